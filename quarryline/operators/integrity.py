"""Content ids, Merkle trees, sketches, audits and append-only stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import tokens
from quarryline.operators.ordering import placed
from quarryline.sources.shared import written

MINHASH_LANES = 64


def content_id(columns: list[str], without: tuple[str, ...] = ("ts",)) -> Column:
    """SHA-256 over the record's columns in their order, those that change between writes left out; null is unlike empty."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns if c not in without]
    return F.sha2(F.concat_ws("\x01", *parts), 256)


def leaves(rows: DataFrame, order: list[str], content: Column) -> DataFrame:
    """(idx, hash) of rows in order, from 0."""
    return placed(rows.select(*order, F.sha2(content, 256).alias("hash")), *order, name="idx", first=0).select("idx", "hash")


def _parent(level: DataFrame) -> DataFrame:
    """One level up: two neighbours hash to one, the last of an odd number with itself."""
    pair = level.groupBy((F.col("idx") / 2).cast("long").alias("idx")).agg(F.max_by("hash", -F.col("idx")).alias("l"), F.max_by("hash", F.col("idx")).alias("r"))
    return pair.select("idx", F.sha2(F.concat(F.unhex("l"), F.unhex("r")), 256).alias("hash"))


def merkle_levels(indexed: DataFrame) -> list[DataFrame]:
    """The tree's levels, leaves first, the root last; as many as the leaves' number has bits. Each is written, so none is worked out twice."""
    out = [indexed.select("idx", "hash")]
    n = indexed.count()
    while n > 1:
        out.append(written(_parent(out[-1]), "level"))
        n = (n + 1) // 2
    return out


def merkle_proof(levels: list[DataFrame], idx: int) -> list[tuple[str, str]]:
    """(side, hash) from the leaf upwards: what stands beside the path."""
    proof = []
    for level in levels[:-1]:
        other = idx ^ 1
        near = {r["idx"]: r["hash"] for r in level.where(F.col("idx").isin([idx, other])).collect()}
        proof.append(("R" if other > idx else "L", near.get(other, near[idx])))
        idx //= 2
    return proof


def merkle_proofs(levels: list[DataFrame]) -> DataFrame:
    """(idx, leaf, proof) of every leaf, the proof as in merkle_proof: one join a level from the root down, where both children of a node take over its proof."""
    out = levels[-1].select("idx", F.col("hash").alias("leaf"), F.array().cast("array<struct<side:string,hash:string>>").alias("proof"))
    for level in reversed(levels[:-1]):
        pair = level.groupBy((F.col("idx") / 2).cast("long").alias("idx")).agg(F.max_by("hash", -F.col("idx")).alias("l"), F.max_by("hash", F.col("idx")).alias("r"), F.count("*").alias("n"))
        step = lambda side, h: F.concat(F.array(F.struct(F.lit(side).alias("side"), F.col(h).alias("hash"))), F.col("proof"))
        left = F.struct((2 * F.col("idx")).alias("idx"), F.col("l").alias("leaf"), step("R", "r").alias("proof"))
        right = F.struct((2 * F.col("idx") + 1).alias("idx"), F.col("r").alias("leaf"), step("L", "l").alias("proof"))
        both = F.when(F.col("n") == 2, F.array(left, right)).otherwise(F.array(left))
        out = pair.join(out.select("idx", "proof"), "idx").select(F.explode(both).alias("c")).select("c.*")
    return out


def verified(leaf: Column, proof: Column, root: Column) -> Column:
    """Whether an array of (side, hash) leads from the leaf to the root."""
    def up(h: Column, s: Column) -> Column:
        a, b = F.when(s["side"] == "L", s["hash"]).otherwise(h), F.when(s["side"] == "L", h).otherwise(s["hash"])
        return F.sha2(F.concat(F.unhex(a), F.unhex(b)), 256)

    return F.aggregate(proof, leaf, up) == root


def _times(a: Column, b: int) -> Column:
    """a * b modulo 2**32, by halves of a so that no product leaves 64 bits."""
    high = ((F.shiftright(a, 16) * F.lit(b)).bitwiseAND(F.lit(0xFFFF))) * 65536
    return (high + a.bitwiseAND(F.lit(0xFFFF)) * F.lit(b)).bitwiseAND(F.lit(0xFFFFFFFF))


# The multipliers of the 32-bit mixing function.
MIX_STEP, MIX_A, MIX_B = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35


def minhash(documents: DataFrame, key: str) -> DataFrame:
    """(key, lane, value): the least mixed hash of a text's terms in each of 64 lanes.

    A lane starts from one of the eight words of the term's SHA-256.
    """
    terms = documents.select(key, F.explode(tokens(F.col("text"))).alias("term")).select(key, F.sha2("term", 256).alias("h"))
    lanes = terms.select(key, "h", F.explode(F.sequence(F.lit(0), F.lit(MINHASH_LANES - 1))).alias("lane"))
    word = F.conv(F.substring("h", F.pmod(F.col("lane"), F.lit(8)) * 8 + 1, F.lit(8)), 16, 10).cast("long")
    step = _times((F.col("lane") + 1).cast("long"), MIX_STEP)
    v = word.bitwiseXOR(step)
    v = v.bitwiseXOR(F.shiftright(v, 16))
    lanes = lanes.select(key, "lane", v.alias("v")).withColumn("v", _times(F.col("v"), MIX_A))
    lanes = lanes.withColumn("v", F.col("v").bitwiseXOR(F.shiftright("v", 13))).withColumn("v", _times(F.col("v"), MIX_B))
    return lanes.groupBy(key, "lane").agg(F.min(F.col("v").bitwiseXOR(F.shiftright("v", 16))).alias("value"))


def new_rows(stored: DataFrame, incoming: DataFrame, key: str = "event_id") -> DataFrame:
    """The incoming rows that aren't stored yet, each once: what an idempotent append writes."""
    return incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def put_counts(stored: DataFrame, incoming: DataFrame, key: str = "event_id") -> DataFrame:
    """(added, skipped) of an idempotent append."""
    once = incoming.groupBy(key).agg(F.count("*").alias("n"))
    known = stored.select(F.col(key)).distinct().withColumn("known", F.lit(True))
    both = once.join(known, key, "left")
    return both.agg(F.count_if(F.col("known").isNull()).alias("added"), F.sum(F.when(F.col("known").isNull(), F.col("n") - 1).otherwise(F.col("n"))).cast("long").alias("skipped"))


def collisions(objects: DataFrame, cid: str = "cid", data: str = "data") -> DataFrame:
    """Content ids that stand for different data."""
    return objects.groupBy(cid).agg(F.count_distinct(F.sha2(data, 256)).alias("kinds"), F.count("*").alias("n")).where("kinds > 1")


def audit(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of each outcome when contents are hashed again: ok, changed, missing."""
    new = fresh.select(key, F.sha2("text", 256).alias("now"))
    both = stored.select(key, "cid").join(new, key, "left")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("cid"), "ok").otherwise("changed")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def upserted(old: DataFrame, seen: DataFrame) -> DataFrame:
    """A registry (fingerprint, success_count, first_seen, last_seen, evidence) with newly seen rows added up."""
    rows = old.unionByName(seen)
    sums = rows.groupBy("fingerprint").agg(F.sum("success_count").cast("long").alias("success_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    # distinct items meet before they are listed
    items = rows.select("fingerprint", F.explode("evidence").alias("item")).distinct().groupBy("fingerprint").agg(F.array_sort(F.collect_list("item")).alias("evidence"))
    return sums.join(items, "fingerprint", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(old.schema["evidence"].dataType)))
