"""Queries of the integrity family: content ids, trees, sketches, stores and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import integrity as I
from quarryline.plans.catalog import query
from quarryline.plans.inputs import LEDGER_SQL, ledger, read
from quarryline.sources.shared import written


@query("SELECT doc_id, sha256(text) AS cid, substr(sha256(text), 1, 16) AS short_id, substr(sha256(text), 1, 2) AS fan, CAST((strlen(text) + 3) // 4 AS BIGINT) AS tokens FROM documents")
def doc_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-42, SF-38, SRC-12: content ids with their fan-out prefix, and token estimates."""
    d = read(spark, sf_dir, "documents")
    cid = F.sha2("text", 256)
    return d.select("doc_id", cid.alias("cid"), F.substring(cid, 1, 16).alias("short_id"), F.substring(cid, 1, 2).alias("fan"), X.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT sha256(text) AS cid, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12, AG-32: contents stored more than once."""
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("cid")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT cid, kinds, n FROM (SELECT substr(sha256(text), 1, 3) AS cid, count(DISTINCT text) AS kinds, count(*) AS n FROM documents GROUP BY 1) WHERE kinds > 1")
def prefix_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: ids, cut to three digits here, that stand for different data."""
    return I.collisions(read(spark, sf_dir, "documents").select(F.substring(F.sha2("text", 256), 1, 3).alias("cid"), F.col("text").alias("data")))


_MERKLE = """
WITH RECURSIVE l(level, idx, hash) AS (
  SELECT CAST(0 AS BIGINT), row_number() OVER (ORDER BY doc_id) - 1, sha256(text) FROM documents
  UNION ALL
  SELECT max(level) + 1, idx // 2, sha256(unhex(concat(min_by(hash, idx), max_by(hash, idx))))
  FROM (SELECT *, max(idx) OVER () AS last FROM l) WHERE last > 0 GROUP BY idx // 2)
SELECT level, count(*) AS nodes, min_by(hash, idx) AS first_hash FROM l GROUP BY level
"""


@query(_MERKLE)
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-24, D8: (level, nodes, first hash) of the tree over all documents in the order of their ids; the last level is the root."""
    levels = I.merkle_levels(written(I.leaves(read(spark, sf_dir, "documents"), ["doc_id"], F.col("text")), "leaves"))
    out = None
    for k, level in enumerate(levels):
        row = level.agg(F.count("*").alias("nodes"), F.min_by("hash", "idx").alias("first_hash")).select(F.lit(k).cast("long").alias("level"), "nodes", "first_hash")
        out = row if out is None else out.unionAll(row)
    return out


@query(
    "WITH l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, sha256(text) AS h FROM documents), n AS (SELECT count(*) AS n FROM l) "
    "SELECT a.idx, CAST(ceil(log2(n)) AS BIGINT) AS steps, true AS valid, a.h = b.h AS next_valid FROM l a, n, l b WHERE b.idx = (a.idx + 1) % n"
)
def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-22, AG-25, SP-02: the proof of every document's leaf, verified, and held against the next leaf, which it refuses unless that has the same text."""
    levels = I.merkle_levels(written(I.leaves(read(spark, sf_dir, "documents"), ["doc_id"], F.col("text")), "leaves"))
    n = F.lit(max(levels[0].count(), 1))
    behind = levels[0].select(F.pmod(F.col("idx") - 1, n).alias("idx"), F.col("hash").alias("next"))
    rows = I.merkle_proofs(levels).join(behind, "idx").crossJoin(F.broadcast(levels[-1].select(F.col("hash").alias("root"))))
    valid = lambda leaf: I.verified(F.col(leaf), F.col("proof"), F.col("root"))
    return rows.select("idx", F.size("proof").cast("long").alias("steps"), valid("leaf").alias("valid"), valid("next").alias("next_valid"))


_MINHASH = r"""
WITH t AS (
  SELECT item_id, w, sha256(w) AS h FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS w FROM benchmark) WHERE length(w) >= 3 AND w NOT IN (%s)),
l AS (SELECT item_id, CAST(lane AS INTEGER) AS lane, CAST('0x' || substr(h, CAST(lane %% 8 * 8 + 1 AS INTEGER), 8) AS UBIGINT)::BIGINT AS word FROM t, range(0, 64) r(lane)),
a AS (SELECT item_id, lane, xor(word, ((lane + 1) * 2654435769) %% 4294967296) AS v FROM l),
b AS (SELECT item_id, lane, CAST((CAST(xor(v, v >> 16) AS HUGEINT) * 2246822507) %% 4294967296 AS BIGINT) AS v FROM a),
c AS (SELECT item_id, lane, CAST((CAST(xor(v, v >> 13) AS HUGEINT) * 3266489909) %% 4294967296 AS BIGINT) AS v FROM b)
SELECT item_id, lane, min(xor(v, v >> 16)) AS value FROM c GROUP BY item_id, lane
"""


@query(_MINHASH % ", ".join(f"'{w}'" for w in X.INDEX_STOP))
def minhash_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-26: 64-lane sketches of the benchmark items' terms."""
    return I.minhash(read(spark, sf_dir, "benchmark"), "item_id")


_STORE = f"WITH {LEDGER_SQL}, stored AS (SELECT * FROM ledger WHERE event_id % 3 = 0), incoming AS (SELECT * FROM ledger WHERE event_id % 2 = 0 UNION ALL SELECT * FROM ledger WHERE event_id % 10 = 0) "


def _put(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = ledger(spark, sf_dir)
    return own.where("event_id % 3 = 0"), own.where("event_id % 2 = 0").unionAll(own.where("event_id % 10 = 0"))


@query(_STORE + "SELECT DISTINCT event_id, kind, model_id FROM incoming WHERE event_id NOT IN (SELECT event_id FROM stored)")
def idempotent_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02, JN-18, SM-02: the rows an idempotent append adds."""
    return I.new_rows(*_put(spark, sf_dir)).select("event_id", "kind", "model_id")


@query(_STORE + "SELECT CAST(count(DISTINCT event_id) FILTER (WHERE event_id NOT IN (SELECT event_id FROM stored)) AS BIGINT) AS added, count(*) - count(DISTINCT event_id) FILTER (WHERE event_id NOT IN (SELECT event_id FROM stored)) AS skipped FROM incoming")
def batch_put_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03: how many rows of a batch are added and skipped."""
    return I.put_counts(*_put(spark, sf_dir))


@query(f"WITH {LEDGER_SQL} SELECT run_id, kind, count(*) AS n FROM ledger WHERE run_id = 'r2' GROUP BY ALL")
def run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04: one run's view of the store."""
    return ledger(spark, sf_dir).where("run_id = 'r2'").groupBy("run_id", "kind").agg(F.count("*").alias("n"))


_IDS = ["kind", "model_id", "condition", "specimen_id", "question_id", "failure_code", "pass"]


_ID_PARTS = ", ".join(f"coalesce('v' || {c}, 'n')" for c in _IDS)


@query(f"WITH {LEDGER_SQL}, i AS (SELECT sha256(concat_ws(chr(1), {_ID_PARTS})) AS cid FROM ledger) SELECT cid, count(*) AS n FROM i GROUP BY cid")
def event_content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-43, SRC-01, SP-17: content ids without id and time; equal evidence has one id."""
    own = ledger(spark, sf_dir)
    return own.select(I.content_id(_IDS).alias("cid")).groupBy("cid").agg(F.count("*").alias("n"))


@query(f"WITH {LEDGER_SQL}, i AS (SELECT sha256(concat_ws(chr(1), 'v' || model_id, 'v' || specimen_id, 'v' || run_id)) AS env, condition FROM ledger) SELECT env, count(DISTINCT condition) AS conditions, count(*) AS n FROM i GROUP BY env")
def env_hash_without_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-44, SP-67, SP-68: a hash of the environment that leaves the varied axis out, so all its values share it."""
    own = ledger(spark, sf_dir)
    return own.select(I.content_id(["model_id", "condition", "specimen_id", "run_id"], ("condition",)).alias("env"), "condition").groupBy("env").agg(F.count_distinct("condition").alias("conditions"), F.count("*").alias("n"))


@query(
    "SELECT state, count(*) AS n FROM (SELECT CASE WHEN d.doc_id % 17 = 5 THEN 'missing' WHEN d.doc_id % 13 = 3 THEN 'changed' ELSE 'ok' END AS state FROM documents d) GROUP BY state"
)
def store_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-24, SRC-13, SP-04: stored content ids against contents hashed anew; some are tampered with here."""
    d = read(spark, sf_dir, "documents")
    stored = d.select("doc_id", F.sha2("text", 256).alias("cid"))
    fresh = d.where("doc_id % 17 <> 5").select("doc_id", F.when(F.col("doc_id") % 13 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return I.audit(stored, fresh, "doc_id")


@query(
    f"WITH {LEDGER_SQL} SELECT concat(model_id, '/', condition) AS fingerprint, count(*) AS success_count, min(ts) AS first_seen, max(ts) AS last_seen, string_agg(DISTINCT specimen_id, ',' ORDER BY specimen_id) AS evidence FROM ledger WHERE pass GROUP BY 1"
)
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17: a registry of working configurations, newly seen ones added up with those on record."""
    own = ledger(spark, sf_dir).where("pass").select(
        F.concat_ws("/", "model_id", "condition").alias("fingerprint"), F.lit(1).cast("long").alias("success_count"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.array("specimen_id").alias("evidence"), "event_id"
    )
    old = own.where("event_id % 2 = 0").drop("event_id")
    none = old.limit(0)
    return I.upserted(I.upserted(none, old), own.where("event_id % 2 = 1").drop("event_id")).withColumn("evidence", F.array_join("evidence", ","))


@query("SELECT doc_id, text FROM documents WHERE (doc_id - 1) % 50 = 0 ORDER BY doc_id LIMIT 10")
def stride_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-19: every fiftieth page, the first ten of them: stride and limit are the dump's parameters."""
    return read(spark, sf_dir, "documents").where(F.pmod(F.col("doc_id") - 1, F.lit(50)) == 0).orderBy("doc_id").limit(10).select("doc_id", "text")


@query(
    "WITH d AS (SELECT doc_id, CAST(floor(doc_id / 100.0) AS BIGINT) AS segment, md5('7|' || doc_id) AS h FROM documents) SELECT segment, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY h) AS n FROM d) WHERE n = 1"
)
def spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-12: one seeded page of each equal segment."""
    h = F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string")))
    return read(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("segment")).agg(F.min_by("doc_id", h).alias("doc_id"))


@query(
    "WITH d AS (SELECT doc_id, sha256('seed|' || doc_id) AS h FROM documents) SELECT doc_id FROM (SELECT doc_id FROM d ORDER BY h LIMIT 12) UNION SELECT min(doc_id) FROM d UNION SELECT max(doc_id) FROM d"
)
def chained_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-13: a sample by hash that holds the first and the last page."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    some = d.orderBy(F.sha2(F.concat(F.lit("seed|"), F.col("doc_id").cast("string")), 256)).limit(12)
    return some.unionAll(d.agg(F.min("doc_id"))).unionAll(d.agg(F.max("doc_id"))).distinct()
