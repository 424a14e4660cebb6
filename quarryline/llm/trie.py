"""A trie of conversations' prefixes by preorder intervals (operator 12).

A conversation c is rebuilt: the first h turns of conversation c - c % 100, h being crc32 of c in decimal modulo 6, then c's own turns
after its first h. Each distinct sequence of first turns is a node; the root is the sequence of none. Turns stand by number, null
first, equal numbers by a hash of role and text; null roles and texts are empty.

Method. Turns become symbols, 128 bits of a hash of role and text, and conversations are ranked in the lexicographic order of their symbols: blocks
of 32 turns are ranked, blocks of 32 ranks, and so on until each conversation is one rank, so no row or group grows with a long
conversation. A node is known by its depth and four running sums of hashes of (symbol, depth), 128 bits in all; it is introduced by the least
rank r of its members and ends with their greatest rank. Nodes in the order of (r, depth) are in preorder, and a subtree
is an interval of it: its end is the last node that is introduced up to the greatest rank. Leaves and saved tokens of a subtree are
differences of running sums at the interval's ends. Running sums and places are made by ranges of rows (prefix.running), so a
conversation, first turn or conversation's copies with a third of all rows are dealt like others; texts leave the first scan as hash and length only.
The digest of a node's ending conversations is read off their sorted ids as a stream: one pass, one hasher at a time in memory.

% has the sign of its left side, as in SQL. A null conv_id names no conversation; its rows are left out. Repeated rows are turns of
their own. A rebuilt conversation without turns is a member of the root alone. Texts are hashed whole, however long; an empty table
has no node, not even a root. Columns beside conv_id, turn, role and text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import written
from quarryline.llm.prefix import running

GROUP_OF, SHARED = 100, 6
BLOCK = 32
LANES = [f"p{i}" for i in range(4)]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def symbol(role: Column, text: Column) -> Column:
    """128 bits that stand for a turn; the role's length keeps role and text apart."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("long")


def _lane(i: int) -> Column:
    """32 bits of a hash of a turn's symbol and depth; their sums stay within a long."""
    return F.xxhash64("symbol", "depth", F.lit(i)).bitwiseAND(F.lit(0xFFFFFFFF))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, size) of all conversations, and their turns as they are rebuilt: conv_id, depth, symbol, chars."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", symbol(role, text).alias("symbol"), F.length(text).cast("long").alias("chars"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "symbol"]
    turns = written(running(turns, order, {"place": F.lit(1)}, key="conv_id").drop("turn"), "turns")
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("h", shared_turns(F.col("conv_id")))
    counts = written(counts.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP_OF), "counts")
    given = F.least("h", F.coalesce("there", F.lit(0)))
    plan = counts.join(counts.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left").select("conv_id", "base", "h", "own", given.alias("given"))
    plan = written(plan.withColumn("size", F.col("given") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "plan")
    heads = turns.where(F.col("place") < SHARED).withColumnRenamed("conv_id", "base")
    first = plan.where("given > 0").join(heads, "base").where("place <= h").select("conv_id", F.col("place").alias("depth"), "symbol", "chars")
    rest = turns.join(plan, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("depth"), "symbol", "chars")
    return plan.select("conv_id", "size"), written(first.union(rest), "rebuilt")


def _order_of(rows: DataFrame) -> DataFrame:
    """rows (conv_id, depth, symbol) to (conv_id, rank): 1, 2, ... in the lexicographic order of the symbols; equal conversations share a rank."""
    level = rows.select("conv_id", F.col("depth").alias("at"), "symbol")
    while True:
        blocks = level.groupBy("conv_id", F.floor((F.col("at") - 1) / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("all"))
        blocks = written(blocks.select("conv_id", (F.col("block") + 1).alias("at"), F.col("all.symbol").alias("symbols")), "blocks")
        ranks = running(blocks.select("symbols").distinct(), ["symbols"], {"symbol": F.lit(1)})
        level = blocks.join(ranks, "symbols").select("conv_id", "at", "symbol")
        last = blocks.agg(F.max("at")).first()[0]
        if last is None or last == 1:
            return level.select("conv_id", F.col("symbol").alias("rank"))
        level = written(level, "level")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, conv_id), sorted, to (rank, ends_sha256): the hash of the ids in decimal, comma-joined."""
    rank, hasher = None, None
    for batch in batches:
        ranks, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.string()).to_pylist()
        cut = [0, *[i for i in range(1, len(ranks)) if ranks[i] != ranks[i - 1]], len(ranks)]
        out = []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if i == j:
                continue
            joined = ",".join(texts[i:j]).encode()
            if ranks[i] == rank:
                hasher.update(b"," + joined)
                continue
            if hasher:
                out.append((rank, hasher.hexdigest()))
            rank, hasher = int(ranks[i]), hashlib.sha256(joined)
        yield pa.record_batch([pa.array([r for r, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], names=["rank", "ends_sha256"])
    if hasher:
        yield pa.record_batch([pa.array([rank], pa.int64()), pa.array([hasher.hexdigest()], pa.string())], names=["rank", "ends_sha256"])


def nodes(sizes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct nodes, and (rank, conv_id) of all conversations; those without turns have rank 0."""
    ranks = written(sizes.join(_order_of(rows), "conv_id", "left").select("conv_id", F.coalesce("rank", F.lit(0)).alias("rank"), "size"), "ranks")
    classes = written(ranks.groupBy("rank").agg(F.count("*").alias("copies"), F.min("conv_id").alias("conv_id"), F.first("size").alias("size")), "classes")
    own = rows.join(classes.select("conv_id"), "conv_id", "left_semi")  # of equal conversations one stands for all
    paths = running(own, ["conv_id", "depth"], {p: _lane(i) for i, p in enumerate(LANES)}, key="conv_id")
    paths = paths.select("conv_id", "depth", "chars", *[_lane(i).alias(f"last{i}") for i in range(4)], *LANES).join(classes, "conv_id")
    root = classes.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "chars", "last0", "last1", "last2", "last3", *LANES)], "rank", "copies", "size")
    grouped = paths.unionByName(root).groupBy("depth", *LANES).agg(
        F.min("rank").alias("rank"), F.max("rank").alias("last_rank"), F.sum("copies").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.first("chars").alias("chars"), F.max("size").alias("deepest"), F.min_by("size", "rank").alias("size"), *[F.first(f"last{i}").alias(f"last{i}") for i in range(4)],
    )
    return written(grouped, "nodes"), ranks.select("rank", "conv_id")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; its interval is start to end."""
    sizes, rows = rebuilt(conversations)
    found, members = nodes(sizes, rows)
    # places in preorder and running sums over it
    leaf, saved = (F.col("depth") == F.col("deepest")).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    found = found.withColumn("leaf", leaf).withColumn("saved", saved)
    placed = written(running(found, ["rank", "depth"], {"start": F.lit(1), "leaves": F.col("leaf"), "saving": F.col("saved")}), "placed")
    # the last node that a rank introduces is where its conversation ends
    ends = placed.groupBy(F.col("rank").alias("last_rank")).agg(F.max("start").alias("end"), F.max_by("leaves", "start").alias("leaves_end"), F.max_by("saving", "start").alias("saving_end"))
    placed = placed.join(ends, "last_rank")
    parent = [(F.col(p) - F.col(f"last{i}")).alias(p) for i, p in enumerate(LANES)]
    key = ["depth", *LANES]
    children = placed.where("depth > 0").select((F.col("depth") - 1).alias("depth"), *parent)
    counted = children.groupBy(*key).agg(F.count("*").alias("n_children"))
    above = placed.select((F.col("depth") + 1).alias("up_depth"), *[F.col(p).alias(f"up_{p}") for p in LANES], F.col("conv_id").alias("parent_conv_id"))
    is_above = F.col("depth") == F.col("up_depth")
    for i, p in enumerate(LANES):
        is_above &= (F.col(p) - F.col(f"last{i}")) == F.col(f"up_{p}")
    hashed = members.repartition("rank").sortWithinPartitions("rank", "conv_id").mapInArrow(digests, "rank long, ends_sha256 string")
    hashed = hashed.withColumnRenamed("rank", "ends_rank")
    out = placed.join(counted, key, "left").join(above, is_above, "left")
    out = out.join(hashed, (F.col("rank") == F.col("ends_rank")) & (F.col("depth") == F.col("size")), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), (F.col("leaves_end") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saving_end") - F.col("saving") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "start", "end",
    )


#: crc32 by its polynomial, bit by bit; prefixes as lists of turns, compared as lists.
ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT conv_id, turn, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS symbol, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, symbol) AS place FROM v),
c AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name, conv_id - conv_id % 100 AS base FROM t),
k AS (SELECT conv_id, base, name, 0 AS i, CAST(4294967295 AS BIGINT) AS crc FROM c
  UNION ALL SELECT conv_id, base, name, i + 1, list_reduce(list_prepend(xor(crc, CAST(ascii(name[i + 1]) AS BIGINT)), [CAST(b AS BIGINT) FOR b IN range(8)]),
    lambda a, b: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END)) FROM k WHERE i < length(name)),
h AS (SELECT conv_id, base, xor(crc, 4294967295) % 6 AS h FROM k WHERE i = length(name)),
r AS (SELECT h.conv_id, t.place AS at, t.symbol, t.chars FROM h JOIN t ON t.conv_id = h.base AND t.place <= h.h
  UNION ALL SELECT h.conv_id, t.place + 6, t.symbol, t.chars FROM h JOIN t ON t.conv_id = h.conv_id AND t.place > h.h),
s AS (SELECT h.conv_id, coalesce(list({'s': r.symbol, 'n': r.chars} ORDER BY r.at) FILTER (WHERE r.at IS NOT NULL), []) AS seq FROM h LEFT JOIN r ON h.conv_id = r.conv_id GROUP BY h.conv_id),
p AS (SELECT conv_id, seq, d, seq[1:d] AS path FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM s)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(path[d].n), 0) AS chars,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(seq) = d), '') AS ends FROM p GROUP BY path, d),
q AS (SELECT n.path, count(m.path) AS n_children FROM n LEFT JOIN n m ON m.d = n.d + 1 AND m.path[1:n.d] = n.path GROUP BY n.path),
x AS (SELECT n.*, q.n_children, unnest(range(n.d + 1)) AS up FROM n JOIN q ON n.path = q.path),
u AS (SELECT path[1:up] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens, count(*) AS nodes FROM x GROUP BY path[1:up]),
o AS (SELECT n.*, q.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, row_number() OVER (ORDER BY n.path) AS start, u.nodes FROM n JOIN q ON n.path = q.path JOIN u ON n.path = u.path)
SELECT o.conv_id, o.d AS depth, m.conv_id AS parent_conv_id, o.n_convs, o.n_children, o.n_leaves, o.saved_tokens, sha256(o.ends) AS ends_sha256,
       o.start, o.start + o.nodes - 1 AS "end"
FROM o LEFT JOIN n m ON o.d > 0 AND m.d = o.d - 1 AND m.path = o.path[1:o.d - 1]
"""
