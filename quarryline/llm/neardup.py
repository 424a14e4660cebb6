"""Near duplicates by BagMinHash signatures (operator 4).

Texts are multisets of shingles of five words (a shorter text is one shingle of all its words);
two are linked when their weighted Jaccard similarity is 0.8 or more, and classes are the
connected components of the links. Texts with equal words are one node from the start.
A null or empty text, or one of white space, has no words and is a class of its own.
Repeated rows and repeated ids belong to the class of their text; a null id is kept as null
and its class is named by the least id of the class, null if there is none. Long texts are
read whole. An empty table gives an empty result; columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quarryline.llm import textkernel as K
from quarryline.llm.common import bounded_batches, fresh, written
from quarryline.llm.components import components

SHINGLE = 5
SIMILAR = 0.8
#: A pair at similarity 0.8 shares one of 36 bands of 7 values with probability 0.9998; one at 0.2 with 0.0005.
BANDS, ROWS = 36, 7
#: Ids of texts to fetch go to every executor up to this number (16 MB); beyond it they are joined by a shuffle.
MOST_SENT = 500_000
#: Shingles of a block of a band's nodes, and of the tiles that a task's group holds, about.
BLOCK, GROUP = 250_000, 1_000_000


def bag_min_hash(x: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """n signatures of m values of the weighted sets whose elements are x, by owner.

    An element's weights are cut at the powers of two: [0,1), [1,2), [2,4), [4,8) and so on. Each cut
    has a Poisson process of its own, seeded by the element and the cut, with as many points
    a unit of time as the cut is wide; a point halves its way down to one unit cell of the cut and
    counts if the element's weight covers that cell. It falls on one of the m values, which keeps the
    earliest time. Two sets agree in a value with a probability of their weighted Jaccard similarity.
    A process ends as soon as its next point is later than all values of its set, so that
    a set needs about m ln m points besides one for each element.
    """
    owners, seeds, widths, tops = [owner], [K.mixed(x)], [np.ones(len(x))], [np.ones(len(x), dtype=np.int64)]
    cut, low = 1, 1
    more = np.flatnonzero(weight > 1)
    while len(more):
        owners.append(owner[more])
        seeds.append(K.mixed(x[more] + np.array([cut], dtype=np.uint64) * K.U64(0xA0761D6478BD642F)))
        widths.append(np.full(len(more), float(low)))
        tops.append(np.minimum(weight[more] - low, low))
        cut, low = cut + 1, 2 * low
        more = more[weight[more] > low]
    of, seed, width, top = (np.concatenate(v) for v in (owners, seeds, widths, tops))
    time = np.zeros(len(of))
    made = np.zeros(len(of), dtype=np.uint64)
    out = np.full(n * m, np.inf)
    while len(of):
        many = 1 if len(of) > 20_000 else min(64, 40_000 // len(of))
        step = made[:, None] + np.arange(1, many + 1, dtype=np.uint64)
        at = K.mixed(seed[:, None] + step * K.U64(0xE7037ED1A0B428DB))
        times = time[:, None] + np.cumsum(-np.log(K.unit(at)) / width[:, None], axis=1)
        where = K.mixed(at + K.U64(0x8EBC6AF09C88C6E3))
        slot = ((where >> K.U64(32)) * K.U64(m)) >> K.U64(32)
        cell = (where & K.U64(0xFFFFFFFF)).astype(np.int64) & (width.astype(np.int64) - 1)[:, None]
        good = cell < top[:, None]
        np.minimum.at(out, ((of * m)[:, None] + slot.astype(np.int64))[good], times[good])
        last = out.reshape(n, m).max(axis=1)
        time, made = times[:, -1], step[:, -1]
        on = time < last[of]
        of, seed, width, top, time, made = of[on], seed[on], width[on], top[on], time[on], made[on]
    return out.reshape(n, m)


def _order_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each text's sequence of words."""
    place = np.arange(len(h), dtype=np.int64) - np.repeat(at[:-1], np.diff(at))
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(K.mixed(h + K.mixed(place.astype(np.uint64))), out=total[1:])
    return K.mixed(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


SIGNED = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


@arrow_udf(SIGNED)
def signed(texts: pa.Array) -> pa.Array:
    """The hash of a text's words, the number of its shingles and a hash of each band; all null without words."""
    nodes = np.zeros(len(texts), dtype=np.int64)
    sizes = np.zeros(len(texts), dtype=np.int64)
    bands = np.zeros((len(texts), BANDS), dtype=np.int64)
    for w in K.words(texts):
        h = w.hashes(w.start, w.end)
        nodes[w.first : w.first + w.n] = _order_hash(h, w.word_at).view(np.int64)
        run, at = K.windows(h, w.word_at, SHINGLE)
        n = np.diff(at)
        sizes[w.first : w.first + w.n] = n
        owner = np.repeat(np.arange(w.n), n)
        tags = K.tagged(run, owner)
        often = np.flatnonzero(K.repeated(tags))
        _, first, count = np.unique(tags[often], return_index=True, return_counts=True)
        once = np.ones(len(run), dtype=bool)
        once[often] = False
        pick = np.concatenate([np.flatnonzero(once), often[first]])
        weight = np.concatenate([np.ones(len(pick) - len(first), dtype=np.int64), count])
        some = np.flatnonzero(n)
        dense = np.zeros(w.n, dtype=np.int64)
        dense[some] = np.arange(len(some))
        values = bag_min_hash(run[pick], weight, dense[owner[pick]], len(some), BANDS * ROWS)
        parts = K.mixed(values.view(np.uint64)).reshape(len(some), BANDS, ROWS)
        total = np.zeros((len(some), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            total = (total + parts[:, :, r]) * K.U64(0xC2B2AE3D27D4EB4F)
        total = K.mixed(total + np.arange(1, BANDS + 1, dtype=np.uint64) * K.U64(0x9E3779B97F4A7C15))
        bands[w.first + some] = total.view(np.int64)
    none = pa.array(sizes == 0)
    at = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS)
    lists = pa.ListArray.from_arrays(at, pa.array(bands.reshape(-1)))
    fields = [pa.array(nodes, mask=sizes == 0), pa.array(sizes), lists]
    return pa.StructArray.from_arrays(fields, fields=[pa.field("node", pa.int64()), pa.field("n", pa.int64()), pa.field("bands", pa.list_(pa.int64()))], mask=none)


SHINGLES = T.StructType([T.StructField("node", T.LongType()), T.StructField("bag", T.BinaryType())])


@arrow_udf(SHINGLES)
def shingles(texts: pa.Array) -> pa.Array:
    """A text's node and its shingles as sorted 64-bit hashes, those of a repeated shingle told apart by their number."""
    nodes, bags = [], []
    for w in K.words(texts):
        h = w.hashes(w.start, w.end)
        nodes.append(_order_hash(h, w.word_at).view(np.int64))
        run, at = K.windows(h, w.word_at, SHINGLE)
        for i in range(w.n):
            own = np.sort(run[at[i] : at[i + 1]])
            fresh_ = np.ones(len(own), dtype=bool)
            fresh_[1:] = own[1:] != own[:-1]
            number = np.arange(len(own)) - np.flatnonzero(fresh_)[np.cumsum(fresh_) - 1] if len(own) else np.zeros(0, dtype=np.int64)
            bags.append(np.sort(K.mixed(own + number.astype(np.uint64) * K.U64(0x9E3779B97F4A7C15))).tobytes())
    return pa.StructArray.from_arrays([pa.array(np.concatenate(nodes) if nodes else [], pa.int64()), pa.array(bags, pa.binary())], names=["node", "bag"])


@arrow_udf(T.DoubleType())
def overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """The weighted Jaccard similarity of two bags of shingles()."""
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
        both = len(np.intersect1d(x, y, assume_unique=True))
        out[i] = both / (len(x) + len(y) - both) if len(x) + len(y) > both else 0.0
    return pa.array(out)


def few(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df with a hint to send it to every executor, if it has no more than most rows."""
    return F.broadcast(df) if df.count() <= most else df


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _similar(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b, sim) of pairs (a, b); a hot node's rows are split by Spark's skew join."""
    left = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", overlap("bag_a", "bag_b").alias("sim"))


def _bags(documents: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingles of the wanted nodes, each from the text of one row."""
    rows = few(nodes.join(wanted.distinct(), "node").select(F.col("rep").alias("_rep"), F.col("hash").alias("_hash")))
    found = documents.select("doc_id", "text").join(rows, F.col("doc_id").eqNullSafe(F.col("_rep")) & (_text_hash() == F.col("_hash")), "left_semi")
    return found.select(shingles("text").alias("s")).select("s.*").dropDuplicates(["node"])


def _linked(documents: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between nodes that share a band and have similar bags; enough of them for the components.

    First each band's nodes are held against the band's least node, and joined where similar. Nodes of a band that
    are in one component by then need no link more. Of the rest, nodes of two components are
    held against each other inside tasks, a large band block against block, unless their sizes, or by the
    triangle inequality of the Jaccard distance their similarities to the band's least node, rule out a link.
    """
    members = nodes.select("node", "n", F.explode("bands").alias("band"))
    heads = written(members.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1").drop("size"), "heads")
    with_head = written(members.join(heads, "band"), "members")
    firsts = with_head.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    firsts = written(firsts, "pairs")
    ids = firsts.select(F.col("a").alias("node")).union(firsts.select("b"))
    bags = written(_bags(documents, nodes, ids), "bags")
    sims = written(_similar(firsts, bags), "sims")
    links = sims.where(F.col("sim") >= similar).select("a", "b")
    roots = written(components(links), "roots")
    placed = with_head.join(roots, "node", "left").join(sims.select(F.col("a").alias("node"), F.col("b").alias("head"), "sim"), ["node", "head"], "left")
    placed = placed.select("band", "node", "n", F.coalesce("root", "node").alias("root"), F.coalesce("sim", F.lit(1.0)).alias("sim"), (F.col("node") == F.col("head")).alias("is_head"))
    # the band's least node has been held against all others
    open_ = written(_open(placed.where("not is_head")), "open")
    tiles = _tiles(open_)
    many = max(1, (tiles.agg(F.sum("n")).first()[0] or 0) // GROUP)
    tiles = tiles.join(bags, "node").withColumn("part", F.pmod(F.xxhash64("band", "low", "high"), F.lit(many)))
    late = written(tiles.groupBy("part").applyInArrow(tile_linker(similar), "a long, b long").distinct(), "late")
    return roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(late)


def _open(placed: DataFrame) -> DataFrame:
    """The nodes of bands with two roots or more; with whether a node is of the band's largest root, and in how many blocks those
    and the others are dealt: none of either if the band is one tile."""
    sums = placed.groupBy("band", "root").agg(F.sum("n").alias("s"))
    bands = sums.groupBy("band").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("s", "root")).alias("big"), F.max("s").alias("big_s"), F.sum("s").alias("s")).where("roots > 1")
    blocks = lambda s: F.when(F.col("s") > BLOCK, F.ceil(s / BLOCK)).otherwise(0).cast("int")
    bands = bands.select("band", "big", blocks(F.col("s") - F.col("big_s")).alias("rests"), blocks(F.col("big_s")).alias("bigs"))
    return placed.join(bands, "band").withColumn("is_big", F.col("root") == F.col("big")).drop("big")


def _tiles(open_: DataFrame) -> DataFrame:
    """The nodes of _open() with the tiles they are in: blocks low and high of a band, and their own block.

    The largest root's nodes are one component, so none of their blocks meets another of theirs, only the blocks of the
    others: a band of one large root and few others is sent once, and the others once for each of its blocks.
    """
    hashed = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    block = F.when(F.col("is_big"), F.col("rests") + hashed("bigs")).otherwise(hashed("rests"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("is_big"), F.col("rests")).otherwise(F.col("rests") + F.col("bigs")) - 1))
    many = open_.where("rests > 0").select("*", block.alias("block"), other.alias("o")).select("*", F.least("block", "o").alias("low"), F.greatest("block", "o").alias("high")).drop("o")
    one = open_.where("rests = 0").select("*", F.lit(0).alias("block"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    return one.unionByName(many).drop("rests", "bigs", "is_big")


def tile_linker(similar: float):
    """tile_links() at a similarity, as a function of a group's rows."""

    def linked(table: pa.Table) -> pa.Table:
        return tile_links(table, similar)

    return linked


def tile_links(table: pa.Table, similar: float = SIMILAR) -> pa.Table:
    """Links between the roots that meet in each tile, a spanning forest of them: no more than a tile has rows.

    A tile is a block of a band's nodes, or two blocks held against each other.
    """
    node, root, size, sim, block = (table.column(c).to_numpy() for c in ("node", "root", "n", "sim", "block"))
    keys = np.column_stack([table.column(c).to_numpy() for c in ("band", "low", "high")])
    bags = table.column("bag").combine_chunks()
    at = np.frombuffer(bags.buffers()[1], dtype=np.int32)[bags.offset : bags.offset + len(bags) + 1].astype(np.int64) // 8
    words = np.frombuffer(bags.buffers()[2], dtype=np.uint64)
    out = []
    order = np.lexsort(keys.T)
    cut = np.flatnonzero(np.concatenate([[True], (keys[order][1:] != keys[order][:-1]).any(axis=1), [True]]))
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        own = order[i:j]
        low, high = keys[own[0], 1:]
        root_, block_, size_, sim_ = root[own].copy(), block[own], size[own], sim[own]
        if len(np.unique(root_)) < 2:
            continue
        first = np.concatenate([[0], np.cumsum(size_)])
        _, ids = np.unique(np.concatenate([words[at[k] : at[k + 1]] for k in own]), return_inverse=True)
        mark = np.zeros(len(ids), dtype=bool)
        for k in range(len(own)):
            able = (root_ != root_[k]) & (np.minimum(size_, size_[k]) >= similar * np.maximum(size_, size_[k])) & (np.abs(sim_ - sim_[k]) <= 1 - similar + 1e-9)
            able[:k] = False
            if low != high:
                able &= block_ != block_[k]
            to = np.flatnonzero(able)
            if not len(to):
                continue
            mark[ids[first[k] : first[k + 1]]] = True
            if 4 * len(to) < len(own):
                both = np.array([np.count_nonzero(mark[ids[first[t] : first[t + 1]]]) for t in to])
            else:
                both = np.add.reduceat(mark[ids].astype(np.int64), first[:-1])[to]
            mark[ids[first[k] : first[k + 1]]] = False
            near = to[both >= similar * (size_[to] + size_[k] - both)]
            for t in near:
                if root_[t] != root_[k]:
                    out.append((node[own[k]], node[own[t]]))
                    root_[root_ == root_[t]] = root_[k]
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _classes(documents: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, hash, node) of documents, and (node, class_node, class_id, class_hash)."""
    rows = written(bounded_batches(documents).select("doc_id", _text_hash().alias("hash"), signed("text").alias("s")).select("doc_id", "hash", "s.*"), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))
    nodes = rows.where("node is not null").groupBy("node").agg(least.alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("node", F.col("rep.doc_id").alias("rep"), F.col("rep.hash").alias("hash"), "n", "bands"), "nodes")
    roots = components(_linked(documents, nodes, similar))
    joined = nodes.select("node", "rep", "hash").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = joined.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "hash")).alias("best"))
    named = joined.join(best, "root").select("node", F.col("best.rep").alias("class_id"), F.col("best.hash").alias("class_hash"))
    return rows.select("doc_id", "hash", "node"), written(named, "classes")


def near_duplicates(documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id and class_id of every row of documents; class_id is the least doc_id of the class.

    The bands are made for a similarity of 0.8 or more; below that, pairs share one less surely.
    """
    rows, named = _classes(documents, similar)
    return rows.join(named, "node", "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of documents, as they are, without all but one row of each class.

    Of rows that repeat both the id and the text of the class's first row, the one of the least values in the other
    columns stays, compared as JSON.
    """
    rows, named = _classes(documents, similar)
    placed = rows.where("node is not null").join(named, "node")
    is_best = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("hash") == F.col("class_hash"))
    # names that no column of documents has, so that nothing is ambiguous
    id_, hash_, key = (fresh(documents, name) for name in ("_id", "_hash", "_key"))
    gone = placed.where(~is_best).select(F.col("doc_id").alias(id_), F.col("hash").alias(hash_)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (_text_hash() == F.col(hash_))
    left = documents.join(few(written(gone, "gone")), same, "left_anti")
    again = placed.where(is_best).groupBy("doc_id", "hash").count().where("count > 1").select(F.col("doc_id").alias(id_), F.col("hash").alias(hash_))
    again = written(again, "again")
    if again.isEmpty():
        return left
    quoted = [F.col(f"`{c.replace('`', '``')}`") for c in left.columns]
    twice = left.join(few(again), same, "left_semi").select(F.struct(*quoted).alias(key))
    first = twice.groupBy(F.col(key)["doc_id"].alias(id_), F.xxhash64(F.coalesce(F.col(key)["text"], F.lit(""))).alias(hash_)).agg(F.min_by(key, F.to_json(key)).alias(key))
    return left.join(few(again), same, "left_anti").unionAll(first.select(f"{key}.*"))
