"""Tables of sets held against each other: containment of one in the other, and what one state keeps of another."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarryline.functions.numeric import ratio
from quarryline.sources.shared import bounded_batches, written

#: Elements of items that go to every executor at once.
BLOCK = 1_000_000
#: Rows and queries of one cell of vectors, and pages of one cell of terms: what a task holds at once.
VECTORS, QUERIES, PAGES = 8_192, 16_384, 8_192


def _shares(items: DataFrame, least: float, block: int, own: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(item_id, doc_id, shared, total, share) of items (item_id, t), where `own` gives (doc_id, e) of the documents for a block of elements (item_id, total, e)."""
    each = written(items.select("item_id", F.size("t").cast("long").alias("total"), F.explode_outer("t").alias("e")).where("e IS NOT NULL"), "elements")
    many = max(1, -(-each.count() // block))
    hits = []
    for b in range(many):
        part = each.where(F.pmod(F.xxhash64("item_id"), F.lit(many)) == b)
        found = own(part).join(F.broadcast(part), "e").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"), F.first("total").alias("total"))
        hits.append(found.withColumn("share", F.col("shared") / F.col("total")).where(F.col("share") >= least))
    return reduce(DataFrame.unionAll, hits)


def contained(docs: DataFrame, items: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(item_id, doc_id, shared, total, share) of items (item_id, t) of whose set a document (doc_id, t) has a share of `least` or more.

    The items' elements go out in blocks of some `block` of them, so that no element, however common, is one task's; a document's
    hits are summed up before they are shuffled. Docs are read once a block.
    """
    # an outer one: of others Spark asks for their size before, and makes the elements for each question
    each = docs.select("doc_id", F.explode_outer("t").alias("e"))
    return _shares(items, least, block, lambda part: each)


def _held(runs: list[str], n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches (doc_id, text), (doc_id, e) of the runs of n words that are among `runs`, each once a row. It goes to the workers whole.

    A word is its number among the runs' words, and so are the first two, three and more words of a run among all such beginnings. So no run is ever
    made as a text, and only what begins as one of `runs` does is looked at further.
    """
    split = [r.split(" ") for r in runs]
    names = list(dict.fromkeys(w for r in split for w in r))
    number = {w: i for i, w in enumerate(names)}
    columns = np.array([[number[w] for w in r] for r in split], dtype=np.int64).reshape(len(runs), n)
    code, begun = columns[:, 0], []
    for k in range(1, n):
        table, code = np.unique(code * len(names) + columns[:, k], return_inverse=True)
        begun.append(table)
    values, ordered = pa.array(names, pa.large_string()), pa.array(runs, pa.large_string()).take(pa.array(np.argsort(code)))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column(1).cast(pa.large_string()).fill_null(""), " ")
            word = pc.index_in(words.flatten(), values).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            at = np.flatnonzero(word[: max(0, len(word) - n + 1)] >= 0)
            at = at[row[at] == row[at + n - 1]]
            now = word[at]
            for k, table in enumerate(begun, 1):
                key = np.where(word[at + k] >= 0, now * len(names) + word[at + k], -1)
                place = np.minimum(np.searchsorted(table, key), len(table) - 1)
                at, now = at[there := table[place] == key], place[there]
            row, now = np.divmod(np.unique(row[at] * len(runs) + now), max(1, len(runs)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), ordered.take(pa.array(now)).cast(pa.string())], ["doc_id", "e"])

    return held


def contained_runs(docs: DataFrame, items: DataFrame, least: float, n: int = 3, block: int = BLOCK) -> DataFrame:
    """`contained` of runs of n words: items (item_id, t) have theirs, distinct, with single spaces between, and documents (doc_id, text) their words, likewise.

    A block's runs go to the workers, who give a document's runs that are among them.
    """
    schema = StructType([docs.schema["doc_id"], StructField("e", StringType())])

    def own(part: DataFrame) -> DataFrame:
        runs = part.select("e").distinct().toArrow().column("e").to_pylist()
        return bounded_batches(docs).select("doc_id", "text").mapInArrow(_held(sorted(runs), n), schema)

    return _shares(items, least, block, own)


def preserved(atoms: DataFrame) -> DataFrame:
    """(key, preserved, invented) of atoms (key, late, atom): the share of the early ones that the late ones keep, and of the late ones that are new."""
    own = atoms.groupBy("key", "atom").agg(F.bool_or(~F.col("late")).alias("want"), F.bool_or("late").alias("got"))
    counts = own.groupBy("key").agg(
        F.count_if(F.col("want") & F.col("got")).alias("kept"), F.count_if("want").alias("wanted"), F.count_if(F.col("got") & ~F.col("want")).alias("new"), F.count_if("got").alias("given"),
    )
    return counts.select("key", F.round(ratio(F.col("kept"), F.col("wanted"), 1.0), 6).alias("preserved"), F.round(ratio(F.col("new"), F.col("given")), 6).alias("invented"))


def _overlaps() -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A function of one cell, (q, overlap, page): each question's best page of the cell, the lowest on ties. It goes to the workers whole."""

    def cell(asked: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(pages):
            return pd.DataFrame({"q": [], "overlap": [], "page": []})
        terms, pages = pages["t"].to_numpy(), pages["page"].to_numpy()
        names, places = np.unique(pages, return_inverse=True)
        order = np.argsort(terms, kind="stable")
        terms, places = terms[order], places[order]
        asked = asked.sort_values("q", kind="stable")
        q, t = asked["q"].to_numpy(), asked["t"].to_numpy()
        low, high = np.searchsorted(terms, t, "left"), np.searchsorted(terms, t, "right")
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        out = []
        for a, b in zip(starts, np.r_[starts[1:], len(q)], strict=True):
            counts = np.bincount(np.concatenate([places[low[i] : high[i]] for i in range(a, b)]), minlength=len(names))
            top = counts.argmax()  # the first of equals, and names are in order
            if counts[top]:
                out.append((q[a], counts[top], names[top]))
        return pd.DataFrame(out, columns=["q", "overlap", "page"])

    return cell


def best_overlap(asked: DataFrame, pages: DataFrame, block: int = BLOCK, at_once: int = PAGES, of: int | None = None) -> DataFrame:
    """(question, page, overlap): of each question (question, term) the page (page, term) with the most of its terms, the lowest page on ties.

    The questions' terms go out in blocks; a page keeps those of its terms that a block asks for, as numbers. Pages are dealt into cells of a bounded
    size, each with the block's questions, and a cell counts in arrays: no pair of a page and a question is ever a row. `of` is the number of pages,
    if it is known; it is counted otherwise.
    """
    asked = written(asked.where("term IS NOT NULL").distinct(), "asked")
    terms = written(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    ids = written(asked.select("question").distinct().withColumn("q", F.monotonically_increasing_id()), "questions")
    asked = written(asked.join(terms, "term").join(ids, "question").select("q", "t"), "asked")
    many = max(1, -(-asked.count() // block))
    # each page is a hash's, so few cells are much fuller than others
    of = pages.agg(F.approx_count_distinct("page")).first()[0] if of is None else of
    cells = max(1, -(-of // at_once))
    own = pages.where("page IS NOT NULL").withColumn("cell", F.pmod(F.xxhash64("page"), F.lit(cells)).cast("int"))
    kind = pages.schema["page"].dataType.simpleString()
    best = []
    for b in range(many):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(many)) == b)
        wanted = terms.join(part, "t", "left_semi") if many > 1 else terms
        held = own.join(F.broadcast(wanted), "term").select("cell", "page", "t")
        every = part.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        found = every.groupBy("cell").cogroup(held.groupBy("cell")).applyInPandas(_overlaps(), f"q long, overlap long, page {kind}")
        best.append(found.groupBy("q").agg(F.max(F.struct("overlap", (-F.col("page")).alias("b"))).alias("m")))
    return reduce(DataFrame.unionAll, best).join(ids, "q").select("question", (-F.col("m.b")).alias("page"), "m.overlap")


def _cells() -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A function of one cell, (id, label, best) of its queries and rows. It goes to the workers whole, so it uses nothing of this module."""

    def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
            return np.where(norm == 0, 0.0, q @ v.T / np.where(norm == 0, 1.0, norm))

    def cell(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": [], "label": [], "best": []})]
        if not len(queries) or not len(rows):
            return out[0]
        codes, labels = pd.factorize(rows["label"], use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")
        starts = np.searchsorted(codes[order], np.arange(len(labels)))
        ids, vectors = rows["id"].to_numpy()[order], rows["v"].to_numpy()[order]
        wide, asked_wide = (np.array([len(x) for x in vs]) for vs in (vectors, queries["v"]))
        for size in np.unique(asked_wide):
            asked = queries[asked_wide == size]
            same = np.flatnonzero(wide == size)
            v = np.array([vectors[i] for i in same], dtype=np.float64).reshape(len(same), size)
            for at in range(0, len(asked), 256):
                part = asked.iloc[at : at + 256]
                own = part["id"].to_numpy()
                best = np.zeros((len(part), len(ids)))  # vectors of another length have a cosine of 0
                best[:, same] = np.maximum(cosines(np.array(part["v"].tolist(), dtype=np.float64).reshape(len(part), size), v), 0.0)
                best[own[:, None] == ids[None, :]] = -1.0  # a vector isn't held against itself
                top = np.maximum.reduceat(best, starts, axis=1)
                q, k = np.nonzero(top != -1.0)
                out.append(pd.DataFrame({"id": own[q], "label": np.asarray(labels)[k], "best": top[q, k]}))
        return pd.concat(out[1:])

    return cell


def best_cosine(queries: DataFrame, rows: DataFrame, vectors: int = VECTORS, at_once: int = QUERIES) -> DataFrame:
    """(id, label, best) of queries (id, v) and rows (id, label, v): each query's best cosine with the rows of each label but those of its own id, not below 0.

    Rows and queries are dealt into parts of a bounded size, each pair of parts is one cell, and a cell is one product of matrices. A vector that is
    null or holds a null has a cosine of 0.
    """
    whole = F.when(F.forall("v", lambda x: x.isNotNull()), F.col("v").cast("array<double>")).otherwise(F.array().cast("array<double>")).alias("v")
    own, asked = rows.where("id IS NOT NULL").select("id", "label", whole), queries.where("id IS NOT NULL").select("id", whole)
    n, m = max(1, -(-own.count() // vectors)), max(1, -(-asked.count() // at_once))
    part = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own, asked = own.withColumn("r", part(n)).withColumn("q", every(m)), asked.withColumn("q", part(m)).withColumn("r", every(n))

    kinds = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, best double"
    found = asked.groupBy("r", "q").cogroup(own.groupBy("r", "q")).applyInPandas(_cells(), kinds)
    return found.groupBy("id", "label").agg(F.max("best").alias("best"))
