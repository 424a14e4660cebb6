"""Inverted index, term graph, ranked search and budget packing over a table (block_id, scope, text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import INDEX_STOP, literals, token_estimate, tokens, words
from quarryline.sources.shared import written

#: The postings of the query's own terms count this much, those of added neighbours 1.
OWN_WEIGHT = 3
GRAPH_TERMS, TERMS_PER_PAGE, NEIGHBOURS = 512, 64, 8
#: Blocks that are sent to all tasks; more are joined by a shuffle. Terms that are looked for before all others.
FEW_BLOCKS, FIRST_TERMS = 500_000, 512


def postings(blocks: DataFrame) -> DataFrame:
    """(term, block_id), each once."""
    return blocks.select("block_id", F.explode(tokens(F.col("text"))).alias("term"))


def matched(blocks: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of some terms alone, looked for inside each row: no other term of a text is taken out of it."""
    return blocks.select("block_id", F.explode(F.array_intersect(words(F.col("text")), literals([t for t in terms if t not in INDEX_STOP and len(t) >= 3]))).alias("term"))


def document_frequency(posting: DataFrame) -> DataFrame:
    return posting.groupBy("term").agg(F.count("*").alias("df"))


def top_terms(posting: DataFrame, k: int = GRAPH_TERMS) -> DataFrame:
    """The k terms on most blocks, ties by term; k rows at most, whatever the corpus."""
    return document_frequency(posting).orderBy(F.desc("df"), "term").limit(k)


def listed(blocks: DataFrame) -> DataFrame:
    """(block_id, terms): each block's postings in one row."""
    return blocks.select("block_id", tokens(F.col("text")).alias("terms"))


def unlisted(lists: DataFrame) -> DataFrame:
    """(term, block_id) of (block_id, terms)."""
    return lists.select(F.explode("terms").alias("term"), "block_id")


def term_graph(posting: DataFrame, terms: int | None = GRAPH_TERMS, per_page: int | None = TERMS_PER_PAGE, neighbours: int | None = NEIGHBOURS, of: list[str] | None = None) -> DataFrame:
    """(src, dst, weight, rank): how many blocks two frequent terms share, the strongest neighbours of each term.

    The caps come before the pairing, so a block gives per_page ** 2 pairs at most. With `of` there are none (the three are None): all links of these few
    terms, to whatever terms; posting is (block_id, terms) then, and a block gives a pair for each of its terms and of these.
    """
    if of is not None:
        own = posting.where("block_id IS NOT NULL").select(F.explode(F.array_intersect("terms", literals(of))).alias("src"), "terms").select("src", F.explode("terms").alias("dst")).where("src <> dst")
        order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
        return own.groupBy("src", "dst").agg(F.count("*").alias("weight")).withColumn("rank", F.row_number().over(order))
    allowed = posting.join(F.broadcast(top_terms(posting, terms).select("term")), "term")
    first = Window.partitionBy("block_id").orderBy("term")
    page = allowed.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_page)
    listed = page.groupBy("block_id").agg(F.collect_list("term").alias("terms"))
    pairs = listed.select(F.explode("terms").alias("src"), "terms").select("src", F.explode("terms").alias("dst")).where("src < dst")
    # a pair is counted once and holds both ways
    weights = pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    weights = weights.select("weight", F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).select("src", "dst", "weight")
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)


def spread(lists: DataFrame, links: DataFrame, starts: list[str], depth: int) -> DataFrame:
    """(start, term, depth, df): the terms within `depth` links of each of a query's terms, each at its least distance, where all terms that share a block are linked.

    links (src, dst) are those of the starts. Beyond them blocks are reached by their terms and terms by their blocks (lists has block_id and terms), so no pair of terms
    is made and none is left out. The starts of a term or block are bits of a number, 63 at a time.
    """
    starts = sorted(set(starts))
    df = written(document_frequency(unlisted(lists)), "near")
    parts = [_spread(lists, df, links, starts[i : i + 63], depth) for i in range(0, len(starts), 63)]
    return reduce(DataFrame.unionAll, parts)


def _spread(lists: DataFrame, df: DataFrame, links: DataFrame, starts: list[str], depth: int) -> DataFrame:
    posting = unlisted(lists)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(literals(starts), F.col("src")) - 1).cast("int"))
    sized = lambda b: b.hint("broadcast" if b.count() <= FEW_BLOCKS else "merge")
    seen = links.where(F.col("src").isin(starts)).groupBy(F.col("dst").alias("term")).agg(F.bit_or(bit).alias("starts"))
    seen = edge = written(seen.select("term", "starts", F.lit(1).cast("long").alias("depth")), "near")
    for d in range(2, depth + 1):
        every = edge.agg(F.bit_or("starts")).first()[0]
        if every is None:
            break
        # the terms of many starts and blocks come first: a block that has all starts by them needs no other term, so few postings are dealt out by term
        first = edge.join(df.hint("merge"), "term").orderBy(F.desc(F.bit_count("starts")), F.desc("df"), "term").limit(FIRST_TERMS).select("term", "starts")
        some = written(posting.join(F.broadcast(first), "term").groupBy("block_id").agg(F.bit_or("starts").alias("starts")), "near")
        rest = lists.join(sized(some.where(F.col("starts") == every)), "block_id", "left_anti")
        more = unlisted(rest).join(edge.select("term", "starts").hint("shuffle_hash"), "term").select("block_id", "starts")
        blocks = written(some.unionAll(more.groupBy("block_id").agg(F.bit_or("starts").alias("starts"))).groupBy("block_id").agg(F.bit_or("starts").alias("starts")), "near")
        came = lists.join(sized(blocks), "block_id").select(F.explode("terms").alias("term"), "starts").groupBy("term").agg(F.bit_or("starts").alias("starts"))
        old = seen.groupBy("term").agg(F.bit_or("starts").alias("old"))
        new = came.join(old.hint("merge"), "term", "left").select("term", F.col("starts").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("starts"))
        edge = written(new.where("starts <> 0").withColumn("depth", F.lit(d).cast("long")), "near")
        seen = seen.unionAll(edge)
    each = F.explode(F.filter(literals(starts), lambda s: F.call_function("getbit", F.col("starts"), (F.array_position(literals(starts), s) - 1).cast("int")) == 1))
    return seen.join(df.hint("merge"), "term").select(each.alias("start"), "term", "depth", "df").where("start <> term")


def query_terms(terms: list[str]) -> list[str]:
    return sorted(set(terms))


def expanded(posting: DataFrame, terms: list[str], depth: int = 2) -> DataFrame:
    """(term, weight): the query's terms, and of each term its depth strongest neighbours; own terms keep their weight."""
    graph = term_graph(posting).where(F.col("src").isin(terms) & (F.col("rank") <= depth))
    own = posting.sparkSession.createDataFrame([(t, OWN_WEIGHT) for t in terms], "term string, weight int")
    near = graph.select(F.col("dst").alias("term"), F.lit(1).alias("weight"))
    return own.unionByName(near).groupBy("term").agg(F.max("weight").alias("weight"))


def ranked(posting: DataFrame, weighted: DataFrame, limit: int) -> DataFrame:
    """(block_id, score, matched) of the best blocks, ties by block_id. weighted has a row for each term of the query."""
    hits = posting.join(F.broadcast(weighted), "term").groupBy("block_id").agg(F.sum("weight").cast("long").alias("score"), F.count("*").alias("matched"))
    return hits.orderBy(F.desc("score"), "block_id").limit(limit)


def packed(hits: DataFrame, budget: int, most: int, order: list[Column]) -> DataFrame:
    """Of few ranked hits (block_id, cid, cost) those that a greedy reader takes: in order, each that fits what is left of
    the budget and whose content wasn't taken before, until there are `most`."""
    struct = F.struct("place", "block_id", "cid", "cost")
    listed = hits.withColumn("place", F.row_number().over(Window.orderBy(*order))).agg(F.array_sort(F.collect_list(struct)).alias("rows"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<string>").alias("cids"))

    def step(state: Column, row: Column) -> Column:
        fits = (row["cost"] <= state["left"]) & (F.size(state["ids"]) < most) & ~F.array_contains(state["cids"], row["cid"])
        return F.struct(
            F.when(fits, state["left"] - row["cost"]).otherwise(state["left"]).alias("left"),
            F.when(fits, F.array_append(state["ids"], row["block_id"])).otherwise(state["ids"]).alias("ids"),
            F.when(fits, F.array_append(state["cids"], row["cid"])).otherwise(state["cids"]).alias("cids"),
        )

    folded = listed.select(F.aggregate("rows", start, step).alias("s"))
    return folded.select(F.posexplode("s.ids").alias("n", "block_id"), F.col("s.left").alias("left_over")).select((F.col("n") + 1).cast("long").alias("rank"), "block_id", "left_over")


def with_cost(blocks: DataFrame) -> DataFrame:
    return blocks.select("block_id", F.sha2("text", 256).alias("cid"), token_estimate(F.col("text")).alias("cost"))


def cover_terms(posting: DataFrame, pages: int, most: int) -> DataFrame:
    """The corpus' most frequent terms dealt round to pages: (page, term, df)."""
    top = top_terms(posting, most)
    place = F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1
    return top.select((F.pmod(place, F.lit(pages)) + 1).cast("long").alias("page"), "term", "df")


def segments(pages: DataFrame, lines: int = 12, least: int = 2) -> DataFrame:
    """(page_id, block, first_line, n_lines, text): a block ends at a blank line once it has `least` lines, or at `lines` lines.

    The blocks of a page, joined, are the page.
    """
    # keep each line's own line feed, so that joining gives the page back
    split = F.split(F.col("text"), r"(?<=\n)")
    start = F.struct(F.array().cast("array<int>").alias("sizes"), F.lit(0).alias("held"))

    def step(state: Column, line: Column) -> Column:
        held = state["held"] + 1
        ends = (held >= lines) | ((F.trim(F.regexp_replace(line, r"\s+", "")) == "") & (held >= least))
        return F.struct(F.when(ends, F.array_append(state["sizes"], held)).otherwise(state["sizes"]).alias("sizes"), F.when(ends, 0).otherwise(held).alias("held"))

    folded = pages.select("page_id", split.alias("all"), F.aggregate(split, start, step).alias("s"))
    sizes = F.when(F.col("s.held") > 0, F.array_append("s.sizes", F.col("s.held"))).otherwise(F.col("s.sizes"))
    each = folded.select("page_id", "all", sizes.alias("sizes")).select("page_id", "all", "sizes", F.posexplode("sizes").alias("block", "n_lines"))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("block")), F.lit(0), lambda a, b: a + b)
    each = each.withColumn("first_line", before)
    return each.select("page_id", F.col("block").cast("long").alias("block"), F.col("first_line").cast("long").alias("first_line"), F.col("n_lines").cast("long").alias("n_lines"), F.array_join(F.slice("all", F.col("first_line") + 1, F.col("n_lines")), "").alias("text"))


def one_of(terms: list[str]) -> Column:
    return literals(terms)
