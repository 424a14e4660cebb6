"""Queries of the retrieval family, over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import comparison as C
from quarryline.operators import retrieval as R
from quarryline.plans.catalog import query
from quarryline.plans.inputs import read
from quarryline.sources.shared import written

TERMS = ["aile", "heer", "onation", "ther", "thereon"]
_STOP = ", ".join(f"'{w}'" for w in X.INDEX_STOP)
_WANT = ", ".join(f"('{t}')" for t in TERMS)

POSTINGS = rf"""postings AS (
  SELECT doc_id AS block_id, t.term FROM documents, LATERAL (
    SELECT DISTINCT w AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+')) AS w) WHERE length(w) >= 3 AND w NOT IN ({_STOP})) t)"""
GRAPH = POSTINGS + r""",
top AS (SELECT term, count(*) AS df FROM postings GROUP BY term ORDER BY df DESC, term LIMIT 512),
page AS (SELECT block_id, term FROM (SELECT block_id, term, row_number() OVER (PARTITION BY block_id ORDER BY term) AS n FROM postings WHERE term IN (SELECT term FROM top)) WHERE n <= 64),
w AS (SELECT a.term AS src, b.term AS dst, count(*) AS weight FROM page a JOIN page b ON a.block_id = b.block_id AND a.term <> b.term GROUP BY 1, 2),
graph AS (SELECT src, dst, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM w) WHERE rank <= 8)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), "text", "source", "lang")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.postings(blocks(spark, sf_dir))


def _own(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, 3) for t in TERMS], "term string, weight int")


@query(f"WITH {POSTINGS}, q(term) AS (VALUES {_WANT}) SELECT block_id, 3 * count(*) AS score, count(*) AS matched FROM postings JOIN q USING (term) GROUP BY block_id ORDER BY score DESC, block_id LIMIT 20")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-01, SF-02, AG-27, JN-07, TK-01, TK-02: ranked search by the postings of the query's terms."""
    return R.ranked(R.matched(blocks(spark, sf_dir), TERMS), _own(spark), 20)


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df FROM postings GROUP BY term ORDER BY df DESC, term LIMIT 512")
def inverted_index_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-27, AG-28, TK-03: the terms on most documents."""
    return R.top_terms(postings(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT src, dst, weight, CAST(rank AS INTEGER) AS rank FROM graph")
def term_cooccurrence_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-09, WN-01, WN-02: the term graph."""
    return R.term_graph(written(postings(spark, sf_dir), "postings"))


@query(
    f"WITH {GRAPH}, q(term) AS (VALUES {_WANT}), e AS (SELECT term, max(weight) AS weight FROM (SELECT term, 3 AS weight FROM q UNION ALL SELECT dst, 1 FROM graph WHERE src IN (SELECT term FROM q) AND rank <= 2) GROUP BY term) "
    "SELECT block_id, CAST(sum(weight) AS BIGINT) AS score, count(*) AS matched FROM postings JOIN e USING (term) GROUP BY block_id ORDER BY score DESC, block_id LIMIT 32"
)
def graph_expand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-08, ST-01, TK-01: search with the graph's neighbours added to the query."""
    own = written(postings(spark, sf_dir), "postings")  # read for the frequencies, the graph and the ranking
    return R.ranked(own, R.expanded(own, TERMS), 32)


_HITS = f"WITH RECURSIVE {POSTINGS}, q(term) AS (VALUES {_WANT}), h AS MATERIALIZED (SELECT block_id, count(*) AS score FROM postings JOIN q USING (term) GROUP BY block_id ORDER BY score DESC, block_id LIMIT 80), "


@query(
    _HITS + "r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY score DESC, block_id) AS n, block_id, sha256(text) AS cid, CAST((strlen(text) + 3) // 4 AS BIGINT) AS cost FROM h JOIN documents ON doc_id = block_id), "
    "f AS (SELECT 0 AS n, CAST(6000 AS BIGINT) AS left_, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS cids UNION ALL "
    "SELECT r.n, CASE WHEN ok THEN left_ - cost ELSE left_ END, CASE WHEN ok THEN list_append(ids, r.block_id) ELSE ids END, CASE WHEN ok THEN list_append(cids, r.cid) ELSE cids END "
    "FROM (SELECT r.*, f.left_, f.ids, f.cids, r.cost <= f.left_ AND len(f.ids) < 20 AND NOT list_contains(f.cids, r.cid) AS ok FROM f JOIN r ON r.n = f.n + 1) r), "
    "z AS (SELECT ids, left_ FROM f ORDER BY n DESC LIMIT 1) SELECT CAST(generate_subscripts(ids, 1) AS BIGINT) AS rank, unnest(ids) AS block_id, left_ AS left_over FROM z"
)
def retrieval_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-10, SF-38, SP-01: ranked search, then blocks packed greedily under a token budget."""
    own = blocks(spark, sf_dir)
    hits = R.ranked(R.matched(own, TERMS), _own(spark), 80)
    # the costs and content ids of the few hits only
    costed = R.with_cost(own.join(F.broadcast(hits.select("block_id")), "block_id", "left_semi"))
    return R.packed(costed.join(F.broadcast(hits), "block_id"), 6000, 20, [F.desc("score"), F.col("block_id")])


@query(
    f"WITH {POSTINGS}, q(term) AS (VALUES {_WANT}), h AS (SELECT DISTINCT term, source FROM postings JOIN q USING (term) JOIN documents ON doc_id = block_id) "
    "SELECT source, count(*) AS covered, round(count(*) / 5.0, 6) AS coverage, round(1 - count(*) / 5.0, 6) AS uncertainty, CASE WHEN 1 - count(*) / 5.0 > 0.6 THEN 3 WHEN 1 - count(*) / 5.0 > 0.25 THEN 2 ELSE 1 END AS depth FROM h GROUP BY source"
)
def route_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routing step of a query: which share of its terms each scope covers, and the depth that follows."""
    own = blocks(spark, sf_dir)
    hit = own.select("source", F.explode(F.array_intersect(X.words(F.col("text")), X.literals(TERMS))).alias("term")).distinct()
    u = 1 - F.col("covered") / float(len(TERMS))
    out = hit.groupBy("source").agg(F.count("*").alias("covered"))
    return out.select("source", "covered", F.round(F.col("covered") / float(len(TERMS)), 6).alias("coverage"), F.round(u, 6).alias("uncertainty"), F.when(u > 0.6, 3).when(u > 0.25, 2).otherwise(1).alias("depth"))


@query(f"WITH {POSTINGS}, top AS (SELECT term, count(*) AS df FROM postings GROUP BY term ORDER BY df DESC, term LIMIT 60) SELECT CAST((row_number() OVER (ORDER BY df DESC, term) - 1) % 5 + 1 AS BIGINT) AS page, term, df FROM top")
def cover_text_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-18: frequent terms dealt round to pages, ties by term."""
    return R.cover_terms(postings(spark, sf_dir), 5, 60)


_SEGMENTS = r"""
WITH RECURSIVE p AS (SELECT doc_id AS page_id, string_split(text, chr(10)) AS ls FROM documents),
l AS MATERIALIZED (SELECT page_id, generate_subscripts(ls, 1) AS i, len(ls) AS n, unnest(ls) AS x FROM p),
t AS MATERIALIZED (SELECT page_id, i, CASE WHEN i < n THEN x || chr(10) ELSE x END AS x FROM l),
f(page_id, i, held, block) AS (
  SELECT DISTINCT page_id, 0::BIGINT, 0, 0 FROM t
  UNION ALL
  SELECT page_id, i, CASE WHEN ends THEN 0 ELSE held END, CASE WHEN ends THEN block + 1 ELSE block END
  FROM (SELECT f.page_id, t.i, f.held + 1 AS held, f.block, f.held + 1 >= 12 OR (regexp_replace(x, '\s+', '', 'g') = '' AND f.held + 1 >= 2) AS ends FROM f JOIN t ON t.page_id = f.page_id AND t.i = f.i + 1)),
b AS (SELECT t.page_id, f.block, min(t.i) - 1 AS first_line, count(*) AS n_lines, string_agg(x, '' ORDER BY t.i) AS text FROM t JOIN f ON f.page_id = t.page_id AND f.i = t.i - 1 GROUP BY ALL),
k AS (SELECT *, trim(text, ' ') AS body, string_split(trim(text, ' '), chr(10)) AS ls, trim(string_split(trim(text, ' '), chr(10))[1], ' ') AS first FROM b),
m AS (SELECT *, len(regexp_extract_all(first, '\p{L}')) AS letters, len(regexp_extract_all(first, '\p{Lu}')) AS upper_, len(regexp_extract_all(body, '[=+*/^<>≤≥∑∫√]')) AS maths,
  len(regexp_extract_all(body, '[{}\[\]();_]')) + len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]{4}'))) AS code, len(list_filter(ls, lambda x: contains(x, '    '))) AS wide FROM k)
SELECT page_id, CAST(block AS BIGINT) AS block, first_line, n_lines, CASE WHEN body = '' THEN 'whitespace'
  WHEN strlen(first) <= 90 AND (length(first) >= 2 AND letters > 0 AND upper_ * 100 >= letters * 70 OR regexp_matches(first, '^(Chapter|CHAPTER) ')) THEN 'heading'
  WHEN maths > 12 AND maths * 20 > length(body) THEN 'equation' WHEN code > len(ls) * 2 THEN 'code' WHEN wide >= 2 THEN 'table' ELSE 'text' END AS kind,
  sha256(text) AS cid, strlen(text) AS n_bytes FROM m
"""


@query(_SEGMENTS)
def block_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-11, SF-21: pages cut into blocks, each with its kind and content id."""
    pages = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    cut = R.segments(pages)
    return cut.select("page_id", "block", "first_line", "n_lines", X.block_kind(F.col("text")).alias("kind"), F.sha2("text", 256).alias("cid"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(
    f"WITH {POSTINGS}, qs AS (SELECT conv_id, turn, list_distinct(list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda w: trim(w, '.,;:!?¿()[]{{}}\"''')), lambda w: strlen(w) > 3 AND w NOT IN ({', '.join(repr(w) for w in X.SCOUT_STOP)}))) AS ws FROM conversations WHERE conv_id % 20 = 0), "
    "w AS (SELECT conv_id, turn, unnest(ws) AS term FROM qs), s AS (SELECT conv_id, turn, block_id, count(*) AS overlap FROM w JOIN postings USING (term) GROUP BY ALL) "
    "SELECT conv_id, turn, block_id AS page, overlap FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY overlap DESC, block_id) AS n FROM s) WHERE n = 1"
)
def page_scout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-21, SF-26: the page that shares most terms with a question, the lowest page on ties, none without overlap.

    Questions are all turns of the dialogues whose id 20 divides, held in blocks against all terms of all pages.
    """
    asked = read(spark, sf_dir, "conversations").where("conv_id % 20 = 0")
    asked = asked.select(F.struct("conv_id", "turn").alias("question"), F.explode(X.keywords(F.col("text"), 3, X.SCOUT_STOP, ".,;:!?¿()[]{}\"'")).alias("term"))
    best = C.best_overlap(asked, postings(spark, sf_dir).withColumnRenamed("block_id", "page"), of=blocks(spark, sf_dir).count())
    return best.select("question.conv_id", "question.turn", "page", "overlap")


@query(
    f"WITH {POSTINGS.replace('postings AS (', 'postings AS MATERIALIZED (', 1)}, q(term) AS (VALUES {_WANT}), b0 AS (SELECT term AS start, block_id FROM postings JOIN q USING (term)), t1 AS MATERIALIZED (SELECT DISTINCT start, term FROM b0 JOIN postings USING (block_id)), "
    "b1 AS MATERIALIZED (SELECT DISTINCT start, block_id FROM t1 JOIN postings USING (term)), t2 AS (SELECT DISTINCT start, term FROM b1 JOIN postings USING (block_id)), df AS (SELECT term, count(*) AS df FROM postings GROUP BY term), p AS (SELECT *, 1 AS depth FROM t1 UNION ALL SELECT *, 2 FROM t2) "
    "SELECT start, term, CAST(min(depth) AS BIGINT) AS depth, any_value(df) AS df FROM p JOIN df USING (term) WHERE term <> start GROUP BY start, term"
)
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-10, SP-50: the terms within two links of each query term, each at its least distance (breadth first, where the source walks depth first), with their document frequencies.

    The graph is that of all terms and whole documents: two terms are linked where a document has both; no cap on terms, on a document's terms or on a term's neighbours.
    """
    lists = written(R.listed(blocks(spark, sf_dir)), "postings")
    return R.spread(lists, R.term_graph(lists, None, None, None, TERMS), TERMS, 2)
