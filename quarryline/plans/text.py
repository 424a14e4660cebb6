"""Queries of the text functions and the grounding family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions import numeric as N
from quarryline.functions import text as X
from quarryline.operators import comparison as C
from quarryline.operators import grounding as G
from quarryline.plans.catalog import query
from quarryline.plans.inputs import read

_KEY_STOP = ", ".join(f"'{w}'" for w in X.KEYWORD_STOP)
_KEYS = f"list_distinct(list_filter(list_transform(list_filter(string_split_regex(lower(%s), '\\s+'), lambda w: w <> ''), lambda w: trim(w, '.,;:!?()[]{{}}\"''')), lambda w: strlen(w) > 4 AND w NOT IN ({_KEY_STOP})))"


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages".replace('\\"', '"'))
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-23, SRC-08: pages without their tags."""
    return read(spark, sf_dir, "pages").select("page_id", X.without_tags(F.col("html")).alias("text"))


@query(
    "WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN 'What is the difference in 2021 of NASA? ' WHEN turn % 3 = 1 THEN '¿Cómo se hace 3.5 y 42? ' ELSE 'define ' END || text AS q FROM conversations), "
    + r"""e AS (SELECT *, ltrim(lower(q), '¿¡"'' ') AS l, regexp_extract_all(q, '\b[12][0-9]{3}\b') AS y, list_filter(regexp_extract_all(q, '\b[0-9]+(?:\.[0-9]+)?\b'), lambda x: NOT regexp_full_match(x, '[12][0-9]{3}')) AS k FROM c) """
    + r"SELECT conv_id, turn, CASE WHEN regexp_matches(l, 'compare|comparison|relationship|relaci[óo]n| vs |( vs\.)|difference|diferencia') THEN 'comparison' WHEN regexp_matches(l, '^(what is|what are|qué es|que es|define)') THEN 'definition' WHEN regexp_matches(l, '^(how |cómo|como |why |por qué|por que)| (how|cómo|como|why|por qué|por que) ') THEN 'process' WHEN len(y) > 0 OR len(k) > 0 THEN 'factual_detail' ELSE 'general' END AS class, array_to_string(y, ',') AS years, array_to_string(k, ',') AS numbers, array_to_string(list_filter(string_split_regex(q, '[^\p{L}\p{Nd}_]+'), lambda w: regexp_full_match(w, '[A-Z]{2,}')), ',') AS acronyms FROM e"
)
def question_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-24, SF-25: a question's class, years, other numbers and acronyms."""
    t = F.col("turn") % 3
    lead = F.when(t == 0, "What is the difference in 2021 of NASA? ").when(t == 1, "¿Cómo se hace 3.5 y 42? ").otherwise("define ")
    q = F.concat(lead, F.col("text"))
    join = lambda a: F.array_join(a, ",")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.question_class(q).alias("class"), join(X.years(q)).alias("years"), join(X.numbers(q)).alias("numbers"), join(X.acronyms(q)).alias("acronyms"))


_SCORE = (
    "WITH p AS (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS content FROM conversations), "
    f"k AS (SELECT *, {_KEYS % 'content'} AS keys_, len(list_filter(string_split_regex(answer, '\\s+'), lambda w: w <> '')) AS na, len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) AS nc FROM p WHERE content IS NOT NULL), "
    "m AS (SELECT *, len(keys_) AS total, len(list_filter(keys_, lambda w: contains(lower(answer), w))) AS matched FROM k) "
    "SELECT conv_id, turn, CAST(total AS BIGINT) AS total, CAST(matched AS BIGINT) AS matched, round(CASE WHEN total = 0 THEN 0.5 ELSE (matched / total * 0.4 + CASE WHEN na = 0 THEN 0.0 WHEN na < nc // 10 THEN 0.6 WHEN na > nc * 2 THEN 0.7 ELSE 1.0 END * 0.3 + CASE WHEN matched = 0 THEN 0.3 ELSE 0.8 END * 0.3) * 0.8 + 0.1 END, 6) AS score FROM m"
)


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, content, answer): each turn with the one before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", before.alias("content"), F.col("text").alias("answer")).where("content IS NOT NULL")


@query(_SCORE)
def keyword_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-18: each turn's score as an answer to the one before: by that one's keywords, its length and a flexibility of 0.8."""
    p = answered(spark, sf_dir)
    n = lambda col: F.size(F.filter(F.split(col, r"\s+"), lambda w: w != ""))
    p = p.withColumns({"keys": X.keywords(F.col("content")), "na": n("answer"), "nc": n("content")})
    p = p.withColumns({"total": F.size("keys"), "matched": F.size(F.filter("keys", lambda w: F.contains(F.lower("answer"), w)))})
    length = F.when(F.col("na") == 0, 0.0).when(F.col("na") < F.floor(F.col("nc") / 10), 0.6).when(F.col("na") > F.col("nc") * 2, 0.7).otherwise(1.0)
    raw = F.col("matched") / F.col("total") * 0.4 + length * 0.3 + F.when(F.col("matched") == 0, 0.3).otherwise(0.8) * 0.3
    return p.select("conv_id", "turn", F.col("total").cast("long").alias("total"), F.col("matched").cast("long").alias("matched"), F.round(F.when(F.col("total") == 0, 0.5).otherwise(raw * 0.8 + 0.1), 6).alias("score"))


@query("WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'No estoy muy SEGURO ' WHEN 1 THEN 'Definitivamente ' WHEN 2 THEN 'parece que ' ELSE '' END || text AS t FROM conversations) SELECT conv_id, turn, CASE WHEN contains(lower(t), 'no sé') OR (contains(lower(t), 'no estoy') AND contains(lower(t), 'seguro')) THEN 0.4 WHEN regexp_matches(lower(t), 'seguro|definitivamente') THEN 0.9 WHEN regexp_matches(lower(t), 'probablemente|parece') THEN 0.6 ELSE 0.7 END::DOUBLE AS confidence FROM c")
def hedged_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-19: confidence by hedging phrases."""
    t = F.col("turn") % 4
    lead = F.when(t == 0, "No estoy muy SEGURO ").when(t == 1, "Definitivamente ").when(t == 2, "parece que ").otherwise("")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.hedged_confidence(F.concat(lead, F.col("text"))).alias("confidence"))


@query(r"SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda p: trim(p, ' ')), lambda p: strlen(p) >= 15), '|') AS passages FROM conversations")
def answer_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-20: sentences of 15 bytes or more."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.passages(F.col("text")), "|").alias("passages"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', '-', 'g'), '-') AS slug, trim(regexp_replace(regexp_replace(source, '[0-9]', '#', 'g'), '\s+', ' ', 'g')) AS shape FROM documents")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-28, SF-29: slugs of the texts and shapes of the source names."""
    return read(spark, sf_dir, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"), X.repetition_shape(F.col("source")).alias("shape"))


@query(r"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '[0-9]', '#', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents) SELECT doc_id, len(ls) >= 3 AND len(list_distinct(ls[-3:])) = 1 AS degenerate FROM l")
def repetition_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-22, UD-07: texts whose last lines repeat one shape; three lines here, as these texts have few."""
    return read(spark, sf_dir, "documents").select("doc_id", X.degenerate(F.col("text"), 3).alias("degenerate"))


@query(
    r"WITH p AS (SELECT c.conv_id, c.turn, c.text AS answer, d.text AS evidence FROM conversations c JOIN documents d ON d.doc_id = c.conv_id), n AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(answer || ' 42 and 7.', '[0-9]+(?:\.[0-9]+)?'), lambda x: length(x) >= 2 AND NOT contains(evidence, x))) AS missing FROM p) SELECT conv_id, turn, array_to_string(list_sort(missing), ',') AS missing FROM n"
)
def unsupported_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-24, FLT-25: numbers of an answer that its evidence doesn't have."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("answer"))
    p = c.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("evidence")), "conv_id")
    found = F.regexp_extract_all(F.concat("answer", F.lit(" 42 and 7.")), F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0)
    return p.select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 2) & ~F.contains("evidence", x)))), ",").alias("missing"))


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _any(n: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({n}, ' {w} ')" for w in words) + ")"


_PARTS = r"list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(%s, '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '[.!?;\n]'), lambda p: regexp_replace(replace(p, chr(1), '.'), '^\s+|\s+$', '', 'g')), lambda p: p <> '')"
_NORM = r"' ' || trim(regexp_replace(regexp_replace(lower(%s), '[^\p{L}\p{Nd}%%.,\-\s]', ' ', 'g'), '\s+', ' ', 'g')) || ' '"
_STEM = "CASE " + " ".join(f"WHEN strlen(w) > {len(x) + 3} AND suffix(w, '{x}') THEN left(w, length(w) - {len(x)})" for x in G.SUFFIXES) + " ELSE w END"
_TERMS = f"list_distinct(list_filter(list_transform(list_filter(string_split(%s, ' '), lambda w: w <> ''), lambda w: {_STEM}), lambda w: strlen(w) >= 2 AND w NOT IN ({_listed(G.STOP)})))"
_NUMBERS = r"list_sort(list_transform(regexp_extract_all(%s, '[-+]?[0-9]+(?:[.,][0-9]+)?%%?'), lambda x: regexp_replace(regexp_replace(regexp_replace(replace(rtrim(x, '%%'), ',', '.'), '^(-?)0+([0-9])', '\1\2'), '(\.[0-9]*?)0+$', '\1'), '\.$', '') || CASE WHEN suffix(x, '%%') THEN '%%' ELSE '' END))"
_QUANTIFIER = "CASE " + " ".join(f"WHEN {_any('%s', w.split())} THEN '{q}'" for q, w in G.QUANTIFIERS) + " END"
_OPPOSED = " OR ".join(f"contains(c, ' {x} ') AND contains(e, ' {y} ') OR contains(c, ' {y} ') AND contains(e, ' {x} ')" for x, y in G.ANTONYMS)
_GROUND = f"""
WITH f AS (SELECT doc_id, text, trim(split_part(text, '.', 1)) AS s FROM documents),
x AS (SELECT conv_id, turn, concat(c.text, '. ', CASE turn % 3 WHEN 0 THEN 'not ' || s WHEN 1 THEN s || ' in 1999' ELSE s END) AS answer, concat(s, ' in 2001. ', f.text) AS evidence FROM conversations c JOIN f ON doc_id = conv_id),
cl AS (SELECT conv_id, turn, generate_subscripts(p, 1) AS k, unnest(p) AS claim FROM (SELECT conv_id, turn, {_PARTS % 'answer'} AS p FROM x)),
sp AS (SELECT conv_id, turn, generate_subscripts(p, 1) AS place, unnest(p) AS span FROM (SELECT conv_id, turn, {_PARTS % 'evidence'} AS p FROM x)),
ct AS (SELECT conv_id, turn, k, c, {_TERMS % 'c'} AS t FROM (SELECT conv_id, turn, k, {_NORM % 'claim'} AS c FROM cl)),
st AS (SELECT conv_id, turn, place, n, {_TERMS % 'n'} AS t FROM (SELECT conv_id, turn, place, {_NORM % 'span'} AS n FROM sp)),
m AS (SELECT conv_id, turn, k, c, n AS e, CASE WHEN len(ct.t) > 0 THEN len(list_intersect(ct.t, coalesce(st.t, []))) / len(ct.t) ELSE 0 END AS alignment, place FROM ct LEFT JOIN st USING (conv_id, turn)),
b AS (SELECT conv_id, turn, k, c, coalesce(e, '  ') AS e, alignment FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, k ORDER BY alignment DESC, place) AS r FROM m) WHERE r = 1),
q AS (SELECT *, {_NUMBERS % 'c'} AS nc, {_NUMBERS % 'e'} AS ne, {_QUANTIFIER.replace('%s', 'c')} AS qc, {_QUANTIFIER.replace('%s', 'e')} AS qe FROM b),
v AS (SELECT conv_id, turn, alignment, CASE WHEN alignment < 0.45 THEN 'LOW_ALIGNMENT' WHEN len(nc) > 0 AND len(nc) = len(ne) AND nc <> ne THEN 'NUMERIC' WHEN {_any('c', G.NEGATIVE)} <> {_any('e', G.NEGATIVE)} THEN 'POLARITY'
  WHEN qc <> qe AND (qc = 'NEVER' OR qe = 'NEVER') THEN 'QUANTIFIER' WHEN {_OPPOSED} THEN 'ANTONYM' WHEN alignment >= 0.70 THEN 'SUPPORTED' ELSE 'ALIGNED' END AS reason FROM q),
g AS (SELECT conv_id, turn, count(*) AS claims, avg(round(alignment, 6)) AS mean, count_if(reason <> 'LOW_ALIGNMENT') AS covered, count_if(reason IN ('NUMERIC', 'POLARITY', 'QUANTIFIER', 'ANTONYM')) AS against, count_if(reason = 'SUPPORTED') AS good FROM v GROUP BY ALL),
d AS (SELECT *, CASE WHEN against > 0 THEN 'CONTRADICTED' WHEN covered = 0 THEN 'UNKNOWN' WHEN good = claims THEN 'SUPPORTED' WHEN covered < claims THEN 'INSUFFICIENT' ELSE 'UNKNOWN' END AS verdict FROM g)
SELECT conv_id, turn, verdict, round(CASE WHEN against > 0 THEN 1.0 WHEN covered = 0 THEN 0.0 WHEN verdict = 'INSUFFICIENT' THEN covered / claims ELSE mean END, 6) AS confidence, round(covered / claims, 6) AS coverage, claims FROM d
"""


@query(_GROUND)
def grounding_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-09 to SF-17, JN-12: each turn, and a changed sentence of a document, verified against that document's whole text."""
    s = F.trim(F.substring_index("text", ".", 1))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), s.alias("s"), F.concat(s, F.lit(" in 2001. "), "text").alias("evidence"))
    c = read(spark, sf_dir, "conversations").join(d, "conv_id")
    changed = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("not "), "s")).when(F.col("turn") % 3 == 1, F.concat("s", F.lit(" in 1999"))).otherwise(F.col("s"))
    r = G.verdicts(c.select(F.struct("conv_id", "turn").alias("id"), F.concat("text", F.lit(". "), changed).alias("answer"), "evidence"))
    return r.select("id.conv_id", "id.turn", "verdict", "confidence", "coverage", "claims")


_TRI = r"list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i : i + 2], ' ')))"


@query(
    rf"WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+') AS w FROM benchmark), bt AS (SELECT item_id, unnest({_TRI}) AS t FROM b), bn AS (SELECT item_id, count(*) AS total FROM bt GROUP BY item_id), "
    rf"d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+') AS w FROM documents), dt AS (SELECT doc_id, unnest({_TRI}) AS t FROM d), h AS (SELECT item_id, doc_id, count(*) AS shared FROM bt JOIN dt USING (t) GROUP BY ALL) SELECT item_id, doc_id, shared, total, round(shared / total, 6) AS share FROM h JOIN bn USING (item_id) WHERE shared / total >= 0.5"
)
def trigram_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-08, JN-20: benchmark items of whose word triples a document has half or more."""
    items = read(spark, sf_dir, "benchmark").select("item_id", X.trigrams(F.col("text")).alias("t"))
    docs = read(spark, sf_dir, "documents").select("doc_id", X.spaced_words(F.col("text")).alias("text"))
    hit = C.contained_runs(docs, items, 0.5)
    return hit.select("item_id", "doc_id", "shared", "total", F.round("share", 6).alias("share"))


@query(
    "WITH q AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS query_id, b.label, greatest(0.0, list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS s FROM q JOIN embeddings b ON b.vec_id <> q.vec_id) SELECT query_id, label, round(max(s), 6) AS best FROM p GROUP BY ALL"
)
def best_passage_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-33, JN-13, SRC-22: each query vector's best cosine with the vectors of each label, not below 0.

    The queries are the vectors whose id 20 divides, held against all rows.
    """
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return C.best_cosine(e.where("id % 20 = 0").select("id", "v"), e).select(F.col("id").alias("query_id"), "label", F.round("best", 6).alias("best"))


@query(
    "WITH h AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS s, list_distinct(string_split(lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), ' ')) AS p FROM conversations), d AS (SELECT conv_id, turn, CASE WHEN p IS NULL THEN 0 ELSE 1 - len(list_intersect(s, p)) / len(list_distinct(list_concat(s, p))) END AS drift FROM h) SELECT conv_id, count(*) AS hops, round(avg(drift), 6) AS mean_drift, round(arg_max(drift, turn), 6) AS last_drift FROM d GROUP BY conv_id"
)
def hop_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-04, AG-42, AG-43, ST-03: how far each hop's words drift from the hop before."""
    own = F.array_distinct(F.split(F.lower("text"), " "))
    w = Window.partitionBy("conv_id").orderBy("turn")
    h = read(spark, sf_dir, "conversations").select("conv_id", "turn", own.alias("s"), F.lag(own).over(w).alias("p"))
    drift = F.when(F.col("p").isNull(), 0.0).otherwise(1 - F.size(F.array_intersect("s", "p")) / F.size(F.array_union("s", "p")))
    d = h.select("conv_id", "turn", drift.alias("drift"))
    return d.groupBy("conv_id").agg(F.count("*").alias("hops"), F.round(F.avg("drift"), 6).alias("mean_drift"), F.round(F.max_by("drift", "turn"), 6).alias("last_drift"))


@query(
    r"WITH t AS (SELECT conv_id, turn, unnest(list_distinct(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), lambda w: concat_ws(':', role, w)))) AS atom FROM conversations), "
    "a AS (SELECT conv_id, atom, bool_or(turn < 2) AS want, bool_or(turn >= 2) AS got FROM t GROUP BY ALL) "
    "SELECT conv_id, round(coalesce(count_if(want AND got) / nullif(count_if(want), 0), 1), 6) AS preserved, round(coalesce(count_if(got AND NOT want) / nullif(count_if(got), 0), 0), 6) AS invented FROM a GROUP BY conv_id"
)
def semantic_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-42, ST-04, ST-09, SP-34, SP-35: atoms, all words of each role, kept and invented between a dialogue's first two turns and the rest."""
    atom = F.explode(F.array_distinct(F.transform(X.words(F.col("text")), lambda w: F.concat_ws(":", F.col("role"), w)))).alias("atom")
    late = F.col("turn") >= 2
    return C.preserved(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), late.alias("late"), atom)).withColumnRenamed("key", "conv_id")


@query(r"SELECT doc_id, regexp_extract(a, '^store://carrier/docs/([^/]+)/', 1) AS doc, CAST(regexp_extract(a, '/pages/([0-9]{6})', 1) AS BIGINT) AS page, coalesce(TRY_CAST(nullif(regexp_extract(a, '/blocks/([0-9]{4})$', 1), '') AS BIGINT), -1) AS block, regexp_full_match(a, 'store://carrier/(docs/[^/]+/)?pages/[0-9]{6}(/blocks/[0-9]{4})?') AS valid FROM (SELECT doc_id, concat('store://carrier/docs/', source, '/pages/', lpad(CAST(doc_id AS VARCHAR), 6, '0'), CASE WHEN doc_id % 2 = 0 THEN concat('/blocks/', lpad(CAST(doc_id % 100 AS VARCHAR), 4, '0')) ELSE '' END) AS a FROM documents)")
def address_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-19, FLT-20: addresses taken apart and checked."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    a = F.concat(F.lit("store://carrier/docs/"), "source", F.lit("/pages/"), pad(F.col("doc_id"), 6), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/blocks/"), pad(F.col("doc_id") % 100, 4))).otherwise(""))
    d = read(spark, sf_dir, "documents").select("doc_id", a.alias("a"))
    block = F.regexp_extract("a", r"/blocks/([0-9]{4})$", 1)
    return d.select("doc_id", F.regexp_extract("a", r"^store://carrier/docs/([^/]+)/", 1).alias("doc"), F.regexp_extract("a", r"/pages/([0-9]{6})", 1).cast("long").alias("page"), F.when(block != "", block.try_cast("long")).otherwise(F.lit(-1)).cast("long").alias("block"), F.col("a").rlike(r"^store://carrier/(docs/[^/]+/)?pages/[0-9]{6}(/blocks/[0-9]{4})?$").alias("valid"))


@query(r"WITH c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('UNFOLD store://carrier/pages/', lpad(CAST(doc_id AS VARCHAR), 6, '0'), CASE WHEN doc_id % 4 = 0 THEN ':low' ELSE '' END) ELSE concat('GROUP term:', source, ' depth:', doc_id % 4) END AS cmd FROM documents) SELECT doc_id, regexp_extract(cmd, '^(UNFOLD|GROUP)', 1) AS verb, regexp_extract(cmd, '^UNFOLD (store://\S+?)(?::(low|high))?$', 1) AS address, regexp_extract(cmd, ':(low|high)$', 1) AS fidelity, regexp_extract(cmd, 'term:(\S+)', 1) AS term, coalesce(TRY_CAST(nullif(regexp_extract(cmd, 'depth:([0-9]+)', 1), '') AS BIGINT), 0) AS depth FROM c")
def command_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-21: the two commands taken apart."""
    cmd = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("UNFOLD store://carrier/pages/"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.when(F.col("doc_id") % 4 == 0, ":low").otherwise(""))).otherwise(F.concat(F.lit("GROUP term:"), "source", F.lit(" depth:"), (F.col("doc_id") % 4).cast("string")))
    c = read(spark, sf_dir, "documents").select("doc_id", cmd.alias("cmd"))
    x = lambda p: F.regexp_extract("cmd", p, 1)
    depth = x(r"depth:([0-9]+)")
    return c.select("doc_id", x(r"^(UNFOLD|GROUP)").alias("verb"), x(r"^UNFOLD (store://\S+?)(?::(low|high))?$").alias("address"), x(r":(low|high)$").alias("fidelity"), x(r"term:(\S+)").alias("term"), F.when(depth != "", depth.try_cast("long")).otherwise(F.lit(0)).cast("long").alias("depth"))


@query("WITH s AS (SELECT doc_id, string_split(text, '.') AS parts FROM documents), q AS (SELECT doc_id, concat('¿Cuál es el contenido principal de la página ', doc_id, '?') AS question FROM s UNION ALL SELECT doc_id, concat('Resumen brevemente los puntos importantes de la página ', doc_id) FROM s UNION ALL SELECT doc_id, concat('¿Qué términos técnicos o conceptos clave aparecen en la página ', doc_id, '?') FROM s) SELECT question, count(*) AS n FROM q GROUP BY question")
def template_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-27: the three fixed questions of each page."""
    forms = F.array(F.lit("¿Cuál es el contenido principal de la página %d?"), F.lit("Resumen brevemente los puntos importantes de la página %d"), F.lit("¿Qué términos técnicos o conceptos clave aparecen en la página %d?"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(forms).alias("form"))
    return d.groupBy(F.replace("form", F.lit("%d"), F.col("doc_id").cast("string")).alias("question")).agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS t FROM documents), c AS (SELECT doc_id, t, count(*) AS n FROM w WHERE length(t) > 4 GROUP BY ALL) SELECT doc_id, t, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, t) AS k FROM c) WHERE k <= 3")
def salient_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-51, TK-14: each document's most frequent longer words."""
    w = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("t")).where(F.length("t") > 4)
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "t"))
    return w.groupBy("doc_id", "t").agg(F.count("*").alias("n")).withColumn("k", k).where("k <= 3").drop("k")


@query("SELECT vec_id, (vec_id * 37) % 256 AS a, (vec_id * 91) % 256 AS b, CAST(bit_count(xor((vec_id * 37) % 256, (vec_id * 91) % 256)) AS INTEGER) AS distance FROM embeddings")
def hamming_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-39: Hamming distance of bit strings."""
    bits = lambda c: F.lpad(F.bin(c), 8, "0")
    e = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 37 % 256).alias("a"), (F.col("vec_id") * 91 % 256).alias("b"))
    return e.select("vec_id", "a", "b", N.hamming(bits(F.col("a")), bits(F.col("b"))).alias("distance"))
