"""Lexical verification of claims against evidence text: spans, coverage, contradictions and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.numeric import cosine, ratio
from quarryline.functions.text import FUNCTION_WORDS, triples

CANDIDATE, SUPPORT = 0.45, 0.70

# Word lists, phrases and pairs of the rules.
STOP = "a al and are as at be by con de del dentro el en es esta este for from in is la las los mediante no of on o or para por que se su sus the to un una y".split()
NEGATIVE = ["no", "not", "never", "nunca", "ninguno", "ninguna", "without", "sin", "does not", "do not", "did not", "isn t", "arent", "aren t", "wasn t"]
QUANTIFIERS = [("ALL", "all todos todas"), ("NEVER", "none ninguno ninguna"), ("SOME", "some algunos algunas"), ("NEVER", "never nunca"), ("ALWAYS", "always siempre")]
ANTONYMS = [
    ("increase", "decrease"), ("increases", "decreases"), ("increased", "decreased"), ("aumenta", "disminuye"), ("aumentar", "disminuir"), ("before", "after"),
    ("antes", "despues"), ("antes", "después"), ("enable", "disable"), ("enabled", "disabled"), ("habilitado", "deshabilitado"), ("habilitada", "deshabilitada"),
    ("present", "absent"), ("presente", "ausente"), ("true", "false"), ("verdadero", "falso"), ("verdadera", "falsa"),
    ("distributed", "centralized"), ("distribuido", "centralizado"), ("distribuida", "centralizada"),
]
SUFFIXES = ["mente", "ing", "ed", "es", "s"]


def spans(text: Column) -> Column:
    """Sentences and clauses; a point between two digits doesn't end one."""
    parts = F.split(text, r"(?<![0-9])[.]|[.](?![0-9])|[!?;\n]")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def norm(text: Column) -> Column:
    """Lower case; letters, digits and % . , - stay; white space collapsed, with one space at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}%.,\-\s]", " "), r"\s+", " ")), F.lit(" "))


def stem(word: Column) -> Column:
    """Without the first of the suffixes that it ends with; lengths are in bytes."""
    out = word
    for suffix in reversed(SUFFIXES):
        out = F.when((F.octet_length(word) > len(suffix) + 3) & word.endswith(suffix), F.left(word, F.length(word) - len(suffix))).otherwise(out)
    return out


def terms(n: Column) -> Column:
    """Distinct stems of a normal form's words, without stop words."""
    words = F.transform(F.filter(F.split(n, " "), lambda w: w != ""), stem)
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOP)))


def coverage(claim: Column, evidence: Column) -> Column:
    """The share of the claim's terms that the evidence has."""
    return F.when(F.size(claim) > 0, F.size(F.array_intersect(claim, evidence)) / F.size(claim)).otherwise(0.0)


def negated(n: Column) -> Column:
    out = F.lit(False)
    for marker in NEGATIVE:
        out = out | F.contains(n, F.lit(f" {marker} "))
    return out


def numbers(n: Column) -> Column:
    """The numbers of a normal form as sorted text: commas as points, no idle zeros, a minus and a % kept."""
    raw = F.regexp_extract_all(n, F.lit(r"[-+]?[0-9]+(?:[.,][0-9]+)?%?"), 0)
    one = lambda x: F.concat(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(F.rtrim(x, F.lit("%")), F.lit(","), F.lit(".")), r"^(-?)0+([0-9])", "$1$2"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), F.when(x.endswith("%"), "%").otherwise(""))
    return F.array_sort(F.transform(raw, one))


def quantifier(n: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(QUANTIFIERS):
        hit = F.lit(False)
        for w in words.split():
            hit = hit | F.contains(n, F.lit(f" {w} "))
        out = F.when(hit, name).otherwise(out)
    return out


def antonym(a: Column, b: Column) -> Column:
    out = F.lit(False)
    has = lambda n, w: F.contains(n, F.lit(f" {w} "))
    for x, y in ANTONYMS:
        out = out | (has(a, x) & has(b, y)) | (has(a, y) & has(b, x))
    return out


def claim_verdicts(cases: DataFrame) -> DataFrame:
    """(id, claim_no, alignment, verdict, reason) of every claim of (id, answer, evidence).

    A claim is held against the span that covers it best, the earliest of equals. Spans and claims of a case meet inside its row.
    """
    held = lambda c: F.transform(spans(F.coalesce(c, F.lit(""))), lambda x: F.struct(norm(x).alias("n"), terms(norm(x)).alias("t")))
    # the spans are made once, and carried along as each claim looks for its best one; only what it found leaves the row
    out = "array<struct<c:string,best:struct<score:double,place:int,n:string>>>"
    start = F.struct(held("evidence").alias("spans"), F.array().cast(out).alias("out"))

    def step(state: Column, claim: Column) -> Column:
        scored = F.transform(state["spans"], lambda x, i: F.struct(coverage(claim["t"], x["t"]).cast("double").alias("score"), (-i).alias("place"), x["n"].alias("n")))
        return F.struct(state["spans"].alias("spans"), F.array_append(state["out"], F.struct(claim["n"].alias("c"), F.array_max(scored).alias("best"))).alias("out"))

    found = F.aggregate(held("answer"), start, step, lambda state: state["out"])
    own = cases.select("id", F.posexplode(found).alias("claim_no", "r")).select("id", "claim_no", F.col("r.c").alias("c"), F.col("r.best").alias("best"))
    s, e, c = F.coalesce(F.col("best.score"), F.lit(0.0)), F.coalesce(F.col("best.n"), F.lit("  ")), F.col("c")
    own = own.select("id", "claim_no", s.alias("alignment"), c.alias("c"), e.alias("e"))
    own = own.withColumns({"nc": numbers(F.col("c")), "ne": numbers(F.col("e")), "qc": quantifier(F.col("c")), "qe": quantifier(F.col("e"))})
    numeric = (F.size("nc") > 0) & (F.size("nc") == F.size("ne")) & (F.col("nc") != F.col("ne"))
    quant = F.col("qc").isNotNull() & F.col("qe").isNotNull() & (F.col("qc") != F.col("qe")) & ((F.col("qc") == "NEVER") | (F.col("qe") == "NEVER"))
    reason = (
        F.when(F.col("alignment") < CANDIDATE, "LOW_ALIGNMENT").when(numeric, "NUMERIC").when(negated(F.col("c")) != negated(F.col("e")), "POLARITY")
        .when(quant, "QUANTIFIER").when(antonym(F.col("c"), F.col("e")), "ANTONYM").when(F.col("alignment") >= SUPPORT, "SUPPORTED").otherwise("ALIGNED")
    )
    verdict = F.when(F.col("reason") == "SUPPORTED", "SUPPORTED").when(F.col("reason").isin("LOW_ALIGNMENT", "ALIGNED"), "UNKNOWN").otherwise("CONTRADICTED")
    return own.withColumn("reason", reason).select("id", F.col("claim_no").cast("long").alias("claim_no"), F.round("alignment", 6).alias("alignment"), verdict.alias("verdict"), "reason")


def verdicts(cases: DataFrame) -> DataFrame:
    """(id, verdict, confidence, coverage, claims): any contradiction decides; all supported is supported; a case without claims is insufficient.

    The confidence is 1 of a contradiction, the mean alignment of the claims where all are supported or all have evidence, the coverage where some have none.
    """
    own = claim_verdicts(cases).groupBy("id").agg(
        F.count("*").alias("claims"), F.avg("alignment").alias("mean"), F.count_if(F.col("reason") != "LOW_ALIGNMENT").alias("covered"), F.count_if(F.col("verdict") == "CONTRADICTED").alias("contradicted"), F.count_if(F.col("verdict") == "SUPPORTED").alias("supported"),
    )
    every = cases.select("id").join(own, "id", "left")
    verdict = (
        F.when(F.col("claims").isNull(), "INSUFFICIENT").when(F.col("contradicted") > 0, "CONTRADICTED").when(F.col("covered") == 0, "UNKNOWN")
        .when(F.col("supported") == F.col("claims"), "SUPPORTED").when(F.col("covered") < F.col("claims"), "INSUFFICIENT").otherwise("UNKNOWN")
    )
    coverage_ = F.coalesce(F.col("covered") / F.col("claims"), F.lit(0.0))
    confidence = F.when(F.col("claims").isNull() | (F.col("covered") == 0) & (F.col("contradicted") == 0), 0.0).when(verdict == "CONTRADICTED", 1.0).when(verdict == "INSUFFICIENT", coverage_).otherwise(F.col("mean"))
    return every.select("id", verdict.alias("verdict"), F.round(confidence, 6).alias("confidence"), F.round(coverage_, 6).alias("coverage"), F.coalesce("claims", F.lit(0)).cast("long").alias("claims"))


def answer_features(question: Column, answer: Column, passage: Column, q: Column, a: Column, p: Column, sentences: Column, chunks: Column) -> list[Column]:
    """The twelve features of an answer: cosines of its vector, the question's and the passage's; how well its sentences' vectors are supported by
    the passage's chunks; words shared, with function words left out; triples taken word for word; and rates of its own words."""
    w = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-záéíóúñü0-9]+"), 0)
    content = lambda ws: F.array_distinct(F.filter(ws, lambda x: ~x.isin(FUNCTION_WORDS)))
    x, y, z = w(answer), w(question), w(passage)
    support = F.transform(sentences, lambda s: F.coalesce(F.array_max(F.transform(chunks, lambda c: cosine(s, c))), F.lit(0.0)))
    total = F.aggregate(support, F.lit(0.0), lambda s, v: s + v)
    size = lambda v: F.size(v).cast("double")
    # the passage's triples are made once, and carried along as the answer's are looked up
    start = F.struct(triples(z).alias("z"), F.lit(0).alias("n"))
    taken = F.aggregate(triples(x), start, lambda s, t: F.struct(s["z"].alias("z"), (s["n"] + F.array_contains(s["z"], t).cast("int")).alias("n")), lambda s: s["n"].cast("double"))
    named = {
        "cos_answer_passage": F.round(cosine(a, p), 5), "cos_question_passage": F.round(cosine(q, p), 5), "cos_question_answer": F.round(cosine(q, a), 5),
        "support_mean": F.round(ratio(total, size(support)), 5), "support_min": F.round(F.coalesce(F.array_min(support), F.lit(0.0)), 5), "support_max": F.round(F.coalesce(F.array_max(support), F.lit(0.0)), 5),
        "answer_in_passage": F.round(ratio(size(F.array_intersect(content(x), z)), size(content(x))), 6), "question_in_answer": F.round(ratio(size(F.array_intersect(content(y), x)), size(content(y))), 6),
        "verbatim_triples": F.round(ratio(taken, size(triples(x))), 6), "length_ratio": F.round(F.least(F.lit(2.0), F.length(answer) / F.greatest(F.length(passage), F.lit(1))), 6),
        "type_token": F.round(ratio(size(F.array_distinct(x)), size(x)), 6), "function_words": F.round(ratio(size(F.filter(x, lambda t: t.isin(FUNCTION_WORDS))), size(x)), 6),
    }
    return [v.alias(n) for n, v in named.items()]
