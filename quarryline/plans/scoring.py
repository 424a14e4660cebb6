"""Queries of the scoring and calibration families, over events, conversations, documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import scoring as S
from quarryline.plans.catalog import query
from quarryline.plans.inputs import LEDGER_SQL, PREDICTIONS_SQL, STAGES, ledger, predictions, read

_NORM = r"trim(regexp_replace(upper(answer), '[^\p{L}\p{Nd}_]+', ' ', 'g'))"
_HAS = lambda need: "len(list_filter([" + ", ".join(f"'{t}'" for t in need.split()) + "], lambda t: NOT list_contains(w, t))) = 0"
_PASS = (
    "CASE question WHEN 'Q0' THEN contains(n, 'BOX') AND contains(n, 'CELL') AND contains(n, 'ARROW') AND contains(n, 'TRANSITION') AND contains(n, 'RING') AND contains(n, 'CHECKPOINT') AND (contains(n, 'TIME') OR contains(n, 'TEMPORAL')) "
    + " ".join(f"WHEN '{q}' THEN {_HAS(need)}" for q, need in S.NEEDED.items())
    + " WHEN 'Q6' THEN contains(n, 'NO') AND contains(n, 'LITERAL') AND (contains(n, 'VIDEO') OR contains(n, 'FRAME')) "
    f"WHEN 'Q8' THEN NOT regexp_matches(answer, '(?i)\\b[0-9a-f]{{64}}\\b') AND regexp_matches(n, '{S.HONEST}') END"
)
_ANSWERS = ["A and B and C", "a is active; b waits", "A: ACTIVE, then B", "A done, C active", "T0 T2 T4", "it is not a literal video", "A done B done C active", "UNKNOWN", "box cell arrow transition ring checkpoint time", "maybe"]
_DEFS = ", ".join(f"('{q}', '{layer}')" for q, layer in S.LAYER.items())
_ANSWER = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ANSWERS)) + " END"
_TRIALS = (
    f"WITH t AS (SELECT DISTINCT user_id AS trial FROM events), d(question, layer) AS (VALUES {_DEFS}), "
    f"r AS (SELECT user_id AS trial, concat('Q', event_id % 11) AS question, {_ANSWER} AS answer, event_id AS pos FROM events), "
    f"l AS (SELECT trial, question, arg_max(answer, pos) AS answer FROM r GROUP BY ALL), j AS (SELECT t.trial, d.question, d.layer, l.answer, {_NORM} AS n, string_split({_NORM}, ' ') AS w FROM t CROSS JOIN d LEFT JOIN l ON l.trial = t.trial AND l.question = d.question), "
    f"e AS (SELECT trial, question, layer, coalesce({_PASS}, false) AS pass FROM j) "
)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    answer = F.element_at(X.literals(_ANSWERS), (F.col("event_id") % 10 + 1).cast("int"))
    responses = e.select(F.col("user_id").alias("trial"), F.concat(F.lit("Q"), (F.col("event_id") % 11).cast("string")).alias("question"), answer.alias("answer"), F.col("event_id").alias("pos"))
    return S.evaluated(e.select(F.col("user_id").alias("trial")).distinct(), responses)


@query(_TRIALS + "SELECT * FROM e")
def trial_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-03, WN-05, SF-04, SF-06, SF-07, SF-08, SP-36: every expected question of each trial."""
    return results(spark, sf_dir)


@query(_TRIALS + "SELECT trial, layer, count_if(pass)::BIGINT AS passed, count(*) AS total, round(avg(CAST(pass AS DOUBLE)), 6) AS score FROM e GROUP BY ALL")
def layer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-07: passed of total by layer."""
    return S.layer_scores(results(spark, sf_dir))


@query(_TRIALS + ", l AS (SELECT trial, layer, avg(CAST(pass AS DOUBLE)) AS s FROM e GROUP BY ALL) SELECT trial, round((SELECT avg(CAST(pass AS DOUBLE)) FROM e WHERE e.trial = l.trial), 6) AS overall, round(avg(s), 6) AS mean_of_layers FROM l GROUP BY trial".replace(", l AS (SELECT trial, layer", ", y AS (SELECT trial, layer").replace("e.trial = l.trial", "e.trial = y.trial").replace("FROM l GROUP", "FROM y GROUP"))
def trial_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-07, AG-11: overall score, and the mean of the layers' scores."""
    return S.overall(results(spark, sf_dir))


_LAST = lambda c: f"round(coalesce(arg_max(score, event_id) FILTER (WHERE condition = '{c}'), 0), 6)"


@query(f"WITH {LEDGER_SQL}, p AS (SELECT model_id, specimen_id, {_LAST('NATIVE')} AS native, {_LAST('ASSISTED')} AS assisted, {_LAST('DEGRADED')} AS degraded FROM ledger WHERE kind = 'OBSERVATION' GROUP BY ALL) SELECT *, round(assisted - native, 6) AS gain FROM p")
def condition_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-08, AG-11: the last score under each condition side by side."""
    return S.condition_pivot(ledger(spark, sf_dir))


_RANK = f"list_position([{', '.join(repr(s) for s in STAGES)}], stage) - 1"
_MODE = lambda c, w="": f"(SELECT {c} FROM o i WHERE i.model_id = o.model_id AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(f"WITH {LEDGER_SQL}, o AS (SELECT *, {_RANK} AS rank FROM ledger WHERE kind = 'OBSERVATION' AND stage IS NOT NULL) SELECT model_id, count(*) AS reports, round(avg(CAST(coalesce(pass, false) AS DOUBLE)), 6) AS consistency, {_MODE('stage')} AS dominant, arg_min(stage, rank) AS earliest, arg_max(stage, rank) AS furthest, {_MODE('failure_code')} AS code FROM o GROUP BY model_id")
def mode_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-09, AG-10, SF-40: dominant, earliest and furthest stage of each model."""
    return S.frontier(ledger(spark, sf_dir).where("kind = 'OBSERVATION'"))


@query(f"WITH {LEDGER_SQL} SELECT condition, count_if(pass = false)::BIGINT AS active_failures, count_if(coalesce(pass, false))::BIGINT AS clean, count_if(failure_code IS NULL)::BIGINT AS missing, round(avg(score), 6) AS mean FROM ledger WHERE kind = 'OBSERVATION' GROUP BY condition")
def loop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-13, AG-11: failures, clean and missing rows by condition."""
    o = ledger(spark, sf_dir).where("kind = 'OBSERVATION'").groupBy("condition")
    return o.agg(F.count_if(~F.col("pass")).alias("active_failures"), F.count_if(F.coalesce("pass", F.lit(False))).alias("clean"), F.count_if(F.col("failure_code").isNull()).alias("missing"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"WITH {PREDICTIONS_SQL} SELECT slice, count(*) AS n, count_if(NOT abstained)::BIGINT AS covered, round(avg(CAST(NOT abstained AS DOUBLE)), 6) AS coverage, round(coalesce(avg(CAST(correct AS DOUBLE)) FILTER (WHERE NOT abstained), 0), 6) AS accuracy, round(coalesce(avg(pow(confidence - CAST(correct AS DOUBLE), 2)) FILTER (WHERE NOT abstained), 0), 6) AS brier FROM predictions GROUP BY slice")
def calibration_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-17, AG-18, AG-21: accuracy, Brier score and coverage by slice."""
    return S.calibration(predictions(spark, sf_dir))


@query(f"WITH {PREDICTIONS_SQL}, b AS (SELECT slice, greatest(0, least(9, floor(confidence * 10))) AS bin, count(*) AS n, abs(avg(confidence) - avg(CAST(correct AS DOUBLE))) AS gap FROM predictions GROUP BY ALL) SELECT slice, round(sum(n * gap) / sum(n), 6) AS ece FROM b GROUP BY slice")
def calibration_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-19: expected calibration error."""
    return S.calibration_error(predictions(spark, sf_dir))


_CURVE = f"WITH {PREDICTIONS_SQL}, c AS (SELECT slice, CAST(t AS DOUBLE) AS threshold, round(avg(CAST(confidence >= t AS DOUBLE)), 6) AS coverage, round(coalesce(avg(CAST(correct AS DOUBLE)) FILTER (WHERE confidence >= t), 0), 6) AS accuracy FROM predictions, (VALUES (0.0), (0.25), (0.5), (0.75), (0.9)) v(t) GROUP BY ALL) "
_POINTS = [0.0, 0.25, 0.5, 0.75, 0.9]


@query(_CURVE + "SELECT * FROM c")
def abstention_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-20: coverage and accuracy at thresholds."""
    return S.abstention_curve(predictions(spark, sf_dir), _POINTS)


@query(_CURVE + "SELECT slice, CAST(coalesce(min(threshold) FILTER (WHERE accuracy >= 0.5), 1.01) AS DOUBLE) AS floor FROM c GROUP BY slice")
def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-54: the first threshold of the wanted accuracy."""
    return S.confidence_floor(S.abstention_curve(predictions(spark, sf_dir), _POINTS), 0.5)


@query(f"WITH {PREDICTIONS_SQL} SELECT event_id, CASE WHEN domain = 'error' THEN 'UNSUPPORTED' WHEN domain NOT IN ('view', 'click', 'purchase') THEN 'UNSUPPORTED' WHEN confidence < 0.4 THEN 'LOW_EVIDENCE' WHEN slice = 'out' THEN 'UNKNOWN' ELSE 'ANSWERED' END AS verdict FROM predictions")
def calibration_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10: the abstention policy, its first rule that applies."""
    return S.calibration_verdict(predictions(spark, sf_dir), ["error"], ["view", "click", "purchase"], 0.4).select("event_id", "verdict")


@query(f"WITH {PREDICTIONS_SQL}, b AS (SELECT domain, slice, greatest(0, least(9, floor(confidence * 10))) AS bin, count(*) AS n, abs(avg(confidence) - avg(CAST(correct AS DOUBLE))) AS gap, count_if(correct) AS ok FROM predictions GROUP BY ALL), m AS (SELECT domain, sum(n * gap) FILTER (WHERE slice = 'in') / sum(n) FILTER (WHERE slice = 'in') AS ece, sum(n) FILTER (WHERE slice = 'out') AS n_out, sum(ok) FILTER (WHERE slice = 'out') / sum(n) FILTER (WHERE slice = 'out') AS acc FROM b GROUP BY domain) SELECT domain, concat_ws(',', CASE WHEN n_out < 100 THEN 'OOD_TOO_SMALL' END, CASE WHEN ece > 0.10 THEN 'ECE_ABOVE_CEILING' END, CASE WHEN n_out >= 100 AND acc < 0.8 THEN 'OOD_ACCURACY_BELOW_FLOOR' END) AS reasons FROM m")
def admission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11, SP-44: every reason that keeps a model from being admitted."""
    return S.admission(predictions(spark, sf_dir))


@query("WITH p AS (SELECT quality = 0 AS truth, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE n_chars < 900 END AS guess FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) AS n, count(guess) AS covered, count_if(truth AND guess)::BIGINT AS tp, count_if(NOT truth AND guess)::BIGINT AS fp, count_if(truth AND NOT guess)::BIGINT AS fn FROM p) SELECT *, round(covered / n, 6) AS coverage, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM c")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-22: a guess by length against the quality labels."""
    p = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return S.confusion(p, F.col("quality") == 0, F.when(F.col("n_chars") % 7 != 0, F.col("n_chars") < 900))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(n) AS n, max(value) FILTER (WHERE place = CAST(floor((n - 1) * 0.5 + 0.999999) AS BIGINT) + 1) AS p50, max(value) FILTER (WHERE place = CAST(floor((n - 1) * 0.95 + 0.999999) AS BIGINT) + 1) AS p95, round(sum(value), 4) AS total FROM r GROUP BY event_type")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-14, AG-15: percentiles by the nearest rank above."""
    return S.percentiles(read(spark, sf_dir, "events"), "event_type", "value")


_RUNS = "WITH r AS (SELECT l_suppkey AS population, l_linenumber AS parallelism, min(l_quantity) AS q FROM lineitem GROUP BY ALL), u AS (SELECT r.population, r.parallelism, r.q >= 0.2 * s.q AS useful FROM r JOIN r s ON r.population = s.population AND s.parallelism = 1) "


@query(_RUNS + "SELECT population, CAST(coalesce(max(parallelism) FILTER (WHERE useful), 0) AS BIGINT) AS capacity, count(*) AS settings FROM (SELECT population, parallelism, bool_and(useful) AS useful FROM u GROUP BY ALL) GROUP BY population")
def capacity_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-14, AG-16: runs against their serial twins, and the most parallel setting that stays useful."""
    r = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("population"), F.col("l_linenumber").alias("parallelism")).agg(F.min("l_quantity").alias("q"))
    twin = r.where("parallelism = 1").select("population", F.col("q").alias("serial"))
    return S.capacity(r.join(twin, "population").withColumn("useful", F.col("q") >= 0.2 * F.col("serial")))


@query(f"WITH {PREDICTIONS_SQL}, p AS (SELECT family, confidence AS got, CASE WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE AS expected FROM predictions) SELECT family, count(*) AS n, round(avg(abs(got - expected)), 6) AS mae, round(sqrt(avg((got - expected) * (got - expected))), 6) AS rmse, round(corr(expected, got), 6) AS r, round(avg(got), 6) AS mean, round(stddev_pop(got), 6) AS std FROM p GROUP BY family")
def regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-52, AG-53: errors and correlation by family, mean and deviation of the predictions."""
    p = predictions(spark, sf_dir).select("family", F.col("confidence").alias("got"), F.col("correct").cast("double").alias("expected"))
    return S.regression_report(p)


@query("WITH p AS (SELECT doc_id, n_chars % 11 / 10.0 AS score FROM documents) SELECT count(*) AS pages, round(avg(score), 6) AS mean, min(score) AS low, max(score) AS high, round(median(score), 6) AS middle, count_if(score >= 0.7)::BIGINT AS passed, CASE WHEN avg(score) >= 0.7 THEN 'PASS' WHEN avg(score) >= 0.5 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM p")
def validation_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-34: a validation run's figures and its status, with the true median."""
    s = F.col("score")
    p = read(spark, sf_dir, "documents").select((F.col("n_chars") % 11 / 10.0).alias("score"))
    mean = F.avg(s)
    return p.agg(F.count("*").alias("pages"), F.round(mean, 6).alias("mean"), F.min(s).alias("low"), F.max(s).alias("high"), F.round(F.median(s), 6).alias("middle"), F.count_if(s >= 0.7).alias("passed"), F.when(mean >= 0.7, "PASS").when(mean >= 0.5, "PARTIAL").otherwise("FAIL").alias("status"))


@query("SELECT conv_id, count(*) AS turns, CAST(sum((strlen(text) + 3) // 4) AS BIGINT) AS tokens, round(sum((strlen(text) + 3) // 4) / count(*), 6) AS tokens_per_turn, round(count_if(role = 'assistant') / count(*), 6) AS learning_rate FROM conversations GROUP BY conv_id")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-35: turns and tokens of each session."""
    t = X.token_estimate(F.col("text"))
    n = F.count("*")
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(n.alias("turns"), F.sum(t).cast("long").alias("tokens"), F.round(F.sum(t) / n, 6).alias("tokens_per_turn"), F.round(F.count_if(F.col("role") == "assistant") / n, 6).alias("learning_rate"))


@query(f"WITH {LEDGER_SQL} SELECT model_id, round(avg(score) FILTER (WHERE failure_code IS NOT NULL AND score > 0), 6) AS confidence FROM ledger GROUP BY model_id")
def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-41: mean confidence of the rows that count."""
    return ledger(spark, sf_dir).groupBy("model_id").agg(F.round(F.avg(F.when(F.col("failure_code").isNotNull() & (F.col("score") > 0), F.col("score"))), 6).alias("confidence"))


@query(
    r"WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'define ' WHEN 1 THEN 'how ' ELSE '' END || text AS question, CASE WHEN (conv_id + turn) % 5 > 0 THEN 'comparison' END AS m, 0.5 + (conv_id + turn) % 4 * 0.15 AS s, CASE (conv_id + turn) % 3 WHEN 0 THEN 'ANSWERED' WHEN 1 THEN 'LOW_EVIDENCE' END AS v FROM conversations), "
    r"r AS (SELECT *, CASE WHEN m IS NULL THEN 'unreachable' WHEN v <> 'ANSWERED' THEN 'calibration:' || v WHEN v IS NULL AND s < 0.7 THEN 'uncalibrated-low-confidence' END AS model_rejected, ltrim(lower(question), '¿¡\"'' ') AS l FROM c), "
    r"k AS (SELECT *, CASE WHEN regexp_matches(l, 'compare|comparison|relationship|relaci[óo]n| vs |( vs\.)|difference|diferencia') THEN 'comparison' WHEN regexp_matches(l, '^(what is|what are|qué es|que es|define)') THEN 'definition' WHEN regexp_matches(l, '^(how |cómo|como |why |por qué|por que)| (how|cómo|como|why|por qué|por que) ') THEN 'process' WHEN regexp_matches(question, '\b[0-9]+(?:\.[0-9]+)?\b') THEN 'factual_detail' ELSE 'general' END AS rule FROM r) "
    "SELECT conv_id, turn, CASE WHEN model_rejected IS NULL THEN m ELSE rule END AS class, round(CASE WHEN model_rejected IS NULL THEN s WHEN rule = 'general' THEN 0.3 ELSE 0.8 END, 6)::DOUBLE AS confidence, CASE WHEN model_rejected IS NULL THEN 'model' ELSE 'rules' END AS method, m AS model_verdict, model_rejected FROM k".replace('\\"', '"')
)
def score_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-52, SP-53: a question's class by a recorded model where it can be trusted, else by the rules, with what was passed over and why."""
    n = F.col("conv_id") + F.col("turn")
    lead = F.when(F.col("turn") % 3 == 0, "define ").when(F.col("turn") % 3 == 1, "how ").otherwise("")
    rows = read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(lead, "text").alias("question"), F.when(n % 5 > 0, "comparison").alias("model_class"), (0.5 + n % 4 * 0.15).alias("model_confidence"),
        F.when(n % 3 == 0, "ANSWERED").when(n % 3 == 1, "LOW_EVIDENCE").alias("calibration"),
    )
    return S.classified(rows).drop("question").withColumn("confidence", F.round("confidence", 6))
