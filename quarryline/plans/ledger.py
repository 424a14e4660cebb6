"""Queries of the ledger family, over events read as experiment records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.operators import ledger as L
from quarryline.plans.catalog import query
from quarryline.plans.inputs import LEDGER_SQL, ledger, read

_FAIL = f"WITH {LEDGER_SQL}, f AS (SELECT *, coalesce(stage, 'UNKNOWN_STAGE') AS stage_, coalesce(failure_code, 'BENCHMARK_ASSERTION_FAILED') AS code_, coalesce(layer, 'UNKNOWN_LAYER') AS layer_ FROM ledger WHERE kind = 'OBSERVATION' AND evidence_class = 'REAL_MODEL' AND pass = false)"
# Fixed values, written out for SQL: codes and stages with their targets, targets with their kinds of change, best first.
_TARGET = """CASE WHEN code = 'NO_VISUAL_SIGNAL' THEN 'VISUAL_SIGNAL' WHEN code = 'BOOT_NOT_FOUND' THEN 'BOOT' WHEN code = 'ROSETTA_NOT_FOUND' THEN 'ROSETTA'
  WHEN code = 'CODEC_NOT_FOUND' THEN 'CODEC_REGISTRY' WHEN code = 'CAPABILITY_MISMATCH' THEN 'CAPABILITY_FALLBACK' WHEN code = 'T2_NOT_FOUND' THEN 'T2_NAVIGATION'
  WHEN code = 'SEMANTIC_EVIDENCE_INSUFFICIENT' THEN 'SEMANTIC_LAYOUT' WHEN code = 'TEMPORAL_RULE_AMBIGUOUS' THEN 'TEMPORAL_GRAMMAR'
  WHEN code = 'TEMPORAL_EXECUTION_INCOMPLETE' THEN 'EXECUTION_POLICY_COMPLIANCE'
  WHEN code IN ('RULE_FIRING_PRECONDITION_VIOLATION', 'EXECUTION_SEMANTICS_CONTRADICTION', 'CROSS_MODEL_EXECUTION_FIDELITY_FAILED') THEN 'SYNCHRONOUS_EXECUTION_FIDELITY'
  WHEN code = 'CELL_IDENTITY_CONFUSION' THEN 'CELL_IDENTITY_ENCODING' WHEN code = 'FROM_STATE_PRECONDITION_CONFUSION' THEN 'FROM_STATE_PRECONDITION_VISIBILITY'
  WHEN code = 'CONDITION_TARGET_BINDING_CONFUSION' THEN 'RULE_ROLE_BINDING' WHEN code = 'CHECKPOINT_NOT_FOUND' THEN 'TEMPORAL_ROUTING'
  WHEN code IN ('ARTIFACT_GENERATION_REGRESSION', 'UNAUTHORIZED_SEMANTIC_DRIFT') THEN 'SEMANTIC_PARITY_GATE' WHEN code = 'UNSUPPORTED_OPERATION' THEN 'CAPABILITY_PROFILE'
  WHEN stage = 'ROSETTA' THEN 'ROSETTA_TO_T2_ROUTE' WHEN stage IN ('TEMPORAL_ROUTE', 'TEMPORAL_STEP') THEN 'TEMPORAL_PROGRAM' ELSE 'BENCHMARK_FAILURE_ANALYSIS' END"""
_KINDS_OF = """CASE target WHEN 'VISUAL_SIGNAL' THEN ['PRIMITIVE', 'REDUNDANCY', 'LAYOUT', 'COLOR_USAGE'] WHEN 'BOOT' THEN ['PROMPT', 'LAYOUT', 'REDUNDANCY', 'PRIMITIVE']
  WHEN 'ROSETTA' THEN ['PROMPT', 'LAYOUT', 'REDUNDANCY', 'PRIMITIVE'] WHEN 'CODEC_REGISTRY' THEN ['PROMPT', 'LAYOUT', 'CHANNEL_ROLE', 'REDUNDANCY']
  WHEN 'CAPABILITY_FALLBACK' THEN ['PROMPT', 'CHANNEL_ROLE', 'REDUNDANCY'] WHEN 'T2_NAVIGATION' THEN ['LAYOUT', 'PROMPT', 'REDUNDANCY', 'CHANNEL_ROLE']
  WHEN 'SEMANTIC_LAYOUT' THEN ['LAYOUT', 'PRIMITIVE', 'REDUNDANCY', 'CHANNEL_ROLE'] WHEN 'TEMPORAL_GRAMMAR' THEN ['TEMPORAL_STRUCTURE', 'PROMPT', 'PRIMITIVE', 'CHANNEL_ROLE']
  WHEN 'TEMPORAL_ROUTING' THEN ['TEMPORAL_STRUCTURE', 'LAYOUT', 'REDUNDANCY', 'PROMPT'] WHEN 'CAPABILITY_PROFILE' THEN ['PROMPT', 'CHANNEL_ROLE', 'REDUNDANCY']
  WHEN 'ROSETTA_TO_T2_ROUTE' THEN ['LAYOUT', 'PROMPT', 'REDUNDANCY', 'CHANNEL_ROLE'] WHEN 'TEMPORAL_PROGRAM' THEN ['TEMPORAL_STRUCTURE', 'LAYOUT', 'PROMPT', 'REDUNDANCY']
  ELSE ['PROMPT', 'LAYOUT', 'REDUNDANCY', 'PRIMITIVE'] END"""
_ALL = "('PROMPT'), ('CHANNEL_ROLE'), ('PRIMITIVE'), ('LAYOUT'), ('REDUNDANCY'), ('COLOR_USAGE'), ('NUMERIC_STRUCTURE'), ('INTERFERENCE_STRUCTURE'), ('DEPTH_STRUCTURE'), ('TEMPORAL_STRUCTURE'), ('EMERGENT_STRUCTURE')"
_PATTERNS = _FAIL + ", p AS (SELECT stage_ AS stage, code_ AS code, layer_ AS layer, count(*) AS n, string_agg(DISTINCT model_id, ',' ORDER BY model_id) AS models, string_agg(DISTINCT specimen_id, ',' ORDER BY specimen_id) AS specimens, string_agg(DISTINCT question_id, ',' ORDER BY question_id) AS questions, count(DISTINCT model_id) AS n_models, count(DISTINCT specimen_id) AS n_specimens FROM f GROUP BY ALL)"
_DELTA = "coalesce(delta, score_after - score_before)"
_PROFILE = f"WITH {LEDGER_SQL}, p AS (SELECT concat(model_id, '/', condition) AS profile, case_key, bool_and(pass) AS pass FROM ledger WHERE kind = 'OBSERVATION' AND pass IS NOT NULL GROUP BY 1, 2)"
_HISTORY = f"t AS (SELECT DISTINCT candidate_id, mutation FROM ledger WHERE kind = 'CHANGE'), s AS (SELECT t.mutation, count(*) AS n, round(avg({_DELTA}), 9) AS mean FROM ledger l JOIN t USING (candidate_id) WHERE kind = 'OUTCOME' GROUP BY ALL)"
_WEIGHTS = _PATTERNS + f""", {_HISTORY}, top AS (SELECT *, {_TARGET} AS target FROM p ORDER BY n DESC, concat(stage, '|', code, '|', layer) LIMIT 5),
k AS (SELECT n * (1 + 0.1 * (n_models - 1) + 0.05 * (n_specimens - 1)) AS mass, {_KINDS_OF} AS kinds FROM top),
r AS (SELECT mutation, sum(mass * w) AS raw FROM (SELECT mass, unnest(kinds) AS mutation, unnest([1.0, 0.8, 0.6, 0.4][1 : len(kinds)])::DOUBLE AS w FROM k) GROUP BY mutation),
a(mutation) AS (VALUES {_ALL}), e AS (SELECT mutation, coalesce(raw, 0.0)::DOUBLE AS raw FROM a LEFT JOIN r USING (mutation)),
g AS (SELECT mutation, CASE WHEN sum(raw) OVER () > 0 THEN raw ELSE 1.0 END * (1 + greatest(-0.25, least(0.25, coalesce(mean, 0)))) AS raw FROM e LEFT JOIN s USING (mutation)),
w AS (SELECT mutation, round(0.85 * raw / sum(raw) OVER () + 0.15 / 11, 6) AS weight FROM g)"""
_SIGNALS = f"WITH {LEDGER_SQL}, {_HISTORY}"


@query(f"WITH {LEDGER_SQL} SELECT count(*) AS events, count_if(kind = 'OBSERVATION')::BIGINT AS observations, count_if(kind = 'CHANGE')::BIGINT AS changes, count_if(kind = 'OUTCOME')::BIGINT AS outcomes, count_if(kind = 'OBSERVATION' AND NOT coalesce(pass, false))::BIGINT AS failures, count_if(kind = 'OBSERVATION' AND evidence_class = 'REAL_MODEL')::BIGINT AS real, count_if(kind = 'OBSERVATION' AND evidence_class = 'SYNTHETIC')::BIGINT AS synthetic, count(DISTINCT model_id) AS models FROM ledger")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-01, SM-03: the ledger's counters."""
    return L.summary(ledger(spark, sf_dir))


@query(_PATTERNS + " SELECT * FROM p")
def failure_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-02, FLT-01: real failures by stage, code and layer."""
    return L.failure_patterns(L.real_failures(ledger(spark, sf_dir)))


@query(_PATTERNS + f" SELECT {_TARGET} AS target, n, concat(stage, '|', code, '|', layer) AS pattern FROM p ORDER BY n DESC, pattern LIMIT 1")
def next_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-05, SF-46: the most frequent pattern and what it suggests to work on."""
    return L.focus(L.real_failures(ledger(spark, sf_dir)), 1).select("target", "n", "pattern")


@query(f"WITH {LEDGER_SQL} SELECT candidate_id, count(*) AS n, round(avg({_DELTA}), 9) AS mean, round(max({_DELTA}), 9) AS best, round(min({_DELTA}), 9) AS worst FROM ledger WHERE kind = 'OUTCOME' GROUP BY candidate_id")
def candidate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-03: outcomes by candidate."""
    return L.outcomes(ledger(spark, sf_dir))


@query(_PROFILE + " SELECT profile, count(*) AS cases, count_if(pass)::BIGINT AS passes, count_if(NOT pass)::BIGINT AS failures, round(avg(CAST(pass AS DOUBLE)), 6) AS accuracy FROM p GROUP BY profile")
def profile_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-04, AG-05, SP-12: accuracy of each profile over its cases."""
    return L.accuracy(L.profiles(ledger(spark, sf_dir)))


@query(_PROFILE + ", n AS (SELECT a.profile AS a, b.profile AS b, count(*) AS shared, count_if(a.pass AND b.pass)::BIGINT AS both_pass, count_if(NOT a.pass AND NOT b.pass)::BIGINT AS both_fail, count_if(NOT a.pass AND b.pass)::BIGINT AS a_recovered, count_if(a.pass AND NOT b.pass)::BIGINT AS b_recovered FROM p a JOIN p b ON a.case_key = b.case_key AND a.profile < b.profile GROUP BY 1, 2) SELECT *, both_fail + a_recovered + b_recovered AS failure_union, round(coalesce(both_fail / nullif(both_fail + a_recovered + b_recovered, 0), 0), 6) AS overlap, round(coalesce((a_recovered + b_recovered) / nullif(both_fail + a_recovered + b_recovered, 0), 0), 6) AS complementarity, round((shared - both_fail) / shared, 6) AS oracle FROM n")
def profile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-06, JN-04: how profiles complement each other."""
    return L.pairwise(L.profiles(ledger(spark, sf_dir)))


@query(_WEIGHTS + " SELECT * FROM w")
def exploration_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-48, AG-49, SF-47: how likely each kind of change is to be tried next."""
    own = ledger(spark, sf_dir)
    return L.exploration_weights(L.real_failures(own), L.historical_signals(own))


@query(
    _WEIGHTS + """, o AS (SELECT mutation, row_number() OVER (ORDER BY weight DESC, mutation) AS place FROM w), z AS (SELECT o.*, (SELECT target FROM top ORDER BY n DESC, concat(stage, '|', code, '|', layer) LIMIT 1) AS t FROM o WHERE place <= 4)
SELECT CAST(place AS INTEGER) AS place, mutation, CASE WHEN mutation = 'LAYOUT' AND t IN ('T2_NAVIGATION', 'ROSETTA_TO_T2_ROUTE') THEN 'T1_TO_T2_ENTRY_ROUTE' WHEN mutation = 'PROMPT' AND t IN ('T2_NAVIGATION', 'ROSETTA_TO_T2_ROUTE') THEN 'ROSETTA.S2.READ_SUPERINDEX' WHEN mutation = 'REDUNDANCY' AND t = 'T2_NAVIGATION' THEN 'T2_ENTRY_MARKER' ELSE t END AS field,
CASE WHEN mutation = 'LAYOUT' THEN CASE WHEN t IN ('T2_NAVIGATION', 'ROSETTA_TO_T2_ROUTE') THEN 'EXPLICIT_DIRECTIONAL_ANCHOR' ELSE 'LOCALIZE_FAILURE_TARGET_REGION' END WHEN mutation = 'PROMPT' THEN CASE WHEN t IN ('T2_NAVIGATION', 'ROSETTA_TO_T2_ROUTE') THEN 'DECLARE_T2_LOCATION_BEFORE_DECODE' ELSE 'SHORT_EXPLICIT_PROTOCOL_INSTRUCTION' END
WHEN mutation = 'REDUNDANCY' THEN CASE WHEN t = 'T2_NAVIGATION' THEN 'REPEAT_AT_BOOT_AND_ROSETTA' ELSE 'BOUNDED_REDUNDANT_ANCHOR' END WHEN mutation = 'CHANNEL_ROLE' THEN 'DEDICATED_SEMANTIC_ROUTING_ROLE' WHEN mutation = 'PRIMITIVE' THEN 'DISTINCT_FAILURE_TARGET_PRIMITIVE' WHEN mutation = 'TEMPORAL_STRUCTURE' THEN 'EXPLICIT_PHASE_EVENT_CHECKPOINT_STRUCTURE'
WHEN mutation = 'COLOR_USAGE' THEN 'HIGH_CONTRAST_ROLE_SEPARATION' END AS value FROM z"""
)
def suggested_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-47: what the likeliest kinds of change are to set."""
    own = ledger(spark, sf_dir)
    failures = L.real_failures(own)
    return L.suggestions(failures, L.exploration_weights(failures, L.historical_signals(own)))


@query(_WEIGHTS + ", c AS (SELECT DISTINCT candidate_id, mutation FROM ledger WHERE kind = 'CHANGE'), m AS (SELECT candidate_id, count(DISTINCT concat(mutation, event_id % 3)) AS mutations FROM ledger WHERE kind = 'CHANGE' GROUP BY 1), q AS (SELECT candidate_id, round(greatest(0.0, avg(weight) - 0.02 * (any_value(mutations) - 1)), 6) AS priority FROM c JOIN w USING (mutation) JOIN m USING (candidate_id) GROUP BY candidate_id) SELECT candidate_id, priority, CAST(row_number() OVER (ORDER BY priority DESC, candidate_id) AS INTEGER) AS place FROM q")
def candidate_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-06, WN-07, SP-22: candidates in the order in which to try them."""
    own = ledger(spark, sf_dir)
    tried = own.where("kind = 'CHANGE'").select("candidate_id", "mutation", (F.col("event_id") % 3).alias("v")).distinct()
    return L.queue(tried.select("candidate_id", "mutation"), L.exploration_weights(L.real_failures(own), L.historical_signals(own)))


@query(_SIGNALS + " SELECT * FROM s")
def historical_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-06, SP-13: outcomes by the kinds of change tried before."""
    return L.historical_signals(ledger(spark, sf_dir))


@query(_SIGNALS + " SELECT CASE WHEN mean > 0 THEN 'PRESERVE' ELSE 'AVOID' END AS action, mutation AS target, CASE WHEN n >= 9 THEN 'HIGH' WHEN n >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, n, mean FROM s WHERE mean <> 0")
def derived_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-44, SP-20, SP-24: what to keep and what to avoid."""
    return L.policy(ledger(spark, sf_dir))


@query(_FAIL + ", n AS (SELECT *, row_number() OVER (PARTITION BY stage_, code_, layer_ ORDER BY event_id) AS k FROM f) SELECT stage_ AS stage, code_ AS code, layer_ AS layer, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS parents FROM n WHERE k <= 20 GROUP BY 1, 2, 3")
def parent_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-23, SP-14: the events behind each pattern, twenty at most: that bound is the operator's."""
    return L.parents(L.real_failures(ledger(spark, sf_dir)))


@query(_FAIL + " SELECT lower(stage) AS stage, lower(failure_code) AS code, count(*) AS n, min(event_id) AS first_id FROM f WHERE stage IS NOT NULL AND failure_code IS NOT NULL GROUP BY 1, 2")
def pattern_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-19: events by pattern, whatever the case of letters, without defaults."""
    f = L.real_failures(ledger(spark, sf_dir)).where("stage IS NOT NULL AND failure_code IS NOT NULL")
    return f.groupBy(F.lower("stage").alias("stage"), F.lower("failure_code").alias("code")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"WITH {LEDGER_SQL} SELECT kind, run_id, count(*) AS n FROM ledger WHERE kind <> 'OBSERVATION' OR run_id IN ('r1') GROUP BY ALL")
def planning_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06: this run's observations and all other events."""
    return L.planning_view(ledger(spark, sf_dir), ["r1"]).groupBy("kind", "run_id").agg(F.count("*").alias("n"))


@query(f"WITH {LEDGER_SQL} SELECT kind, coalesce(CASE WHEN kind = 'OBSERVATION' AND pass IS NULL THEN 'MISSING_PASS' WHEN kind = 'OBSERVATION' AND stage IS NULL THEN 'MISSING_STAGE' END, 'VALID') AS error, count(*) AS n FROM ledger GROUP BY ALL")
def event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-02, FLT-28, SP-66: events by the first required field they lack."""
    return L.error_code(ledger(spark, sf_dir)).groupBy("kind", F.coalesce("error", F.lit("VALID")).alias("error")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN c_custkey % 9 = 0 THEN 'PLACEHOLDER' WHEN c_custkey % 9 = 1 THEN 'SYNTHETIC' ELSE 'REAL' END AS class, count(*) AS n FROM customer GROUP BY 1")
def model_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05: placeholder, synthetic and real ids."""
    k = F.col("c_custkey") % 9
    name = F.when(k == 0, "replace_with_real_model_id").when(k == 1, F.concat(F.lit(" synthetic-"), F.col("c_name"))).otherwise(F.col("c_name"))
    return read(spark, sf_dir, "customer").groupBy(L.model_class(name).alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {LEDGER_SQL}, l AS (SELECT model_id, pass, row_number() OVER (PARTITION BY model_id ORDER BY event_id DESC) AS n FROM ledger WHERE kind = 'OBSERVATION' AND pass IS NOT NULL) SELECT model_id, pass FROM l WHERE n = 1")
def compatibility_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-45, WN-12: the last observation of each model decides."""
    return ledger(spark, sf_dir).where("kind = 'OBSERVATION' AND pass IS NOT NULL").groupBy("model_id").agg(F.max_by("pass", "event_id").alias("pass"))


@query(f"WITH {LEDGER_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY mutation, layer ORDER BY event_id) AS n FROM ledger WHERE kind = 'CHANGE') SELECT mutation, layer, candidate_id FROM f WHERE n = 1")
def rule_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-07, SP-21: rules by (kind, target), the first one kept."""
    return ledger(spark, sf_dir).where("kind = 'CHANGE'").groupBy("mutation", "layer").agg(F.min_by("candidate_id", "event_id").alias("candidate_id"))


@query(f"WITH {LEDGER_SQL} SELECT candidate_id, string_agg(DISTINCT mutation, ',' ORDER BY mutation) AS modules, count(DISTINCT mutation) AS changed, CASE count(DISTINCT mutation) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS causal FROM ledger WHERE kind = 'CHANGE' GROUP BY candidate_id")
def modules_by_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-18, SP-25, ST-02, FLT-32: the modules each candidate changed, and how sure a cause that leaves."""
    m = ledger(spark, sf_dir).where("kind = 'CHANGE'").groupBy("candidate_id").agg(L.listed("mutation").alias("modules"), F.count_distinct("mutation").alias("changed"))
    return m.withColumn("causal", F.when(F.col("changed") == 0, "UNKNOWN").when(F.col("changed") == 1, "HIGH").when(F.col("changed") == 2, "MEDIUM").otherwise("LOW"))


@query(f"WITH {LEDGER_SQL}, q AS (SELECT question_id, avg(score) FILTER (WHERE candidate_id < 'c2') AS base, avg(score) FILTER (WHERE candidate_id >= 'c2') AS cand FROM ledger WHERE kind = 'OBSERVATION' GROUP BY question_id) SELECT question_id, round(base, 6) AS base, round(cand, 6) AS cand, cand + 1e-12 >= base AS holds FROM q")
def non_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-19, AG-12: question means of a candidate set against the baseline's, with a tolerance."""
    o = ledger(spark, sf_dir).where("kind = 'OBSERVATION'")
    is_base = F.col("candidate_id") < "c2"
    q = o.groupBy("question_id").agg(F.avg(F.when(is_base, F.col("score"))).alias("base"), F.avg(F.when(~is_base, F.col("score"))).alias("cand"))
    return q.select("question_id", F.round("base", 6).alias("base"), F.round("cand", 6).alias("cand"), (F.col("cand") + 1e-12 >= F.col("base")).alias("holds"))


@query(f"WITH {LEDGER_SQL} SELECT candidate_id, count(*) AS n FROM ledger WHERE candidate_id = 'c1' OR specimen_id = 's1' OR starts_with(specimen_id, 's1-') GROUP BY candidate_id")
def baseline_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07: events of the baseline, by candidate, specimen or the specimen's prefix."""
    s = F.col("specimen_id")
    return ledger(spark, sf_dir).where((F.col("candidate_id") == "c1") | (s == "s1") | s.startswith("s1-")).groupBy("candidate_id").agg(F.count("*").alias("n"))


@query(f"WITH {LEDGER_SQL}, t AS (SELECT DISTINCT candidate_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('c', event_id % 4) END AS parent FROM ledger) SELECT candidate_id, parent FROM t WHERE candidate_id NOT IN (SELECT candidate_id FROM ledger WHERE kind = 'OUTCOME' AND score > 0.97) AND (parent IS NULL OR parent = 'c1')")
def available_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14: untested candidates of no parent or of the incumbent."""
    own = ledger(spark, sf_dir)
    all_ = own.select("candidate_id", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string"))).alias("parent")).distinct()
    tested = own.where("kind = 'OUTCOME' AND score > 0.97").select("candidate_id").distinct()
    return all_.join(tested, "candidate_id", "left_anti").where("parent IS NULL OR parent = 'c1'")


@query(f"WITH {LEDGER_SQL}, b AS (SELECT run_id, candidate_id, max(score) AS best FROM ledger WHERE kind = 'OBSERVATION' GROUP BY ALL) SELECT run_id, candidate_id, round(best, 6) AS best FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY best DESC, candidate_id) AS n FROM b) WHERE n = 1")
def best_of_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-13: the best candidate of each generation, ties by id."""
    b = ledger(spark, sf_dir).where("kind = 'OBSERVATION'").groupBy("run_id", "candidate_id").agg(F.max("score").alias("best"))
    n = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("best"), "candidate_id"))
    return b.withColumn("n", n).where("n = 1").select("run_id", "candidate_id", F.round("best", 6).alias("best"))


@query(f"WITH {LEDGER_SQL}, p AS (SELECT concat(model_id, '/', condition) AS worker, array_agg(DISTINCT question_id) AS keys_ FROM ledger WHERE kind = 'OBSERVATION' AND NOT coalesce(pass, true) GROUP BY 1) SELECT worker, len(keys_) AS n_keys FROM p")
def failed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-15: the questions each profile failed, to be asked once more."""
    f = ledger(spark, sf_dir).where("kind = 'OBSERVATION' AND pass = false")
    return f.groupBy(F.concat_ws("/", "model_id", "condition").alias("worker")).agg(F.count_distinct("question_id").alias("n_keys"))
