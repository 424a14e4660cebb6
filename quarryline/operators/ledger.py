"""Failure patterns, outcomes, profiles, plans and policies over the experiment ledger (see plans.inputs.LEDGER)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.numeric import clamp, ratio
from quarryline.operators.ordering import placed

# What a failure code suggests to work on, and which kinds of change suit a target, best first.
CODE_TARGET = {
    "NO_VISUAL_SIGNAL": "VISUAL_SIGNAL", "BOOT_NOT_FOUND": "BOOT", "ROSETTA_NOT_FOUND": "ROSETTA", "CODEC_NOT_FOUND": "CODEC_REGISTRY",
    "CAPABILITY_MISMATCH": "CAPABILITY_FALLBACK", "T2_NOT_FOUND": "T2_NAVIGATION", "SEMANTIC_EVIDENCE_INSUFFICIENT": "SEMANTIC_LAYOUT",
    "TEMPORAL_RULE_AMBIGUOUS": "TEMPORAL_GRAMMAR", "TEMPORAL_EXECUTION_INCOMPLETE": "EXECUTION_POLICY_COMPLIANCE",
    "RULE_FIRING_PRECONDITION_VIOLATION": "SYNCHRONOUS_EXECUTION_FIDELITY", "EXECUTION_SEMANTICS_CONTRADICTION": "SYNCHRONOUS_EXECUTION_FIDELITY",
    "CROSS_MODEL_EXECUTION_FIDELITY_FAILED": "SYNCHRONOUS_EXECUTION_FIDELITY", "CELL_IDENTITY_CONFUSION": "CELL_IDENTITY_ENCODING",
    "FROM_STATE_PRECONDITION_CONFUSION": "FROM_STATE_PRECONDITION_VISIBILITY", "CONDITION_TARGET_BINDING_CONFUSION": "RULE_ROLE_BINDING",
    "CHECKPOINT_NOT_FOUND": "TEMPORAL_ROUTING", "ARTIFACT_GENERATION_REGRESSION": "SEMANTIC_PARITY_GATE", "UNAUTHORIZED_SEMANTIC_DRIFT": "SEMANTIC_PARITY_GATE",
    "UNSUPPORTED_OPERATION": "CAPABILITY_PROFILE",
}
STAGE_TARGET = {"ROSETTA": "ROSETTA_TO_T2_ROUTE", "TEMPORAL_ROUTE": "TEMPORAL_PROGRAM", "TEMPORAL_STEP": "TEMPORAL_PROGRAM"}
OTHER_TARGET = "BENCHMARK_FAILURE_ANALYSIS"
UNKNOWN_STAGE, UNKNOWN_CODE, UNKNOWN_LAYER = "UNKNOWN_STAGE", "BENCHMARK_ASSERTION_FAILED", "UNKNOWN_LAYER"
TARGET_KINDS = {
    "VISUAL_SIGNAL": "PRIMITIVE REDUNDANCY LAYOUT COLOR_USAGE", "BOOT": "PROMPT LAYOUT REDUNDANCY PRIMITIVE", "ROSETTA": "PROMPT LAYOUT REDUNDANCY PRIMITIVE",
    "CODEC_REGISTRY": "PROMPT LAYOUT CHANNEL_ROLE REDUNDANCY", "CAPABILITY_FALLBACK": "PROMPT CHANNEL_ROLE REDUNDANCY", "T2_NAVIGATION": "LAYOUT PROMPT REDUNDANCY CHANNEL_ROLE",
    "SEMANTIC_LAYOUT": "LAYOUT PRIMITIVE REDUNDANCY CHANNEL_ROLE", "TEMPORAL_GRAMMAR": "TEMPORAL_STRUCTURE PROMPT PRIMITIVE CHANNEL_ROLE",
    "TEMPORAL_ROUTING": "TEMPORAL_STRUCTURE LAYOUT REDUNDANCY PROMPT", "CAPABILITY_PROFILE": "PROMPT CHANNEL_ROLE REDUNDANCY",
    "ROSETTA_TO_T2_ROUTE": "LAYOUT PROMPT REDUNDANCY CHANNEL_ROLE", "TEMPORAL_PROGRAM": "TEMPORAL_STRUCTURE LAYOUT PROMPT REDUNDANCY",
}
OTHER_KINDS = "PROMPT LAYOUT REDUNDANCY PRIMITIVE"
# What a kind of change is suggested to set, and where that differs for two targets.
SUGGESTED = {
    "LAYOUT": "LOCALIZE_FAILURE_TARGET_REGION", "PROMPT": "SHORT_EXPLICIT_PROTOCOL_INSTRUCTION", "REDUNDANCY": "BOUNDED_REDUNDANT_ANCHOR", "CHANNEL_ROLE": "DEDICATED_SEMANTIC_ROUTING_ROLE",
    "PRIMITIVE": "DISTINCT_FAILURE_TARGET_PRIMITIVE", "TEMPORAL_STRUCTURE": "EXPLICIT_PHASE_EVENT_CHECKPOINT_STRUCTURE", "COLOR_USAGE": "HIGH_CONTRAST_ROLE_SEPARATION",
    "NUMERIC_STRUCTURE": "EXPERIMENTAL_ADDRESS_ORDER_SIGNAL", "INTERFERENCE_STRUCTURE": "EXPERIMENTAL_INTERFERENCE_SIGNAL", "DEPTH_STRUCTURE": "EXPERIMENTAL_DEPTH_SIGNAL",
    "EMERGENT_STRUCTURE": "EXPERIMENTAL_EMERGENT_SIGNAL",
}
SUGGESTED_FOR = {
    ("T2_NAVIGATION", "LAYOUT"): ("T1_TO_T2_ENTRY_ROUTE", "EXPLICIT_DIRECTIONAL_ANCHOR"), ("ROSETTA_TO_T2_ROUTE", "LAYOUT"): ("T1_TO_T2_ENTRY_ROUTE", "EXPLICIT_DIRECTIONAL_ANCHOR"),
    ("T2_NAVIGATION", "PROMPT"): ("ROSETTA.S2.READ_SUPERINDEX", "DECLARE_T2_LOCATION_BEFORE_DECODE"), ("ROSETTA_TO_T2_ROUTE", "PROMPT"): ("ROSETTA.S2.READ_SUPERINDEX", "DECLARE_T2_LOCATION_BEFORE_DECODE"),
    ("T2_NAVIGATION", "REDUNDANCY"): ("T2_ENTRY_MARKER", "REPEAT_AT_BOOT_AND_ROSETTA"),
}
NO_TARGET = "GENERAL_EXPLORATION"
#: Patterns that a plan looks at, changes that it suggests, and how far outcomes may move a kind's weight.
FOCUS, SUGGESTIONS, SWING = 5, 4, 0.25
KIND_WEIGHTS = (1.0, 0.8, 0.6, 0.4)
ALL_KINDS = "PROMPT CHANNEL_ROLE PRIMITIVE LAYOUT REDUNDANCY COLOR_USAGE NUMERIC_STRUCTURE INTERFERENCE_STRUCTURE DEPTH_STRUCTURE TEMPORAL_STRUCTURE EMERGENT_STRUCTURE".split()
EXPLORE = 0.15


def real_failures(ledger: DataFrame) -> DataFrame:
    """Observations of real models that did not pass; an unknown outcome is no failure here."""
    return ledger.where("kind = 'OBSERVATION' AND evidence_class = 'REAL_MODEL' AND pass = false")


def summary(ledger: DataFrame) -> DataFrame:
    """The ledger's counters; an observation of unknown outcome counts as failed."""
    seen = F.col("kind") == "OBSERVATION"
    failed = seen & ~F.coalesce("pass", F.lit(False))
    return ledger.agg(
        F.count("*").alias("events"), F.count_if(seen).alias("observations"), F.count_if(F.col("kind") == "CHANGE").alias("changes"), F.count_if(F.col("kind") == "OUTCOME").alias("outcomes"),
        F.count_if(failed).alias("failures"), F.count_if(seen & (F.col("evidence_class") == "REAL_MODEL")).alias("real"), F.count_if(seen & (F.col("evidence_class") == "SYNTHETIC")).alias("synthetic"),
        F.count_distinct("model_id").alias("models"),
    )


def patterned(failures: DataFrame) -> DataFrame:
    """With the defaults that a pattern's key uses for what isn't known."""
    known = lambda c, default: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(default))
    return failures.withColumns({"stage_": known("stage", UNKNOWN_STAGE), "code_": known("failure_code", UNKNOWN_CODE), "layer_": known("layer", UNKNOWN_LAYER)})


def listed(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def failure_patterns(failures: DataFrame) -> DataFrame:
    """One row for each (stage, code, layer): how often, and on which models, specimens and questions; the most frequent first."""
    return patterned(failures).groupBy(F.col("stage_").alias("stage"), F.col("code_").alias("code"), F.col("layer_").alias("layer")).agg(
        F.count("*").alias("n"), listed("model_id").alias("models"), listed("specimen_id").alias("specimens"), listed("question_id").alias("questions"),
        F.count_distinct("model_id").alias("n_models"), F.count_distinct("specimen_id").alias("n_specimens"),
    )


def target(code: Column, stage: Column) -> Column:
    """What to work on: by the code, else by the stage."""
    out = F.lit(OTHER_TARGET)
    for mapping, key in ((STAGE_TARGET, stage), (CODE_TARGET, code)):
        for name, value in mapping.items():
            out = F.when(F.upper(key) == name, value).otherwise(out)
    return out


def outcomes(ledger: DataFrame) -> DataFrame:
    """(candidate_id, n, mean, best, worst) of the outcomes' deltas; a missing delta is after less before."""
    d = F.coalesce("delta", F.col("score_after") - F.col("score_before"))
    own = ledger.where("kind = 'OUTCOME'").groupBy("candidate_id").agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.max(d).alias("best"), F.min(d).alias("worst"))
    return own.select("candidate_id", "n", *[F.round(c, 9).alias(c) for c in ("mean", "best", "worst")])


def profiles(ledger: DataFrame) -> DataFrame:
    """(profile, case_key, pass): repeated observations of a case as one, failed if any failed; unknown outcomes left out."""
    known = ledger.where("kind = 'OBSERVATION' AND pass IS NOT NULL")
    return known.groupBy(F.concat_ws("/", "model_id", "condition").alias("profile"), "case_key").agg(F.bool_and("pass").alias("pass"))


def accuracy(profile: DataFrame) -> DataFrame:
    return profile.groupBy("profile").agg(F.count("*").alias("cases"), F.count_if("pass").alias("passes"), F.count_if(~F.col("pass")).alias("failures"), F.round(F.avg(F.col("pass").cast("double")), 6).alias("accuracy"))


def pairwise(profile: DataFrame) -> DataFrame:
    """Each two profiles with shared cases: how they fail together, and what one makes up for the other.

    Cases are shared by few profiles each: the pairing is by case, and its counts are summed up before they are shuffled.
    """
    a = profile.select("case_key", F.col("profile").alias("a"), F.col("pass").alias("pa"))
    b = profile.select("case_key", F.col("profile").alias("b"), F.col("pass").alias("pb"))
    both = a.join(b, "case_key").where("a < b")
    pa, pb = F.col("pa"), F.col("pb")
    n = both.groupBy("a", "b").agg(
        F.count("*").alias("shared"), F.count_if(pa & pb).alias("both_pass"), F.count_if(~pa & ~pb).alias("both_fail"), F.count_if(~pa & pb).alias("a_recovered"), F.count_if(pa & ~pb).alias("b_recovered"),
    )
    union = F.col("both_fail") + F.col("a_recovered") + F.col("b_recovered")
    return n.select(
        "*", union.alias("failure_union"), F.round(ratio(F.col("both_fail"), union), 6).alias("overlap"),
        F.round(ratio(F.col("a_recovered") + F.col("b_recovered"), union), 6).alias("complementarity"), F.round(ratio(F.col("shared") - F.col("both_fail"), F.col("shared")), 6).alias("oracle"),
    )


def kind_table(spark: SparkSession) -> DataFrame:
    """(target, mutation, weight, place): the kinds of change that suit each target."""
    targets = dict.fromkeys([*CODE_TARGET.values(), *STAGE_TARGET.values(), OTHER_TARGET])
    rows = [(t, k, w, i + 1) for t in targets for i, (k, w) in enumerate(zip(TARGET_KINDS.get(t, OTHER_KINDS).split(), KIND_WEIGHTS, strict=False))]
    return spark.createDataFrame(rows, "target string, mutation string, weight double, place int")


def focus(failures: DataFrame, most: int = FOCUS) -> DataFrame:
    """The most frequent patterns, ties by key, each with its target: what a plan looks at."""
    p = failure_patterns(failures).withColumns({"pattern": F.concat_ws("|", "stage", "code", "layer"), "target": target(F.col("code"), F.col("stage"))})
    return p.orderBy(F.desc("n"), "pattern").limit(most)


def exploration_weights(failures: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(mutation, weight) of all kinds: the mass of the patterns in focus by target, made wider by models and specimens, each kind's
    moved by the outcomes (mutation, mean) of its changes so far, with a floor for every kind. Without failures all kinds weigh alike. The weights sum to 1."""
    spark = failures.sparkSession
    mass = F.col("n") * (1 + 0.1 * F.greatest(F.col("n_models") - 1, F.lit(0)) + 0.05 * F.greatest(F.col("n_specimens") - 1, F.lit(0)))
    raw = focus(failures).select("target", mass.alias("mass")).join(F.broadcast(kind_table(spark)), "target").groupBy("mutation").agg(F.sum(F.col("mass") * F.col("weight")).alias("raw"))
    every = spark.createDataFrame([(k,) for k in ALL_KINDS], "mutation string").join(raw, "mutation", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    all_ = Window.partitionBy()  # a row for each kind, eleven in all
    every = every.withColumn("raw", F.when(F.sum("raw").over(all_) > 0, F.col("raw")).otherwise(1.0))
    if history is not None:
        every = every.join(history.select("mutation", F.col("mean").alias("swing")), "mutation", "left").withColumn("raw", F.col("raw") * (1 + clamp(F.coalesce("swing", F.lit(0.0)), -SWING, SWING)))
    share = F.col("raw") / F.sum("raw").over(all_)
    return every.select("mutation", F.round((1 - EXPLORE) * share + EXPLORE / len(ALL_KINDS), 6).alias("weight"))


def suggestions(failures: DataFrame, weights: DataFrame, most: int = SUGGESTIONS) -> DataFrame:
    """(place, mutation, field, value): the kinds of most weight, and what each is to set for the target of the most frequent pattern."""
    spark = failures.sparkSession
    first = focus(failures, 1).select("target")
    rows = [(t, k, *SUGGESTED_FOR.get((t, k), (t, v))) for t in dict.fromkeys([*CODE_TARGET.values(), *STAGE_TARGET.values(), OTHER_TARGET, NO_TARGET]) for k, v in SUGGESTED.items()]
    table = spark.createDataFrame(rows, "target string, mutation string, field string, value string")
    top = weights.orderBy(F.desc("weight"), "mutation").limit(most).withColumn("place", F.row_number().over(Window.orderBy(F.desc("weight"), "mutation")))
    aim = first.agg(F.coalesce(F.max("target"), F.lit(NO_TARGET)).alias("target"))
    return top.crossJoin(aim).join(F.broadcast(table), ["target", "mutation"]).select("place", "mutation", "field", "value")


def queue(candidates: DataFrame, weights: DataFrame, limit: int | None = None) -> DataFrame:
    """(candidate_id, priority, place): the mean weight of a candidate's distinct kinds, less for each further one, not below 0."""
    kinds = candidates.select("candidate_id", "mutation").distinct().join(weights, "mutation").groupBy("candidate_id").agg(F.avg("weight").alias("mean"))
    many = candidates.groupBy("candidate_id").agg(F.count("*").alias("mutations"))
    scored = kinds.join(many, "candidate_id").select("candidate_id", F.round(F.greatest(F.lit(0.0), F.col("mean") - 0.02 * (F.col("mutations") - 1)), 6).alias("priority"))
    out = placed(scored, F.desc("priority"), "candidate_id")
    return out.where(F.col("place") <= limit) if limit else out


def historical_signals(ledger: DataFrame) -> DataFrame:
    """(mutation, n, mean): the outcomes' deltas by the kinds of change that were tried on their candidates."""
    tried = ledger.where("kind = 'CHANGE'").select("candidate_id", "mutation").distinct()
    d = F.coalesce("delta", F.col("score_after") - F.col("score_before"))
    own = ledger.where("kind = 'OUTCOME'").select("candidate_id", d.alias("d"))
    return own.join(tried, "candidate_id").groupBy("mutation").agg(F.count("*").alias("n"), F.round(F.avg("d"), 9).alias("mean"))


def parents(failures: DataFrame, most: int = 20) -> DataFrame:
    """(stage, code, layer, parents): the least ids of the events of each pattern, few of them, kept as it goes."""
    p = patterned(failures)
    order = Window.partitionBy("stage_", "code_", "layer_").orderBy("event_id")
    few = p.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return few.groupBy(F.col("stage_").alias("stage"), F.col("code_").alias("code"), F.col("layer_").alias("layer")).agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("parents"))


def policy(ledger: DataFrame) -> DataFrame:
    """(action, target, confidence, n, mean): keep what helped, avoid what hurt; sure from nine outcomes on, fairly from three."""
    s = historical_signals(ledger).where("mean <> 0")
    sure = F.when(F.col("n") >= 9, "HIGH").when(F.col("n") >= 3, "MEDIUM").otherwise("LOW")
    return s.select(F.when(F.col("mean") > 0, "PRESERVE").otherwise("AVOID").alias("action"), F.col("mutation").alias("target"), sure.alias("confidence"), "n", "mean")


def planning_view(ledger: DataFrame, runs: list[str]) -> DataFrame:
    """Observations of the given runs, and all events of other kinds."""
    seen = F.col("kind") == "OBSERVATION"
    return ledger.where(~seen | F.col("run_id").isin(runs))


def error_code(ledger: DataFrame) -> DataFrame:
    """ledger with error: the first field that its kind requires and it lacks."""
    k = F.col("kind")
    return ledger.withColumn(
        "error",
        F.when(k.isNull(), "MISSING_KIND").when((k == "OBSERVATION") & F.col("pass").isNull(), "MISSING_PASS").when((k == "OBSERVATION") & F.col("stage").isNull(), "MISSING_STAGE")
        .when((k == "CHANGE") & F.col("mutation").isNull(), "MISSING_CHANGE").when((k == "OUTCOME") & (F.col("score_before").isNull() | F.col("score_after").isNull()), "MISSING_SCORES"),
    )


def model_class(model: Column) -> Column:
    """placeholder, synthetic or real, by an id's beginning."""
    m = F.upper(F.trim(model))
    return F.when((m == "") | m.startswith("REPLACE_WITH"), "PLACEHOLDER").when(m.startswith("SYNTHETIC") | m.startswith("FAKE") | m.startswith("TEST"), "SYNTHETIC").otherwise("REAL")
