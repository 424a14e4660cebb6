"""Candidates evaluated by all gates of a policy against a baseline, and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.gates import weighted_score
from quarryline.operators.joins import one_to_one
from quarryline.operators.ordering import placed

# A policy's defaults, the kinds of mutation, and those of them that need a reveal rate.
DEFAULTS = {
    "bytes": 512000.0, "context_tokens": 4000.0, "roundtrip": 1.0, "index_rate": 0.95, "answer_rate": 0.90, "evidence": 0.95, "routing": 0.95, "reveal_rate": 0.95,
    "real_models": 3.0, "trials": 9.0, "improvement": 0.01,
}
KINDS = [
    "PROMPT", "CHANNEL_ROLE", "PRIMITIVE", "LAYOUT", "REDUNDANCY", "COLOR_USAGE", "NUMERIC_STRUCTURE", "INTERFERENCE_STRUCTURE", "DEPTH_STRUCTURE", "TEMPORAL_STRUCTURE",
    "EMERGENT_STRUCTURE",
]
PERCEPTUAL = ["INTERFERENCE_STRUCTURE", "DEPTH_STRUCTURE", "TEMPORAL_STRUCTURE", "EMERGENT_STRUCTURE"]

#: What must not get worse than the baseline: rates that may only rise, and counts that may only fall.
RISING = ["roundtrip", "index_rate", "answer_rate", "evidence", "routing"]
FALLING = ["mechanical_dependencies", "unverified_claims", "false_exact", "budget_violations", "unknown_violations"]


def normalised(policy: dict[str, float]) -> dict[str, float]:
    """A policy whose thresholds are all positive: a missing one, and one of none or less, is the default."""
    unknown = set(policy) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"no thresholds: {sorted(unknown)}")
    return {n: policy[n] if (policy.get(n) or 0) > 0 else d for n, d in DEFAULTS.items()}


def normalised_rows(policies: DataFrame) -> DataFrame:
    """The same for a table of policies, one a row."""
    return policies.withColumns({n: F.when(F.col(n) > 0, F.col(n)).otherwise(F.lit(d)) for n, d in DEFAULTS.items() if n in policies.columns})


def baseline_score(base: dict[str, float]) -> Column:
    """The baseline's own score: relative terms are a half of their weight."""
    return F.transform(F.array(F.struct(*[F.lit(v).alias(n) for n, v in base.items()])), lambda b: _scored(b, base))[0]


def _scored(b: Column, base: dict[str, float]) -> Column:
    from quarryline.functions.numeric import clamp, higher_is_better, lower_is_better
    from quarryline.operators.gates import SCORE_DENSITY, SCORE_LOWER, SCORE_RATES

    out = F.lit(0.0)
    for n, w in SCORE_RATES.items():
        out = out + w * clamp(b[n])
    density = F.lit(base["units"] / base["bytes"])
    out = out + SCORE_DENSITY * higher_is_better(density, density)
    for n, w in SCORE_LOWER.items():
        out = out + w * lower_is_better(b[n], F.lit(base[n]))
    return out


def gates(base: dict[str, float], policy: dict[str, float], improvement: Column) -> list[tuple[str, Column]]:
    """All seventeen gates of a row of metrics, in the order in which they are reported."""
    c, p = F.col, normalised(policy)
    steady = F.lit(True)
    for n in RISING:
        steady = steady & (c(n) >= base[n])
    for n in FALLING:
        steady = steady & (c(n) <= base[n])
    perceptual = F.size(F.array_intersect("mutations", F.array(*[F.lit(k) for k in PERCEPTUAL]))) > 0
    return [
        ("SEMANTIC_ROUNDTRIP", c("roundtrip") >= p["roundtrip"]), ("NATIVE_T2_INDEX", c("index_rate") >= p["index_rate"]), ("NATIVE_SEMANTIC_ANSWER", c("answer_rate") >= p["answer_rate"]),
        ("NO_MECHANICAL_DEPENDENCY", c("mechanical_dependencies") == 0), ("NO_UNVERIFIED_MECHANICAL_CLAIMS", c("unverified_claims") == 0), ("FALSE_EXACT_ZERO", c("false_exact") == 0),
        ("BUDGET_ZERO", c("budget_violations") == 0), ("UNKNOWN_DISCIPLINE", c("unknown_violations") == 0), ("CARRIER_SIZE", (c("bytes") > 0) & (c("bytes") <= p["bytes"])),
        ("CONTEXT_BOUND", (c("context_tokens") >= 0) & (c("context_tokens") <= p["context_tokens"])), ("VERIFIED_EVIDENCE", c("evidence") >= p["evidence"]), ("ROUTING", c("routing") >= p["routing"]),
        ("PERCEPTUAL_REVEAL", ~perceptual | (c("reveal_rate") >= p["reveal_rate"])), ("REAL_MODELS", c("real_models") >= p["real_models"]), ("TRIALS", c("trials") >= p["trials"]),
        ("CRITICAL_NON_REGRESSION", steady), ("MEASURABLE_IMPROVEMENT", improvement >= p["improvement"]),
    ]


def invalid_reason(profile: str) -> Column:
    """The first rule that a candidate (candidate_id, base_profile, mutations) breaks, null for none."""
    blank = lambda n: F.trim(F.coalesce(n, F.lit(""))) == ""
    return (
        F.when(blank("candidate_id"), "MISSING_ID").when(blank("base_profile"), "MISSING_BASE_PROFILE").when(F.col("base_profile") != profile, "BASE_PROFILE_MISMATCH")
        .when(F.coalesce(F.size("mutations"), F.lit(0)) <= 0, "NO_MUTATION").when(F.size(F.array_except("mutations", F.array(*[F.lit(k) for k in KINDS]))) > 0, "UNSUPPORTED_KIND")
    )


def evaluated(candidates: DataFrame, evidence: DataFrame, profile: str, base: dict[str, float], policy: dict[str, float]) -> DataFrame:
    """(candidate_id, score, improvement, failed, eligible, recommendation) of candidates (candidate_id, base_profile, mutations) and evidence (candidate_id, metrics).

    Each candidate has evidence once: duplicates on either side and missing evidence raise, as do candidates that break a rule; evidence of
    others is passed over. A metric that is null fails its gate.
    """
    j = one_to_one(candidates, evidence, ["candidate_id"], "candidate", "evidence", surplus=True)
    bad = invalid_reason(profile)
    j = j.where(F.when(bad.isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", bad, "candidate_id")).cast("boolean")))
    j = j.withColumn("raw", weighted_score(base)).withColumn("gain", F.col("raw") - baseline_score(base))
    checked = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(ok, F.lit(False)).alias("pass")) for n, ok in gates(base, policy, F.col("gain"))])
    own = j.select("candidate_id", F.round("raw", 6).alias("score"), F.round("gain", 6).alias("improvement"), checked.alias("gates"))
    failed = F.array_join(F.transform(F.filter("gates", lambda g: ~g["pass"]), lambda g: g["name"]), ",")
    own = own.select("candidate_id", "score", "improvement", failed.alias("failed"), F.forall("gates", lambda g: g["pass"]).alias("eligible"))
    return own.withColumn("recommendation", F.when(F.col("eligible"), "RECOMMEND_FOR_VALIDATION").otherwise("REJECT_OR_CONTINUE_EXPERIMENT"))


def ranked(evaluations: DataFrame) -> DataFrame:
    """Evaluations with their place: the eligible first, then by score, then by id. The first one has won if it is eligible."""
    return placed(evaluations, F.desc("eligible"), F.desc("score"), "candidate_id").withColumn("winner", (F.col("place") == 1) & F.col("eligible"))
