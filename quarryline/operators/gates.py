"""Weighted scores, gates, rankings, parity checks and greedy selection over candidates and workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.numeric import clamp, higher_is_better, lower_is_better
from quarryline.operators.ordering import placed

# The terms of the tournament's score with their weights, and of the receivers' fitness.
SCORE_RATES = {"roundtrip": 0.15, "boot": 0.09, "index_rate": 0.14, "answer_rate": 0.10, "routing": 0.08, "evidence": 0.08, "transport": 0.05, "context": 0.05}
SCORE_DENSITY, SCORE_LOWER = 0.10, {"recognition_ms": 0.06, "bootstrap_steps": 0.05, "decode_steps": 0.05}
FITNESS = {"bootstrap": 0.15, "rosetta": 0.15, "navigation": 0.15, "correctness": 0.25, "evidence": 0.15, "unknown": 0.15}


def weighted_score(base: dict[str, float]) -> Column:
    """The score of a row's metrics against those of a baseline."""
    out = F.lit(0.0)
    for name, w in SCORE_RATES.items():
        out = out + w * clamp(F.col(name))
    out = out + SCORE_DENSITY * F.when((F.col("units") > 0) & (F.col("bytes") > 0), higher_is_better(F.col("units") / F.col("bytes"), F.lit(base["units"] / base["bytes"]))).otherwise(0.5)
    for name, w in SCORE_LOWER.items():
        out = out + w * lower_is_better(F.col(name), F.lit(base[name]))
    return out


def gates(policy: dict[str, float]) -> Column:
    """All gates of a candidate: an array of (name, pass)."""
    c = F.col
    rules = [
        ("SEMANTIC_ROUNDTRIP", c("roundtrip") >= policy["roundtrip"]), ("NATIVE_INDEX", c("index_rate") >= policy["index_rate"]), ("NATIVE_ANSWER", c("answer_rate") >= policy["answer_rate"]),
        ("VERIFIED_EVIDENCE", c("evidence") >= policy["evidence"]), ("ROUTING", c("routing") >= policy["routing"]), ("CARRIER_SIZE", (c("bytes") > 0) & (c("bytes") <= policy["bytes"])),
        ("TRIALS", c("trials") >= policy["trials"]), ("FALSE_EXACT_ZERO", c("false_exact") == 0),
    ]
    return F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(ok, F.lit(False)).alias("pass")) for n, ok in rules])


def tournament(candidates: DataFrame, base: dict[str, float], policy: dict[str, float]) -> DataFrame:
    """(candidate_id, score, failed, eligible, place): the eligible first, then by score, then by id."""
    own = candidates.select("candidate_id", F.round(weighted_score(base), 6).alias("score"), gates(policy).alias("gates"))
    failed = F.array_join(F.transform(F.filter("gates", lambda g: ~g["pass"]), lambda g: g["name"]), ",")
    own = own.select("candidate_id", "score", failed.alias("failed"), F.forall("gates", lambda g: g["pass"]).alias("eligible"))
    return placed(own, F.desc("eligible"), F.desc("score"), "candidate_id")


def fitness(window: int) -> tuple[Column, Column]:
    """A receiver's score and the first gate it fails, null if none."""
    rates = [F.col(n) for n in FITNESS]
    bad = F.lit(False)
    for r in rates:
        bad = bad | (r < 0) | (r > 1)
    reason = F.when(F.col("contaminated"), "CONTAMINATED").when(F.col("false_exact") != 0, "FALSE_EXACT").when(F.col("peak_tokens") > window, "BUDGET").when(bad, "RATE_RANGE")
    total = F.lit(0.0)
    for n, w in FITNESS.items():
        total = total + w * F.col(n)
    return F.when(reason.isNull(), total - 0.001 * F.greatest(F.col("tool_cost"), F.lit(0.0))).otherwise(0.0), reason


def worker_rank(workers: DataFrame, capability: str, scope: str, domain: str, most_params: int) -> DataFrame:
    """Eligible workers, best first: by an additive score, workers without parameters, then fewer parameters, then by id."""
    ok = (F.col("capability") == capability) & (F.col("params") <= most_params) & F.col("scope").isin(scope, "ANY") & F.col("domain").isin(domain, "GENERAL")
    score = 100 * (F.col("scope") == scope).cast("int") + 50 * (F.col("domain") == domain).cast("int") + 25 * (F.col("params") == 0).cast("int") + 10 * (F.col("engine") == "RULES").cast("int")
    own = workers.where(ok).withColumn("score", score)
    return placed(own.select("worker_id", "score", "params"), F.desc("score"), F.col("params") != 0, "params", "worker_id")


def parity(expected: DataFrame, actual: DataFrame, declared: DataFrame) -> DataFrame:
    """(key, expected, actual, state) of tables (key, value): declared differences are changes, others drift; absent is an empty value."""
    e = expected.select("key", F.col("value").alias("e"))
    a = actual.select("key", F.col("value").alias("a"))
    d = declared.select("key", F.col("value").alias("d"), F.lit(True).alias("is_declared"))
    j = e.join(a, "key", "full_outer").join(d, "key", "full_outer")
    blank = lambda c: F.coalesce(c, F.lit(""))
    state = F.when(blank("e") == blank("a"), F.when(F.coalesce("is_declared", F.lit(False)), "DECLARED_UNCHANGED").otherwise("SAME")).when(F.coalesce("is_declared", F.lit(False)) & (blank("d") == blank("a")), "DECLARED").otherwise("DRIFT")
    return j.select("key", blank("e").alias("expected"), blank("a").alias("actual"), state.alias("state"))


def monitored(runs: DataFrame, retire_above: float, least: int = 5) -> DataFrame:
    """(model_id, phase) of runs (model_id, pass, score): RETIRED by one score above what is honest, DEGRADED by more failures than successes in `least` runs or more, else ACTIVE."""
    c = runs.groupBy("model_id").agg(F.count("*").alias("runs"), F.count_if(~F.col("pass")).alias("failures"), F.count_if("pass").alias("recoveries"), F.max("score").alias("top"))
    phase = F.when(F.col("top") > retire_above, "RETIRED").when((F.col("runs") >= least) & (F.col("failures") > F.col("recoveries")), "DEGRADED").otherwise("ACTIVE")
    return c.select("model_id", phase.alias("phase"))


def panel(required: DataFrame, trials: DataFrame) -> DataFrame:
    """(model, passes, runs, ok): a required model without a trial fails."""
    own = trials.groupBy("model").agg(F.count_if("pass").alias("passes"), F.count("*").alias("runs"))
    j = required.select("model").distinct().join(own, "model", "left")
    return j.select("model", F.coalesce("passes", F.lit(0)).alias("passes"), F.coalesce("runs", F.lit(0)).alias("runs"), (F.coalesce("passes", F.lit(0)) * 2 > F.coalesce("runs", F.lit(0))).alias("ok"))


def ensemble(quality: DataFrame, pairs: DataFrame, k: int, w_quality: float = 0.6, w_pair: float = 0.4) -> list[str]:
    """k members picked one at a time: each has the best sum of quality and mean complementarity with those picked; ties by id."""
    picked: list[str] = []
    for _ in range(k):
        near = pairs.where(F.col("a").isin(picked)).select(F.col("b").alias("member"), "c").unionAll(pairs.where(F.col("b").isin(picked)).select(F.col("a").alias("member"), "c"))
        mean = near.groupBy("member").agg(F.avg("c").alias("c"))
        score = w_quality * F.col("q") + w_pair * F.coalesce("c", F.lit(0.0))
        best = quality.where(~F.col("member").isin(picked)).join(mean, "member", "left").orderBy(F.desc(F.round(score, 9)), "member").select("member").first()
        if best is None:
            break
        picked.append(best["member"])
    return picked
