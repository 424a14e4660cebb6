"""Layered benchmark scores, calibration, confusion and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.numeric import in_order, nearest_rank, ratio
from quarryline.functions.text import has_groups, has_tokens, question_class, upper_tokens_text
from quarryline.plans.inputs import STAGES

# The questions, their layers and what an answer must hold.
LAYER = {"Q0": "R", "Q1": "P", "Q2": "P", "Q3": "S", "Q4": "T", "Q5": "T", "Q6": "R", "Q7": "T", "Q8": "X"}
NEEDED = {"Q1": "A B C", "Q2": "A ACTIVE", "Q3": "A ACTIVE B", "Q4": "A DONE C ACTIVE", "Q5": "T0 T2 T4", "Q7": "A DONE B DONE C ACTIVE"}
Q0_GROUPS = [["BOX"], ["CELL"], ["ARROW"], ["TRANSITION"], ["RING"], ["CHECKPOINT"], ["TIME", "TEMPORAL"]]
HONEST = "UNKNOWN|NOT VERIFIED|NOT_VERIFIED|CANNOT VERIFY|NO EXACT DECODER"


def passed(question: Column, answer: Column) -> Column:
    """Whether an answer meets its question's rule; a missing answer does not."""
    n = upper_tokens_text(answer)
    rules = {q: has_tokens(answer, need.split()) for q, need in NEEDED.items()}
    rules["Q0"] = has_groups(answer, Q0_GROUPS)
    rules["Q6"] = F.contains(n, F.lit("NO")) & F.contains(n, F.lit("LITERAL")) & (F.contains(n, F.lit("VIDEO")) | F.contains(n, F.lit("FRAME")))
    rules["Q8"] = ~answer.rlike(r"(?i)\b[0-9a-f]{64}\b") & n.rlike(HONEST)
    out = F.lit(False)
    for q, rule in rules.items():
        out = F.when(question == q, rule).otherwise(out)
    return F.coalesce(out, F.lit(False))


def definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LAYER.items()), "question string, layer string")


def evaluated(trials: DataFrame, responses: DataFrame) -> DataFrame:
    """(trial, question, layer, pass) of every expected question of each trial; the last response to a question counts.

    The nine definitions go to every executor: a fixed table.
    """
    last = responses.groupBy("trial", "question").agg(F.max_by("answer", "pos").alias("answer"))
    asked = trials.crossJoin(F.broadcast(definitions(trials.sparkSession)))
    return asked.join(last, ["trial", "question"], "left").select("trial", "question", "layer", passed(F.col("question"), F.col("answer")).alias("pass"))


def layer_scores(results: DataFrame) -> DataFrame:
    """(trial, layer, passed, total, score)."""
    return results.groupBy("trial", "layer").agg(F.count_if("pass").alias("passed"), F.count("*").alias("total"), F.round(F.avg(F.col("pass").cast("double")), 6).alias("score"))


def overall(results: DataFrame) -> DataFrame:
    """(trial, overall, mean_of_layers): the mean of the layers' ratios is not that of the rows."""
    layers = results.groupBy("trial", "layer").agg(F.avg(F.col("pass").cast("double")).alias("score"))
    rows = results.groupBy("trial").agg(F.round(F.avg(F.col("pass").cast("double")), 6).alias("overall"))
    return rows.join(layers.groupBy("trial").agg(F.round(F.avg("score"), 6).alias("mean_of_layers")), "trial")


def condition_pivot(ledger: DataFrame) -> DataFrame:
    """(model_id, specimen_id, native, assisted, degraded, gain): the last score under each condition, 0 if there is none."""
    own = ledger.where("kind = 'OBSERVATION'").groupBy("model_id", "specimen_id")
    last = [F.round(F.coalesce(F.max_by(F.when(F.col("condition") == c, F.col("score")), F.when(F.col("condition") == c, F.col("event_id"))), F.lit(0.0)), 6).alias(c.lower()) for c in ("NATIVE", "ASSISTED", "DEGRADED")]
    return own.agg(*last).withColumn("gain", F.round(F.col("assisted") - F.col("native"), 6))


def frontier(debug: DataFrame) -> DataFrame:
    """One row for each model: reports, how many are consistent, the dominant stage (ties: the first by name), the earliest and the furthest."""
    rank = in_order(F.col("stage"), STAGES)
    known = debug.where(rank >= 0).withColumn("rank", rank)
    return known.groupBy("model_id").agg(
        F.count("*").alias("reports"), F.round(F.avg(F.coalesce("pass", F.lit(False)).cast("double")), 6).alias("consistency"), F.mode("stage", True).alias("dominant"),
        F.min_by("stage", "rank").alias("earliest"), F.max_by("stage", "rank").alias("furthest"), F.mode("failure_code", True).alias("code"),
    )


def calibration(predictions: DataFrame) -> DataFrame:
    """(slice, n, covered, coverage, accuracy, brier): an abstention counts in the coverage only."""
    ok = F.col("correct").cast("double")
    answered = ~F.col("abstained")
    return predictions.groupBy("slice").agg(
        F.count("*").alias("n"), F.count_if(answered).alias("covered"), F.round(F.avg(answered.cast("double")), 6).alias("coverage"),
        F.round(F.coalesce(F.avg(F.when(answered, ok)), F.lit(0.0)), 6).alias("accuracy"), F.round(F.coalesce(F.avg(F.when(answered, F.pow(F.col("confidence") - ok, F.lit(2)))), F.lit(0.0)), 6).alias("brier"),
    )


def calibration_error(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """(slice, ece): the bins' gaps of confidence and accuracy, weighted by their rows."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)))
    own = predictions.groupBy("slice", b.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("confidence") - F.avg(F.col("correct").cast("double"))).alias("gap"))
    return own.groupBy("slice").agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def abstention_curve(predictions: DataFrame, thresholds: list[float]) -> DataFrame:
    """(slice, threshold, coverage, accuracy) of what is answered at or above each of a few thresholds, in one pass."""
    ok = F.col("correct").cast("double")
    parts = [F.struct(F.lit(t).alias("threshold"), F.avg((F.col("confidence") >= t).cast("double")).alias("coverage"), F.coalesce(F.avg(F.when(F.col("confidence") >= t, ok)), F.lit(0.0)).alias("accuracy")) for t in thresholds]
    rows = predictions.groupBy("slice").agg(F.array(*parts).alias("curve"))
    return rows.select("slice", F.inline("curve")).select("slice", "threshold", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))


def confidence_floor(curve: DataFrame, wanted: float) -> DataFrame:
    """(slice, floor): the first threshold of the wanted accuracy, 1.01, which admits nothing, if none has it."""
    return curve.groupBy("slice").agg(F.coalesce(F.min(F.when(F.col("accuracy") >= wanted, F.col("threshold"))), F.lit(1.01)).alias("floor"))


def confusion(pairs: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """Counts, precision, recall and coverage; an unknown guess covers nothing."""
    counts = pairs.agg(
        F.count("*").alias("n"), F.count_if(guess.isNotNull()).alias("covered"), F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"),
    )
    tp = F.col("tp")
    return counts.select("*", *[F.round(ratio(a, b), 6).alias(n) for n, a, b in (("coverage", F.col("covered"), F.col("n")), ("precision", tp, tp + F.col("fp")), ("recall", tp, tp + F.col("fn")))])


def percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, p50, p95, total) by the nearest rank above. Equal values are counted together before they are put in order."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    run = F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(key, value, "c", run.alias("upto"), F.sum("c").over(w).alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.floor((F.col("n") - 1) * F.lit(q) + F.lit(0.999999)) + 1, F.col(value)))
    return ranked.groupBy(key).agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.round(F.sum(F.col(value) * F.col("c")), 4).alias("total"))


def percentile_of(values: Column, q: float) -> Column:
    return nearest_rank(values, q)


def capacity(runs: DataFrame) -> DataFrame:
    """(population, capacity): the most parallel setting at which all runs are useful."""
    useful = runs.groupBy("population", "parallelism").agg(F.bool_and("useful").alias("all_useful"))
    return useful.groupBy("population").agg(F.coalesce(F.max(F.when(F.col("all_useful"), F.col("parallelism"))), F.lit(0)).cast("long").alias("capacity"), F.count("*").alias("settings"))


def regression_report(pairs: DataFrame) -> DataFrame:
    """Mean absolute and root mean square error and correlation of (expected, got), overall and by family."""
    err = F.col("got") - F.col("expected")
    return pairs.groupBy("family").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(err)), 6).alias("mae"), F.round(F.sqrt(F.avg(err * err)), 6).alias("rmse"), F.round(F.corr("expected", "got"), 6).alias("r"),
        F.round(F.avg("got"), 6).alias("mean"), F.round(F.stddev_pop("got"), 6).alias("std"),
    )


#: The least raw confidence of a model that was never calibrated.
LEAST_CONFIDENCE = 0.7


def classified(questions: DataFrame) -> DataFrame:
    """(…, class, confidence, method, model_verdict, model_rejected) of rows (question, model_class, model_confidence, calibration).

    The model's class is taken if it answered and is trusted: by its calibration's verdict, or without one by its raw confidence. Otherwise the
    rules decide. What the model said and why it was passed over stays beside the result. A null model_class is a model that didn't answer;
    a null calibration is none.
    """
    model, sure, verdict = F.col("model_class"), F.col("model_confidence"), F.col("calibration")
    rejected = (
        F.when(model.isNull(), "unreachable").when(verdict.isNotNull() & (verdict != "ANSWERED"), F.concat(F.lit("calibration:"), verdict))
        .when(verdict.isNull() & (F.coalesce(sure, F.lit(0.0)) < LEAST_CONFIDENCE), "uncalibrated-low-confidence")
    )
    rule = question_class(F.col("question"))
    own = questions.withColumns({"model_rejected": rejected, "rule": rule})
    taken = F.col("model_rejected").isNull()
    return own.withColumns({
        "class": F.when(taken, model).otherwise(F.col("rule")), "confidence": F.when(taken, sure).otherwise(F.when(F.col("rule") == "general", 0.3).otherwise(0.8)),
        "method": F.when(taken, "model").otherwise("rules"), "model_verdict": model,
    }).drop("rule", "model_class", "model_confidence", "calibration")


def calibration_verdict(predictions: DataFrame, denied: list[str], allowed: list[str], least: float) -> DataFrame:
    """predictions (domain, confidence, slice) with verdict, by the first rule that applies: a denied domain, one not allowed, too little confidence, out of distribution."""
    d = F.lower(F.trim("domain"))
    verdict = F.when(d.isin(denied) | ~d.isin(allowed), "UNSUPPORTED").when(F.col("confidence") < least, "LOW_EVIDENCE").when(F.col("slice") == "out", "UNKNOWN").otherwise("ANSWERED")
    return predictions.withColumn("verdict", verdict)


def admission(predictions: DataFrame, bins: int = 10, least_rows: int = 100, most_error: float = 0.10, least_accuracy: float = 0.8) -> DataFrame:
    """(domain, reasons): all that keeps a model from being admitted: too few rows out of distribution, its calibration error inside, its accuracy outside."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)))
    own = predictions.groupBy("domain", "slice", b.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("confidence") - F.avg(F.col("correct").cast("double"))).alias("gap"), F.count_if("correct").alias("ok"))
    inside, out = F.col("slice") == "in", F.col("slice") == "out"
    m = own.groupBy("domain").agg(
        (F.sum(F.when(inside, F.col("n") * F.col("gap"))) / F.sum(F.when(inside, F.col("n")))).alias("ece"), F.sum(F.when(out, F.col("n"))).alias("n_out"),
        (F.sum(F.when(out, F.col("ok"))) / F.sum(F.when(out, F.col("n")))).alias("acc"),
    )
    n = F.col("n_out")
    reasons = [F.when(n < least_rows, "OOD_TOO_SMALL"), F.when(F.col("ece") > most_error, "ECE_ABOVE_CEILING"), F.when((n >= least_rows) & (F.col("acc") < least_accuracy), "OOD_ACCURACY_BELOW_FLOOR")]
    return m.select("domain", F.concat_ws(",", *reasons).alias("reasons"))
