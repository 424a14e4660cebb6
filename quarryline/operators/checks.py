"""Structural checks, verdict folding, policy compilation, debug traces, layout text, packing and recorded loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.ledger import exploration_weights, queue, real_failures
from quarryline.plans.inputs import STAGES
from quarryline.sources.shared import written

# The vocabularies of debug traces, and how their footer begins.
STATUSES = ["PASS", "FAIL", "UNKNOWN", "NOT_VERIFIED", "CAPABILITY_MISMATCH"]
FAILURES = [
    "NONE", "NO_VISUAL_SIGNAL", "BOOT_NOT_FOUND", "ROSETTA_NOT_FOUND", "CODEC_NOT_FOUND", "CAPABILITY_MISMATCH", "T2_NOT_FOUND", "SEMANTIC_EVIDENCE_INSUFFICIENT",
    "TEMPORAL_RULE_AMBIGUOUS", "CHECKPOINT_NOT_FOUND", "EXACT_DECODER_REQUIRED", "UNSUPPORTED_OPERATION", "OTHER",
]
MARKER = "DEBUG_TRACE_R0="
TRACE = "schema string, status string, last_completed_stage string, failure_code string, confidence double"


def structural(rows: DataFrame) -> DataFrame:
    """(id, check, ok) of rows (id, body, hash, value, kind, needs, has): valid JSON, a hash prefix, required fields, range, one-of, dependencies."""
    c = F.col
    rules = [
        ("JSON_VALID", F.try_parse_json("body").isNotNull()), ("HASH_MATCHES", F.sha2("body", 256).startswith(c("hash"))), ("REQUIRED_FIELDS", F.get_json_object("body", "$.k").isNotNull()),
        ("IN_RANGE", c("value").between(0.0, 1.0)), ("ONE_OF", c("kind").isin("A", "B", "C")), ("DEPENDENCIES", F.size(F.array_except("needs", "has")) == 0),
    ]
    return rows.select("id", F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, ok in rules])))


def folded(checks: DataFrame) -> DataFrame:
    """(id, verdict, failed): VERIFIED if all checks hold, UNVERIFIED if one fails, INCONCLUSIVE without any; null is a check not run."""
    own = checks.groupBy("id").agg(F.count("ok").alias("n"), F.bool_and("ok").alias("all"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("check")))), ",").alias("failed"))
    return own.select("id", F.when(F.col("n") == 0, "INCONCLUSIVE").when(F.col("all"), "VERIFIED").otherwise("UNVERIFIED").alias("verdict"), "failed")


def parse_debug(text: Column) -> tuple[Column, Column]:
    """An answer without its debug footer, and the footer as a struct: what follows the last marker, with or without a code fence."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    raw = strip(F.substring_index(text, MARKER, -1))
    raw = strip(F.regexp_replace(F.regexp_replace(raw, r"(?s)^```(json)?", ""), r"(?s)```.*$", ""))
    has = F.contains(text, F.lit(MARKER))
    cut = F.length(text) - F.length(F.substring_index(text, MARKER, -1)) - len(MARKER)
    answer = F.when(has, strip(F.left(text, F.greatest(cut, F.lit(0))))).otherwise(text)
    return answer, F.when(has, F.from_json(raw, TRACE))


def debug_violations(trace: Column) -> Column:
    """What a footer breaks: vocabularies, consistency of status and code, the range of its confidence."""
    rules = [
        ("STATUS", ~trace["status"].isin(STATUSES)), ("STAGE", ~trace["last_completed_stage"].isin("NONE", *STAGES)), ("CODE", ~trace["failure_code"].isin(FAILURES)),
        ("PASS_WITH_CODE", (trace["status"] == "PASS") & (trace["failure_code"] != "NONE")), ("FAIL_WITHOUT_CODE", (trace["status"] == "FAIL") & (trace["failure_code"] == "NONE")),
        ("CONFIDENCE", ~trace["confidence"].between(0.0, 1.0)),
    ]
    return F.concat_ws(",", *[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules])


def authorised(actions: DataFrame, catalog: DataFrame, ceiling: int, prefix: str) -> DataFrame:
    """(action_id, reasons): why a policy refuses an action: unknown capability, too risky, missing or undeclared arguments, a path outside."""
    j = actions.join(catalog, "capability", "left")  # a catalogue goes out whole only if Spark finds it small
    known = F.col("risk").isNotNull()
    rules = [
        ("UNKNOWN_CAPABILITY", ~known), ("RISK_ABOVE_CEILING", F.col("risk") > ceiling), ("MISSING_ARGUMENT", known & (F.size(F.array_except("required", F.map_keys("args"))) > 0)),
        ("UNDECLARED_ARGUMENT", known & (F.size(F.array_except(F.map_keys("args"), F.array_union("required", "optional"))) > 0)),
        ("PATH_OUTSIDE", F.col("args")["path"].isNotNull() & ~F.col("args")["path"].startswith(prefix)),
    ]
    return j.select("action_id", F.concat_ws(",", *[F.when(bad, name) for name, bad in rules]).alias("reasons"))


def rolled_back(actions: DataFrame) -> DataFrame:
    """The inverse of a move: its two paths exchanged."""
    a = F.col("args")
    return actions.where("capability = 'MOVE'").select("action_id", F.map_concat(F.map_filter("args", lambda k, v: ~k.isin("from", "to")), F.create_map(F.lit("from"), a["to"], F.lit("to"), a["from"])).alias("args"))


def module_packing(modules: DataFrame, budget: int) -> DataFrame:
    """(pack, chosen, used) of modules (pack, module, priority, required, full, small): in order of priority, each in full if it fits, else small,
    else left out; a required one that doesn't fit is an error named in chosen."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "module", "required", "full", "small")))
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        full, small = m["full"] <= s["left"], m["small"] <= s["left"]
        name = F.when(full, F.concat(m["module"], F.lit(":FULL"))).when(small, F.concat(m["module"], F.lit(":MIN"))).when(m["required"], F.concat(m["module"], F.lit(":ERROR")))
        return F.struct(
            F.when(full, s["left"] - m["full"]).when(small, s["left"] - m["small"]).otherwise(s["left"]).alias("left"),
            F.when(name.isNotNull(), F.array_append(s["out"], name)).otherwise(s["out"]).alias("out"),
        )

    packed = modules.groupBy("pack").agg(rows.alias("rows")).select("pack", F.aggregate("rows", start, step).alias("s"))
    return packed.select("pack", F.array_join("s.out", ",").alias("chosen"), (F.lit(budget) - F.col("s.left")).cast("long").alias("used"))


def layout_text(regions: DataFrame) -> DataFrame:
    """(page_id, text): the regions of a page (page_id, place, kind, text) in order, figures left out."""
    own = F.array_sort(F.collect_list(F.when(F.col("kind") != "figure", F.struct("place", "text"))))
    return regions.groupBy("page_id").agg(F.array_join(F.transform(own, lambda r: r["text"]), "\n").alias("text"))


def region_kind(text: Column, height: Column, page_height: Column) -> Column:
    """heading by size or capitals, caption and list by how they begin, equation by its signs, else paragraph."""
    t = F.trim(text)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    return (
        F.when((height > page_height * 0.02) | ((letters > 0) & (F.upper(t) == t) & (F.length(t) < 80)), "heading").when(t.rlike(r"^(Figure|Fig\.|Table) "), "caption")
        .when(t.rlike(r"^([-*•]|[0-9]+[.)]) "), "list").when(F.contains(t, F.lit("=")) & (F.length(t) < 120), "equation").otherwise("paragraph")
    )


def closed_loop(trials: DataFrame, changes: DataFrame, baseline: str, generations: int, per_generation: int = 2, least: float = 0.01) -> list[dict]:
    """A recorded loop replayed, generation by generation: plan, queue, test, gate, advance.

    trials are ledger observations with candidate_id and score, changes are (candidate_id, mutation). A generation looks at the incumbent's
    failures, weighs the kinds of change by them and by the outcomes so far, queues untested candidates by those weights and tests the first
    few. One advances if no question's mean falls and the mean of all rises by `least`; the best of them is the next incumbent, ties by id. It
    stops when the incumbent has no trials or no failures, when nothing is left to test, or after `generations`.
    """
    spark = trials.sparkSession
    trials = written(trials, "trials")
    means = written(trials.groupBy("candidate_id", "question_id").agg(F.avg("score").alias("mean")), "means")
    scores = {r["candidate_id"]: (r["score"], r["failures"]) for r in trials.groupBy("candidate_id").agg(F.avg("score").alias("score"), F.count_if(~F.col("pass")).alias("failures")).collect()}
    bank = {r["candidate_id"] for r in changes.select("candidate_id").distinct().collect()} - {baseline}
    incumbent, tested, outcomes, log = baseline, set(), [], []
    for g in range(1, generations + 1):
        row = {"generation": g, "before": incumbent, "selected": "", "incumbent": incumbent, "event": "KEPT", "remaining": len(bank - tested - {incumbent})}
        log.append(row)
        if incumbent not in scores:
            row["event"] = "INCUMBENT_EXECUTION_UNAVAILABLE"
            break
        if not scores[incumbent][1]:
            row["event"] = "INCUMBENT_NO_ACTIVE_FAILURES"
            break
        past = spark.createDataFrame(outcomes, "candidate_id string, delta double").join(changes.select("candidate_id", "mutation").distinct(), "candidate_id")
        weights = exploration_weights(real_failures(trials.where(F.col("candidate_id") == incumbent)), past.groupBy("mutation").agg(F.avg("delta").alias("mean")))
        open_ = changes.where(~F.col("candidate_id").isin([incumbent, *tested]))
        order = [r["candidate_id"] for r in queue(open_, weights, per_generation).orderBy("place").collect()]
        if not order:
            row["event"] = "NO_ELIGIBLE_CANDIDATES"
            break
        base = means.where(F.col("candidate_id") == incumbent).select("question_id", F.col("mean").alias("base"))
        cand = means.where(F.col("candidate_id").isin(order))
        # a question that a candidate lacks has fallen
        falls = base.crossJoin(cand.select("candidate_id").distinct()).join(cand, ["candidate_id", "question_id"], "left").where(F.coalesce("mean", F.lit(-1.0)) + 1e-12 < F.col("base"))
        fallen = {r["candidate_id"] for r in falls.select("candidate_id").distinct().collect()}
        before, able = scores[incumbent][0], []
        for c in order:
            tested.add(c)
            if c in scores:
                outcomes.append((c, scores[c][0] - before))
                if c not in fallen and scores[c][0] - before >= least:
                    able.append((-scores[c][0], c))
        row["selected"] = ",".join(order)
        if able:
            incumbent = min(able)[1]
            row |= {"incumbent": incumbent, "event": "ADVANCED"}
        row["remaining"] = len(bank - tested - {incumbent})
        if not row["remaining"] or able and not scores[incumbent][1]:
            break
    return log


def loop_table(spark: SparkSession, log: list[dict]) -> DataFrame:
    names = ("generation", "before", "selected", "incumbent", "event", "remaining")
    return spark.createDataFrame([tuple(r[n] for n in names) for r in log], "generation int, before string, selected string, incumbent string, event string, remaining int")


def json_objects(text: Column) -> Column:
    """The texts of all objects in braces inside a text, from the first brace on, however deep: each from a { outside of any other to the } that closes it.

    Braces inside strings don't count, and \" doesn't end a string; quotes outside of braces are prose. A brace that is never closed hides what is behind it.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[{}\"]|[^{}\"\\]+|\\"), 0)
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("head"), F.array().cast("array<struct<head:int,size:int>>").alias("found"))

    def step(s: Column, piece: Column) -> Column:
        opens, closes = (piece == "{") & ~s["quoted"], (piece == "}") & ~s["quoted"] & (s["depth"] > 0)
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        ends = closes & (depth == 0)
        one = F.struct(s["head"].alias("head"), (s["at"] - s["head"] + 1).alias("size"))
        return F.struct(
            (s["at"] + F.length(piece)).alias("at"), depth.alias("depth"), F.when((piece == '"') & (s["depth"] > 0), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            F.when(opens & (s["depth"] == 0), s["at"]).otherwise(s["head"]).alias("head"), F.when(ends, F.array_append(s["found"], one)).otherwise(s["found"]).alias("found"),
        )

    return F.aggregate(pieces, start, step, lambda s: F.transform(s["found"], lambda f: F.substring(text, f["head"], f["size"])))


def json_object(text: Column) -> Column:
    """The first of the objects in braces inside a text that is JSON; null if there is none."""
    return F.get(F.filter(json_objects(text), lambda x: F.try_parse_json(x).isNotNull()), F.lit(0))


def json_between(text: Column) -> Column:
    """What stands from a text's first { to its last }, if that is one JSON object and nothing else; null otherwise."""
    whole = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    # the parser passes over what follows an object, so the object has to be all there is
    return F.when((F.get(json_objects(text), F.lit(0)) == whole) & F.try_parse_json(whole).isNotNull(), whole)


def structured_observation(text: Column) -> Column:
    """A model's answer as JSON: the object from its first { to its last } in canonical form; an answer that holds none, trimmed, as a JSON string."""
    return F.coalesce(F.to_json(F.try_parse_json(json_between(text))), F.concat(F.lit('"'), _escaped(F.btrim(text, F.lit(" \t\r\n"))), F.lit('"')))


def _escaped(text: Column) -> Column:
    """A text's characters as they stand in a JSON string."""
    out = text
    for raw, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def normal_evidence(text: Column) -> Column:
    """Free evidence as the sorted distinct runs of letters, digits and underscores, in capitals, with one space between."""
    runs = F.regexp_extract_all(F.upper(text), F.lit(r"[\p{L}\p{Nd}_]+"), 0)
    return F.array_join(F.array_sort(F.array_distinct(runs)), " ")


def trace_mismatch(passed: Column, question: Column, status: Column) -> Column:
    """Whether a debug trace contradicts its answer: one that passed says other than PASS (Q8 may say UNKNOWN or NOT_VERIFIED), or one that failed says PASS."""
    s = F.upper(F.trim(F.coalesce(status, F.lit(""))))
    allowed = (s == "PASS") | ((question == "Q8") & s.isin("UNKNOWN", "NOT_VERIFIED"))
    ok = F.coalesce(passed, F.lit(False))
    return (ok & ~allowed) | (~ok & (s == "PASS"))
