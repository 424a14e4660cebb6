"""States that spread over plans, rule systems that settle, panels that review, retries that complete, and ordered patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarryline.sources.shared import bucketed, new_path, written


class Rounds:
    """The rows that a loop finds, in one folder with a subfolder for each round: all of them are one relation, however many rounds there are."""

    def __init__(self, spark: SparkSession, name: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, new_path(spark, name), schema

    def write(self, df: DataFrame, n: int) -> None:
        df.write.option("compression", "zstd").parquet(f"{self.path}/round={n}")

    def of(self, n: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={n}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)


def spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan, node, state) of nodes (plan, node, join_kind, quorum, fails) and edges (plan, src, dst, tolerated): COMPLETED, FAILED or BLOCKED.

    A node runs once its barrier over its dependencies (ALL, ANY, or a QUORUM of them) can open, and fails if `fails`. A dependency that has FAILED or is BLOCKED counts
    against the barrier, unless its edge tolerates that; a quorum of none or less is more than half; a node whose barrier can't open any more is BLOCKED. The label only spreads, so rounds
    over the newly dead nodes end by themselves, on cycles too: what waits for itself alone isn't dead, and counts as COMPLETED.
    A round goes over the links of the newly dead alone, and over what waits: the nodes that some but not all strict dependencies have told of their death, with the
    number of these. The links stay where they are, dealt out by their source, and plans don't meet.
    """
    spark = nodes.sparkSession
    key = ["plan", "node"]
    edges = written(edges.select("plan", "src", "dst", F.coalesce("tolerated", F.lit(False)).alias("tolerated")).distinct(), "edges")
    deps = edges.groupBy("plan", F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.count_if(~F.col("tolerated")).alias("strict"))
    quorum = F.when(F.col("quorum") > 0, F.col("quorum")).otherwise(F.floor(F.col("n") / 2) + 1)
    needed = F.when(F.col("join_kind") == "ALL", F.col("n")).when(F.col("join_kind") == "ANY", F.lit(1)).otherwise(quorum)
    spare = F.when(F.col("n").isNull(), 0).otherwise(F.col("n") - needed).cast("long")  # how many may die before the barrier can't open
    plan = written(nodes.join(deps, key, "left").select(*key, F.coalesce("fails", F.lit(False)).alias("fails"), spare.alias("spare"), F.coalesce("strict", F.lit(0)).alias("strict")), "plan")
    # those that fail when they run are dead from the start, whether they come to run or not; so are those that ask for more than there is
    gone = F.col("fails") | (F.col("spare") < 0)
    links = edges.where("NOT tolerated").select("plan", "src", F.col("dst").alias("node")).join(plan.select(*key, "spare", "strict", gone.alias("gone")), key)
    links = bucketed(links, "links", "plan", "src")
    front = plan.where(gone).select("plan", F.col("node").alias("src"))
    found = Rounds(spark, "dead", links.select(*key, "spare", "strict", "gone", F.lit(1).cast("long").alias("bad"), F.lit(True).alias("newly")).schema)
    waits, n = None, 0
    while not front.isEmpty():
        told = links.join(front.hint("shuffle_hash"), ["plan", "src"]).select(*key, "spare", "strict", "gone", F.lit(1).cast("long").alias("bad"), F.lit(0).cast("long").alias("before"))
        if waits is not None:
            told = told.unionByName(waits.drop("newly").withColumn("before", F.col("bad")))
        now = told.groupBy(*key).agg(*[F.max(c).alias(c) for c in ("spare", "strict", "gone")], F.sum("bad").alias("bad"), F.max("before").alias("before"))
        # from when a barrier can't open any more; once all strict dependencies have told, nothing comes any more
        now = now.withColumn("newly", (F.col("spare") >= 0) & (F.col("bad") > F.col("spare")) & (F.col("before") <= F.col("spare")))
        found.write(now.where(F.col("newly") | (F.col("bad") < F.col("strict"))).select(*found.schema.names), n)
        waits = found.of(n).where("bad < strict")
        front, n = found.of(n).where("newly AND NOT gone").select("plan", F.col("node").alias("src")), n + 1
    blocked = plan.where("spare < 0").select(*key)
    if n:
        blocked = blocked.unionByName(found.all().where("newly").select(*key))
    j = plan.join(blocked.withColumn("blocked", F.lit(True)), key, "left")
    return j.select(*key, F.when(F.col("blocked"), "BLOCKED").when(F.col("fails"), "FAILED").otherwise("COMPLETED").alias("state"))


def run_verdicts(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """(plan, ok, failed, blocked): a run is good if each node is COMPLETED, or its own policy is TOLERATED; a blank policy is STRICT, others raise."""
    policy = F.upper(F.trim(F.coalesce("policy", F.lit(""))))
    known = F.when(policy == "", "STRICT").when(policy.isin("STRICT", "TOLERATED"), policy).otherwise(F.raise_error(F.concat(F.lit("unsupported failure policy: "), policy)))
    j = states.join(nodes.select("plan", "node", known.alias("policy")), ["plan", "node"])
    return j.groupBy("plan").agg(
        F.bool_and((F.col("state") == "COMPLETED") | (F.col("policy") == "TOLERATED")).alias("ok"), F.count_if(F.col("state") == "FAILED").alias("failed"), F.count_if(F.col("state") == "BLOCKED").alias("blocked"),
    )


def settled(cells: DataFrame, rules: DataFrame, requires: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """(key, cell, state) of all rule systems that settle, and (key, error) of those that don't.

    cells (key, cell, state), rules (key, rule, target, from_state, to_state), requires (key, rule, cell, state): a system for each key, all in one
    loop. In a step all rules of a system read its states before the step. A system ends by itself, when none of its rules fires; from then on no
    round reads it. It is given up, as an error, when two rules write different states to a cell, when a rule
    names a cell that it hasn't, when a cell is there twice, and after `most` steps.
    """
    spark = cells.sparkSession
    cells, rules, requires = (written(x, "system") for x in (cells.select("key", "cell", "state"), rules.select("key", "rule", "target", "from_state", "to_state"), requires.select("key", "rule", "cell", "state")))
    big = lambda df: df.hint("merge")  # noqa: E731  # rows of all systems: no round sends them through the driver
    twice = cells.groupBy("key", "cell").count().where("count > 1").select("key", F.lit("DUPLICATE_CELL").alias("error"))
    named = rules.select("key", F.col("target").alias("cell")).union(requires.select("key", "cell"))
    unknown = named.join(big(cells), ["key", "cell"], "left_anti").select("key", F.lit("UNKNOWN_CELL").alias("error"))
    wrong = twice.union(unknown).groupBy("key").agg(F.min("error").alias("error"))
    errors, done = Rounds(spark, "errors", wrong.schema), Rounds(spark, "settled", cells.schema)
    errors.write(wrong, 0)
    now = written(cells.join(big(errors.of(0)), "key", "left_anti"), "states")
    need = written(requires.groupBy("key", "rule").agg(F.count("*").alias("need")), "need")
    rules = written(rules.where("from_state <> to_state").join(big(need), ["key", "rule"], "left").withColumn("need", F.coalesce("need", F.lit(0))), "rules")
    n = 0
    while not now.isEmpty():
        n += 1
        met = requires.join(big(now), ["key", "cell", "state"]).groupBy("key", "rule").agg(F.count("*").alias("met"))
        able = rules.join(big(now.select("key", F.col("cell").alias("target"), F.col("state").alias("from_state"))), ["key", "target", "from_state"])
        fires = able.join(big(met), ["key", "rule"], "left").where(F.col("need") == F.coalesce("met", F.lit(0)))
        writes = written(fires.groupBy("key", F.col("target").alias("cell")).agg(F.min("to_state").alias("to"), F.max("to_state").alias("other")), "writes")
        clash = written(writes.where("to <> other").select("key").distinct(), "clash")
        errors.write(clash.select("key", F.lit("CONFLICTING_WRITES").alias("error")), n)
        # a system without a write has settled
        done.write(now.join(big(writes), "key", "left_anti"), n)
        on = now.join(big(writes.select("key").distinct().join(big(clash), "key", "left_anti")), "key", "left_semi")
        now = written(on.join(big(writes.select("key", "cell", "to")), ["key", "cell"], "left").select("key", "cell", F.coalesce("to", "state").alias("state")), "states")
        if n == most:
            errors.write(now.select("key", F.lit("NOT_SETTLED").alias("error")).distinct(), n + 1)
            break
    if not n:
        done.write(now, 0)
    return done.all(), errors.all()


def consensus(votes: DataFrame, key: list[str]) -> DataFrame:
    """(key, status, value, votes, needed) of votes (key..., value, valid): confirmed is the one value with two thirds of all votes or more; any invalid vote, and a tie of the most, leave UNKNOWN."""
    counted = votes.groupBy(*key, "value").agg(F.count("*").alias("_n"), F.bool_and("valid").alias("_ok"))
    best = counted.groupBy(*key).agg(F.sum("_n").alias("_total"), F.bool_and("_ok").alias("_ok"), F.max(F.struct("_n", "value")).alias("_top"))
    tied = counted.join(best.select(*key, F.col("_top._n").alias("_most")), key).where("_n = _most").groupBy(*key).agg(F.count("*").alias("_at_top"))
    needed, most = F.floor((2 * F.col("_total") + 2) / 3), F.col("_top._n")
    wins = F.col("_ok") & (F.col("_at_top") == 1) & (most >= needed)
    return best.join(tied, key).select(*key, F.when(wins, "CONFIRMED").otherwise("UNKNOWN").alias("status"), F.when(wins, F.col("_top.value")).alias("value"), F.when(F.col("_ok"), most).otherwise(0).alias("votes"), needed.alias("needed"))


# Severities from the least, and the sentinels in the order in which they speak.
SEVERITIES = ["INFO", "WARN", "BLOCK"]
SENTINELS = ["permission-sentinel", "scope-sentinel", "conflict-sentinel", "ood-sentinel", "numeric-consistency-sentinel"]
NUMBER = r"\b[0-9][0-9.,]*\b"


def inside(path: Column, roots: Column) -> Column:
    """Whether a path is one of the roots or below one; a path with .. in it is inside nothing."""
    return F.exists(roots, lambda r: (path == r) | path.startswith(F.concat(F.rtrim(r, F.lit("/")), F.lit("/")))) & ~path.rlike(r"(^|/)\.\.(/|$)")


def concerns(subjects: DataFrame, observations: DataFrame) -> DataFrame:
    """(subject, sentinel, kind, severity, detail): what five sentinels find in subjects, none of them knowing the others.

    subjects: subject, capability, risk and args (a map) of a proposed action or null, max_risk, allowed (capabilities, empty for all), roots
    (allowed paths, empty for all), verdict (of calibration, null for none), answer and evidence. observations: (subject, key, value).
    A value is held for a path if it begins with / or ~ or has a / in it. A number counts from two characters on, without marks at its end. A risk that is null
    can't be checked, and what can't be checked hasn't passed: that is a BLOCK.
    """
    act = F.col("capability").isNotNull()
    row = lambda sentinel, kind, severity, detail: F.struct(F.lit(sentinel).alias("sentinel"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), detail.alias("detail"))
    outside = F.filter(F.map_entries("args"), lambda e: (e["value"].startswith("~") | F.contains(e["value"], F.lit("/"))) & ~inside(e["value"], F.col("roots")))
    listed = F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all("answer", F.lit(NUMBER), 0), lambda x: F.rtrim(x, F.lit(".,"))), lambda x: F.length(x) >= 2)))
    loose = F.filter(listed, lambda x: ~F.contains(F.col("evidence"), x))
    rules = [
        (act & F.col("max_risk").isNotNull() & F.col("risk").isNull(), row(SENTINELS[0], "sentinel_error", "BLOCK", F.lit("risk is not known"))),
        (act & (F.col("risk") > F.col("max_risk")), row(SENTINELS[0], "risk_over_ceiling", "BLOCK", F.concat_ws(">", F.col("risk").cast("string"), F.col("max_risk").cast("string")))),
        (act & (F.size("allowed") > 0) & ~F.array_contains("allowed", F.col("capability")), row(SENTINELS[0], "capability_not_allowed", "BLOCK", F.col("capability"))),
        (F.coalesce(F.col("verdict") != "ANSWERED", F.lit(False)), row(SENTINELS[3], "out_of_distribution", "WARN", F.col("verdict"))),
        ((F.coalesce("answer", F.lit("")) != "") & (F.coalesce("evidence", F.lit("")) != "") & (F.size(loose) > 0), row(SENTINELS[4], "unsupported_number", "WARN", F.array_join(loose, ","))),
        # a look that found nothing to say is worth a note
        (~act & F.col("verdict").isNull(), row(SENTINELS[3], "not_calibrated", "INFO", F.lit(""))),
    ]
    own = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), r) for broken, r in rules]), lambda x: x.isNotNull())
    paths = F.when(act & (F.size("roots") > 0), F.transform(outside, lambda e: row(SENTINELS[1], "path_out_of_scope", "BLOCK", F.concat_ws("=", e["key"], e["value"]))))
    said = subjects.select("subject", F.inline(F.concat(own, F.coalesce(paths, F.array().cast("array<struct<sentinel:string,kind:string,severity:string,detail:string>>")))))
    split = observations.groupBy("subject", "key").agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a <> b")
    return said.unionByName(split.select("subject", F.lit(SENTINELS[2]).alias("sentinel"), F.lit("observation_conflict").alias("kind"), F.lit("WARN").alias("severity"), F.col("key").alias("detail")))


def reviewed(subjects: DataFrame, found: DataFrame) -> DataFrame:
    """(subject, verdict, decided_by, kind, concerns, failed_checks) of concerns: the highest severity decides, BLOCK above all, the first sentinel
    of it speaks for it; INFO is counted, but no failed check. A subject without concerns is CLEAR."""
    level = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    place = F.array_position(F.array(*[F.lit(s) for s in SENTINELS]), F.col("sentinel"))
    worst = F.min(F.struct((-level).alias("level"), place.alias("place"), "kind", "detail", "sentinel", "severity")).alias("w")
    own = found.groupBy("subject").agg(worst, F.count("*").alias("concerns"), F.count_if(F.col("severity") != "INFO").alias("failed_checks"))
    verdict = F.when(F.col("w.severity") == "BLOCK", "BLOCKED").when(F.col("w.severity") == "WARN", "WARNED").otherwise("CLEAR")
    j = subjects.select("subject").join(own, "subject", "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    said = lambda c: F.when(F.col("w.severity") != "INFO", F.col(c))
    return j.select("subject", verdict.alias("verdict"), F.coalesce(said("w.sentinel"), F.lit("")).alias("decided_by"), F.coalesce(said("w.kind"), F.lit("")).alias("kind"), zero("concerns"), zero("failed_checks"))


def retried(trials: DataFrame, answers: DataFrame, second: DataFrame, questions: DataFrame) -> DataFrame:
    """(trial, question, pass, diagnostic) of the trials that stay: one pass over the answers, and one retry of what failed in it.

    trials (trial), answers and second (trial, question, pass), questions (question). A trial stays if each question is answered once or more; a question that is
    answered twice passes if both do, one that is null has failed. The failed questions of a trial that stays are asked once more: second has the answers to that. The
    retry is kept, as diagnostic rows beside the first ones, only if it answers every failed question of its trial; answers to other questions and trials are passed over.
    """
    want = questions.select("question").distinct()
    once = answers.join(want, "question", "left_semi").groupBy("trial", "question").agg(F.bool_and(F.coalesce("pass", F.lit(False))).alias("pass"))
    full = once.groupBy("trial").agg(F.count("*").alias("n")).where(F.col("n") == want.count())  # questions are a fixed list
    kept = written(once.join(full, "trial", "left_semi").join(trials.select("trial").distinct(), "trial", "left_semi"), "kept")
    failed = kept.where("NOT pass").select("trial", "question")
    again = failed.join(second.groupBy("trial", "question").agg(F.bool_and("pass").alias("pass")), ["trial", "question"], "left")
    whole = again.groupBy("trial").agg(F.count("*").alias("asked"), F.count("pass").alias("answered")).where("asked = answered")
    return kept.select("trial", "question", "pass", F.lit(False).alias("diagnostic")).unionByName(again.join(whole, "trial", "left_semi").select("trial", "question", "pass", F.lit(True).alias("diagnostic")))


def patched(sections: DataFrame, patches: DataFrame, group: list[str], row: list[str], shields: DataFrame | None = None) -> DataFrame:
    """Sections (group..., place, id, row...) after patches of the same columns, applied in the order of their place.

    A patch of an id that is there takes over its section's row and keeps its place, the first one where sections share an id; any other is appended behind the
    last section, in the order of the patches' first appearance; of patches of one id the last one's row counts. New places go on by one.
    Patches of the ids in shields (group..., id) do nothing. A patch that comes again changes nothing.
    """
    key = [*group, "id"]
    if shields is not None:
        patches = patches.join(shields.select(*key).distinct(), key, "left_anti")
    first = sections.groupBy(*key).agg(F.min("place").alias("_first"))
    last = patches.groupBy(*key).agg(F.min("place").alias("_came"), F.max(F.struct("place", *row)).alias("_new"))
    j = sections.join(first, key).join(last, key, "left")
    hit = (F.col("place") == F.col("_first")) & F.col("_new").isNotNull()
    kept = j.select(*group, "place", "id", *[F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in row])
    end = sections.groupBy(*group).agg(F.max("place").alias("_end"))
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("_came", "id"))
    added = last.join(first, key, "left_anti").withColumn("_nth", nth).join(end, group, "left")
    return kept.unionByName(added.select(*group, (F.coalesce("_end", F.lit(0)) + F.col("_nth")).alias("place"), "id", *[F.col(f"_new.{c}").alias(c) for c in row]))


def protected(rules: DataFrame, modules: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan, kind, target, reason) of rules (plan, place, kind, target, reason), and behind them a PRESERVE rule for each protected module of the plan's genome
    (plan, module, protected) but the plan's own target (plan, own): of rules of one kind and target the first stays, so a PRESERVE rule that is there keeps its reason.
    A plan without a target of its own has all of them protected."""
    keep = modules.where("protected").select("plan", "module").distinct().join(targets.select("plan", F.col("own").alias("module")), ["plan", "module"], "left_anti")
    new = keep.select("plan", F.lit(1).alias("late"), F.lit(0).cast("long").alias("place"), F.lit("PRESERVE").alias("kind"), F.col("module").alias("target"), F.lit("protected by prompt genome").alias("reason"))
    both = rules.select("plan", F.lit(0).alias("late"), F.col("place").cast("long").alias("place"), "kind", "target", "reason").unionByName(new)
    return both.groupBy("plan", "kind", "target").agg(F.min(F.struct("late", "place", "reason")).alias("f")).select("plan", "kind", "target", F.col("f.reason").alias("reason"))
