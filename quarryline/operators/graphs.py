"""Plans as graphs: validity, levels, critical paths, barriers, rule fixpoints, distilled automata, weighted branches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quarryline.sources.shared import bucketed, new_path, written


def plan_errors(nodes: DataFrame, edges: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """(plan, node, error) of nodes (plan, node, quorum), edges (plan, src, dst) and, where given, bindings (plan, node, source): plans are told apart.

    An id that a plan uses twice, a dependency that its plan doesn't have, a node that depends on itself, a quorum of none or above the number of dependencies, and
    an input bound to a node that isn't among the node's dependencies. An edge that is given twice counts once.
    """
    key = ["plan", "node"]
    unknown = edges.join(nodes.select("plan", F.col("node").alias("src")).hint("merge"), ["plan", "src"], "left_anti")
    # what is known of a node comes together as rows, in order: itself, its dependencies, and one row for each that its plan lacks; nothing is gathered in tables by key
    row = lambda df, node, kind, src, quorum: df.select("plan", F.col(node).alias("node"), F.lit(kind).alias("kind"), src.alias("src"), quorum.cast("long").alias("quorum"))
    none, no = F.lit(None), F.lit(None).cast(edges.schema["src"].dataType)
    rows = row(nodes, "node", 0, no, F.col("quorum")).unionAll(row(edges, "dst", 1, F.col("src"), none)).unionAll(row(unknown, "dst", 2, no, none))
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), (nodes.count() + edges.count()) >> 19)
    w = Window.partitionBy(*key).orderBy("kind", "src")
    some = lambda c: F.coalesce(F.max(c.cast("int")).over(w), F.lit(0))
    own = rows.repartition(parts, *key).select(
        *key, F.lead("kind").over(w).isNull().alias("last"), F.count_if(F.col("kind") == 0).over(w).alias("times"), F.max("quorum").over(w).alias("quorum"), some(F.col("kind") == 2).alias("lacks"),
        some((F.col("kind") == 1) & (F.col("src") == F.col("node"))).alias("itself"), F.dense_rank().over(w).alias("groups"),
    ).where("last")
    # its own rows and those of what its plan lacks are a group each; a null is no node's name
    deps = F.when(F.col("plan").isNotNull() & F.col("node").isNotNull(), F.col("groups") - (F.col("times") > 0).cast("int") - F.col("lacks")).otherwise(0)
    found = {
        "DUPLICATE": F.col("times") > 1, "UNKNOWN_DEPENDENCY": F.col("lacks") == 1, "OWN_DEPENDENCY": F.col("itself") == 1, "QUORUM_TOO_LARGE": (F.col("quorum") > 0) & (F.col("quorum") > deps), "QUORUM_TOO_SMALL": F.col("quorum") <= 0,
    }
    out = own.select(*key, F.explode(F.array_compact(F.array(*[F.when(c, error) for error, c in found.items()]))).alias("error"))
    if bindings is None:
        return out
    named = edges.select("plan", F.col("dst").alias("node"), F.col("src").alias("source"))
    return out.unionAll(bindings.join(named, [*key, "source"], "left_anti").select(*key, F.lit("UNBOUND_INPUT").alias("error")).distinct())


class Cyclic(ValueError):
    """A plan has nodes on a cycle."""


class MissingProducer(ValueError):
    """A goal needs something that nothing gives."""


def _big(df: DataFrame) -> DataFrame:
    """A side of a join that no join sends through the driver: a written table of many rows can be a few MB of files, which Spark takes for a small one."""
    return df.hint("merge")


def _hung(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root, steps, weight): each node with one dependency hangs below it, and so below the nearest node above that has none or several.

    Weight is the cost of the nodes from there on, its own included. Pointers jump to their pointers' ends, so a chain of n nodes takes log2 n rounds; those that go
    round a cycle of such nodes have no root.
    """
    below = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("deps"), F.min("src").alias("src")).where("deps = 1")
    now = written(below.join(_big(nodes), "node").select("node", F.col("src").alias("root"), F.lit(1).cast("long").alias("steps"), F.col("cost").alias("weight")), "jumps")
    total, rounds = now.count(), 0
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("above"), F.col("steps").alias("more"), F.col("weight").alias("over"))
        open_ = now.join(_big(up.select("root")), "root", "left_semi")
        if open_.isEmpty() or 1 << rounds > total:
            return now.join(_big(up.select("root")), "root", "left_anti").select("node", "root", "steps", "weight")
        far = now.join(_big(up), "root", "left").select(
            "node", F.coalesce("above", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("weight") + F.coalesce("over", F.lit(0))).alias("weight"),
        )
        now, rounds = written(far, "jumps"), rounds + 1


def _peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, finish) of nodes (node, cost): round by round those without open dependencies; nodes on a cycle, and those behind it, are never reached.

    Nodes with one dependency take no part in the rounds: they hang on another (_hung) and follow from it, so a chain, or a tree, is done at once. A
    round goes over the links of the nodes that the round before has done, and over the nodes that wait with a part of their dependencies done: one row
    each, with their number and the latest level and finish. Nodes that nothing has come to are in no round, and the links stay where they are, dealt out by
    their source. A round is one written table, of those that are done and those that wait, and all rounds are read as one relation at the end.
    """
    spark = nodes.sparkSession
    edges = written(edges.select("src", "dst").distinct(), "edges")
    cost = written(nodes.groupBy("node").agg(F.max("cost").cast("long").alias("cost")), "costs")
    hung = written(_hung(cost, edges), "hung")
    zero = F.lit(0).cast("long")
    own = written(cost.join(_big(edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("need"))), "node", "left").select("node", "cost", F.coalesce("need", zero).alias("need")), "needs")
    far = edges.join(_big(own.where("need > 1").withColumnRenamed("node", "dst")), "dst").join(_big(hung.withColumnRenamed("node", "src")), "src", "left")
    far = far.select(F.coalesce("root", "src").alias("src"), F.col("dst").alias("node"), "cost", "need", F.coalesce("steps", zero).alias("steps"), F.coalesce("weight", zero).cast("long").alias("weight"))
    links = bucketed(far, "links", "src")
    now = own.where("need = 0").select("node", "cost", "need", zero.alias("came"), zero.alias("level"), F.col("cost").alias("finish"), F.lit(1).alias("done"))
    path, n = new_path(spark, "rounds"), 0
    schema = StructType(now.schema.fields[:-1])
    while True:
        now.write.option("compression", "zstd").partitionBy("done").parquet(f"{path}/round={n}")
        rows = spark.read.schema(StructType([*schema.fields, StructField("done", IntegerType())])).parquet(f"{path}/round={n}")
        done = rows.where("done = 1").select(F.col("node").alias("src"), F.col("level").alias("l"), F.col("finish").alias("f"))
        if done.isEmpty():
            break
        came = links.join(done.hint("shuffle_hash"), "src").select("node", "cost", "need", F.lit(1).cast("long").alias("came"), (F.col("l") + F.col("steps")).alias("level"), (F.col("f") + F.col("weight")).alias("finish"))
        every = came.unionByName(rows.where("done = 0").drop("done")).groupBy("node").agg(*[F.max(c).alias(c) for c in ("cost", "need")], F.sum("came").alias("came"), *[F.max(c).alias(c) for c in ("level", "finish")])
        ready = F.col("came") == F.col("need")
        # what waits keeps the latest of its dependencies, what is done comes after them
        level, finish = F.when(ready, F.col("level") + 1).otherwise(F.col("level")), F.when(ready, F.greatest("cost", F.col("finish") + F.col("cost"))).otherwise(F.col("finish"))
        now, n = every.select("node", "cost", "need", "came", level.alias("level"), finish.alias("finish"), ready.cast("int").alias("done")), n + 1
    every = spark.read.schema(StructType([*schema.fields, StructField("done", IntegerType())])).parquet(path).where("done = 1").select("node", "level", "finish")
    behind = hung.join(_big(every.withColumnRenamed("node", "root")), "root").select("node", (F.col("level") + F.col("steps")).alias("level"), (F.col("finish") + F.col("weight")).alias("finish"))
    return every.unionByName(behind)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): a node's level is one above its highest dependency; nodes on a cycle, and those behind it, have none."""
    return _peeled(nodes.select("node", F.lit(0).cast("long").alias("cost")), edges).select("node", "level")


def critical_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, finish): the longest chain of costs that ends in each node; a plan with a cycle has none and raises."""
    done = _peeled(nodes.select("node", F.col("cost").cast("long").alias("cost")), edges)
    if done.count() < nodes.select("node").distinct().count():
        raise Cyclic("the plan has a cycle, so its chains have no end")
    return done.select("node", "finish")


#: Links of one level that are sent to all tasks; of more, the pairs are sent to the links.
FEW_LINKS = 500_000


class Pairs:
    """What a loop finds, (goal, worker, depth, level): one table in the shared folder, dealt out by goal, with a part for each level."""

    def __init__(self, spark: SparkSession, parts: int) -> None:
        self.spark, self.parts, self.table, self.path = spark, parts, f"pairs_{uuid.uuid4().hex}", new_path(spark, "pairs")

    def add(self, df: DataFrame) -> None:
        out = df.select("goal", "worker", "depth", "level").write.mode("append").option("compression", "zstd").option("path", self.path)
        out.partitionBy("level").bucketBy(self.parts, "goal").saveAsTable(self.table)

    def all(self) -> DataFrame:
        return self.spark.table(self.table)


def resolved(goals: DataFrame, needs: DataFrame, producers: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """(goal, worker, depth): the workers that goals (goal, product) take, by chaining backwards, each at its least depth.

    producers is (product, worker, rank): of a product's producers the one of least rank is taken, ties by name. needs is (worker, product). What is
    `available` (product) needs no producer. A product that nobody gives, and workers that need each other, raise.
    Workers are gone through from the highest level down, so a round knows the least depth of all its pairs (goal, worker) and no pair is met twice. Pairs
    stay dealt out by goal, in one table with a part for each level; a level of few links goes to them, and only for larger ones they go to the links.
    """
    spark = goals.sparkSession
    best = producers.groupBy("product").agg(F.min(F.struct("rank", "worker")).alias("b")).select("product", F.col("b.worker").alias("worker"))
    open_ = needs
    if available is not None:
        there = written(available.select("product").distinct(), "there")
        open_ = needs.join(there.hint("broadcast" if there.count() <= FEW_LINKS else "merge"), "product", "left_anti")
    links = written(open_.join(_big(best.withColumnRenamed("worker", "by")), "product", "left").select("worker", "product", "by"), "links")
    first = written(goals.join(_big(best.withColumnRenamed("worker", "by")), "product", "left").select("goal", "product", F.col("by").alias("worker")), "goals")
    lost = first.where("worker IS NULL").select("product").first()
    if lost:
        raise MissingProducer(f"nothing produces {lost['product']}")
    gaps = links.where("by IS NULL")  # only workers that a goal comes to miss anything
    some = not gaps.isEmpty()
    hops = links.where("by IS NOT NULL").select("worker", "by")
    level = written(levels(best.select(F.col("worker").alias("node")).distinct(), hops.select(F.col("by").alias("src"), F.col("worker").alias("dst"))), "levels")
    # who needs a worker on a cycle has no level either
    if not first.join(_big(level.withColumnRenamed("node", "worker")), "worker", "left_anti").isEmpty():
        raise Cyclic("workers need each other")
    steps = hops.distinct().join(_big(level.select(F.col("node").alias("worker"), F.col("level").alias("at"))), "worker").join(_big(level.select(F.col("node").alias("by"), "level")), "by")
    # a level's links stand together, so a round reads no others
    steps = written(steps.repartitionByRange("at", "worker").sortWithinPartitions("at", "worker"), "steps")
    sizes = {r["at"]: r["count"] for r in steps.groupBy("at").count().collect()}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), first.count() >> 14)
    pairs = Pairs(spark, parts)
    pairs.add(first.join(_big(level.withColumnRenamed("node", "worker")), "worker").select("goal", "worker", F.lit(0).cast("long").alias("depth"), "level").distinct().repartition(parts, "goal"))
    for at in sorted(sizes if not some else {r["level"] for r in level.select("level").distinct().collect()}, reverse=True):
        front = pairs.all().where(F.col("level") == at).groupBy("goal", "worker").agg(F.min("depth").alias("depth"))
        if some:
            lost = gaps.join(front.hint("merge"), "worker", "left_semi").select("product").first()
            if lost:
                raise MissingProducer(f"nothing produces {lost['product']}")
        if at in sizes:
            few = sizes[at] <= FEW_LINKS
            step = front.join(steps.where(F.col("at") == at).drop("at").hint("broadcast" if few else "merge"), "worker").select("goal", F.col("by").alias("worker"), (F.col("depth") + 1).alias("depth"), "level")
            step = step if few else step.repartition(parts, "goal")
            pairs.add(step.groupBy("goal", "worker", "level").agg(F.min("depth").alias("depth")))
    return pairs.all().groupBy("goal", "worker").agg(F.min("depth").alias("depth")).select("goal", "worker", "depth")


def barriers(nodes: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """(node, state): READY, WAITING or IMPOSSIBLE by its barrier (ALL, ANY, QUORUM) over the states of what it depends on."""
    d = edges.join(states.select(F.col("node").alias("src"), "state"), "src").groupBy(F.col("dst").alias("node")).agg(
        F.count("*").alias("n"), F.count_if(F.col("state") == "SUCCEEDED").alias("good"), F.count_if(F.col("state").isin("FAILED", "BLOCKED")).alias("bad"),
    )
    j = nodes.join(d, "node")
    needed = F.when(F.col("join_kind") == "ALL", F.col("n")).when(F.col("join_kind") == "ANY", F.lit(1)).otherwise(F.col("quorum"))
    state = F.when(F.col("good") >= needed, "READY").when(F.col("n") - F.col("bad") < needed, "IMPOSSIBLE").otherwise("WAITING")
    return j.select("node", state.alias("state"))


def _digest(parts: str) -> Column:
    """A hash of all rows of a group, in whatever order: their number and two sums of words of their SHA-256, so that no group is gathered."""
    h = F.sha2(parts, 256)
    word = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)"))
    return F.sha2(F.concat_ws(":", F.count(parts).cast("string"), word(1).cast("string"), word(17).cast("string")), 256)


def topology_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan, edges, shape) of nodes (plan, node, join_kind) and edges (plan, src, dst): a hash of each plan with its names, and of its in-degrees and kinds alone.

    Plans may use the same names: a plan's hashes depend on its own rows alone.
    """
    named = edges.select("plan", F.concat_ws(">", "src", "dst").alias("e")).groupBy("plan").agg(_digest("e").alias("edges"))
    deg = nodes.join(edges.groupBy("plan", F.col("dst").alias("node")).agg(F.count("*").alias("d")), ["plan", "node"], "left")
    shape = deg.select("plan", F.concat_ws(":", F.coalesce("d", F.lit(0)).cast("string"), "join_kind").alias("s")).groupBy("plan").agg(_digest("s").alias("shape"))
    return shape.join(named, "plan", "left").select("plan", "edges", "shape")


class ConflictingWrites(ValueError):
    """Two rules write different states to one cell in one step."""


def rule_fixpoint(cells: DataFrame, rules: DataFrame, requires: DataFrame, most: int = 64) -> DataFrame:
    """(cell, state) when no rule fires any more. In a step all rules read the state before it.

    rules: (rule, target, from_state, to_state); requires: (rule, cell, state). Conflicting writes, unknown cells and `most` steps without an end raise.
    """
    big = lambda df: df.hint("merge")  # noqa: E731  # tables of a row for each cell: no round sends one through the driver
    named = rules.select(F.col("target").alias("cell")).union(requires.select("cell"))
    if not named.join(big(cells), "cell", "left_anti").isEmpty():
        raise ValueError("a rule names a cell that doesn't exist")
    now = written(cells.select("cell", "state"), "graph")
    need = requires.groupBy("rule").agg(F.count("*").alias("need"))
    needing = written(rules.join(big(need), "rule", "left").withColumn("need", F.coalesce("need", F.lit(0))), "graph")
    for _ in range(most):
        met = requires.join(big(now), ["cell", "state"]).groupBy("rule").agg(F.count("*").alias("met"))
        fires = needing.join(big(met), "rule", "left").where(F.col("need") == F.coalesce("met", F.lit(0)))
        fires = fires.join(big(now.select(F.col("cell").alias("target"), F.col("state").alias("from_state"))), ["target", "from_state"])
        writes = written(fires.groupBy(F.col("target").alias("cell")).agg(F.min("to_state").alias("to_state"), F.max("to_state").alias("other")), "graph")
        found = writes.agg(F.count("*").alias("n"), F.count_if(F.col("to_state") != F.col("other")).alias("clashes")).first()
        if not found["n"]:
            return now
        if found["clashes"]:
            raise ConflictingWrites("two rules write different states to one cell")
        now = written(now.join(big(writes.select("cell", "to_state")), "cell", "left").select("cell", F.coalesce("to_state", "state").alias("state")), "graph")
    raise ValueError(f"no fixpoint within {most} steps")


def distilled(steps: DataFrame) -> DataFrame:
    """(target, from_state, to_state, n, first_step): the distinct rules behind a trace (step, target, from_state, to_state)."""
    return steps.groupBy("target", "from_state", "to_state").agg(F.count("*").alias("n"), F.min("step").alias("first_step"))


def receiver_rules(trace: DataFrame) -> DataFrame:
    """(state, token, action, next_state, deterministic): one row for each (state, token); more than one outcome is no rule."""
    return trace.groupBy("state", "token").agg(
        F.min("action").alias("action"), F.min("next_state").alias("next_state"), (F.count_distinct("action", "next_state") == 1).alias("deterministic"), F.count("*").alias("n"),
    )


def interfered(branches: DataFrame, least: float = 1e-12) -> DataFrame:
    """(state_id, label, re, im): amplitudes of equal labels added up, what cancels left out, the rest of each state scaled to 1."""
    s = branches.groupBy("state_id", "label").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).where(F.hypot("re", "im") > least)
    norm = F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).over(Window.partitionBy("state_id")))
    return s.select("state_id", "label", (F.col("re") / norm).alias("re"), (F.col("im") / norm).alias("im"))


def transformed(state: DataFrame, linear: DataFrame) -> DataFrame:
    """A state under a linear map (label, to_label, m_re, m_im): the complex product, added up and scaled. A label that the map lacks raises."""
    j = state.join(linear, "label", "left")
    j = j.where(F.when(F.col("to_label").isNull(), F.raise_error(F.concat(F.lit("no mapping for label: "), F.col("label"))).cast("boolean")).otherwise(True))
    re, im, a, b = F.col("re"), F.col("im"), F.col("m_re"), F.col("m_im")
    return interfered(j.select("state_id", F.col("to_label").alias("label"), (re * a - im * b).alias("re"), (re * b + im * a).alias("im")))


def probabilities(state: DataFrame) -> DataFrame:
    return state.select("state_id", "label", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))


def observed(state: DataFrame, x: float) -> DataFrame:
    """(state_id, label): the first label, by name, at which the running probability reaches x."""
    w = Window.partitionBy("state_id").orderBy("label")
    run = probabilities(state).withColumn("run", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("run") >= x - 1e-12).groupBy("state_id").agg(F.min("label").alias("label"))


def accounting(executions: DataFrame, critical: int) -> DataFrame:
    """Total work, bytes and queue time, efficiency (work over wall) and overhead (wall beyond the critical path, not below 0)."""
    work, wall = F.sum("work"), F.max("end") - F.min("start")
    return executions.agg(work.alias("work"), wall.alias("wall"), F.sum("bytes").alias("bytes"), F.round(work / wall, 6).alias("efficiency"), F.greatest(F.lit(0), wall - critical).alias("overhead"))
