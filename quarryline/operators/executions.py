"""What an execution leaves behind, the contracts that models' answers have to keep, plans of ensembles, and changes without evidence of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.checks import json_between, json_objects

SPACE = " \t\r\n\f\x0b"

# Kinds of records, and what stands for a worker that isn't known.
OBSERVATION, DECISION, FAILURE, METRIC = "OBSERVATION", "DECISION", "FAILURE", "METRIC"
UNRESOLVED = "UNRESOLVED"


def _trimmed(c: Column) -> Column:
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACE))


def _first(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that is broken, empty for none; a rule that can't be told isn't broken."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules], F.lit(""))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _is_json(value: Column) -> Column:
    # the parser passes over what follows an object, so an object has to be all there is
    whole = ~_trimmed(value).startswith("{") | json_between(value).eqNullSafe(_trimmed(value))
    return F.try_parse_json(value).isNotNull() & whole


def recorded(executions: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, entry, worker, key, value, confidence, references) of what executions leave behind, and (node, place, error) of those that break off.

    executions (node, capability, worker, duration_ms, confidence, error, output), a row for each node; observations (node, place, key, value, confidence,
    references). Each observation is a record, in a node that consolidates and under a key of decisions a DECISION; an error is a FAILURE, and every execution ends with a METRIC.
    Keys are trimmed, references trimmed, distinct and sorted. A node breaks off at its first observation without a key, without JSON, or with a confidence outside of 0 to 1:
    what stands before that one stays, and neither a failure nor a metric follows. Observations of a node that wasn't executed are left out.
    """
    refs = F.transform(F.coalesce("references", F.array().cast("array<string>")), lambda r: _trimmed(r))
    refs = F.array_sort(F.array_distinct(F.filter(refs, lambda r: r != "")))
    seen = observations.select("node", "place", _trimmed(F.col("key")).alias("key"), "value", "confidence", refs.alias("references"))
    wrong = _first([
        ("KEY_REQUIRED", F.col("key") == ""), ("VALUE_NOT_JSON", ~F.coalesce(_is_json(F.col("value")), F.lit(False))),
        ("CONFIDENCE_OUT_OF_RANGE", ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))),
    ])
    broken = seen.select("node", "place", wrong.alias("error")).where("error <> ''").groupBy("node").agg(F.min(F.struct("place", "error")).alias("b"))
    worker = F.when(_trimmed(F.col("worker")) == "", UNRESOLVED).otherwise(F.col("worker"))
    runs = executions.join(broken, "node", "left").withColumn("worker", worker)
    decides = F.contains(F.upper("capability"), F.lit("CONSOLIDATE")) & F.lower("key").startswith("decision.")
    own = seen.join(runs.select("node", "capability", "worker", F.col("b.place").alias("until")), "node").where("until IS NULL OR place < until")
    own = own.select("node", F.when(F.coalesce(decides, F.lit(False)), DECISION).otherwise(OBSERVATION).alias("entry"), "worker", "key", "value", "confidence", "references")
    said, sure = F.coalesce("error", F.lit("")), F.coalesce("confidence", F.lit(0.0))
    base = F.to_json(F.struct(F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), F.when(said != "", said).alias("error"), F.when(sure != 0, sure).alias("confidence")))
    output = F.to_json(F.try_parse_json("output"))
    metric = F.when(output.isNull(), base).otherwise(F.concat(F.left(base, F.length(base) - 1), F.lit(',"output":'), output, F.lit("}")))
    row = lambda entry, key, value, sure: F.struct(F.lit(entry).alias("entry"), F.lit(key).alias("key"), value.alias("value"), sure.alias("confidence"))
    failure = F.when(said != "", row(FAILURE, "node.failure", F.to_json(F.struct(said.alias("error"))), F.lit(0.0)))
    ends = runs.where("b IS NULL").select("node", "worker", F.inline(F.array_compact(F.array(failure, row(METRIC, "node.execution", metric, sure)))))
    ends = ends.select("node", "entry", "worker", "key", "value", "confidence", F.array().cast("array<string>").alias("references"))
    return own.unionByName(ends), runs.where("b IS NOT NULL").select("node", "b.place", "b.error")


# The fields that an answer of each role may have, with their types, as of a JSON value's shape.
_TEXT = "(?:STRING|VOID)"


def _object(**fields: str) -> str:
    """A pattern of the shape of an object with some of the fields and no other; shapes name them in the order of the alphabet."""
    return "OBJECT<" + "".join(f"(?:{name}: {fields[name]}(?:, |(?=>)))?" for name in sorted(fields)) + ">"


def _array(of: str) -> str:
    return f"(?:ARRAY<(?:{of}|VOID)>|VOID)"


ROLES = {
    "rosetta": (_object(box=_TEXT, arrow=_TEXT, ring=_TEXT, x_time=_TEXT, semantic_film_not_video="(?:BOOLEAN|VOID)"), "box string, arrow string, ring string, x_time string"),
    "cells": (_object(cells=_array(_object(id=_TEXT, initial_state=_TEXT))), "cells array<struct<id: string, initial_state: string>>"),
    "transitions": (
        _object(rules=_array(_object(requires=_array(_object(cell_id=_TEXT, state=_TEXT)), target_cell=_TEXT, from_state=_TEXT, to_state=_TEXT))),
        "rules array<struct<requires: array<struct<cell_id: string, state: string>>, target_cell: string, from_state: string, to_state: string>>",
    ),
    "timeline": (_object(checkpoints=_array(_TEXT)), "checkpoints array<string>"),
}
SEEN = _object(boot_text=_array(_TEXT), probe_top=_TEXT, probe_bottom=_TEXT, tool_protocol=_TEXT, address_abi=_TEXT, t3=".*")


def _shape(value: Column) -> Column:
    return F.schema_of_variant(F.try_parse_json(value))


def _blank(c: Column) -> Column:
    return _trimmed(c) == ""


def contract_error(role: Column, value: Column) -> Column:
    """What a role's answer breaks, empty for nothing: it is one JSON object, has the role's fields and no other, each of its type, and says something in all of them.

    Names of fields count as they are written. A field that is null or missing says nothing; cells, rules and checkpoints need one entry at least, and no two cells have one id, whatever
    its case. What a rule requires may be missing, but not be blank.
    """
    read = {name: F.from_json(value, schema) for name, (_, schema) in ROLES.items()}
    cells, rules, points = read["cells"]["cells"], read["transitions"]["rules"], read["timeline"]["checkpoints"]
    ids = F.transform(cells, lambda c: F.upper(_trimmed(c["id"])))
    none = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    gaps = lambda r: F.exists(F.coalesce(r["requires"], F.array().cast("array<struct<cell_id: string, state: string>>")), lambda q: _blank(q["cell_id"]) | _blank(q["state"]))
    empty = F.when(role == "cells", none(cells)).when(role == "transitions", none(rules)).when(role == "timeline", none(points)).otherwise(False)
    blank = (
        F.when(role == "rosetta", _blank(read["rosetta"]["box"]) | _blank(read["rosetta"]["arrow"]) | _blank(read["rosetta"]["ring"]) | _blank(read["rosetta"]["x_time"]))
        .when(role == "cells", F.exists(cells, lambda c: _blank(c["id"]) | _blank(c["initial_state"])))
        .when(role == "transitions", F.exists(rules, lambda r: _blank(r["target_cell"]) | _blank(r["from_state"]) | _blank(r["to_state"]) | gaps(r)))
        .when(role == "timeline", F.exists(points, lambda p: _blank(p)))
    )
    fits = F.lit(False)
    for name, (shape, _) in ROLES.items():
        fits = fits | ((role == name) & _shape(value).rlike(f"^{shape}$"))
    return _first([
        ("UNKNOWN_ROLE", ~F.coalesce(role.isin(*ROLES), F.lit(False))), ("NOT_ONE_OBJECT", ~F.coalesce(_trimmed(value).startswith("{") & _is_json(value), F.lit(False))),
        ("UNKNOWN_FIELD_OR_TYPE", ~F.coalesce(fits, F.lit(False))), ("NO_ENTRIES", empty), ("BLANK_FIELD", blank), ("REPEATED_CELL", (role == "cells") & (F.size(F.array_distinct(ids)) < F.size(ids))),
    ])


def parsed_observation(answer: Column) -> Column:
    """A model's answer as a struct (error, boot_text, probe_top, probe_bottom, tool_protocol, address_abi, t3): its first JSON object, out of a code fence, held strictly.

    A fence counts from three lines on. An answer without an object, with one that is no JSON, or with a field of another name or type has its error
    and nothing else. Texts are trimmed but those of boot_text; t3 may be any JSON and stays it.
    """
    text = F.regexp_replace(_trimmed(answer), r"(?s)^```[^\n]*\n(?=[^\n]*\n)(.*?)(?:\n[^\S\n]*```[^\S\n]*)?$", "$1")
    # what stands before the first brace and behind the last is prose
    found = F.get(json_objects(text), F.lit(0))

    def held(found: Column) -> Column:
        error = _first([("NO_OBJECT", found.isNull()), ("NOT_JSON", F.try_parse_json(found).isNull()), ("UNKNOWN_FIELD_OR_TYPE", ~_shape(found).rlike(f"^{SEEN}$"))])
        return _once(F.struct(error.alias("error"), found.alias("found")), read)

    def read(s: Column) -> Column:
        good = F.when(s["error"] == "", s["found"])
        return _once(F.from_json(good, "boot_text array<string>, probe_top string, probe_bottom string, tool_protocol string, address_abi string"), lambda own: F.struct(
            s["error"].alias("error"), own["boot_text"].alias("boot_text"), *[F.when(s["error"] == "", _trimmed(own[c])).alias(c) for c in ("probe_top", "probe_bottom", "tool_protocol", "address_abi")],
            F.to_json(F.variant_get(F.try_parse_json(good), "$.t3", "variant")).alias("t3"),
        ))

    return _once(found, held)


# How a plan of an ensemble names its nodes, and the ways in which a node may wait.
MEMBER, FUSION = "ensemble-member-", "ensemble-fusion"
JOINS = ["ALL", "ANY", "QUORUM"]


def ensembles(goals: DataFrame, workers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(goal, node, worker, policy, depends, join_kind, needed) of the plans of ensembles, and (goal, error) of the goals that get none.

    goals (goal, capability, members, fusion_capability, join_kind, quorum), workers (worker, capability, score, params, requires). The best workers of a capability are a goal's members,
    whose failures are tolerated, and the best one of the fusion's capability waits for them: best score first, those without parameters first, fewer parameters, then by name. A quorum that isn't
    given is more than half. Workers are ranked once for each capability, not once for each goal, and only as far as the largest goal reaches.
    """
    name = lambda c: F.upper(_trimmed(F.col(c))).alias(c)
    asked = goals.select("goal", name("capability"), F.coalesce("members", F.lit(0)).alias("members"), name("fusion_capability"), name("join_kind"), F.coalesce("quorum", F.lit(0)).alias("quorum"))
    asked = asked.withColumn("join_kind", F.when(F.col("join_kind") == "", "ALL").otherwise(F.col("join_kind")))
    asked = asked.withColumn("needed", F.when((F.col("join_kind") == "QUORUM") & (F.col("quorum") <= 0), F.floor(F.col("members") / 2) + 1).otherwise(F.col("quorum")).cast("long"))
    wrong = _first([
        ("CAPABILITY_REQUIRED", F.col("capability") == ""), ("TOO_FEW_MEMBERS", F.col("members") < 2), ("FUSION_REQUIRED", F.col("fusion_capability") == ""), ("UNKNOWN_JOIN", ~F.col("join_kind").isin(JOINS)),
        ("QUORUM_ABOVE_MEMBERS", (F.col("join_kind") == "QUORUM") & (F.col("needed") > F.col("members"))), ("QUORUM_WITHOUT_ITS_JOIN", (F.col("join_kind") != "QUORUM") & (F.col("quorum") != 0)),
    ])
    asked = asked.withColumn("error", wrong)
    most = asked.where("error = ''").agg(F.max("members")).first()[0] or 1
    place = F.row_number().over(Window.partitionBy("capability").orderBy(F.desc("score"), F.col("params") != 0, "params", "worker"))
    ranked = workers.select("worker", name("capability"), "score", "params", "requires").withColumn("place", place).where(F.col("place") <= most)
    good = asked.where("error = ''")
    members = good.join(ranked, "capability").where("place <= members").groupBy("goal").agg(F.array_sort(F.collect_list("worker")).alias("workers"))
    best = ranked.where("place = 1").select(F.col("capability").alias("fusion_capability"), F.col("worker").alias("fusion"), "requires")
    j = good.join(members, "goal", "left").join(best, "fusion_capability", "left")
    late = _first([
        ("NOT_ENOUGH_WORKERS", F.coalesce(F.size("workers"), F.lit(0)) < F.col("members")), ("NO_FUSION_WORKER", F.col("fusion").isNull()),
        ("FUSION_NOT_ATOMIC", F.coalesce(F.size("requires"), F.lit(0)) > 0),
    ])
    j = j.withColumn("error", late)
    none = F.array().cast("array<string>")
    row = lambda node, worker, policy, depends, kind, needed: F.struct(node.alias("node"), worker.alias("worker"), F.lit(policy).alias("policy"), depends.alias("depends"), kind.alias("join_kind"), needed.alias("needed"))
    one = F.transform("workers", lambda w: row(F.concat(F.lit(MEMBER), w), w, "TOLERATED", none, F.lit("ALL"), F.lit(0).cast("long")))
    fusion = row(F.lit(FUSION), F.col("fusion"), "STRICT", F.transform("workers", lambda w: F.concat(F.lit(MEMBER), w)), F.col("join_kind"), F.col("needed"))
    nodes = j.where("error = ''").select("goal", F.inline(F.array_append(one, fusion)))
    return nodes, asked.where("error <> ''").select("goal", "error").unionByName(j.where("error <> ''").select("goal", "error"))


def exploration_changes(queue: DataFrame, changes: DataFrame, baseline: DataFrame, most: int = 20) -> DataFrame:
    """(candidate_id, place, parents, tags) of queued candidates (candidate_id, place) for which there is no evidence yet: CHANGE records that rest on the baseline.

    The parents are the first `most` distinct observations of the baseline (event_id, ts, kind); without one there are no records. changes (candidate_id, mutation) give the tags. A
    candidate without changes of its own has no record.
    """
    first = baseline.where("kind = 'OBSERVATION'").groupBy("event_id").agg(F.min("ts").alias("ts")).orderBy("ts", "event_id").limit(most)
    parents = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]).alias("parents")).where(F.size("parents") > 0)
    kinds = changes.groupBy("candidate_id").agg(F.collect_set(F.concat(F.lit("mutation:"), "mutation")).alias("kinds"))
    j = queue.join(kinds, "candidate_id").crossJoin(F.broadcast(parents))  # one row
    return j.select("candidate_id", "place", "parents", F.array_sort(F.concat(F.array(F.lit("closed-loop"), F.lit("exploration")), "kinds")).alias("tags"))
