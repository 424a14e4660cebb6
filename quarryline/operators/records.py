"""Rules over single records: claim records, builds, answers of native trials, worker descriptors and visible names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import literals, upper_spaced

# The states of a claim record, those that need evidence, and the kinds of evidence that three of them need.
STATUSES = ["designed", "implemented", "evidenced", "evidenced_failing", "verified", "rejected"]
NEED_EVIDENCE = ["implemented", "evidenced", "evidenced_failing", "verified"]
NEED_KIND = {"implemented": ["test"], "evidenced": ["run"], "evidenced_failing": ["run"], "verified": ["hash", "invariant", "bytes"]}
# Phrases of an answer that depends on what a model can't have, and of claims that it can't have checked.
DEPENDS = [
    "NEED AN EXTERNAL DECODER", "NEED EXTERNAL DECODER", "NEED THE ORIGINAL FILE", "NEED THE IMAGE FILE", "NEED ACCESS TO THE FILE", "NEED THE BINARY", "CANNOT READ THE PAYLOAD", "CANNOT ACCESS THE PAYLOAD",
]
ESCALATES = ["EXTRACT THE BITS", "EXTRACT BITS", "READ THE BITS", "DECODE THE BINARY", "DECOMPRESS THE", "BZIP2", "GZIP", "ZSTD", "MERKLE PROOF FIRST", "VERIFY HASH FIRST"]
UNVERIFIED = {
    "BYTE_LAYOUT": [" BYTES", "BYTE HEADER", "BYTE PAYLOAD"], "COMPRESSION": ["BZIP2", "GZIP", "ZSTD", "COMPRESSED RESIDUAL"], "HASH": ["SHA256:", "SHA-256:", "HASH SHA256"],
    "ARCHIVE": ["ARCHIVE CONTENTS", "DECOMPRESS THE RESIDUAL"],
}
#: Share of the expected entries from which on an index counts as recovered, and parameters above which a worker is large.
RECOVERED, LARGE = 0.75, 1_000_000_000


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def claim_record_errors(records: DataFrame) -> DataFrame:
    """(id, error) of claim records (id, statement, status, version_introduced, last_checked, evidence), a row for each rule that one breaks; an id used twice once."""
    refs = F.coalesce("evidence", F.array().cast("array<string>"))
    starts = lambda kinds: F.exists(refs, lambda r: F.split_part(r, F.lit(":"), F.lit(1)).isin(kinds) & F.contains(r, F.lit(":")))
    rules = [
        ("BAD_ID", ~F.coalesce(F.col("id"), F.lit("")).rlike("^[A-Z0-9][A-Z0-9._-]*$")), ("EMPTY_STATEMENT", _blank("statement")), ("EMPTY_VERSION", _blank("version_introduced")),
        ("BAD_STATUS", ~F.coalesce("status", F.lit("")).isin(STATUSES)), ("BAD_DATE", F.try_to_timestamp("last_checked", F.lit("yyyy-MM-dd")).isNull()),
        ("NO_EVIDENCE", F.col("status").isin(NEED_EVIDENCE) & (F.size(refs) == 0)), ("BAD_REFERENCE", F.exists(refs, lambda r: ~F.contains(r, F.lit(":")))),
        *[(f"NO_{'_OR_'.join(kinds).upper()}_EVIDENCE", (F.col("status") == status) & ~starts(kinds)) for status, kinds in NEED_KIND.items()],
    ]
    broken = records.select("id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))).alias("error"))
    return broken.unionAll(records.groupBy("id").count().where("count > 1").select("id", F.lit("DUPLICATE_ID").alias("error"))).distinct()


def build_state(schema: str) -> Column:
    """The first rule that a build breaks against its candidate, VALID for none: columns schema, candidate_id, program, payload, artifact and artifact_bytes, and what the candidate has."""
    unlike = lambda c: (F.coalesce(f"wanted_{c}", F.lit("")) != "") & ~F.col(c).eqNullSafe(F.col(f"wanted_{c}"))
    return (
        F.when(~F.col("schema").eqNullSafe(F.lit(schema)), "SCHEMA").when(~F.col("candidate_id").eqNullSafe(F.col("wanted_candidate_id")), "CANDIDATE").when(unlike("program"), "PROGRAM").when(unlike("payload"), "PAYLOAD")
        .when((F.coalesce("artifact", F.lit("")) == "") | (F.coalesce("artifact_bytes", F.lit(0)) <= 0), "ARTIFACT").otherwise("VALID")
    )


def _has(text: Column, phrases: list[str]) -> Column:
    return F.exists(literals(phrases), lambda p: F.contains(text, p))


def native_evaluation(trials: DataFrame) -> DataFrame:
    """trials (…, query_class, output, expected: entries, decoder, declared, exact) with index_rate, answered, discovered, mechanical, unverified and pass."""
    out = F.col("out")
    own = trials.withColumn("out", upper_spaced(F.coalesce("output", F.lit(""))))
    rate = F.when(F.size("expected") > 0, F.size(F.filter("expected", lambda e: F.contains(out, upper_spaced(e)))) / F.size("expected")).otherwise(0.0)
    c = F.col("query_class")
    answered = F.when(c == "INDEX", rate >= RECOVERED).when(c.isin("IDENTITY", "OVERVIEW", "LOCATE"), (out != "") & ~F.contains(out, F.lit("UNKNOWN"))).when(c == "EXACT", out != "").otherwise(False)
    wanted = upper_spaced(F.coalesce("decoder", F.lit("")))
    discovered = (wanted == "") | (upper_spaced(F.coalesce("declared", F.lit(""))) == wanted) | F.contains(out, wanted)
    mechanical = c.isin("IDENTITY", "INDEX", "OVERVIEW", "LOCATE") & (_has(out, DEPENDS) | _has(out, ESCALATES))
    unverified = F.when(F.col("exact"), "").otherwise(F.concat_ws(",", *[F.when(_has(out, phrases), name) for name, phrases in UNVERIFIED.items()]))
    own = own.withColumns({"index_rate": F.round(rate, 6), "answered": answered, "discovered": discovered, "mechanical": mechanical, "unverified": unverified})
    clean = F.col("answered") & (F.col("unverified") == "")
    return own.withColumn("pass", F.when(c == "EXACT", clean).otherwise(clean & F.col("discovered") & ~F.col("mechanical"))).drop("out")


def member_inputs(context: Column, prefix: str) -> Column:
    """The entries of a context (a map) whose names begin with the prefix, in the order of their names."""
    return F.array_sort(F.map_entries(F.map_filter(context, lambda n, _: n.startswith(prefix))))


def advisories(workers: DataFrame) -> DataFrame:
    """(plan, worker_id, advice) of the workers (plan, worker_id, engine, deterministic, params, abstention) of plans: models whose calibration is to be checked first, and large ones."""
    rules = [
        ("CHECK_CALIBRATION", F.col("abstention") & (F.col("engine") == "MODEL") & ~F.coalesce("deterministic", F.lit(False))), ("LARGE_WORKER", F.col("params") > LARGE),
    ]
    return workers.select("plan", "worker_id", F.explode(F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules]))).alias("advice"))


def rule_of(key: Column) -> Column:
    """The rule that a dotted key belongs to."""
    return F.regexp_extract(key, r"^rule[.]([^.]+)[.]", 1)


def visible_requires(value: Column, names: Column) -> Column:
    """cell=state in visible names."""
    part = F.split(value, "=")
    return F.concat_ws(" is ", F.element_at(names, part[0]), part[1])
