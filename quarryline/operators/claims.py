"""Claim validation, fusion, conflicts and votes over (candidate_id, subject, predicate, object, polarity, confidence, address, cid)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.numeric import ratio
from quarryline.functions.text import lower_spaced
from quarryline.sources.shared import written

_MISSING = (("candidate_id", "MISSING_ID"), ("subject", "MISSING_SUBJECT"), ("predicate", "MISSING_PREDICATE"), ("object", "MISSING_OBJECT"))


def reject_reason(claims: DataFrame) -> DataFrame:
    """claims with reason: the first rule a claim breaks, null for none."""
    out = F.lit(None).cast("string")
    rules = [(F.trim(F.coalesce(c, F.lit(""))) == "", r) for c, r in _MISSING]
    rules += [(F.coalesce("address", F.lit("")) == "", "MISSING_EVIDENCE"), (F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1), "BAD_CONFIDENCE")]
    for broken, reason in reversed(rules):
        out = F.when(broken, reason).otherwise(out)
    return claims.withColumn("reason", out)


def verified(claims: DataFrame, objects: DataFrame) -> DataFrame:
    """Claims whose evidence exists: a stored (address, cid), or the address alone if the claim leaves the cid blank."""
    known = objects.select("address", F.col("cid").alias("stored")).distinct()
    fits = (claims["address"] == known["address"]) & ((F.coalesce(claims["cid"], F.lit("")) == "") | (claims["cid"] == F.col("stored")))
    return claims.join(known, fits, "left_semi")


def keyed(claims: DataFrame) -> DataFrame:
    """With normal forms of subject, predicate and object."""
    return claims.withColumns({"s": lower_spaced(F.col("subject")), "p": lower_spaced(F.col("predicate")), "o": lower_spaced(F.col("object"))})


def fused_exact(claims: DataFrame) -> DataFrame:
    """One row for each triple: conflict if both polarities are claimed, merged otherwise; the first candidate speaks for the group."""
    groups = keyed(claims).groupBy("s", "p", "o").agg(
        F.count("*").alias("n"), F.bool_or("polarity").alias("yes"), F.bool_or(~F.col("polarity")).alias("no"), F.max("confidence").alias("confidence"),
        F.min("candidate_id").alias("first_id"), F.count_distinct("address").alias("evidence"),
    )
    status = F.when(F.col("yes") & F.col("no"), "CONFLICT").otherwise("ACCEPTED")
    return groups.select("s", "p", "o", status.alias("status"), "n", F.round("confidence", 6).alias("confidence"), "first_id", "evidence")


def fused_single(claims: DataFrame) -> DataFrame:
    """One row for each (subject, predicate): conflict if more than one (polarity, object) is claimed, and the object left blank then."""
    groups = keyed(claims).groupBy("s", "p").agg(F.count_distinct(F.struct("polarity", "o")).alias("values"), F.min("o").alias("o"), F.count("*").alias("n"), F.min("candidate_id").alias("first_id"))
    clash = F.col("values") > 1
    return groups.select("s", "p", F.when(clash, "").otherwise(F.col("o")).alias("o"), F.when(clash, "CONFLICT").otherwise("ACCEPTED").alias("status"), "values", "n", "first_id")


MODES = ["EXACT", "SINGLE_VALUE"]


def policy_rows(policies: DataFrame) -> DataFrame:
    """(p, fusion) of policies (predicate, cardinality, fusion): predicates in normal form; a blank fusion follows from the cardinality, ONE or else MANY.

    A blank predicate, a predicate that is there twice, and an unknown cardinality or fusion raise, with it in the message.
    """
    blank = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    p, card, mode = lower_spaced(F.coalesce("predicate", F.lit(""))), blank("cardinality"), blank("fusion")
    refuse = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce("predicate", F.lit("")))).cast("string")
    fusion = (
        F.when(p == "", refuse("policy without a predicate")).when(~card.isin("", "ONE", "MANY"), refuse("unknown cardinality")).when(~mode.isin("", *MODES), refuse("unknown fusion"))
        .when(mode != "", mode).when(card == "ONE", "SINGLE_VALUE").otherwise("EXACT")
    )
    own = policies.select(p.alias("p"), fusion.alias("fusion")).groupBy("p").agg(F.count("*").alias("n"), F.min("fusion").alias("fusion"))
    return own.select("p", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two policies of one predicate: "), F.col("p"))).cast("string")).otherwise(F.col("fusion")).alias("fusion"))


def governed(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """Claims with their normal forms and the fusion of their predicate, EXACT without a policy.

    The policies are written first, so that Spark knows their size and sends a catalogue of them to the claims: predicates are few, and dealt out by
    them most claims would come to one task.
    """
    return keyed(claims).join(written(policy_rows(policies), "policies"), "p", "left").withColumn("fusion", F.coalesce("fusion", F.lit("EXACT")))


def fused_by_policy(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """(s, p, o, fusion, status, values, n, yes, no, confidence, first_id, evidence): one row for each claim group, by the fusion of its predicate, EXACT without a policy.

    Both kinds come out of one aggregation, whose key is the triple or, where a predicate has one value, subject and predicate: an exact group is in
    conflict if both polarities are claimed, a single-valued one if more than one polarity and object are, and then its object is blank. values counts those.
    """
    own = governed(claims, policies)
    single = F.col("fusion") == "SINGLE_VALUE"
    groups = own.withColumn("key", F.when(~single, F.col("o"))).groupBy("s", "p", "fusion", "key").agg(
        F.min("o").alias("o"), F.count_distinct(F.struct("polarity", "o")).alias("values"), F.count("*").alias("n"), F.count_if("polarity").alias("yes"), F.count_if(~F.col("polarity")).alias("no"),
        F.max("confidence").alias("confidence"), F.min("candidate_id").alias("first_id"), F.count_distinct("address").alias("evidence"),
    )
    clash = F.col("values") > 1  # of an exact group: both polarities of its one object
    return groups.select(
        "s", "p", F.when(clash & single, "").otherwise(F.col("o")).alias("o"), "fusion", F.when(clash, "CONFLICT").otherwise("ACCEPTED").alias("status"), "values", "n", "yes", "no",
        F.round("confidence", 6).alias("confidence"), "first_id", "evidence",
    )


def conflict_members(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """(s, p, o, candidate_id, side): a row for each candidate of a group in conflict, + for what it affirms and - for what it denies, with its own object."""
    own = governed(claims, policies).withColumn("key", F.when(F.col("fusion") == "EXACT", F.col("o")))
    lone = own.groupBy("s", "p", "key").agg(F.count_distinct(F.struct("polarity", "o")).alias("values")).where(F.col("values") > 1)
    same = [own[c].eqNullSafe(lone[c]) for c in ("s", "p", "key")]
    return own.join(lone, same, "left_semi").select("s", "p", "o", "candidate_id", F.when(F.col("polarity"), "+").otherwise("-").alias("side"))


def decisions(claims: DataFrame) -> DataFrame:
    """(candidate_id, decision): rejected, in conflict, and of a merged group the first accepted and the rest merged; rows of one id share its decision."""
    judged = reject_reason(claims)
    rows = keyed(judged.where("reason IS NULL"))
    groups = rows.groupBy("s", "p", "o").agg((F.bool_or("polarity") & F.bool_or(~F.col("polarity"))).alias("clash"), F.min("candidate_id").alias("first_id"))
    kind = F.when(F.col("clash"), "CONFLICT").when(F.col("candidate_id") == F.col("first_id"), "ACCEPTED").otherwise("MERGED")
    return rows.join(groups, ["s", "p", "o"]).select("candidate_id", kind.alias("decision")).unionAll(judged.where("reason IS NOT NULL").select("candidate_id", F.lit("REJECTED").alias("decision")))


def metrics(decided: DataFrame) -> DataFrame:
    """Counts of the decisions and the uncertainty they leave: twice the conflicts, and half the rejections, of all; 1 of none."""
    counts = decided.agg(F.count("*").alias("n"), *[F.count_if(F.col("decision") == d).alias(d.lower()) for d in ("ACCEPTED", "MERGED", "CONFLICT", "REJECTED")])
    raw = ratio(2 * F.col("conflict") + 0.5 * F.col("rejected"), F.col("n"), 1.0)
    return counts.withColumn("uncertainty", F.round(F.least(F.lit(1.0), raw), 6))


def verification_plan(claims: DataFrame) -> DataFrame:
    """(s, p, o, candidate_id, address) of each conflict's candidates: what to read again to settle it, a row each."""
    own = keyed(claims)
    clash = own.groupBy("s", "p", "o").agg(F.bool_or("polarity").alias("yes"), F.bool_or(~F.col("polarity")).alias("no")).where("yes AND no")
    return own.join(clash, ["s", "p", "o"], "left_semi").select("s", "p", "o", "candidate_id", "address").distinct()


def majority(votes: DataFrame, key: str, value: str, valid: str) -> DataFrame:
    """(key, verdict, winner, votes, needed): the value with two thirds of the votes; UNKNOWN on a tie, on too few, and with any invalid vote."""
    counts = votes.groupBy(key, value).agg(F.count("*").alias("n"), F.bool_and(valid).alias("ok"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), value)
    placed = counts.withColumn("place", F.row_number().over(order))
    best = placed.groupBy(key).agg(
        F.sum("n").alias("votes"), F.bool_and("ok").alias("ok"), F.max(F.when(F.col("place") == 1, F.col(value))).alias("top"),
        F.max(F.when(F.col("place") == 1, F.col("n"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("n"))).alias("second"),
    )
    needed = F.floor((2 * F.col("votes") + 2) / 3)
    wins = F.col("ok") & (F.col("first") >= needed) & (F.col("first") > F.coalesce("second", F.lit(0)))
    return best.select(key, F.when(wins, "RESOLVED").otherwise("UNKNOWN").alias("verdict"), F.when(wins, F.col("top")).alias("winner"), F.col("votes").cast("long").alias("votes"), needed.alias("needed"))
