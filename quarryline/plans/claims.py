"""Queries of the claim family, over lineitem rows read as claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import claims as C
from quarryline.plans.catalog import query
from quarryline.plans.inputs import CLAIMS_SQL, claims, read

_N = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_K = f"SELECT *, {_N.format('subject')} AS s, {_N.format('predicate')} AS p, {_N.format('object')} AS o"
_OK = "trim(coalesce(object, '')) <> '' AND address <> '' AND confidence BETWEEN 0 AND 1"
_DECIDED = (
    f"WITH {CLAIMS_SQL}, k AS ({_K} FROM claims WHERE {_OK}), d AS (SELECT candidate_id, CASE WHEN max(CAST(polarity AS INT)) OVER g <> min(CAST(polarity AS INT)) OVER g THEN 'CONFLICT' "
    f"WHEN row_number() OVER (PARTITION BY s, p, o ORDER BY candidate_id) = 1 THEN 'ACCEPTED' ELSE 'MERGED' END AS decision FROM k WINDOW g AS (PARTITION BY s, p, o) UNION ALL SELECT candidate_id, 'REJECTED' FROM claims WHERE NOT ({_OK})) "
)


@query(f"WITH {CLAIMS_SQL} SELECT coalesce(CASE WHEN trim(object) = '' THEN 'MISSING_OBJECT' WHEN confidence < 0 OR confidence > 1 THEN 'BAD_CONFIDENCE' END, 'VALID') AS reason, count(*) AS n FROM claims GROUP BY 1")
def claim_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-03: claims by the first rule they break."""
    return C.reject_reason(claims(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("VALID")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {CLAIMS_SQL}, k AS ({_K} FROM claims) SELECT s, p, o, CASE WHEN bool_or(polarity) AND bool_or(NOT polarity) THEN 'CONFLICT' ELSE 'ACCEPTED' END AS status, count(*) AS n, round(max(confidence), 6) AS confidence, min(candidate_id) AS first_id, count(DISTINCT address) AS evidence FROM k GROUP BY s, p, o")
def claim_fusion_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-29, SP-07, SF-03: exact fusion by triple."""
    return C.fused_exact(claims(spark, sf_dir))


@query(f"WITH {CLAIMS_SQL}, k AS ({_K} FROM claims) SELECT s, p, CASE WHEN count(DISTINCT (polarity, o)) > 1 THEN '' ELSE min(o) END AS o, CASE WHEN count(DISTINCT (polarity, o)) > 1 THEN 'CONFLICT' ELSE 'ACCEPTED' END AS status, count(DISTINCT (polarity, o)) AS values, count(*) AS n, min(candidate_id) AS first_id FROM k GROUP BY s, p")
def claim_fusion_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-30, SP-08: single-valued predicates."""
    return C.fused_single(claims(spark, sf_dir))


@query(_DECIDED + "SELECT decision, count(*) AS n, min(candidate_id) AS first_id FROM d GROUP BY decision")
def claim_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-31, WN-06: the reducer's decision on each candidate."""
    return C.decisions(claims(spark, sf_dir)).groupBy("decision").agg(F.count("*").alias("n"), F.min("candidate_id").alias("first_id"))


@query(_DECIDED + "SELECT count(*) AS n, count_if(decision = 'ACCEPTED')::BIGINT AS accepted, count_if(decision = 'MERGED')::BIGINT AS merged, count_if(decision = 'CONFLICT')::BIGINT AS conflict, count_if(decision = 'REJECTED')::BIGINT AS rejected, round(least(1.0, (2 * count_if(decision = 'CONFLICT') + 0.5 * count_if(decision = 'REJECTED')) / count(*)::DOUBLE), 6) AS uncertainty FROM d")
def claim_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-31, AG-33: counts of the decisions and the uncertainty."""
    return C.metrics(C.decisions(claims(spark, sf_dir)))


@query(_DECIDED + ", u AS (SELECT count_if(decision = 'CONFLICT') AS c, least(1.0, (2 * count_if(decision = 'CONFLICT') + 0.5 * count_if(decision = 'REJECTED')) / count(*)::DOUBLE) AS u FROM d) SELECT CASE WHEN c > 0 THEN 'RESOLVE_CONFLICTS' WHEN u > 0.35 THEN 'REDUCE_UNCERTAINTY' ELSE 'SATISFIED' END AS state FROM u")
def controller_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-09: what the controller does next."""
    m = C.metrics(C.decisions(claims(spark, sf_dir)))
    return m.select(F.when(F.col("conflict") > 0, "RESOLVE_CONFLICTS").when(F.col("uncertainty") > 0.35, "REDUCE_UNCERTAINTY").otherwise("SATISFIED").alias("state"))


@query(f"WITH {CLAIMS_SQL}, k AS ({_K} FROM claims) SELECT DISTINCT s, p, o, candidate_id, address FROM k JOIN (SELECT s, p, o FROM k GROUP BY s, p, o HAVING bool_or(polarity) AND bool_or(NOT polarity)) USING (s, p, o)")
def verification_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-11, SP-03: the evidence to read again for each conflict."""
    return C.verification_plan(claims(spark, sf_dir))


@query(f"WITH {CLAIMS_SQL}, stored AS (SELECT DISTINCT concat('store://carrier/docs/d', l_suppkey, '/pages/', lpad(CAST(l_orderkey % 1000000 AS VARCHAR), 6, '0')) AS address, concat('x', l_orderkey) AS cid FROM lineitem WHERE l_suppkey % 3 <> 0) SELECT producer, count(*) AS n FROM claims c WHERE EXISTS (SELECT 1 FROM stored t WHERE t.address = c.address AND (c.cid = '' OR c.cid = t.cid)) GROUP BY producer")
def evidence_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-02, UD-05, AG-32: claims whose evidence is stored under their address and content id."""
    own = claims(spark, sf_dir)
    stored = own.where("address NOT RLIKE '^store://carrier/docs/d[0-9]*/' OR CAST(regexp_extract(address, 'docs/d([0-9]+)', 1) AS BIGINT) % 3 <> 0").select("address", F.concat(F.lit("x"), F.regexp_extract("candidate_id", "^k0*([0-9]+)-", 1)).alias("cid"))
    return C.verified(own, stored).groupBy("producer").agg(F.count("*").alias("n"))


@query(f"WITH {CLAIMS_SQL}, d AS (SELECT DISTINCT candidate_id, address, cid FROM claims) SELECT count(*) AS rows_, count(DISTINCT address) AS addresses, count_if(cid = '')::BIGINT AS blank FROM d")
def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-32: evidence once for each (candidate, address, cid)."""
    d = claims(spark, sf_dir).dropDuplicates(["candidate_id", "address", "cid"])
    return d.agg(F.count("*").alias("rows_"), F.count_distinct("address").alias("addresses"), F.count_if(F.col("cid") == "").alias("blank"))


@query(
    f"WITH {CLAIMS_SQL}, e AS (SELECT subject, predicate, count(DISTINCT polarity) AS kinds FROM claims GROUP BY subject, predicate), b AS (SELECT predicate, max(kinds) AS most, avg(kinds) AS mean FROM e GROUP BY predicate) "
    "SELECT predicate, CASE WHEN predicate = 'IS_R' THEN 'ONE' ELSE 'MANY' END AS cardinality, CASE WHEN predicate = 'IS_R' THEN 'SINGLE_VALUE' ELSE 'EXACT' END AS fusion, most, round(mean, 6) AS mean FROM b"
)
def claim_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-06, UD-04: predicate policies with their defaults beside what the claims show."""
    kinds = claims(spark, sf_dir).groupBy("subject", "predicate").agg(F.count_distinct("polarity").alias("kinds"))
    policy = spark.createDataFrame([("IS_R", "ONE")], "predicate string, cardinality string")
    seen = kinds.groupBy("predicate").agg(F.max("kinds").alias("most"), F.round(F.avg("kinds"), 6).alias("mean")).join(F.broadcast(policy), "predicate", "left")
    card = F.coalesce("cardinality", F.lit("MANY"))
    return seen.select("predicate", card.alias("cardinality"), F.when(card == "ONE", "SINGLE_VALUE").otherwise("EXACT").alias("fusion"), "most", "mean")


@query(
    f"WITH {CLAIMS_SQL}, t(term) AS (VALUES ('part'), ('is_n'), ('line o'), ('7')), m AS (SELECT candidate_id, count(*) AS score FROM claims, t WHERE contains(lower(concat_ws(' ', subject, predicate, object)), term) GROUP BY candidate_id) SELECT candidate_id, score FROM m ORDER BY score DESC, candidate_id LIMIT 8"
)
def claim_term_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-24, TK-04: the claims that contain most of the query's terms."""
    text = F.lower(F.concat_ws(" ", "subject", "predicate", "object"))
    score = sum((F.contains(text, F.lit(t)).cast("long") for t in ("part", "is_n", "line o", "7")), F.lit(0).cast("long"))
    hits = claims(spark, sf_dir).groupBy("candidate_id").agg(F.sum(score).alias("score"))
    return hits.where("score > 0").orderBy(F.desc("score"), "candidate_id").limit(8)


@query(
    "WITH v AS (SELECT user_id, event_type AS value, value >= 10 AS ok FROM events), c AS (SELECT user_id, value, count(*) AS n, bool_and(ok) AS ok FROM v GROUP BY ALL), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, value) AS place FROM c), b AS (SELECT user_id, sum(n)::BIGINT AS votes, bool_and(ok) AS ok, max(value) FILTER (WHERE place = 1) AS top, max(n) FILTER (WHERE place = 1) AS f, coalesce(max(n) FILTER (WHERE place = 2), 0) AS s FROM p GROUP BY user_id) "
    "SELECT user_id, CASE WHEN ok AND f >= (2 * votes + 2) // 3 AND f > s THEN 'RESOLVED' ELSE 'UNKNOWN' END AS verdict, CASE WHEN ok AND f >= (2 * votes + 2) // 3 AND f > s THEN top END AS winner, votes, (2 * votes + 2) // 3 AS needed FROM b"
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-23: two-thirds majority by key."""
    v = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("value"), (F.col("value") >= 10).alias("ok"))
    return C.majority(v, "user_id", "value", "ok")


@query("SELECT user_id, event_type, count(DISTINCT floor(value / 250)) AS kinds FROM events GROUP BY user_id, event_type HAVING count(DISTINCT floor(value / 250)) > 1")
def observation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-23: keys observed with different values."""
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_distinct(F.floor(F.col("value") / 250)).alias("kinds")).where("kinds > 1")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AND json_valid(props) AS valid, event_id % 7 <> 0 AND json_valid(props) AND value / 500 <= 0.9 AS accepted FROM events")
def json_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04, FLT-15, SF-45, SP-10: observation rows with valid JSON, the required keys and a confidence in range."""
    e = read(spark, sf_dir, "events")
    valid = F.try_parse_json("props").isNotNull()
    keyed = F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("string")).isNotNull()
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), valid.alias("valid"), (keyed & valid & (F.col("value") / 500 <= 0.9)).alias("accepted"))


@query("SELECT canonical, count(*) AS n FROM (SELECT '{\"a\":' || (event_id % 3) || ',\"b\":\"' || event_type || '\"}' AS canonical FROM events) GROUP BY canonical")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-45: key-sorted JSON, so that equal values are equal text."""
    e = read(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"b": "'), F.col("event_type"), F.lit('", "a": '), (F.col("event_id") % 3).cast("string"), F.lit("}"))).otherwise(
        F.concat(F.lit('{"a":'), (F.col("event_id") % 3).cast("string"), F.lit(',"b":"'), F.col("event_type"), F.lit('"}'))
    )
    return e.select(F.to_json(F.parse_json(raw)).alias("canonical")).groupBy("canonical").agg(F.count("*").alias("n"))
