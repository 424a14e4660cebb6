"""The tables of the workloads, derived from the driver's tables by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The stages of an experiment, in order.
STAGES = ["BOOT", "ROSETTA", "CODEC_DISCOVERY", "T2_NAVIGATION", "SEMANTIC_DECODE", "TEMPORAL_ROUTE", "TEMPORAL_STEP", "EXACT_BOUNDARY", "ANSWER"]

_stage = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(("BOOT", "ROSETTA", "T2_NAVIGATION", "SEMANTIC_DECODE", "TEMPORAL_STEP"))) + " END"
# The codes of failures.
CODES = (
    "NO_VISUAL_SIGNAL BOOT_NOT_FOUND ROSETTA_NOT_FOUND CODEC_NOT_FOUND CAPABILITY_MISMATCH T2_NOT_FOUND SEMANTIC_EVIDENCE_INSUFFICIENT TEMPORAL_RULE_AMBIGUOUS TEMPORAL_EXECUTION_INCOMPLETE "
    "RULE_FIRING_PRECONDITION_VIOLATION EXECUTION_SEMANTICS_CONTRADICTION CROSS_MODEL_EXECUTION_FIDELITY_FAILED CELL_IDENTITY_CONFUSION FROM_STATE_PRECONDITION_CONFUSION "
    "CONDITION_TARGET_BINDING_CONFUSION CHECKPOINT_NOT_FOUND ARTIFACT_GENERATION_REGRESSION UNAUTHORIZED_SEMANTIC_DRIFT UNSUPPORTED_OPERATION"
).split()
# every code occurs; some more often than others, and a tenth of the events has none or one that is not known
_code = "CASE (event_id * 7 + user_id) % 23 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + " WHEN 19 THEN 'T2_NOT_FOUND' WHEN 20 THEN 'SOMETHING_ELSE' END"

#: An append-only ledger of experiment events: observations, changes and outcomes.
LEDGER: dict[str, str] = {
    "event_id": "event_id",
    "kind": "CASE WHEN (event_id * 5 + user_id) % 8 = 6 THEN 'CHANGE' WHEN (event_id * 5 + user_id) % 8 = 7 THEN 'OUTCOME' ELSE 'OBSERVATION' END",
    "evidence_class": "CASE WHEN event_id % 10 = 9 THEN 'SYNTHETIC' ELSE 'REAL_MODEL' END",
    "model_id": "concat('m', user_id % 7)",
    "condition": "CASE user_id % 3 WHEN 0 THEN 'NATIVE' WHEN 1 THEN 'ASSISTED' ELSE 'DEGRADED' END",
    "specimen_id": "concat('s', event_id % 5)",
    "question_id": "concat('Q', event_id % 9)",
    "case_key": "concat('s', event_id % 5, '|Q', event_id % 9)",
    "candidate_id": "concat('c', user_id % 13)",
    "run_id": "concat('r', event_id % 4)",
    "stage": _stage,
    "failure_code": _code,
    "layer": "CASE event_id % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'R' WHEN 2 THEN 'S' ELSE NULL END",
    "pass": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value >= 200 END",
    "score": "value / 500",
    "score_before": "value / 500",
    "score_after": "CASE WHEN event_id % 3 = 0 THEN value / 400 ELSE value / 600 END",
    "delta": "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN value / 400 - value / 500 ELSE value / 600 - value / 500 END",
    "mutation": "CASE (event_id + user_id * 3) % 5 WHEN 0 THEN 'LAYOUT' WHEN 1 THEN 'PROMPT' WHEN 2 THEN 'REDUNDANCY' ELSE 'PRIMITIVE' END",
    "ts": "ts",
}

#: Claims of many producers: subject, predicate, object, polarity, confidence and an evidence address.
CLAIMS: dict[str, str] = {
    "candidate_id": "concat('k', lpad(CAST(l_orderkey AS string), 9, '0'), '-', l_linenumber)",
    "producer": "concat('p', l_suppkey % 9)",
    "subject": "concat('part ', l_partkey)",
    "predicate": "concat('IS_', l_returnflag)",
    "object": "concat(CASE WHEN l_linenumber % 2 = 0 THEN ' Line  ' ELSE 'line ' END, l_linestatus)",
    "polarity": "l_discount <= 0.09",
    "confidence": "CASE WHEN l_linenumber = 7 THEN 1.5 ELSE 1 - l_tax END",
    "address": "concat('store://carrier/docs/d', l_suppkey, '/pages/', lpad(CAST(l_orderkey % 1000000 AS string), 6, '0'))",
    "cid": "CASE WHEN l_linenumber = 6 THEN '' ELSE concat('x', l_orderkey) END",
}

#: Predictions with a confidence and whether they were right.
PREDICTIONS: dict[str, str] = {
    "event_id": "event_id",
    "slice": "CASE WHEN user_id % 4 = 0 THEN 'out' ELSE 'in' END",
    "domain": "event_type",
    "confidence": "value / 500",
    "correct": "event_id % 2 = 0",
    "abstained": "value < 50",
    "family": "event_type",
}


def select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def cte(name: str, table: str, columns: dict[str, str]) -> str:
    """The same columns as a common table expression for DuckDB."""
    body = ", ".join(f"{e} AS {n}" for n, e in columns.items()).replace(" AS string)", " AS VARCHAR)")
    return f"{name} AS (SELECT {body} FROM {table})"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(read(spark, sf_dir, "events"), LEDGER)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(read(spark, sf_dir, "lineitem"), CLAIMS)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(read(spark, sf_dir, "events"), PREDICTIONS)


LEDGER_SQL = cte("ledger", "events", LEDGER)
CLAIMS_SQL = cte("claims", "lineitem", CLAIMS)
PREDICTIONS_SQL = cte("predictions", "events", PREDICTIONS)
