"""Queries of checks, packing, traces and recorded loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import checks as C
from quarryline.operators import records as R
from quarryline.operators.joins import many_to_one
from quarryline.plans.catalog import query
from quarryline.plans.inputs import LEDGER_SQL, ledger, read
from quarryline.sources.stores import run_id

_CHECKS = "WITH c AS (SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN '{' ELSE props END AS body, substr(sha256(props), 1, 8) AS hash, value / 400 AS value, chr(CAST(65 + event_id % 5 AS INTEGER)) AS kind, event_id % 4 <> 0 AS dep FROM events), k AS (SELECT id, unnest(['JSON_VALID', 'HASH_MATCHES', 'REQUIRED_FIELDS', 'IN_RANGE', 'ONE_OF', 'DEPENDENCIES']) AS \"check\", unnest([json_valid(body), starts_with(sha256(body), hash), json_valid(body) AND coalesce(TRY(json_extract_string(body, '$.k')), '') <> '', value BETWEEN 0 AND 1, kind IN ('A', 'B', 'C'), dep]) AS ok FROM c) "


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(
        i.alias("id"), F.when(i % 9 == 0, "{").otherwise(F.col("props")).alias("body"), F.substring(F.sha2("props", 256), 1, 8).alias("hash"), (F.col("value") / 400).alias("value"),
        F.char(65 + i % 5).alias("kind"), F.when(i % 4 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"))).alias("needs"), F.array(F.lit("x")).alias("has"),
    )
    return C.structural(rows)


@query(_CHECKS.replace("coalesce(TRY(json_extract_string(body, '$.k')), '') <> ''", "contains(body, '\"k\"')") + 'SELECT "check", count_if(ok)::BIGINT AS passed, count_if(NOT ok)::BIGINT AS failed FROM k GROUP BY "check"')
def structural_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15, SP-47, SP-48, SP-64: structural checks of each row."""
    return _checks(spark, sf_dir).groupBy("check").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


@query(_CHECKS.replace("coalesce(TRY(json_extract_string(body, '$.k')), '') <> ''", "contains(body, '\"k\"')") + "SELECT id, CASE WHEN bool_and(ok) THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS verdict, coalesce(string_agg(\"check\", ',' ORDER BY \"check\") FILTER (WHERE NOT ok), '') AS failed FROM k GROUP BY id")
def check_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16, SP-49, UD-05: checks folded to a verdict."""
    return C.folded(_checks(spark, sf_dir))


def _debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ledger(spark, sf_dir).where("kind = 'OBSERVATION'")
    code = F.coalesce("failure_code", F.when(F.col("event_id") % 2 == 0, "NONE").otherwise("ODD"))
    body = F.to_json(F.struct(F.lit("r0").alias("schema"), F.when(F.coalesce("pass", F.lit(False)), "PASS").otherwise("FAIL").alias("status"), F.coalesce("stage", F.lit("NONE")).alias("last_completed_stage"), code.alias("failure_code"), (F.col("score") * 1.2).alias("confidence")))
    fence = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    text = F.concat(F.lit("answer "), "question_id", F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("\n" + C.MARKER), fence)))
    answer, trace = C.parse_debug(text)
    return own.select("event_id", answer.alias("answer"), trace.alias("trace"))


@query(
    f"WITH {LEDGER_SQL}, o AS (SELECT event_id, question_id, coalesce(pass, false) AS ok, coalesce(failure_code, CASE WHEN event_id % 2 = 0 THEN 'NONE' ELSE 'ODD' END) AS code, score * 1.2 AS confidence, event_id % 5 = 0 AS bare FROM ledger WHERE kind = 'OBSERVATION') "
    "SELECT event_id, concat('answer ', question_id) AS answer, CASE WHEN bare THEN '' ELSE concat_ws(',', CASE WHEN code NOT IN ('NONE', 'NO_VISUAL_SIGNAL', 'BOOT_NOT_FOUND', 'ROSETTA_NOT_FOUND', 'CODEC_NOT_FOUND', 'CAPABILITY_MISMATCH', 'T2_NOT_FOUND', 'SEMANTIC_EVIDENCE_INSUFFICIENT', 'TEMPORAL_RULE_AMBIGUOUS', 'CHECKPOINT_NOT_FOUND', 'EXACT_DECODER_REQUIRED', 'UNSUPPORTED_OPERATION', 'OTHER') THEN 'CODE' END, CASE WHEN ok AND code <> 'NONE' THEN 'PASS_WITH_CODE' END, CASE WHEN NOT ok AND code = 'NONE' THEN 'FAIL_WITHOUT_CODE' END, CASE WHEN confidence > 1 THEN 'CONFIDENCE' END) END AS violations FROM o"
)
def debug_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-32, FLT-17, FLT-18, SP-37: answers taken apart from their debug footers, and what those break."""
    d = _debug(spark, sf_dir)
    return d.select("event_id", "answer", F.when(F.col("trace").isNull(), "").otherwise(C.debug_violations(F.col("trace"))).alias("violations"))


_CAPS = [("READ", 1, ["path"], []), ("MOVE", 2, ["from", "to"], ["path"]), ("DELETE", 5, ["path"], ["force"])]


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cap = F.when(k % 4 == 0, "READ").when(k % 4 == 1, "MOVE").when(k % 4 == 2, "DELETE").otherwise("SHOUT")
    path = F.concat(F.when(k % 3 == 0, "/tmp/x").otherwise("/data/x"), k.cast("string"))
    args = F.when(k % 4 == 1, F.create_map(F.lit("from"), path, F.lit("to"), F.concat(path, F.lit("b")))).when(k % 5 == 0, F.create_map(F.lit("mode"), F.lit("r"))).otherwise(F.create_map(F.lit("path"), path))
    return read(spark, sf_dir, "orders").select(k.alias("action_id"), cap.alias("capability"), args.alias("args"))


@query(
    "WITH a AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'READ' WHEN 1 THEN 'MOVE' WHEN 2 THEN 'DELETE' ELSE 'SHOUT' END AS cap, o_orderkey % 4 <> 1 AND o_orderkey % 5 <> 0 AS has_path, o_orderkey % 4 <> 1 AND o_orderkey % 5 = 0 AS odd FROM orders) "
    "SELECT k AS action_id, concat_ws(',', CASE WHEN cap = 'SHOUT' THEN 'UNKNOWN_CAPABILITY' END, CASE WHEN cap = 'DELETE' THEN 'RISK_ABOVE_CEILING' END, CASE WHEN odd AND cap <> 'SHOUT' THEN 'MISSING_ARGUMENT' END, CASE WHEN odd AND cap <> 'SHOUT' THEN 'UNDECLARED_ARGUMENT' END, CASE WHEN has_path AND k % 3 = 0 THEN 'PATH_OUTSIDE' END) AS reasons FROM a"
)
def policy_authorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-26, FLT-25: why a policy refuses actions."""
    catalog = spark.createDataFrame(_CAPS, "capability string, risk int, required array<string>, optional array<string>")
    return C.authorised(_actions(spark, sf_dir), catalog, 3, "/data/")


@query("SELECT o_orderkey AS action_id, concat(CASE WHEN o_orderkey % 3 = 0 THEN '/tmp/x' ELSE '/data/x' END, o_orderkey, 'b') AS src, concat(CASE WHEN o_orderkey % 3 = 0 THEN '/tmp/x' ELSE '/data/x' END, o_orderkey) AS dst FROM orders WHERE o_orderkey % 4 = 1")
def action_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-65: the inverse of each move."""
    return C.rolled_back(_actions(spark, sf_dir)).select("action_id", F.col("args")["from"].alias("src"), F.col("args")["to"].alias("dst"))


_PACKING = """
WITH RECURSIVE m AS (
  SELECT l_orderkey AS pack, CAST(l_linenumber AS VARCHAR) AS module, l_linenumber = 1 AS required, CAST(trunc(l_quantity) AS INTEGER) AS size, CAST(trunc(l_quantity / 4) AS INTEGER) AS small,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, trunc(l_quantity), trunc(l_quantity / 4)) AS k FROM lineitem),
f(pack, k, left_, out) AS (
  SELECT DISTINCT pack, CAST(0 AS BIGINT), 60, CAST([] AS VARCHAR[]) FROM m
  UNION ALL
  SELECT f.pack, m.k, left_ - CASE WHEN size <= left_ THEN size WHEN small <= left_ THEN small ELSE 0 END,
         CASE WHEN size <= left_ THEN list_append(out, module || ':FULL') WHEN small <= left_ THEN list_append(out, module || ':MIN') WHEN required THEN list_append(out, module || ':ERROR') ELSE out END
  FROM f JOIN m ON m.pack = f.pack AND m.k = f.k + 1)
SELECT pack, array_to_string(max_by(out, k), ',') AS chosen, CAST(60 - max_by(left_, k) AS BIGINT) AS used FROM f GROUP BY pack
"""


@query(_PACKING)
def module_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-16: each order's lines as modules, packed in full or small under a budget."""
    k = F.col("l_linenumber")
    m = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pack"), k.cast("string").alias("module"), (10 - k).alias("priority"), (k == 1).alias("required"), F.col("l_quantity").cast("int").alias("full"), (F.col("l_quantity") / 4).cast("int").alias("small"))
    return C.module_packing(m, 60)


@query("SELECT conv_id AS page_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE turn % 3 <> 2 GROUP BY conv_id")
def layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-05, SP-51, SRC-14: a page's text from its regions in order, figures left out."""
    r = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("place"), F.when(F.col("turn") % 3 == 2, "figure").otherwise("text").alias("kind"), "text")
    return C.layout_text(r)


@query(r"WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS x FROM p), r AS (SELECT doc_id, line, trim(CASE (doc_id + line) % 5 WHEN 0 THEN 'Figure 3 ' || x WHEN 1 THEN '- ' || x WHEN 2 THEN x || ' = b + c' ELSE x END) AS t, (doc_id + line) % 30 AS h FROM l) SELECT doc_id, CAST(line AS INTEGER) AS line, CASE WHEN h > 25 OR (regexp_matches(t, '\p{L}') AND upper(replace(t, 'ß', 'SS')) = t AND length(t) < 80) THEN 'heading' WHEN regexp_matches(t, '^(Figure|Fig\.|Table) ') THEN 'caption' WHEN regexp_matches(t, '^([-*•]|[0-9]+[.)]) ') THEN 'list' WHEN contains(t, '=') AND length(t) < 120 THEN 'equation' ELSE 'paragraph' END AS kind FROM r")
def region_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-22: kinds of layout regions: every line of every document, some as captions, list items and equations."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    n, x = F.col("doc_id") + F.col("line"), F.col("x")
    t = F.when(n % 5 == 0, F.concat(F.lit("Figure 3 "), x)).when(n % 5 == 1, F.concat(F.lit("- "), x)).when(n % 5 == 2, F.concat(x, F.lit(" = b + c"))).otherwise(x)
    return d.select("doc_id", "line", C.region_kind(t, n % 30, F.lit(1250)).alias("kind"))


@query("SELECT event_id, props AS found FROM events")
def json_inside_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-40, SP-41, SP-38, SP-69: the JSON object inside a text."""
    return read(spark, sf_dir, "events").select("event_id", C.json_object(F.concat(F.lit("said: "), "props", F.lit(" and more"))).alias("found"))


@query()
def closed_loop_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-03, FX-04, SP-14, SP-16, SP-46: a recorded loop of generations replayed."""
    own = ledger(spark, sf_dir)
    # each candidate's scores lie a little higher than those of the one before
    score = F.col("score") + F.substring("candidate_id", 2, 9).cast("int") * 0.05
    trials = own.where("kind = 'OBSERVATION'").withColumn("score", F.floor(score * 10) / 10)
    changes = own.where("kind = 'CHANGE'").select("candidate_id", "mutation").distinct()
    return C.loop_table(spark, C.closed_loop(trials, changes, "c0", 6))


@query(f"WITH {LEDGER_SQL}, r AS (SELECT model_id, specimen_id FROM ledger WHERE kind = 'OBSERVATION'), d AS (SELECT model_id, max(failure_code) AS code FROM ledger WHERE kind = 'CHANGE' GROUP BY model_id) SELECT r.model_id, coalesce(d.code, 'OTHER') AS code, count(*) AS n FROM r LEFT JOIN d USING (model_id) GROUP BY ALL")
def import_with_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01, JN-02, SRC-07: results joined to their trials, with a debug report's code where there is one."""
    own = ledger(spark, sf_dir)
    code = own.where("kind = 'CHANGE'").groupBy("model_id").agg(F.max("failure_code").alias("code"))
    trials = own.groupBy("model_id", "specimen_id").agg(F.count("*").alias("planned"))
    results = many_to_one(own.where("kind = 'OBSERVATION'").select("model_id", "specimen_id"), trials, ["model_id", "specimen_id"], "trial")
    return results.join(code, "model_id", "left").groupBy("model_id", F.coalesce("code", F.lit("OTHER")).alias("code")).agg(F.count("*").alias("n"))


_RECORDS = (
    "WITH r AS (SELECT CASE WHEN o_orderkey % 31 = 0 THEN 'low-' || o_orderkey WHEN o_orderkey % 37 = 0 THEN 'C.SAME' ELSE 'C-' || o_orderkey END AS id, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END AS statement, "
    "CASE o_orderkey % 7 WHEN 0 THEN 'designed' WHEN 1 THEN 'implemented' WHEN 2 THEN 'evidenced' WHEN 3 THEN 'evidenced_failing' WHEN 4 THEN 'verified' WHEN 5 THEN 'rejected' ELSE 'done' END AS status, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'r1' END AS version, o_orderkey % 17 = 0 AS bad_date, "
    "CASE o_orderkey % 6 WHEN 0 THEN [] WHEN 1 THEN ['test:pkg:TestX'] WHEN 2 THEN ['run:7'] WHEN 3 THEN ['hash:ab', 'loose'] WHEN 4 THEN ['run:1', 'test:p:TestY', 'bytes:3'] ELSE ['other:1'] END AS refs FROM orders) "
)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda by, values, other: _ladder(k % by, values, other)
    refs = [[], ["test:pkg:TestX"], ["run:7"], ["hash:ab", "loose"], ["run:1", "test:p:TestY", "bytes:3"]]
    return read(spark, sf_dir, "orders").select(
        F.when(k % 31 == 0, F.concat(F.lit("low-"), k.cast("string"))).when(k % 37 == 0, "C.SAME").otherwise(F.concat(F.lit("C-"), k.cast("string"))).alias("id"), F.when(k % 11 == 0, " ").otherwise(F.col("o_orderpriority")).alias("statement"),
        pick(7, [F.lit(x) for x in ("designed", "implemented", "evidenced", "evidenced_failing", "verified", "rejected")], F.lit("done")).alias("status"), F.when(k % 13 != 0, "r1").alias("version_introduced"),
        F.when(k % 17 == 0, "2024-13-01").otherwise("2024-01-13").alias("last_checked"), pick(6, [F.array(*[F.lit(x) for x in r]).cast("array<string>") for r in refs], F.array(F.lit("other:1"))).alias("evidence"),
    )


def _ladder(x: Column, values: list[Column], other: Column) -> Column:
    out = F.when(x == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(x == i, v)
    return out.otherwise(other)


@query(
    _RECORDS.rstrip() + ", e AS (SELECT id, unnest([CASE WHEN NOT regexp_full_match(id, '[A-Z0-9][A-Z0-9._-]*') THEN 'BAD_ID' END, CASE WHEN trim(statement) = '' THEN 'EMPTY_STATEMENT' END, CASE WHEN version IS NULL THEN 'EMPTY_VERSION' END, CASE WHEN status = 'done' THEN 'BAD_STATUS' END, CASE WHEN bad_date THEN 'BAD_DATE' END, "
    "CASE WHEN status NOT IN ('designed', 'rejected', 'done') AND len(refs) = 0 THEN 'NO_EVIDENCE' END, CASE WHEN list_contains(refs, 'loose') THEN 'BAD_REFERENCE' END, CASE WHEN status = 'implemented' AND len(list_filter(refs, lambda r: starts_with(r, 'test:'))) = 0 THEN 'NO_TEST_EVIDENCE' END, "
    "CASE WHEN status IN ('evidenced', 'evidenced_failing') AND len(list_filter(refs, lambda r: starts_with(r, 'run:'))) = 0 THEN 'NO_RUN_EVIDENCE' END, CASE WHEN status = 'verified' AND len(list_filter(refs, lambda r: starts_with(r, 'hash:') OR starts_with(r, 'invariant:') OR starts_with(r, 'bytes:'))) = 0 THEN 'NO_HASH_OR_INVARIANT_OR_BYTES_EVIDENCE' END]) AS error FROM r "
    "UNION ALL SELECT id, 'DUPLICATE_ID' FROM r GROUP BY id HAVING count(*) > 1) SELECT DISTINCT id, error FROM e WHERE error IS NOT NULL"
)
def claim_record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-29: every rule that a claim record breaks."""
    return R.claim_record_errors(_records(spark, sf_dir))


@query(_RECORDS + "SELECT status, count(*) AS n FROM r GROUP BY 1")
def claim_ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-55: claim records by status."""
    return _records(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "WITH c AS (SELECT CASE c_custkey % 5 WHEN 0 THEN 'DeepSeek-VL2 ' WHEN 1 THEN 'qwen2-vl' WHEN 2 THEN 'LFM2-VL' WHEN 3 THEN 'liquid/x' ELSE c_name END AS m, CASE c_custkey % 7 WHEN 0 THEN ' direct' WHEN 1 THEN 'web' WHEN 2 THEN 'auto' WHEN 3 THEN '' WHEN 4 THEN 'relay' WHEN 5 THEN 'NATIVE_API' END AS t, CASE WHEN c_custkey % 2 = 0 THEN 'openai' ELSE ' ' END AS k FROM customer), "
    "f AS (SELECT CASE WHEN contains(lower(m), 'deepseek') THEN 'DEEPSEEK' WHEN contains(lower(m), 'qwen') THEN 'QWEN' WHEN contains(lower(m), 'liquid') OR contains(lower(m), 'lfm') THEN 'LIQUID_AI' ELSE 'UNKNOWN' END AS family, CASE upper(trim(coalesce(t, ''))) WHEN 'DIRECT' THEN 'DIRECT_IMAGE_API' WHEN 'NATIVE_API' THEN 'DIRECT_IMAGE_API' WHEN 'WEB' THEN 'PLATFORM_MEDIATED' WHEN 'RELAY' THEN 'RELAY' ELSE CASE WHEN k = 'openai' THEN 'DIRECT_IMAGE_API' ELSE 'UNKNOWN' END END AS transport FROM c) "
    "SELECT family, transport, count(*) AS n FROM f GROUP BY ALL"
)
def model_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-30: model families by id, and the condition under which each was reached."""
    k = F.col("c_custkey")
    m = F.when(k % 5 == 0, "DeepSeek-VL2 ").when(k % 5 == 1, "qwen2-vl").when(k % 5 == 2, "LFM2-VL").when(k % 5 == 3, "liquid/x").otherwise(F.col("c_name"))
    t = F.when(k % 7 == 0, " direct").when(k % 7 == 1, "web").when(k % 7 == 2, "auto").when(k % 7 == 3, "").when(k % 7 == 4, "relay").when(k % 7 == 5, "NATIVE_API")
    family, transport = X.model_family(m), X.transport_condition(t, F.when(k % 2 == 0, "openai").otherwise(" "))
    return read(spark, sf_dir, "customer").groupBy(family.alias("family"), transport.alias("transport")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT strftime(ts, '%Y-%m') AS month, concat(strftime(ts, '%Y%m%dT%H%M%S'), '-', substr(sha256(CAST(user_id AS VARCHAR)), 1, 8)) AS run_id FROM events) SELECT month, count(*) AS n, min(run_id) AS first_run FROM r GROUP BY month")
def run_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-48, SRC-16: run ids and their month partitions."""
    e = read(spark, sf_dir, "events").select("ts", F.sha2(F.col("user_id").cast("string"), 256).alias("env"))
    return e.select(F.date_format("ts", "yyyy-MM").alias("month"), run_id("ts", "env").alias("run_id")).groupBy("month").agg(F.count("*").alias("n"), F.min("run_id").alias("first_run"))


@query("WITH a AS (SELECT p_partkey AS k, p_size / 50.0 AS x FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN 0.123 ELSE p_size / 50.0 END AS x FROM part WHERE p_partkey % 4 <> 0), j AS (SELECT a.k IS NULL OR b.k IS NULL OR abs(CAST(a.x AS DOUBLE) - CAST(b.x AS DOUBLE)) > 1e-6 AS off FROM a FULL JOIN b USING (k)) SELECT count_if(off)::BIGINT AS findings, greatest(0.0, 1 - 0.25 * count_if(off))::DOUBLE AS score FROM j")
def reference_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-41, SP-43: two sets of rows compared with a tolerance, and the score that their differences leave."""
    p = read(spark, sf_dir, "part")
    k, x = F.col("p_partkey").alias("k"), F.col("p_size") / F.lit(50.0)
    a = p.where("p_partkey % 3 <> 0").select(k, x.alias("x"))
    b = p.where("p_partkey % 4 <> 0").select(k, F.when(F.col("p_partkey") % 10 == 0, 0.123).otherwise(x).alias("y"))
    off = F.col("x").isNull() | F.col("y").isNull() | (F.abs(F.col("x") - F.col("y")) > 1e-6)
    return a.join(b, "k", "full_outer").agg(F.count_if(off).alias("findings"), F.greatest(F.lit(0.0), 1 - 0.25 * F.count_if(off)).alias("score"))


_NATIVE = (
    "WITH t AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'INDEX' WHEN 1 THEN 'IDENTITY' WHEN 2 THEN 'OVERVIEW' WHEN 3 THEN 'LOCATE' WHEN 4 THEN 'EXACT' ELSE 'OTHER' END AS query_class, "
    "concat(CASE (conv_id * 3 + turn) % 8 WHEN 0 THEN 'I need the  binary ' WHEN 1 THEN 'first gzip it ' WHEN 2 THEN 'its SHA256: ab ' WHEN 3 THEN 'unknown ' WHEN 4 THEN '12 bytes of codec-9 ' ELSE '' END, text, CASE WHEN turn % 2 = 0 THEN ' alpha beta gamma' ELSE ' alpha' END) AS output, CASE WHEN turn % 3 = 0 THEN 'codec-9' END AS decoder, CASE WHEN turn % 5 = 0 THEN ' Codec-9' END AS declared, turn % 4 = 3 AS exact FROM conversations), "
    "u AS (SELECT *, trim(regexp_replace(upper(replace(output, 'ß', 'SS')), '\\s+', ' ', 'g')) AS o FROM t), "
    "v AS (SELECT *, round((CAST(contains(o, 'ALPHA') AS INT) + CAST(contains(o, 'BETA') AS INT) + CAST(contains(o, 'GAMMA') AS INT) + CAST(contains(o, 'DELTA Q') AS INT)) / 4, 6) AS index_rate, decoder IS NULL OR upper(trim(coalesce(declared, ''))) = 'CODEC-9' OR contains(o, 'CODEC-9') AS discovered, "
    "query_class IN ('INDEX', 'IDENTITY', 'OVERVIEW', 'LOCATE') AND (contains(o, 'NEED THE BINARY') OR contains(o, 'GZIP')) AS mechanical, CASE WHEN exact THEN '' ELSE concat_ws(',', CASE WHEN contains(o, ' BYTES') THEN 'BYTE_LAYOUT' END, CASE WHEN contains(o, 'GZIP') THEN 'COMPRESSION' END, CASE WHEN contains(o, 'SHA256:') THEN 'HASH' END) END AS unverified FROM u), "
    "w AS (SELECT *, CASE query_class WHEN 'INDEX' THEN index_rate >= 0.75 WHEN 'EXACT' THEN o <> '' WHEN 'OTHER' THEN false ELSE o <> '' AND NOT contains(o, 'UNKNOWN') END AS answered FROM v) "
    "SELECT conv_id, turn, index_rate, answered, discovered, mechanical, unverified, answered AND unverified = '' AND (query_class = 'EXACT' OR discovered AND NOT mechanical) AS pass FROM w"
)


@query(_NATIVE)
def native_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-27, SP-33, AG-56: answers by the rules of their query class: entries recovered, decoder found, what they depend on and what they can't have checked."""
    c, t = F.col("conv_id"), F.col("turn")
    lead = _ladder((c * 3 + t) % 8, [F.lit(x) for x in ("I need the  binary ", "first gzip it ", "its SHA256: ab ", "unknown ", "12 bytes of codec-9 ")], F.lit(""))
    trials = read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", _ladder((c + t) % 6, [F.lit(x) for x in ("INDEX", "IDENTITY", "OVERVIEW", "LOCATE", "EXACT")], F.lit("OTHER")).alias("query_class"),
        F.concat(lead, "text", F.when(t % 2 == 0, " alpha beta gamma").otherwise(" alpha")).alias("output"), F.array(*[F.lit(x) for x in ("alpha", "beta", "Gamma", "delta q")]).alias("expected"),
        F.when(t % 3 == 0, "codec-9").alias("decoder"), F.when(t % 5 == 0, " Codec-9").alias("declared"), (t % 4 == 3).alias("exact"),
    )
    return R.native_evaluation(trials).select("conv_id", "turn", "index_rate", "answered", "discovered", "mechanical", "unverified", "pass")


@query("SELECT c_custkey, concat('ens_', c_custkey % 3, '=a,', 'ens_', 3 + c_custkey % 2, '=c') AS members FROM customer")
def ensemble_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-59: the context's entries of an ensemble, by their prefix, in order."""
    k = F.col("c_custkey")
    ctx = F.create_map(F.concat(F.lit("ens_"), (k % 3).cast("string")), F.lit("a"), F.lit("other"), F.lit("b"), F.concat(F.lit("ens_"), (3 + k % 2).cast("string")), F.lit("c"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(R.member_inputs(ctx, "ens_"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("members"))


@query(
    "WITH w AS (SELECT s_nationkey AS plan, s_suppkey AS worker_id, s_suppkey % 4 <> 0 AS model, s_suppkey % 3 = 0 AS deterministic, s_suppkey % 5 * 400000000 AS params, s_nationkey % 2 = 0 AS abstention FROM supplier) "
    "SELECT CAST(plan AS INTEGER) AS plan, worker_id, 'CHECK_CALIBRATION' AS advice FROM w WHERE abstention AND model AND NOT deterministic UNION ALL SELECT plan, worker_id, 'LARGE_WORKER' FROM w WHERE params > 1000000000"
)
def worker_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP-61: what to look at before a plan's workers run."""
    k = F.col("s_suppkey")
    w = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("plan"), k.alias("worker_id"), F.when(k % 4 != 0, "MODEL").otherwise("RULES").alias("engine"), (k % 3 == 0).alias("deterministic"), (k % 5 * 400_000_000).alias("params"), (F.col("s_nationkey") % 2 == 0).alias("abstention"))
    return R.advisories(w)
