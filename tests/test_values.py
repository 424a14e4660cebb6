"""Worked-out values and properties of the operators."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quarryline.functions import numeric as N
from quarryline.functions import text as X
from quarryline.operators import checks, claims, comparison, gates, graphs, grounding, integrity, ledger, ordering, retrieval, scoring
from quarryline.sources import stores
from quarryline.streaming import appends


def test_calibration_values(spark):
    p = spark.createDataFrame([(0.9, True), (0.8, True), (0.9, False)], "confidence double, correct boolean").selectExpr("confidence", "correct", "'in' AS slice", "false AS abstained")
    r = scoring.calibration(p).first()
    assert (r["accuracy"], r["coverage"]) == (round(2 / 3, 6), 1.0) and abs(r["brier"] - (0.01 + 0.04 + 0.81) / 3) < 1e-6
    ece = scoring.calibration_error(p, 2).first()["ece"]
    assert abs(ece - abs(2.6 / 3 - 2 / 3)) < 1e-6
    curve = {r["threshold"]: (r["coverage"], r["accuracy"]) for r in scoring.abstention_curve(p, [0.5, 0.85, 0.95]).collect()}
    assert curve == {0.5: (1.0, round(2 / 3, 6)), 0.85: (round(2 / 3, 6), 0.5), 0.95: (0.0, 0.0)}
    assert scoring.confidence_floor(scoring.abstention_curve(p, [0.5]), 0.9).first()["floor"] == 1.01


def test_pairwise_values(spark):
    rows = [("a", f"q{i}", x) for i, x in enumerate([True, False, True, True])] + [("b", f"q{i}", x) for i, x in enumerate([True, False, False, True])]
    rows = [("a", "q0", True), ("a", "q1", True), ("a", "q2", False), ("a", "q3", False), ("b", "q0", True), ("b", "q1", False), ("b", "q2", True), ("b", "q3", False)]
    r = ledger.pairwise(spark.createDataFrame(rows, "profile string, case_key string, pass boolean")).first()
    assert (r["shared"], r["both_pass"], r["both_fail"], r["a_recovered"], r["b_recovered"], r["failure_union"]) == (4, 1, 1, 1, 1, 3)
    assert (r["overlap"], r["complementarity"], r["oracle"]) == (0.333333, 0.666667, 0.75)


def test_weights_sum_to_one(spark):
    cols = "event_id long, stage string, failure_code string, layer string, model_id string, specimen_id string, question_id string"
    f = spark.createDataFrame([(1, "T2_NAVIGATION", "T2_NOT_FOUND", "P", "m", "s", "Q1")], cols)
    w = {r["mutation"]: r["weight"] for r in ledger.exploration_weights(f).collect()}
    assert abs(sum(w.values()) - 1) < 1e-4 and all(v > 0 for v in w.values()) and max(w, key=w.get) == "LAYOUT"
    none = {r["mutation"]: r["weight"] for r in ledger.exploration_weights(f.limit(0)).collect()}
    assert len(set(none.values())) == 1


def test_fixpoint_is_synchronous(spark):
    cells = spark.createDataFrame([("A", "ON"), ("B", "OFF")], "cell string, state string")
    swap = spark.createDataFrame([("r1", "A", "ON", "OFF"), ("r2", "B", "OFF", "ON")], "rule string, target string, from_state string, to_state string")
    need = spark.createDataFrame([("r1", "B", "OFF"), ("r2", "A", "ON")], "rule string, cell string, state string")
    assert {r["cell"]: r["state"] for r in graphs.rule_fixpoint(cells, swap, need).collect()} == {"A": "OFF", "B": "ON"}
    clash = spark.createDataFrame([("r1", "A", "ON", "OFF"), ("r2", "A", "ON", "DEAD")], swap.schema)
    with pytest.raises(graphs.ConflictingWrites):
        graphs.rule_fixpoint(cells, clash, need.limit(0))
    with pytest.raises(ValueError):
        graphs.rule_fixpoint(cells, swap, spark.createDataFrame([("r1", "Z", "ON")], need.schema))
    blink = spark.createDataFrame([("r1", "A", "ON", "OFF"), ("r2", "A", "OFF", "ON")], swap.schema)
    with pytest.raises(ValueError):
        graphs.rule_fixpoint(cells, blink, need.limit(0), most=3)


def test_levels_leave_cycles_out(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "node long")
    edges = spark.createDataFrame([(1, 2), (3, 4), (4, 3)], "src long, dst long")
    assert {r["node"]: r["level"] for r in graphs.levels(nodes, edges).collect()} == {1: 0, 2: 1}


def test_merkle_equals_a_plain_tree(spark):
    hashes = [hashlib.sha256(str(i).encode()).digest() for i in range(13)]
    level = hashes
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
    rows = spark.createDataFrame([(i, h.hex()) for i, h in enumerate(hashes)], "idx long, hash string")
    levels = integrity.merkle_levels(rows)
    assert levels[-1].first()["hash"] == level[0].hex()
    proof = integrity.merkle_proof(levels, 12)
    ok = spark.createDataFrame([(hashes[12].hex(), proof), (hashes[3].hex(), proof)], "leaf string, proof array<struct<side:string,hash:string>>")
    assert [r["v"] for r in ok.select(integrity.verified(F.col("leaf"), F.col("proof"), F.lit(level[0].hex())).alias("v")).collect()] == [True, False]


def test_merkle_proofs_of_all_leaves(spark, tmp_path):
    from quarryline.plans import integrity as plans

    for n in (1, 3, 13):
        hashes = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        want, level, at = [[] for _ in hashes], hashes, list(range(n))
        while len(level) > 1:
            for i, k in enumerate(at):
                want[i].append(("L" if k % 2 else "R", level[k - 1 if k % 2 else min(k + 1, len(level) - 1)].hex()))
            level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
            at = [k // 2 for k in at]
        levels = integrity.merkle_levels(spark.createDataFrame([(i, h.hex()) for i, h in enumerate(hashes)], "idx long, hash string"))
        got = {r["idx"]: (r["leaf"], [tuple(x) for x in r["proof"]]) for r in integrity.merkle_proofs(levels).collect()}
        assert got == {i: (h.hex(), want[i]) for i, h in enumerate(hashes)}
    spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(map(tuple, plans.merkle_proofs(spark, str(tmp_path)).collect()))
    assert rows == [(i, 3, True, False) for i in range(5)]


def test_places_across_ranges(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k"))
    got = {r["id"]: r["place"] for r in ordering.placed(rows, F.desc("k"), "id").collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 7), i)))}
    assert ordering.placed(rows.limit(0), "id", name="idx", first=0).columns == ["id", "k", "idx"]


def test_segments_give_the_page_back(spark):
    pages = [(1, "TITLE\n\nfirst line\nsecond\n\n    code\n    more\n\nend"), (2, "\n".join(f"l{i}" for i in range(30)) + "\n"), (3, "x")]
    cut = retrieval.segments(spark.createDataFrame(pages, "page_id long, text string"))
    for i, text in pages:
        own = cut.where(F.col("page_id") == i).orderBy("block").collect()
        assert "".join(r["text"] for r in own) == text and all(r["n_lines"] <= 12 for r in own)


def test_packing_skips_what_does_not_fit(spark):
    hits = spark.createDataFrame([(1, "a", 5), (2, "b", 9), (3, "a", 1), (4, "c", 4), (5, "d", 1)], "block_id long, cid string, cost long")
    got = [r["block_id"] for r in retrieval.packed(hits, 10, 5, [F.col("block_id")]).orderBy("rank").collect()]
    assert got == [1, 4, 5]


def test_claims(spark):
    cols = "candidate_id string, subject string, predicate string, object string, polarity boolean, confidence double, address string, cid string"
    rows = [("1", "A", "is", "x", True, 0.5, "p", "c"), ("2", " a ", "IS", "X", True, 0.7, "p", "c"), ("3", "a", "is", "y", False, 0.7, "q", ""), ("4", "", "is", "y", True, 0.1, "q", ""), ("5", "a", "is", "x", True, 2.0, "q", "")]
    d = spark.createDataFrame(rows, cols)
    assert {r["candidate_id"]: r["decision"] for r in claims.decisions(d).collect()} == {"1": "ACCEPTED", "2": "MERGED", "3": "ACCEPTED", "4": "REJECTED", "5": "REJECTED"}
    assert claims.metrics(claims.decisions(d.limit(0))).first()["uncertainty"] == 1.0
    assert claims.fused_single(d.where("candidate_id IN ('1', '3')")).first()["status"] == "CONFLICT"


@pytest.mark.parametrize(
    "answer,evidence,verdict",
    [
        ("The valve opens at 40 degrees.", "The valve opens at 40 degrees. It is red.", "SUPPORTED"), ("The valve opens at 50 degrees.", "The valve opens at 40 degrees.", "CONTRADICTED"),
        ("The valve does not open at 40 degrees.", "The valve opens at 40 degrees.", "CONTRADICTED"), ("All valves open slowly today.", "Never valves open slowly today.", "CONTRADICTED"),
        ("Pressure increases before start.", "Pressure decreases before start.", "CONTRADICTED"), ("Whales sing in winter.", "The valve opens at 40 degrees.", "UNKNOWN"), ("", "x", "INSUFFICIENT"),
        ("It costs 2.50 today.", "It costs 2,5 today.", "SUPPORTED"), ("Filter be by pump", "Filter pump", "SUPPORTED"), ("It shows -5 degrees", "It shows 5 degrees", "CONTRADICTED"),
        ("It shows -05.0 degrees", "It shows -5 degrees", "SUPPORTED"),
    ],
)
def test_grounding(spark, answer, evidence, verdict):
    d = spark.createDataFrame([(1, answer, evidence)], "id long, answer string, evidence string")
    assert grounding.verdicts(d).first()["verdict"] == verdict


def test_grounding_confidence(spark):
    rows = [
        (1, "The valve opens at 40 degrees", "The valve opens at 40 degrees", 1.0), (2, "The valve opens at 50 degrees", "The valve opens at 40 degrees", 1.0), (3, "Whales sing", "The valve opens", 0.0), (4, "", "x", 0.0),
        (5, "The valve opens at 40 degrees. Whales sing", "The valve opens at 40 degrees", 0.5), (6, "The valve opens slowly tonight", "The valve opens", 0.5),
    ]
    d = spark.createDataFrame(rows, "id long, answer string, evidence string, want double")
    got = {r["id"]: r["confidence"] for r in grounding.verdicts(d).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_amplitudes_cancel(spark):
    b = spark.createDataFrame([(1, "A", 0.5, 0.0), (1, "A", -0.5, 0.0), (2, "A", 1.0, 0.0), (2, "B", 1.0, 0.0)], "state_id long, label string, re double, im double")
    s = graphs.interfered(b)
    assert s.where("state_id = 1").count() == 0
    m = spark.createDataFrame([("A", "D", 1.0, 0.0), ("B", "E", 1.0, 0.0)], "label string, to_label string, m_re double, m_im double")
    p = {r["label"]: round(r["p"], 9) for r in graphs.probabilities(graphs.transformed(s, m)).collect()}
    assert p == {"D": 0.5, "E": 0.5}


def test_scalar_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(N.ratio(F.lit(1), F.lit(0), 1.0)) == 1.0 and get(N.hamming(F.lit("0110"), F.lit("0011"))) == 2
    assert get(N.nearest_rank(F.array(*[F.lit(i) for i in range(1, 11)]), 0.95)) == 10
    assert abs(get(N.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) - 0.5**0.5) < 1e-12 and get(N.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0)))) == 0.0
    assert get(X.block_kind(F.lit("A HEADING\ntext"))) == "heading" and get(X.block_kind(F.lit("  "))) == "whitespace" and get(X.block_kind(F.lit("plain words here"))) == "text"
    assert get(X.slug(F.lit("  Héllo, Wörld! "))) == "héllo-wörld" and get(X.token_estimate(F.lit("abcde"))) == 2
    assert get(checks.json_object(F.lit('say {"a": {"b": 1}} now'))) == '{"a": {"b": 1}}'


def test_gates_and_ensemble(spark):
    q = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.5)], "member string, q double")
    pairs = spark.createDataFrame([("a", "b", 0.0), ("a", "c", 1.0), ("b", "c", 0.1)], "a string, b string, c double")
    assert gates.ensemble(q, pairs, 2) == ["a", "c"]


def test_ledger_store_is_idempotent(spark, tmp_path):
    e = spark.createDataFrame([("1", "OBSERVATION"), ("2", "CHANGE"), ("2", "CHANGE")], "event_id string, kind string")
    path = str(tmp_path / "ledger")
    assert stores.append_ledger(e, path) == 2 and stores.append_ledger(e, path) == 0
    assert spark.read.parquet(path).count() == 2


def test_ledger_files_are_checked(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"kind": "CHANGE", "event_id": "wrong"}')
    with pytest.raises(Exception, match="content id"):
        stores.read_ledger(spark, str(tmp_path)).collect()
    (tmp_path / "a.json").write_text("{broken")
    with pytest.raises(Exception):
        stores.read_ledger(spark, str(tmp_path)).collect()


def test_campaign_reader_and_import(spark, tmp_path):
    (tmp_path / "c.json").write_text(
        '{"benchmark_id": "b", "trials": [{"id": "t1", "model_id": "real-1", "condition": "NATIVE", "specimen": {"id": "s", "sha256": "x"}, "responses": [{"question_id": "Q1", "text": "A, B and C"}, {"question_id": "Q1", "text": "none"}, {"question_id": "Q2", "text": "a active"}]},'
        ' {"id": "t2", "model_id": "REPLACE_WITH_REAL_MODEL_ID", "condition": "NATIVE", "responses": []}]}'
    )
    trials, responses = stores.read_campaign(spark, str(tmp_path / "c.json"))
    r = scoring.evaluated(trials.select("trial"), responses)
    got = {(x["trial"], x["question"]): x["pass"] for x in r.collect()}
    assert len(got) == 18 and not got["t1", "Q1"] and got["t1", "Q2"]  # the last response to Q1 counts
    obs = stores.observations(r, trials)
    assert obs.count() == 9 and obs.select("event_id").distinct().count() == 9


def test_reports_runs_and_objects(spark, tmp_path):
    stores.write_report_csv(spark.createDataFrame([(1, 0.5, None)], "a int, b double, c double").coalesce(1), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_text().split() == ["a,b,c", "1,0.500000,"]
    runs = spark.sql("SELECT 'r1' AS run_id, timestamp'2024-05-06 01:02:03' AS observed_at")
    stores.append_runs(runs, str(tmp_path / "runs"))
    assert (tmp_path / "runs" / "month=2024-05").exists()
    with pytest.raises(ValueError):
        stores.append_runs(runs, str(tmp_path / "runs"))
    data = spark.createDataFrame([("x",), ("x",), ("y",)], "data string").withColumn("cid", F.sha2("data", 256))
    stores.write_objects(data, str(tmp_path / "objects"))
    cid = hashlib.sha256(b"y").hexdigest()
    assert stores.read_object(spark, str(tmp_path / "objects"), cid).first()["data"] == "y"


def test_stream_guard_and_lifecycle(spark, tmp_path):
    def ran(run, rows, schema, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        return {r[0]: r for r in run(stream, str(tmp_path / f"{name}-state"), str(tmp_path / f"{name}-offsets")).collect()}

    guard = lambda s, p, c: appends.guarded(s, p, c, 3)
    got = ran(guard, [("k", i, f"line {i}") for i in range(4)] + [("j", 0, "a"), ("j", 1, "b")], "key string, seq long, line string", "chunks")
    assert {k: (r["n_chunks"], r["degenerate"]) for k, r in got.items()} == {"k": (4, True), "j": (2, False)}
    # what comes later meets what was kept
    got = ran(guard, [("j", 2, "b"), ("j", 3, "b"), ("i", 9000, "x")], "key string, seq long, line string", "chunks")
    assert {k: (r["n_chunks"], r["degenerate"]) for k, r in got.items()} == {"k": (4, True), "j": (4, True), "i": (1, False)}
    rows = [("w", True, 1), ("w", True, 2), ("w", False, 3), ("w", False, 4), ("w", True, 5), ("v", True, 1)]
    r = ran(appends.lifecycle, rows, "worker string, pass boolean, seq long", "moves")
    assert (r["w"]["phase"], r["w"]["moves"], r["v"]["phase"]) == ("RETIRED", 4, "SHADOW")
    r = ran(appends.lifecycle, [("v", True, 6), ("w", True, 7)], "worker string, pass boolean, seq long", "moves")
    assert (r["w"]["phase"], r["w"]["moves"], r["v"]["phase"], r["v"]["moves"]) == ("RETIRED", 4, "ACTIVE", 2)


def test_folds_keep_the_order_whatever_the_ranges(spark, monkeypatch):
    monkeypatch.setattr(appends, "WIDTH", 3)
    rows = [("a", 10 * i, f"{i}") for i in range(40)] + [("b", -7, "z"), ("b", -8, "y")]
    df = spark.createDataFrame(rows, "k string, at long, v string").repartition(5)
    got = {r["k"]: r["v"] for r in appends.folded(df, "k", "at", "v", lambda vs: F.array_join(vs, ",")).collect()}
    assert got == {"a": ",".join(str(i) for i in range(40)), "b": "y,z"}
    assert appends.folded(df.limit(0), "k", "at", "v", lambda vs: F.array_join(vs, ",")).count() == 0


def test_cycles_and_missing_producers_raise(spark):
    nodes = spark.createDataFrame([(i, 1) for i in range(4)], "node long, cost long")
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (2, 3)], "src long, dst long")
    assert {r["node"] for r in graphs.levels(nodes, ring).collect()} == {0}
    with pytest.raises(graphs.Cyclic):
        graphs.critical_path(nodes, ring)
    makes = spark.createDataFrame([("p", "a", 0), ("q", "b", 1), ("q", "c", 0), ("r", "d", 0)], "product string, worker string, rank int")
    needs = spark.createDataFrame([("a", "q"), ("c", "r"), ("b", "nothing")], "worker string, product string")
    goal = spark.createDataFrame([("g", "p")], "goal string, product string")
    assert {(r["worker"], r["depth"]) for r in graphs.resolved(goal, needs, makes).collect()} == {("a", 0), ("c", 1), ("d", 2)}
    had = spark.createDataFrame([("q",)], "product string")
    assert {r["worker"] for r in graphs.resolved(goal, needs, makes, had).collect()} == {"a"}
    with pytest.raises(graphs.MissingProducer):
        graphs.resolved(goal, needs.unionAll(spark.createDataFrame([("d", "s")], needs.schema)), makes)
    with pytest.raises(graphs.Cyclic):
        graphs.resolved(goal, needs.unionAll(spark.createDataFrame([("d", "p")], needs.schema)), makes)


def test_goals_deeper_than_any_bound(spark):
    chain = spark.range(1, 13)
    makes = chain.selectExpr("id AS product", "id AS worker", "0 AS rank")
    needs = chain.where("id > 1").selectExpr("id AS worker", "id - 1 AS product")
    goal = spark.createDataFrame([(0, 12)], "goal long, product long")
    assert {r["worker"]: r["depth"] for r in graphs.resolved(goal, needs, makes).collect()} == {i: 12 - i for i in range(1, 13)}


@pytest.mark.parametrize("code,kinds", [("CODEC_NOT_FOUND", "PROMPT LAYOUT CHANNEL_ROLE REDUNDANCY"), ("CAPABILITY_MISMATCH", "PROMPT CHANNEL_ROLE REDUNDANCY"), ("CHECKPOINT_NOT_FOUND", "TEMPORAL_STRUCTURE LAYOUT REDUNDANCY PROMPT"), ("UNAUTHORIZED_SEMANTIC_DRIFT", "PROMPT LAYOUT REDUNDANCY PRIMITIVE")])
def test_every_target_keeps_its_mass(spark, code, kinds):
    cols = "event_id long, stage string, failure_code string, layer string, model_id string, specimen_id string, question_id string"
    f = spark.createDataFrame([(1, "BOOT", code, "P", "m", "s", "Q1")], cols)
    w = {r["mutation"]: r["weight"] for r in ledger.exploration_weights(f).collect()}
    assert sorted(w, key=w.get, reverse=True)[: len(kinds.split())] == kinds.split() and abs(sum(w.values()) - 1) < 1e-4
    history = spark.createDataFrame([("PROMPT", 9.0)], "mutation string, mean double")
    swung = {r["mutation"]: r["weight"] for r in ledger.exploration_weights(f, history).collect()}
    base = lambda x: (x["PROMPT"] - 0.15 / 11) / (x["REDUNDANCY"] - 0.15 / 11)
    assert abs(base(swung) / base(w) - 1.25) < 1e-3  # outcomes move a kind by a quarter at most
    assert [r["field"] for r in ledger.suggestions(f, ledger.exploration_weights(f)).collect()][0] == ledger.CODE_TARGET[code]


def test_families_and_transport(spark):
    rows = [("DeepSeek-VL", "auto", "x"), ("my-LFM2", None, ""), ("gpt", "Web", ""), ("QWEN2", "relay", None)]
    r = spark.createDataFrame(rows, "m string, t string, k string").select(X.model_family(F.col("m")), X.transport_condition(F.col("t"), F.col("k"))).collect()
    assert [tuple(x) for x in r] == [("DEEPSEEK", "DIRECT_IMAGE_API"), ("LIQUID_AI", "UNKNOWN"), ("UNKNOWN", "PLATFORM_MEDIATED"), ("QWEN", "RELAY")]


def test_containment_in_blocks(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, [])], "doc_id long, t array<string>")
    items = spark.createDataFrame([(10, ["a", "b"]), (11, ["c", "x", "y"]), (12, ["a"])], "item_id long, t array<string>")
    want = {(10, 1, 1.0), (12, 1, 1.0), (10, 2, 0.5), (12, 2, 1.0)}
    for block in (1_000_000, 2):
        assert {(r["item_id"], r["doc_id"], r["share"]) for r in comparison.contained(docs, items, 0.5, block).collect()} == want
    asked = spark.createDataFrame([("q", "a"), ("q", "b"), ("p", "z")], "question string, term string")
    pages = spark.createDataFrame([(5, "a"), (4, "a"), (4, "b"), (3, "a"), (3, "b")], "page long, term string")
    for block in (1_000_000, 1):
        assert [tuple(r) for r in comparison.best_overlap(asked, pages, block).collect()] == [("q", 3, 2)]


def test_module_packing(spark):
    rows = [("p", "a", 9, True, 6, 2), ("p", "b", 8, False, 6, 3), ("p", "c", 7, True, 5, 4), ("p", "d", 6, False, 1, 1)]
    d = spark.createDataFrame(rows, "pack string, module string, priority int, required boolean, full int, small int")
    assert tuple(checks.module_packing(d, 10).first()) == ("p", "a:FULL,b:MIN,c:ERROR,d:FULL", 10)


def test_closed_loop(spark):
    cols = "event_id long, kind string, evidence_class string, candidate_id string, question_id string, score double, pass boolean, stage string, failure_code string, layer string, model_id string, specimen_id string"
    scores = {"c0": (0.4, 0.5), "c1": (0.6, 0.5), "c2": (0.9, 0.1), "c3": (0.7, 0.8), "c4": (0.61, 0.5)}
    rows = [(10 * i + k, "OBSERVATION", "REAL_MODEL", c, f"q{k}", x, x >= 0.65, "BOOT", "T2_NOT_FOUND", "P", "m", "s") for i, (c, xs) in enumerate(scores.items()) for k, x in enumerate(xs)]
    trials = spark.createDataFrame(rows, cols)
    changes = spark.createDataFrame([("c1", "LAYOUT"), ("c2", "PROMPT"), ("c3", "DEPTH_STRUCTURE"), ("c4", "DEPTH_STRUCTURE")], "candidate_id string, mutation string")
    log = checks.closed_loop(trials, changes, "c0", 5)
    # LAYOUT and PROMPT come first for this code; c2 loses a question, so c1 advances; then c3, which has no failure left
    assert [(r["before"], r["selected"], r["incumbent"], r["event"], r["remaining"]) for r in log] == [("c0", "c1,c2", "c1", "ADVANCED", 2), ("c1", "c3,c4", "c3", "ADVANCED", 0)]
    assert [r["event"] for r in checks.closed_loop(trials, changes, "c3", 5)] == ["INCUMBENT_NO_ACTIVE_FAILURES"]
    assert [r["event"] for r in checks.closed_loop(trials, changes, "zz", 5)] == ["INCUMBENT_EXECUTION_UNAVAILABLE"]
    assert [r["event"] for r in checks.closed_loop(trials, changes.limit(0), "c0", 5)] == ["NO_ELIGIBLE_CANDIDATES"]
    assert checks.closed_loop(trials, changes, "c0", 5, least=5.0)[0]["event"] == "KEPT"
    assert checks.loop_table(spark, log).count() == 2


def test_classes_by_model_or_rules(spark):
    rows = [("define x", "process", 0.9, "ANSWERED"), ("define x", "process", 0.9, "UNKNOWN"), ("define x", "process", 0.6, None), ("define x", "process", 0.7, None), ("hm", None, None, None)]
    got = [(r["class"], r["confidence"], r["method"], r["model_rejected"]) for r in scoring.classified(spark.createDataFrame(rows, "question string, model_class string, model_confidence double, calibration string")).collect()]
    assert got == [("process", 0.9, "model", None), ("definition", 0.8, "rules", "calibration:UNKNOWN"), ("definition", 0.8, "rules", "uncalibrated-low-confidence"), ("process", 0.7, "model", None), ("general", 0.3, "rules", "unreachable")]


def test_percentiles_by_counts(spark):
    d = spark.createDataFrame([("k", float(v)) for v in [5, 1, 1, 1, 9, 2, 2, 7, 7, 3]], "key string, value double")
    own = sorted([5, 1, 1, 1, 9, 2, 2, 7, 7, 3])
    r = scoring.percentiles(d, "key", "value").first()
    assert (r["n"], r["p50"], r["p95"]) == (10, own[int(9 * 0.5 + 0.999999)], own[int(9 * 0.95 + 0.999999)])


def test_debug_footer(spark):
    text = 'the answer\nDEBUG_TRACE_R0=```json\n{"schema": "r0", "status": "PASS", "last_completed_stage": "BOOT", "failure_code": "T2_NOT_FOUND", "confidence": 2.0}\n```'
    answer, trace = checks.parse_debug(F.lit(text))
    r = spark.range(1).select(answer.alias("a"), trace.alias("t")).select("a", checks.debug_violations(F.col("t")).alias("v")).first()
    assert tuple(r) == ("the answer", "PASS_WITH_CODE,CONFIDENCE")
