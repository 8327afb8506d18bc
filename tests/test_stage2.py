import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracebraid.functions.expressions import is_loadgen, normalize_service
from tracebraid.operators import adjudication, evaluation, evidence, incident, masking, metrics, reports
from tracebraid.operators.graph import reachable
from tracebraid.schemas import CAUSAL, MASKED, OBSERVED
from tracebraid.sources.telemetry import Telemetry

EV = "case_id string, pos long, evidence_id string, node string, kind string, signal string, abnormality double, ts_s double, text string"
EDGE = "case_id string, pos long, source string, relation string, target string"
PAIR = "case_id string, source string, target string"
NODE = "case_id string, node string, rank long"


def ev(spark, *rows, case="c"):
    return spark.createDataFrame([(case, i + 1, f"e{i + 1}", n, "trace", "x", float(a), None if t is None else float(t), "") for i, (n, a, t) in enumerate(rows)], EV)


def edges(spark, *pairs, relation=OBSERVED, case="c"):
    return spark.createDataFrame([(case, i, s, relation, t) for i, (s, t) in enumerate(pairs)], EDGE)


def nodes(spark, *names, case="c"):
    return spark.createDataFrame([(case, n, i + 1) for i, n in enumerate(names)], NODE)


def chain(spark):
    known = edges(spark, ("ts-db", "ts-worker"), ("ts-worker", "ts-api"), ("ts-other", "ts-api"), ("ts-cache", "ts-other"))
    return known, ev(spark, ("ts-db", 0.95, 1), ("ts-worker", 0.9, 2), ("ts-api", 0.98, 3), ("ts-other", 0.1, 2), ("ts-cache", 0.05, 1)), nodes(spark, "ts-api")


def cases(spark, *names):
    return spark.createDataFrame([(n,) for n in names or ("c",)], "case_id string")


def pairs_of(df):
    return {(r["source"], r["target"]) for r in df.collect()}


@pytest.mark.parametrize("logic", [None, incident.soft_logic, incident.psl])
def test_chain_is_found(spark, logic):
    known, e, s = chain(spark)
    _, found, roots = incident.predict(known, e, s, logic=logic)
    assert pairs_of(found) == {("ts-db", "ts-worker"), ("ts-worker", "ts-api")}
    assert roots.filter("rank = 1").first()["node"] == "ts-db"


def test_scores_of_a_hypothesis(spark):
    known, e, _ = chain(spark)
    h = {(r["source"], r["target"]): r for r in incident.causal_hypotheses(known, e).collect()}
    r = h["ts-db", "ts-worker"]
    assert (r["temporal_score"], r["anomaly_score"]) == (1.0, 0.9) and r["abductive_score"] == pytest.approx(0.55 + 0.405)
    assert h["ts-cache", "ts-other"]["temporal_score"] == 0.0


def test_delay_buckets(spark):
    df = spark.createDataFrame([(0.0, t) for t in (-1.0, 0.0, 5.0, 6.0, 30.0, 120.0, 121.0, None)], "a double, b double")
    assert [r[0] for r in df.select(incident.temporal_score(F.col("a"), F.col("b"))).collect()] == [0, 1, 1, 0.8, 0.8, 0.55, 0.2, 0]


def test_pairs_need_evidence_and_are_not_truncated(spark):
    known = edges(spark, *[(f"a{i}", "b") for i in range(80)], ("x", "b"))
    e = ev(spark, *[(f"a{i}", 0.9, 1) for i in range(80)], ("b", 0.9, 2))
    assert incident.causal_hypotheses(known, e).count() == 80
    assert incident.causal_hypotheses(known, e, most=7).count() == 7
    with pytest.raises(ValueError):
        incident.causal_hypotheses(known, e, most=0)


def test_soft_logic_against_plain_loop(spark):
    rng = np.random.default_rng(4)
    names = [f"n{i}" for i in range(9)]
    known = edges(spark, *[(names[a], names[b]) for a, b in {tuple(rng.integers(0, 9, 2)) for _ in range(25)} if a != b])
    e = ev(spark, *[(n, rng.random(), rng.integers(0, 60)) for n in names])
    h = incident.causal_hypotheses(known, e)
    got = {(r["source"], r["target"]): r["soft_logic_score"] for r in incident.soft_logic(h, known, nodes(spark, "n0", "n1")).collect()}
    local = {(r["source"], r["target"]): r["l"] for r in h.select("source", "target", incident.local_score().alias("l")).collect()}
    reach = dict.fromkeys(names, 0.0) | {"n0": 1.0, "n1": 1.0}
    for _ in range(20):
        reach = {n: max([reach[n], *(w * reach[b] for (a, b), w in local.items() if a == n)]) for n in names}
    for (a, b), w in local.items():
        assert got[a, b] == pytest.approx(max(0, min(1, 0.82 * w + 0.18 * min(w, reach[b]))), abs=1e-5)


def test_global_inference_is_the_minimum():
    rng = np.random.default_rng(0)
    source, target = np.array([0, 1, 1]), np.array([1, 2, 0])
    symptom = np.array([False, False, True])
    for _ in range(4):
        t, a = rng.random(3), rng.random(3)
        c = incident.solve_global(t, a, None, None, source, target, [], symptom)

        def loss(c, r, t=t, a=a):
            h = lambda x: max(0.0, x) ** 2
            out = sum(1.2 * h(t[i] - c[i]) + 1.1 * h(a[i] - c[i]) + 0.8 * h(c[i] - t[i]) + 1.2 * h(c[i] - a[i]) + 0.25 * c[i] ** 2 for i in range(3))
            out += sum(1.6 * h(c[i] + r[target[i]] - 1 - r[source[i]]) + 0.8 * h(t[i] + r[target[i]] - 1 - c[i]) for i in range(3))
            return out + 2 * 0.5 * h(c[0] + c[2] - 1)

        best = min(loss(c, (x, y, 1.0)) for x in np.linspace(0, 1, 41) for y in np.linspace(0, 1, 41))
        for step in itertools.product((-0.05, 0, 0.05), repeat=3):
            moved = np.clip(c + np.array(step), 0, 1)
            assert best <= min(loss(moved, (x, y, 1.0)) for x in np.linspace(0, 1, 11) for y in np.linspace(0, 1, 11)) + 2e-3


def test_fallback_root_without_edges(spark):
    e = ev(spark, ("seat", 0.95, 1), ("gateway", 0.99, 3), ("route", 0.2, 2))
    _, found, roots = incident.predict(edges(spark).limit(0), e, nodes(spark, "gateway"))
    assert roots.orderBy("rank").first()["node"] == "seat" and found.count() == 0


def test_visible_causal_edges_stay(spark):
    known, e, s = chain(spark)
    known = known.withColumn("relation", F.when(F.col("source") == "ts-cache", CAUSAL).otherwise(F.col("relation")))
    assert ("ts-cache", "ts-other") in pairs_of(incident.predict(known, e, s)[1])
    only = incident.graph_only_roots(e, s)
    assert [r["node"] for r in only.orderBy("rank").collect()] == ["ts-db", "ts-worker", "ts-other"]


def test_roots_are_sources_and_no_symptoms(spark):
    """a -> b -> d with symptom d, and evidence at z that no edge touches."""
    known = edges(spark, ("a", "b"), ("b", "d"), relation=CAUSAL)
    e = ev(spark, ("a", 0.6, 1), ("b", 0.8, 2), ("d", 0.9, 3), ("z", 0.95, 9))
    found = incident.predict(known, e, nodes(spark, "d"))[2].orderBy("rank").collect()
    assert [r["node"] for r in found] == ["a", "b"]
    # a: earliest of the two, nothing comes in; b: latest of the two, a's edge comes in.
    assert [round(r["score"], 6) for r in found] == [round(0.38 + 0.30 * 0.6 + 0.20 + 0.12, 6), round(0.38 + 0.30 * 0.8, 6)]
    assert [r["node"] for r in incident.graph_only_roots(e, nodes(spark, "d")).orderBy("rank").collect()] == ["z", "b", "a"]


def test_without_a_source_that_is_no_symptom_evidence_ranks(spark):
    e = ev(spark, ("d", 0.9, 3), ("x", 0.7, 1), ("y", 0.6, 2))
    found = incident.predict(edges(spark, ("d", "x"), relation=CAUSAL), e, nodes(spark, "d"))[2].orderBy("rank").collect()
    assert [r["node"] for r in found] == ["x", "y"]


def test_scores_are_ranked_as_they_are(spark):
    e = ev(spark, ("p", 0.6, 1), ("q", 0.6 + 1e-10, 1))
    found = incident.rank_by_evidence(e, nodes(spark, "none")).orderBy("rank").collect()
    assert [r["node"] for r in found] == ["q", "p"]


def test_normalised_names(spark):
    names = ["TS-Order-Service", " svc:ts-a_b", "service/x", "tsx", "ts-load-gen", "LoadGen_1"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(normalize_service("n"), is_loadgen("n")).collect()
    assert [r[0] for r in got] == ["orderservice", "ab", "x", "tsx", "loadgen", "loadgen1"] and [r[1] for r in got] == [False] * 4 + [True, True]


def test_empty_sets_score_one(spark):
    none = spark.createDataFrame([], PAIR)
    r = metrics.edge_prf(none, none, cases(spark)).first()
    assert (r["precision"], r["recall"], r["f1"]) == (1, 1, 1)
    r = metrics.root_prf(nodes(spark).limit(0), nodes(spark).limit(0), cases(spark)).first()
    assert r["f1"] == 1


def test_roots_alone_count_as_nodes(spark):
    none = spark.createDataFrame([], PAIR)
    r = metrics.node_prf(none, none, cases(spark), nodes(spark, "ts-seat"), nodes(spark, "seat")).first()
    assert r["f1"] == 1


def test_loadgen_pairs_are_ignored(spark):
    p = spark.createDataFrame([("c", "TS-Order-Service", "ts-api"), ("c", "loadgen", "api")], PAIR)
    g = spark.createDataFrame([("c", "order_service", "api")], PAIR)
    assert metrics.edge_prf(p, g, cases(spark)).first()["f1"] == 1


def test_reachability(spark):
    e = spark.createDataFrame([("c", "db", "worker"), ("c", "worker", "api"), ("c", "api", "db"), ("d", "a", "b")], PAIR)
    assert {(r["root"], r["node"]) for r in reachable(e, nodes(spark, "worker")).collect()} == {("worker", x) for x in ("worker", "api", "db")}
    good = metrics.path_reachability(e, nodes(spark, "db"), nodes(spark, "db"), nodes(spark, "api"), cases(spark)).first()
    bad = metrics.path_reachability(e, nodes(spark, "worker"), nodes(spark, "db"), nodes(spark, "api"), cases(spark)).first()
    own = metrics.path_reachability(e.limit(0), nodes(spark, "db"), nodes(spark, "db"), nodes(spark, "db"), cases(spark)).first()
    assert (good[1], bad[1], own[1]) == (1, 0, 1)
    assert metrics.mean_reachability(e, nodes(spark, "db", "x"), nodes(spark, "api"), cases(spark)).first()["reachability"] == 0.5
    # Lists count as they are: db twice, and a load generator that no edge reaches but itself.
    assert metrics.mean_reachability(e, nodes(spark, "db", "db", "loadgen"), nodes(spark, "api", "loadgen"), cases(spark)).first()["reachability"] == 0.5


def test_long_chains_take_few_rounds(spark, monkeypatch):
    from tracebraid.operators import graph

    written = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or real(df))
    n = 300
    chain_ = spark.createDataFrame([("c", f"n{i}", f"n{i + 1}") for i in range(n)] + [("d", "a", "b"), ("d", "b", "a")], PAIR)
    got = {(r["case_id"], r["node"]) for r in reachable(chain_, nodes(spark, "n0").union(nodes(spark, "a", case="d"))).collect()}
    assert got == {("c", f"n{i}") for i in range(n + 1)} | {("d", "a"), ("d", "b")}
    # Starts, two single steps, nine doublings of steps and pairs.
    assert len(written) <= 1 + 2 + 2 * 9
    w = chain_.withColumn("w", F.lit(0.99))
    best = {(r["case_id"], r["node"]): r["reach"] for r in graph.best_reach(w, nodes(spark, f"n{n}").union(nodes(spark, "a", case="d"))).collect()}
    assert abs(best["c", "n0"] - 0.99**n) < 1e-12 and best["d", "a"] == 1 and abs(best["d", "b"] - 0.99) < 1e-12 and len(best) == n + 3


def test_exact_quantiles_of_few_and_many_rows(spark):
    import numpy as np

    from tracebraid.operators.selection import quantiles

    rng = np.random.default_rng(3)
    sides = {"one": [5.0], "two": [1.0, 2.0], "ties": [3.0] * 400 + [7.0] * 3, "many": np.round(rng.lognormal(3, 2, 5000), 3).tolist(), "none": [None, None]}
    df = spark.createDataFrame([(k, x) for k, v in sides.items() for x in v], "k string, v double")
    shares = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)
    # A coarse sketch, so that keys of more than 50 rows are bracketed.
    for accuracy in (50, 10_000):
        got = {r["k"]: (r["_n"], r["q"]) for r in quantiles(df, ["k"], "v", shares, accuracy).collect()}
        for k, v in sides.items():
            v = [x for x in v if x is not None]
            want = [None] * len(shares) if not v else np.quantile(v, shares).tolist()
            assert got[k][0] == len(v)
            assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got[k][1], want, strict=True)), (k, got[k], want)


def test_paths_lead_to_symptoms_without_alarms(spark):
    both = metrics.alarms_or_symptoms(nodes(spark, "a", case="c"), nodes(spark, "s", case="c").union(nodes(spark, "t", case="d")))
    assert {(r["case_id"], r["node"]) for r in both.collect()} == {("c", "a"), ("d", "t")}


def test_root_hits(spark):
    got = metrics.root_hits(nodes(spark, "a", "b", "ts-c"), nodes(spark, "c", "b"), cases(spark, "c", "none")).orderBy("case_id").collect()
    assert [tuple(r) for r in got] == [("c", 1, 1, 0, 0, 1), ("none", 0, 0, 1, 0, 0)]


def test_classification_of_masked_rows(spark):
    truth = spark.createDataFrame([("c", 0, "a", CAUSAL, "b"), ("c", 1, "b", "non_causal_dependency", "d")], EDGE)
    r = metrics.classification(spark.createDataFrame([("c", "a", "b")], PAIR), truth, cases(spark, "c", "none")).orderBy("case_id").collect()
    assert (r[0]["accuracy"], r[0]["f1"]) == (1, 1) and (r[1]["accuracy"], r[1]["f1"]) == (0, 0)


def test_causal_mask_hides_labels_only(spark):
    known, _, _ = chain(spark)
    gold = spark.createDataFrame([("c", "db", "worker"), ("c", "worker", "api")], PAIR)
    visible, truth = masking.causal_mask(known, gold, 0.5)
    assert visible.count() == 4 and visible.filter(F.col("relation") == MASKED).count() == truth.count() == 2
    assert masking.labelled(known, gold).filter(F.col("relation") == CAUSAL).count() == 2


def test_conditions_gain_from_recovery(spark):
    e = ev(spark, ("orders", 0.95, 1), ("frontend", 0.9, 2))
    full = spark.createDataFrame([("c", "service:frontend", "calls", "service:orders")], "case_id string, source string, relation string, target string")
    t = evaluation.conditions(full.limit(0), full, full)
    gold = spark.createDataFrame([("c", "orders", "frontend")], PAIR)
    rows = evaluation.topology_rca(t, e, nodes(spark, "frontend"), gold, nodes(spark, "orders"), nodes(spark, "frontend"), cases(spark), logic=incident.psl)
    by = {r["condition"]: r for r in rows.collect()}
    assert [(by[c]["edge_f1"], by[c]["path_reachability"]) for c in ("incomplete", "recovered", "complete")] == [(0, 0), (1, 1), (1, 1)]
    d = evaluation.condition_deltas(rows).first()
    assert d["delta_edge_f1"] == 1 and d["gap_edge_f1"] == 0


def test_symptoms_and_fallback(spark):
    known, e, _ = chain(spark)
    assert [r["node"] for r in evidence.symptoms(known, e).collect()] == ["ts-api"]
    calm = ev(spark, ("ts-api", 0.3, 1), ("ts-db", 0.4, 1))
    assert [r["node"] for r in evidence.symptoms(known, calm).collect()] == ["ts-db"]


def test_evidence_signals(spark):
    t = [("c", w, s, float(ts), float(d), st, 200.0) for w, s, ts, d, st in [("normal", "a", 1, 10, "OK"), ("normal", "a", 2, 10, "OK"), ("normal", "b", 1, 5, "OK"), ("abnormal", "a", 11, 50, "OK"), ("abnormal", "b", 12, 5, "Error")]]
    tr = spark.createDataFrame(t, "case_id string, win string, service_name string, ts_s double, duration double, `attr.status_code` string, `attr.http.response.status_code` double")
    m = [("c", "normal", "a", "cpu", float(v), 1.0) for v in (1, 1, 1)] + [("c", "abnormal", "a", "cpu", v, ts) for v, ts in ((9.0, 12.0), (9.0, 11.0), (float("nan"), 10.0))] + [("c", "normal", "a", "x.time", 1.0, 1.0)]
    me = spark.createDataFrame(m, "case_id string, win string, service_name string, metric string, value double, ts_s double")
    lo = spark.createDataFrame([("c", "normal", "b", "info", 1.0), ("c", "abnormal", "b", "fatal", 13.0), ("c", "normal", "z", "info", 1.0)], "case_id string, win string, service_name string, level string, ts_s double")
    st = spark.createDataFrame([("c", 10.0)], "case_id string, start_s double")
    got = {(r["node"], r["signal"]): r for r in evidence.evidence(Telemetry(tr, me, lo, st)).collect()}
    assert set(got) == {("a", "availability_drop"), ("a", "latency"), ("a", "cpu"), ("b", "error_rate"), ("b", "error_log_rate")}
    assert got["a", "latency"]["abnormality"] == pytest.approx(math.log2(5) / 3) and got["a", "latency"]["ts_s"] == 11
    assert got["a", "cpu"]["abnormality"] == 1 and got["a", "cpu"]["ts_s"] == 11
    assert got["b", "error_rate"]["ts_s"] == 12 and got["b", "error_log_rate"]["ts_s"] == 13
    assert [r["evidence_id"] for r in sorted(got.values(), key=lambda r: r["pos"])] == ["e1", "e2", "e3", "e4", "e5"]


def test_answers(spark):
    parse = adjudication.parse_answer
    assert parse('```json\n{"causal_ids":[0,"2","x"],"root_causes":["a"]}\n```') == (["0", "2"], ["a"], "json")
    assert parse("causal_ids: [1, -3] and root_causes = ['b', \"c\"]") == (["1", "-3"], ["b", "c"], "regex_fallback")
    assert parse("no idea") == parse(None) == ([], [], "failed")
    known = edges(spark, ("ts-a", "ts-b"), ("loadgen", "ts-a"), ("ts-b", "ts-d"), relation=MASKED)
    answers = spark.createDataFrame([("c", '{"causal_ids": [1, 1, 9], "root_causes": ["B", "zz", "ts-a", "a", "d", "yy"]}')], "case_id string, answer string")
    found, roots, n = adjudication.decide(answers, known, None)
    assert pairs_of(found) == {("ts-b", "ts-d")}
    assert [r["node"] for r in roots.orderBy("rank").collect()] == ["ts-b", "ts-a", "ts-d"]
    r = n.first()
    assert (r["mode"], r["n_valid_ids"], r["n_invalid_ids"], r["n_invalid_roots"]) == ("json", 1, 1, 1)
    huge = spark.createDataFrame([("c", '{"causal_ids":[0,99999999999,%d]}' % 10**30)], "case_id string, answer string")
    found, _, n = adjudication.decide(huge, known, None)
    assert pairs_of(found) == {("ts-a", "ts-b")} and (n.first()["n_valid_ids"], n.first()["n_invalid_ids"]) == (1, 2)


def test_prompts_show_no_gold(spark):
    known, e, s = chain(spark)
    visible, _ = masking.causal_mask(known, spark.createDataFrame([("c", "ts-db", "ts-worker")], PAIR), 1.0)
    p = adjudication.prompts(visible, e, s).first()["prompt"]
    assert "0|ts-db|ts-worker" in p and CAUSAL not in p and p.index("ts-api|trace") < p.index("ts-db|trace") < p.index("ts-cache|trace")


def test_comparison_without_variance(spark):
    a = spark.createDataFrame([("c", "x", "y", 0.4), ("c", "x", "z", 0.6)], PAIR + ", score double")
    b = spark.createDataFrame([("c", "x", "y", 0.5), ("c", "x", "z", 0.5), ("c", "q", "z", 0.5)], PAIR + ", score double")
    r = reports.compare(a, b).first()
    assert (r["n_common"], r["n_only_right"], r["n_disagree"], r["pearson"]) == (2, 1, 1, None)


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("a", 0.0), (None, 0.5)], "system string, f1 double")
    got = {r["system"]: (r["n"], r["f1"]) for r in reports.per_system(rows, ["f1"]).collect()}
    assert got == {"a": (2, 0.5), "unknown": (1, 0.5), "overall": (3, 0.5)}
    assert "| a | 2 | 50.00 |" in reports.markdown(reports.per_system(rows, ["f1"]), "t", ("f1",))
    for i, text in enumerate(['{"case_id": "b"}', '{"case_id": "a"}']):
        (tmp_path / f"s{i}.json").write_text(text)
    assert [r["case_id"] for r in reports.merge_shards(spark, f"{tmp_path}/s*.json", 2).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        reports.merge_shards(spark, f"{tmp_path}/s*.json", 3)
    with pytest.raises(ValueError):
        reports.markdown(spark.range(1001), "t")
    for n in (0, 2):
        with pytest.raises(ValueError):
            reports.write_summary(spark.range(n), f"{tmp_path}/out")


def test_result_files(spark, tmp_path):
    docs = [{"summary": {"f1": 0.5}, "mask_ratio": 0.4, "track": "ablation"}, {"summary": {"old_f1": 0.2}, "mask_ratio": 0.2, "model": "m"}, {"other": 1}]
    import json

    for i, d in enumerate(docs):
        (tmp_path / f"r{i}.json").write_text(json.dumps(d))
    (tmp_path / "bad.json").write_text("{")
    found = reports.load_results(spark, f"{tmp_path}/*.json")
    rows = {(r["kind"], r["mask_ratio"], r["f1"]) for r in reports.summary_rows(found, {"f1": ("f1", "old_f1")}).collect()}
    assert rows == {("ablation", 0.4, 0.5), ("direct_llm", 0.2, 0.2)} and {r["ratio"] for r in found.collect()} == {"40%", "20%"}
    with pytest.raises(ValueError):
        reports.load_results(spark, f"{tmp_path}/r2.json")
    assert reports.means(found.select("mask_ratio").limit(0), ["mask_ratio"]).first()["mask_ratio"] == 0.0
