import json

import pytest

from tracebraid.operators import evaluation
from tracebraid.sources import cases as c, telemetry

FULL = {
    "case_id": "x",
    "symptom_nodes": ["api"],
    "known_edges": [["db", "r", "api"], {"source": "a", "target": "b"}],
    "evidence": [{"evidence_id": "e1", "node": "db", "kind": "trace", "signal": "s", "abnormality": 0.9, "metadata": {"unit": "ms", "tags": ["a", {"b": 1}]}}],
    "structural_relations": [{"source": "service:a", "relation": "calls", "target": "service:b"}],
    "relation_observations": [{"observation_id": "ro", "source": "service:a", "target": "service:b", "evidence_kind": "trace_parent_child", "metadata": {"observation_count": 3, "collector": "otel"}}],
    "gold_root_causes": ["db"],
    "gold_paths": [["db", "api"]],
    "metadata": {"system": "s", "reference_topology_provenance": {"source": "cmdb", "version": "1", "independent_of_model_observations": True, "evaluator_only": True}},
}
LEGACY = {"case_id": "y", "symptom_nodes": [], "known_edges": [], "evidence": []}


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("cases") / "c.jsonl"
    path.write_text(json.dumps(FULL) + "\n\n" + json.dumps(LEGACY) + "\n")
    return c.read_cases(spark, str(path))


def test_edges_of_both_forms(read):
    got = {(r["role"], r["pos"], r["source"], r["relation"], r["target"]) for r in read.edges.collect()}
    assert got == {("known", 0, "db", "r", "api"), ("known", 1, "a", "causal_propagates_to", "b"), ("structural", 0, "service:a", "calls", "service:b")}


def test_defaults(read):
    o = read.observations.first()
    assert (o["confidence"], o["text"], o["observation_count"]) == (1.0, "", 3)
    assert read.evidence.first()["ts_s"] is None and read.cases.count() == 2


def test_round_trip(spark, read, tmp_path):
    c.write_cases(read, str(tmp_path / "out"))
    again = c.read_cases(spark, str(tmp_path / "out"))
    for name in ("edges", "nodes", "evidence", "observations", "paths"):
        key = lambda df: sorted(map(repr, df.collect()))
        assert key(getattr(read, name)) == key(getattr(again, name)), name
    assert json.loads(again.evidence.first()["metadata"]) == {"unit": "ms", "tags": ["a", {"b": 1}]}
    assert json.loads(again.observations.first()["metadata"]) == {"observation_count": 3, "collector": "otel"}


def test_audit(read):
    audit = evaluation.reference_audit(read.cases, read.edges.filter("role = 'structural'"))
    got = {r["case_id"]: r["issues"] for r in audit.collect()}
    assert got["x"] == [] and got["y"] == ["missing reference_topology_provenance", "reference topology has no evaluable typed relations"]
    with pytest.raises(ValueError):
        evaluation.require_independent(audit)
    assert evaluation.require_independent(audit, allow_derived=True) == "diagnostic_only"
    assert evaluation.require_independent(audit.filter("case_id = 'x'")) == "primary"


def test_case_checks(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "case_id string"), spark.createDataFrame([("x",)], "case_id string")
    c.require_same_cases(b, a)
    with pytest.raises(ValueError):
        c.require_same_cases(a, b)
    with pytest.raises(ValueError):
        c.require_same_cases(b.union(b), a)


def test_groups(spark):
    rows = [("s", None, "c1", "s"), ("s", "t", "c2", "t"), (" ", None, "c3", "c3"), ("s", "  ", "c4", "c4"), (None, "", "c5", "c5")]
    df = spark.createDataFrame(rows, "system string, topology_id string, case_id string, want string")
    got = df.select(c.topology_group(df.system, df.topology_id, df.case_id), "want").collect()
    assert all(r[0] == r[1] for r in got)


def test_case_folders(spark, tmp_path):
    import pandas as pd

    for case in ("k1", "k2"):
        d = tmp_path / case
        d.mkdir()
        for win in ("normal", "abnormal"):
            t = pd.Timestamp("2024-01-01 00:00:01.5") if case == "k1" else pd.Timestamp("2024-01-02")
            pd.DataFrame({"service_name": ["a"], "time": [t]}).to_parquet(d / f"{win}_traces.parquet")
            pd.DataFrame({"service_name": ["a"], "metric": ["m"], "value": [1.0], "time": [1_500_000_000]}).to_parquet(d / f"{win}_metrics.parquet")
            pd.DataFrame({"service_name": ["a"], "level": ["info"]}).to_parquet(d / f"{win}_logs.parquet")
        (d / "env.json").write_text('{"ABNORMAL_START": 5.0}')
        (d / "label.txt").write_text(" Attributed\n" if case == "k1" else "other")
    t = telemetry.read_cases(spark, str(tmp_path))
    got = {(r["case_id"], r["win"], r["ts_s"]) for r in t.traces.collect()}
    assert ("k1", "normal", 1704067201.5) in got and len(got) == 4
    assert {r["ts_s"] for r in t.metrics.collect()} == {1.5} and {r["ts_s"] for r in t.logs.collect()} == {None}
    assert {(r["case_id"], r["start_s"]) for r in t.starts.collect()} == {("k1", 5.0), ("k2", 5.0)}
    assert {(r["case_id"], r["attributed"]) for r in telemetry.read_labels(spark, str(tmp_path)).collect()} == {("k1", True), ("k2", False)}


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text("\n".join([*(json.dumps({"name": f"c{i}", "system": "s", "root_services": ["r"]}) for i in range(5)), ""]))
    m = telemetry.read_manifest(spark, str(p))
    assert [r["name"] for r in telemetry.manifest_slice(m, -3, 2).collect()] == ["c0", "c1"] and telemetry.manifest_slice(m, 4, 99).count() == 1


def test_cases_are_built_and_written(spark, tmp_path):
    from tracebraid.plans import build
    from tracebraid.plans.sample import Sample

    s = Sample(spark, "/root/testdata/sf0.001")
    gold = build.Gold(s.gold_edges.filter("case_id IN ('case-1', 'case-2', 'case-3')"), s.gold_roots, s.alarms)
    made = build.build(s.t, gold, limit=2)
    c.write_cases(made, str(tmp_path / "made"))
    again = c.read_cases(spark, str(tmp_path / "made"))
    assert {r["case_id"] for r in again.cases.collect()} == {"case-1", "case-2"}
    assert again.edges.filter("role = 'known'").count() == made.edges.filter("role = 'known'").count() > 0
    assert again.evidence.count() > 0 and again.observations.count() == made.observations.count()


def test_causal_graph_documents(spark, tmp_path):
    from tracebraid.plans.build import gold_of_folder

    docs = {
        "a": {
            "component_to_service": {"pod-1": "cart", "odd": ""}, "root_causes": ["pod-1", {"component": "service|pay|v2"}, {"name": "x"}, "unknown", 5], "alarm_nodes": ["service|late"],
            "path_terminal_alarm_nodes": ["span|web::GET /|x"], "edges": [{"source": "pod-1", "target": "span|web::GET"}, {"source": "pod-1", "target": "service|cart"}, {"source": "odd", "target": "pod-1"}, {"target": "pod-1"}, {"source": "pod-1", "target": "span|web::PUT"}],
        },
        "b": {"alarm_nodes": ["service|late"], "path_terminal_alarm_nodes": [], "root_causes": None},
        "c": [1, 2],
    }
    for name, d in docs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "causal_graph.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "causal_graph.json").write_text("{broken")
    gold = gold_of_folder(spark, str(tmp_path))
    key = lambda df, *c: sorted(tuple(r[x] for x in ("case_id", *c)) for r in df.collect())
    assert key(gold.edges, "source", "target") == [("a", "cart", "web")]
    assert key(gold.roots, "node") == [("a", "cart"), ("a", "pay|v2")]
    assert key(gold.alarms, "node") == [("a", "web"), ("b", "late")]
