import json

import pandas as pd
import pytest

from tracebraid.plans import runner
from tracebraid.sources import cases as c

PROVENANCE = {"source": "inventory", "version": "2", "independent_of_model_observations": True, "evaluator_only": True}


def case(i):
    """A chain pay -> cart -> web of trouble, with a side branch that has no part in it."""
    seen = lambda node, abnormality, at: {"evidence_id": f"e-{node}", "node": node, "kind": "trace", "signal": "latency", "abnormality": abnormality, "timestamp": at}
    call = lambda a, b: {"observation_id": f"o-{a}-{b}", "source": f"service:{a}", "target": f"service:{b}", "evidence_kind": "trace_parent_child", "confidence": 0.9}
    pairs = [("cart", "pay"), ("web", "cart"), ("web", "ads")]
    return {
        "case_id": f"k{i}",
        "symptom_nodes": ["web"],
        "known_edges": [["pay", "r", "cart"], ["cart", "r", "web"], ["ads", "r", "web"]],
        "evidence": [seen("pay", 1.0, 1.0), seen("cart", 0.9, 3.0), seen("web", 0.8, 6.0), seen("ads", 0.1, None)],
        "structural_relations": [[f"service:{a}", "calls", f"service:{b}"] for a, b in pairs],
        "relation_observations": [call(*p) for p in pairs],
        "gold_root_causes": ["pay"],
        "gold_edges": [["pay", "causal_propagates_to", "cart"], ["cart", "causal_propagates_to", "web"]],
        "gold_alarm_nodes": ["web"],
        "metadata": {"system": "shop", "reference_topology_provenance": PROVENANCE},
    }


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    path = tmp_path_factory.mktemp("runner") / "cases.jsonl"
    path.write_text("\n".join(json.dumps(case(i)) for i in range(3)))
    return str(path)


def done(spark, data, out, command, *flags):
    a = runner.parser().parse_args([command, "--data", data, "--out", str(out), *flags])
    return runner.run(spark, a), spark.read.json(f"{out}/rows")


def test_qualification(spark, data, tmp_path):
    said, rows = done(spark, data, tmp_path, "qualification", "--mask-ratio", "1.0", "--semantic", "deterministic", "--limit", "2")
    assert [r["case_id"] for r in rows.orderBy("case_id").collect()] == ["k0", "k1"]
    (s,) = said["summary"]
    assert s["n"] == 2 and {s[k] for k in s if k != "n"} == {1.0}
    # Nothing is hidden: nothing is classified, visible causes still lead to the root.
    (s,) = done(spark, data, tmp_path, "qualification")[0]["summary"]
    assert (s["n"], s["causal_relation_f1"], s["root_hit_at_1"], s["process_path_reachability"]) == (3, 0.0, 1.0, 1.0)


def test_recovery_needs_an_independent_reference(spark, data, tmp_path):
    with pytest.raises(ValueError, match="independent"):
        done(spark, data, tmp_path, "recovery")
    with pytest.raises(ValueError, match="same file"):
        done(spark, data, tmp_path, "recovery", "--reference-data", data)
    said, rows = done(spark, data, tmp_path, "recovery", "--allow-derived-reference", "--topology-missing-ratio", "0.34")
    (s,) = said["summary"]
    # One relation of the shared topology is hidden in each case, its calls are observed.
    assert (s["n"], s["micro_tp"], s["micro_fp"], s["micro_fn"], s["n_missing"], s["evaluation"]) == (3, 3, 0, 0, 3, "diagnostic_only")
    assert s["candidate_ceiling"] == 1.0 and rows.count() == 3
    other = tmp_path / "reference.jsonl"
    other.write_text("\n".join(json.dumps({k: v for k, v in case(i).items() if k not in ("relation_observations",)}) for i in range(3)))
    assert done(spark, data, tmp_path, "recovery", "--reference-data", str(other))[0]["summary"][0]["evaluation"] == "primary"


def test_topologies_are_ranked_over(spark, data, tmp_path):
    said, rows = done(spark, data, tmp_path, "rca", "--allow-derived-reference", "--topology-missing-ratio", "1.0", "--rca-variant", "abduction")
    by = {r["condition"]: r for r in said["summary"]}
    assert set(by) == {"incomplete", "recovered", "complete"} and rows.count() == 9
    assert by["incomplete"]["edge_f1"] == 0.0 and by["recovered"]["edge_f1"] == by["complete"]["edge_f1"] == 1.0


def test_ablation_and_standard(spark, data, tmp_path):
    said, _ = done(spark, data, tmp_path, "ablation", "--variant", "abduction", "--mask-ratio", "1.0")
    assert said["summary"][0]["relation_f1"] == 1.0
    said, rows = done(spark, data, tmp_path, "standard")
    assert said["summary"][0]["hit_1"] == 1.0 and rows.first()["root_causes"][0] == "pay"


def test_folders_become_a_shard(spark, tmp_path):
    for name in ("k0", "k1", "k2"):
        d = tmp_path / "cases" / name
        d.mkdir(parents=True)
        (d / "label.txt").write_text("attributed" if name != "k1" else "no")
        (d / "env.json").write_text('{"ABNORMAL_START": 100.0}')
        (d / "causal_graph.json").write_text(json.dumps({"root_causes": ["service|pay"], "alarm_nodes": ["service|web"], "edges": [{"source": "service|pay", "target": "service|web"}]}))
        for win, slow in (("normal", 1), ("abnormal", 50)):
            n = range(20)
            rows = [(f"t{i}", "1", None, "web", 10 * slow, 100.0 + i) for i in n] + [(f"t{i}", "2", "1", "pay", 10 * slow, 100.0 + i) for i in n]
            df = pd.DataFrame(rows, columns=["trace_id", "span_id", "parent_span_id", "service_name", "duration", "time"])
            df["time"] = (df["time"] * 1e9).astype("int64")
            df.to_parquet(d / f"{win}_traces.parquet")
    base, manifest = f"file://{tmp_path}/cases", tmp_path / "m.jsonl"
    manifest.write_text("\n".join(json.dumps({"name": n, "system": "shop", "root_services": ["pay"]}) for n in ("k2", "k1", "k0")))
    build = ["build", "--cache", base, "--out", str(tmp_path / "shards" / "s0"), "--manifest", str(manifest)]
    with pytest.raises(ValueError, match="go together"):
        runner.run(spark, runner.parser().parse_args([*build, "--start-index", "0"]))
    made = runner.run(spark, runner.parser().parse_args([*build, "--start-index", "0", "--end-index", "2"]))
    assert made["n_cases"] == 1
    build[4] = str(tmp_path / "shards" / "s1")
    assert runner.run(spark, runner.parser().parse_args([*build, "--start-index", "2", "--end-index", "9"]))["n_cases"] == 1
    merged = runner.run(spark, runner.parser().parse_args(["merge", "--glob", f"{tmp_path}/shards/s*", "--out", str(tmp_path / "all"), "--manifest-total", "3"]))
    assert merged["shard_counts"] == {"s0": 1, "s1": 1}
    back = c.read_cases(spark, str(tmp_path / "all"))
    assert {(r["case_id"], r["source"], r["target"]) for r in back.edges.filter("role = 'known'").collect()} == {(k, "pay", "web") for k in ("k0", "k2")}
    assert {json.loads(str(r["metadata"]))["system"] for r in back.cases.selectExpr("to_json(metadata) AS metadata").collect()} == {"shop"}
    assert done(spark, str(tmp_path / "all"), tmp_path / "run", "standard")[0]["summary"][0]["n"] == 2
