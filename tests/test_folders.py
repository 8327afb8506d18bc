import json

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tracebraid.operators import observations
from tracebraid.sources import folders


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    """Six cases; the telemetry of those that nobody wants is no Parquet."""
    base = tmp_path_factory.mktemp("folders")
    for i in range(6):
        d = base / f"k{i}"
        d.mkdir()
        (d / "label.txt").write_text(" Attributed \n" if i % 2 == 0 else "other")
        (d / "env.json").write_text(json.dumps({"ABNORMAL_START": 5.0 + i}))
        for win in folders.WINDOWS:
            if i % 2:
                for kind in folders.FRAMES:
                    (d / f"{win}_{kind}.parquet").write_text("not parquet")
                continue
            pod = "attr.k8s.pod.name" if i == 0 else "k8s.pod.name"
            time = pa.array([1_700_000_000_123_456_789 + i] * 3, pa.timestamp("ns", "UTC"))
            spans = {"trace_id": ["t"] * 3, "span_id": ["1", "2", "3"], "parent_span_id": [None, "1", "2"], "service_name": ["a", "b", "c"], pod: ["p1", "p2", None], "time": time, "duration": [1, 2, 3], "attr.http.response.status_code": ["200", "n/a", None]}
            pq.write_table(pa.table(spans), d / f"{win}_traces.parquet")
            if i != 2:
                pd.DataFrame({"service_name": ["a"], "metric": ["m"], "value": [1.5], "time": [1_500_000_000]}).to_parquet(d / f"{win}_metrics.parquet")
            pd.DataFrame({"service_name": pd.Categorical(["a"]), "level": ["info"], "other": [1]}).to_parquet(d / f"{win}_logs.parquet")
    rows = [{"name": n, "system": "s"} for n in ("k4", "k1", "gone", "k2", "k0", "k4")]
    (base / "manifest.jsonl").write_text("\n".join([*map(json.dumps, rows), "", ""]))
    return str(base)


def uri(base):
    return "file://" + base


def test_unwanted_cases_are_never_opened(spark, base):
    before = spark.conf.get("spark.sql.legacy.parquet.nanosAsLong")
    t = folders.read_folders(spark, uri(base))
    got = t.traces.collect()
    assert {r["case_id"] for r in got} == {"k0", "k2", "k4"} and len(got) == 18
    assert {r["ts_s"] for r in got} == {1_700_000_000_123_456_789 / 1e9}
    assert sorted({r["duration"] for r in got}) == [1.0, 2.0, 3.0]
    assert {r["attr.http.response.status_code"] for r in got} == {200.0, None}
    assert {(r["case_id"], r["value"], r["ts_s"]) for r in t.metrics.collect()} == {("k0", 1.5, 1.5), ("k4", 1.5, 1.5)}
    assert {(r["level"], r["service_name"], r["ts_s"]) for r in t.logs.collect()} == {("info", "a", None)}
    assert {(r["case_id"], r["start_s"]) for r in t.starts.collect()} == {("k0", 5.0), ("k2", 7.0), ("k4", 9.0)}
    assert spark.conf.get("spark.sql.legacy.parquet.nanosAsLong") == before
    with pytest.raises(Exception, match="k[135]/(ab)?normal_traces.parquet is no Parquet file"):
        folders.read_folders(spark, uri(base), attributed=False).traces.collect()


def test_each_file_names_its_pods_its_own_way(spark, base):
    t = folders.read_folders(spark, uri(base))
    seen = observations.collect(t.traces, t.metrics, t.logs).filter("evidence_kind = 'service_pod_cooccurrence'")
    assert sorted({(r["case_id"], r["target"]) for r in seen.collect()}) == [(k, f"pod:{p}") for k in ("k0", "k2", "k4") for p in ("p1", "p2")]


@pytest.mark.parametrize(("start", "end", "want"), [(0, None, {"k0", "k2", "k4"}), (1, 4, {"k2"}), (-5, 1, {"k4"}), (4, 99, {"k0", "k4"}), (3, 3, set())])
def test_slices_of_the_manifest(spark, base, start, end, want):
    t = folders.read_folders(spark, uri(base), manifest=uri(base) + "/manifest.jsonl", start=start, end=end)
    rows = t.traces.collect()
    assert {r["case_id"] for r in rows} == {r["case_id"] for r in t.starts.collect()} == want and len(rows) == 6 * len(want)


def test_a_slice_does_not_end_before_it_starts(spark, base):
    with pytest.raises(ValueError):
        folders.read_folders(spark, uri(base), manifest=uri(base) + "/manifest.jsonl", start=3, end=2)


def test_a_large_file_is_shared_by_row_groups(spark, tmp_path):
    (tmp_path / "big").mkdir()
    pq.write_table(pa.table({"service_name": [f"s{i}" for i in range(5000)], "metric": ["m"] * 5000, "value": list(range(5000))}), tmp_path / "big" / "normal_metrics.parquet", row_group_size=300)
    options = {"path": "file://" + str(tmp_path), "kind": "metrics", "split_bytes": "4000"}
    df = folders.read_frame(spark, options["path"], "metrics", "case_id string, value double", split_bytes="4000")
    assert df.columns == ["case_id", "value"] and df.rdd.getNumPartitions() > 3
    assert sorted(r["value"] for r in df.collect()) == [float(i) for i in range(5000)]
    # No rows at all, too, is a table.
    assert folders.read_frame(spark, options["path"], "logs").collect() == []
