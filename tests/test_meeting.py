"""Calls counted in batches of whole traces, against the count by key that Spark makes."""

import random

import pyarrow as pa
import pytest

from tracebraid.operators import meeting, observations as o

FIELDS = ["case_id", "trace_id", "span_id", "parent_span_id", "service_name", "normal", "place"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_span_crosses_once(spark, sf_dir):
    from tracebraid.plans.sample import Sample

    plan = o.call_counts(Sample(spark, sf_dir).t.traces)._jdf.queryExecution().executedPlan().toString()
    # It was a row for its own key and one for its parent's, and a window over both.
    assert "Generate" not in plan and "Window" not in plan


@pytest.mark.parametrize("held, files, pairs", [(200_000, 64, 2_000_000), (50, 3, 7), (1, 2, 1)])
def test_same_as_by_key(spark, monkeypatch, held, files, pairs):
    dice = random.Random(7)
    one = lambda *xs: dice.choice(xs)
    data = []
    for _ in range(900):
        # Trace "big" has most spans; ids repeat, within a trace and between traces.
        ids = [str(dice.randrange(12)) for _ in range(2)]
        data.append((one("k", "m", None), one("normal", "abnormal", None), one("big", "big", " big", "t1", "t2", "None", " null", None), one(*ids, f" {ids[0]}", "NaN", None), one(ids[1], f"{ids[1]}\t", "", None), one("web", "cart ", "pay", "nulls", "null", None)))
    traces = spark.createDataFrame(data, "case_id string, win string, trace_id string, span_id string, parent_span_id string, service_name string")
    want = rows(o.count_calls(o.spans(traces)))
    assert len(want) > 20 and rows(o.call_counts(traces)) == want
    # The same in small pieces, where large traces go over files.
    for name, value in (("HELD_ROWS", held), ("FILES", files), ("PAIRS", pairs)):
        monkeypatch.setattr(meeting, name, value)
    t = [[r[0], r[2], r[3], r[4], r[5], r[1] == "normal", hash((r[0], r[2].strip()))] for r in data if r[2]]
    t.sort(key=lambda r: r[6])
    types = [pa.string()] * 5 + [pa.bool_(), pa.int64()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*t[i : i + 40]), types)], FIELDS) for i in range(0, len(t), 40)]
    sums = {}
    for batch in meeting.calls(iter(batches)):
        for r in batch.to_pylist():
            s = sums.setdefault((r["case_id"], r["caller"], r["callee"]), [0, 0])
            s[0] += r["times"]
            s[1] += r["normal_times"]
    assert sorted([(*k, *v) for k, v in sums.items()], key=repr) == want


def test_nothing(spark):
    none = spark.createDataFrame([("k", "normal", "t", "1", None, None)] * 3, "case_id string, win string, trace_id string, span_id string, parent_span_id string, service_name string")
    assert o.call_counts(none).collect() == [] == o.call_counts(none.limit(0)).collect()
