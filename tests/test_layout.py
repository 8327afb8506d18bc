import pytest

from tracebraid.operators import observations
from tracebraid.sources import layout

SCHEMA = "case_id string, win string, trace_id string, span_id string, parent_span_id string, service_name string"
ROWS = [
    ("k", "normal", " t1 ", "1", None, "web"), ("k", "normal", "t1", "2", "1", "cart"), ("k", "abnormal", "t1", "3", "2 ", "pay"), ("k", "abnormal", "t1", "4", "2", "pay"),
    ("k", "normal", "t2", "1", "", "web"), ("k", "normal", "t2", "2", "1", "cart"), ("k", "normal", "t2", "2", "1", "cart"), ("k", "normal", "none", "9", "1", "lost"),
    ("k", "normal", "t2", "5", "1", None), ("m", "abnormal", "t1", "7", "1", "ads"), ("m", "abnormal", "t1", "1", "nan", "web"), (None, "normal", "t1", "1", None, "x"),
]


@pytest.fixture
def traces(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_calls_of_laid_out_spans(spark, traces, tmp_path):
    table = layout.write_spans(traces, "laid_spans", str(tmp_path / "spans"), buckets=3)
    calls = observations.count_calls(table)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = [("k", "cart", "pay", 2, 0), ("k", "web", "cart", 3, 3), ("m", "web", "ads", 1, 0)]
    assert key(calls) == want == key(observations.call_counts(traces))
    # Only the counts by service, which are few, are exchanged; nothing is where spans meet.
    plan = observations.count_calls(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert observations.call_counts(traces)._jdf.queryExecution().executedPlan().toString().count("Exchange") > 1
    layout.drop_spans(spark, "laid_spans")


def test_empty_and_unfit_frames(spark, traces, tmp_path):
    empty = layout.write_spans(traces.limit(0), "no_spans", str(tmp_path / "none"), buckets=2)
    assert observations.count_calls(empty).collect() == []
    layout.drop_spans(spark, "no_spans")
    with pytest.raises(ValueError):
        layout.write_spans(traces.drop("span_id"), "unfit")
