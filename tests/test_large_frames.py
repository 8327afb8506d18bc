"""What is done for every span: few rows made of it, no interpreted functions, one exchange of them."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame, functions as F

from tracebraid.functions.expressions import clean, strip
from tracebraid.operators import observations as o
from tracebraid.operators.selection import quantiles

POD, NODE, DB, ADDRESS = "attr.k8s.pod.name", "attr.k8s.node.name", "attr.db.system", "attr.server.address"
ROWS = [
    ("k", "normal", "t1", "1", None, "web", "p1", "n1", None, "a"), ("k", "abnormal", "t1", "2", "1", "cart ", "p1", "n1", "sql", "a"),
    ("k", "normal", "t1", "2", "1", "cart", " p1", "n2", "sql", None), ("k", "abnormal", "t1", "3", "2", "pay", "none", "n2", "NaN", "b"),
    ("k", "normal", "t1", "3", "2", "pay", None, "n2", "sql", "b"), ("k", "abnormal", "t1", "4", "2", None, "p3", "n3", "sql", "b"),
    ("m", "abnormal", "t1", "1", "1", "web", "p1", None, None, None), ("m", "normal", "t2", "1", "", "\tnull\n", "p1", "", "x", "y"),
]


@pytest.fixture
def traces(spark):
    names = "case_id win trace_id span_id parent_span_id service_name".split() + [f"`{c}`" for c in (POD, NODE, DB, ADDRESS)]
    return spark.createDataFrame(ROWS, ", ".join(f"{n} string" for n in names))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_span_is_few_typed_rows(traces):
    made = o._typed(traces, 0, True, F.lit("shop"))
    # One row for its place, one for a database; it was one for each kind and one for the inventory.
    assert made.count() == traces.count() + traces.filter(F.col(f"`{DB}`").isNotNull() & F.col("service_name").isNotNull()).count()


def test_places_give_what_single_collectors_give(traces):
    logs = traces.select("case_id", "win", "service_name").unionByName(traces.sparkSession.createDataFrame([("q", "normal", " only-logs "), (None, "normal", "x")], "case_id string, win string, service_name string"))
    got = o.collect(traces, None, logs, F.lit("shop"))
    parts = [o.deployments([traces]), o.databases(traces), o.messaging(traces), o.inventory([traces, logs], F.lit("shop"))]
    want = o.dedupe(reduce(DataFrame.unionByName, parts))
    names = want.columns
    assert rows(got.filter("evidence_kind <> 'trace_parent_child'").select(names)) == rows(want)


def test_calls_are_exchanged_once(traces):
    many = traces.unionByName(traces.filter("span_id = '2'"))
    calls = o.call_counts(many)
    text = plan(calls)
    # One exchange for spans and one for sums, and no second aggregation by key.
    assert text.count("Exchange") == 2 and "ObjectHashAggregate" not in text
    assert rows(calls) == rows(o.count_calls(o.spans(many))) == [("k", "cart", "pay", 8, 2), ("k", "web", "cart", 4, 2)]


def test_quantiles_without_functions_over_arrays(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 3001).cast("double").alias("v"))
    q = quantiles(df, ["k"], "v", (0.5, 0.95), 50)
    # The sketch is taken once for both ends.
    text = plan(q)
    assert "lambda" not in text and "exists(" not in text
    for r in q.collect():
        v = sorted(float(i * 7919 % 3001) for i in range(3000) if i % 3 == r["k"])
        want = [v[int(p)] + (v[min(int(p) + 1, 999)] - v[int(p)]) * (p - int(p)) for p in (0.5 * 999, 0.95 * 999)]
        assert r["q"] == pytest.approx(want)


def test_strip(spark):
    df = spark.createDataFrame([(x,) for x in (" a b\t", "\r\n\x0bx\f", "", " \n", None, "é ", "  ")], "x string")
    assert [r[0] for r in df.select(strip("x")).collect()] == ["a b", "x", "", "", None, "é", ""]
    assert [r[0] for r in df.select(clean("x")).collect()] == ["a b", "x", None, None, None, "é", None]
    assert "regexp" not in df.select(clean("x"))._jdf.queryExecution().optimizedPlan().toString()
