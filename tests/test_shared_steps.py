"""Steps that many queries share: what a query does not need is not read, and what it reads several times is made once."""

import pytest
from pyspark.sql import functions as F

from tracebraid.operators import masking, observations as o, structural
from tracebraid.operators.selection import quantiles
from tracebraid.plans.sample import EDGE, Sample
from tracebraid.sources.telemetry import one_a_key


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_known_calls_need_no_other_observations(spark, sf_dir):
    s = Sample(spark, sf_dir)
    got = s.known
    assert "both_windows" not in s.__dict__
    whole = structural.recover(s.observed_normal).filter("selected")
    assert rows(got.select("case_id", *EDGE)) == rows(structural.propagation_edges(whole).select("case_id", *EDGE))
    calls = s.collected.filter("evidence_kind = 'trace_parent_child'")
    assert rows(o.collect_calls(s.t.traces).select(calls.columns)) == rows(calls)
    # Spans alone: neither parts nor suppliers are joined.
    assert "p_type" not in plan(o.collect_calls(s.t.traces)) and "s_nationkey" not in plan(o.collect_calls(s.t.traces))


def test_observations_that_are_at_hand_are_used(spark, sf_dir):
    s = Sample(spark, sf_dir)
    before = rows(s.known)
    other = Sample(spark, sf_dir)
    assert other.both_windows is not None and "lineitem" not in plan(other.calls_normal)
    assert rows(other.known) == before


@pytest.mark.parametrize("keys, joins", [((1, 2, None, None), 0), ((1, 1, 2, None), 1)])
def test_outer_join_with_a_table_of_one_row_a_key(spark, keys, joins):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k long, v string")
    right = spark.createDataFrame([(k, f"x{i}") for i, k in enumerate(keys)], "r long, w string")
    j = left.join(one_a_key(right, "r"), left.k == F.col("r"), "left")
    assert plan(j.select("v")).count("Join") == joins
    want = left.join(right, left.k == right.r, "left")
    # A repeated key still repeats rows.
    assert rows(j.select("v", "w")) == rows(want.select("v", "w")) and rows(j.select("v")) == rows(want.select("v"))


def test_bounds_of_quantiles_are_made_once(spark):
    df = spark.range(5000).selectExpr("id % 2 AS k", "CAST(id * 7919 % 5003 AS double) AS v")
    q = quantiles(df, ["k"], "v", (0.5, 0.99))
    assert "percentile_approx" not in plan(q)
    for r in q.collect():
        v = sorted(float(i * 7919 % 5003) for i in range(5000) if i % 2 == r["k"])
        at = lambda s: v[int(s * 2499)] + (v[min(int(s * 2499) + 1, 2499)] - v[int(s * 2499)]) * (s * 2499 - int(s * 2499))  # noqa: E731, B023
        assert r["q"] == pytest.approx([at(0.5), at(0.99)])


def test_masked_relations_are_hashed_once(spark):
    df = spark.createDataFrame([("c", "g", f"service:s{i}", "calls", f"service:t{i}") for i in range(20)], "case_id string, group_id string, source string, relation string, target string")
    visible, missing = masking.group_mask(df, 0.4)
    assert "sha2" not in plan(visible) and "sha2" not in plan(missing)
    assert missing.count() == 8 and visible.count() == 12
