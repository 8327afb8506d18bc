"""Durations in cells: exact quantiles without a sketch of every key."""

import math

import pytest
from pyspark.sql import functions as F

from tracebraid.operators import evidence, selection


@pytest.mark.parametrize("most", [200_000, 3])
def test_quantiles_by_cells(spark, monkeypatch, most):
    # With the small limit sketches take the place of cells.
    monkeypatch.setattr(selection, "CELL_ROWS", most)
    values = {
        "spread": [float(i * 7919 % 5003) for i in range(4000)], "same": [5.0] * 50 + [None] * 3, "few": [1.0, 2.0], "none": [None, None], "one": [7.0],
        "signs": [math.sin(i) * 10 ** (i % 9 - 4) for i in range(3000)], "wide": [0.0, -0.0, 1e300, -1e300, math.inf, -math.inf, 1e-300], "close": [1000 + i / 1e6 for i in range(3000)],
    }
    data = [(k, "normal", k, v, "ERROR" if i % 3 == 0 else "OK", float(i)) for k, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, "case_id string, win string, service_name string, duration double, `attr.status_code` string, ts_s double")
    got = {r["case_id"]: r for r in evidence.service_stats(df).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        v, r = sorted(x for x in vs if x is not None), got[k]
        for share, name in ((0.95, "p95"), (0.99, "p99")):
            at = share * (len(v) - 1)
            want = v[int(at)] + (v[math.ceil(at)] - v[int(at)]) * (at - int(at)) if v else 0.0
            assert r[name] == pytest.approx(want, rel=1e-12), (k, name)
        assert (r["n"], r["first_error"]) == (len(vs), 0.0) and r["error_rate"] == len(range(0, len(vs), 3)) / len(vs)


def test_no_sketch_of_every_key(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a sketch")

    monkeypatch.setattr(selection.F, "percentile_approx", never)
    df = spark.range(5000).select(F.lit("k").alias("case_id"), F.lit("normal").alias("win"), F.lit("s").alias("service_name"), F.col("id").cast("double").alias("duration"))
    assert evidence.service_stats(df).first()["p95"] == pytest.approx(0.95 * 4999)
