import math
import random

from pyspark.sql import functions as F

from tracebraid.llm import hard_negatives
from tracebraid.llm.hard_negatives import op11_hard_negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, score double"


def brute(rows):
    use = []
    for at, (i, v, label) in enumerate(rows):
        if i is not None and i % 7 == 0 and label is not None:
            label = (label + 1) % 10
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((at, i, [math.floor(256 * x) for x in v], label))
    out = []
    big = 1 << 63
    for at, i, q, label in use:
        if i is None or i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), big if k is None else k, lab == label) for a, k, v, lab in use if a != at)
        for s, p, same in [x for x in scored if x[2]][:5]:
            fits = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, None if p == big else p, r, None if k == big else k, -s, -n) for r, (n, k, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def found(spark, rows, **small):
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA)
    return sorted((tuple(r[c] for c in COLUMNS) for r in op11_hard_negatives(df, **small).collect()), key=repr)


def floats(v):
    import numpy as np

    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def test_same_as_brute_force_in_small_pages_and_groups(spark):
    rng = random.Random(5)
    rows = [(i, floats([rng.gauss(0.05, 0.12) for _ in range(8)]), rng.randrange(3)) for i in range(700)]
    # Ties: one vector many times; repeated ids; nulls; other dimensions; no id.
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(60)]
    rows += [(100, rows[3][1], 1), (100, rows[3][1], 1), (None, rows[0][1], 0), (None, rows[0][1], 2), (701, None, 1), (800, [None] * 8, 1), (702, floats([0.5]), 0), (703, [], 1)]
    rows += [(704, [math.nan] * 8, 1), (705, [math.inf] + [0.0] * 7, 1), (706, rows[1][1], None), (900, [0.0] * 8, 2)]
    got = found(spark, rows, page_rows=37, group=3)
    assert got == brute(rows) and len(got) > 100


def test_large_components_and_empty_table(spark):
    rows = [(100, floats([3e5, 1.0]), 1), (1, floats([3e5, 2.0]), 1), (2, floats([2.9e5, -1.0]), 2), (3, floats([1e20, 1e20]), 2), (200, floats([2.0, 1e9]), 2), (5, floats([1.0, 9e8]), 3)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_bounds_hold_every_exact_score(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(0, 40, (500, 16)))
    page = hard_negatives.Page(hard_negatives._page("p", np.arange(500), np.zeros(500, int), v))
    low, high = page.bounds(v[:50])
    exact = v[:50] @ v.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 0.5 * exact.std()


def test_no_row_scored_that_bounds_exclude(spark):
    """Most pairs are decided by their bounds alone."""
    import numpy as np

    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(0, 32, (2000, 32)))
    labels = rng.integers(0, 5, 2000)
    page = hard_negatives.Page(hard_negatives._page("p", np.arange(2000), labels, v))
    anchors = hard_negatives.Anchors([{"page": "q", "place": i, "id": i, "label": labels[i], "v": v[i]} for i in range(20)])
    a, _ = hard_negatives.positives_in(page, anchors, 5, np.full(20, -np.inf))
    assert 100 <= len(a) < 0.1 * 20 * 2000


def test_columns(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("id", F.lit(1))
    assert op11_hard_negatives(df).columns == COLUMNS
