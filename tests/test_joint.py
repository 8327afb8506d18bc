import random

import numpy as np
from pyspark.sql import functions as F

from tracebraid.operators import joint
from tracebraid.schemas import CAUSAL, NON_CAUSAL

H = "case_id string, source string, target string, temporal_score double, anomaly_score double, semantic_support double, semantic_contradiction double, soft_logic_score double"


def cases(spark, semantic=False):
    """A case of some nodes with reverse pairs and labels, a hub, and a case of two edges."""
    rng = random.Random(4)
    pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(75)} | {(0, i) for i in range(1, 14)}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    number = lambda: rng.random() if semantic else None
    h = [("c", f"n{a:02}", f"n{b:02}", rng.choice([0.0, 0.2, 0.55, 1.0]), rng.random(), number(), number(), None) for a, b in pairs[10:]]
    known = [("c", f"n{a:02}", rng.choice([CAUSAL, NON_CAUSAL]), f"n{b:02}") for a, b in pairs[:10]]
    h += [("d", "x", "y", 1.0, 0.9, number(), number(), None), ("d", "y", "x", 0.2, 0.4, number(), number(), None)]
    symptoms = [("c", "n03"), ("c", "n05"), ("d", "y"), ("e", "n01")]
    return spark.createDataFrame(h, H), spark.createDataFrame(known, "case_id string, source string, relation string, target string"), spark.createDataFrame(symptoms, "case_id string, node string")


def whole(h, known, symptoms, case):
    rows = [r for r in h.collect() if r["case_id"] == case]
    hard = [r for r in known.collect() if r["case_id"] == case]
    names = sorted({r[e] for r in (*rows, *hard) for e in ("source", "target")})
    at = {x: i for i, x in enumerate(names)}
    sym = np.array([(case, x) in {tuple(r) for r in symptoms.collect()} for x in names])
    col = lambda c: np.array([r[c] for r in rows], float)
    words = rows[0]["semantic_support"] is not None
    c = joint.solve_global(
        col("temporal_score"), col("anomaly_score"), col("semantic_support") if words else None, col("semantic_contradiction") if words else None,
        np.array([at[r["source"]] for r in rows]), np.array([at[r["target"]] for r in rows]), [(at[r["source"]], at[r["target"]], float(r["relation"] == CAUSAL)) for r in hard], sym, steps=40000,
    )
    return {(case, r["source"], r["target"]): x for r, x in zip(rows, c, strict=True)}


def test_parts_agree_on_the_minimum_of_the_whole(spark):
    h, known, symptoms = cases(spark, True)
    want = whole(h, known, symptoms, "c") | whole(h, known, symptoms, "d")
    y, reach = joint.infer(h, known, symptoms, part_edges=30)
    got = {(r["case_id"], r["source"], r["target"]): r["y"] for r in y.collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-6
    worst = joint.residuals(h, known, symptoms, y, reach).agg(F.max("residual")).first()[0]
    assert worst < 1e-4


def test_parts_hold_pairs_together_and_split_hubs(spark):
    h, known, symptoms = cases(spark)
    parts, most = joint._parts(joint._edges(h, known, symptoms), 10)
    rows = parts.filter("case_id = 'c'").collect()
    assert most > 5 and len(rows) > 5 and max(len(r["edges"]) for r in rows) < 40
    at = {(e["source"], e["target"]): r["part"] for r in rows for e in r["edges"]}
    assert all(at[a, b] == at[b, a] for a, b in at if (b, a) in at)


def test_residuals_see_a_wrong_answer(spark):
    h, known, symptoms = cases(spark)
    y, reach = joint.infer(h, known, symptoms)
    good = joint.residuals(h, known, symptoms, y, reach)
    assert good.agg(F.max("residual")).first()[0] < 1e-5 and good.filter("kind = 'cause'").count() == h.count()
    bad = joint.residuals(h, known, symptoms, y.withColumn("y", F.lit(0.9)), reach)
    assert bad.filter("kind = 'cause' AND residual > 1e-3").count() > 10


def test_no_hypotheses(spark):
    h, known, symptoms = cases(spark)
    assert joint.psl(h.limit(0), known, symptoms).count() == 0
