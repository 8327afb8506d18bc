"""All variants of stage 1 in one run; tables that grow with the input do not pass through the driver."""

import random

import pytest
from pyspark.sql import functions as F

from tracebraid.operators import evaluation, masking, structural
from tracebraid.operators.graph import cut
from tracebraid.plans import catalog
from tracebraid.sources import telemetry

REL = "case_id string, source string, relation string, target string"
OBS = "case_id string, observation_id string, source string, target string, evidence_kind string, confidence double, text string, observation_count long"
KINDS = [("service:s{}", "calls", "service:t{}", "trace_parent_child"), ("pod:p{}", "runs_on", "node:n{}", "pod_node_cooccurrence"), ("system:y{}", "has_service", "service:s{}", "system_inventory")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def made(spark):
    """Relations, observations and cases: pods on several nodes, services of several systems, weak and strong evidence, a case without any."""
    rng = random.Random(8)
    rel, obs = set(), []
    for _ in range(400):
        a, r, b, kind = rng.choice(KINDS)
        edge = (f"c{rng.randrange(4)}", a.format(rng.randrange(6)), r, b.format(rng.randrange(6)))
        if rng.random() < 0.6:
            rel.add(edge)
        if rng.random() < 0.7:
            obs.append((edge[0], f"o{len(obs)}", edge[1], edge[3], rng.choice([kind, kind, "generic"]), rng.choice([0.3, 0.53, 0.6, 0.98]), "", 1))
    cases = spark.createDataFrame([(f"c{i}",) for i in (0, 1, 2, 9)], "case_id string")
    relations = spark.createDataFrame([(*e, f"g{int(e[0][1]) % 2}") for e in sorted(rel)], REL + ", group_id string")
    return cut(relations), cut(spark.createDataFrame(obs, OBS)), cases


def scorer(_, h):
    """Support that differs from the abductive one; none in one case."""
    x = F.when(F.col("case_id") != "c1", (F.abs(F.xxhash64("case_id", "source", "target")) % 100) / 100)
    return h.withColumn("semantic_support", x).withColumn("semantic_contradiction", 1 - x).withColumn("semantic_neutral", F.lit(0.0))


def test_one_run_gives_what_single_runs_give(made):
    relations, observations, cases = made
    counts = ["tp", "fp", "fn", "precision", "recall", "f1"]
    got = {r["variant"]: [r[c] for c in counts] for r in evaluation.stage1_variants(relations, observations, cases, 0.4, semantic=scorer).collect()}
    want = {}
    for name in evaluation.STAGE1_VARIANTS:
        row = evaluation.stage1_variant(relations, observations, cases, 0.4, name, semantic=scorer)["micro"].first()
        want[name] = [row[c] for c in counts]
    assert got == want and len({tuple(x) for x in want.values()}) == 5
    with pytest.raises(ValueError):
        evaluation.stage1_variants(relations, observations, cases, 0.4)


def test_no_cases_give_what_single_runs_give(made):
    relations, observations, cases = made
    rows = evaluation.stage1_variants(relations, observations, cases.limit(0), 0.4, semantic=scorer).collect()
    assert len(rows) == 5 and all(tuple(r)[1:] == (0, 0, 0, 1, 1, 1) for r in rows)


def test_query_masks_once(spark, sf_dir, monkeypatch):
    made = []
    whole = masking.group_mask
    monkeypatch.setattr(masking, "group_mask", lambda *x, **o: made.append(1) or whole(*x, **o))
    df = catalog.queries()["stage1_variants"](spark, sf_dir)
    # It was five times, in five plans beside each other.
    assert made == [1] and df.count() == 5


def test_relations_are_not_broadcast(made):
    relations, observations, cases = made
    visible, missing = masking.group_mask(relations, 0.4)
    h = cut(structural.hypotheses(observations))
    for df in (structural.psl(h, visible), structural.soft_logic(h, visible), structural.scored_all(h, scorer(None, h)), evaluation.candidate_ceiling(h, missing)):
        assert "BroadcastExchange" not in plan(df) and "SortMergeJoin" in plan(df)
    added = evaluation.stage1(relations, observations, cases, 0.4)["added"]
    both = structural.recover_missing(visible, observations)[1]
    for df in (added, both):
        assert "LeftAnti" in plan(df) and not [x for x in plan(df).splitlines() if "BroadcastHashJoin" in x and "LeftAnti" in x]


def test_conflicts_of_both_functional_relations(spark):
    names = "source relation target".split()
    h = spark.createDataFrame([("c", *e) for e in (("pod:a", "runs_on", "node:1"), ("pod:a", "runs_on", "node:2"), ("pod:b", "runs_on", "node:1"), ("system:x", "has_service", "service:s"), ("system:y", "has_service", "service:s"), ("service:s", "calls", "service:t"))], REL)
    visible = spark.createDataFrame([("c", "pod:a", "runs_on", "node:2"), ("c", "system:y", "has_service", "service:s"), ("c", "service:s", "calls", "service:u"), ("d", "pod:b", "runs_on", "node:7")], REL)
    got = structural.with_conflicts(h, visible)
    assert got.columns == [*h.columns, "conflict"]
    assert {tuple(r[c] for c in names) for r in got.filter("conflict = 1").collect()} == {("pod:a", "runs_on", "node:1"), ("system:x", "has_service", "service:s")}


@pytest.mark.parametrize("keys", [(1, 2, 3, None), (1, 1, 2, None)])
def test_large_tables_beside_spans_are_not_broadcast(spark, monkeypatch, keys):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c"), (None, "d")], "k long, v string")
    right = spark.createDataFrame([(k, f"x{i}") for i, k in enumerate(keys)], "r long, w string")
    join = lambda: left.join(telemetry.one_a_key(right, "r"), left.k == F.col("r"), "left")
    few = sorted(map(tuple, join().collect()), key=repr)
    monkeypatch.setattr(telemetry, "BROADCAST_ROWS", 2)
    many = join()
    assert "ShuffledHashJoin" in plan(many) and "BroadcastExchange" not in plan(many)
    assert sorted(map(tuple, many.collect()), key=repr) == few
    # A join that nothing is read from is still left out.
    assert ("Join" in plan(many.select("v"))) == (len(set(keys)) < len(keys))
