import random

import pytest
from pyspark.sql import functions as F

from tracebraid.operators import evaluation, masking, observations, semantic, structural
from tracebraid.schemas import MASKED_STRUCTURAL

OBS = "case_id string, observation_id string, source string, target string, evidence_kind string, confidence double, text string, observation_count long"
REL = "case_id string, source string, relation string, target string"


def traces(spark):
    rows = [
        ("c", "t1", "p", "", "kiosk", "kiosk-p2", "rack-1", None, None),
        ("c", "t1", "c", "p", "ledger", "ledger-x7", "rack-4", "mariadb", "ledger-db"),
        ("c", "t1", "d", "p", "kiosk", "None", "nan", " ", None),
    ]
    return spark.createDataFrame(rows, "case_id string, trace_id string, span_id string, parent_span_id string, service_name string, `attr.k8s.pod.name` string, `attr.k8s.node.name` string, `attr.db.system` string, `attr.server.address` string")


def obs(spark, *rows):
    return spark.createDataFrame([(c, f"ro{i}", s, t, k, p, "", 1) for i, (c, s, t, k, p) in enumerate(rows)], OBS)


def triples(df):
    return {tuple(r) for r in df.select("source", "relation", "target").collect()}


def test_collectors_and_relations(spark):
    o = observations.collect(traces(spark))
    r = structural.recover(o).filter("selected")
    assert triples(r) == {
        ("service:kiosk", "calls", "service:ledger"),
        ("service:ledger", "uses_database", "database:mariadb:ledger-db"),
        ("service:kiosk", "deployed_on", "pod:kiosk-p2"),
        ("service:ledger", "deployed_on", "pod:ledger-x7"),
        ("pod:kiosk-p2", "runs_on", "node:rack-1"),
        ("pod:ledger-x7", "runs_on", "node:rack-4"),
    }
    assert triples(structural.propagation_edges(r)) == {("ledger", "dependency_propagates_to", "kiosk")}
    calls = o.filter("evidence_kind = 'trace_parent_child'").first()
    assert calls["observation_id"].startswith("ro-") and len(calls["observation_id"]) == 19 and calls["observation_count"] == 1


def test_frames_without_columns_give_nothing(spark):
    bare = spark.createDataFrame([("c", "s")], "case_id string, service_name string")
    assert observations.collect(bare, bare).count() == 0


def _spans(spark, n=400):
    """Random spans of both windows with nulls, blanks, spaces, a parent with many children, repeated rows."""
    rng = random.Random(6)
    some = lambda *x: rng.choice([*x, None, "", " "])
    rows = []
    for i in range(n):
        rows.append((f"c{i % 2}", rng.choice(["normal", "abnormal"]), rng.choice(["t1", "t2", "t3", None]), str(rng.randrange(60)), rng.choice([str(rng.randrange(60)), "0", "0", "", None]), some("cart", "pay ", "pay", "mail"), some("pod-a", "pod-b", " pod-a"), some("n1", "n2"), some("redis", "mysql"), some("kafka"), some("host", "h2")))
    names = ["trace_id", "span_id", "parent_span_id", "service_name", "attr.k8s.pod.name", "attr.k8s.node.name", "attr.db.system", "attr.messaging.system", "attr.server.address"]
    return spark.createDataFrame(rows + rows[:20], "case_id string, win string, " + ", ".join(f"`{c}` string" for c in names))


def test_one_pass_is_the_union_of_all_collectors(spark):
    t = _spans(spark)
    logs = t.select("case_id", "win", "service_name", "`attr.k8s.pod.name`").filter("case_id = 'c1'")
    key = lambda df: sorted(tuple(r[c] for c in ("case_id", "source", "target", "evidence_kind", "observation_count", "confidence", "text", "observation_id")) for r in df.collect())

    def each(traces, logs):
        parts = [observations.span_calls(traces), observations.deployments([traces, logs]), observations.databases(traces), observations.messaging(traces), observations.inventory([traces, logs], F.lit("shop"))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return observations.dedupe(out)

    both = observations.collect_windows(t, None, logs, F.lit("shop"))
    assert key(observations.collect(t, None, logs, F.lit("shop"))) == key(both) == key(each(t, logs))
    normal = "win = 'normal'"
    assert key(observations.normal_only(both)) == key(each(t.filter(normal), logs.filter(normal)))


def test_collecting_scans_traces_twice(spark, tmp_path):
    _spans(spark).write.parquet(f"{tmp_path}/t")
    df = observations.collect_windows(spark.read.parquet(f"{tmp_path}/t"), system=F.lit("shop"))
    df.collect()
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2


def test_first_existing_column_wins_even_if_null(spark):
    df = traces(spark).withColumn("db.system", F.lit("mysql"))
    kinds = observations.databases(df)
    assert kinds.count() == 1 and kinds.first()["target"] == "database:mariadb:ledger-db"


def test_noisy_or_and_weak_prior(spark):
    o = obs(spark, ("c", "service:a", "service:b", "trace_parent_child", 0.98), ("c", "service:a", "service:b", "generic_endpoint_cooccurrence", 1.0), ("c", "service:x", "service:y", "generic_endpoint_cooccurrence", 1.0))
    h = {r["source"]: r for r in structural.recover(o).collect()}
    assert h["service:a"]["abductive_support"] == pytest.approx(1 - (1 - 0.98 * 0.98) * (1 - 0.35))
    assert not h["service:x"]["selected"] and h["service:a"]["selected"]


def test_certain_support_is_not_lost(spark):
    h = structural.hypotheses(obs(spark, ("c", "system:s", "service:a", "system_inventory", 1.0)))
    assert h.first()["abductive_support"] == 1.0


def test_incompatible_kinds_are_dropped(spark):
    assert structural.hypotheses(obs(spark, ("c", "pod:a", "service:b", "trace_parent_child", 1.0))).count() == 0


@pytest.mark.parametrize("logic", [structural.soft_logic, structural.psl])
def test_functional_conflict_stops_a_relation(spark, logic):
    o = obs(spark, ("c", "pod:ledger-x7", "node:rack-9", "pod_node_cooccurrence", 0.98), ("d", "pod:ledger-x7", "node:rack-9", "pod_node_cooccurrence", 0.98))
    visible = spark.createDataFrame([("c", "pod:ledger-x7", "runs_on", "node:rack-4")], REL)
    got = {r["case_id"]: r for r in structural.recover(o, visible, logic=logic).collect()}
    assert got["c"]["soft_logic_score"] < 0.5 and not got["c"]["selected"] and got["d"]["selected"]


def test_psl_minimum_against_a_grid(spark):
    rng = random.Random(3)
    rows = [(rng.random(), rng.random(), rng.random(), rng.randint(0, 1)) for _ in range(60)]
    df = spark.createDataFrame(rows, "p double, s double, k double, c int")
    got = df.select("*", structural.psl_score(F.col("p"), F.col("s"), F.col("k"), F.col("c")).alias("y")).collect()
    for r in got:
        loss = lambda y: 1.4 * max(0, r["p"] - y) ** 2 + 1.1 * max(0, r["s"] - y) ** 2 + 1.2 * max(0, r["k"] + y - 1) ** 2 + (0.2 + 2 * r["c"]) * y * y  # noqa: E731, B023
        assert loss(r["y"]) <= min(loss(i / 2000) for i in range(2001)) + 1e-6


def test_final_score_paths(spark):
    df = spark.createDataFrame([(0.6, None, None, None), (0.6, 0.5, 0.5, None), (0.6, 0.9, 0.1, 0.31), (0.9, 1.0, None, None)], "abductive_support double, semantic_support double, semantic_contradiction double, soft_logic_score double")
    assert [round(r[0], 6) for r in df.select(structural.final_score()).collect()] == [0.6, 0.6, 0.31, 1.0]


def relations(spark, n=10, cases=("c1", "c2")):
    return spark.createDataFrame([(c, f"service:s{i}", "calls", f"service:t{i}", "g") for c in cases for i in range(n)], REL + ", group_id string")


def test_thresholds_mask_as_ranks_do(spark):
    r = relations(spark, 57).unionByName(relations(spark, 3, ("c3",)).withColumn("group_id", F.lit("h")))
    for ratio in (0.0, 0.1, 0.4, 0.5, 1.0):
        ranked = masking.hash_mask(r, "group_id", ratio)
        for group, n in (("g", 57), ("h", 3)):
            ranks = sorted(x["rank"] for x in ranked.filter(F.col("group_id") == group).collect())
            assert ranks == list(range(1, n + 1))
        missing = {(x["group_id"], x["source"]) for x in ranked.filter("missing").collect()}
        seen, gone = masking.group_mask(r, ratio)
        assert {(x["group_id"], x["source"]) for x in gone.collect()} == missing
        assert seen.count() + gone.count() == r.count() and seen.columns == r.columns


def test_masks_nest_and_are_shared(spark):
    r = relations(spark)
    seen = []
    for ratio in (0.2, 0.4, 0.6):
        visible, missing = masking.group_mask(r, ratio)
        by = {c: triples(missing.filter(F.col("case_id") == c)) for c in ("c1", "c2")}
        assert by["c1"] == by["c2"] and len(by["c1"]) == 10 * ratio
        assert triples(visible) | by["c1"] == triples(r) and not triples(visible) & by["c1"]
        seen.append(by["c1"])
    assert seen[0] < seen[1] < seen[2]
    assert triples(masking.group_mask(r, 0.4, seed=7)[1]) != seen[1]


def test_case_masks_differ_by_case_and_round_half_even(spark):
    visible, missing = masking.case_mask(relations(spark).drop("group_id"), 0.4)
    by = {c: triples(missing.filter(F.col("case_id") == c)) for c in ("c1", "c2")}
    assert by["c1"] != by["c2"]
    assert masking.case_mask(relations(spark, 5, ("c1",)).drop("group_id"), 0.5)[1].count() == 2


def test_type_mask_keeps_the_pair(spark):
    m = masking.type_mask(relations(spark, 4, ("c1",)).drop("group_id"), 0.5)
    assert m.count() == 4 and m.filter(F.col("relation") == MASKED_STRUCTURAL).count() == 2 and m.filter("truth = 'calls'").count() == 4


def test_bad_ratios_are_refused(spark):
    with pytest.raises(ValueError):
        masking.group_mask(relations(spark), 1.5)
    with pytest.raises(ValueError):
        structural.recover(obs(spark, ("c", "service:a", "service:b", "trace_parent_child", 1.0)), threshold=2)


def test_random_mask_is_python_sampling(spark):
    known = spark.createDataFrame([("c", i, f"a{i}", "dependency_propagates_to", f"b{i}") for i in range(11)], "case_id string, pos int, source string, relation string, target string")
    _, gone = masking.removal_mask(known, 0.4)
    want = random.Random(masking.case_seed("c", 42)).sample(range(11), 4)
    assert {r["pos"] for r in gone.collect()} == set(want)


def test_stage1_run(spark):
    o = obs(spark, ("c", "service:kiosk", "service:ledger", "trace_parent_child", 0.98), ("c", "service:ledger", "pod:ledger-x7", "service_pod_cooccurrence", 0.98))
    r = spark.createDataFrame([("c", "service:kiosk", "calls", "service:ledger", "g"), ("c", "service:ledger", "deployed_on", "pod:ledger-x7", "g")], REL + ", group_id string")
    cases = spark.createDataFrame([("c",)], "case_id string")
    s = evaluation.stage1(r, o, cases, 0.5)
    assert s["visible"].count() == s["missing"].count() == 1
    row = s["rows"].first()
    assert (row["precision"], row["recall"], row["f1"]) == (1, 1, 1) and s["ceiling"].first()["ceiling"] == 1
    none = evaluation.typed_prf(s["added"].limit(0), s["missing"], cases).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0, 0, 0)
    with pytest.raises(ValueError):
        evaluation.mask_audit(r, s["missing"].limit(0), 0.5)


def test_typed_scores_are_exact(spark):
    cases = spark.createDataFrame([("c",), ("empty",)], "case_id string")
    gold = spark.createDataFrame([("c", "a", "calls", "b"), ("c", "a", "runs_on", "b")], REL)
    pred = spark.createDataFrame([("c", "a", "calls", "b"), ("c", "a", "deployed_on", "b"), ("c", "x", "other", "y")], REL)
    got = {r["case_id"]: r for r in evaluation.typed_prf(pred, gold, cases).collect()}
    assert (got["c"]["precision"], got["c"]["recall"], got["c"]["f1"]) == (0.5, 0.5, 0.5)
    assert (got["empty"]["precision"], got["empty"]["recall"], got["empty"]["f1"]) == (1, 1, 1)
    assert [tuple(r)[:4] for r in evaluation.per_relation(pred, gold).orderBy("relation").collect()] == [("calls", 1, 0, 0), ("deployed_on", 0, 1, 0), ("runs_on", 0, 0, 1)]


def test_contrast_arithmetic(spark):
    df = spark.createDataFrame([(0.9, 0.1), (0.0, 0.0), (0.1, 0.1), (0.2, 0.0)], "a double, b double")
    got = df.select(*[c.alias(n) for n, c in semantic.contrast(F.col("a"), F.col("b")).items()]).collect()
    assert [tuple(round(x, 6) for x in r) for r in got] == [(0.9, 0.1, 0.0), (0.5, 0.5, 1.0), (0.5, 0.5, 0.6), (0.7, 0.3, 0.6)]


def test_model_sees_premises_in_order_and_batches(spark):
    o = obs(spark, *[("c", "service:a", f"service:b{i}", "trace_parent_child", 0.98) for i in range(40)])

    def model():
        def run(premises, claims):
            assert len(premises) == len(claims) <= 32
            return [0.8 if "only co-observed" not in c else 0.2 for c in claims]

        return run

    r = structural.recover(o, semantic=semantic.structural_scorer(model)).collect()
    assert len(r) == 40 and all(abs(x["semantic_support"] - 0.8) < 1e-9 for x in r)
    claims = semantic.structural_claims(structural.hypotheses(o), o).filter("target = 'service:b3'").first()
    assert claims["positive"] == "service:a calls service:b3." and "evidence_kind=trace_parent_child; confidence=0.980; count=1." in claims["premise"]


def test_no_cartesian_and_no_gold_in_the_plan(spark):
    o = observations.collect(traces(spark))
    plan = structural.recover(o)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "gold" not in plan
