"""One test per finding of a review."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracebraid.operators import adjudication, incident, masking, structural
from tracebraid.schemas import CAUSAL, MASKED


def test_adjudication_keeps_scored_roots_and_visible_edges(spark):
    rows = [(c, i, a, r, b) for c in "xy" for i, (a, r, b) in enumerate([("ts-a", MASKED, "ts-b"), ("ts-b", CAUSAL, "ts-d")])]
    known = spark.createDataFrame(rows, "case_id string, pos long, source string, relation string, target string")
    scored = spark.createDataFrame([(c, n, k + 1) for c in "xy" for k, n in enumerate(["nobody", "ts-d", "b"])], "case_id string, node string, rank long")
    answers = spark.createDataFrame([("x", "no idea"), ("y", '{"causal_ids": [0], "root_causes": ["a"]}')], "case_id string, answer string")
    edges, roots, _ = adjudication.decide(answers, known, None, scored_roots=scored)
    assert {tuple(r) for r in edges.collect()} == {("x", "ts-b", CAUSAL, "ts-d"), ("y", "ts-b", CAUSAL, "ts-d"), ("y", "ts-a", CAUSAL, "ts-b")}
    assert {tuple(r) for r in roots.collect()} == {("x", "ts-d", 1), ("x", "ts-b", 2), ("y", "ts-a", 1)}
    ev = spark.createDataFrame([], "case_id string, evidence_id string, node string, kind string, signal string, abnormality double, ts_s double, text string")
    symptoms = spark.createDataFrame([("x", "ts-d")], "case_id string, node string")
    p = adjudication.prompts(known, ev, symptoms, roots=scored).filter("case_id = 'x'").first()["prompt"]
    assert 'SCORED_ROOTS\n["nobody","ts-d","b"]' in p


def test_soft_logic_reaches_a_chain_of_any_length(spark, monkeypatch):
    h = spark.createDataFrame([("c", "n0", "n1")], "case_id string, source string, target string")
    monkeypatch.setattr(incident, "local_score", lambda: incident.F.lit(0.5))
    known = spark.createDataFrame([("c", f"n{i}", CAUSAL, f"n{i + 1}") for i in range(1, 4)], "case_id string, source string, relation string, target string")
    symptoms = spark.createDataFrame([("c", "n4")], "case_id string, node string")
    # No rounds but those that the nodes ask for.
    assert abs(incident.soft_logic(h, known, symptoms).first()["soft_logic_score"] - 0.5) < 1e-9


def test_competing_relations_of_a_pair_are_solved_together(spark):
    observed = [("c", "service:a", "service:b", "trace_parent_child", 0.9, "o1", 1, "t"), ("c", "service:a", "service:d", "trace_parent_child", 0.5, "o2", 1, "t")]
    o = spark.createDataFrame(observed, "case_id string, source string, target string, evidence_kind string, confidence double, observation_id string, observation_count long, text string")
    schema = {("service", "service"): ("calls", "depends_on")}
    got = {(r["target"], r["relation"]): r["soft_logic_score"] for r in structural.recover(o, schema=schema, logic=structural.psl).collect()}
    grid = np.linspace(0, 1, 1001)
    for target, c in (("service:b", 0.9), ("service:d", 0.5)):
        p = {"calls": 0.98 * c, "depends_on": 0.35 * c}
        y, z = np.meshgrid(grid, grid, indexing="ij")
        loss = sum(1.4 * np.maximum(0, p[r] - v) ** 2 + 0.2 * v**2 for r, v in (("calls", y), ("depends_on", z))) + 1.6 * np.maximum(0, y + z - 1) ** 2
        i, j = np.unravel_index(loss.argmin(), loss.shape)
        assert abs(got[target, "calls"] - grid[i]) < 2e-3 and abs(got[target, "depends_on"] - grid[j]) < 2e-3
    alone = structural.recover(o, logic=structural.psl).collect()
    assert all(abs(r["soft_logic_score"] - 1.4 * r["abductive_support"] / 1.6) < 1e-12 for r in alone)


def test_prompts_carry_all_signals_by_normalised_name(spark):
    known = spark.createDataFrame([("x", 0, "ts-a", MASKED, "ts-b"), ("x", 1, "ts-b", CAUSAL, "ts-d"), ("x", 2, "ts-d", MASKED, "ts-a")], "case_id string, pos long, source string, relation string, target string")
    scored = [("x", "a", "b", 0, 0.25, 0.8, 0.5, 0.9, 0.1, 0.75, 0.75), ("x", "ts-A", "B", 1, 0.5, 0.8, 0.5, 0.9, 0.2, None, 0.4)]
    s = spark.createDataFrame(scored, "case_id string, source string, target string, pos long, abductive_score double, temporal_score double, anomaly_score double, semantic_support double, semantic_contradiction double, soft_logic_score double, final_score double")
    s = s.withColumn("truth_causal", F.lit(True))
    ev = spark.createDataFrame([("x", "e1", "ts-a", "trace", "latency", 0.75, None, "slow  a")], "case_id string, evidence_id string, node string, kind string, signal string, abnormality double, ts_s double, text string")
    symptoms = spark.createDataFrame([("x", "ts-d")], "case_id string, node string")
    p = adjudication.prompts(known, ev, symptoms, s, keep_loadgen=False).first()["prompt"]
    assert "0|ts-a|ts-b|decision=0|abd=0.500|temporal=0.800|anomaly=0.500|margin=0.700|logic=NA|final=0.400" in p  # the last of equal names
    assert "1|ts-d|ts-a|decision=0|abd=NA" in p and "VISIBLE_RELATIONS\nts-b|ts-d" in p and "truth" not in p and "t=NA|slow a" in p
    adjudication.require_scored(known, s)
    with pytest.raises(KeyError, match="x"):
        adjudication.require_scored(known, s.limit(0))
    q = adjudication.pair_prompts(known, ev.withColumn("pos", F.lit(1)), symptoms).first()["prompt"]
    assert '{"source":"ts-a","relation":"__MASKED_RELATION__","target":"ts-b"}' in q and '"abnormality":0.75' in q


def test_answers_of_pairs_and_broken_answers(spark):
    assert adjudication.parse_pairs('so {no} ```{"causal_pairs": [["a", "b"], ["c"], "d", ["e", "f", 1]], "root_causes": [1, 2, 3, 4]}```') == ([("a", "b"), ("e", "f")], ["1", "2", "3"], "json")
    assert adjudication.parse_pairs(None) == adjudication.parse_pairs("[1]") == ([], [], "failed")
    assert adjudication.parse_answer("{x} {\"causal_ids\": [3], \"root_causes\": null} tail }") == (["3"], [], "json")
    assert adjudication.parse_answer("Root_Causes = [\"a b\", 'c', 5] causal_ids=[]") == ([], ["a b", "c"], "regex_fallback")
    known = spark.createDataFrame([("x", 0, "a", MASKED, "b"), ("x", 1, "b", CAUSAL, "d"), ("y", 0, "b", CAUSAL, "d")], "case_id string, pos long, source string, relation string, target string")
    answers = spark.createDataFrame([("x", '{"causal_pairs": [["a", "b"], ["q", "r"]], "root_causes": ["a"]}')], "case_id string, answer string")
    edges, roots = adjudication.decide_pairs(answers, known)
    assert {tuple(r) for r in edges.collect()} == {("x", "a", CAUSAL, "b"), ("x", "q", CAUSAL, "r"), ("x", "b", CAUSAL, "d")}
    assert [tuple(r) for r in roots.collect()] == [("x", "a", 1)]


def test_given_picks_mask_as_a_sample_would(spark):
    known = spark.createDataFrame([("x", i, f"a{i}", "dependency_propagates_to", "b") for i in range(6)], "case_id string, pos long, source string, relation string, target string")
    gold = spark.createDataFrame([("x", "a1", "b"), ("x", "A-2", "b")], "case_id string, source string, target string")
    picks = spark.createDataFrame([("x", 1), ("x", 3), ("x", 3), ("x", 99)], "case_id string, place int")
    visible, truth = masking.causal_mask(known, gold, 0.5, picks=picks)
    assert [r["relation"] == MASKED for r in visible.orderBy("pos").collect()] == [False, True, False, True, False, False]
    assert [(r["source"], r["relation"] == CAUSAL) for r in truth.orderBy("pos").collect()] == [("a1", True), ("a3", False)]
    kept, gone = masking.removal_mask(known, 0.5, picks=picks)
    assert kept.count() == 4 and gone.count() == 2


def words():
    """A tokenizer whose tokens are words; local, so that workers need not import this file."""

    def make():
        import re

        return lambda texts: [[m.end() for m in re.finditer(r"\S+", t)] for t in texts]

    return make


def test_budget_cuts_at_a_token(spark):
    from tracebraid.operators import answers

    rows = spark.createDataFrame([("a", "one two  three"), ("b", "one two"), ("c", None), ("d", "")], "case_id string, prompt string")
    got = {r["case_id"]: tuple(r)[1:] for r in answers.within_budget(rows, words(), 2).collect()}
    assert got == {"a": ("one two", 3, 2, True), "b": ("one two", 2, 2, False), "c": ("", 0, 0, False), "d": ("", 0, 0, False)}
    account = answers.run_account(answers.within_budget(rows, words(), 2)).first()
    assert (account["n"], account["raw_tokens"], account["input_tokens"], account["truncation_rate"], account["seconds"]) == (4, 5, 4, 0.25, None)
    with pytest.raises(ValueError):
        answers.within_budget(rows, words(), 0)


def test_answers_are_asked_once(spark, tmp_path):
    from tracebraid.operators import answers

    def client():
        def run(prompts):
            with open(tmp_path / "calls", "a") as f:
                f.write("".join(f"{p}\n" for p in prompts))
            return [None if p == "mute" else p.upper() for p in prompts]

        return run

    calls = lambda: sorted((tmp_path / "calls").read_text().splitlines())
    rows = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "mute"), ("d", None)], "case_id string, prompt string")
    first = {r["case_id"]: (r["answer"], r["output_tokens"]) for r in answers.answered(rows, "m", client, f"{tmp_path}/store", make_tokenizer=words()).collect()}
    assert first == {"a": ("ONE", 1), "b": ("ONE", 1), "c": (None, 0), "d": ("", 0)} and calls() == ["", "mute", "one"]
    more = rows.union(spark.createDataFrame([("e", "two")], "case_id string, prompt string"))
    again = {r["case_id"]: r["answer"] for r in answers.answered(more, "m", client, f"{tmp_path}/store").collect()}
    assert again == {"a": "ONE", "b": "ONE", "c": None, "d": "", "e": "TWO"} and calls() == ["", "mute", "one", "two"]
    answers.answered(rows, "another", client, f"{tmp_path}/store").collect()
    assert len(calls()) == 7


def test_scored_run_must_fit():
    from tracebraid.operators import answers

    answers.require_run({"variant": "full", "mask_ratio": 0.4}, 0.4)
    for run in ({"variant": "abduction", "mask_ratio": 0.4}, {"variant": "full", "mask_ratio": 0.2}, {"variant": "full"}):
        with pytest.raises(ValueError):
            answers.require_run(run, 0.4)


def test_scorers_are_checked(spark):
    from tracebraid.operators import structural

    o = spark.createDataFrame([("c", "service:a", f"service:{x}", "trace_parent_child", 1.0, "", x, 1) for x in "bd"], "case_id string, source string, target string, evidence_kind string, confidence double, text string, observation_id string, observation_count int")
    whole = structural.recover(o, semantic=lambda _, h: structural.deterministic_semantics(h))
    assert whole.count() == 2 and whole.columns == structural.recover(o, semantic=structural.deterministic_scorer).columns
    with pytest.raises(Exception, match="lost a hypothesis"):
        structural.recover(o, semantic=lambda _, h: structural.deterministic_semantics(h).filter("target = 'service:b'")).collect()
    with pytest.raises(TypeError):
        structural.recover(o, semantic=lambda _, h: h)
