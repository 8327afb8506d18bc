"""Queries by name: each takes (spark, sf_dir) and runs one operator over the whole sample."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expressions import entity_kind, entity_value
from ..operators import adjudication, answers, evaluation, evidence, incident, joint, masking, metrics, observations, reports, semantic, structural
from ..operators.graph import cut
from ..schemas import MASKED
from ..sources import layout, telemetry
from ..sources.shared import shared_dir
from .sample import RATIO, Sample

EDGE = ["case_id", "source", "relation", "target"]


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def scores(df: DataFrame, *key: str) -> DataFrame:
    return df.select(*key, *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], *r6("precision", "recall", "f1"))


def observed(*kinds: str) -> Callable[[Sample], DataFrame]:
    columns = ["case_id", "source", "target", "evidence_kind", "observation_count", "confidence", "text", "observation_id"]
    return lambda s: s.collected.filter(F.col("evidence_kind").isin(*kinds)).select(*columns)


def _laid_out_calls(s: Sample) -> DataFrame:
    """Calls with their numbers, from a table of spans laid out by trace."""
    spark = s.t.traces.sparkSession
    table = layout.write_spans(s.t.traces, f"spans_{uuid.uuid4().hex}", shared_dir(spark, "spans"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return observations.count_calls(table)


def _hypotheses(s: Sample) -> DataFrame:
    h = structural.hypotheses(s.observed)
    return h.select(*EDGE, F.round("abductive_support", 6).alias("support"), F.array_join("observation_ids", ",").alias("observation_ids"), F.size("evidence_kinds").cast("long").alias("n_kinds"))


def _logic(run) -> Callable[[Sample], DataFrame]:
    def f(s: Sample) -> DataFrame:
        h = run(structural.hypotheses(s.observed_normal), s.stage1["visible"])
        return h.select(*EDGE, "conflict", F.round("soft_logic_score", 6).alias("score"))

    return f


def _structural_semantics(s: Sample) -> DataFrame:
    h = structural.recover(s.observed, semantic=structural.deterministic_scorer)
    return h.select(*EDGE, F.round("semantic_support", 6).alias("support"), F.round("semantic_contradiction", 6).alias("contradiction"), *r6("final_score"))


def _mask(ratio: float) -> Callable[[Sample], DataFrame]:
    return lambda s: masking.hash_mask(s.relations, "group_id", ratio)


def _case_mask(s: Sample) -> DataFrame:
    return masking.hash_mask(s.relations, "case_id", RATIO)


def _mask_audit(s: Sample) -> DataFrame:
    return evaluation.mask_audit(s.relations, s.stage1["missing"], RATIO).select("n_full", "n_missing", *r6("realized_ratio"))


def _recovered(s: Sample) -> DataFrame:
    visible = s.stage1["visible"]
    return structural.recover_missing(visible, s.observed_normal, logic=structural.psl)[0].select(*EDGE)


def _added(s: Sample) -> DataFrame:
    return structural.recover_missing(s.stage1["visible"], s.observed_normal, logic=structural.psl)[1].select(*EDGE)


def _insertion(s: Sample) -> DataFrame:
    return evaluation.insertion_rate(s.stage1["rows"]).select(*r6("rate"))


def _counts(rows: DataFrame, by: str) -> DataFrame:
    return structural.type_counts(rows, by).select("case_id", F.explode("counts").alias(by, "n"))


def _variants(s: Sample) -> DataFrame:
    """Pooled scores of every stage-1 variant; the semantic ones with the deterministic scorer."""
    return scores(evaluation.stage1_variants(s.relations, s.observed_normal, s.cases, RATIO, semantic=structural.deterministic_scorer), "variant")


def _shift(s: Sample) -> DataFrame:
    m = evidence.metric_shift(s.t.metrics).withColumnsRenamed({"normal_median": "nmed", "abnormal_median": "amed"})
    return m.select("case_id", "service_name", "metric", *r6("nmed", "amed", "scale", "score", "onset"))


def _hits(s: Sample) -> DataFrame:
    return metrics.root_hits(s.prediction[2], s.gold_roots, s.cases)


def _graph_only(s: Sample) -> DataFrame:
    r = incident.graph_only_roots(s.evidence, s.symptoms)
    return r.select("case_id", "node", "rank", *r6("score"))


def _edge_rows(s: Sample) -> DataFrame:
    return metrics.edge_prf(s.prediction[1], s.gold_edges, s.cases)


def _root_rows(s: Sample) -> DataFrame:
    return metrics.root_prf(s.prediction[2], s.gold_roots, s.cases)


def _per_system(s: Sample) -> DataFrame:
    rows = s.cases.select("case_id", F.col("group_id").alias("system"))
    rows = rows.join(_edge_rows(s).select("case_id", F.col("f1").alias("edge_f1")), "case_id").join(_root_rows(s).select("case_id", F.col("f1").alias("root_f1")), "case_id")
    return reports.per_system(rows, ["edge_f1", "root_f1"]).select("system", "n", *r6("edge_f1", "root_f1"))


def _coverage(s: Sample) -> DataFrame:
    c = reports.coverage_audit(s.cases, s.observed, s.relations)
    return c.select("relation", "n", "n_cases", *r6("case_coverage"), "examples")


def _diagnostics(s: Sample) -> DataFrame:
    h = semantic.deterministic_causal(s.evidence, incident.causal_hypotheses(s.known, s.evidence)).withColumn("final_score", incident.final_score())
    d = reports.score_diagnostics(h)
    return d.select("n", *r6(*d.columns[1:]))


def _compare(s: Sample) -> DataFrame:
    """Two variants on two edge masks, so that each has pairs that the other lacks."""
    pair = ["case_id", "source", "target"]

    def run(picks: DataFrame, semantic) -> DataFrame:
        h, _, _ = incident.predict(masking.removal_mask(s.known, RATIO, picks=picks)[0], s.evidence, s.symptoms, semantic=semantic)
        return h.select(*pair, F.col("final_score").alias("score"), F.col("abductive_score").alias("base"))

    c = reports.compare(run(s.picks(), None), run(s.picks(3, 1), semantic.deterministic_causal))
    return c.select(*c.columns[:6], *r6(*c.columns[6:]))


def _claims(s: Sample) -> DataFrame:
    return semantic.structural_claims(structural.hypotheses(s.observed), s.observed).select(*EDGE, "positive", "negative")


def _soft_logic(s: Sample) -> DataFrame:
    h = incident.soft_logic(incident.causal_hypotheses(s.known, s.evidence), s.known, s.symptoms)
    return h.select("case_id", "source", "target", *r6("local", "soft_logic_score"))


def _psl(s: Sample) -> DataFrame:
    h = incident.psl(incident.causal_hypotheses(s.known, s.evidence), s.known, s.symptoms)
    return h.select("case_id", "source", "target", F.round("soft_logic_score", 4).alias("score"))


def _optimality(s: Sample) -> DataFrame:
    """Whether every variable of the joint logic over hidden labels is optimal."""
    known = s.hidden[0]
    h = cut(incident.causal_hypotheses(known, s.evidence))
    y, reach = joint.infer(h, known, s.symptoms)
    return joint.residuals(h, known, s.symptoms, y, reach).select("case_id", "kind", "source", "target", (F.col("residual") < 1e-5).alias("optimal"))


def _causal_mask(s: Sample) -> DataFrame:
    return s.hidden[0].select(*EDGE, "pos")


def _removal_mask(s: Sample) -> DataFrame:
    return masking.removal_mask(s.known, RATIO, picks=s.picks())[0].select(*EDGE, "pos")


def _seeded_masks(s: Sample) -> DataFrame:
    """Both masks by the seeded sample, with the kind of mask."""
    masks = (("causal", masking.causal_mask(s.known, s.gold_edges, RATIO)[0]), ("removal", masking.removal_mask(s.known, RATIO)[0]))
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("mask"), *EDGE, "pos") for kind, df in masks])


def _token_overlap_model():
    """A model of a few rules: the share of a claim's words that its premise has."""

    def run(premises: list[str], claims: list[str]) -> list[float]:
        return [len(set(c.split()) & set(p.split())) / max(1, len(set(c.split()))) for p, c in zip(premises, claims, strict=True)]

    return run


def _contrastive(s: Sample) -> DataFrame:
    h = structural.recover(s.observed, semantic=semantic.structural_scorer(_token_overlap_model))
    return h.select(*EDGE, *r6("semantic_support", "semantic_contradiction", "semantic_neutral", "final_score"))


def _section(prompt: str, title: str) -> list[str]:
    return prompt.split(f"\n\n{title}\n", 1)[1].split("\n\n", 1)[0].splitlines()


def _reading_client():
    """A client of a few rules that reads its prompt: what the scored run decided, an unknown id and name, a symptom, the first scored root."""

    def answer(prompt: str) -> str:
        ids = [int(line.split("|", 1)[0]) for line in _section(prompt, "MASKED_CANDIDATES") if "|decision=1|" in line]
        symptoms, roots = (json.loads("".join(_section(prompt, t))) for t in ("SYMPTOM_SERVICES", "SCORED_ROOTS"))
        return "```json\n" + json.dumps({"causal_ids": [*ids, 999_999], "root_causes": ["nobody", *symptoms[:1], *roots[:1]]}) + "\n```"

    return lambda prompts: [answer(p) for p in prompts]


def _adjudicated(part: int) -> Callable[[Sample], DataFrame]:
    """Of edges, roots and counts the ``part``-th."""

    def f(s: Sample) -> DataFrame:
        h, _, roots = incident.predict(s.hidden[0], s.evidence, s.symptoms, semantic=semantic.deterministic_causal)
        h, roots = cut(h), cut(roots)
        adjudication.require_scored(s.hidden[0], h)
        said = adjudication.ask(adjudication.prompts(s.hidden[0], s.evidence, s.symptoms, h, keep_loadgen=False, roots=roots), _reading_client)
        return adjudication.decide(cut(said), s.hidden[0], s.evidence, scored_roots=roots)[part]

    return f


def _splitting_tokenizer():
    """Tokens are what stands between bars and line ends."""
    return lambda texts: [[m.end() for m in re.finditer(r"[^|\n]+", t)] for t in texts]


def _budgeted(s: Sample) -> DataFrame:
    """The lines of masked candidates of each case, cut at 32 tokens."""
    c = adjudication.candidates(s.hidden[0])
    text = adjudication.lines(c, F.concat_ws("|", "id", "source", "target"), ["id"], "prompt")
    return answers.within_budget(text, _splitting_tokenizer, 32)


def _budgets(s: Sample) -> DataFrame:
    return _budgeted(s).select("case_id", "raw_tokens", "input_tokens", "truncated", "prompt")


def _account(s: Sample) -> DataFrame:
    return answers.run_account(_budgeted(s)).select("n", "raw_tokens", "input_tokens", *r6("truncation_rate"))


def _capped(s: Sample) -> DataFrame:
    """The three best candidates of each case."""
    return incident.causal_hypotheses(s.known, s.evidence, 3).select("case_id", "source", "target", "pos", *r6("abductive_score"))


def _legacy_reachability(s: Sample) -> DataFrame:
    return metrics.mean_reachability(s.prediction[1], s.prediction[2], s.symptoms, s.cases).select("case_id", *r6("reachability"))


def _graph_gold(s: Sample) -> DataFrame:
    """Gold read back from causal graph documents: spans as sources, mapped components as targets, roots as objects, terminal alarms in every other case."""
    span = F.concat(F.lit("span|"), "source", F.lit("::get|x"))
    part = F.concat(F.lit("part-"), "target")
    e = s.gold_edges.groupBy("case_id").agg(F.collect_list(F.struct(span.alias("source"), part.alias("target"))).alias("edges"), F.map_from_entries(F.collect_set(F.struct(part, "target"))).alias("component_to_service"))
    listed = lambda df, item, name: df.groupBy("case_id").agg(F.collect_list(item).alias(name))
    named = F.concat(F.lit("service|"), "node")
    d = e.join(listed(s.gold_roots, F.struct(named.alias("component")), "root_causes"), "case_id", "left").join(listed(s.alarms, named, "alarms"), "case_id", "left")
    even = F.substring_index("case_id", "-", -1).cast("int") % 2 == 0
    none = F.array().cast("array<string>")
    d = d.select("case_id", "edges", "component_to_service", "root_causes", F.when(even, F.col("alarms")).otherwise(none).alias("path_terminal_alarm_nodes"), F.when(even, none).otherwise(F.col("alarms")).alias("alarm_nodes"))
    roots, edges, alarms = evidence.gold_of_graph(*telemetry.causal_graphs(cut(d.select("case_id", F.to_json(F.struct(*d.columns[1:])).alias("value")))))
    node = lambda df, role: df.select("case_id", F.lit(role).alias("role"), F.col("node").alias("source"), F.lit(None).cast("string").alias("target"))
    return edges.select("case_id", F.lit("edge").alias("role"), "source", "target").unionByName(node(roots, "root")).unionByName(node(alarms, "alarm"))


def _pair_client():
    """A client of a few rules for direct prompts: hidden pairs in alphabetical order, the last symptom."""

    def answer(prompt: str) -> str:
        relations, symptoms = (json.loads("".join(_section(prompt, t))) for t in ("RELATIONS", "SYMPTOM_SERVICES"))
        pairs = [[r["source"], r["target"]] for r in relations if r["relation"] == MASKED and r["source"] < r["target"]]
        return json.dumps({"causal_pairs": [*pairs, ["alone"], "text"], "root_causes": symptoms[-1:]})

    return lambda prompts: [answer(p) for p in prompts]


def _direct(part: int) -> Callable[[Sample], DataFrame]:
    """Of edges and roots the ``part``-th."""

    def f(s: Sample) -> DataFrame:
        said = adjudication.ask(adjudication.pair_prompts(s.hidden[0], s.evidence, s.symptoms), _pair_client)
        return adjudication.decide_pairs(cut(said), s.hidden[0])[part]

    return f


def _pair_rows(s: Sample) -> DataFrame:
    known, truth = s.hidden
    h, edges, _ = incident.predict(known, s.evidence, s.symptoms, semantic=semantic.deterministic_causal)
    d = evaluation.pair_diagnostics(truth, edges, h)
    return d.select("case_id", "candidate_id", "source", "target", "truth_relation", "truth_causal", "predicted_causal", *r6("abductive_score", "temporal_score", "anomaly_score", "semantic_margin", "final_score"))


def _ablation(variant: str, mode: str = "relation", seeded: bool = False) -> Callable[[Sample], DataFrame]:
    def f(s: Sample) -> DataFrame:
        picks = None if seeded else s.picks()
        rows = evaluation.ablation(s.known, s.gold_edges, s.evidence, s.symptoms, s.gold_roots, s.alarms, s.cases, variant, mode, RATIO, semantic=semantic.deterministic_causal, picks=picks)
        return rows.select("case_id", *r6(*rows.columns[1:]))

    return f


def _qualified(s: Sample) -> DataFrame:
    return evaluation.qualification(s.known, s.gold_edges, s.evidence, s.symptoms, s.gold_roots, s.alarms, s.cases, RATIO, semantic=semantic.deterministic_causal, picks=s.picks())


def _qualification(s: Sample) -> DataFrame:
    return _qualified(s).select("case_id", *r6(*evaluation.QUALIFIED))


def _qualification_summary(s: Sample) -> DataFrame:
    return reports.means(_qualified(s), list(evaluation.QUALIFIED)).select("n", *r6(*evaluation.QUALIFIED))


def _rca(s: Sample) -> DataFrame:
    whole = ["n_predicted_roots", "n_predicted_edges"]
    return s.rca.select("case_id", "condition", *whole, *r6(*[c for c in s.rca.columns if c not in ("case_id", "condition", *whole)]))


def _deltas(s: Sample) -> DataFrame:
    d = evaluation.condition_deltas(s.rca)
    return d.select("case_id", *r6(*d.columns[1:]))


def _condition_means(s: Sample) -> DataFrame:
    d = evaluation.condition_summary(s.rca)
    return d.select("condition", "n", *r6(*d.columns[2:]))


def _standard(s: Sample) -> DataFrame:
    """Lists as text: roots in order, edges by name."""
    t = evaluation.standard_track(s.known, s.evidence, s.symptoms)
    edges = F.array_join(F.transform("propagation", lambda x: F.concat_ws("->", x.source, x.target)), ";")
    return t.select("case_id", F.array_join("root_causes", ",").alias("root_causes"), edges.alias("propagation"))


QUERIES: dict[str, Callable[[Sample], DataFrame]] = {
    "span_calls_observations": observed("trace_parent_child"),
    "laid_out_calls": _laid_out_calls,
    "deployment_observations": observed("service_pod_cooccurrence", "pod_node_cooccurrence"),
    "db_msg_observations": observed("db_client_context", "messaging_context"),
    "system_inventory": observed("system_inventory"),
    "observation_type_counts": lambda s: _counts(s.observed, "evidence_kind"),
    "abductive_hypotheses": _hypotheses,
    "structural_soft_logic": _logic(structural.soft_logic),
    "structural_psl_closed_form": _logic(structural.psl),
    "structural_semantic_scores": _structural_semantics,
    "propagation_edges": lambda s: s.known.select(*EDGE, "pos"),
    "relation_type_counts": lambda s: _counts(s.relations, "relation"),
    "group_mask_20": _mask(0.2),
    "group_mask_40": _mask(0.4),
    "group_mask_60": _mask(0.6),
    "case_mask": _case_mask,
    "type_mask": lambda s: masking.type_mask(s.relations, RATIO).select(*EDGE, "truth"),
    "mask_audit": _mask_audit,
    "recovered_topology": _recovered,
    "added_relations": _added,
    "stage1_missing_prf": lambda s: scores(s.stage1["rows"], "case_id"),
    "stage1_micro": lambda s: scores(s.stage1["micro"]),
    "stage1_per_type": lambda s: scores(s.stage1["per_relation"], "relation"),
    "candidate_ceiling": lambda s: s.stage1["ceiling"].select("case_id", "n_missing", "n_candidates", *r6("ceiling")),
    "candidate_ceiling_pooled": lambda s: evaluation.pooled_ceiling(s.stage1["ceiling"]).select("n_missing", "n_candidates", *r6("ceiling")),
    "false_insertion_rate": _insertion,
    "stage1_variants": _variants,
    "service_stats": lambda s: evidence.service_stats(s.t.traces).select("case_id", "win", "service_name", "n", *r6("error_rate", "p95", "p99")),
    "log_error_rate": lambda s: evidence.log_rates(s.t.logs).select("case_id", "win", "service_name", *r6("log_rate")),
    "metric_shift": _shift,
    "metric_argmax": lambda s: evidence.best_metric(evidence.metric_shift(s.t.metrics)).select("case_id", "service_name", "metric", *r6("score", "onset")),
    "evidence_all": lambda s: s.evidence.select("case_id", "pos", "evidence_id", "node", "kind", "signal", *r6("abnormality", "ts_s")),
    "node_anomaly": lambda s: evidence.node_anomaly(s.evidence).select("case_id", "node", *r6("anomaly", "first_s")),
    "symptoms": lambda s: s.symptoms.select("case_id", "node", "rank"),
    "incident_hypotheses": lambda s: incident.causal_hypotheses(s.known, s.evidence).select("case_id", "source", "target", "pos", *r6("temporal_score", "anomaly_score", "abductive_score")),
    "predicted_edges": lambda s: s.prediction[1].select("case_id", "source", "target"),
    "root_ranking": lambda s: s.prediction[2].select("case_id", "node", "rank", *r6("score")),
    "root_ranking_evidence_only": lambda s: incident.rank_by_evidence(s.evidence, s.symptoms).select("case_id", "node", "rank", *r6("score")),
    "graph_only_roots": _graph_only,
    "edge_prf": lambda s: scores(_edge_rows(s), "case_id"),
    "node_prf": lambda s: scores(metrics.node_prf(s.prediction[1], s.gold_edges, s.cases, s.prediction[2], s.gold_roots), "case_id"),
    "root_prf": lambda s: scores(_root_rows(s), "case_id"),
    "root_hits": _hits,
    "path_reachability": lambda s: metrics.path_reachability(s.prediction[1], s.prediction[2], s.gold_roots, metrics.alarms_or_symptoms(s.alarms, s.symptoms), s.cases),
    "per_system_summary": _per_system,
    "coverage_audit": _coverage,
    "observation_audit": lambda s: reports.observation_audit(s.cases, s.observed).select("n_cases", "n_observed_cases", "n_observations", *r6("mean_observations")),
    "score_diagnostics": _diagnostics,
    "a2_a3_compare": _compare,
    "normalize_service": lambda s: s.services(),
    "entity_parts": lambda s: s.observed.select("source").distinct().select("source", entity_kind("source").alias("kind"), entity_value("source").alias("value")),
    "claims": _claims,
    "incident_soft_logic": _soft_logic,
    "incident_psl_optimality": _optimality,
    "causal_graph_gold": _graph_gold,
    "prompt_budgets": _budgets,
    "run_account": _account,
    "candidate_cap": _capped,
    "legacy_reachability": _legacy_reachability,
    "causal_mask": _causal_mask,
    "removal_mask": _removal_mask,
    "contrastive_scores": _contrastive,
    "adjudication": _adjudicated(2),
    "adjudication_edges": _adjudicated(0),
    "adjudication_roots": _adjudicated(1),
    "direct_pairs_edges": _direct(0),
    "direct_pairs_roots": _direct(1),
    "pair_diagnostics": _pair_rows,
    "topology_condition_rows": _rca,
    "topology_condition_deltas": _deltas,
    "topology_condition_summary": _condition_means,
    "ablation_graph_only": _ablation("graph_only"),
    "ablation_abduction": _ablation("abduction"),
    "ablation_semantic": _ablation("semantic"),
    "ablation_edge_mask": _ablation("abduction", "edge"),
    "ablation_no_mask": _ablation("abduction", "none"),
    "standard_track": _standard,
    "qualification": _qualification,
    "qualification_summary": _qualification_summary,
    # Without SQL: the joint solver and samples by a seed.
    "incident_psl": _psl,
    "ablation_abduction_psl": _ablation("abduction_psl"),
    "ablation_full": _ablation("full"),
    "seeded_masks": _seeded_masks,
    "ablation_seeded": _ablation("abduction", seeded=True),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Sample(spark, sf_dir))) for name, f in QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered calls with their support, as propagation edges."""
    s = Sample(spark, sf_dir)
    h = structural.recover(s.observed.filter("evidence_kind = 'trace_parent_child'")).filter("selected")
    edges = structural.propagation_edges(h)
    support = h.select("case_id", entity_value("target").alias("source"), entity_value("source").alias("target"), "abductive_support")
    return edges.join(support, ["case_id", "source", "target"]).select(*EDGE, "abductive_support")

