"""Evaluation runs as one plan over all cases: masks, recovery, scores, conditions, summaries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import normalize_service, ratio_of
from ..functions.predicates import structural, without_loadgen
from ..schemas import CAUSAL, DERIVED
from ..sources.shared import never_broadcast
from . import incident, masking, metrics, structural as s1
from .graph import cut
from .incident import PAIR
from .metrics import prf, with_scores

EDGE = ["source", "relation", "target"]


def typed_prf(predicted: DataFrame, truth: DataFrame, cases: DataFrame) -> DataFrame:
    """Exact typed triples; without gold the recall is 1, without prediction the precision is 0 unless both are empty."""
    return prf(predicted.filter(structural()), truth.filter(structural()), cases, EDGE, 1.0)


def micro(n: DataFrame) -> DataFrame:
    """One row from summed tp, fp, fn."""
    total = n.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return with_scores(total, 1.0)


def per_relation(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn and scores by relation type, over all cases; types without any are left out."""
    p = predicted.filter(structural()).select("case_id", *EDGE).distinct().withColumn("p", F.lit(1))
    g = truth.filter(structural()).select("case_id", *EDGE).distinct().withColumn("g", F.lit(1))
    j = p.join(g, ["case_id", *EDGE], "full_outer")
    n = j.groupBy("relation").agg(
        F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )
    return with_scores(n, 1.0)


def candidate_ceiling(hypotheses: DataFrame, missing: DataFrame) -> DataFrame:
    """Per case the share of missing relations that are candidates at all; null where none is missing."""
    h = hypotheses.select("case_id", *EDGE).distinct().withColumn("h", F.lit(1))
    m = missing.select("case_id", *EDGE).distinct().join(never_broadcast(h), ["case_id", *EDGE], "left")
    return m.groupBy("case_id").agg(F.count("*").alias("n_missing"), F.count("h").alias("n_candidates"), (F.count("h") / F.count("*")).alias("ceiling"))


def mask_audit(relations: DataFrame, missing: DataFrame, ratio: float) -> DataFrame:
    """Realised ratio over all cases; an error if a positive ratio removed nothing."""
    row = relations.filter(structural()).agg(F.count("*").alias("n_full")).crossJoin(missing.agg(F.count("*").alias("n_missing")))
    if ratio > 0 and not row.first()["n_missing"]:
        raise ValueError("the mask removed no relation")
    return row.withColumn("realized_ratio", ratio_of("n_missing", "n_full"))


def stage1(relations: DataFrame, observations: DataFrame, cases: DataFrame, ratio: float, seed: int = 42, threshold: float = 0.5, **options) -> dict[str, DataFrame]:
    """Mask the reference's relations by group, recover, score.

    ``relations`` has group_id.  The result's tables are lazy and share the
    plan: visible, missing, hypotheses, added, rows, micro, per_relation, ceiling.
    """
    visible, missing = masking.group_mask(relations, ratio, seed)
    h = s1.recover(observations, visible, threshold=threshold, **options)
    found = h.filter("selected").select("case_id", *EDGE)
    added = found.join(never_broadcast(visible.select("case_id", *EDGE)), ["case_id", *EDGE], "left_anti")
    rows = typed_prf(added, missing, cases)
    return {
        "visible": visible,
        "missing": missing,
        "hypotheses": h,
        "added": added,
        "rows": rows,
        "micro": micro(rows),
        "per_relation": per_relation(added, missing),
        "ceiling": candidate_ceiling(h, missing),
    }


#: Stage-1 variants: whether a semantic scorer moves the scores, and the logic; topology_only recovers nothing.
STAGE1_VARIANTS: dict[str, tuple[bool, str] | None] = {
    "topology_only": None, "abduction": (False, "none"), "abduction_semantic": (True, "none"), "abduction_psl": (False, "psl"), "abduction_semantic_psl": (True, "psl"),
}


def stage1_variant(relations: DataFrame, observations: DataFrame, cases: DataFrame, ratio: float, variant: str, semantic=None, **options) -> dict[str, DataFrame]:
    """``stage1`` under a variant's name; ``semantic`` is the scorer of those that use one."""
    uses = STAGE1_VARIANTS[variant]
    if uses is None:
        return stage1(relations, observations.limit(0), cases, ratio, **options)
    if uses[0] and semantic is None:
        raise ValueError(f"{variant} needs a semantic scorer")
    return stage1(relations, observations, cases, ratio, semantic=semantic if uses[0] else None, logic=s1.LOGIC[uses[1]], **options)


def stage1_variants(relations: DataFrame, observations: DataFrame, cases: DataFrame, ratio: float, seed: int = 42, threshold: float = 0.5, semantic=None, **options) -> DataFrame:
    """``micro`` of every variant's ``stage1``, by ``variant``, in one run.

    Mask, hypotheses, their semantics and conflicts are made once; a variant is a
    column that says what it selects, and all of them meet the reference in one join.
    """
    if semantic is None:
        raise ValueError("some variants need a semantic scorer")
    visible, missing = masking.group_mask(relations, ratio, seed)
    h = s1.unscored(s1.with_semantics(observations, s1.hypotheses(observations, **options), semantic))
    said = ("semantic_support", "semantic_contradiction", "semantic_neutral")
    h = s1.with_conflicts(h.select("case_id", *EDGE, "abductive_support", *[F.col(c).alias(f"_{c}") for c in said]), visible)
    h = cut(h)
    for name, uses in STAGE1_VARIANTS.items():
        if uses is None:
            h = h.withColumn(name, F.lit(False))
            continue
        one = h.withColumns({c: F.col(f"_{c}") for c in said}) if uses[0] else h
        logic = s1.LOGIC[uses[1]]
        one = s1.decided(one if logic is None else logic(one, conflicts=False), threshold)
        h = one.select(*h.columns, F.col("selected").alias(name))
    names = list(STAGE1_VARIANTS)
    p = h.filter(structural()).groupBy("case_id", *EDGE).agg(*[F.max(v).alias(v) for v in names])
    kinds = [df.select("case_id", *EDGE, F.lit(gone).alias("gone")) for df, gone in ((visible, False), (missing, True))]
    g = kinds[0].unionByName(kinds[1]).groupBy("case_id", *EDGE).agg(F.max("gone").alias("g"), F.max(~F.col("gone")).alias("seen"))
    # A full join has no side that could be broadcast.
    j = p.join(g, ["case_id", *EDGE], "full_outer").na.fill(False, [*names, "g", "seen"])
    counts = []
    for v in names:
        added = F.col(v) & ~F.col("seen")
        counts += [F.count_if(added & F.col("g")).alias(f"tp_{v}"), F.count_if(added & ~F.col("g")).alias(f"fp_{v}"), F.count_if(~added & F.col("g")).alias(f"fn_{v}")]
    n = cases.select("case_id").distinct().join(j.groupBy("case_id").agg(*counts), "case_id", "left")
    total = n.agg(*[F.coalesce(F.sum(f"{c}_{v}"), F.lit(0)).alias(f"{c}_{v}") for v in names for c in ("tp", "fp", "fn")])
    rows = [F.struct(F.lit(v).alias("variant"), *[F.col(f"{c}_{v}").alias(c) for c in ("tp", "fp", "fn")]) for v in names]
    return with_scores(total.select(F.inline(F.array(*rows))), 1.0)


def insertion_rate(rows: DataFrame) -> DataFrame:
    """One row: the share of inserted relations that are wrong; 0 without any."""
    n = rows.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"))
    return n.select("tp", "fp", ratio_of("fp", F.col("tp") + F.col("fp")).alias("rate"))


def pooled_ceiling(ceiling: DataFrame) -> DataFrame:
    """One row over all cases: missing relations, those among the candidates, their share (null without any missing)."""
    n = ceiling.agg(F.coalesce(F.sum("n_missing"), F.lit(0)).alias("n_missing"), F.coalesce(F.sum("n_candidates"), F.lit(0)).alias("n_candidates"))
    return n.withColumn("ceiling", F.try_divide("n_candidates", "n_missing"))


def conditions(visible: DataFrame, added: DataFrame, full: DataFrame) -> DataFrame:
    """The three topologies of each case, by ``condition``."""
    parts = {"incomplete": visible, "recovered": visible.select("case_id", *EDGE).union(added.select("case_id", *EDGE)), "complete": full}
    return reduce(DataFrame.unionByName, [d.select("case_id", *EDGE).distinct().withColumn("condition", F.lit(c)) for c, d in parts.items()])


def topology_rca(topologies: DataFrame, ev: DataFrame, symptoms: DataFrame, gold_edges: DataFrame, gold_roots: DataFrame, alarms: DataFrame, cases: DataFrame, logic=None) -> DataFrame:
    """Stage 2 once for all (case, condition) pairs; a row of scores for each.

    Evidence and gold are the same in all conditions.  The composite case id is
    ``case|condition``.
    """
    names = cases.sparkSession.createDataFrame([("incomplete",), ("recovered",), ("complete",)], "condition string")
    both = F.concat_ws("|", "case_id", "condition")
    each = F.broadcast(names)

    def spread(df: DataFrame) -> DataFrame:
        return df.join(each, F.lit(True)).withColumn("case_id", both).drop("condition")

    topo = topologies.withColumn("case_id", both).drop("condition")
    known = with_positions(s1.propagation_edges(topo))
    all_cases, ev, symptoms = spread(cases), spread(ev), spread(symptoms)
    gold_edges, gold_roots, alarms = spread(gold_edges), spread(gold_roots), spread(alarms)
    _, edges, roots = incident.predict(known, ev, symptoms, logic=logic)
    named = lambda df, name: df.select("case_id", *[F.col(c).alias(f"{name}_{c}") for c in ("precision", "recall", "f1")])
    out = all_cases.select("case_id").distinct()
    for df in (
        named(metrics.edge_prf(edges, gold_edges, all_cases), "edge"),
        named(metrics.node_prf(edges, gold_edges, all_cases, roots, gold_roots), "node"),
        named(metrics.root_prf(roots, gold_roots, all_cases), "root"),
        metrics.root_hits(roots, gold_roots, all_cases),
        metrics.path_reachability(edges, roots, gold_roots, metrics.alarms_or_symptoms(alarms, symptoms), all_cases),
    ):
        out = out.join(df, "case_id")
    for df, name in ((roots, "n_predicted_roots"), (edges, "n_predicted_edges")):
        out = out.join(df.groupBy("case_id").agg(F.count("*").alias(name)), "case_id", "left").na.fill(0, [name])
    return out.withColumn("condition", F.substring_index("case_id", "|", -1)).withColumn("case_id", F.regexp_replace("case_id", "\\|[^|]*$", ""))


#: Scores of a row that are summarised, and those whose differences are reported.
SCORES = (
    "any_hit", "all_hit", "root_precision", "root_recall", "root_f1", "exact", "hit_1", "hit_3", "path_reachability",
    "node_precision", "node_recall", "node_f1", "edge_precision", "edge_recall", "edge_f1",
)
DELTAS = ("edge_f1", "node_f1", "root_f1", "any_hit", "exact", "path_reachability")


def condition_deltas(rows: DataFrame) -> DataFrame:
    """Per case: gain of the recovered over the incomplete topology, and what is left to the complete one."""
    p = rows.groupBy("case_id").pivot("condition", ["incomplete", "recovered", "complete"]).agg(*[F.first(c).alias(c) for c in DELTAS])
    return p.select(
        "case_id",
        *[(F.col(f"recovered_{c}") - F.col(f"incomplete_{c}")).alias(f"delta_{c}") for c in DELTAS],
        *[(F.col(f"complete_{c}") - F.col(f"recovered_{c}")).alias(f"gap_{c}") for c in DELTAS],
    )


def condition_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("condition").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in SCORES])


def with_positions(edges: DataFrame) -> DataFrame:
    """Adds ``pos`` in order of source and target within the case."""
    return edges.withColumn("pos", F.row_number().over(Window.partitionBy("case_id").orderBy("source", "target")).cast("long"))


#: Ablation variants: which semantic scorer and which logic they use.
ABLATIONS: dict[str, tuple[bool, str]] = {"abduction": (False, "none"), "semantic": (True, "none"), "abduction_psl": (False, "psl"), "full": (True, "psl")}


def ablation(known: DataFrame, gold: DataFrame, ev: DataFrame, symptoms: DataFrame, gold_roots: DataFrame, alarms: DataFrame, cases: DataFrame, variant: str, mode: str = "relation", ratio: float = 0.4, seed: int = 42, semantic=None, picks: DataFrame | None = None) -> DataFrame:
    """A row of scores per case for one variant and mask; ``graph_only`` uses visible causal edges alone.

    ``mode``: ``relation`` hides labels, ``edge`` removes edges, ``none`` masks nothing.
    """
    if mode not in ("relation", "edge", "none") or variant not in ("graph_only", *ABLATIONS):
        raise ValueError(f"unknown mode or variant: {mode}, {variant}")
    truth = None
    if mode == "relation":
        known, truth = masking.causal_mask(known, gold, ratio, seed, picks)
    elif mode == "edge":
        known, _ = masking.removal_mask(known, ratio, seed, picks)
    if variant == "graph_only":
        edges, roots = known.filter(F.col("relation") == CAUSAL), incident.graph_only_roots(ev, symptoms)
    else:
        uses, logic = ABLATIONS[variant]
        scorer = semantic if uses else None
        _, edges, roots = incident.predict(known, ev, symptoms, semantic=scorer, logic=incident.psl if logic == "psl" else None)
    out = metrics.edge_prf(edges, gold, cases).select("case_id", F.col("precision").alias("edge_precision"), F.col("recall").alias("edge_recall"), F.col("f1").alias("edge_f1"))
    more = [
        metrics.node_prf(edges, gold, cases, roots, gold_roots).select("case_id", F.col("f1").alias("node_f1")),
        metrics.root_prf(roots, gold_roots, cases).select("case_id", F.col("f1").alias("root_f1")),
        metrics.root_hits(roots, gold_roots, cases),
        metrics.path_reachability(edges, roots, gold_roots, metrics.alarms_or_symptoms(alarms, symptoms), cases),
    ]
    if truth is not None:
        more.append(metrics.classification(edges, truth, cases).select("case_id", F.when(F.col("n") > 0, F.col("f1")).alias("relation_f1"), F.when(F.col("n") > 0, F.col("accuracy")).alias("relation_accuracy")))
    for df in more:
        out = out.join(df, "case_id")
    return out


QUALIFIED = ("causal_relation_accuracy", "causal_relation_precision", "causal_relation_recall", "causal_relation_f1", "root_hit_at_1", "root_hit_at_3", "process_path_reachability")


def qualification(known: DataFrame, gold: DataFrame, ev: DataFrame, symptoms: DataFrame, gold_roots: DataFrame, alarms: DataFrame, cases: DataFrame, ratio: float = 0.0, seed: int = 42, semantic=None, logic=None, picks: DataFrame | None = None) -> DataFrame:
    """The controlled run over hidden labels: per case how hidden pairs were classified (0 without any), root hits, paths to gold alarms."""
    visible, truth = masking.causal_mask(known, gold, ratio, seed, picks)
    _, edges, roots = incident.predict(visible, ev, symptoms, semantic=semantic, logic=logic)
    out = metrics.classification(edges, truth, cases).select("case_id", *[F.col(c).alias(f"causal_relation_{c}") for c in ("accuracy", "precision", "recall", "f1")])
    out = out.join(metrics.root_hits(roots, gold_roots, cases).select("case_id", F.col("hit_1").alias("root_hit_at_1"), F.col("hit_3").alias("root_hit_at_3")), "case_id")
    reach = metrics.path_reachability(edges, roots, gold_roots, alarms, cases)
    return out.join(reach.withColumnRenamed("path_reachability", "process_path_reachability"), "case_id")


def pair_diagnostics(truth: DataFrame, predicted: DataFrame, h: DataFrame) -> DataFrame:
    """Hidden pairs in order, as ``candidate_id``, with their truth, the decision and the hypothesis's scores (null without one).

    Pairs meet by normalised names; of hypotheses with one name the last counts.
    """
    norm = [normalize_service("source").alias("source_norm"), normalize_service("target").alias("target_norm")]
    key = ["case_id", "source_norm", "target_norm"]
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("pos")) - 1
    t = truth.select("case_id", place.cast("long").alias("candidate_id"), *PAIR, *norm, F.col("relation").alias("truth_relation"), (F.col("relation") == CAUSAL).alias("truth_causal"))
    p = predicted.select("case_id", *norm).distinct().withColumn("predicted_causal", F.lit(True))
    scores = ("abductive_score", "temporal_score", "anomaly_score", "semantic_support", "semantic_contradiction", "semantic_neutral", "soft_logic_score", "final_score")
    last = h.groupBy("case_id", *norm).agg(F.max_by(F.struct(*scores), "pos").alias("s"))
    j = t.filter(without_loadgen()).join(p, key, "left").join(last, key, "left")
    margin = F.col("s.semantic_support") - F.col("s.semantic_contradiction")
    return j.select(*t.columns, F.coalesce("predicted_causal", F.lit(False)).alias("predicted_causal"), *[F.col(f"s.{c}").alias(c) for c in scores], margin.alias("semantic_margin"))


def inference_view(known: DataFrame, relation: str = "dependency_propagates_to") -> DataFrame:
    """Edges as a model may see them: every label an observed dependency; gold tables are not part of it."""
    return known.withColumn("relation", F.lit(relation))


def standard_track(known: DataFrame, ev: DataFrame, symptoms: DataFrame, logic=None, semantic=None) -> DataFrame:
    """Predictions per case as ``root_causes`` and ``propagation`` arrays."""
    _, edges, roots = incident.predict(inference_view(known), ev, symptoms, semantic=semantic, logic=logic)
    r = roots.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x.node).alias("root_causes"))
    e = edges.groupBy("case_id").agg(F.array_sort(F.collect_set(F.struct(*PAIR))).alias("propagation"))
    return r.join(e, "case_id", "left").withColumn("propagation", F.coalesce("propagation", F.array().cast("array<struct<source:string,target:string>>")))


def reference_audit(cases: DataFrame, relations: DataFrame, reference_given: bool = True, same_path: bool = False) -> DataFrame:
    """Per case the issues of its reference's provenance.

    ``cases`` has case_id and metadata (VARIANT); a reference must name source
    and version, be independent of the model's observations, be for the
    evaluator only, and hold a typed relation.
    """
    key = "$.reference_topology_provenance"
    text = lambda c: F.coalesce(F.trim(F.try_variant_get("metadata", f"{key}.{c}", "string")), F.lit(""))
    flag = lambda c: F.coalesce(F.try_variant_get("metadata", f"{key}.{c}", "boolean"), F.lit(False))
    present = F.try_variant_get("metadata", key, "map<string,variant>").isNotNull()
    legacy = F.lower(F.concat_ws(" ", *[F.try_variant_get("metadata", f"$.{c}", "string") for c in ("structural_relation_source", "structural_normalization_policy")]))
    n = relations.filter(structural()).groupBy("case_id").agg(F.count("*").alias("n_typed"))
    j = cases.join(n, "case_id", "left")
    derived = reduce(Column.__or__, [legacy.contains(m) for m in DERIVED])
    found = [
        F.when(F.lit(not reference_given), "independent reference was not provided"),
        F.when(F.lit(same_path), "data and reference are the same file"),
        F.when(~present, "missing reference_topology_provenance"),
        F.when(present & (text("source") == ""), "reference source is empty"),
        F.when(present & (text("version") == ""), "reference version is empty"),
        F.when(present & ~flag("independent_of_model_observations"), "independent_of_model_observations must be true"),
        F.when(present & ~flag("evaluator_only"), "evaluator_only must be true"),
        F.when(derived, "reference topology is derived from model observations"),
        F.when(F.coalesce("n_typed", F.lit(0)) == 0, "reference topology has no evaluable typed relations"),
    ]
    return j.select("case_id", F.array_compact(F.array(*found)).alias("issues"))


def require_independent(audit: DataFrame, allow_derived: bool = False) -> str:
    """``primary`` without issues; ``diagnostic_only`` where that is allowed; else an error."""
    bad = audit.filter(F.size("issues") > 0).select("case_id", "issues").limit(8).collect()
    if bad and not allow_derived:
        raise ValueError("primary evaluation requires an independent reference: " + "; ".join(f"{r['case_id']}: {', '.join(r['issues'])}" for r in bad))
    return "diagnostic_only" if bad else "primary"
