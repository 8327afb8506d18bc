"""Commands over case files, for spark-submit: ``python -m tracebraid.plans.runner COMMAND ...``.

Rows go to ``<out>/rows`` as JSON, written by the tasks; the summary, one small
table, to ``<out>/summary`` and to standard output.  Cases are taken in order of
their ids where ``--limit`` keeps the first ones.  No language model is part of this: the
semantic choices are the deterministic scorer or none.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluation, incident, reports, semantic, structural
from ..operators.graph import cut
from ..sources.cases import Cases, read_cases, require_same_cases, topology_group
from ..sources.folders import read_folders
from ..sources.shards import merge_case_shards, write_shard
from ..sources.telemetry import read_manifest
from . import build

EDGE = ["source", "relation", "target"]
CAUSAL_LOGIC = {"none": None, "soft": incident.soft_logic, "psl": incident.psl}
CAUSAL_SCORER = {"none": None, "deterministic": semantic.deterministic_causal}


def first_cases(cases: Cases, limit: int) -> Cases:
    """The first cases by id; 0 keeps all."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    if not limit:
        return cases
    kept = cut(cases.cases.select("case_id").orderBy("case_id").limit(limit))
    only = lambda df: df.join(kept, "case_id", "left_semi")
    return Cases(*(only(df) for df in (cases.cases, cases.edges, cases.nodes, cases.evidence, cases.observations, cases.paths)))


def _nodes(cases: Cases, role: str) -> DataFrame:
    return cases.nodes.filter(F.col("role") == role).select("case_id", "node")


def _edges(cases: Cases, role: str) -> DataFrame:
    return cases.edges.filter(F.col("role") == role).select("case_id", *EDGE, "pos")


def incident_tables(cases: Cases) -> dict[str, DataFrame]:
    """What the runs of stage 2 take, written once."""
    return {
        "known": cut(_edges(cases, "known")),
        "gold": cut(_edges(cases, "gold")),
        "ev": cut(cases.evidence),
        "symptoms": cut(_nodes(cases, "symptom").distinct()),
        "gold_roots": cut(_nodes(cases, "gold_root")),
        "alarms": cut(_nodes(cases, "gold_alarm")),
        "cases": cut(cases.cases.select("case_id").distinct()),
    }


def qualify(cases: Cases, mask_ratio: float = 0.0, seed: int = 42, scorer: str = "none", logic: str = "none") -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of the controlled run over hidden labels."""
    rows = cut(evaluation.qualification(**incident_tables(cases), ratio=mask_ratio, seed=seed, semantic=CAUSAL_SCORER[scorer], logic=CAUSAL_LOGIC[logic]))
    return rows.withColumn("mask_ratio", F.lit(mask_ratio)), reports.means(rows, list(evaluation.QUALIFIED))


def ablate(cases: Cases, variant: str = "full", mode: str = "relation", mask_ratio: float = 0.4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of one variant of the ablation under one kind of mask."""
    rows = cut(evaluation.ablation(**incident_tables(cases), variant=variant, mode=mode, ratio=mask_ratio, seed=seed, semantic=semantic.deterministic_causal))
    return rows, reports.means(rows, rows.columns[1:])


def standard(cases: Cases) -> tuple[DataFrame, DataFrame]:
    """(predictions, summary) of the track without masks: all labels are observed dependencies, gold is only scored against."""
    t = incident_tables(cases)
    t["known"] = evaluation.inference_view(t["known"])
    rows = cut(evaluation.ablation(**t, variant="abduction", mode="none"))
    said = evaluation.standard_track(t["known"], t["ev"], t["symptoms"])
    return rows.join(said, "case_id", "left"), reports.means(rows, rows.columns[1:])


def _reference(cases: Cases, reference: Cases | None, allow_derived: bool, same_path: bool) -> tuple[DataFrame, DataFrame, str]:
    """(typed relations with their group, cases with it, kind of the evaluation) of the independent reference or, if allowed, of the cases' own."""
    if reference is not None:
        require_same_cases(cases.cases, reference.cases)
    said = reference or cases
    text = lambda c: F.try_variant_get("metadata", f"$.{c}", "string")
    groups = cut(cases.cases.select("case_id", topology_group(text("system"), text("topology_id"), F.col("case_id")).alias("group_id")))
    documents = said.cases.join(groups.select("case_id"), "case_id", "left_semi")
    relations = structural.typed(_edges(said, "structural")).select("case_id", *EDGE).distinct()
    kind = evaluation.require_independent(evaluation.reference_audit(documents, relations, reference is not None, same_path), allow_derived)
    return cut(relations.join(groups, "case_id")), groups, kind


def recover(cases: Cases, reference: Cases | None = None, variant: str = "abduction", missing_ratio: float = 0.2, seed: int = 42, threshold: float = 0.5, allow_derived: bool = False, same_path: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of the recovery of masked relations: pooled scores, mean scores, ceiling, realised mask, wrong insertions."""
    relations, groups, kind = _reference(cases, reference, allow_derived, same_path)
    run = evaluation.stage1_variant(relations, cut(cases.observations), groups, missing_ratio, variant, structural.deterministic_scorer, seed=seed, threshold=threshold)
    rows = cut(run["rows"].join(run["ceiling"], "case_id", "left"))
    pooled = evaluation.micro(rows).select(*[F.col(c).alias(f"micro_{c}") for c in ("tp", "fp", "fn", "precision", "recall", "f1")])
    one_row = [
        reports.means(rows, ["precision", "recall", "f1"]),
        pooled,
        evaluation.pooled_ceiling(rows).select(F.col("ceiling").alias("candidate_ceiling")),
        evaluation.mask_audit(relations, run["missing"], missing_ratio).select("n_full", "n_missing", "realized_ratio"),
        evaluation.insertion_rate(rows).select(F.col("rate").alias("false_insertion_rate")),
    ]
    summary = one_row[0]
    for df in one_row[1:]:
        summary = summary.crossJoin(df)
    return rows, summary.withColumn("evaluation", F.lit(kind))


def recover_then_rank(cases: Cases, reference: Cases | None = None, topology_variant: str = "abduction_semantic_psl", rca_variant: str = "abduction_psl", missing_ratio: float = 0.4, seed: int = 42, threshold: float = 0.5, allow_derived: bool = False, same_path: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows per case and condition, summary per condition) of stage 2 over the incomplete, recovered and complete topology."""
    relations, groups, kind = _reference(cases, reference, allow_derived, same_path)
    run = evaluation.stage1_variant(relations, cut(cases.observations), groups, missing_ratio, topology_variant, structural.deterministic_scorer, seed=seed, threshold=threshold)
    topologies = cut(evaluation.conditions(run["visible"], run["added"], relations))
    t = incident_tables(cases)
    logic = CAUSAL_LOGIC["psl" if rca_variant.endswith("psl") else "none"]
    rows = cut(evaluation.topology_rca(topologies, t["ev"], t["symptoms"], t["gold"], t["gold_roots"], t["alarms"], t["cases"], logic=logic))
    return rows, evaluation.condition_summary(rows).withColumn("evaluation", F.lit(kind)).orderBy("condition")


def build_shard(spark: SparkSession, base: str, out: str, manifest: str | None = None, start: int = 0, end: int | None = None, all_labels: bool = False, standard_track: bool = False, limit: int = 0) -> dict:
    """Cases of the wanted folders as one finished shard; the manifest's system goes into their metadata."""
    t = read_folders(spark, base, attributed=not all_labels, manifest=manifest, start=start, end=end)
    t = replace(t, starts=cut(t.starts))
    gold = build.gold_of_folder(spark, base)
    wanted = t.starts.select("case_id")
    only = lambda df: cut(df.join(wanted, "case_id", "left_semi"))
    gold = build.Gold(only(gold.edges), only(gold.roots), only(gold.alarms))
    made = build.build(t, gold, both_windows=standard_track, require_edges=not standard_track, limit=limit)
    if manifest:
        told = build.with_manifest(made.cases.select("case_id"), read_manifest(spark, manifest).dropDuplicates(["name"]))
        known = F.to_json(F.struct("system", "primary_kind", "subtypes", "hybrid", "root_services"))
        made = replace(made, cases=told.select("case_id", F.parse_json(known).alias("metadata")))
    return write_shard(made, out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracebraid.plans.runner", description=__doc__.split("\n", 1)[0])
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, limit: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=about)
        if limit:
            c.add_argument("--data", required=True, help="case file or folder")
            c.add_argument("--limit", type=int, default=0, help="first cases by id, 0: all")
        c.add_argument("--out", required=True)
        return c

    c = command("qualification", "hidden causal labels: classification, hits, paths")
    c.add_argument("--mask-ratio", type=float, default=0.0)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--semantic", choices=sorted(CAUSAL_SCORER), default="none")
    c.add_argument("--logic", choices=sorted(CAUSAL_LOGIC), default="none")
    c = command("ablation", "one variant under one mask")
    c.add_argument("--variant", choices=["graph_only", *evaluation.ABLATIONS], default="full")
    c.add_argument("--mask-mode", choices=["relation", "edge", "none"], default="relation")
    c.add_argument("--mask-ratio", type=float, default=0.4)
    c.add_argument("--seed", type=int, default=42)
    command("standard", "predictions without masks")
    for name, about, ratio in (("recovery", "missing relations of a topology", 0.2), ("rca", "recovery, then root causes", 0.4)):
        c = command(name, about)
        c.add_argument("--reference-data")
        c.add_argument("--topology-missing-ratio", type=float, default=ratio)
        c.add_argument("--seed", type=int, default=42)
        c.add_argument("--relation-threshold", type=float, default=0.5)
        c.add_argument("--allow-derived-reference", action="store_true")
        if name == "recovery":
            c.add_argument("--variant", choices=sorted(evaluation.STAGE1_VARIANTS), default="abduction")
        else:
            c.add_argument("--topology-variant", choices=sorted(evaluation.STAGE1_VARIANTS), default="abduction_semantic_psl")
            c.add_argument("--rca-variant", choices=["abduction", "abduction_psl"], default="abduction_psl")
    c = command("build", "case folders to a shard of cases", limit=False)
    c.add_argument("--cache", required=True, help="URI of the folder with the case folders")
    c.add_argument("--manifest")
    c.add_argument("--start-index", type=int)
    c.add_argument("--end-index", type=int)
    c.add_argument("--all-labels", action="store_true")
    c.add_argument("--standard", action="store_true", help="topology of both windows")
    c.add_argument("--limit", type=int, default=0)
    c = command("merge", "shards to one case file", limit=False)
    c.add_argument("--glob", required=True)
    c.add_argument("--manifest-total", type=int, default=500)
    c.add_argument("--plain-files", action="store_true", help="take shards without a meta document too")
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Carry out a parsed command; the document that it prints."""
    if a.command == "merge":
        return merge_case_shards(spark, a.glob, a.out, a.manifest_total, not a.plain_files)
    if a.command == "build":
        if (a.start_index is None) != (a.end_index is None):
            raise ValueError("--start-index and --end-index go together")
        if a.start_index is not None and not a.manifest:
            raise ValueError("a slice needs --manifest")
        return build_shard(spark, a.cache, a.out, a.manifest, a.start_index or 0, a.end_index, a.all_labels, a.standard, a.limit)
    cases = first_cases(read_cases(spark, a.data), a.limit)
    if a.command == "qualification":
        rows, summary = qualify(cases, a.mask_ratio, a.seed, a.semantic, a.logic)
    elif a.command == "ablation":
        rows, summary = ablate(cases, a.variant, a.mask_mode, a.mask_ratio, a.seed)
    elif a.command == "standard":
        rows, summary = standard(cases)
    else:
        reference = read_cases(spark, a.reference_data) if a.reference_data else None
        common = {"missing_ratio": a.topology_missing_ratio, "seed": a.seed, "threshold": a.relation_threshold, "allow_derived": a.allow_derived_reference, "same_path": a.reference_data == a.data}
        rows, summary = recover(cases, reference, a.variant, **common) if a.command == "recovery" else recover_then_rank(cases, reference, a.topology_variant, a.rca_variant, **common)
    rows.write.mode("overwrite").json(f"{a.out.rstrip('/')}/rows")
    # One row, or one for each of three conditions.
    summary.coalesce(1).write.mode("overwrite").json(f"{a.out.rstrip('/')}/summary")
    return {"track": a.command, "out": a.out, "summary": [r.asDict() for r in summary.limit(3).collect()]}


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    print(json.dumps(run(SparkSession.builder.getOrCreate(), a), indent=2, ensure_ascii=False))


if __name__ == "__main__":
    main()
