"""Telemetry to normalised cases: the two builders as one plan over all cases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import evidence, observations, structural
from ..operators.evaluation import with_positions
from ..operators.graph import cut
from ..sources.cases import Cases
from ..sources.telemetry import Telemetry, read_causal_graphs

EDGE = ["source", "relation", "target"]


@dataclass(frozen=True)
class Gold:
    """What the evaluation knows, never the models: edges, roots and alarms by case."""

    edges: DataFrame
    roots: DataFrame
    alarms: DataFrame


def gold_of_folder(spark: SparkSession, base: str) -> Gold:
    """The gold of all case folders below ``base``, from their causal graph documents."""
    roots, edges, alarms = evidence.gold_of_graph(*read_causal_graphs(spark, base))
    return Gold(edges, roots, alarms)


def attributed(t: Telemetry, labels: DataFrame) -> Telemetry:
    """The cases whose label says so; before anything of the others is read."""
    keep = F.broadcast(labels.filter("attributed").select("case_id"))
    return Telemetry(*(x.join(keep, "case_id", "left_semi") for x in (t.traces, t.metrics, t.logs, t.starts)))


def with_manifest(cases: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cases with the manifest's system, kinds and roots."""
    m = manifest.select(F.col("name").alias("case_id"), "system", "primary_kind", "subtypes", "hybrid", "root_services")
    return cases.join(m, "case_id", "left")


def manifest_roots(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.col("name").alias("case_id"), F.explode("root_services").alias("node")).distinct()


def build(t: Telemetry, gold: Gold, *, both_windows: bool = False, system: Column | None = None, require_edges: bool = True, limit: int = 0) -> Cases:
    """Cases from telemetry.

    The topology comes from the normal window, or from both (the standard
    track).  Cases need gold roots, known edges and evidence, and gold edges
    unless ``require_edges`` is off; ``limit`` keeps the first ones by name, 0 all.
    """
    seen = t if both_windows else t.window("normal")
    obs = cut(observations.collect(seen.traces, seen.metrics, seen.logs, system))
    relations = cut(structural.recover(obs).filter("selected").select("case_id", *EDGE))
    known = cut(with_positions(structural.propagation_edges(relations)))
    ev = cut(evidence.evidence(t))
    symptoms = evidence.symptoms(known, ev)
    valid = gold.roots.select("case_id").distinct()
    for df in (known, ev, *([gold.edges] if require_edges else [])):
        valid = valid.join(df.select("case_id"), "case_id", "left_semi")
    if limit:
        valid = valid.orderBy("case_id").limit(limit)
    valid = cut(valid)
    placed = lambda df, order: df.withColumn("pos", F.expr(f"row_number() OVER (PARTITION BY case_id ORDER BY {order}) - 1"))
    role = lambda df, name, order: placed(df, order).select("case_id", F.lit(name).alias("role"), "pos", *(EDGE if "source" in df.columns else ["node"]))
    causal = gold.edges.select("case_id", "source", F.lit("causal_propagates_to").alias("relation"), "target").distinct()
    edges = role(known.drop("pos"), "known", "source, target").unionByName(role(causal, "gold", "source, target")).unionByName(role(relations, "structural", "source, relation, target"))
    nodes = role(symptoms.select("case_id", "node", "rank"), "symptom", "rank").unionByName(role(gold.roots, "gold_root", "node")).unionByName(role(gold.alarms, "gold_alarm", "node"))
    only = lambda df: df.join(valid, "case_id", "left_semi")
    metadata = valid.withColumn("metadata", F.parse_json(F.lit("{}")))
    paths = valid.limit(0).select("case_id", F.lit(0).alias("pos"), F.array().cast("array<string>").alias("path"))
    return Cases(metadata, only(edges), only(nodes), only(ev), only(placed(obs, "source, evidence_kind, target")), paths)
