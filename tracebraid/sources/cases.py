"""Normalised cases: JSON lines to child tables and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import CASE_SCHEMA, CAUSAL

EDGE_ROLES = {"known": "known_edges", "gold": "gold_edges", "structural": "structural_relations"}
NODE_ROLES = {"symptom": "symptom_nodes", "gold_root": "gold_root_causes", "gold_alarm": "gold_alarm_nodes"}


@dataclass(frozen=True)
class Cases:
    """Child tables by ``case_id``; ``pos`` keeps the order of the lists."""

    cases: DataFrame
    edges: DataFrame
    nodes: DataFrame
    evidence: DataFrame
    observations: DataFrame
    paths: DataFrame


def read_cases(spark: SparkSession, path: str | list[str]) -> Cases:
    """Read cases; blank lines and missing optional fields are allowed."""
    raw = spark.read.schema(CASE_SCHEMA).json(path).filter("case_id IS NOT NULL")
    edges = None
    for role, column in EDGE_ROLES.items():
        one = _edges(raw, role, column)
        edges = one if edges is None else edges.unionByName(one)
    nodes = None
    for role, column in NODE_ROLES.items():
        one = raw.select("case_id", F.lit(role).alias("role"), F.posexplode(column).alias("pos", "node"))
        nodes = one if nodes is None else nodes.unionByName(one)
    evidence = raw.select("case_id", F.posexplode("evidence").alias("pos", "e")).select(
        "case_id", "pos", "e.evidence_id", "e.node", "e.kind", "e.signal", "e.abnormality", F.col("e.timestamp").alias("ts_s"), F.coalesce("e.text", F.lit("")).alias("text"), F.coalesce(F.to_json("e.metadata"), F.lit("{}")).alias("metadata")
    )
    count = F.try_variant_get("o.metadata", "$.observation_count", "bigint")
    observations = raw.select("case_id", F.posexplode("relation_observations").alias("pos", "o")).select(
        "case_id",
        "pos",
        "o.observation_id",
        "o.source",
        "o.target",
        "o.evidence_kind",
        F.coalesce("o.confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("o.text", F.lit("")).alias("text"),
        F.coalesce(count, F.lit(1)).alias("observation_count"),
        F.coalesce(F.to_json("o.metadata"), F.lit("{}")).alias("metadata"),
    )
    paths = raw.select("case_id", F.posexplode("gold_paths").alias("pos", "path"))
    return Cases(raw.select("case_id", "metadata"), edges, nodes, evidence, observations, paths)


def _edges(raw: DataFrame, role: str, column: str) -> DataFrame:
    """An edge is an object or a list of three; an object's relation may be missing."""
    items = F.expr(f"try_variant_get({column}, '$', 'array<variant>')")
    e = raw.select("case_id", F.posexplode(items).alias("pos", "e"))
    part: dict[str, Column] = {
        name: F.coalesce(F.try_variant_get("e", f"$.{name}", "string"), F.try_variant_get("e", f"$[{i}]", "string"))
        for i, name in enumerate(("source", "relation", "target"))
    }
    return e.select("case_id", F.lit(role).alias("role"), "pos", part["source"].alias("source"), F.coalesce(part["relation"], F.lit(CAUSAL)).alias("relation"), part["target"].alias("target"))


def _with_objects(df: DataFrame, name: str) -> DataFrame:
    """Metadata texts of a list's items as objects again; lists are sorted before, for objects have no order."""
    return df.withColumn(name, F.transform(name, lambda x: x.withField("metadata", F.parse_json(x.metadata))))


def case_rows(cases: Cases) -> DataFrame:
    """One nested row per case, in the field order of the format."""

    def gathered(df: DataFrame, value: Column, name: str) -> DataFrame:
        return df.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))), lambda x: x.v).alias(name))

    edge = F.struct("source", "relation", "target")
    out = cases.cases
    columns = [gathered(cases.nodes.filter(F.col("role") == r), F.col("node"), c) for r, c in NODE_ROLES.items()]
    columns += [gathered(cases.edges.filter(F.col("role") == r), edge, c) for r, c in EDGE_ROLES.items()]
    said = lambda df: F.col("metadata") if "metadata" in df.columns else F.lit(None).cast("string")
    item = F.struct("evidence_id", "node", "kind", "signal", "abnormality", F.col("ts_s").alias("timestamp"), "text", F.coalesce(said(cases.evidence), F.lit("{}")).alias("metadata"))
    columns.append(_with_objects(gathered(cases.evidence, item, "evidence"), "evidence"))
    counted = F.coalesce(said(cases.observations), F.to_json(F.struct("observation_count")))
    item = F.struct("observation_id", "source", "target", "evidence_kind", "confidence", "text", counted.alias("metadata"))
    columns.append(_with_objects(gathered(cases.observations, item, "relation_observations"), "relation_observations"))
    columns.append(gathered(cases.paths, F.col("path"), "gold_paths"))
    for df in columns:
        out = out.join(df, "case_id", "left")
    order = ["symptom_nodes", "known_edges", "evidence", "structural_relations", "relation_observations", "gold_root_causes", "gold_edges", "gold_paths", "gold_alarm_nodes"]
    return out.select("case_id", *[F.coalesce(c, F.array()).alias(c) if dict(out.dtypes)[c] == "array<string>" else F.col(c) for c in order], "metadata")


def write_cases(cases: Cases, path: str) -> None:
    case_rows(cases).write.mode("overwrite").json(path)


def require_same_cases(given: DataFrame, reference: DataFrame) -> None:
    """Every given case once, and once in the reference."""
    for df, name in ((given, "input"), (reference, "reference")):
        twice = df.groupBy("case_id").count().filter("count > 1").select("case_id").limit(5).collect()
        if twice:
            raise ValueError(f"duplicate {name} case ids: {[r[0] for r in twice]}")
    missing = given.join(reference, "case_id", "left_anti").select("case_id").limit(5).collect()
    if missing:
        raise ValueError(f"reference lacks cases: {[r[0] for r in missing]}")


def topology_group(system: Column, topology_id: Column, case_id: Column) -> Column:
    """The unit that shares a topology: the topology id, else the system; blank falls back on the case."""
    value = F.when(F.coalesce(topology_id, F.lit("")) != "", topology_id).otherwise(system)
    stripped = F.regexp_replace(value, "^\\s+|\\s+$", "")
    return F.when(F.coalesce(stripped, F.lit("")) != "", stripped).otherwise(case_id)
