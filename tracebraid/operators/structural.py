"""Stage 1: observations to relation hypotheses, scores and recovered topology."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import clip01, entity_kind, entity_value
from ..functions.predicates import structural
from ..schemas import GENERIC_PRIOR, OBSERVED, ONE_SOURCE, ONE_TARGET, PRIORS, RELATION_BY_KINDS
from ..sources.shared import never_broadcast

EDGE = ["source", "relation", "target"]


def hypotheses(observations: DataFrame, schema: dict[tuple[str, str], str | tuple[str, ...]] | None = None, generic_prior: float = GENERIC_PRIOR) -> DataFrame:
    """Typed candidates of observed pairs, with noisy-OR support over kinds of evidence.

    The ontology and the priors are tables of a few fixed rows and are
    broadcast; candidates are never made from pairs of nodes.
    """
    if not 0 <= generic_prior <= 1:
        raise ValueError("generic_prior must be in [0, 1]")
    spark = observations.sparkSession
    kinds = [(a, b, r) for (a, b), rs in (schema or RELATION_BY_KINDS).items() for r in ((rs,) if isinstance(rs, str) else rs)]
    ontology = F.broadcast(spark.createDataFrame(kinds, "sk string, tk string, relation string"))
    priors = F.broadcast(spark.createDataFrame([(k, r, p) for (k, r), p in PRIORS.items()], "evidence_kind string, relation string, prior double"))
    o = observations.withColumn("sk", entity_kind("source")).withColumn("tk", entity_kind("target"))
    o = o.join(ontology, ["sk", "tk"]).join(priors, ["evidence_kind", "relation"], "left")
    score = clip01(F.col("confidence") * F.coalesce("prior", F.lit(generic_prior)))
    o = o.select("case_id", *EDGE, F.struct("evidence_kind", score.alias("score"), "observation_id").alias("seen"))
    # One grouping: a pair's observations are a few, one for each kind of evidence, and mostly one in all.
    g = o.groupBy("case_id", *EDGE).agg(F.collect_list("seen").alias("seen"))
    first, single = F.get("seen", F.lit(0)), F.size("seen") == 1
    kinds = F.array_sort(F.array_distinct(F.transform("seen", lambda x: x.evidence_kind)))
    g = g.withColumn("evidence_kinds", F.when(single, F.array(first.evidence_kind)).otherwise(kinds))
    strongest = lambda k: F.array_max(F.transform(F.filter("seen", lambda x: x.evidence_kind == k), lambda x: x.score))
    unexplained = F.aggregate("evidence_kinds", F.lit(1.0), lambda left, k: left * (1 - strongest(k)))
    ids = F.array_sort(F.array_distinct(F.transform("seen", lambda x: x.observation_id)))
    return g.select(
        "case_id",
        *EDGE,
        (1 - F.when(single, 1 - first.score).otherwise(unexplained)).alias("abductive_support"),
        F.when(single, F.array(first.observation_id)).otherwise(ids).alias("observation_ids"),
        "evidence_kinds",
    )


def final_score(base="abductive_support") -> Column:
    """Soft logic if there is one, else the base moved by a quarter of the semantic margin."""
    moved = F.col(base) + 0.25 * (F.col("semantic_support") - F.coalesce("semantic_contradiction", F.lit(0.0)))
    return F.when(F.col("soft_logic_score").isNotNull(), F.col("soft_logic_score")).when(F.col("semantic_support").isNotNull(), clip01(moved)).otherwise(clip01(base))


def unscored(h: DataFrame) -> DataFrame:
    """Adds the score columns that are missing, as nulls."""
    for c in ("semantic_support", "semantic_contradiction", "semantic_neutral", "soft_logic_score"):
        if c not in h.columns:
            h = h.withColumn(c, F.lit(None).cast("double"))
    return h


def deterministic_semantics(h: DataFrame, base="abductive_support") -> DataFrame:
    s = clip01(base)
    return h.withColumn("semantic_support", s).withColumn("semantic_contradiction", 1 - s).withColumn("semantic_neutral", F.lit(0.0))


def deterministic_scorer(_: DataFrame, h: DataFrame) -> DataFrame:
    """``deterministic_semantics`` as a scorer for ``recover``."""
    return deterministic_semantics(h)


deterministic_scorer.whole = True


def with_conflicts(h: DataFrame, visible: DataFrame | None) -> DataFrame:
    """``conflict`` = 1 where a functional relation is visible with another end, and not with this one."""
    if visible is None:
        return h.withColumn("conflict", F.lit(0))
    # The end that has one partner, and the partner; other relations have none among the visible ones that are looked up.
    one = F.col("relation") == ONE_TARGET
    end, partner = F.when(one, F.col("source")).otherwise(F.col("target")), F.when(one, F.col("target")).otherwise(F.col("source"))
    v = visible.filter(F.col("relation").isin(ONE_TARGET, ONE_SOURCE)).select("case_id", "relation", end.alias("_end"), partner.alias("_partner"))
    v = v.groupBy("case_id", "relation", "_end").agg(F.collect_set("_partner").alias("_partners"))
    j = h.withColumn("_end", end).join(never_broadcast(v), ["case_id", "relation", "_end"], "left")
    return j.select(*h.columns, F.coalesce(~F.array_contains("_partners", partner), F.lit(False)).cast("int").alias("conflict"))


def soft_logic(h: DataFrame, visible: DataFrame | None = None, conflicts: bool = True) -> DataFrame:
    """Approximate logic: local score less the best competing relation of the pair and a functional conflict.

    Without ``conflicts`` they are not looked for: ``h`` has them.
    """
    h = with_conflicts(unscored(h), visible) if conflicts else unscored(h)
    margin = F.col("semantic_support") - F.coalesce("semantic_contradiction", F.lit(0.0))
    sem = F.when(F.col("semantic_support").isNull(), F.col("abductive_support")).otherwise(0.5 + 0.5 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), margin)))
    h = h.withColumn("local", clip01(0.7 * F.col("abductive_support") + 0.3 * sem))
    pairs = h.groupBy("case_id", "source", "target").agg(F.max(F.struct("local", "relation")).alias("best"), F.collect_list(F.struct("local", "relation")).alias("all"))
    j = h.join(never_broadcast(pairs), ["case_id", "source", "target"])
    rival = F.coalesce(F.array_max(F.transform(F.filter("all", lambda x: x.relation != F.col("relation")), lambda x: x.local)), F.lit(0.0))
    return j.withColumn("soft_logic_score", clip01(F.col("local") - 0.15 * rival - 0.65 * F.col("conflict"))).drop("best", "all")


def psl_score(p: Column, s: Column | None, k: Column | None, conflict: Column) -> Column:
    """The minimum of the squared hinges of one relation, exactly.

    Minimises 1.4 (p - y)+^2 + 1.1 (s - y)+^2 + 1.2 (k + y - 1)+^2 + (0.2 + 2 conflict) y^2
    over [0, 1]: the stationary point of every set of active hinges and every
    breakpoint is a candidate, the best one wins.
    """
    c = 0.2 + 2.0 * conflict
    if s is None:
        return 1.4 * p / (1.4 + c)
    k = F.lit(0.0) if k is None else k

    def loss(y: Column) -> Column:
        hinge = lambda x: F.pow(F.greatest(F.lit(0.0), x), F.lit(2.0))
        return 1.4 * hinge(p - y) + 1.1 * hinge(s - y) + 1.2 * hinge(k + y - 1) + c * y * y

    # One lambda for all sets of active hinges, so that the plan holds the loss once.
    sets = F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip("abd", bits, strict=True)]) for bits in product((0, 1), repeat=3)])
    still = F.transform(sets, lambda x: (1.4 * x.a * p + 1.1 * x.b * s + 1.2 * x.d * (1 - k)) / (1.4 * x.a + 1.1 * x.b + 1.2 * x.d + c))
    points = F.concat(still, F.array(p, s, 1 - k, F.lit(0.0), F.lit(1.0)))
    into = lambda y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))
    return F.array_min(F.transform(points, lambda y: F.struct(loss(into(y)).alias("loss"), into(y).alias("y")))).y


def psl(h: DataFrame, visible: DataFrame | None = None, competing: bool = False, conflicts: bool = True) -> DataFrame:
    """Joint logic, at its exact minimum.

    Without competition every relation stands alone and the minimum is a closed
    form.  With ``competing`` (an ontology with several relations for one pair of
    kinds) the relations of a pair are solved together; they are a few rows of the
    ontology.  Without ``conflicts`` they are not looked for: ``h`` has them.
    """
    scored = "semantic_support" in h.columns
    h = with_conflicts(unscored(h), visible) if conflicts else unscored(h)
    p, conflict = F.col("abductive_support"), F.col("conflict")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    alone = psl_score(p, None, None, conflict)
    if scored:
        cases = h.groupBy("case_id").agg(F.max(F.col("semantic_support").isNotNull()).alias("semantic"))
        h = h.join(cases, "case_id")
        alone = F.when(F.col("semantic"), psl_score(p, zero("semantic_support"), zero("semantic_contradiction"), conflict)).otherwise(alone)
    else:
        h = h.withColumn("semantic", F.lit(False))
    h = h.withColumn("soft_logic_score", alone)
    if competing:
        pair = ["case_id", "source", "target"]
        row = F.struct("relation", p.alias("p"), zero("semantic_support").alias("s"), zero("semantic_contradiction").alias("k"), "conflict", "semantic")
        pairs = h.groupBy(*pair).agg(F.array_sort(F.collect_list(row)).alias("rows")).filter(F.size("rows") > 1)
        solved = pairs.mapInPandas(_solved_pairs, "case_id string, source string, target string, relation string, _y double")
        h = h.join(never_broadcast(solved), [*pair, "relation"], "left").withColumn("soft_logic_score", F.coalesce("_y", "soft_logic_score")).drop("_y")
    return h.drop("semantic")


def solve_pair(p: np.ndarray, s: np.ndarray, k: np.ndarray, conflict: np.ndarray, semantic: bool, steps: int = 2000) -> np.ndarray:
    """The minimum for competing relations of one pair: each one's own hinges, and 0.8 (y_i + y_j - 1)+^2 for every ordered two."""
    y = z = np.full(len(p), 0.5)
    c, on, momentum = 0.2 + 2.0 * conflict, float(semantic), 1.0
    step = 1 / (2 * (1.4 + 2.3 + 2.2) + 6.4 * len(p))
    for _ in range(steps):
        over = np.maximum(0, z[:, None] + z[None] - 1)
        np.fill_diagonal(over, 0)
        slope = -2.8 * np.maximum(0, p - z) + on * (-2.2 * np.maximum(0, s - z) + 2.4 * np.maximum(0, k + z - 1)) + 2 * c * z + 3.2 * over.sum(axis=1)
        new = np.clip(z - step * slope, 0, 1)
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        if (new - y) @ (z - new) > 0:
            following = momentum = 1.0
        z = new + (momentum - 1) / following * (new - y)
        moved, y, momentum = np.abs(new - y).max(), new, following
        if moved < 1e-12:
            break
    return y


def _solved_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            column = lambda c: np.array([x[c] for x in row.rows], float)  # noqa: E731, B023
            y = solve_pair(column("p"), column("s"), column("k"), column("conflict"), any(x["semantic"] for x in row.rows))
            yield pd.DataFrame({"case_id": row.case_id, "source": row.source, "target": row.target, "relation": [x["relation"] for x in row.rows], "_y": y})


Scorer = Callable[[DataFrame, DataFrame], DataFrame]
Logic = Callable[[DataFrame, DataFrame | None], DataFrame]
LOGIC: dict[str, Logic | None] = {"none": None, "soft": soft_logic, "psl": psl}


def recover(
    observations: DataFrame, visible: DataFrame | None = None, semantic: Scorer | None = None, logic: Logic | None = None, threshold: float = 0.5, **options
) -> DataFrame:
    """Scored hypotheses with ``final_score`` and ``selected``."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1]")
    h = hypotheses(observations, **options)
    if semantic is not None:
        h = with_semantics(observations, h, semantic)
    if logic is not None:
        several = any(not isinstance(r, str) and len(r) > 1 for r in (options.get("schema") or {}).values())
        h = logic(h, visible, competing=True) if logic is psl and several else logic(h, visible)
    return decided(h, threshold)


def decided(h: DataFrame, threshold: float) -> DataFrame:
    """Adds ``final_score`` and ``selected``."""
    h = unscored(h).withColumn("final_score", final_score())
    return h.withColumn("selected", F.col("final_score") >= threshold)


def with_semantics(observations: DataFrame, h: DataFrame, semantic: Scorer) -> DataFrame:
    """What the scorer makes of the hypotheses.  Scorers marked whole keep every one; any other's result is compared with what it was given."""
    return scored_all(h, semantic(observations, h), rows=not getattr(semantic, "whole", False))


def scored_all(h: DataFrame, scored: DataFrame, rows: bool = True, key: tuple[str, ...] = ("case_id", *EDGE)) -> DataFrame:
    """What a scorer made of hypotheses, each of them once; an error, when it runs, if one is lost, and at once if columns lack."""
    lacking = [c for c in (*h.columns, "semantic_support", "semantic_contradiction") if c not in scored.columns]
    if lacking:
        raise TypeError(f"the scorer's result lacks {', '.join(lacking)}")
    if not rows:
        return scored
    marked = scored.dropDuplicates(list(key)).withColumn("_scored", F.lit(True))
    j = h.select(*key).join(never_broadcast(marked), list(key), "left")
    lost = F.raise_error(F.lit("the scorer lost a hypothesis")).cast("double")
    return j.withColumn("semantic_support", F.when(F.col("_scored"), F.col("semantic_support")).otherwise(lost)).select(*scored.columns)


def recover_missing(visible: DataFrame, observations: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(recovered topology, relations added to the visible ones), both distinct."""
    found = recover(observations, visible, **options).filter("selected").select("case_id", *EDGE)
    visible = visible.select("case_id", *EDGE)
    added = found.join(never_broadcast(visible), ["case_id", *EDGE], "left_anti")
    return visible.union(added).distinct(), added


def propagation_edges(relations: DataFrame) -> DataFrame:
    """Calls between services, turned round: the callee's trouble reaches the caller."""
    service = lambda c: entity_kind(c) == "service"
    calls = relations.filter((F.col("relation") == "calls") & service("source") & service("target"))
    e = calls.select("case_id", entity_value("target").alias("source"), F.lit(OBSERVED).alias("relation"), entity_value("source").alias("target"))
    return e.filter("source <> target").distinct()


def type_counts(rows: DataFrame, by: str = "relation") -> DataFrame:
    """Per case a sorted map of how often each type occurs."""
    n = rows.groupBy("case_id", by).agg(F.count("*").alias("n"))
    return n.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias("counts"))


def typed(relations: DataFrame) -> DataFrame:
    return relations.filter(structural())
