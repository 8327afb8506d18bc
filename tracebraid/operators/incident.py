"""Stage 2: which dependencies took part in an incident, and which services began it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import clip01
from ..schemas import CAUSAL, MASKED, OBSERVED
from .evidence import node_anomaly
from .graph import best_reach
from .joint import psl, solve_global
from .structural import unscored

__all__ = ["causal_hypotheses", "final_score", "graph_only_roots", "local_score", "predict", "psl", "rank_by_evidence", "rank_roots", "soft_logic", "solve_global", "temporal_score"]

PAIR = ["source", "target"]


def temporal_score(first_source: Column, first_target: Column) -> Column:
    """By the delay from the source's first anomaly to the target's; 0 if unknown or negative."""
    d = first_target - first_source
    return F.when(d.isNull() | (d < 0), 0.0).when(d <= 5, 1.0).when(d <= 30, 0.8).when(d <= 120, 0.55).otherwise(0.2)


def causal_hypotheses(known: DataFrame, ev: DataFrame, most: int | None = None) -> DataFrame:
    """Unlabelled pairs, first occurrence each, that have evidence at both ends; by score, then position."""
    if most is not None and most <= 0:
        raise ValueError("most must be positive")
    pairs = known.filter(F.col("relation").isin(MASKED, OBSERVED)).groupBy("case_id", *PAIR).agg(F.min("pos").alias("pos"))
    nodes = node_anomaly(ev)
    end = lambda c: nodes.select("case_id", F.col("node").alias(c), F.col("anomaly").alias(f"{c}_anomaly"), F.col("first_s").alias(f"{c}_first"))
    h = pairs.join(end("source"), ["case_id", "source"]).join(end("target"), ["case_id", "target"])
    h = h.withColumn("temporal_score", temporal_score(F.col("source_first"), F.col("target_first")))
    h = h.withColumn("anomaly_score", F.least("source_anomaly", "target_anomaly"))
    h = h.withColumn("abductive_score", 0.55 * F.col("temporal_score") + 0.45 * F.col("anomaly_score"))
    h = unscored(h.drop("source_anomaly", "target_anomaly", "source_first", "target_first"))
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("abductive_score"), "pos"))
        h = h.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")
    return h


def final_score() -> Column:
    """Soft logic as it is if there is one; else the abductive score moved by the semantic margin."""
    moved = F.col("abductive_score") + 0.25 * (F.col("semantic_support") - F.coalesce("semantic_contradiction", F.lit(0.0)))
    return F.when(F.col("soft_logic_score").isNotNull(), F.col("soft_logic_score")).when(F.col("semantic_support").isNotNull(), clip01(moved)).otherwise(clip01("abductive_score"))


def local_score() -> Column:
    t, a = F.col("temporal_score"), F.col("anomaly_score")
    margin = F.when(F.col("semantic_support").isNotNull(), F.col("semantic_support") - F.coalesce("semantic_contradiction", F.lit(0.5))).otherwise(0.0)
    return clip01(0.55 * t + 0.45 * a + 0.20 * margin - (0.30 * (1 - a) + 0.15 * (1 - t)))


def soft_logic(h: DataFrame, known: DataFrame, symptoms: DataFrame) -> DataFrame:
    """Local scores, and how far symptoms reach back over them and over visible causes: best products of paths."""
    h = h.withColumn("local", local_score())
    edges = h.select("case_id", *PAIR, F.col("local").alias("w"))
    hard = known.filter(F.col("relation") == CAUSAL).select("case_id", *PAIR, F.lit(1.0).alias("w"))
    down = best_reach(edges.unionByName(hard), symptoms).withColumnRenamed("node", "target")
    j = h.join(down, ["case_id", "target"], "left").withColumn("reach", F.coalesce("reach", F.lit(0.0)))
    return j.withColumn("soft_logic_score", clip01(0.82 * F.col("local") + 0.18 * F.least("local", "reach"))).drop("reach")


def early(value: Column, partition: str = "case_id") -> Column:
    """1 for the earliest first anomaly of the candidates, 0 for the latest; 0 without one."""
    w = Window.partitionBy(partition)
    span = F.greatest(F.max(value).over(w) - F.min(value).over(w), F.lit(1e-9))
    return F.coalesce(1 - (value - F.min(value).over(w)) / span, F.lit(0.0))


def rank_roots(h: DataFrame, ev: DataFrame, symptoms: DataFrame, most: int = 3) -> DataFrame:
    """Sources of scored edges (case_id, source, target, score) that are no symptoms, by outgoing score, anomaly, earliness, lack of incoming score.

    Earliness compares these nodes alone.  A case whose sources are all symptoms has no row.
    """
    n = h.groupBy("case_id", F.col("source").alias("node")).agg(F.max("score").alias("out"))
    n = n.join(symptoms.select("case_id", "node").distinct(), ["case_id", "node"], "left_anti")
    into = h.groupBy("case_id", F.col("target").alias("node")).agg(F.max("score").alias("inc"))
    n = n.join(into, ["case_id", "node"], "left").join(node_anomaly(ev), ["case_id", "node"], "left").withColumn("early", early(F.col("first_s")))
    score = 0.38 * F.col("out") + 0.30 * F.coalesce("anomaly", F.lit(0.0)) + 0.20 * F.col("early") + 0.12 * (1 - F.coalesce("inc", F.lit(0.0)))
    return _ranked(n.withColumn("score", score), most)


def rank_by_evidence(ev: DataFrame, symptoms: DataFrame, most: int = 3) -> DataFrame:
    """Without edges: nodes that are no symptoms (all if there are none) by anomaly and earliness."""
    n = node_anomaly(ev).join(symptoms.select("case_id", "node").distinct().withColumn("is_symptom", F.lit(True)), ["case_id", "node"], "left")
    n = n.withColumn("others", F.max(F.col("is_symptom").isNull()).over(Window.partitionBy("case_id")))
    n = n.filter(F.col("is_symptom").isNull() | ~F.col("others")).withColumn("early", early(F.col("first_s")))
    return _ranked(n.withColumn("score", 0.75 * F.col("anomaly") + 0.25 * F.col("early")), most)


def _ranked(n: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "node"))
    return n.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most).select("case_id", "node", "score", "rank")


def graph_only_roots(ev: DataFrame, symptoms: DataFrame, most: int = 3) -> DataFrame:
    """The baseline's roots: all nodes with evidence but symptoms, by anomaly, first anomalous time, name; edges have no say."""
    n = node_anomaly(ev).join(symptoms.select("case_id", "node").distinct(), ["case_id", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("anomaly"), F.col("first_s").asc_nulls_last(), "node"))
    return n.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most).select("case_id", "node", F.col("anomaly").alias("score"), "rank")


def predict(known: DataFrame, ev: DataFrame, symptoms: DataFrame, semantic=None, logic=None, threshold: float = 0.5, most_roots: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored hypotheses, predicted edges, ranked roots) of all cases.

    Predicted edges are the visible causal ones and the hypotheses at or above
    the threshold, each triple once, visible ones first.
    """
    if not 0 <= threshold <= 1 or most_roots <= 0:
        raise ValueError("threshold must be in [0, 1] and most_roots positive")
    h = causal_hypotheses(known, ev)
    if semantic is not None:
        h = semantic(ev, h)
    if logic is not None:
        h = logic(h, known, symptoms)
    h = h.withColumn("final_score", final_score())
    chosen = h.filter(F.col("final_score") >= threshold)
    hard = known.filter(F.col("relation") == CAUSAL).select("case_id", *PAIR).distinct()
    edges = hard.unionByName(chosen.select("case_id", *PAIR)).distinct().withColumn("relation", F.lit(CAUSAL))
    scored = chosen.select("case_id", *PAIR, F.col("final_score").alias("score")).unionByName(hard.withColumn("score", F.lit(1.0)))
    roots = rank_roots(scored, ev, symptoms, most_roots)
    fallback = rank_by_evidence(ev.join(roots.select("case_id").distinct(), "case_id", "left_anti"), symptoms, most_roots)
    return h, edges, roots.unionByName(fallback)
