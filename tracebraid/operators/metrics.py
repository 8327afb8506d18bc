"""Set metrics of edges, nodes and roots; path reachability; classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import is_loadgen, normalize_service, ratio_of
from ..functions.predicates import without_loadgen
from ..schemas import CAUSAL
from .graph import reachable


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def prf(predicted: DataFrame, gold: DataFrame, cases: DataFrame, key: list[str], empty_recall: float | None = None) -> DataFrame:
    """Per case tp, fp, fn, precision, recall, f1 of distinct keys.

    Both empty: all 1.  No prediction: precision 0, or, if ``empty_recall`` is
    given, 1 only without gold; no gold: recall 0, or ``empty_recall``.
    """
    p = predicted.select("case_id", *key).distinct().withColumn("p", F.lit(1))
    g = gold.select("case_id", *key).distinct().withColumn("g", F.lit(1))
    j = p.join(g, ["case_id", *key], "full_outer")
    n = j.groupBy("case_id").agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    n = cases.select("case_id").distinct().join(n, "case_id", "left").na.fill(0, ["tp", "fp", "fn"])
    return with_scores(n, empty_recall)


def with_scores(n: DataFrame, empty_recall: float | None = None) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn."""
    none = (F.col("tp") + F.col("fp") + F.col("fn")) == 0
    p = F.when(none, 1.0).otherwise(ratio_of(F.col("tp"), F.col("tp") + F.col("fp")))
    r = F.when(none, 1.0).otherwise(ratio_of(F.col("tp"), F.col("tp") + F.col("fn"), 0.0 if empty_recall is None else empty_recall))
    return n.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def service_pairs(edges: DataFrame) -> DataFrame:
    e = edges.filter(without_loadgen()).select("case_id", normalize_service("source").alias("source"), normalize_service("target").alias("target"))
    return e.distinct()


def edge_prf(predicted: DataFrame, gold: DataFrame, cases: DataFrame) -> DataFrame:
    return prf(service_pairs(predicted), service_pairs(gold), cases, ["source", "target"])


def _roots(df: DataFrame) -> DataFrame:
    return df.filter(~is_loadgen("node")).select("case_id", normalize_service("node").alias("node"))


def node_prf(predicted: DataFrame, gold: DataFrame, cases: DataFrame, roots: DataFrame | None = None, gold_roots: DataFrame | None = None) -> DataFrame:
    def nodes(edges: DataFrame, more: DataFrame | None) -> DataFrame:
        n = service_pairs(edges).select("case_id", F.explode(F.array("source", "target")).alias("node"))
        return n if more is None else n.unionByName(_roots(more))

    return prf(nodes(predicted, roots), nodes(gold, gold_roots), cases, ["node"])


def root_prf(predicted: DataFrame, gold: DataFrame, cases: DataFrame) -> DataFrame:
    return prf(_roots(predicted), _roots(gold), cases, ["node"])


def root_hits(predicted: DataFrame, gold: DataFrame, cases: DataFrame) -> DataFrame:
    """any, all, exact, hit@1 and hit@3 of ranked roots (case_id, node, rank); loadgen is not left out here."""
    sets = lambda df, name: df.groupBy("case_id").agg(F.array_sort(F.collect_set(normalize_service("node"))).alias(name))
    first = lambda k: sets(predicted.filter(F.col("rank") <= k), f"p{k}")
    j = cases.select("case_id").distinct()
    for df in (sets(predicted, "p"), sets(gold, "g"), first(1), first(3)):
        j = j.join(df, "case_id", "left")
    j = j.select("case_id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("p", "g", "p1", "p3")])
    yes = lambda c: c.cast("double")
    return j.select(
        "case_id",
        yes(F.arrays_overlap("p", "g")).alias("any_hit"),
        yes((F.size("g") > 0) & (F.size(F.array_except("g", "p")) == 0)).alias("all_hit"),
        yes(F.col("p") == F.col("g")).alias("exact"),
        yes(F.arrays_overlap("p1", "g")).alias("hit_1"),
        yes(F.arrays_overlap("p3", "g")).alias("hit_3"),
    )


def path_reachability(predicted: DataFrame, roots: DataFrame, gold_roots: DataFrame, alarms: DataFrame, cases: DataFrame) -> DataFrame:
    """1 where a correct root reaches a gold alarm over predicted pairs; a root that is an alarm needs no edge."""
    right = _roots(roots).distinct().join(_roots(gold_roots).distinct(), ["case_id", "node"])
    reach = reachable(service_pairs(predicted), right)
    hit = reach.join(_roots(alarms).distinct(), ["case_id", "node"]).select("case_id").distinct().withColumn("hit", F.lit(1.0))
    return cases.select("case_id").distinct().join(hit, "case_id", "left").select("case_id", F.coalesce("hit", F.lit(0.0)).alias("path_reachability"))


def alarms_or_symptoms(alarms: DataFrame, symptoms: DataFrame) -> DataFrame:
    """Where paths are to lead: a case's alarms or, without any, its symptoms."""
    rest = symptoms.join(alarms.select("case_id").distinct(), "case_id", "left_anti")
    return alarms.select("case_id", "node").unionByName(rest.select("case_id", "node"))


def mean_reachability(predicted: DataFrame, roots: DataFrame, symptoms: DataFrame, cases: DataFrame) -> DataFrame:
    """The older measure: the share of (root, symptom) pairs that are connected; both lists as they are, with repeats and load generators."""
    named = lambda df: df.groupBy("case_id", normalize_service("node").alias("node")).agg(F.count("*").alias("n"))
    r, s = named(roots), named(symptoms)
    reach = reachable(service_pairs(predicted), r).withColumn("reached", F.lit(1))
    pairs = r.withColumnsRenamed({"node": "root", "n": "n_root"}).join(s, "case_id").withColumn("pairs", F.col("n_root") * F.col("n"))
    m = pairs.join(reach, ["case_id", "root", "node"], "left").groupBy("case_id").agg((F.sum(F.when(F.col("reached") == 1, F.col("pairs")).otherwise(0)) / F.sum("pairs")).alias("reachability"))
    return cases.select("case_id").distinct().join(m, "case_id", "left").na.fill(0.0, ["reachability"])


def classification(predicted: DataFrame, truth: DataFrame, cases: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and f1 over masked rows, each row once as it stands; all 0 without rows."""
    p = service_pairs(predicted).withColumn("p", F.lit(True))
    t = truth.filter(without_loadgen()).select("case_id", normalize_service("source").alias("source"), normalize_service("target").alias("target"), (F.col("relation") == CAUSAL).alias("y"))
    j = t.join(p, ["case_id", "source", "target"], "left").withColumn("p", F.coalesce("p", F.lit(False)))
    n = j.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.col("p") & F.col("y")).alias("tp"), F.count_if(F.col("p") & ~F.col("y")).alias("fp"), F.count_if(~F.col("p") & F.col("y")).alias("fn"))
    n = cases.select("case_id").distinct().join(n, "case_id", "left").na.fill(0)
    pr, rc = ratio_of(F.col("tp"), F.col("tp") + F.col("fp")), ratio_of(F.col("tp"), F.col("tp") + F.col("fn"))
    acc = ratio_of(F.col("n") - F.col("fp") - F.col("fn"), F.col("n"))
    return n.withColumn("accuracy", acc).withColumn("precision", pr).withColumn("recall", rc).withColumn("f1", f1(pr, rc))
