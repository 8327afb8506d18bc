"""Anomaly evidence: normal against abnormal windows, for all cases and services at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import clip01, fixed, to_number
from ..functions.predicates import is_time_metric, log_error, trace_error
from ..sources.telemetry import Telemetry
from .graph import cut
from .selection import ACCURACY, brackets_of_cells, in_cells, pick, quantiles


def service_stats(traces: DataFrame) -> DataFrame:
    """Per case, window and service: spans, error rate, exact p95 and p99 of the durations (0 without any), first time of an error."""
    d = to_number("duration") if "duration" in traces.columns else F.lit(None).cast("double")
    at = F.col("ts_s") if "ts_s" in traces.columns else F.lit(None).cast("double")
    t = traces.filter("service_name IS NOT NULL").select("case_id", "win", "service_name", d.alias("d"), trace_error(traces).alias("e"), at.alias("at"))
    key = ["case_id", "win", "service_name"]
    # Durations by cell, errors with them, in the first of two passes.
    cells = in_cells(t, key, "d", F.count("*").alias("n"), F.sum(F.col("e").cast("long")).alias("errors"), F.min(F.when(F.col("e"), F.col("at"))).alias("first_error"))
    others = (F.sum("n").alias("n"), (F.sum("errors") / F.sum("n")).alias("error_rate"), F.min("first_error").alias("first_error"))
    q = pick(t, brackets_of_cells(cells, t, key, "d", (0.95, 0.99), ACCURACY, *others), key, "d", (0.95, 0.99))
    p = lambda i: F.coalesce(F.get("q", F.lit(i)), F.lit(0.0))
    return q.select("case_id", "win", "service_name", "n", "error_rate", p(0).alias("p95"), p(1).alias("p99"), "first_error")


def log_rates(logs: DataFrame) -> DataFrame:
    l = logs.filter("service_name IS NOT NULL")
    return l.groupBy("case_id", "win", "service_name").agg(F.avg(log_error().cast("double")).alias("log_rate"))


def metric_shift(metrics: DataFrame) -> DataFrame:
    """Per case, service and metric of both windows: medians, robust scale, score and onset.

    Needs three normal and two abnormal numbers.  Medians are exact; the median
    deviation is a selection of its own, against the first.
    """
    key = ["case_id", "service_name", "metric"]
    m = metrics.filter(~is_time_metric()).select(*key, "win", "ts_s", to_number("value").alias("v")).filter("v IS NOT NULL AND service_name IS NOT NULL")
    middle = quantiles(m, [*key, "win"], "v", (0.5,)).select(*key, "win", F.col("_n").alias("n"), F.get("q", F.lit(0)).alias("median"))
    of = lambda win, c: F.max(F.when(F.col("win") == win, F.col(c)))
    sides = [x for w in ("normal", "abnormal") for x in (of(w, "median").alias(f"{w}_median"), F.coalesce(of(w, "n"), F.lit(0)).alias(f"n_{w}"))]
    # Read three times below.
    base = cut(middle.groupBy(*key).agg(*sides).filter("n_normal >= 3 AND n_abnormal >= 2"))
    gap = F.abs(F.col("v") - F.col("normal_median"))
    gaps = m.filter("win = 'normal'").join(base, key).select(*key, gap.alias("gap"))
    base = base.join(quantiles(gaps, key, "gap", (0.5,)).select(*key, F.get("q", F.lit(0)).alias("mad")), key)
    scale = F.greatest(1.4826 * F.col("mad"), 0.05 * F.abs("normal_median"), F.lit(1e-9))
    base = base.withColumn("scale", scale).withColumn("score", clip01(F.abs(F.col("abnormal_median") - F.col("normal_median")) / F.col("scale") / 6))
    late = m.filter("win = 'abnormal'").join(base.select(*key, "normal_median", "scale"), key).filter(gap / F.col("scale") >= 3)
    onset = late.groupBy(*key).agg(F.min("ts_s").alias("onset"))
    return base.join(onset, key, "left")


def best_metric(shift: DataFrame) -> DataFrame:
    """Per case and service the metric with the largest score, of equal ones the first by name; a score of 0 never wins."""
    return shift.filter("score > 0").groupBy("case_id", "service_name").agg(
        F.min_by(F.struct("metric", "score", "onset"), F.struct(-F.col("score"), "metric")).alias("b")
    ).select("case_id", "service_name", "b.*")


def evidence(t: Telemetry) -> DataFrame:
    """All evidence rows with ids in the fixed order of phases, services and signals."""
    key = ["case_id", "service_name"]
    stats = cut(service_stats(t.traces))

    def side(df: DataFrame, win: str, names: list[str], prefix: str) -> DataFrame:
        return df.filter(F.col("win") == win).select(*key, *[F.col(c).alias(prefix + c) for c in names])

    values = ["n", "error_rate", "p95", "p99"]
    normal, abnormal = side(stats, "normal", values, "n_"), side(stats, "abnormal", values, "a_")
    both = normal.join(abnormal, key, "full_outer").na.fill(0)
    starts = t.starts
    spans = t.traces.filter("win = 'abnormal' AND service_name IS NOT NULL")
    slow = spans.join(normal, key).filter(to_number("duration") > F.greatest(1.25 * F.col("n_p99"), 1.5 * F.col("n_p95")))
    first_slow = slow.groupBy(*key).agg(F.min("ts_s").alias("first_slow"))
    first_error = stats.filter("win = 'abnormal'").select(*key, "first_error")
    both = both.join(first_error, key, "left").join(first_slow, key, "left").join(starts, "case_id")

    def signal(df: DataFrame, order: int, kind: str, name: str | Column, score: Column, least: float, at: Column, text: Column) -> DataFrame:
        name = F.lit(name) if isinstance(name, str) else name
        rows = df.select(*key, F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), name.alias("signal"), score.alias("abnormality"), at.alias("ts_s"), text.alias("text"))
        return rows.filter(F.col("abnormality") >= least)

    start = F.col("start_s")
    # An onset of 0 counts as none.
    onset = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), start)
    service = F.col("service_name")
    drop = F.when(F.col("n_n") > 0, clip01((F.col("n_n") - F.col("a_n")) / F.col("n_n"))).otherwise(0.0)
    errors = clip01(F.greatest(F.lit(0.0), F.col("a_error_rate") - F.col("n_error_rate")) * 3)
    ratio = F.when((F.col("n_p95") > 0) & (F.col("a_p95") > F.col("n_p95")), F.col("a_p95") / F.col("n_p95"))
    slower = F.when(ratio.isNotNull(), clip01(F.log2(F.greatest(ratio, F.lit(1.0))) / 3)).otherwise(0.0)
    change = lambda what, a, b: F.concat(service, F.lit(f" {what} changed from "), fixed(F.col(a)), F.lit(" to "), fixed(F.col(b)), F.lit("."))
    rates = log_rates(t.logs)
    logs = side(rates, "normal", ["log_rate"], "n_").join(side(rates, "abnormal", ["log_rate"], "a_"), key, "full_outer").na.fill(0)
    first_log = t.logs.filter("win = 'abnormal'").filter(log_error()).groupBy(*key).agg(F.min("ts_s").alias("first_log"))
    logs = logs.join(first_log, key, "left").join(starts, "case_id")
    log_score = clip01(F.greatest(F.lit(0.0), F.col("a_log_rate") - F.col("n_log_rate")) * 3)
    best = best_metric(metric_shift(t.metrics)).join(starts, "case_id")
    found = [
        signal(both, 1, "trace", "availability_drop", drop, 0.10, start, F.concat(service, F.lit(" trace volume dropped "), fixed(drop * 100, 1), F.lit("% versus the normal window."))),
        signal(both, 2, "trace", "error_rate", errors, 0.10, onset("first_error"), change("trace error rate", "n_error_rate", "a_error_rate")),
        signal(both, 3, "trace", "latency", slower, 0.10, onset("first_slow"), F.concat(service, F.lit(" p95 span duration increased "), fixed(F.coalesce(ratio, F.lit(0.0)), 2), F.lit("x versus normal."))),
        signal(logs, 4, "log", "error_log_rate", log_score, 0.10, onset("first_log"), change("error-log rate", "n_log_rate", "a_log_rate")),
        signal(best, 5, "metric", F.col("metric"), F.col("score"), 0.15, onset("onset"), F.concat(service, F.lit(" metric "), "metric", F.lit(" shifted materially from its normal-window distribution."))),
    ]
    rows = reduce(DataFrame.unionByName, found).withColumn("phase", F.lit(0))
    calm = normal.select(*key).join(rows.select(*key).distinct(), key, "left_anti").join(starts, "case_id")
    stable = signal(calm, 6, "trace", "stable_presence", F.lit(0.05), 0.0, start, F.concat(service, F.lit(" remained observable without a strong detected anomaly.")))
    rows = rows.unionByName(stable.withColumn("phase", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("phase", "service_name", "kind_order"))
    rows = rows.withColumn("pos", place.cast("long"))
    return rows.select("case_id", "pos", F.concat(F.lit("e"), "pos").alias("evidence_id"), service.alias("node"), "kind", "signal", "abnormality", "ts_s", "text")


def node_anomaly(ev: DataFrame) -> DataFrame:
    """Per node the largest abnormality and the first time it was anomalous."""
    return ev.groupBy("case_id", "node").agg(F.max("abnormality").alias("anomaly"), F.min(F.when(F.col("abnormality") >= 0.5, F.col("ts_s"))).alias("first_s"))


def symptoms(known: DataFrame, ev: DataFrame, most: int = 2) -> DataFrame:
    """Sinks of the graph by anomaly, at least 0.5, the first two; else the most anomalous node."""
    nodes = node_anomaly(ev)
    sinks = known.select("case_id", F.col("target").alias("node")).distinct().join(known.select("case_id", F.col("source").alias("node")).distinct(), ["case_id", "node"], "left_anti")
    ranked = Window.partitionBy("case_id").orderBy(F.desc("anomaly"), "node")
    first = sinks.join(nodes.filter("anomaly >= 0.5"), ["case_id", "node"]).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= most)
    other = nodes.join(first.select("case_id").distinct(), "case_id", "left_anti").withColumn("rank", F.row_number().over(ranked)).filter("rank = 1")
    return first.select("case_id", "node", "rank").unionByName(other.select("case_id", "node", "rank"))


def gold_of_graph(edges: DataFrame, components: DataFrame, roots: DataFrame, alarms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roots, edges, alarms) of a causal graph of components, as services.

    ``components`` maps component to service per case; an unmapped name keeps
    what is behind its ``service|``, or behind its ``span|`` up to ``::``.  Names that
    are neither, or map to nothing, and edges within a service are left out.
    """

    def named(df: DataFrame, c: str) -> DataFrame:
        m = components.select("case_id", F.col("component").alias(c), F.col("service").alias("_s"))
        rest = F.expr(f"substr({c}, instr({c}, '|') + 1)")
        own = F.when(F.col(c).startswith("service|"), rest).when(F.col(c).startswith("span|"), F.substring_index(rest, "::", 1))
        return df.join(m, ["case_id", c], "left").withColumn(c, F.coalesce("_s", own)).drop("_s").filter(F.col(c) != "")

    pairs = named(named(edges.select("case_id", "source", "target"), "source"), "target").filter("source <> target").distinct()
    return named(roots.select("case_id", "node"), "node").distinct(), pairs, named(alarms.select("case_id", "node"), "node").distinct()
