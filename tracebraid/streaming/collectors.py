"""Extension: the collectors and the error evidence over streams.

The batch operators define no streaming semantics; these are this library's own.
Time is the event time ``ts``; rows later than the watermark are dropped by
Spark, and state is bounded by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import clean, entity, observation_id
from ..functions.predicates import log_error


def span_calls(spans: DataFrame, delay: str = "10 minutes", reach: str = "10 minutes") -> DataFrame:
    """Calls between services as parent and child spans arrive, in either order, within ``reach`` of each other.

    An inner join of the stream with itself; both sides carry the watermark, so
    that old spans leave the state.
    """
    s = spans.select("case_id", *[clean(c).alias(c) for c in ("trace_id", "span_id", "parent_span_id", "service_name")], "ts")
    child = s.filter("parent_span_id IS NOT NULL").select("case_id", "trace_id", "parent_span_id", F.col("service_name").alias("callee"), F.col("ts").alias("child_ts")).withWatermark("child_ts", delay)
    parent = s.filter("span_id IS NOT NULL").select(F.col("case_id").alias("p_case"), F.col("trace_id").alias("p_trace"), F.col("span_id").alias("p_span"), F.col("service_name").alias("caller"), F.col("ts").alias("parent_ts")).withWatermark("parent_ts", delay)
    near = (F.col("child_ts") >= F.col("parent_ts") - F.expr(f"INTERVAL {reach}")) & (F.col("child_ts") <= F.col("parent_ts") + F.expr(f"INTERVAL {reach}"))
    same = (F.col("case_id") == F.col("p_case")) & (F.col("trace_id") == F.col("p_trace")) & (F.col("parent_span_id") == F.col("p_span"))
    j = child.join(parent, same & near).filter("caller <> callee")
    source, target = entity("service", "caller"), entity("service", "callee")
    return j.select("case_id", observation_id(F.lit("trace_parent_child"), source, target).alias("observation_id"), source.alias("source"), target.alias("target"), F.lit("trace_parent_child").alias("evidence_kind"), F.lit(0.98).alias("confidence"), "child_ts")


def error_rates(logs: DataFrame, size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Error rate of every service's logs in tumbling windows of event time."""
    l = logs.filter("service_name IS NOT NULL").withWatermark("ts", delay)
    rate = l.groupBy("case_id", "service_name", F.window("ts", size)).agg(F.count("*").alias("n"), F.avg(log_error().cast("double")).alias("log_rate"))
    return rate.select("case_id", "service_name", F.col("window.start").alias("begin"), "n", "log_rate")
