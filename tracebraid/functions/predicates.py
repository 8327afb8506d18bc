"""Row predicates of telemetry and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import STRUCTURAL
from .expressions import col, is_loadgen, to_number


def trace_error(df: DataFrame) -> Column:
    """An error or failure status, or an HTTP status of 500 and up; columns that are missing say no."""
    out = F.lit(False)
    if "attr.status_code" in df.columns:
        status = F.lower(col("attr.status_code"))
        # Of every span, so no regular expression.
        out = out | F.coalesce(F.contains(status, F.lit("error")) | F.contains(status, F.lit("fail")), F.lit(False))
    if "attr.http.response.status_code" in df.columns:
        out = out | F.coalesce(to_number("attr.http.response.status_code") >= 500, F.lit(False))
    return out


def log_error(level="level") -> Column:
    return F.coalesce(F.upper(col(level)).isin("ERROR", "FATAL", "CRITICAL"), F.lit(False))


def is_time_metric(name="metric") -> Column:
    return F.lower(col(name)).rlike("(\\.time|_time)$")


def structural(relation="relation") -> Column:
    return col(relation).isin(*STRUCTURAL)


def without_loadgen(source="source", target="target") -> Column:
    return ~is_loadgen(source) & ~is_loadgen(target)
