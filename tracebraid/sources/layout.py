"""Spans laid out by case and trace, so that parents and children meet without a shuffle.

``write_spans`` pays one exchange, once; every later count of calls over the table
(``observations.count_calls``) reads buckets side by side.  A trace of very many
spans is one bucket's, as it would be one task's in a shuffle; its rows are
counted by key before they meet.

Cases: spans without a trace or a service are not kept, nothing is counted from
them; frames without the columns are an error; an empty frame gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.observations import spans

#: Buckets of a table: about as many as tasks that should read it together.
BUCKETS = 200
BY = ("case_id", "trace_id")


def write_spans(traces: DataFrame, table: str, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The cleaned spans as the bucketed table of that name, replaced if it exists; in the warehouse, or at ``path``."""
    s = spans(traces)
    if s is None:
        raise ValueError("spans need trace_id, span_id, parent_span_id and service_name")
    # A task writes whole buckets, so that a bucket is one file.
    writer = s.repartition(buckets, *BY).write.format("parquet").mode("overwrite").bucketBy(buckets, *BY).sortBy(*BY)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return traces.sparkSession.table(table)


def drop_spans(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
