"""Telemetry frames: Parquet scans with case and window, manifests, labels; and the sample tables as telemetry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expressions import seconds


@dataclass(frozen=True)
class Telemetry:
    """Three frames with ``case_id`` and ``win`` (normal or abnormal), and when each case turns abnormal."""

    traces: DataFrame
    metrics: DataFrame
    logs: DataFrame
    starts: DataFrame

    def window(self, name: str) -> Telemetry:
        return Telemetry(*(x.filter(F.col("win") == name) for x in (self.traces, self.metrics, self.logs)), self.starts)


def with_seconds(df: DataFrame, time: str = "time") -> DataFrame:
    """Adds ``ts_s``, epoch seconds of the time column; null where there is none."""
    return df.withColumn("ts_s", seconds(df, time) if time in df.columns else F.lit(None).cast("double"))


def read_cases(spark: SparkSession, base: str) -> Telemetry:
    """All case folders below ``base`` at once: ``<case>/{normal,abnormal}_{traces,metrics,logs}.parquet`` and ``<case>/env.json``.

    Times in nanoseconds, which Spark has no type for, are read as numbers.
    """
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")

    def frames(kind: str) -> DataFrame:
        def one(win: str) -> DataFrame:
            df = spark.read.option("mergeSchema", "true").parquet(f"{base}/*/{win}_{kind}.parquet")
            case = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+_" + kind, 1)
            return with_seconds(df.select("*", case.alias("case_id"), F.lit(win).alias("win")))

        return one("normal").unionByName(one("abnormal"), allowMissingColumns=True)

    env = spark.read.schema("ABNORMAL_START double").option("multiLine", True).json(f"{base}/*/env.json")
    starts = env.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/env", 1).alias("case_id"), F.col("ABNORMAL_START").alias("start_s"))
    return Telemetry(frames("traces"), frames("metrics"), frames("logs"), starts)


def causal_graphs(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, components, roots, alarms) of causal graph documents (case_id, value), as ``evidence.gold_of_graph`` takes them.

    Roots and alarms are names or objects with a ``component``.  Alarms are the
    terminal ones of paths or, where that list is missing or empty, all.  A
    document that is no JSON object has no part in any table.
    """
    d = documents.select("case_id", F.try_parse_json("value").alias("g"))
    items = lambda key: F.coalesce(F.try_variant_get("g", f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
    # An object without a component names nothing.
    name = lambda x: F.when(F.to_json(x).startswith("{"), F.try_variant_get(x, "$.component", "string")).otherwise(F.try_variant_get(x, "$", "string"))
    nodes = lambda listed: d.select("case_id", F.explode(listed).alias("x")).select("case_id", name(F.col("x")).alias("node")).filter("node IS NOT NULL")
    terminal = items("path_terminal_alarm_nodes")
    end = lambda c: F.try_variant_get("x", f"$.{c}", "string").alias(c)
    edges = d.select("case_id", F.explode(items("edges")).alias("x")).select("case_id", end("source"), end("target")).dropna()
    components = d.select("case_id", F.explode(F.try_variant_get("g", "$.component_to_service", "map<string,string>")).alias("component", "service"))
    return edges, components, nodes(items("root_causes")), nodes(F.when(F.size(terminal) > 0, terminal).otherwise(items("alarm_nodes")))


def read_causal_graphs(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``causal_graphs`` of the ``causal_graph.json`` of all case folders below ``base``."""
    text = spark.read.text(f"{base}/*/causal_graph.json", wholetext=True)
    return causal_graphs(text.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/causal_graph", 1).alias("case_id"), "value"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's rows; blank lines are skipped."""
    schema = "name string, system string, primary_kind string, subtypes array<string>, hybrid boolean, root_services array<string>"
    return spark.read.schema(schema).json(path).filter("name IS NOT NULL")


def read_labels(spark: SparkSession, base: str) -> DataFrame:
    """case_id and whether its label.txt says attributed."""
    text = spark.read.text(f"{base}/*/label.txt", wholetext=True)
    case = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/label", 1)
    return text.select(case.alias("case_id"), (F.lower(F.trim(F.regexp_replace("value", "\\s+", " "))) == "attributed").alias("attributed"))


def manifest_slice(manifest: DataFrame, start: int, end: int, order: str = "name") -> DataFrame:
    """Rows start to end (exclusive) in order, clamped to what there is."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(order)) - 1
    return manifest.withColumn("_at", place).filter((F.col("_at") >= max(0, start)) & (F.col("_at") < end)).drop("_at")


#: The sample tables as telemetry: cases, services, when line items and events turn abnormal.
CASES, SERVICES, EVENT_SERVICES = 20, 61, 6
LINE_CUT, EVENT_CUT = "1998-05-24", "2024-01-21"
#: Abnormal start in days, the sample's unit of time.
START = 10370.0


#: Rows of a table beside the spans that Spark may broadcast; of 120 bytes each they take the driver two to three times 24 MB.
BROADCAST_ROWS = 200_000


def one_a_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` grouped by its key if that is unique, so that an outer join with it is left out where its columns are not read; else as it is.

    A null key, which joins nothing, is left out.  Above ``BROADCAST_ROWS`` rows it is joined by a shuffle, however small its files.
    """
    df = df.filter(F.col(key).isNotNull())
    n, most = df.groupBy(key).count().agg(F.sum("count"), F.max("count")).first()
    if most in (None, 1):
        df = df.groupBy(key).agg(*[F.first(c).alias(c) for c in df.columns if c != key])
    return df.hint("shuffle_hash") if n is not None and n > BROADCAST_ROWS else df


def sample_telemetry(spark: SparkSession, sf_dir: str) -> Telemetry:
    """lineitem, supplier and part as spans; events as metrics and logs; each row has a part in it."""
    line, supplier, part, events = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier", "part", "events"))
    t = line.join(one_a_key(supplier.select("s_suppkey", "s_nationkey"), "s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    t = t.join(one_a_key(part.select("p_partkey", "p_type", "p_brand"), "p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
    traces = t.select(
        F.concat(F.lit("case-"), F.col("l_orderkey") % CASES).alias("case_id"),
        F.when(F.col("l_shipdate") < F.lit(LINE_CUT).cast("timestamp_ntz"), "normal").otherwise("abnormal").alias("win"),
        F.col("l_orderkey").cast("string").alias("trace_id"),
        F.col("l_linenumber").cast("string").alias("span_id"),
        F.when(F.col("l_linenumber") > 1, (F.col("l_linenumber") - 1).cast("string")).otherwise("").alias("parent_span_id"),
        F.concat(F.lit("svc-"), F.col("l_suppkey") % SERVICES).alias("service_name"),
        F.concat(F.lit("pod-"), F.col("l_suppkey")).alias("attr.k8s.pod.name"),
        F.concat(F.lit("node-"), F.col("s_nationkey")).alias("attr.k8s.node.name"),
        F.when(F.col("l_linestatus") == "F", F.lower("p_type")).alias("attr.db.system"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), "queue").alias("attr.messaging.system"),
        F.col("p_brand").alias("attr.server.address"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double").alias("ts_s"),
        F.col("l_extendedprice").alias("duration"),
        F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("OK").alias("attr.status_code"),
        F.when(F.col("l_tax") >= 0.08, 503.0).otherwise(200.0).alias("attr.http.response.status_code"),
    )
    e = events.select(
        F.concat(F.lit("case-"), F.col("event_id") % CASES).alias("case_id"),
        F.when(F.col("ts") < F.lit(EVENT_CUT).cast("timestamp_ntz"), "normal").otherwise("abnormal").alias("win"),
        F.concat(F.lit("svc-"), F.col("user_id") % EVENT_SERVICES).alias("service_name"),
        F.col("event_type").alias("metric"),
        "value",
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        (F.lit(START) + (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(EVENT_CUT).cast("timestamp"))) / 864e8).alias("ts_s"),
    )
    starts = spark.range(CASES).select(F.concat(F.lit("case-"), F.col("id")).alias("case_id"), F.lit(START).alias("start_s"))
    return Telemetry(traces, e.drop("level"), e.select("case_id", "win", "service_name", "level", "ts_s"), starts)
