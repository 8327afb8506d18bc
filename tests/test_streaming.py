from pyspark.sql import functions as F

from tracebraid.operators import observations
from tracebraid.streaming import collectors


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_calls_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    rows = [("c", "t", "1", "", "a", 10), ("c", "t", "2", "1", "b", 11), ("c", "t", "3", "2", "c", 12), ("c", "t", "4", "1", "a", 12), ("d", "t", "2", "1", "x", 12)]
    schema = "case_id string, trace_id string, span_id string, parent_span_id string, service_name string, s long"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r["case_id"], r["source"], r["target"]) for r in run(spark, collectors.span_calls(stream), "calls").collect()}
    want = {(r["case_id"], r["source"], r["target"]) for r in observations.span_calls(df).collect()}
    assert got == want and len(want) == 2


def test_error_rates_close_behind_the_watermark(spark, tmp_path):
    rows = [("c", "a", "error", 0), ("c", "a", "info", 60), ("c", "a", "info", 400), ("c", "a", "info", 5000)]
    df = spark.createDataFrame(rows, "case_id string, service_name string, level string, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = [(r["n"], r["log_rate"]) for r in run(spark, collectors.error_rates(stream), "rates").orderBy("begin").collect()]
    assert got == [(2, 0.5), (1, 0.0)]
