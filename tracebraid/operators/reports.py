"""Summaries over result tables and their sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expressions import ratio_label
from ..functions.predicates import structural


def per_system(rows: DataFrame, values: list[str]) -> DataFrame:
    """Means by system (``unknown`` without one) and over all."""
    s = rows.withColumn("system", F.coalesce("system", F.lit("unknown")))
    return s.rollup("system").agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values]).withColumn("system", F.coalesce("system", F.lit("overall")))


def coverage_audit(cases: DataFrame, observations: DataFrame, relations: DataFrame) -> DataFrame:
    """Per relation: count, cases with it, share of all cases, up to five examples."""
    n = cases.select("case_id").distinct().count()
    r = relations.filter(structural())
    return r.groupBy("relation").agg(
        F.count("*").alias("n"),
        F.countDistinct("case_id").alias("n_cases"),
        (F.countDistinct("case_id") / F.lit(max(1, n))).alias("case_coverage"),
    ).join(examples(r), "relation")


def examples(relations: DataFrame, most: int = 5) -> DataFrame:
    """The first five distinct pairs of each relation by name."""
    from pyspark.sql import Window

    d = relations.select("relation", F.concat_ws(" -> ", "source", "target").alias("pair")).distinct()
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("relation").orderBy("pair"))).filter(F.col("rank") <= most)
    return d.groupBy("relation").agg(F.array_join(F.array_sort(F.collect_list("pair")), "; ").alias("examples"))


def observation_audit(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: cases, cases with observations, observations, mean per case."""
    o = observations.groupBy("case_id").agg(F.count("*").alias("n"))
    j = cases.select("case_id").distinct().join(o, "case_id", "left").na.fill(0, ["n"])
    return j.agg(F.count("*").alias("n_cases"), F.count_if(F.col("n") > 0).alias("n_observed_cases"), F.sum("n").alias("n_observations"), F.avg("n").alias("mean_observations"))


def score_diagnostics(h: DataFrame) -> DataFrame:
    """Means and positive rates of flattened hypotheses."""
    margin = F.col("semantic_support") - F.coalesce("semantic_contradiction", F.lit(0.0))
    return h.agg(
        F.count("*").alias("n"),
        F.avg("abductive_score").alias("mean_abductive"),
        F.avg(F.abs(margin)).alias("mean_abs_margin"),
        F.avg("final_score").alias("mean_final"),
        F.avg(F.abs(F.col("final_score") - F.col("abductive_score"))).alias("mean_abs_shift"),
        F.avg((F.col("abductive_score") >= 0.5).cast("double")).alias("abductive_positive_rate"),
        F.avg((F.col("final_score") >= 0.5).cast("double")).alias("final_positive_rate"),
    )


def compare(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Two variants' scores of the same pairs (case_id, source, target, score and, if known, base): one row.

    Rates and means are null without common pairs, the correlation also below two
    pairs and without variance.  Shifts are the mean distances of the scores from ``base``.
    """
    key = ["case_id", "source", "target"]

    def one(df: DataFrame, name: str) -> DataFrame:
        base = F.col("base") if "base" in df.columns else F.lit(None).cast("double")
        best = df.select(*key, "score", base.alias("base")).groupBy(*key).agg(F.max(F.struct("score", "base")).alias("s"))
        return best.select(*key, F.col("s.score").alias(name), F.col("s.base").alias(f"{name}_base"))

    j = one(left, "a").join(one(right, "b"), key, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    up_a, up_b = F.col("a") >= threshold, F.col("b") >= threshold
    x, y = F.when(both, F.col("a")), F.when(both, F.col("b"))
    n = F.count_if(both)
    cov = F.avg(x * y) - F.avg(x) * F.avg(y)
    var = (F.avg(x * x) - F.avg(x) * F.avg(x)) * (F.avg(y * y) - F.avg(y) * F.avg(y))
    differ = F.count_if(both & (up_a != up_b))
    return j.agg(
        n.alias("n_common"),
        F.count_if(F.col("b").isNull()).alias("n_only_left"),
        F.count_if(F.col("a").isNull()).alias("n_only_right"),
        differ.alias("n_disagree"),
        F.count_if(both & up_a & ~up_b).alias("n_left_only_up"),
        F.count_if(both & ~up_a & up_b).alias("n_right_only_up"),
        F.try_divide(differ, n).alias("disagreement_rate"),
        F.avg(F.abs(x - y)).alias("mean_abs_error"),
        F.when((n >= 2) & (var > 1e-24), cov / F.sqrt(var)).alias("pearson"),
        F.avg((F.abs(x - y) <= 1e-12).cast("double")).alias("equal_rate"),
        F.avg(F.abs(x - F.col("a_base"))).alias("mean_abs_left_shift"),
        F.avg(F.abs(y - F.col("b_base"))).alias("mean_abs_right_shift"),
    )


def merge_shards(spark: SparkSession, pattern: str, expected: int | None = None) -> DataFrame:
    """Result shards by glob, each case once; rows come in order of the case."""
    df = spark.read.json(pattern)
    twice = df.groupBy("case_id").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate cases: {[r['case_id'] for r in twice]}")
    n = df.count()
    if expected is not None and n != expected:
        raise ValueError(f"{n} cases, {expected} expected")
    return df.orderBy("case_id")


def load_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Result documents by glob with their path; unreadable ones and those without summary and mask_ratio are left out."""
    df = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern).withColumn("_path", F.col("_metadata.file_path"))
    if not {"summary", "mask_ratio"} <= set(df.columns) or df.filter("summary IS NOT NULL AND mask_ratio IS NOT NULL").isEmpty():
        raise ValueError(f"no results match {pattern}")
    return df.filter("summary IS NOT NULL AND mask_ratio IS NOT NULL").withColumn("ratio", ratio_label("mask_ratio"))


def result_kind(df: DataFrame) -> DataFrame:
    """Adds ``kind``: final_llm, ablation, direct_llm or other, by the result's track and variant."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    kind = (
        F.when(text("variant") == "llm_adjudication", "final_llm")
        .when(text("track") == "ablation", "ablation")
        .when(text("model") != "", "direct_llm")
        .otherwise("other")
    )
    return df.withColumn("kind", kind)


def summary_rows(df: DataFrame, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per result: each wanted value from the first of its columns in ``summary`` that is there and not null."""
    have = df.select("summary.*").columns
    pick = lambda names: F.coalesce(*[F.col(f"summary.`{n}`") for n in names if n in have], F.lit(None))
    return result_kind(df).select("kind", "mask_ratio", *[pick(names).alias(c) for c, names in columns.items()])


def means(rows: DataFrame, values: list[str]) -> DataFrame:
    """One row of means over cases, 0 where there are none."""
    return rows.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(v), F.lit(0.0)).alias(v) for v in values])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as JSON; an error if there are more rows, or none."""
    n = len(df.limit(2).collect())
    if n != 1:
        raise ValueError(f"a summary has one row, not {'none' if n == 0 else 'several'}")
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown(summary: DataFrame, title: str, percent: tuple[str, ...] = (), most: int = 1000) -> str:
    """A small summary table as Markdown: two decimals, ``-`` for null, the given columns in percent.

    It is made on the driver; an error if it has more than ``most`` rows.
    """
    rows = summary.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    names = summary.columns

    def shown(name: str, v) -> str:
        if v is None:
            return "-"
        if name in percent:
            return f"{100 * v:.2f}"
        return f"{v:.4f}" if isinstance(v, float) else json.dumps(v) if isinstance(v, (list, dict)) else str(v)

    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(shown(n, r[n]) for n in names) + " |" for r in rows)]) + "\n"
