"""Deterministic masks: nested ones by hash rank, random ones by a seeded sample."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.expressions import half_even, mask_rank, normalize_service
from ..functions.predicates import structural
from ..schemas import CAUSAL, MASKED, MASKED_STRUCTURAL, NON_CAUSAL
from .graph import cut

EDGE = ["source", "relation", "target"]


def _checked(ratio: float) -> float:
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be in [0, 1]")
    return float(ratio)


#: Hex digits of the hash that name a bucket: a group has 16 ** BUCKET_DIGITS of them, of which one is looked into.
BUCKET_DIGITS = 3


def _hashed(relations: DataFrame, group: str, seed: int) -> DataFrame:
    """Distinct typed relations of each group with their hash and its bucket."""
    r = relations.filter(structural()).select(group, *EDGE).distinct()
    return r.withColumn("_h", mask_rank(seed, group)).withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS))


def _histogram(hashed: DataFrame, group: str) -> DataFrame:
    """Rows by group and bucket, ``_n`` of the group and ``_before``, those in earlier buckets.

    A window goes over a group's buckets, whose number is fixed, not over its relations.
    """
    counts = hashed.groupBy(group, "_bucket").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("_before", before).withColumn("_n", F.sum("_c").over(w))


def _wanted(ratio: float) -> Column:
    return half_even(F.col("_n") * F.lit(float(ratio)))


def hash_mask(relations: DataFrame, group: str, ratio: float, seed: int = 42) -> DataFrame:
    """Distinct typed relations of each group with their ``rank`` and ``missing``.

    Relations are ranked by a hash of seed, group and triple; the first
    ``rint(n * ratio)`` are missing, so that larger ratios contain smaller ones.
    A rank is the number of relations in earlier buckets and the place within the bucket.
    """
    _checked(ratio)
    hashed = _hashed(relations, group, seed)
    j = hashed.join(_histogram(hashed, group), [group, "_bucket"])
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_h", *EDGE))
    return j.select(group, *EDGE, rank.cast("long").alias("rank"), (rank <= _wanted(ratio)).alias("missing"))


def thresholds(relations: DataFrame, group: str, ratio: float, seed: int = 42) -> DataFrame:
    """(group, last): the last missing (hash, source, relation, target) of each group; none where nothing is missing.

    Only the bucket that holds it is looked into.
    """
    hashed = _hashed(relations, group, seed)
    at = _histogram(hashed, group).withColumn("_k", _wanted(ratio)).filter("_before < _k AND _k <= _before + _c")
    inside = hashed.join(at, [group, "_bucket"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_h", *EDGE))
    return inside.withColumn("_place", place).filter(F.col("_place") == F.col("_k")).select(group, F.struct("_h", *EDGE).alias("last"))


def with_missing(relations: DataFrame, group: str, ratio: float, seed: int = 42) -> DataFrame:
    """All relations with ``missing``: typed ones up to their group's threshold, by a comparison for each row."""
    _checked(ratio)
    j = relations.join(thresholds(relations, group, ratio, seed), group, "left")
    upto = F.struct(mask_rank(seed, group).alias("_h"), *EDGE) <= F.col("last")
    return j.withColumn("missing", structural() & F.coalesce(upto, F.lit(False))).drop("last")


def group_mask(relations: DataFrame, ratio: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(visible, missing) typed relations of every case; cases of one ``group_id`` share their mask."""
    # Written, for what is visible and what is missing are each read several times, and every reading would hash all relations.
    rows = cut(with_missing(relations, "group_id", ratio, seed).filter(structural()))
    return rows.filter(~F.col("missing")).select(*relations.columns), rows.filter("missing").select(*relations.columns)


def case_mask(relations: DataFrame, ratio: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    visible, missing = group_mask(relations.withColumn("group_id", F.col("case_id")), ratio, seed)
    return visible.drop("group_id"), missing.drop("group_id")


def type_mask(relations: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Masked relations stay visible under another name; ``truth`` keeps theirs."""
    j = with_missing(relations, "case_id", ratio, seed).withColumn("truth", F.col("relation"))
    return j.withColumn("relation", F.when(F.col("missing"), MASKED_STRUCTURAL).otherwise(F.col("relation")))


def case_seed(case_id: str, seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{case_id}".encode()).digest()[:8], "big")


@F.udf(T.ArrayType(T.IntegerType()))
def _sampled(case_id: str, seed: int, n: int, k: int):
    """Positions of a seeded sample; only per-case counts go in, not the edges."""
    return sorted(random.Random(case_seed(case_id, seed)).sample(range(n), k)) if k else []


def _sample_positions(edges: DataFrame, ratio: float, seed: int, picks: DataFrame | None = None) -> DataFrame:
    """Adds ``picked``: by a seeded sample, or where ``picks`` (case_id and place, from 0 in order of ``pos``) says so."""
    if picks is None:
        n = edges.groupBy("case_id").agg(F.count("*").cast("int").alias("n"))
        picks = n.select("case_id", F.explode(_sampled("case_id", F.lit(seed), "n", half_even(F.col("n") * F.lit(_checked(ratio))).cast("int"))).alias("place"))
    place = (F.row_number().over(Window.partitionBy("case_id").orderBy("pos")) - 1).alias("place")
    picks = picks.select("case_id", "place").distinct().withColumn("picked", F.lit(True))
    return edges.select("*", place).join(picks, ["case_id", "place"], "left").withColumn("picked", F.coalesce("picked", F.lit(False))).drop("place")


def labelled(known: DataFrame, gold: DataFrame) -> DataFrame:
    """Known edges with the causal label where the normalised pair is gold."""
    pair = [normalize_service("source").alias("s"), normalize_service("target").alias("t")]
    g = gold.select("case_id", *pair).distinct().withColumn("is_gold", F.lit(True))
    k = known.withColumn("s", pair[0]).withColumn("t", pair[1]).join(g, ["case_id", "s", "t"], "left").drop("s", "t")
    return k.withColumn("relation", F.when(F.col("is_gold"), CAUSAL).otherwise(NON_CAUSAL)).drop("is_gold")


def causal_mask(known: DataFrame, gold: DataFrame, ratio: float, seed: int = 42, picks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges with hidden labels, truth of the hidden ones); ``known`` has ``pos``, ``picks`` replaces the sample."""
    all_edges = _sample_positions(labelled(known, gold), ratio, seed, picks)
    visible = all_edges.withColumn("relation", F.when(F.col("picked"), MASKED).otherwise(F.col("relation"))).drop("picked")
    return visible, all_edges.filter("picked").drop("picked")


def removal_mask(known: DataFrame, ratio: float, seed: int = 42, picks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges that stay, edges removed)."""
    all_edges = _sample_positions(known, ratio, seed, picks)
    return all_edges.filter("NOT picked").drop("picked"), all_edges.filter("picked").drop("picked")
