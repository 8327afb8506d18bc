"""Exact quantiles of keys of any size, without a buffer of a key's rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import cut

#: Accuracy of the sketch that brackets a quantile: of a key of n > ACCURACY rows no more than about 8 n / ACCURACY lie in a bracket, of a smaller one all.
ACCURACY = 1_000
#: Keys whose brackets may be broadcast: rows of a few numbers.
BROADCAST_KEYS = 200_000


def brackets(value: Column, shares: tuple[float, ...], accuracy: int = ACCURACY) -> list[Column]:
    """Aggregates that ``pick`` needs: ``_n``, and ``_low`` and ``_high``, bounds by a mergeable sketch around each share."""
    off = 3 / accuracy
    few = F.count(value) <= accuracy
    # One sketch for both ends of all brackets.
    sketch = F.percentile_approx(value, [min(1.0, max(0.0, s + to)) for to in (-off, off) for s in shares], accuracy)
    around = lambda first, end: F.when(few, F.array(*[end] * len(shares))).otherwise(F.slice(sketch, first, len(shares)))
    return [F.count(value).alias("_n"), around(1, F.min(value)).alias("_low"), around(1 + len(shares), F.max(value)).alias("_high")]


#: Rows of a key that a cell may hold where a sketch would keep to fewer; cells of a doubling of the value.
CELL_ROWS, CELLS = 200_000, 16


def cell(value: Column) -> Column:
    """A number that never falls as the value grows: 16 for every doubling."""
    return F.signum(value) * F.rint(CELLS * F.log2(1 + F.abs(value)))


def in_cells(rows: DataFrame, key: list[str], value: str, *parts: Column) -> DataFrame:
    """Rows of each key by the cell of their value: ``_c``, ``_low`` and ``_high`` of the numbers and ``parts``, in a plain aggregation; read several times."""
    v = F.col(value)
    return cut(rows.groupBy(*key, cell(v).alias("_cell")).agg(F.count(v).alias("_c"), F.min(v).alias("_low"), F.max(v).alias("_high"), *parts))


def brackets_of_cells(cells: DataFrame, rows: DataFrame, key: list[str], value: str, shares: tuple[float, ...], accuracy: int = ACCURACY, *others: Column) -> DataFrame:
    """``brackets`` and ``others`` (aggregates over ``cells``) from cells: a share lies in one cell or between two.

    A key with a cell of very many rows takes a sketch for its brackets instead.
    """
    w = Window.partitionBy(*key)
    upto = F.sum("_c").over(w.orderBy("_cell"))
    c = cells.filter("_c > 0").withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(w))
    # Cells that hold one of the ranks that a share lies between.
    places = [F.lit(s) * (F.col("_n") - 1) for s in shares]
    on = [(F.col("_upto") > F.floor(x)) & (F.col("_upto") - F.col("_c") <= F.ceil(x)) for x in places]
    ends = [f(F.when(o, F.col(end))).alias(f"{end}{i}") for f, end in ((F.min, "_low"), (F.max, "_high")) for i, o in enumerate(on)]
    held = F.greatest(*[F.sum(F.when(o & (F.col("_low") < F.col("_high")), F.col("_c")).otherwise(0)) for o in on]) if len(shares) > 1 else F.sum(F.when(on[0] & (F.col("_low") < F.col("_high")), F.col("_c")).otherwise(0))
    found = c.groupBy(*key).agg(F.first("_n").alias("_n"), *ends, held.alias("_held"))
    listed = [F.array(*[F.col(f"{end}{i}") for i in range(len(shares))]).alias(end) for end in ("_low", "_high")]
    found = cut(found.select(*key, "_n", *listed, "_held"))
    many = found.filter(F.col("_held") > F.greatest(F.lit(CELL_ROWS), 8 * F.col("_n") / accuracy)).select(*key)
    if not many.isEmpty():
        sketch = rows.join(F.broadcast(many), key).groupBy(*key).agg(*brackets(F.col(value), shares, accuracy))
        found = cut(found.join(many, key, "left_anti").drop("_held").unionByName(sketch))
    out = cells.groupBy(*key).agg(*others).join(found.drop("_held"), key, "left")
    return cut(out.withColumn("_n", F.coalesce("_n", F.lit(0))))


def pick(rows: DataFrame, bounds: DataFrame, key: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """``bounds`` (key, _n, _low, _high and others) with ``q``, the exact quantiles, linear between neighbours; null without a number.

    A second pass counts rows by the cell between bounds that they lie in, and by
    their value inside a bracket, before anything is shuffled.  The ranks that are
    looked for lie in brackets; running counts go over a bracket's values alone.
    """
    ends = [(F.col(f"_low{i}"), F.col(f"_high{i}")) for i in range(len(shares))]
    b = bounds.filter("_n > 0").select(*key, "_n", *[F.get(c, F.lit(i)).alias(f"{c}{i}") for c in ("_low", "_high") for i in range(len(shares))])
    if b.count() <= BROADCAST_KEYS:
        b = F.broadcast(b)
    v = F.col(value)
    j = rows.filter(v.isNotNull()).select(*key, v.alias("_v")).join(b, key)
    # Plain comparisons, for every row meets them: functions over arrays are not compiled.
    held = reduce(Column.__or__, [F.col("_v").between(low, high) for low, high in ends])
    cell = reduce(Column.__add__, [x.cast("int") for low, high in ends for x in (low <= F.col("_v"), high < F.col("_v"))])
    counts = j.groupBy(*key, cell.alias("_cell"), F.when(held, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*key).orderBy("_cell", "_v"))
    counts = counts.withColumn("_upto", upto)
    places = [s * (F.col("_n") - 1) for s in shares]
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.struct("_cell", "_v")))["_v"]
    found = counts.groupBy(*key).agg(*[at(f(x)).alias(f"{n}{i}") for i, x in enumerate(places) for n, f in (("_a", F.floor), ("_b", F.ceil))])
    part = [s * (F.col("_n") - 1) - F.floor(s * (F.col("_n") - 1)) for s in shares]
    line = lambda i: F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * part[i]
    sure = lambda i: F.when(F.col("_n") == 0, None).otherwise(F.coalesce(line(i), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")))
    out = bounds.join(found, key, "left").withColumn("q", F.array(*[sure(i) for i in range(len(shares))]))
    return out.drop("_low", "_high", *[f"{n}{i}" for n in ("_a", "_b") for i in range(len(shares))])


def quantiles(rows: DataFrame, key: list[str], value: str, shares: tuple[float, ...], accuracy: int = ACCURACY, *others: Column) -> DataFrame:
    """Per key ``_n`` (numbers), ``q`` (exact quantiles of the shares) and ``others``, aggregates taken in the first of two passes."""
    # Written, for the second pass reads them three times.
    bounds = cut(rows.groupBy(*key).agg(*brackets(F.col(value), shares, accuracy), *others))
    return pick(rows, bounds, key, value, shares)
