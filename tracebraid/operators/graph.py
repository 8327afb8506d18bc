"""Reachability over edge tables, for all cases at once: a few frontier rounds, then path doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..sources.shared import spent, written

#: Rounds that follow single edges; most graphs of services are done by then.  Later ones double the length of paths.
FRONTIER_ROUNDS = 2
#: Doublings: paths of up to 2 ** MOST_DOUBLINGS edges.
MOST_DOUBLINGS = 40
#: Gains that count.
LEAST_GAIN = 1e-12


def cut(df: DataFrame) -> DataFrame:
    """Write and re-read: ends the lineage of a loop in the folder all executors share."""
    return written(df, "cut")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(case_id, root, node): nodes that each start reaches, itself included.

    A round writes the nodes that are new, never those known before.  After the
    frontier rounds, nodes found since meet pairs that are 1, 2, 4 ... edges
    apart, so a path of n edges takes about log2(n) rounds.  A round without a new
    node, or without any path of its length, is the last.
    """
    key = ["case_id", "root", "node"]
    hops = edges.select("case_id", F.col("source").alias("node"), F.col("target").alias("following")).distinct()
    seen = [cut(starts.select("case_id", F.col("node").alias("root"), "node").distinct())]

    def step(front: DataFrame, by: DataFrame) -> DataFrame:
        new = front.join(by, ["case_id", "node"]).select("case_id", "root", F.col("following").alias("node")).distinct()
        return cut(new.join(_all(seen), key, "left_anti"))

    for _ in range(FRONTIER_ROUNDS):
        new = step(seen[-1], hops)
        if new.isEmpty():
            return _all(seen)
        seen.append(new)
    late = [seen[-1]]
    for _ in range(MOST_DOUBLINGS):
        new = step(_all(late), hops)
        if new.isEmpty():
            return _all(seen)
        seen.append(new)
        late.append(new)
        # A case without a new node is done.
        going = hops.join(new.select("case_id").distinct(), "case_id", "left_semi")
        before, hops = hops, cut(_joined(going).select("case_id", "node", "following").distinct())
        spent(before)
        if hops.isEmpty():
            return _all(seen)
    raise RuntimeError("reachability did not end")


def _joined(hops: DataFrame) -> DataFrame:
    """Paths of twice the length: (case_id, node, following) and, if there are weights, their product ``w``."""
    first = hops.withColumnsRenamed({"following": "middle", "w": "w1"})
    return first.join(hops.withColumnRenamed("node", "middle"), ["case_id", "middle"])


def best_reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(case_id, node, reach): the largest product of weights (case_id, source, target, w, from 0 to 1) on any path from a node to a start; 1 at starts.

    The rounds are those of ``reachable``, with best products for sets.  One in
    which no node gains is the last, for it holds every path that is one edge longer.
    """
    hops = edges.filter("w > 0").groupBy("case_id", F.col("target").alias("node"), F.col("source").alias("following")).agg(F.max("w").alias("w"))
    hops = cut(hops)
    reach = cut(starts.select("case_id", "node").distinct().withColumn("reach", F.lit(1.0)))
    for round_ in range(FRONTIER_ROUNDS + MOST_DOUBLINGS):
        new = reach.join(hops, ["case_id", "node"]).select("case_id", F.col("following").alias("node"), (F.col("w") * F.col("reach")).alias("reach"), F.lit(0.0).alias("was"))
        both = reach.withColumn("was", F.col("reach")).unionByName(new).groupBy("case_id", "node").agg(F.max("reach").alias("reach"), F.max("was").alias("was"))
        better = cut(both)
        gains = not better.filter(F.col("reach") - F.col("was") > LEAST_GAIN).isEmpty()
        spent(reach)
        reach = better.drop("was")
        if not gains:
            return reach
        if round_ >= FRONTIER_ROUNDS:
            before, hops = hops, cut(_joined(hops).groupBy("case_id", "node", "following").agg(F.max(F.col("w1") * F.col("w")).alias("w")))
            spent(before)
            if hops.isEmpty():
                return reach
    raise RuntimeError("reach did not settle")
