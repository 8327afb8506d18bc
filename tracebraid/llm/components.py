"""Connected components of an edge table, by alternating star contractions.

Edges are first contracted where they are: of every run of edges in a task only
each node's link to the smallest node it reaches in the run goes on.  A round points every larger neighbour of a node to the smallest node around it
(large star), then every node's smaller neighbours to the smallest of them
(small star).  Both are a grouped minimum and a join; no node's neighbours are
ever gathered.  The edges of each round are written to the shared folder, so a
lost executor repeats one round at most, and those of the round before deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import spent, written

#: Edges that a task contracts together.
RUN_EDGES = 250_000


def smallest_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of edges (u, v), and for each the smallest one that the edges connect it with."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        # Both ends and their present labels go to the smaller label; then labels follow labels.
        for at in (a, b, before[a], before[b]):
            np.minimum.at(label, at, least)
        label = label[label]
        if (label == before).all():
            break
    return nodes, nodes[label]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def run() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        kind = table.schema.field("u").type
        values = lambda c: table.column(c).to_numpy() if pa.types.is_integer(kind) else np.array(table.column(c).to_pylist(), object)
        nodes, roots = smallest_reached(values("u"), values("v"))
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(roots, kind)], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= RUN_EDGES:
            yield run()
            held = []
    if held:
        yield run()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` has two columns of one ordered type; the result has ``node`` and ``component``, its smallest node.

    Only nodes with an edge are returned; edges with a null end are ignored.
    """
    a, b = edges.columns
    first = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    first = written(first.mapInArrow(_contracted, first.schema).distinct(), "edges")
    pairs, state = first.filter("u > v"), None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, pairs = pairs, written(small.filter("u > v").distinct(), "edges")
        spent(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            nodes = first.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            joined = nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left")
            out = written(joined.select("node", F.coalesce("component", "node").alias("component")), "components")
            spent(first, pairs)
            return out
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
