"""Hard negatives by vector-approximation files: bounds from cells first, exact scores only where a window may be entered.

Rows are packed into pages.  A page quantises every dimension into cells of
about equally many rows and keeps each cell's middle and half width, so that a
table lookup turns cells into a centre and a radius of every score: the exact
inner product lies between centre - radius and centre + radius.  A page's
vectors are scored exactly only where the upper bound may enter an anchor's
window: the first positives, then the first negatives in the band below each
positive.  Pages stay where they are; anchors, a stated query set, come in
groups of at most about GROUP, and every task keeps for a group no more than its
first rows, which are merged by a window over a few rows per task.

Cases: rows with a null label, a null vector or a null or non-finite component
take no part; an empty vector, and components that one vector has and another
lacks, count as 0; a row without an id takes part with the largest possible
id, which its results show as null; rows that repeat an id are rows of their
own, as anchors too, and an anchor is never its own positive or negative; ties
in score go by id, and among equal ids by nothing that can be seen; scores
beyond 64 bits are cut to the largest 64-bit number; anchors without positives
or a positive without negatives have no row; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import written

#: Rows of a page, cells of a dimension, anchors of a group and of a block of it, pairs that are scored together.
PAGE_ROWS, CELLS, GROUP, BLOCK, PAIRS = 4096, 64, 4096, 256, 1 << 16
#: Id of rows that have none.
NO_ID = (1 << 63) - 1
#: Products up to this size are exact in double precision.
EXACT = float(1 << 53)

_PAGE = "page string, n int, dims int, ids binary, labels binary, exact binary, wide boolean, cells binary, middles binary, halves binary"
_FOUND = "anchor int, place int, id long, score long"


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256) -> DataFrame:
    """id, label, v (whole numbers ``floor(scale * x)`` as double) of the rows that take part."""
    label = F.col("label") if label is None else label
    v = F.transform(F.col(vector_col), lambda x: scale * x.cast("double"))
    d = embeddings.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), label.cast("long").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Not F.floor, which makes a 64-bit number of it.
    whole = F.transform("v", lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    return d.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True))).select("id", "label", whole.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, shorter ones filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def _page(name: str, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> dict:
    n, dims = v.shape
    cells, middles, halves = np.zeros((n, dims), np.uint8), np.zeros((dims, CELLS)), np.zeros((dims, CELLS))
    for d in range(dims):
        x = v[:, d]
        order = np.sort(x)
        bounds = np.unique(order[(np.arange(1, CELLS) * n) // CELLS])
        c = np.searchsorted(bounds, x, side="right")
        least, most = np.full(CELLS, np.inf), np.full(CELLS, -np.inf)
        np.minimum.at(least, c, x)
        np.maximum.at(most, c, x)
        used = most >= least
        cells[:, d] = c
        middles[d, used], halves[d, used] = (least[used] + most[used]) / 2, (most[used] - least[used]) / 2
    wide = bool(np.abs(v).max(initial=0) >= 1 << 31)
    return {
        "page": name, "n": n, "dims": dims, "ids": ids.astype(np.int64).tobytes(), "labels": labels.astype(np.int64).tobytes(), "wide": wide,
        "exact": v.astype(np.float64 if wide else np.int32).tobytes(), "cells": cells.tobytes(), "middles": middles.tobytes(), "halves": halves.tobytes(),
    }


def _pages(page_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def page() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            row = _page(f"{part}-{k}", t["id"].to_numpy(), t["label"].to_numpy(), _matrix(t["v"]))
            return pa.RecordBatch.from_pydict({c: [x] for c, x in row.items()}, schema=_PAGE_SCHEMA)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(page_rows - size, batch.num_rows - at)
                held.append(batch.slice(at, take))
                at, size = at + take, size + take
                if size == page_rows:
                    yield page()
                    held, size, k = [], 0, k + 1
        if held:
            yield page()

    return run


_PAGE_SCHEMA = pa.schema([
    ("page", pa.string()), ("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("exact", pa.binary()), ("wide", pa.bool_()),
    ("cells", pa.binary()), ("middles", pa.binary()), ("halves", pa.binary()),
])


class Page:
    """A page as arrays: ``ids``, ``labels``, exact ``v``, and the bounds' ``centre`` and ``radius`` by table lookup."""

    def __init__(self, row: dict):
        self.name, n, dims = row["page"], row["n"], row["dims"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.v = np.frombuffer(row["exact"], np.float64 if row["wide"] else np.int32).reshape(n, dims).astype(np.float64)
        cells = np.frombuffer(row["cells"], np.uint8).reshape(n, dims)
        place = np.arange(dims)[None]
        self.centre = np.frombuffer(row["middles"]).reshape(dims, CELLS)[place, cells]
        self.radius = np.frombuffer(row["halves"]).reshape(dims, CELLS)[place, cells]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of anchors (rows of ``q``) with all rows; widened where doubles may round."""
        d = min(q.shape[1], self.v.shape[1])
        q = q[:, :d]
        c, r = q @ self.centre[:, :d].T, np.abs(q) @ self.radius[:, :d].T
        top = np.abs(q).sum(1).max(initial=0) * (np.abs(self.centre).max(initial=0) + self.radius.max(initial=0))
        slack = 0.0 if 4 * top < EXACT else 1e-9 * top
        return c - r - slack, c + r + slack

    def scores(self, q: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of an anchor and a row."""
        d = min(q.shape[1], self.v.shape[1])
        out = np.zeros(len(a), np.int64)
        exact = np.abs(q).max(initial=0) * np.abs(self.v).max(initial=0) * max(1, d) < EXACT
        for at in range(0, len(a), PAIRS):
            x, y = q[a[at : at + PAIRS], :d], self.v[r[at : at + PAIRS], :d]
            if exact:
                out[at : at + PAIRS] = np.einsum("ij,ij->i", x, y).astype(np.int64)
            else:
                out[at : at + PAIRS] = [max(-NO_ID, min(NO_ID, sum(int(m) * int(n) for m, n in zip(i, j, strict=True)))) for i, j in zip(x, y, strict=True)]
        return out


def _first(key: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` rows of each key, by score and id."""
    order = np.lexsort((ids, -scores, key))
    sorted_key = key[order]
    starts = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0)) if len(order) else order
    return order[np.arange(len(order)) - first < k]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


class Anchors:
    """A group of anchors as arrays: page and place tell a row, so that none is compared with itself."""

    def __init__(self, rows: list):
        self.pages, self.places = np.array([r["page"] for r in rows], object), np.array([r["place"] for r in rows], np.int64)
        self.ids, self.labels = (np.array([r[c] for r in rows], np.int64) for c in ("id", "label"))
        dims = max((len(r["v"]) for r in rows), default=0)
        self.q = np.zeros((len(rows), dims))
        for i, r in enumerate(rows):
            self.q[i, : len(r["v"])] = r["v"]


def positives_in(page: Page, anchors: Anchors, k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row of the page) of one label that may be among an anchor's first ``k``; ``best`` is the score to reach."""
    out = []
    for at in range(0, len(anchors.q), BLOCK):
        q = anchors.q[at : at + BLOCK]
        low, high = page.bounds(q)
        fits = anchors.labels[at : at + BLOCK, None] == page.labels[None]
        for i in np.flatnonzero(anchors.pages[at : at + BLOCK] == page.name):
            fits[i, anchors.places[at + i]] = False
        least = np.maximum(_kth(np.where(fits, low, -np.inf), k), best[at : at + BLOCK])
        a, r = np.nonzero(fits & (high >= least[:, None]))
        out.append((a + at, r))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(anchors: Anchors, windows: np.ndarray | None, k: int):
    """A task's search over pages.

    Without ``windows`` the first ``k`` rows of an anchor's label; with it, rows
    (anchor, positive's score) in order of anchors, the first ``k`` of other
    labels with 80 * positive <= 100 * score <= 100 * positive.
    """
    n = len(anchors.q) if windows is None else len(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
        best = np.full(n, -np.inf)

        def merge(more: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
            nonlocal key, ids, scores, best
            key, ids, scores = (np.concatenate(x) for x in zip((key, ids, scores), more, strict=True))
            keep = _first(key, ids, scores, k)
            key, ids, scores = key[keep], ids[keep], scores[keep]
            full = np.bincount(key, minlength=n) >= k
            least = np.full(n, np.inf)
            np.minimum.at(least, key, scores.astype(np.float64))
            # A double below the score, where a score has more digits than a double.
            best = np.where(full, least - np.abs(least) * 1e-15, -np.inf)

        for batch in batches:
            for row in batch.to_pylist():
                page = Page(row)
                if windows is None:
                    a, r = positives_in(page, anchors, k, best)
                    merge((a, page.ids[r], page.scores(anchors.q, a, r)))
                else:
                    for more in _in_windows(page, anchors, windows, k, best):
                        merge(more)
        if len(key):
            place = np.zeros(len(key), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(place), pa.array(ids), pa.array(scores)], names=["anchor", "place", "id", "score"])

    return run


def _in_windows(page: Page, anchors: Anchors, windows: np.ndarray, k: int, best: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the page that may be among the first ``k`` of a window, with exact scores inside it: (window, id, score)."""
    of, top = windows[:, 0], windows[:, 1]
    # Whole numbers: 100 * score >= 80 * top, without products that overflow.
    least_score = np.array([-((-4 * int(t)) // 5) for t in top], np.int64)
    for at in range(0, len(anchors.q), BLOCK):
        mine = np.flatnonzero((of >= at) & (of < at + BLOCK))
        if not len(mine):
            continue
        q = anchors.q[at : at + BLOCK]
        low, high = page.bounds(q)
        other = anchors.labels[at : at + BLOCK, None] != page.labels[None]
        a, hi, lo = of[mine] - at, top[mine].astype(np.float64), least_score[mine].astype(np.float64)
        for i in range(0, len(mine), BLOCK):
            j = slice(i, i + BLOCK)
            l, h, o = low[a[j]], high[a[j]], other[a[j]]
            inside = o & (l >= lo[j, None]) & (h <= hi[j, None])
            reach = np.maximum(np.maximum(_kth(np.where(inside, l, -np.inf), k), best[mine[j]]), lo[j])
            w, r = np.nonzero(o & (h >= reach[:, None]) & (l <= hi[j, None]))
            window = mine[j][w]
            score = page.scores(anchors.q, of[window], r)
            good = (score <= top[window]) & (score >= least_score[window])
            yield window[good], page.ids[r[good]], score[good]


def build(rows: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The vector-approximation file: a table of pages, written to the shared folder."""
    return written(rows.mapInArrow(_pages(page_rows), _PAGE), "va-file")


def _anchor_rows(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                page = Page(row)
                at = np.flatnonzero((page.ids % every == 0) & (page.ids != NO_ID))
                if len(at):
                    yield pa.RecordBatch.from_pydict({"page": [page.name] * len(at), "place": at.astype(np.int32), "id": page.ids[at], "label": page.labels[at], "v": list(page.v[at])})

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor's rows, a few from every task, with their place from 1."""
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def mine(pages: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, most: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for all anchors (ids divisible by ``every``).

    One round of two searches per group of anchors; a group's rows, not more
    than about ``most``, are all that the driver holds.
    """
    spark = pages.sparkSession
    anchors = written(pages.mapInArrow(_anchor_rows(every), "page string, place int, id long, label long, v array<double>"), "anchors")
    groups = max(1, -(-anchors.count() // most))
    anchors = anchors.withColumn("group", F.pmod(F.xxhash64("page", "place"), F.lit(groups)))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    for g in range(groups):
        group = Anchors(anchors.filter(F.col("group") == g).orderBy("id", "page", "place").collect())
        near = _merged(pages.mapInArrow(_search(group, None, positives), _FOUND), positives).orderBy("anchor", "place").collect()
        windows = np.array([(r["anchor"], r["score"]) for r in near], np.int64).reshape(-1, 2)
        far = _merged(pages.mapInArrow(_search(group, windows, negatives), _FOUND), negatives)
        names = spark.createDataFrame([(i, int(group.ids[r["anchor"]]), r["id"], r["score"]) for i, r in enumerate(near)], "anchor int, anchor_id long, positive_id long, positive_score long")
        rows = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score", "place": "rank"}).join(F.broadcast(names), "anchor")
        no_id = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
        out = out.unionByName(written(rows.select("anchor_id", no_id("positive_id"), F.col("rank").cast("int").alias("rank"), no_id("negative_id"), "positive_score", "negative_score"), "negatives"))
    return out


def op11_hard_negatives(embeddings: DataFrame, page_rows: int = PAGE_ROWS, group: int = GROUP) -> DataFrame:
    """Hard negatives of every hundredth vector, after the change of every seventh label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(build(quantised(embeddings, label=label), page_rows), most=group)


ORACLE = """
WITH r AS (
  SELECT vec_id, label, list_transform(v, x -> floor(256 * x)::BIGINT) AS v, row_number() OVER () AS at FROM (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS v FROM embeddings)
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, x -> x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, a.at AS anchor, b.vec_id AS id, b.at, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), x -> x[1] * x[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.at <> b.at WHERE a.vec_id % 100 = 0),
near AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM pairs WHERE same QUALIFY place <= 5),
far AS (
  SELECT p.anchor_id, p.anchor, p.id AS positive_id, p.place, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.id) AS rank
  FROM near p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM far WHERE rank <= 5
"""
