"""Periodic runs of words by a harmonic grid: longest common extensions between jp and (j+1)p for every period p.

A run is a stretch of words with smallest period q that no neighbouring word
extends.  Of a run with at least four periods three neighbouring grid pairs
(jp, (j+1)p) are equal words, so the two extensions are asked for only there: forward from suffix array, longest common prefixes and range minima
of the words, backward from those of the reversed words.  Arrays are made for
the texts of a batch that need them, all of them together; range minima take
linear memory.

Cases: null and empty texts have no words, no run and an empty collapsed text;
a run of a multiple of its smallest period is reported once, with the smallest;
repeated documents and repeated ids each get their row; texts of any length are
taken whole; other columns stay, and those named as results are replaced; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import Words, text_chunks

#: Fewest periods and fewest words of a run.
LEAST_PERIODS, LEAST_WORDS = 4, 6
#: Bytes of text whose words are taken together; words of a block of range minima.
BATCH_BYTES, RMQ_BLOCK = 1 << 20, 32

WORD = "[^\\x20\\x09-\\x0D]+"


class RangeMinima:
    """Minima of ranges of an array in linear memory: a sparse table over blocks, prefix and suffix minima inside them."""

    def __init__(self, values: np.ndarray):
        b = RMQ_BLOCK
        most = np.iinfo(np.int32).max
        self.values = np.full(-(-max(1, len(values)) // b) * b, most, np.int32)
        self.values[: len(values)] = values
        blocks = self.values.reshape(-1, b)
        self.prefix = np.minimum.accumulate(blocks, axis=1).ravel()
        self.suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):
            step, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of values[first..last], both included."""
        a, b = first // RMQ_BLOCK, last // RMQ_BLOCK
        out = np.minimum(self.suffix[first], self.prefix[last])
        inner = np.flatnonzero(b - a > 1)
        if len(inner):
            lo, n = a[inner] + 1, (b - a)[inner] - 1
            level = np.log2(n).astype(int)
            level -= (1 << level) > n
            for k in np.unique(level):
                at = inner[level == k]
                t = self.table[k]
                out[at] = np.minimum(out[at], np.minimum(t[a[at] + 1], t[b[at] - (1 << k)]))
        same = np.flatnonzero(a == b)
        if len(same):
            lo, n = first[same], last[same] - first[same]
            least = self.values[lo].copy()
            for i in range(1, int(n.max(initial=0)) + 1):
                more = n >= i
                least[more] = np.minimum(least[more], self.values[lo[more] + i])
            out[same] = least
        return out


class Extensions:
    """Longest common prefixes of any two suffixes of a sequence of whole numbers, by its suffix array."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        self.n = n
        _, rank = np.unique(s, return_inverse=True)
        rank = rank.astype(np.int64)
        k, order = 1, np.argsort(rank, kind="stable")
        while rank.max(initial=0) < n - 1:
            following = np.zeros(n, np.int64)
            following[: max(0, n - k)] = rank[k:] + 1
            key = rank * (n + 1) + following
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
            k *= 2
        self.rank = rank
        self.minima = RangeMinima(_common_prefixes(s, order, rank))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes i and j; i and j differ, and n stands for the empty one."""
        out = np.zeros(len(i), np.int64)
        both = np.flatnonzero((i < self.n) & (j < self.n))
        a, b = self.rank[i[both]], self.rank[j[both]]
        out[both] = self.minima(np.minimum(a, b) + 1, np.maximum(a, b))
        return out


def _common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, by Kasai's walk over plain lists."""
    n, values, before = len(s), s.tolist(), np.full(len(s), -1, np.int64)
    before[order[1:]] = order[:-1]
    before, out, h = before.tolist(), [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            h = 0
            continue
        while i + h < n and j + h < n and values[i + h] == values[j + h]:
            h += 1
        out[i] = h
        h = max(0, h - 1)
    lcp = np.zeros(n, np.int32)
    lcp[rank] = out
    return lcp


def grid_pairs(s: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(p, jp) for periods up to a quarter of ``longest`` where three neighbouring pairs (jp, (j+1)p) are equal, so that a run of four periods may lie there."""
    periods, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(1, longest // LEAST_PERIODS + 1):
        grid = s[::p]
        equal = grid[:-1] == grid[1:]
        j = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:])
        if len(j):
            periods.append(np.full(len(j), p))
            places.append(j * p)
    return np.concatenate(periods), np.concatenate(places)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of small numbers, with a number of its own after each text, and where each text begins."""
    sizes = np.array([len(t) for t in texts])
    first = np.r_[0, np.cumsum(sizes + 1)]
    words = np.unique(np.concatenate(texts), return_inverse=True)[1]
    s = np.empty(first[-1], np.int64)
    s[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = words
    s[first[1:] - 1] = words.max(initial=0) + 1 + np.arange(len(sizes))
    return s, first


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, an array of its words as numbers, its runs: rows (start, length, period) by start, then period.

    The grid lies over all texts joined; a run holds three points of it wherever it begins.
    """
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    if not texts:
        return out
    s, first = _joined(texts)
    p, at = grid_pairs(s, max(map(len, texts)))
    if not len(p):
        return out
    of = np.searchsorted(first, at, side="right") - 1
    # Arrays only of the texts that ask.
    asked, of = np.unique(of, return_inverse=True)
    at = at - first[asked[of]]
    s, first = _joined([texts[i] for i in asked])
    n = len(s)
    forward, backward = Extensions(s), Extensions(s[::-1].copy())
    at = at + first[of]
    end = at + p + forward(at, at + p)
    # The words before a place are those from n - place on in the reversed sequence.
    start = at - backward(n - at, n - at - p)
    long = (end - start >= LEAST_PERIODS * p) & (end - start >= LEAST_WORDS)
    of, p, start, length = of[long], p[long], (start - first[of])[long], (end - start)[long]
    # The smallest period of a stretch, once.
    order = np.lexsort((p, length, start, of))
    of, p, start, length = of[order], p[order], start[order], length[order]
    same = np.r_[False, (of[1:] == of[:-1]) & (start[1:] == start[:-1]) & (length[1:] == length[:-1])][: len(p)]
    of, p, start, length = of[~same], p[~same], start[~same], length[~same]
    order = np.lexsort((p, start, of))
    rows = np.stack((start, length, p), axis=1)[order]
    for i, r in zip(asked, np.split(rows, np.searchsorted(of[order], np.arange(1, len(asked)))), strict=True):
        out[i] = r
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those in no run, or in the first period of all runs that hold them."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds runs and collapsed texts to batches whose last column is the text in UTF-8, which goes."""
    for whole in batches:
        for rows, texts in text_chunks(whole, "_text", BATCH_BYTES):
            w = Words(texts)
            spans = [slice(a, b) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            runs = runs_of([w.hashes[x] for x in spans])
            said = []
            for span, r in zip(spans, runs, strict=True):
                stay = np.flatnonzero(kept_words(span.stop - span.start, r)) + span.start
                said.append(b" ".join([w.data[a:b] for a, b in zip(w.starts[stay].tolist(), w.ends[stay].tolist(), strict=True)]).decode())
            flat = np.concatenate(runs)
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], fields=list(_RUN)))
            mine = whole.slice(rows.start, rows.stop - rows.start)
            yield pa.RecordBatch.from_arrays([*mine.columns[:-1], listed, pa.array(said, pa.string())], names=[*whole.schema.names[:-1], "runs", "collapsed"])


def find_runs(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``runs`` (start, length and period in words, by start, then period) and ``collapsed``, the text of the kept words."""
    kept = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in ("runs", "collapsed")])
    run = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([*kept.schema.fields, T.StructField("runs", run), T.StructField("collapsed", T.StringType())])
    return kept.select("*", F.col(f"`{text_col}`").cast("binary").alias("_text")).mapInArrow(_found, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for every tenth hash of the id its words repeated periodically from a place on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.size(words)
    # Once for the text, not for every word.
    row = F.transform(F.array(F.struct(words.alias("w"), n.alias("n"), (g % n).cast("int").alias("a"), g.alias("g"))), lambda x: F.struct(x.w.alias("w"), x.a.alias("a"), (1 + F.floor((x.n - x.a) / (3 + x.g % 8))).cast("int").alias("p")))
    said = F.transform(row, lambda x: F.array_join(F.transform(x.w, lambda w, i: F.when(i < x.a, w).otherwise(F.get(x.w, x.a + F.pmod(i - x.a, x.p)))), " "))
    return F.when((h % 10 == 0) & text.rlike(WORD), F.get(said, F.lit(0))).otherwise(text)


def op12_periodic_runs(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, the number of runs, the longest, and digests of all runs and of the collapsed text."""
    found = find_runs(documents.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))).drop("text")
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, x: F.when((x.length > a.length) | ((x.length == a.length) & ((x.start < a.start) | ((x.start == a.start) & (x.period < a.period)))), x).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x.start, x.length, x.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    d = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length DIV best.period").alias("exponent_milli")
    return d.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")
