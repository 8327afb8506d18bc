"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

The benchmark's words are numbered; each of its windows is a row of word
numbers with a 64-bit hash.  These tables, whose size is checked, go to every
task.  Training texts are scanned as arrays of word numbers: only where a whole
window's length of words is known to the benchmark is a hash made, looked up in
the sorted hash set and verified number by number.  A benchmark above the size
limit is dealt into blocks, each scanned by its own pass over the same rows, so
the memory of a task is bounded and no window is left out.

Cases: null and empty texts have no words and hit nothing; an item without
words has no window; repeated rows (documents or items) each count as they
stand, equal item ids as one item; a null item id is the empty string; empty
tables give empty or clean results; columns of other names are carried along
untouched, also if they clash with internal names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .text import ALNUM_TABLE

#: Words of a window.
WINDOW = 13
#: A document is contaminated when at least one word in so many is hit.
SHARE = 20
#: Benchmark words of a broadcast block, at about 80 bytes each.
BLOCK_WORDS = 400_000


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of anything beyond ASCII."""
    return (text or b"").translate(ALNUM_TABLE).split()


class WindowSet:
    """The windows of some benchmark items, as hash sets by window length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.by_length = {}
        for n, windows in found.items():
            rows = np.array(list(windows), np.int64).reshape(-1, n)
            order = np.argsort(h := self.hashed(rows), kind="stable")
            owners = list(windows.values())
            self.by_length[n] = (h[order], rows[order], [sorted(owners[i]) for i in order])

    @staticmethod
    def hashed(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for column in rows.T:
            h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def scan(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Which words are hit, where each document begins, and each document's items."""
        first = np.cumsum([0, *(len(d) + 1 for d in docs)])
        number = self.numbers.get
        ids = np.zeros(int(first[-1]) + 1, np.int64)
        for i, d in enumerate(docs):
            ids[first[i] : first[i] + len(d)] = [number(w, 0) for w in d]
        known = np.cumsum(np.concatenate(([0], ids != 0)))
        change = np.zeros(len(ids) + 1, np.int64)
        items: list[set[str]] = [set() for _ in docs]
        for n, (hashes, rows, owners) in self.by_length.items():
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            seen = np.lib.stride_tricks.sliding_window_view(ids, n)[at]
            h = self.hashed(seen)
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            while len(at):  # equal hashes of different windows stand side by side
                live = lo < hi
                at, seen, lo, hi = at[live], seen[live], lo[live], hi[live]
                same = (rows[lo] == seen).all(axis=1) if len(at) else np.zeros(0, bool)
                np.add.at(change, at[same], 1)
                np.add.at(change, at[same] + n, -1)
                doc = np.searchsorted(first, at[same], "right") - 1
                for d, w in np.unique(np.stack([doc, lo[same]], 1), axis=0) if same.any() else ():
                    items[d].update(owners[w])
                lo = lo + 1
        return np.cumsum(change)[:-1] > 0, first, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's rows in blocks of about ``limit`` words; one block at a time is on the driver."""
    rows = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    words = rows.agg(F.coalesce(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))), F.lit(0))).first()[0]
    n = max(1, -(-int(words) // limit))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    for k in range(n):
        got = dealt.filter(F.col("block") == k).select("item", F.col("text").cast("binary")).collect()
        yield [(r[0], bytes(r[1])) for r in got]


def scan_documents(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = SHARE,
    block_words: int = BLOCK_WORDS,
    keep_text: bool = True,
    scan_col: str = "scan",
) -> DataFrame:
    """The documents with one struct column ``scan_col``; without their texts if ``keep_text`` is off.

    It holds ``n_words``, ``n_hit``, ``items`` (sorted item ids),
    ``spans`` (hit word ranges, end exclusive) and ``contaminated``.
    """
    spark = documents.sparkSession
    scan = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
        ]
    )
    others = [c for c in documents.columns if c != text_col]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others])
    df = documents.select(row.alias("row"), F.lit(None).cast(scan).alias("scan"), F.col(text_col).cast("binary").alias("text"))
    schema = df.schema
    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        last = after is None and not keep_text
        held = spark.sparkContext.broadcast(WindowSet(block, window))
        df = df.mapInArrow(
            lambda batches, held=held, last=last: _scanned(batches, held.value, not last),
            T.StructType(schema.fields[:2]) if last else schema,
        )
        block = after
    n, hit = F.col("scan.n_words"), F.col("scan.n_hit")
    columns = [F.col("text").cast("string").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in documents.columns if keep_text or c != text_col]
    return df.select(*columns, F.col("scan").withField("contaminated", (hit > 0) & (share * hit >= n)).alias(scan_col))


def _scanned(batches: Iterator[pa.RecordBatch], windows: WindowSet, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for begin in range(0, whole.num_rows, 512):
            batch = whole.slice(begin, 512)
            docs = [words_of(t) for t in batch.column("text").to_pylist()]
            hit, first, items = windows.scan(docs)
            edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            lo = np.searchsorted(starts, first)
            out = []
            for i, (d, had) in enumerate(zip(docs, batch.column("scan").to_pylist(), strict=True)):
                spans = [(int(s - first[i]), int(e - first[i])) for s, e in zip(starts[lo[i] : lo[i + 1]], ends[lo[i] : lo[i + 1]], strict=True)]
                if had:
                    spans = _union(spans + [(s["begin"], s["end"]) for s in had["spans"]])
                    items[i] |= set(had["items"])
                out.append(
                    {
                        "n_words": len(d),
                        "n_hit": sum(e - s for s, e in spans),
                        "items": sorted(items[i]),
                        "spans": [{"begin": s, "end": e} for s, e in spans],
                    }
                )
            field = batch.schema.field("scan")
            batch = batch.set_column(1, field, pa.array(out, field.type))
            yield batch if keep_text else batch.select(["row", "scan"])


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _own(documents: DataFrame) -> str:
    """A name for the scan that no column has."""
    name, taken = "scan", {c.lower() for c in documents.columns}
    while name in taken:
        name += "_"
    return name


def remove_documents(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    scan = _own(documents)
    scanned = scan_documents(documents, benchmark, scan_col=scan, **options)
    return scanned.filter(~F.col(f"{scan}.contaminated")).drop(scan)


def remove_spans(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """All documents, hit words cut from their texts (from a span's first word to its last)."""
    scan = _own(documents)
    scanned = scan_documents(documents, benchmark, text_col=text_col, scan_col=scan, **options)
    spans, text = F.col(f"{scan}.spans"), F.col(f"`{text_col}`")
    hit = F.size(spans) > 0
    # Clean texts do not travel to Python.
    left = _without(F.when(hit, text.cast("binary")), F.when(hit, F.transform(spans, lambda x: x.begin)), F.when(hit, F.transform(spans, lambda x: x.end)))
    return scanned.withColumn(text_col, F.when(hit, left.cast("string")).otherwise(text)).drop(scan)


@F.pandas_udf(T.BinaryType())
def _without(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else cut_words(t, b, e) for t, b, e in zip(texts, begins, ends, strict=True)], dtype=object)


def cut_words(text: bytes, begins: np.ndarray, ends: np.ndarray) -> bytes:
    """The text without the word ranges (begin, end), each from its first word's first byte to its last word's last."""
    edge = np.diff(np.frombuffer(text.translate(ALNUM_TABLE), np.uint8) != 0x20, prepend=False, append=False)
    places = np.flatnonzero(edge).reshape(-1, 2)
    first, last = places[np.asarray(begins, int), 0], places[np.asarray(ends, int) - 1, 1]
    return b"".join([text[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(text)], strict=True)])


def op2_decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items that occur in it, verdict."""
    s = scan_documents(documents.select("doc_id", "text"), benchmark, keep_text=False)
    return s.select(
        "doc_id",
        F.col("scan.n_words").alias("n_words"),
        F.col("scan.n_hit").alias("n_hit"),
        F.size("scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("scan.items", ","), 256).alias("items_sha256"),
        F.col("scan.contaminated").alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    """The digest column's value for sorted item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
