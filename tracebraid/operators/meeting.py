"""Calls of the spans of a task: parents and children of a trace meet in Arrow batches, some whole traces at a time.

Rows come in order of ``place``, a hash of case and trace; names decide who meets, never the hash.  A trace of
more than ``HELD_ROWS`` spans is dealt by key over files in the task's temporary folder and counted file by file.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.expressions import EDGE_SPACE

#: What ``calls`` makes; one row for each pair of services in the traces that are held together.
CALLS = "case_id string, caller string, callee string, times long, normal_times long"
#: Spans held at once, files of a larger trace, pairs made at once.
HELD_ROWS, FILES, PAIRS = 200_000, 64, 2_000_000
NAMES = ["case_id", "trace_id", "span_id", "parent_span_id", "service_name", "normal"]


def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of spans in order of ``place`` the calls between services and how often they occur, in both windows and in the normal one."""
    held, n, large = [], 0, None
    for batch in batches:
        cleaned = _clean(pa.Table.from_batches([batch]))
        held.append(cleaned)
        n += len(cleaned)
        if n < HELD_ROWS:
            continue
        t = pa.concat_tables(held)
        place = t["place"].to_numpy()
        if large is not None:
            # The large trace goes on, or has ended.
            end = int(np.searchsorted(place, large.place, "right"))
            large.add(t.slice(0, end))
            if end < len(t):
                yield from large.calls()
                large = None
            t, place = t.slice(end), place[end:]
        if len(t):
            last = int(np.searchsorted(place, place[-1]))
            yield from _counted(t.slice(0, last))
            t, place = t.slice(last), place[last:]
            if len(t) >= HELD_ROWS:
                large = _Large(int(place[0]))
                large.add(t)
                t = t.slice(len(t))
        held, n = [t], len(t)
    if held or large is not None:
        t = pa.concat_tables(held) if held else None
        if large is not None:
            if t is not None:
                end = int(np.searchsorted(t["place"].to_numpy(), large.place, "right"))
                large.add(t.slice(0, end))
                t = t.slice(end)
            yield from large.calls()
        if t is not None:
            yield from _counted(t)


class _Large:
    """Spans of one place in files by the hash of the key at which they meet: each at its own and at its parent's."""

    def __init__(self, place: int):
        self.place, self.folder, self.files = place, tempfile.TemporaryDirectory(prefix="trace-"), {}

    def add(self, t: pa.Table) -> None:
        for c, other in (("span_id", "parent_span_id"), ("parent_span_id", "span_id")):
            at = t.filter(pc.is_valid(t[c])).select(NAMES)
            at = at.set_column(at.schema.get_field_index(other), other, pa.nulls(len(at), pa.string()))
            # Equal rows are one with their number, so that a span of very many children takes little room.
            at = at.group_by(NAMES).aggregate([([], "count_all")]).rename_columns([*NAMES, "n"])
            if not len(at):
                continue
            file = pd.util.hash_array(at[c].to_pandas().to_numpy(object), categorize=False) % FILES
            for i in np.unique(file):
                part = at.filter(pa.array(file == i))
                if i not in self.files:
                    self.files[i] = pa.ipc.new_stream(os.path.join(self.folder.name, str(i)), part.schema)
                self.files[i].write_table(part)

    def calls(self) -> Iterator[pa.RecordBatch]:
        for i, f in self.files.items():
            f.close()
            with pa.ipc.open_stream(os.path.join(self.folder.name, str(i))) as read:
                yield from _counted(read.read_all())
        self.folder.cleanup()


def _clean(t: pa.Table) -> pa.Table:
    """Ids and services as ``expressions.clean`` makes them; a span without a trace or a service is left out."""
    for c in ("trace_id", "span_id", "parent_span_id", "service_name"):
        x = pc.ascii_trim(t[c], characters=EDGE_SPACE)
        none = pc.is_in(pc.utf8_lower(x), pa.array(["", "none", "null", "nan"]))
        t = t.set_column(t.schema.get_field_index(c), c, pc.if_else(none, pa.scalar(None, pa.string()), x))
    return t.filter(pc.and_(pc.is_valid(t["trace_id"]), pc.is_valid(t["service_name"])))


def _codes(*columns: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the columns' values, in one numbering, -1 for null; and the values."""
    d = pa.chunked_array([x for c in columns for x in c.chunks], columns[0].type).combine_chunks().dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def _counted(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Calls of whole traces.  Spans of a key are counted by service and window before they meet."""
    if not len(t):
        return
    case, cases = _codes(t["case_id"])
    trace, traces = _codes(t["trace_id"])
    service, services = _codes(t["service_name"])
    ids, names = _codes(t["span_id"], t["parent_span_id"])
    own, up = ids[: len(t)], ids[len(t) :]
    normal = t["normal"].to_numpy().astype(np.int64)
    n = t["n"].to_numpy() if "n" in t.column_names else np.ones(len(t), np.int64)
    # Null cases are a case of their own.
    _, group = np.unique((case + 1) * len(traces) + trace, return_inverse=True)
    kinds = 2 * len(services)

    def side(key: np.ndarray) -> tuple[np.ndarray, ...]:
        on = np.flatnonzero(key >= 0)
        # Rows of a table are fewer than 2 ** 31, so two of these numbers fit into 64 bits.
        g, each = np.unique(group[on] * len(names) + key[on], return_inverse=True)
        k, count = _grouped(each * kinds + 2 * service[on] + normal[on], n[on])
        first = np.zeros(len(g), np.int64)
        first[each] = case[on]
        return g[k // kinds], k % kinds // 2, k % 2, count, first[k // kinds]

    at, caller, up_normal, up_n, _ = side(own)
    to, callee, in_normal, times, of = side(up)
    low, high = np.searchsorted(at, to), np.searchsorted(at, to, "right")
    ends = np.cumsum(high - low)
    cut, total = 0, int(ends[-1]) if len(ends) else 0
    done = []
    while cut < len(to) and total:
        before = ends[cut - 1] if cut else 0
        stop = max(cut + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        many = (high - low)[cut:stop]
        child = np.repeat(np.arange(cut, stop), many)
        parent = np.arange(len(child)) + np.repeat(low[cut:stop] - (ends[cut:stop] - many - before), many)
        keep = caller[parent] != callee[child]
        child, parent = child[keep], parent[keep]
        both = times[child] * up_n[parent]
        pair = ((of[child] + 1) * len(services) + caller[parent]) * len(services) + callee[child]
        done.append(_grouped(pair, both, both * (in_normal[child] & up_normal[parent])))
        cut = stop
    if done:
        pair, both, in_both = _grouped(*[np.concatenate(x) for x in zip(*done, strict=True)])
        place = pair // len(services) ** 2 - 1
        columns = [cases.take(pa.array(place, mask=place < 0)), services.take(pa.array(pair // len(services) % len(services))), services.take(pa.array(pair % len(services)))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(both), pa.array(in_both)], ["case_id", "caller", "callee", "times", "normal_times"])
