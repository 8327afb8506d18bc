"""Exact Jaccard join of documents on word shingles, down to connected components.

1. Every text becomes a set of 64-bit shingle hashes.  Hashes travel as packed
   arrays by hash range, and each range tells which of them occur in two texts
   or more, and in how many.  A hash that many texts of one packed chunk share
   travels once, with its count; the list of these texts stays with the chunk.  A
   document that shares less than the threshold's part of its set with all
   others together can have no link.
2. Documents with equal sets form one class; classes that may have links are the
   nodes from here on.
3. With the hashes of each set ordered by their counts, the rarest first, two
   linked sets must meet among the first ``n - ceil(t n) + 1`` of each.  Of these,
   hashes of one text only cannot meet and are left out.  So passages that many texts
   share bring none together that have rarer things to differ by.  Components over
   these meetings are clusters; every link lies inside one.  Only sets of clusters
   are computed again.
4. A cluster is cut into tiles: bands of set size (a factor of 1/t each; links
   reach the next band at most), and within a band by node number into blocks
   of bounded size.  A cluster that fits one block is one tile.  In a tile, hashed
   bitmaps of all sets give the overlap's upper bound ``(n + m - different bits) / 2``;
   pairs that may reach the threshold are decided by intersecting the sorted sets.
   Pairs that are in one component already need no decision.
5. Where a cluster has several blocks, a node of each block's largest component
   is compared first, ``FAN`` blocks at a time; then nodes outside the cluster's largest component are
   compared with all blocks in reach.  Nodes within one component never meet
   again, so a large group of near copies costs no square of its size.

Cases: null and empty texts have the empty set, no links, and are components of
their own; a text of fewer than five words is one shingle; repeated rows are
linked as equal sets; rows of one doc_id with unlike texts are linked only by
their texts; a null doc_id has a null component unless it is linked with others;
an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .store import bounded_broadcast, written
from .text import Words, mix, text_chunks

WORDS, PERCENT = 5, 80
#: Hashes of one packed row, of one hash range and of one block of a tile.
CHUNK_HASHES, RANGE_HASHES, BLOCK_HASHES = 1_000_000, 1_000_000, 200_000
#: Documents of one packed row; a hash that more of them share is packed once.
CHUNK_DOCS, PACKED_OWNERS = 60_000, 256
#: Stands for the owners that stay with the chunk.
MANY = 0xFFFF
#: Stands for a null id; no document may bear it.
NO_ID = -(1 << 63)

_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z."""
    w = Words([t.lower() for t in texts])
    h = w.hashes
    all_windows = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        all_windows += h[j : j + len(all_windows)] * _PLACES[j]
    all_windows = mix(all_windows)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(all_windows[a : b - words + 1]))
        else:
            n = b - a
            out.append(mix(np.array([(h[a:b] * _PLACES[:n]).sum() + np.uint64(n)], np.uint64)) if n else np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    return tuple(int(mix(s ^ np.uint64(c)).sum().view(np.int64)) if len(s) else 0 for c in (0x1234567890ABCDEF, 0xFEDCBA0987654321))


_HEAD = np.dtype([("id", "<i8"), ("n", "<i8"), ("c1", "<i8"), ("c2", "<i8")])


def _pack(batches: Iterator[pa.RecordBatch], ranges: int, words: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of a chunk of documents: (range, chunk, hashes' low halves, their documents' numbers).

    A hash of more than ``PACKED_OWNERS`` documents has the owner ``MANY``, and
    ``many`` has its number of documents.  One of a chunk's rows has its documents
    (``head``) and the owners that are not packed (``kept``).
    """
    from pyspark import TaskContext

    base, chunks = TaskContext.get().partitionId() << 24, 0
    heads: list[tuple] = []
    sets: list[np.ndarray] = []
    size = 0

    def packed() -> pa.RecordBatch:
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        key = (((flat >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)) << np.uint64(32) | (flat & np.uint64(0xFFFFFFFF))
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(begins, len(key)))
        hot = count > PACKED_OWNERS
        inside = np.repeat(hot, count)
        kept = np.concatenate([np.zeros(0, np.uint8), *(np.ascontiguousarray(x).view(np.uint8) for x in (key[begins[hot]], count[hot].astype(np.uint32), owner[inside]))])
        many = count[hot].astype(np.uint32)
        stays = ~inside
        stays[begins[hot]] = True
        owner[begins[hot]] = MANY
        key, owner = key[stays], owner[stays]
        low, cuts = key.astype(np.uint32), np.searchsorted(key >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
        before = np.concatenate(([0], np.cumsum(owner == MANY)))
        used = [r for r in range(ranges) if cuts[r] < cuts[r + 1]] or [0]
        head = [None] * len(used)
        head[chunks % len(used)] = np.array(heads, _HEAD).tobytes()
        part = lambda x: [x[cuts[r] : cuts[r + 1]].tobytes() for r in used]
        return pa.RecordBatch.from_pydict(
            {
                "range": pa.array(used, pa.int64()),
                "chunk": pa.array([base + chunks] * len(used), pa.int64()),
                "low": pa.array(part(low), pa.binary()),
                "owner": pa.array(part(owner), pa.binary()),
                "many": pa.array([many[before[cuts[r]] : before[cuts[r + 1]]].tobytes() for r in used], pa.binary()),
                "head": pa.array(head, pa.binary()),
                "kept": pa.array([None if h is None else kept.tobytes() for h in head], pa.binary()),
                "hot": pa.array([0 if h is None else int(hot.sum()) for h in head], pa.int64()),
            }
        )

    for batch in batches:
        ids = batch.column("rid").to_pylist()
        for rows, texts in text_chunks(batch, "text"):
            for rid, s in zip(ids[rows], shingle_sets(texts, words), strict=True):
                heads.append((rid, len(s), *set_key(s)))
                sets.append(s)
                size += len(s)
                if size >= CHUNK_HASHES or len(sets) >= CHUNK_DOCS:
                    yield packed()
                    chunks += 1
                    heads, sets, size = [], [], 0
    if heads:
        yield packed()


PACKED = "range long, chunk long, low binary, owner binary, many binary, head binary, kept binary, hot long"


def _shared_in_range(key: tuple, table: pa.Table) -> pa.Table:
    """For each packed row of one range: those of its hashes that occur twice or more, their owners and counts."""
    lows = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
    owners = [np.frombuffer(x, np.uint16) for x in table.column("owner").to_pylist()]
    times = [np.ones(len(x), np.int64) for x in owners]
    for t, o, m in zip(times, owners, table.column("many").to_pylist(), strict=True):
        t[o == MANY] = np.frombuffer(m, np.uint32)
    flat, back = np.unique(np.concatenate([np.zeros(0, np.uint32), *lows]), return_inverse=True)
    count = np.bincount(back, np.concatenate([np.zeros(0, np.int64), *times]), len(flat))[back]
    at, out = 0, []
    for low, owner in zip(lows, owners, strict=True):
        n = count[at : at + len(low)]
        at += len(low)
        shared = n > 1
        out.append((low[shared].tobytes(), owner[shared].tobytes(), np.minimum(n[shared], 0xFFFFFFFF).astype(np.uint32).tobytes()))
    columns = {name: pa.array([x[i] for x in out], pa.binary()) for i, name in enumerate(("low", "owner", "count"))}
    return table.select(["chunk", "range", "head", "kept", "hot"]).append_column("low", columns["low"]).append_column("owner", columns["owner"]).append_column("count", columns["count"])


SHARED = "chunk long, range long, head binary, kept binary, hot long, low binary, owner binary, count binary"


def _add_up(key: tuple, table: pa.Table, percent: int) -> pa.Table:
    """One row per document of a chunk: rid, n, c1, c2; and, where it may have links, the hashes by which it can meet others."""
    [first] = [r for r in table.select(["head", "kept", "hot"]).to_pylist() if r["head"] is not None]
    head, hot = np.frombuffer(first["head"], _HEAD), first["hot"]
    hot_keys = np.frombuffer(first["kept"], np.uint64, hot)
    hot_sizes = np.frombuffer(first["kept"], np.uint32, hot, 8 * hot).astype(np.int64)
    hot_owners = np.frombuffer(first["kept"], np.uint16, -1, 12 * hot) if len(first["kept"]) > 12 * hot else np.zeros(0, np.uint16)
    hot_begins = np.cumsum(hot_sizes) - hot_sizes
    keys, owners, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint32)]
    for r, low, owner, count in zip(*(table.column(c).to_pylist() for c in ("range", "low", "owner", "count")), strict=True):
        k = np.uint64(r) << np.uint64(32) | np.frombuffer(low, np.uint32).astype(np.uint64)
        owner, count = np.frombuffer(owner, np.uint16), np.frombuffer(count, np.uint32)
        many = owner == MANY
        if many.any():
            at = np.searchsorted(hot_keys, k[many])
            sizes = hot_sizes[at]
            places = np.repeat(hot_begins[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            keys += [k[~many], np.repeat(k[many], sizes)]
            owners += [owner[~many], hot_owners[places]]
            counts += [count[~many], np.repeat(count[many], sizes)]
        else:
            keys.append(k), owners.append(owner), counts.append(count)
    key_, owner, count = (np.concatenate(x) for x in (keys, owners, counts))
    n = head["n"]
    shared = np.bincount(owner, minlength=len(head))
    may = (n > 0) & (100 * shared >= percent * n)
    # Of the first n - ceil(t n) + 1 hashes those of one text come first; the rest are the rarest of the shared.
    most = np.where(may, n - -(-percent * n // 100) + 1 - (n - shared), 0)
    live = may[owner]
    key_, owner, count = key_[live], owner[live].astype(np.int64), count[live]
    order = np.lexsort((key_, count, owner))
    owner = owner[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    chosen = place < most[owner]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[chosen], minlength=len(head))))).astype(np.int32)
    mask = pa.array(~may)
    meets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key_[order][chosen].view(np.int64)), mask=mask)
    return pa.table({"rid": head["id"].copy(), "n": n.copy(), "c1": head["c1"].copy(), "c2": head["c2"].copy(), "meets": meets})


def _set_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("rid").to_pylist()
        for rows, texts in text_chunks(batch, "text"):
            sets = shingle_sets(texts, words)
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_pydict(
                {
                    "rid": pa.array(ids[rows], pa.int64()),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "c1": pa.array([k[0] for k in keys], pa.int64()),
                    "c2": pa.array([k[1] for k in keys], pa.int64()),
                    "hashes": pa.array([s.tobytes() for s in sets], pa.binary()),
                }
            )


def links_in_tile(sets: list[np.ndarray], groups: np.ndarray, asked: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join the given groups of sets further; of each pair one at least is ``asked``.

    ``groups`` are labels of sets known to be connected.  The result is pairs of
    positions; with them the labels become those of the components of all links.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, label, asked = [sets[i] for i in order], groups[order].copy(), asked[order]
    n = np.array([len(s) for s in sets], np.int64)
    if not len(n):
        return []
    bits = 1 << max(6, min(14, int(np.median(n)).bit_length()))
    maps = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(maps, sets, strict=True):
        odd = np.flatnonzero(np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1)
        np.bitwise_or.at(row, odd >> 6, np.uint64(1) << (odd & 63).astype(np.uint64))
    found = []
    for i in range(1, len(sets)):
        first = int(np.searchsorted(n, -(-percent * int(n[i]) // 100)))
        near = first + np.flatnonzero((label[first:i] != label[i]) & (asked[first:i] | asked[i]))
        if not len(near):
            continue
        differ = np.bitwise_count(maps[near] ^ maps[i]).sum(axis=1, dtype=np.int64)
        may = (100 + percent) * ((n[near] + n[i] - differ) // 2) >= percent * (n[near] + n[i])
        near, differ = near[may], differ[may]
        near = near[np.argsort(differ, kind="stable")]
        while len(near):
            j, near = near[0], near[1:]
            at = np.searchsorted(sets[i], sets[j])
            at[at == n[i]] = 0
            common = int((sets[i][at] == sets[j]).sum())
            if (100 + percent) * common >= percent * int(n[i] + n[j]):
                found.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
    return found


def _distinct_rows(table: pa.Table) -> pa.Table:
    """Rows of one node once, as asked if one is."""
    node, asked = table.column("node").to_numpy(), table.column("asked").to_numpy(zero_copy_only=False)
    order = np.lexsort((~asked, node))
    node = node[order]
    return table.take(order[np.concatenate(([True], node[1:] != node[:-1]))]) if len(node) else table


def _tile_links(key: tuple, table: pa.Table, percent: int) -> pa.Table:
    """Links among the rows (node, component, asked, hashes) of one tile, as pairs of components."""
    table = _distinct_rows(table)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    component = table.column("component").to_numpy()
    links = links_in_tile(sets, component, table.column("asked").to_numpy(zero_copy_only=False), percent)
    return pa.table({"a": pa.array([int(component[i]) for i, _ in links], pa.int64()), "b": pa.array([int(component[j]) for _, j in links], pa.int64())})


def _tile_roots(key: tuple, table: pa.Table, percent: int) -> pa.Table:
    """Every node (node, hashes) of a tile with the smallest node that it is connected with there."""
    table = _distinct_rows(table.append_column("asked", pa.array(np.ones(len(table), bool))))
    node = table.column("node").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    label = np.arange(len(node))
    for i, j in links_in_tile(sets, label, np.ones(len(node), bool), percent):
        label[label == label[i]] = label[j]
    root = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(root, label, node)
    keys = {c: pa.array([k.as_py()] * len(node), pa.int64()) for c, k in zip(_TILE, key, strict=True)}
    return pa.table(keys | {"node": node, "root": root[label]})


_TILE = ["cluster", "band", "slot"]


def _rooted(rows: DataFrame, percent: int) -> DataFrame:
    grouped = rows.select(*_TILE, "node", "hashes").groupBy(*_TILE)
    return written(grouped.applyInArrow(lambda k, t: _tile_roots(k, t.select(["node", "hashes"]), percent), "cluster long, band long, slot long, node long, root long"), "roots")


def _clusters(classes: DataFrame) -> DataFrame:
    """(node, cluster) of the nodes that meet others by one of their ``meets``."""
    keys = written(classes.select(F.explode("meets").alias("key"), "node"), "meetings")
    pivot = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).filter("pivot < top").select("key", "pivot")
    meets = keys.join(pivot, "key").filter("node > pivot").select("node", "pivot")
    return connected_components(meets).withColumnRenamed("component", "cluster")


#: Blocks of a band whose pivots meet in one tile.
FAN = 8


def _placed(nodes: DataFrame, percent: int) -> DataFrame:
    """Adds band and slot to nodes (cluster, n and others); a cluster that fits one block has band -1."""
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9).cast("long")
    nodes = nodes.withColumn("band", band)
    parts = nodes.groupBy("cluster", "band").agg(F.sum("n").alias("part"))
    whole = parts.groupBy("cluster").agg(F.sum("part").alias("whole")).filter(F.col("whole") > BLOCK_HASHES).select("cluster")
    cut = written(parts.join(whole, "cluster").select("cluster", "band", F.ceil(F.col("part") / BLOCK_HASHES).alias("slots")), "cut-clusters")
    slot = F.coalesce(F.pmod(F.xxhash64("node"), F.col("slots")), F.lit(0)).cast("long")
    return nodes.join(bounded_broadcast(cut), ["cluster", "band"], "left").withColumns({"band": F.when(F.col("slots").isNotNull(), F.col("band")).otherwise(F.lit(-1).cast("long")), "slot": slot}).drop("slots")


def _pivot_maps(sets: DataFrame, parts: DataFrame, percent: int) -> list[DataFrame]:
    """Tables (root, label), each for the labels of the one before, that connect blocks by a set of each one's largest component.

    Pivots of a band meet ``FAN`` at a time, level by level; when fewer are left, those of all bands of a cluster meet.
    """
    maps = []
    count = parts.groupBy(*_TILE, "root").agg(F.count("*").alias("m"))
    slots = parts.agg(F.max("slot")).first()[0]
    across = False
    while not across:
        across = slots < FAN
        pivots = count.groupBy(*_TILE).agg(F.max_by("root", F.struct("m", "root")).alias("node"), F.max("m").alias("m"))
        slots //= FAN
        band = F.lit(-1).cast("long") if across else F.col("band")
        pivots = written(pivots.select("cluster", band.alias("band"), F.lit(0).cast("long").alias("slot") if across else F.floor(F.col("slot") / FAN).alias("slot"), "node", "m"), "pivots")
        found = _rooted(sets.select("node", "hashes").join(bounded_broadcast(pivots), "node"), percent)
        maps.append(found.filter("root <> node").select(F.col("node").alias("root"), F.col("root").alias("label")))
        count = pivots.join(found.select("node", "root"), "node").groupBy(*_TILE, "root").agg(F.sum("m").alias("m"))
    return maps


def _cluster_components(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the links among ``sets`` (cluster, band, slot, node, n, hashes)."""
    parts = _rooted(sets, percent)
    whole = parts.filter("band < 0").select("node", F.col("root").alias("component"))
    parts, large = parts.filter("band >= 0"), sets.filter("band >= 0")
    if not parts.limit(1).count():
        return whole
    for labels in _pivot_maps(large, parts, percent):
        parts = parts.join(bounded_broadcast(labels), "root", "left").withColumn("root", F.coalesce("label", "root")).drop("label")
    parts = written(parts.select("node", "cluster", F.col("root").alias("component")), "block-components")
    count = parts.groupBy("cluster", "component").agg(F.count("*").alias("m"))
    main = count.groupBy("cluster").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    asks = written(parts.join(bounded_broadcast(written(main, "main")), "cluster").filter("component <> main").select("node"), "loose")
    if asks.limit(1).count():
        named = large.join(parts.drop("cluster"), "node").join(bounded_broadcast(asks.withColumn("asked", F.lit(True))), "node", "left")
        named = written(named.withColumn("asked", F.coalesce("asked", F.lit(False))), "named")
        loose = named.filter("asked")
        # Loose nodes go as queries to every block in reach, block by block.
        total = loose.groupBy("cluster", "band").agg(F.ceil(F.sum("n") / BLOCK_HASHES).alias("shares"))
        loose = loose.join(total, ["cluster", "band"]).withColumn("share", F.pmod(F.xxhash64("node", F.lit(1)), F.col("shares")))
        asking = loose.select("cluster", F.col("band").alias("from"), "share").distinct()
        blocks = named.select(*_TILE).distinct()
        tiles = written(blocks.join(asking, "cluster").filter(F.abs(F.col("band") - F.col("from")) <= 1), "tile-list")
        one = named.withColumn("asked", F.lit(False)).join(tiles, _TILE)
        two = loose.drop("slot", "shares").withColumnRenamed("band", "from").join(tiles, ["cluster", "from", "share"])
        keys = [*_TILE, "from", "share"]
        rows = one.select(*keys, "node", "component", "asked", "hashes").union(two.select(*keys, "node", "component", "asked", "hashes"))
        grouped = rows.groupBy(*keys)
        links = grouped.applyInArrow(lambda k, t: _tile_links(k, t.select(["node", "component", "asked", "hashes"]), percent), "a long, b long")
        joined = connected_components(written(links, "links")).withColumnsRenamed({"node": "of", "component": "label"})
        parts = parts.join(joined, F.col("component") == F.col("of"), "left").withColumn("component", F.coalesce("label", "component"))
    return whole.union(parts.select("node", "component"))


def _row_components(documents: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """One row per document: rid, n, c1, c2 and, of classes that may have links, class_size and of their component: least (id), best (row) and size.

    Components are described by their classes, and classes join rows last, so that a large group is never a key's rows.
    """
    docs = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    spaces = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, -(-int(spaces) // (6 * RANGE_HASHES)))
    packed = docs.mapInArrow(lambda b: _pack(b, ranges, words), PACKED)
    counts = packed.groupBy("range").applyInArrow(_shared_in_range, SHARED)
    rows = counts.groupBy("chunk").applyInArrow(lambda k, t: _add_up(k, t, percent), "rid long, n long, c1 long, c2 long, meets array<bigint>")
    rows = written(rows, "shingle-counts")

    # Equal sets meet others by the same hashes.
    may = rows.filter("meets IS NOT NULL").groupBy("n", "c1", "c2")
    classes = written(may.agg(F.min("rid").alias("rid"), F.min(_real("rid")).alias("own"), F.count("*").alias("class_size"), F.any_value("meets").alias("meets")), "classes")
    # A node is the class's smallest id; where unlike texts share that id, a hash of the set.
    several = classes.groupBy("rid").agg(F.count("*").alias("m")).filter("m > 1").select("rid", F.lit(True).alias("several"))
    own = F.when(F.col("several"), F.xxhash64("n", "c1", "c2")).otherwise(F.col("rid"))
    classes = written(classes.join(bounded_broadcast(written(several, "several")), "rid", "left").withColumn("node", own).drop("several"), "nodes")
    found = classes.select("n", "c1", "c2", "rid", "node").join(_clusters(classes), "node")
    chosen = written(_placed(found, percent), "chosen")
    sets = docs.join(bounded_broadcast(chosen.select("rid").distinct()), "rid", "left_semi").mapInArrow(
        lambda b: _set_rows(b, words), "rid long, n long, c1 long, c2 long, hashes binary"
    )
    sets = written(sets.join(bounded_broadcast(chosen), ["n", "c1", "c2", "rid"]).select(*_TILE, "node", "n", "hashes"), "sets")
    parts = _cluster_components(sets, percent)
    named = classes.drop("meets").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named, "class-components")
    first = F.struct(F.col("own").isNull().alias("none"), F.coalesce("own", F.lit(NO_ID)).alias("rid"), "n", "c1", "c2")
    best = named.groupBy("component").agg(F.min("own").alias("least"), F.min(first).alias("best"), F.sum("class_size").alias("size"))
    named = named.join(bounded_broadcast(written(best, "components")), "component").select("n", "c1", "c2", "class_size", "least", "best", "size")
    return rows.drop("meets").join(bounded_broadcast(written(named, "named-classes")), ["n", "c1", "c2"], "left")


def _real(c: str):
    return F.when(F.col(c) != NO_ID, F.col(c))


def similar_components(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` and ``class_size`` (documents with an equal set)."""
    rows = _row_components(documents, id_col, text_col, words, percent)
    # A component is named by its smallest real id.
    return rows.select(
        _real("rid").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("size").isNull(), _real("rid")).otherwise(F.col("least")).alias("component_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )


def _fresh(name: str, taken: list[str]) -> str:
    """A column name that none of ``taken`` is, in any case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _keyed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_chunks(batch, "text"):
            part = batch.slice(rows.start, rows.stop - rows.start)
            sets = shingle_sets(texts, words)
            keys = np.array([(len(s), *set_key(s)) for s in sets], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("rid"), part.column("text"), *(pa.array(k) for k in keys.T)], ["row", "rid", "text", "n", "c1", "c2"])


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, one of each component: the row with the smallest doc_id (null last), of equal ones one.

    Rows without words stay.  Rows that share a doc_id, or have none, are told
    apart by their texts: each stays unless its own text is linked.
    """
    rows = _row_components(documents, id_col, text_col, words, percent)
    own_best = (F.col("rid") == F.col("best.rid")) & (F.col("n") == F.col("best.n")) & (F.col("c1") == F.col("best.c1")) & (F.col("c2") == F.col("best.c2"))
    judged = rows.withColumn("kept", F.coalesce(own_best | (F.col("size") == 1), F.lit(True)))
    judged = written(judged.select("rid", "n", "c1", "c2", "kept"), "judged")
    name = _fresh("row_id", documents.columns)
    again = judged.groupBy(F.col("rid").alias(name)).agg(F.count("*").alias("m")).filter(f"m > 1 OR {name} = {NO_ID}").select(name)
    again = written(again, "repeated-ids")
    gone = judged.filter("NOT kept").select(F.col("rid").alias(name)).distinct()
    own = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)) == F.col(name)
    if not again.limit(1).count():
        return documents.join(gone, own, "left_anti")
    once = documents.join(gone.union(again), own, "left_anti")
    # The others, with their sets' keys.
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    others = documents.join(again, own, "left_semi").select(row, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("rid"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    keyed = others.select("*", *[F.lit(0).cast("long").alias(c) for c in ("n", "c1", "c2")])
    keyed = others.mapInArrow(lambda b: _keyed(b, words), keyed.schema)
    same = ["rid", "n", "c1", "c2"]
    keyed = keyed.join(judged.select(*same, "kept").distinct(), same).filter("kept")
    # Equal sets are one component, in which each task first finds its own smallest row; those without words are none.
    least = keyed.filter("n > 0").groupBy(*same).agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    keyed = least.select("row").unionByName(keyed.filter("n = 0").select("row"))
    return once.unionByName(keyed.select(*[F.col(f"row.`{c}`") for c in documents.columns]))


def op3_jaccard_join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and class_size of every document."""
    return similar_components(documents)
