"""A data source over case folders that opens no file of a case it does not want.

``read_folders`` is what callers use.  Cases are chosen by the manifest's rows
and the label files alone, on the driver, before any telemetry is touched; of
those, files are planned by name and size.  A footer is opened by the task that
reads its rows.

Where an attribute may stand in one of several columns, each file is read from
the first that it has, and the rows carry it under the first name of the list:
a case that names its pods otherwise than its neighbours keeps them.  ``ts_s``
are epoch seconds of ``time``; nanoseconds need no session setting.

Cases: a missing frame of a case, and a file without a column, are rows less and
nulls; a value that is no number where one is wanted is null; a manifest row
without a folder is left out, one that is listed twice is read once; a damaged
file of a wanted case is an error that names it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schemas import DB_SYSTEM_COLUMNS, DB_TARGET_COLUMNS, MSG_SYSTEM_COLUMNS, MSG_TARGET_COLUMNS, NODE_COLUMNS, POD_COLUMNS
from .telemetry import Telemetry

#: A file above this size is read by several tasks, each taking the row groups that begin in its share.
SPLIT_BYTES = 128 << 20
BATCH_ROWS = 8192
WINDOWS = ("normal", "abnormal")
#: What a column may be called in a file; the others have one name.
ALTERNATIVES = {names[0]: names for names in (POD_COLUMNS, NODE_COLUMNS, DB_SYSTEM_COLUMNS, DB_TARGET_COLUMNS, MSG_SYSTEM_COLUMNS, MSG_TARGET_COLUMNS)}
_PLACE = [POD_COLUMNS[0], NODE_COLUMNS[0]]
_TEXTS = {
    "traces": ["trace_id", "span_id", "parent_span_id", "service_name", *ALTERNATIVES, "attr.status_code"],
    "metrics": ["service_name", *_PLACE, "metric"],
    "logs": ["service_name", *_PLACE, "level"],
}
_NUMBERS = {"traces": ["duration", "attr.http.response.status_code"], "metrics": ["value"], "logs": []}
FRAMES = {
    kind: ", ".join(["case_id string", "win string", *(f"`{c}` string" for c in _TEXTS[kind]), *(f"`{c}` double" for c in _NUMBERS[kind]), "ts_s double"])
    for kind in _TEXTS
}
_ARROW = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}
_PER_SECOND = {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}


@dataclass
class FileShare(InputPartition):
    """The row groups of a case's file that begin between two bytes."""

    case_id: str
    win: str
    path: str
    begin: int
    end: int


def chosen_names(fs: pafs.FileSystem, base: str, options: dict[str, str]) -> list[str]:
    """Names of the wanted cases: rows ``start`` to ``end`` of the ``manifest``, else all folders; of these the attributed ones if so asked."""
    if manifest := options.get("manifest"):
        start, end = max(0, int(options.get("start", 0))), int(options.get("end", -1))
        mfs, path = pafs.FileSystem.from_uri(manifest)
        with mfs.open_input_stream(path) as f:
            rows = [json.loads(line) for line in f.read().decode().splitlines() if line.strip()]
        stop = len(rows) if end < 0 else min(len(rows), end)
        if stop < start:
            raise ValueError(f"the slice ends at {stop}, before its start {start}")
        names = list(dict.fromkeys(str(r["name"]) for r in rows[start:stop]))
    else:
        names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(base)) if x.type == pafs.FileType.Directory)
    if options.get("attributed", "false").lower() != "true":
        return names

    def says_so(name: str) -> bool:
        try:
            with fs.open_input_stream(f"{base}/{name}/label.txt") as f:
                return f.read().decode().strip().lower() == "attributed"
        except FileNotFoundError:
            return False

    with ThreadPoolExecutor(16) as pool:
        return [n for n, keep in zip(names, pool.map(says_so, names), strict=True) if keep]


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.uri, self.kind = options, options["path"], options["kind"]
        self.types = {f.name: _ARROW[f.dataType.simpleString()] for f in schema.fields}

    def partitions(self) -> list[FileShare]:
        fs, base = pafs.FileSystem.from_uri(self.uri)
        at = [(n, w, f"{base}/{n}/{w}_{self.kind}.parquet") for n in chosen_names(fs, base, self.options) for w in WINDOWS]
        step, shares = int(self.options.get("split_bytes", SPLIT_BYTES)), []
        for (name, win, path), info in zip(at, fs.get_file_info([p for *_, p in at]), strict=True):
            if info.type == pafs.FileType.File:
                shares += [FileShare(name, win, path, b, min(info.size, b + step)) for b in range(0, info.size, step)]
        return shares or [FileShare("", "", "", 0, 0)]

    def read(self, share: FileShare) -> Iterator[pa.RecordBatch]:
        if not share.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        with fs.open_input_file(share.path) as f:
            try:
                file = pq.ParquetFile(f)
            except pa.ArrowInvalid as e:
                raise ValueError(f"{share.path} is no Parquet file") from e
            have = set(file.schema_arrow.names)
            stands = {c: next((n for n in ALTERNATIVES.get(c, (c,)) if n in have), None) for c in self.types}
            stands["ts_s"] = "time" if "time" in have else None
            groups = [i for i in range(file.num_row_groups) if share.begin <= _first_byte(file.metadata.row_group(i)) < share.end]
            wanted = sorted({n for n in stands.values() if n})
            for batch in file.iter_batches(BATCH_ROWS, row_groups=groups, columns=wanted) if groups else ():
                yield self._row_batch(batch, share, stands)

    def _row_batch(self, batch: pa.RecordBatch, share: FileShare, stands: dict[str, str | None]) -> pa.RecordBatch:
        fixed, columns = {"case_id": share.case_id, "win": share.win}, []
        for name, kind in self.types.items():
            if name in fixed:
                columns.append(pa.repeat(pa.scalar(fixed[name], kind), batch.num_rows))
            elif stands[name] is None:
                columns.append(pa.nulls(batch.num_rows, kind))
            else:
                column = batch.column(stands[name])
                columns.append(epoch_seconds(column) if name == "ts_s" else converted(column, kind))
        return pa.RecordBatch.from_arrays(columns, list(self.types))


def _first_byte(group: pq.RowGroupMetaData) -> int:
    """Where a row group's data begin: its first column chunk, at the dictionary if it has one."""
    if group.num_columns == 0:
        return 0
    chunk = group.column(0)
    return min(x for x in (chunk.dictionary_page_offset, chunk.data_page_offset) if x is not None)


def epoch_seconds(x: pa.Array) -> pa.Array:
    """Timestamps of any unit in seconds; numbers are nanoseconds; anything else is null."""
    if pa.types.is_date(x.type):
        x = pc.cast(x, pa.timestamp("s"))
    if pa.types.is_timestamp(x.type):
        return pc.divide(pc.cast(pc.cast(x, pa.int64()), pa.float64(), safe=False), float(_PER_SECOND[x.type.unit]))
    return pc.divide(converted(x, pa.float64()), 1e9)


def converted(x: pa.Array, kind: pa.DataType) -> pa.Array:
    """The column as another type; a value that has no such form is null."""
    if pa.types.is_dictionary(x.type):
        x = x.dictionary_decode()
    try:
        return pc.cast(x, kind, safe=False)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return pa.array([_one(v, kind) for v in x.to_pylist()], kind)


def _one(v, kind: pa.DataType):
    if v is None or kind == pa.string():
        return None if v is None else str(v)
    try:
        return float(v) if kind == pa.float64() else int(v) if kind == pa.int64() else bool(v)
    except (TypeError, ValueError):
        return None


class FolderDataSource(DataSource):
    """``format("case_folders")``: options ``path``, ``kind`` and those of ``chosen_names``; a schema given to the reader chooses columns."""

    @classmethod
    def name(cls) -> str:
        return "case_folders"

    def schema(self) -> str:
        return FRAMES[self.options["kind"]]

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(dict(self.options), schema)


def read_folders(spark: SparkSession, base: str, *, attributed: bool = True, manifest: str | None = None, start: int = 0, end: int | None = None, split_bytes: int = SPLIT_BYTES) -> Telemetry:
    """Telemetry of the wanted case folders below the URI ``base``."""
    spark.dataSource.register(FolderDataSource)
    options = {"path": base.rstrip("/"), "attributed": str(attributed).lower(), "split_bytes": str(split_bytes)}
    if manifest:
        options |= {"manifest": manifest, "start": str(start)} | ({} if end is None else {"end": str(max(0, end))})
    frame = lambda kind: spark.read.format("case_folders").options(**options, kind=kind).load()
    fs, folder = pafs.FileSystem.from_uri(options["path"])
    names = chosen_names(fs, folder, options)
    have = [i.path for i in fs.get_file_info([f"{folder}/{n}/env.json" for n in names]) if i.type == pafs.FileType.File]
    uris = [f"{options['path']}/{p[len(folder) + 1 :]}" for p in have]
    if not uris:
        return Telemetry(frame("traces"), frame("metrics"), frame("logs"), spark.createDataFrame([], "case_id string, start_s double"))
    env = spark.read.schema("ABNORMAL_START double").option("multiLine", True).json(uris)
    starts = env.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("case_id"), F.col("ABNORMAL_START").alias("start_s"))
    return Telemetry(frame("traces"), frame("metrics"), frame("logs"), starts)


def read_frame(spark: SparkSession, base: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    """One frame of case folders, with the columns of ``schema`` alone where it is given."""
    spark.dataSource.register(FolderDataSource)
    reader = spark.read.format("case_folders").options(path=base.rstrip("/"), kind=kind, **options)
    return (reader.schema(schema) if schema else reader).load()
