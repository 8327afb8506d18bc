"""WARC archives as a PySpark Python data source, and a writer that stores equal payloads once.

``spark.read.format("warc").load(folder)`` gives one row per record.  Every file
is one partition or, where it is large, several byte ranges of whole members
given by the writer's index; a second file tells where each record begins.
Equality filters on ``record_type`` and on the header columns are taken over by
the reader: a record's first bytes are inflated for its headers, and when these
fail the filters, or when the payload is not asked for, the reader goes on at the
next record's place.  The rest of the block is neither read nor decoded.

Cases: a null html is an empty payload; a null url is an empty target; equal
payloads of any number share one response record; a null page_id is kept as it
is and never a response for others; an empty table gives an empty archive and
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .store import BROADCAST_ROWS, shared_dir, written

#: Payloads from this many bytes on are stored once.
SHARED_FROM = 1000
#: Bytes of one partition of a scan.
SPLIT_BYTES = 64 << 20
#: Bytes read at once: for a record's headers, and where all payloads are wanted.
HEAD_BYTES, READ_BYTES = 4 << 10, 1 << 20
#: Every record: fixed values of the format.
VERSION, HTTP_HEAD = "WARC/1.1", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, "
    "page_id long, content_length long, payload_bytes long, payload binary"
)
#: Columns that the headers alone give, by header.
HEADER_COLUMNS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    number = (record or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def encode_record(row: dict) -> bytes:
    """One record as a gzip member of its own."""
    body = HTTP_HEAD + (row["payload"] or b"") if row["record_type"] == "response" else HTTP_HEAD
    head = [
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {record_id(row['page_id'])}",
        f"WARC-Target-URI: {''.join((row['target_uri'] or '').splitlines())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if row["refers_to"] is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(row['refers_to'])}"]
    data = "\r\n".join([VERSION, *head, "", ""]).encode() + body + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: An archive's files; the index, which makes it visible, comes last.
FILES = ("records", "warc.gz", "index")


@dataclass
class Written(WriterCommitMessage):
    parts: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes one archive under a temporary name; the commit gives the final names."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        name, out, fs = f"{uuid.uuid4().hex}", None, None
        places, cuts, at = array("q"), [], 0
        for row in (r for batch in iterator for i in range(0, batch.num_rows, 256) for r in batch.slice(i, 256).to_pylist()):
            if out is None:
                fs, folder = pafs.FileSystem.from_uri(self.path)
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(f"{folder}/.{name}.warc.gz", compression=None)
            data = encode_record(row)
            if not cuts or at - cuts[-1][1] >= SPLIT_BYTES:
                cuts.append((len(places), at))
            places.append(at)
            out.write(data)
            at += len(data)
        if out is None:
            return Written([])
        out.close()
        cuts.append((len(places), at))
        places.append(at)
        with fs.open_output_stream(f"{folder}/.{name}.records", compression=None) as f:
            f.write(np.array(places, "<i8").tobytes())
        with fs.open_output_stream(f"{folder}/.{name}.index") as f:
            f.write(" ".join(str(first) for first, _ in cuts).encode())
        return Written([(folder, name)])

    def commit(self, messages: list[Written | None]) -> None:
        for folder, name in [p for m in messages if m for p in m.parts]:
            fs, _ = pafs.FileSystem.from_uri(self.path)
            for kind in FILES:
                fs.move(f"{folder}/.{name}.{kind}", f"{folder}/{name}.{kind}")

    def abort(self, messages: list[Written | None]) -> None:
        for folder, name in [p for m in messages if m for p in m.parts]:
            fs, _ = pafs.FileSystem.from_uri(self.path)
            for kind in FILES:
                fs.delete_file(f"{folder}/.{name}.{kind}")


@dataclass
class RecordRange(InputPartition):
    """The records ``begin`` to ``end`` (exclusive) of an archive."""

    path: str
    begin: int
    end: int


class WarcReader(DataSourceReader):
    """Plans byte ranges, takes over header filters, reads records."""

    def __init__(self, path: str, schema: StructType, verify: bool):
        self.path, self.columns, self.verify, self.wanted = path, schema.fieldNames(), verify, []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("record_type", "target_uri", "payload_digest"):
                self.wanted.append((column, set(f.value) if isinstance(f, In) else {f.value}))
            else:
                yield f

    def partitions(self) -> list[RecordRange]:
        fs, folder = pafs.FileSystem.from_uri(self.path)
        found = [x.path for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))]
        parts = []
        for path in sorted(x for x in found if x.endswith(".index") and not x.rsplit("/", 1)[1].startswith(".")):
            with fs.open_input_stream(path) as f:
                cuts = [int(x) for x in f.read().split()]
            parts += [RecordRange(path.removesuffix("index"), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return parts or [RecordRange("", 0, 0)]

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path + "records") as f:
            places = np.frombuffer(f.read_at(8 * (partition.end - partition.begin + 1), 8 * partition.begin), "<i8")
        rows, size = [], 0
        with fs.open_input_file(partition.path + "warc.gz") as f:
            for row in read_records(f, places.tolist(), self.wanted, "payload" in self.columns or self.verify):
                rows.append([row[c] for c in self.columns])
                size += len(row["payload"] or b"") * ("payload" in self.columns)
                if len(rows) == 2000 or size > 4 << 20:
                    yield from self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield from self._batch(rows)

    def _batch(self, rows: list[list]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "content_length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(x, kinds.get(c, pa.string())) for c, x in zip(self.columns, zip(*rows, strict=True), strict=True)], self.columns)


class _Window:
    """Bytes of a file by place; what was read last is kept."""

    def __init__(self, f):
        self.f, self.at, self.data = f, 0, b""

    def get(self, at: int, n: int, ahead: int) -> bytes:
        """The ``n`` bytes at a place; when they are not there yet, at least ``ahead`` are read."""
        if not self.at <= at <= at + n <= self.at + len(self.data):
            self.at, self.data = at, self.f.read_at(max(n, ahead), at)
        return self.data[at - self.at : at - self.at + n]


def read_records(f, places: list[int], wanted: list[tuple[str, set]] = (), payload: bool = True) -> Iterator[dict]:
    """The records that begin at ``places`` (the last place ends the last record); of unwanted ones only the heads are inflated."""
    window, ahead = _Window(f), READ_BYTES if payload and not wanted else HEAD_BYTES
    for begin, end in zip(places, places[1:], strict=False):
        z, data, at, row = zlib.decompressobj(31), b"", begin, None
        while row is None:
            if at == end or z.eof:
                raise ValueError("a WARC record has no head")
            part = window.get(at, min(HEAD_BYTES, end - at), ahead)
            if not part:
                raise ValueError("a WARC record is cut short")
            at += len(part)
            data += z.decompress(part, HEAD_BYTES)
            while (cut := data.find(b"\r\n\r\n")) < 0 and z.unconsumed_tail:
                data += z.decompress(z.unconsumed_tail, HEAD_BYTES)
            if cut >= 0:
                row = parse_head(data[:cut])
        if not all(row[c] in values for c, values in wanted):
            continue
        if payload and row["record_type"] == "response":
            data += z.decompress(z.unconsumed_tail + window.get(at, end - at, 0))
            if not z.eof:
                raise ValueError("a WARC record is cut short")
            body = data[cut + 4 :][: row["content_length"]]
            row["payload"] = body[body.index(b"\r\n\r\n") + 4 :]
            if hashlib.sha1(row["payload"]).hexdigest() != row["payload_digest"] or len(row["payload"]) != row["payload_bytes"]:
                raise ValueError(f"the payload of {row['record_id']} is damaged")
        yield row


def parse_head(head: bytes) -> dict:
    """A record's header columns."""
    version, *lines = head.decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"not a record of {VERSION}: {version[:40]}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    row: dict = {c: fields.get(h) for c, h in HEADER_COLUMNS.items()}
    row["payload_digest"] = base64.b32decode((row["payload_digest"] or "").removeprefix("sha1:")).hex()
    row["page_id"], row["payload"] = page_of(row["record_id"]), None
    row["content_length"], row["payload_bytes"] = int(fields["Content-Length"]), int(fields["X-Payload-Length"])
    return row


class WarcDataSource(DataSource):
    """``format("warc")``: option ``path``, a URI that pyarrow's file systems know.

    A schema given to the reader chooses the columns; without ``payload`` no
    block is decoded, unless the option ``verify`` asks to hold every payload
    against its digest.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, self.options.get("verify", "false").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def plan_records(pages: DataFrame, shared_from: int = SHARED_FROM) -> DataFrame:
    """Pages as records: of equal payloads, the one with the largest page_id is the response.

    Digests and ids alone are grouped.  The repeated digests are broadcast, so
    no payload moves, whatever the number of copies of one page.  Only if there are
    more than ``BROADCAST_ROWS`` of them, pages meet the ids of the revisits in a join
    by page_id, whose groups are single pages.
    """
    text = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("target_uri"), text.alias("payload"))
    p = p.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    large = p.filter(F.col("payload_bytes") >= shared_from).select("page_id", F.col("payload_digest").alias("digest"))
    first = large.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    first = first.filter("n > 1 AND largest IS NOT NULL").select("digest", "largest")
    first = written(first, "repeated-payloads")
    if first.count() <= BROADCAST_ROWS:
        joined = p.join(F.broadcast(first), (p.payload_digest == first.digest) & (p.payload_bytes >= shared_from), "left")
    else:
        # Pages of one digest are many, but few bytes without their payloads.
        revisits = large.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("largest"))).distinct()
        revisits = revisits.withColumnRenamed("page_id", "again_id")
        joined = p.join(revisits, p.page_id.eqNullSafe(revisits.again_id) & (p.payload_digest == revisits.digest), "left")
    again = F.col("largest").isNotNull() & ~F.col("largest").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        "payload_digest",
        F.when(again, F.col("largest")).alias("refers_to"),
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the pages' records as archives in the folder ``path``."""
    register(pages.sparkSession)
    plan_records(pages).write.format("warc").mode("append").option("path", path).save()


def op10_warc(pages: DataFrame) -> DataFrame:
    """Write all pages as WARC records and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path)
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to string"
    back = lambda verify: spark.read.format("warc").schema(columns).option("verify", verify).load(path)
    # Every stored payload is held against its digest; of revisits the heads tell all.
    back = back("true").filter("record_type = 'response'").unionByName(back("false").filter("record_type = 'revisit'"))
    to = F.expr("try_cast(nullif(regexp_extract(refers_to, 'page:(-?[0-9]+)', 1), '') AS BIGINT)")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", to.alias("refers_to"))
