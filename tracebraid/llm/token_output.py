"""Token ids in Arrow files of fixed-size lists.

Documents are dealt out by ranges of their ids.  Each range is written by one
task as one Arrow IPC file: record batches of two fixed-size-list columns,
``ids`` and ``mask`` (bits: true for a real id, false for padding at a file's end),
all sequences of the same length.  Nothing is compressed, so a memory map gives any
sequence without a copy.  A second small file beside it lists the documents:
``doc_id``, ``start`` within the file and ``n_tokens``.

A task writes under a name of its own and renames when it is done; a second
attempt of a lost task gives the same bytes under the same name.

Cases: a null or empty text is only its end id; repeated doc_ids stand side by
side in the order of their texts; a null doc_id stands first; a text of any
length is one document; an empty table gives no files and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window, functions as F

from .store import give_back, shared_dir, written
from .text import text_chunks

#: Ids of one sequence.
SEQUENCE = 1024
#: Sequences of one record batch.
BATCH_ROWS = 512
#: Text bytes of one output file, about; a task's first Arrow batch, which both sides hold whole, is often most of them.
FILE_BYTES = 8 << 20
#: The id that ends each document.
END_ID = 0
#: Text bytes that are encoded together; arrays of places beside them take several times as much.
RUN_BYTES = 1 << 20
#: Bytes of new pieces that the tokenizer is given at a time, for what it holds of each is many times as large.
JOINED_BYTES = 64 << 10
#: Pieces whose ids are gathered at a time.
GATHERED = 64 << 10
#: Pieces whose ids a worker remembers; when it has so many, further ones are encoded anew in every run.
REMEMBERED = 100_000

#: Kinds of bytes: the space, the line end, other white space (and what some take for it), ASCII letters, other ASCII.
SPACE, LINE, BLANK, LETTER, SIGN, FAR = range(1, 7)
_KINDS = bytes(
    SPACE if b == 0x20 else LINE if b == 0x0A else BLANK if 0x09 <= b <= 0x0D or 0x1C <= b <= 0x1F
    else LETTER if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else FAR if b >= 0x80 else SIGN
    for b in range(256)
)
#: White space and invisible signs beyond ASCII, in UTF-8 (Unicode's, and some more).
_FAR_BLANK = re.compile(b"\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8f\xa8-\xaf]|\x81[\x9f\xa0])|\xe3\x80\x80|\xef\xbb\xbf")
#: First bytes of these, by which they are looked for.
_FAR_BLANK_FIRST = bytes(b in b"\xc2\xe1\xe2\xe3\xef" for b in range(256))
#: A piece that may follow others of its kind in one text, and one that may stand between line ends.
_SPACED, _BARE = re.compile(r" \S+").fullmatch, re.compile(r"\S+").fullmatch


def cut_pieces(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts in a row, and where each text's begin (one more than texts).

    A text is cut where a byte-level pre-tokenizer always begins a new word:
    before a single space and around a single line end between visible
    characters, and between a Latin letter and an ASCII sign or digit.
    """
    data = b"".join(texts)
    bounds = np.cumsum([0, *map(len, texts)])
    a, kind = np.frombuffer(data, np.uint8), np.frombuffer(bytearray(data.translate(_KINDS)), np.uint8)
    for i in np.flatnonzero(np.frombuffer(data.translate(_FAR_BLANK_FIRST), bool)).tolist():
        if m := _FAR_BLANK.match(data, i):
            kind[i : m.end()] = BLANK
    # Second bytes of U+00C0 to U+017F but the two signs among them.
    first = (a[:-1] - np.uint8(0xC3)) < 3
    latin = np.flatnonzero(first) + 1
    kind[latin[(a[latin - 1] != 0xC3) | ((a[latin] != 0x97) & (a[latin] != 0xB7))]] = LETTER
    visible = np.concatenate(([False], kind > BLANK, [False]))
    lone = visible[:-2] & visible[2:] & (kind <= LINE)
    cut = lone.copy()
    cut[1:] |= (lone[:-1] & (kind[:-1] == LINE)) | ((kind[:-1] == LETTER) & (kind[1:] == SIGN))
    cut[bounds[:-1][bounds[:-1] < len(a)]] = True
    begins = np.append(np.flatnonzero(cut), len(a)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(data)])
    return pieces, np.searchsorted(begins, bounds)


def _listed(values: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].tolist()
    whole = data.to_pybytes() if data else b""
    return [whole[i:j] for i, j in zip(at, at[1:], strict=False)]


def _runs(places: np.ndarray, pieces: list[bytes]) -> list[np.ndarray]:
    """The places cut into runs of about ``JOINED_BYTES`` of their pieces; none without a place."""
    upto = np.cumsum([len(pieces[i]) for i in places.tolist()], dtype=np.int64)
    return np.split(places, np.flatnonzero(np.diff(upto // JOINED_BYTES)) + 1) if len(places) else []


class PieceEncoder:
    """Encodes texts with a tokenizers file; distinct pieces of texts are encoded once and remembered.

    The ids of a text's pieces, joined, are the text's ids.  The pieces of many
    texts are one Arrow array; each distinct one is looked up or encoded, and the
    ids of all are gathered by their places in one table.  New pieces are encoded
    many at a time as one text, whose ids are told apart by their lengths in
    bytes.  A text that holds an added token's content is encoded as a whole.
    With ``spell_special`` special tokens in texts are spelled out as ordinary
    ids; else they are their one id, as by default.
    """

    def __init__(self, path: str, end_id: int = END_ID, spell_special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spell_special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and not (spell_special and t.special)]
        # Normalised tokens match texts as the normaliser leaves them, here in any case.
        self.added = re.compile("|".join(map(re.escape, added)).encode(), re.IGNORECASE).search if added else lambda text: None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        # In the byte-level alphabet every character stands for one byte.
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)
        self.end_id = end_id
        # The n-th piece's ids are flat[at[n]:at[n + 1]].
        self.known: dict[bytes, int] = {}
        self.flat, self.at = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def encode_run(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with the end id after it, and where each text's begin (one more than texts)."""
        whole = {i: self._ids([t])[0] for i, t in enumerate(texts) if self.added(t)}
        pieces, first = cut_pieces([b"" if i in whole else t for i, t in enumerate(texts)])
        coded = pieces.dictionary_encode()
        distinct = _listed(coded.dictionary)
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        flat, at = self.flat, self.at
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = [distinct[i] for i in new]
            ids, sizes = self._encode_new(fresh)
            number[new] = len(at) - 1 + np.arange(len(new))
            flat, at = np.concatenate((flat, ids)), np.concatenate((at, at[-1] + np.cumsum(sizes)))
            if len(self.known) + len(new) <= REMEMBERED:
                self.known.update(zip(fresh, number[new].tolist(), strict=True))
                self.flat, self.at = flat, at
        number = number[coded.indices.to_numpy()]
        sizes = (at[1:] - at[:-1])[number]
        ends = np.cumsum(sizes)
        got = np.empty(ends[-1] if len(ends) else 0, self.kind)
        for i in range(0, len(number), GATHERED):
            part = slice(i, i + GATHERED)
            low, high = ends[i] - sizes[i], ends[part][-1]
            got[low:high] = flat[np.arange(low, high) + np.repeat(at[number[part]] - ends[part] + sizes[part], sizes[part])]
        begins = np.concatenate(([0], ends))[first]
        # The end ids, and the texts that were encoded as a whole.
        parts = [x for i in sorted(whole) for x in (begins[i], whole[i])]
        if whole:
            cuts = np.split(got, parts[0::2])
            got = np.concatenate([x for pair in zip(cuts, [*parts[1::2], cuts[-1][:0]], strict=True) for x in pair]).astype(self.kind)
            begins = begins + np.concatenate(([0], np.cumsum([len(whole.get(i, ())) for i in range(len(texts))])))
        return np.insert(got, begins[1:], self.end_id), begins + np.arange(len(texts) + 1)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids with the end id, as bytes of ``kind``."""
        ids, first = self.encode_run([(t or "").encode() for t in texts])
        return [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        got = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.kind) for e in got]

    def _encode_new(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces in a row, and how many each has."""
        text = [p.decode("utf-8", "replace") for p in new]
        sizes = np.zeros(len(new), np.int64)
        kinds = np.array([0 if _SPACED(t) else 1 if _BARE(t) else 2 for t in text])
        parts, order = [], []
        for kind, mark in ((0, ""), (1, "\n")):
            for own in _runs(np.flatnonzero(kinds == kind), new):
                joined = "".join([text[i] + mark for i in own.tolist()])
                [ids] = self._ids([joined.encode()])
                ends = np.cumsum([len(text[i].encode()) + len(mark) for i in own.tolist()], dtype=np.int64)
                cuts = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1
                if mark and len(own):
                    ids, cuts = np.delete(ids, cuts - 1), cuts - np.arange(1, len(own) + 1)
                sizes[own] = np.diff(cuts, prepend=0)
                parts.append(ids)
                order.append(own)
        for own in _runs(np.flatnonzero(kinds == 2), new):
            alone = self._ids([new[i] for i in own.tolist()])
            sizes[own] = [len(x) for x in alone]
            parts += alone
            order.append(own)
        order = np.concatenate([np.zeros(0, np.int64), *order])
        # From the order of kinds to that of ``new``.
        by_kind = sizes[order]
        start = np.empty(len(new), np.int64)
        start[order] = np.cumsum(by_kind) - by_kind
        flat = np.concatenate([np.zeros(0, self.kind), *parts]).astype(self.kind)
        return flat[np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))], sizes


_encoders: dict[tuple[str, int, bool], PieceEncoder] = {}


def encoder_for(path: str, end_id: int, spell_special: bool) -> PieceEncoder:
    """One encoder per worker, file and mode, with what it remembers."""
    key = path, end_id, spell_special
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _SequenceWriter:
    """Cuts a stream of ids into equal sequences and writes them batch by batch."""

    def __init__(self, sink, kind, sequence: int):
        self.kind, self.sequence, self.rest, self.total = np.dtype(kind), sequence, bytearray(), 0
        self.ids = pa.list_(pa.from_numpy_dtype(self.kind), sequence)
        self.mask = pa.list_(pa.bool_(), sequence)
        self.writer = pa.ipc.new_file(sink, pa.schema([("ids", self.ids), ("mask", self.mask)]))
        self.ones = np.ones(BATCH_ROWS * sequence, bool)

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        self.rest += ids.tobytes()
        block = BATCH_ROWS * self.sequence * self.kind.itemsize
        while len(self.rest) >= block:
            self._write(bytes(self.rest[:block]), self.ones)
            del self.rest[:block]

    def _write(self, ids: bytes, mask: np.ndarray) -> None:
        flat = pa.Array.from_buffers(self.ids.value_type, len(ids) // self.kind.itemsize, [None, pa.py_buffer(ids)])
        self.writer.write_batch(
            pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(flat, self.sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)],
                schema=pa.schema([("ids", self.ids), ("mask", self.mask)]),
            )
        )

    def close(self) -> None:
        if self.rest:
            n = len(self.rest) // self.kind.itemsize
            rows = -(-n // self.sequence)
            mask = np.zeros(rows * self.sequence, bool)
            mask[:n] = True
            self._write(bytes(self.rest) + bytes((rows * self.sequence - n) * self.kind.itemsize), mask)
        self.writer.close()


def _write_file(batches: Iterator[pa.RecordBatch], base: str, tokenizer: str, sequence: int, end_id: int, spell_special: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    give_back()
    name = f"part-{TaskContext.get().partitionId():06d}"
    fs, folder = _files(base)
    encoder, writer, temporary = None, None, f"{folder}/.{name}-{uuid.uuid4().hex}"
    ids, starts, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        for rows, texts in text_chunks(batch, "text", RUN_BYTES):
            if writer is None:
                fs.create_dir(folder, recursive=True)
                encoder = encoder_for(tokenizer, end_id, spell_special)
                sink = fs.open_output_stream(temporary)
                writer = _SequenceWriter(sink, encoder.kind, sequence)
            run, first = encoder.encode_run(texts)
            ids += docs[rows]
            starts.append(writer.total + first[:-1])
            counts.append(np.diff(first))
            writer.add(run)
    if writer is None:
        return
    writer.close()
    sink.close()
    index = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": np.concatenate(starts), "n_tokens": np.concatenate(counts)})
    with fs.open_output_stream(temporary + "-docs") as out, pa.ipc.new_file(out, index.schema) as w:
        w.write_table(index)
    fs.move(temporary + "-docs", f"{folder}/{name}-docs.arrow")
    fs.move(temporary, f"{folder}/{name}.arrow")
    yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(ids)], "n_tokens": [writer.total], "id_bytes": [writer.kind.itemsize]})


def write_tokens(
    documents: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
    base: str | None = None,
    spell_special: bool = True,
) -> DataFrame:
    """Write the documents' ids in ascending order of ``id_col``; one row per file comes back.

    The rows: ``base``, ``file``, ``n_docs``, ``n_tokens``, ``id_bytes`` and
    ``first`` (ids in all files before).  Their number is that of the files.
    ``spell_special``: special tokens in texts are spelled out, not one id.
    """
    spark = documents.sparkSession
    base = base or shared_dir(spark, "tokens")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ordered = docs.repartitionByRange(max(spark.sparkContext.defaultParallelism, -(-int(size) // FILE_BYTES)), "doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(
        lambda batches: _write_file(batches, base, tokenizer, sequence, end_id, spell_special), "file string, n_docs long, n_tokens long, id_bytes long"
    )
    files = written(files, "token-files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("base", F.lit(base))


def _read_files(batches: Iterator[pa.RecordBatch], task) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, folder = _files(row["base"])
            path = f"{folder}/{row['file']}"
            with fs.open_input_file(path + "-docs.arrow") as f:
                index = pa.ipc.open_file(f).read_all()
            source = pa.memory_map(path + ".arrow") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path + ".arrow")
            with source:
                reader = pa.ipc.open_file(source)
                parts = [reader.get_batch(i).column("ids").flatten().to_numpy(zero_copy_only=True) for i in range(reader.num_record_batches)]
                yield from task(index, _Stream(parts), row)
                del parts, reader


class _Stream:
    """The ids of a file, by position, across its record batches."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts, self.at = parts, np.cumsum([0, *map(len, parts)])

    def slices(self, start: int, n: int) -> Iterator[np.ndarray]:
        k = int(np.searchsorted(self.at, start, "right")) - 1
        while n > 0:
            i = start - int(self.at[k])
            got = self.parts[k][i : i + n]
            yield got
            start, n, k = start + len(got), n - len(got), k + 1


def _checksums(index: pa.Table, ids: _Stream, row: dict) -> Iterator[pa.RecordBatch]:
    starts, counts = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
    sums = np.empty(len(starts), np.int64)
    for i, (s, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
        crc = 0
        for part in ids.slices(s, n):
            crc = zlib.crc32(part.astype("<u4"), crc)
        sums[i] = crc
    for table in pa.table({"doc_id": index.column("doc_id"), "start": pa.array(starts + row["first"]), "n_tokens": index.column("n_tokens"), "ids_crc32": pa.array(sums)}).to_batches():
        yield table


def read_checksums(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and a checksum of its ids."""
    return _spread(files).mapInArrow(lambda b: _read_files(b, _checksums), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start and its ids as an array."""

    def arrays(index: pa.Table, ids: _Stream, row: dict) -> Iterator[pa.RecordBatch]:
        for doc in index.to_pylist():
            got = np.concatenate([np.zeros(0, np.int64), *ids.slices(doc["start"], doc["n_tokens"])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([doc["doc_id"]], pa.int64()), pa.array([doc["start"] + row["first"]]), pa.array([got])], ["doc_id", "start", "ids"])

    return _spread(files).mapInArrow(lambda b: _read_files(b, arrays), "doc_id long, start long, ids array<long>")


def read_sequence(base: str, file: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """One sequence and its mask, by random access."""
    fs, folder = _files(base)
    source = pa.memory_map(f"{folder}/{file}.arrow") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(f"{folder}/{file}.arrow")
    batch = pa.ipc.open_file(source).get_batch(number // BATCH_ROWS)
    ids, mask = (batch.column(c)[number % BATCH_ROWS].values for c in ("ids", "mask"))
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def _spread(files: DataFrame) -> DataFrame:
    """One task per file, or nearly."""
    n = files.count()
    return files.repartition(max(1, min(n, 100_000)), F.xxhash64("file")) if n > 1 else files


def op9_token_output(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Encode as the tokenizer does by default, write and read back every document: doc_id, start, n_tokens, ids_crc32."""
    return read_checksums(write_tokens(documents, tokenizer, spell_special=False))

