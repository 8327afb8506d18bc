"""Words of many texts at once: byte tables and 64-bit word hashes in numpy.

Texts are UTF-8 bytes.  A batch of texts is hashed as one byte array, so the
cost is a few array passes whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words are runs of anything but space and U+0009..U+000D.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: A-Z lower-cased, every ASCII byte that is no letter or digit a space.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Bytes of text that are hashed together.
CHUNK_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1]


class Words:
    """The words of a list of texts.

    ``hashes`` has one number per word, in order; text ``i`` owns
    ``hashes[first[i]:first[i + 1]]``; word ``k`` is
    ``data[starts[k]:ends[k]]``.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        a = np.frombuffer(self.data, np.uint8)
        parts, begin = [], 0
        while begin < len(a):
            end = _segment_end(a, begin)
            parts.append(_hash_segment(a[begin:end], begin))
            begin = end
        self.starts, self.ends, self.hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, offsets)


def _segment_end(a: np.ndarray, begin: int) -> int:
    """A place after white space, about CHUNK_BYTES on; later only if a word is longer than that."""
    end = begin + 2 * CHUNK_BYTES
    if end >= len(a):
        return len(a)
    spaces = np.flatnonzero(_IS_SPACE[a[begin:end]])
    while not len(spaces) and end < len(a):
        at, end = end, end + CHUNK_BYTES
        spaces = np.flatnonzero(_IS_SPACE[a[at:end]]) + (at - begin)
    return begin + int(spaces[-1]) + 1 if len(spaces) else len(a)


def _hash_segment(a: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.diff(_IS_SPACE[a].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    power, inverse = _powers_to(len(a))
    total = np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return starts + offset, ends + offset, mix((total[ends - 1] - before) * inverse[starts])


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[slice, list[bytes]]]:
    """Rows of a batch in runs of about ``limit`` bytes; a longer text is a run of its own.

    The column is binary; null counts as empty.
    """
    texts = batch.column(column)
    # Python's copies of the texts are made run by run.
    taken = lambda begin, end: (slice(begin, end), [t or b"" for t in texts.slice(begin, end - begin).to_pylist()])
    begin = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > begin and size + n > limit:
            yield taken(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield taken(begin, len(texts))
