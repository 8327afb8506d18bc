import numpy as np
from hypothesis import given, settings, strategies as st

from tracebraid.llm import text
from tracebraid.llm.text import SPACES, Words, text_chunks


def plain_words(t: bytes) -> list[bytes]:
    out, word = [], bytearray()
    for b in t:
        if b in SPACES:
            if word:
                out.append(bytes(word))
            word = bytearray()
        else:
            word.append(b)
    return out + ([bytes(word)] if word else [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\t\n\x0b日", max_size=30), min_size=1, max_size=6), st.integers(4, 50))
def test_words_of_texts_and_segments(texts, segment):
    data = [t.encode() for t in texts]
    whole = Words(data)
    kept, text.CHUNK_BYTES = text.CHUNK_BYTES, segment
    try:
        cut = Words(data)
    finally:
        text.CHUNK_BYTES = kept
    assert (whole.hashes == cut.hashes).all() and (whole.starts == cut.starts).all() and (whole.ends == cut.ends).all()
    for i, t in enumerate(data):
        found = [whole.data[a:b] for a, b in zip(whole.starts[whole.first[i] : whole.first[i + 1]], whole.ends[whole.first[i] : whole.first[i + 1]], strict=True)]
        assert found == plain_words(t)
    by = {}
    for a, b, h in zip(whole.starts, whole.ends, whole.hashes, strict=True):
        assert by.setdefault(whole.data[a:b], h) == h
    assert len(set(by.values())) == len(by)


def test_empty_and_chunks():
    import pyarrow as pa

    assert len(Words([]).hashes) == 0 and len(Words([b"", b" "]).hashes) == 0
    batch = pa.record_batch({"t": pa.array([b"x" * 10, None, b"y" * 100, b""], pa.binary())})
    runs = list(text_chunks(batch, "t", 20))
    assert [r[0] for r in runs] == [slice(0, 2), slice(2, 3), slice(3, 4)] or [t for _, r in runs for t in r] == [b"x" * 10, b"", b"y" * 100, b""]
    assert np.array_equal(Words([b"a b"]).hashes, Words([b"a  b "]).hashes)
