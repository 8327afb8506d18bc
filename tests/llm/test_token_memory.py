from tracebraid.llm import token_output as t
from tracebraid.llm.queries import tokenizer_path


def test_new_pieces_are_encoded_a_little_at_a_time(monkeypatch):
    e, given = t.PieceEncoder(tokenizer_path()), []
    ids = e._ids
    monkeypatch.setattr(e, "_ids", lambda texts: given.append(sum(map(len, texts))) or ids(texts))
    words = [f"w{i * 7919 % 100_003}" + "é" * (i % 3) for i in range(40_000)]
    texts = [" ".join(words[:20_000]).encode(), b"", "\n".join(words[20_000:]).encode(), "  a  b\t\tc  ".encode() * 900, b"<|endoftext|> x", "  ".join(words[:9_000]).encode()]
    got, first = e.encode_run(texts)
    rest = [n for n in given if n != len(texts[4])]
    # A run's new pieces were one text of 600 KB before; now only one long piece would be more.
    assert len(rest) > 6 and max(rest) < t.JOINED_BYTES * 1.5
    for i, text in enumerate(texts):
        assert got[first[i] : first[i + 1]].tolist() == [*ids([text])[0].tolist(), e.end_id]
    # Known pieces are gathered in parts.
    again, begins = e.encode_run(texts * 2)
    assert again.tolist() == got.tolist() * 2 and begins[len(texts)] == len(got)


def test_parts_of_pieces(monkeypatch):
    monkeypatch.setattr(t, "GATHERED", 2)
    monkeypatch.setattr(t, "JOINED_BYTES", 4)
    e = t.PieceEncoder(tokenizer_path())
    texts = [b"", b"one two  three\nfour", b"\n\n", b"one two", b"\xf0\x9f\x98\x80 end"]
    got, first = e.encode_run(texts)
    assert [got[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [[*e._ids([x])[0].tolist(), 0] for x in texts]
    assert e.encode_run([])[0].tolist() == []
