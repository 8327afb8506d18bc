"""What the reader leaves unread, and plans without payloads in a shuffle."""

import io
import random

import pytest

from tracebraid.llm import warc


class Counted(io.BytesIO):
    read_bytes = 0

    def read_at(self, n, at):
        self.seek(at)
        got = self.read(n)
        self.read_bytes += len(got)
        return got


def archive(sizes, kinds):
    rng = random.Random(1)
    data, places = b"", [0]
    for i, (n, kind) in enumerate(zip(sizes, kinds, strict=True)):
        payload = rng.randbytes(n)
        row = {"page_id": i, "record_type": kind, "target_uri": "u" * (i * 37 % 5000), "payload": payload, "payload_bytes": n, "refers_to": None}
        data += warc.encode_record(row | {"payload_digest": warc.hashlib.sha1(payload).hexdigest()})
        places.append(len(data))
    return Counted(data), places


def test_unwanted_payloads_are_not_read():
    sizes = [500_000, 10, 0, 300_000, 70_000, 200]
    kinds = ["response", "response", "revisit", "response", "response", "revisit"]
    f, places = archive(sizes, kinds)
    got = list(warc.read_records(f, places, payload=False))
    assert [r["payload_bytes"] for r in got] == sizes and f.read_bytes < 40_000
    f.read_bytes = 0
    got = list(warc.read_records(f, places, [("record_type", {"revisit"})]))
    assert [r["page_id"] for r in got] == [2, 5] and f.read_bytes < 40_000
    got = list(warc.read_records(f, places))
    assert [len(r["payload"] or b"") for r in got] == [n if k == "response" else 0 for n, k in zip(sizes, kinds, strict=True)]
    assert [r["page_id"] for r in warc.read_records(f, places[3:5])] == [3]


def test_damage_is_found():
    f, places = archive([3000, 40], ["response", "response"])
    data = bytearray(f.getvalue())
    data[places[1] - 5] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        list(warc.read_records(Counted(bytes(data)), places))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read_records(Counted(bytes(f.getvalue()[: places[1] + 9])), places))


def test_both_plans_agree(spark, monkeypatch):
    big = ["x" * 1000, "é" * 700, "z" * 5000]
    rows = [(i if i % 7 else None, "http://h/", big[i % 3] if i % 5 else f"{i}" * 900) for i in range(60)] + [(2, "http://again/", big[2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = sorted(map(repr, warc.plan_records(df).collect()))
    plan = warc.plan_records(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, warc.plan_records(df).collect())) == one and sum("revisit" in r for r in one) > 20
