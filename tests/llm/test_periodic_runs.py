import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tracebraid.llm import periodic_runs
from tracebraid.llm.periodic_runs import op12_periodic_runs

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def brute_runs(w):
    """All maximal stretches by plain loops."""
    n, found = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if length >= max(6, 4 * p) and not any(length >= q and all(w[x] == w[x + q] for x in range(i, i + length - q)) for q in range(1, p)):
                found[i, length] = p
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_row(i, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    if i is not None and w:
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    drop = {k for s, n, p in runs for k in range(s + p, s + n)}
    s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    said = " ".join(x for k, x in enumerate(w) if k not in drop)
    return (i, len(runs), s, n, p, 1000 * n // p if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(said))


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, runs string, period int")
    got = [tuple(r[c] for c in COLUMNS) for r in op12_periodic_runs(df).collect()]
    assert sorted(got, key=repr) == sorted((brute_row(i, t) for i, t in rows), key=repr)
    return got


def test_runs_of_small_alphabets():
    rng = random.Random(3)
    texts = [[rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.randrange(0, 70))] for _ in range(400)]
    texts += [[0, 1] * 30 + [0] * 20, [0, 0, 1] * 12 + [2] + [0, 0, 1] * 9, [5] * 6, [5] * 5, [1, 2, 3, 4] * 4, [1, 2, 3, 4] * 4 + [1], [1, 2, 3, 4] * 3 + [1, 2, 3]]
    got = periodic_runs.runs_of([np.array(t, np.int64) for t in texts])
    for t, r in zip(texts, got, strict=True):
        assert [tuple(x) for x in r.tolist()] == sorted(brute_runs(t), key=lambda x: (x[0], x[2])), t


def test_grid_without_run():
    """Equal words at three neighbouring grid pairs alone make no run."""
    assert [len(r) for r in periodic_runs.runs_of([np.array([1, 2, 1, 3, 1, 4, 1, 5])])] == [0]


def test_extensions_and_minima():
    rng = np.random.default_rng(4)
    s = rng.integers(0, 2, 300)
    lce = periodic_runs.Extensions(s)
    i, j = rng.integers(0, 301, 2000), rng.integers(0, 301, 2000)
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i, j, lce(i, j), strict=True):
        want = 0
        while max(a, b) + want < 300 and s[a + want] == s[b + want]:
            want += 1
        assert n == want
    v = rng.integers(0, 1000, 777).astype(np.int32)
    minima = periodic_runs.RangeMinima(v)
    a, b = np.sort(rng.integers(0, 777, (2, 3000)), axis=0)
    assert (minima(a, b) == [v[x : y + 1].min() for x, y in zip(a, b, strict=True)]).all()


def test_op12_same_as_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab cé \U0001f600 dd".split()) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    rows += [(None, "x y " * 9), (3, None), (4, ""), (5, " \t\n"), (6, "la " * 7 + "\n la\x0b la la"), (6, "la " * 7), (6, "la " * 7), (9, "a\x00b " * 8)]
    tenth = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, " ".join(f"w{k}" for k in range(rng.randrange(0, 200)))) for i in tenth[:40]] + [(tenth[0], None), (tenth[1], " ")]
    got = check(spark, rows)
    assert sum(r[1] > 0 for r in got) > 30


def test_long_text_and_sample(spark, sf_dir):
    rng = random.Random(1)
    line = [f"w{rng.randrange(50)}" for _ in range(40)]
    text = " ".join([f"u{rng.randrange(9000)}" for _ in range(30000)] + line * 50 + ["z"] * 20000 + [f"u{rng.randrange(9000)}" for _ in range(30000)])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    runs = periodic_runs.find_runs(df).select(F.inline("runs")).collect()
    assert [tuple(r) for r in runs] == [(30000, 2000, 40), (32000, 20000, 1)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is None or len(r["text"]) < 4000]
    check(spark, rows)
    assert op12_periodic_runs(docs.limit(0)).count() == 0
