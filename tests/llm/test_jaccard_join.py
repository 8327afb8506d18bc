import random

import numpy as np

from tracebraid.llm import jaccard_join as j
from tracebraid.llm.components import connected_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = label[a], label[b]
                label = [y if v == x else v for v in label]
    least = {}
    for (doc, _), v in zip(docs, label, strict=True):
        if doc is not None:
            least[v] = min(doc, least.get(v, doc))
    return sorted(((doc, len(s), least.get(v)) for (doc, _), s, v in zip(docs, sets, label, strict=True)), key=repr)


def sample(seed=3, groups=12, most=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    docs = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 150]))]
        for _ in range(rng.randint(1, most)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w + passage
            docs.append(" ".join(w).upper() if rng.random() < 0.1 else " ".join(w))
    docs += ["", " ", "a b", "A  b", "c", "a b c d"]
    rng.shuffle(docs)
    return [*enumerate(docs), (500, None), (3, docs[3]), (None, docs[5])]


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = j.op3_jaccard_join(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs)


def test_against_brute_force(spark):
    check(spark, sample())


def test_many_blocks_against_brute_force(spark, monkeypatch):
    """Blocks, chunks and ranges of a few sets: all stages of large clusters are taken."""
    monkeypatch.setattr(j, "BLOCK_HASHES", 150)
    monkeypatch.setattr(j, "CHUNK_HASHES", 300)
    check(spark, sample(8, 5, 40))


def test_tile_equals_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
        sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(30, 80), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 9)).astype(np.uint64)))) for _ in range(25)]
        label = np.arange(25)
        for a, b in j.links_in_tile(sets, np.arange(25), np.ones(25, bool)):
            label[label == label[a]] = label[b]
        want = np.arange(25)
        for a in range(25):
            for b in range(a):
                n = len(np.intersect1d(sets[a], sets[b]))
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    want[want == want[a]] = want[b]
        assert len(set(zip(label.tolist(), want.tolist(), strict=True))) == len(set(label.tolist())) == len(set(want.tolist()))


def test_keep_one_keeps_columns_and_one_of_each(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, text, "x"), (2, text, "y"), (2, text, "z"), (3, "other words", None), (3, "other words", None), (4, None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = j.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_hashes_of_many_texts_against_brute_force(spark, monkeypatch):
    """Their owners stay with the chunk."""
    monkeypatch.setattr(j, "PACKED_OWNERS", 2)
    check(spark, sample(11, 6, 30))
    monkeypatch.setattr(j, "BLOCK_HASHES", 150)
    monkeypatch.setattr(j, "CHUNK_HASHES", 900)
    check(spark, sample(12, 4, 60))


def test_rows_of_one_id_are_told_apart(spark):
    text, other = " ".join(f"t{i}" for i in range(30)), " ".join(f"u{i}" for i in range(40))
    rows = [(7, text), (7, other), (8, other + " v"), (9, text), (None, "n1 n2"), (None, "n3"), (None, "n3"), (None, None), (None, ""), (5, "n3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row_id", "2 AS gone_id", "3 AS again_id", "4 AS rid", "5 AS n", "6 AS row", "map(1, 2) AS kept")
    kept = j.keep_one(df.repartition(3))
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(7, text), (7, other), (None, "n1 n2"), (5, "n3"), (None, None), (None, "")], key=repr)
    parts = sorted(((r["doc_id"], r["component_id"]) for r in j.op3_jaccard_join(df).collect()), key=repr)
    assert parts == sorted([(7, 7), (7, 7), (8, 7), (9, 7), (None, None), (None, 5), (None, 5), (None, None), (None, None), (5, 5)], key=repr)


def test_empty_table(spark):
    assert j.op3_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
        x, y = label[a], label[b]
        label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
