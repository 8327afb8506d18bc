import hashlib
import random
import re

from tracebraid.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        windows += [("" if i is None else str(i), tuple(w[k : k + n])) for k in range(len(w) - n + 1 if n else 0)]
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(item)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice(["ab", "Cd", "é9", "x", "the", "Z"]) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([20, 15, 13, 5, 1, 40])] + [(6, None), (7, "!!"), (2, make(14)), (None, make(16))]
    docs = [(i, make(rng.choice([0, 3, 30, 200]))) for i in range(12)]
    docs += [(20, items[0][1] + ", " + make(300)), (21, make(10) + items[5][1].upper()), (22, None), (23, ""), (None, items[1][1]), (20, items[2][1])]
    return docs, items


def frames(spark):
    docs, items = sample()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_against_brute_force(spark):
    a, b, docs, items = frames(spark)
    got = sorted((tuple(r) for r in d.op2_decontaminate(a, b).collect()), key=repr)
    assert got == brute(docs, items)


def test_blocks_give_the_same(spark):
    a, b, docs, items = frames(spark)
    one = d.scan_documents(a, b).select("doc_id", "scan.n_hit", "scan.items", "scan.spans").collect()
    many = d.scan_documents(a, b, block_words=30).select("doc_id", "scan.n_hit", "scan.items", "scan.spans").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_spans_documents_and_columns(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, f"Start. {item.upper()}! End", "a", "s"), (2, "clean words only", "b", None), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, scan_ string, row string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = d.remove_documents(docs, bench)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in d.remove_spans(docs, bench).collect()}
    assert cut == {1: "Start. ! End", 2: "clean words only", 3: None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.op2_decontaminate(docs, bench).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[1:4] for r in d.op2_decontaminate(some, bench).collect()] == [(2, 0, 0)]
