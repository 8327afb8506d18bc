"""One test per finding of a review."""

import zlib
from urllib.parse import urljoin

import numpy as np
from pyspark.sql import functions as F

from tracebraid.llm import lm_score, token_output, url_filter
from tracebraid.llm.queries import tokenizer_path
from tracebraid.llm.text import Words


def test_lm_tail_adds_up_in_every_context():
    rng = np.random.default_rng(5)
    counts, vectors = rng.integers(0, 9, (13, 6)).astype(np.float32), rng.normal(0, 4, (6, 24)).astype(np.float32)
    counts[3] = 0
    p = 10.0 ** lm_score.tail_scores(counts, vectors).astype(np.float64)
    assert np.allclose(p.sum(axis=0), 1, atol=1e-5) and p.std(axis=1).max() > 0.01 and not p[3].any()


def test_lm_against_direct_softmax(spark, monkeypatch):
    """Every word and the end after one context, scored as texts: prefixes' differences add up to one with the unseen rest."""
    monkeypatch.setattr(lm_score, "CLASSES", 3)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    learn = [(i, " ".join(rng.choice(words, 40, p=np.arange(30, 0, -1) / 465))) for i in range(400) if not held(i)]
    free = [i for i in range(400, 2000) if held(i)]
    ask = ["w0", *(f"w0 {w}" for w in words)]
    df = spark.createDataFrame(learn + list(zip(free, ask, strict=False)), "doc_id long, text string")
    by = {r["doc_id"]: r["score"] for r in lm_score.op4_lm_score(df.repartition(7)).collect()}
    again = {r["doc_id"]: r["score"] for r in lm_score.op4_lm_score(df.coalesce(1)).collect()}
    assert by.keys() == again.keys() and max(abs(by[i] - again[i]) for i in by) < 1e-9  # whatever the layout
    # P(w0 .) and P(w0 w .); the end's probability after "w0 w" does not matter here: it is below one.
    whole = 10 ** np.array([by[i] for i, _ in zip(free, ask, strict=False)])
    first = 10 ** by[free[0]]
    assert whole[0] == first and (whole[1:] > 0).all() and whole.sum() < 1


def test_lm_knows_contexts_of_rare_words(spark, monkeypatch):
    """Two words of equal counts beyond the frequent ones, each in its own context."""
    monkeypatch.setattr(lm_score, "CLASSES", 2)
    words = Words([f"w{i}".encode() for i in range(5000)])
    part = (words.hashes >> np.uint64(32)) * np.uint64(512) >> np.uint64(32)
    pp, qq = (f"w{i}" for i in np.flatnonzero(part == part[0])[:2])  # of one class
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    learn = [i for i in range(1000) if not held(i)][:400]
    tests = [i for i in range(1000, 1100) if held(i)][:4]
    rows = [(i, (f"aa {pp} aa {pp} aa", f"bb {qq} bb {qq} bb")[k % 2]) for k, i in enumerate(learn)]
    rows += list(zip(tests, (f"{a} {b}" for a in ("aa", "bb") for b in (pp, qq)), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r["doc_id"]: r for r in lm_score.op4_lm_score(df).collect()}
    assert len({round(by[i]["base_score"], 9) for i in tests}) == 1
    ap, aq, bp, bq = (by[i]["score"] for i in tests)
    assert ap > aq + 0.2 and bq > bp + 0.2


def test_tokens_of_special_texts_are_the_default_ones(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    texts = ["plain one", "<|endoftext|> hi", "a b<|endoftext|>c, d.", "x  y <|endoftext|>", "<|EndOfText|> no", "<|endoftext| > no", None, "last, one."]
    assert len(tk.encode("<|endoftext|>", add_special_tokens=False).ids) == 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_output.op9_token_output(df, tokenizer_path()).collect())) == want


def test_link_targets_are_resolved_like_urljoin(spark):
    bases = ["http://a.com/en/x/y.html?q=1#f", "https://b.de", "http://c.org/", "http://d.net/p/"]
    targets = ["page2.html", "../x", "../../../x/", "?id=3", "./", "..", ".", "a/./b/../c?x=../y", "/r/../s", "/out?u=http://a.com/en/1", "out?u=http://a.com/1", "//h.de/x/../y", "//h.de", "http://Z.com/a/../b?c", "x.html#top"]
    rows = [(b, t) for b in bases for t in targets]
    df = spark.createDataFrame(rows, "url string, target string")
    f = url_filter
    got = df.select("url", "target", f.address_of(f.resolved(df.target, df.url)).alias("got")).collect()
    want = spark.createDataFrame([(b, t, urljoin(b, t)) for b, t in rows], "url string, target string, want string").select("url", "target", f.address_of(F.col("want")).alias("want")).collect()
    assert {(r["url"], r["target"]): r["got"] for r in got} == {(r["url"], r["target"]): r["want"] for r in want}


def test_url_links_of_all_kinds_carry_blocks(spark):
    rows = [
        (1, "http://a.com/en/1", None, "block"),
        (2, "http://a.com/z/2", "<link rel=canonical href='../en/5'>", "block"),
        (3, "http://b.de/x/", '<meta http-equiv="refresh" content="0; url=index.html">', "block"),
        (4, "http://b.de/x/index.html", '<link rel="alternate canonical" href="http://a.com/en/1">', "block"),
        (5, "http://c.de/y", '<link rel="canonical" href="/out?u=http://a.com/en/1">', "allow"),
        (6, "http://e.de/?a=1&b=2", "<link rel=canonical href=http://a.com/en/1>", "block"),
        (7, "http://f.de/", '<link rel="canonical" href="http://e.de/?a=1&amp;b=2">', "block"),
        (8, "http://g.de/", '<link rel="x-canonical" href="http://a.com/en/1">', "allow"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.op8_url_filter(df).collect()} == {r[0]: r[3] for r in rows}
