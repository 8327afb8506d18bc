import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracebraid.llm import language_id, lm_score, mixing, quality_classifier as qc, quality_rules as qr, token_output, url_filter, warc
from tracebraid.llm.queries import tokenizer_path
from tracebraid.llm.store import shared_dir

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def odd_docs(spark):
    rows = [(1, "a b a b a b\nx\nx\n \n# 5!", "en", "s1"), (2, None, None, None), (3, "", "en", "s2"), (3, "w " * 70, "fr", "s1"), (None, "one\u00a0two\x0bthree\x1cfour", None, "~"), (5, "Q|r|s " * 3 + "\n" * 4, "en", "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("w", F.lit(1)).withColumn("row", F.lit("x"))


def counts(text):
    text = text or ""
    w = WORDS.findall(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {p for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_rule_counts(spark, sf_dir):
    rows, df = odd_docs(spark)
    rows += [(r["doc_id"] + 100, r["text"]) for r in docs_of(spark, sf_dir).collect()]
    every = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    got = Counter((r["doc_id"], *(r[c] for c in qr.COUNTS[:5])) for r in qr.text_counts(every).collect())
    assert got == Counter((r[0], *counts(r[1])) for r in rows)


def test_rules_learn_and_judge(spark):
    docs = docs_of(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = qr.op1_quality_rules(docs, labels).join(labels, "doc_id").filter("NOT base_failed").collect()
    right = sum(r["kept"] == bool(r["quality"]) for r in got) / len(got)
    assert right > 0.97
    plan = qr.apply_rules(qr.text_counts(docs), [(qr.Condition("words", True, 3.0),)])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert qr.op1_quality_rules(docs.limit(0), labels.limit(0)).count() == 0
    none = qr.op1_quality_rules(odd_docs(spark)[1], labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in none)


def test_lm_counts_and_scores(spark):
    rows, _ = odd_docs(spark)
    rng = random.Random(4)
    words = ["the", "of", "and", "x1", "y2", "Zé", "q"]
    rows = [(r[0], r[1]) for r in rows] + [(10 + i, " ".join(rng.choices(words, [9, 7, 5, 1, 1, 1, 1], k=rng.randint(0, 60)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    got = lm_score.op4_lm_score(df).collect()
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm_score.op4_lm_score(df.limit(0)).count() == 0


def test_lm_probabilities_add_up():
    voc = lm_score.Vocabulary([(5, 10), (9, 4)], 6, 20, 3)
    model = lm_score.LogBilinear(voc.other + 1, shares=voc.shares)
    trainer = lm_score.Trainer(model, voc.shares, 1)
    tokens = np.array([0, 1, 2, 0, 3, 2] * 20)
    trainer.learn(tokens, np.roll(tokens, 1), np.roll(tokens, 2))
    one, two, z = model.tables()
    p = 10.0 ** (one[:, None, :] + two[None, :, :] - z[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)


def test_lm_beats_base_on_held_out(spark):
    got = lm_score.op4_lm_score(docs_of(spark, "/root/testdata/sf0.01")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_classifier(spark):
    docs, labels = docs_of(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = qc.op5_quality_classifier(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r["score"] for r in got if r["quality"]], [r["score"] for r in got if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    odd = qc.op5_quality_classifier(odd_docs(spark)[1], labels.limit(0)).collect()
    assert len(odd) == 6 and all(r["score"] == 0.5 for r in odd)
    assert qc.keep_good(odd_docs(spark)[1], labels).columns == odd_docs(spark)[1].columns


def test_language(spark):
    docs = docs_of(spark, "/root/testdata/sf0.01")
    got = language_id.op7_language_id(docs).join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 !?", "en"), (3, "the of and", None), (4, "the and of the", "en")], "doc_id long, text string, lang string")
    by = {r["doc_id"]: r for r in language_id.op7_language_id(odd).collect()}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == "und" and by[3]["lang_pred"] in ("en", "und")
    assert language_id.op7_language_id(odd.limit(0)).count() == 0


def test_language_of_switched_words(spark):
    tagger = language_id.train(docs_of(spark, "/root/testdata/sf0.01"))
    words = tagger.label_words("the thing of that and the then that les des une avec pour dans les une")
    assert [w[1] for w in words[:4]] == ["en"] * 4 and [w[1] for w in words[-4:]] == ["fr"] * 4


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    e, move, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.array([0, 4, 4, 9])
    got = language_id.marginals(e, first, move, start)
    for a, b in ((0, 4), (4, 9)):
        p = np.zeros((b - a, 3))
        for path in np.ndindex(*[3] * (b - a)):
            w = math.exp(start[path[0]] + sum(e[a + t, y] for t, y in enumerate(path)) + sum(move[x, y] for x, y in zip(path, path[1:], strict=False)))
            for t, y in enumerate(path):
                p[t, y] += w
        assert np.allclose(got[a:b], p / p.sum(axis=1, keepdims=True))


def test_mix_meets_targets(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40]), rng.choice(["a", "b", "c", "d", None])) for i in range(300)] + [(300 + i, "v " * 2000, "a") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.op6_mixing(df).collect()
    by = {}
    source = {r[0]: r[2] for r in rows}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        x = by.setdefault(source[r["doc_id"]], [r["source_size"], r["target"], 0])
        x[2] += r["taken"]
    total, names = sum(x[0] for x in by.values()), ["a", "b", "c", "d", None]
    weights = dict(zip(names, [5, 2, 1, 5, 2], strict=True))
    target = dict.fromkeys(names, 0.0)
    left, open_ = float(total), set(names)
    while True:  # share, stop at the limit, share what is over
        share = {n: left * weights[n] / sum(weights[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > 3 * by[n][0]}
        if not over:
            break
        for n in over:
            target[n] = 3.0 * by[n][0]
            left -= target[n]
        open_ -= over
    target |= {n: share[n] for n in open_}
    for n in names:
        assert abs(by[n][1] - target[n]) < 1e-6 * total and abs(by[n][2] - target[n]) <= 1
    assert sorted(map(tuple, mixing.op6_mixing(df).collect())) == sorted(map(tuple, got))


def test_mix_rows_shards_and_columns(spark):
    _, df = odd_docs(spark)
    big = docs_of(spark, "/root/testdata/sf0.001")
    plan = mixing.op6_mixing(big).agg(F.sum("taken"), F.sum("n_draws")).first()
    mixed = mixing.mixed_documents(big)
    assert mixed.columns == [*big.columns, "mix_shard"]
    words = mixed.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))), F.count("*")).first()
    assert tuple(words) == tuple(plan)
    assert set(mixing.mixed_documents(df).columns) == {*df.columns, "mix_shard"}
    assert mixing.op6_mixing(df.limit(0)).count() == 0


def test_tree_gives_every_shard_its_quota(spark):
    tickets = spark.range(101).select(F.concat(F.lit("s"), F.col("id") % 3).alias("skey"), F.col("id").cast("string").alias("unit"), F.lit(1).alias("pass"))
    quotas = mixing.shard_quotas(tickets, 3)
    size = {r["shard"]: r["n"] for r in quotas.groupBy("shard").agg(F.sum("quota").alias("n")).collect()}
    assert len(size) == 8 and sum(size.values()) == 101 and set(size.values()) <= {12, 13}
    assert {r["skey"]: r["n"] for r in quotas.groupBy("skey").agg(F.sum("quota").alias("n")).collect()} == {"s0": 34, "s1": 34, "s2": 33}
    drawn = mixing.draw_tickets(tickets, quotas)
    assert drawn.count() == drawn.select("unit").distinct().count() == 101
    key = lambda df, n: sorted((r["skey"], r["shard"], r[n]) for r in df.collect() if r[n])
    assert key(drawn.groupBy("skey", "shard").agg(F.count("*").alias("n")), "n") == key(quotas, "quota")


def test_url_rules_and_aliases(spark):
    rows = [
        (1, "http://a.com/en/1", None, "block"),
        (2, "http://b.de/x", '<link rel="canonical" href="http://a.com/en/1">', "block"),
        (3, "https://c.de/y#f", "<META HTTP-EQUIV=refresh content='0; url=//b.de/x'>", "block"),
        (4, "http://q.Example.com/en/70", "<link href=/en/71 rel=canonical>", "allow"),
        (5, "http://d.de/z", '<link rel=canonical href="https://example.net/de/5"><link rel=canonical href="http://a.com/en/9">', "allow"),
        (6, None, None, "allow"),
        (7, "nohost", "<link rel=canonical href=http://a.com/en/1>", "allow"),
        (8, "http://e.de/", '<link rel="stylesheet" href="http://a.com/en/1">', "allow"),
        (8, "http://e.de/", None, "allow"),
        (9, "x://notexample.net/de/8", None, "allow"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").withColumn("node", F.lit(1))
    got = url_filter.op8_url_filter(df).collect()
    assert Counter((r["page_id"], r["verdict"]) for r in got) == Counter((r[0], r[3]) for r in rows)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got}
    assert by[4] == ("q.example.com", "/en/70", "example.com/en/7") and by[6] == by[7] == ("", "", None)
    more = spark.createDataFrame([("http://e.de/", "http://a.com/en/3")], "source string, target string")
    assert {r["verdict"] for r in url_filter.judge(df, redirects=more).filter("page_id = 8").collect()} == {"block"}
    assert url_filter.op8_url_filter(df.limit(0)).count() == 0


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    tk.encode_special_tokens = True
    texts = ["a  b\n\n c", "it's, isn't it?\n'tis , x.,y \t z ", "", None, "\n", "<|endoftext|> hi", "x\x00y z", "日本語 ok, don't. é", "w " * 3000, "same text", "same text", "a\x1cb \x1c c"]
    rows = [(i // 2 if i < 20 else None, t) for i, t in enumerate(texts)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    files = token_output.write_tokens(df, tokenizer_path(), sequence=64)
    got = token_output.read_checksums(files).collect()
    want, at = [], 0
    for doc, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    docs = {r["start"]: r["ids"] for r in token_output.read_documents(files).collect()}
    assert {s: len(i) for s, i in docs.items()} == {w[1]: w[2] for w in want}
    first = files.orderBy("file").first()
    ids, mask = token_output.read_sequence(first["base"], first["file"], 0)
    assert len(ids) == len(mask) == 64 and mask.sum() == min(64, first["n_tokens"])
    assert token_output.op9_token_output(df.limit(0), tokenizer_path()).count() == 0


def test_pieces_when_memory_is_full(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "REMEMBERED", 3)
    e = token_output.PieceEncoder(tokenizer_path())
    tk = Tokenizer.from_file(tokenizer_path())
    for t in ("one two, three. four", "five one six, two", "three. seven, é one"):
        assert e.encode([t])[0] == np.array([*tk.encode(t).ids, 0], e.kind).tobytes()


def test_warc_round_trip_and_filters(spark):
    big = "é" * 600
    rows = [(1, "http://a/", big), (5, "http://b/", big), (3, None, big), (4, "http://c/\nx", "small"), (6, "u", "small"), (7, "u", None), (None, "u", big), (8, "u", "y" * 999), (9, "u", "y" * 999)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    import hashlib

    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = html == big and page != 5
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert sorted((tuple(r) for r in warc.op10_warc(df).collect()), key=repr) == sorted(want, key=repr)
    path = shared_dir(spark, "warc-test")
    warc.write_archives(df, path)
    back = spark.read.format("warc").load(path)
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in back.filter("record_type = 'response'").collect()} == {(p, h or "") for p, _, h in rows if h != big or p == 5}
    assert back.filter("record_type = 'revisit' AND target_uri = 'http://a/'").count() == 1
    lean = spark.read.format("warc").schema("page_id long, record_type string").load(path)
    assert lean.count() == len(rows)
    assert warc.op10_warc(df.limit(0)).count() == 0
