import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracebraid.llm import pii
from tracebraid.llm.pii import op13_pii

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        double = [2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(d))]
        return 12 <= len(d) <= 19 and sum(double) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute_base(text):
    out = []
    for order, kind in enumerate(KINDS):
        out += [(m.start(), order, m.end()) for m in re.finditer(PATTERNS[kind], text or "") if holds(kind, m[0])]
    return sorted(out)


def listed(spans):
    return ",".join(f"{[*KINDS, 'term'][k]}:{s}:{e}" for s, k, e in spans)


def check_base(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    for r in op13_pii(df).collect():
        want = brute_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == i for x in want) for i in range(4)], texts[r["doc_id"]][:200]
        assert r["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest() and r["spans"].startswith(listed(want)[:20])


def test_base_spans_same_as_plain_patterns(spark):
    rng = random.Random(2)
    pieces = ["a.b@c.de", "x@y", "@", ".", "..", "1.2.3.4", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+", "12", "-", " ", "  ", "é", "\U0001f600", "\n", "_", "%", "a", "5.5.5.5.5.5.5.5", "0" * 13, "(", ")"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 25))) for _ in range(600)]
    texts += [None, "", "a@b.c_d@e.f", "a@b.cd@e.f", "79927398713 799273987130", "é\U0001f600 a@b.co", "1" * 19, "1" * 20, "4111111111111111.1.1.1"]
    check_base(spark, texts)


def test_very_long_runs_neither_fail_nor_take_long(spark):
    n = 60_000
    cases = [("a" * n, 0, 0, 0), ("a." * n, 0, 0, 0), ("1 " * n, 0, 0, 0), ("1." * n, 0, n // 4, 0), ("+1" + " (" * n, 0, 0, 0), ("x@y" + ".z" * n, 1, 0, 0), ("9" * n + "@", 0, 0, 0)]
    cases += [("a@b.co " * 9_000, 9_000, 0, 0), ("+1 555 555-5555 " * 5_000, 0, 0, 5_000), ("1.1.1.1 " * 9_000, 0, 9_000, 0)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_phone"]) for r in op13_pii(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def brute_terms(texts, least=3):
    near, c_e, c_t, words = defaultdict(set), defaultdict(set), Counter(), r"(?<![^\W\d_])[^\W\d_]{4,}"
    for i, t in enumerate(texts):
        t = t or ""
        c_t.update(set(re.findall(words, re.sub(PATTERNS["email"], " ", t).lower())))
        for order, kind in enumerate(KINDS):
            every = list(re.finditer(PATTERNS[kind], t))
            for k, m in enumerate(every):
                if not holds(kind, m[0]):
                    continue
                left = t[every[k - 1].end() if k else 0 : m.start()]
                right = t[m.end() : every[k + 1].start() if k + 1 < len(every) else len(t)]
                left = re.sub(r"^[^ \t-\r]*", "", left[-80:]) if len(left) > 80 else left
                right = re.sub(r"[^ \t-\r]*$", "", right[:80]) if len(right) > 80 else right
                e = f"{kind}:{m[0].lower()}"
                c_e[e].add(i)
                for w in set(re.findall(words, re.sub(PATTERNS["email"], " ", left + " " + right).lower())):
                    near[e, w].add(i)
    out = {}
    for (e, w), docs in near.items():
        if len({texts[i] for i in docs}) >= least:
            share = 1 - math.log(max(c_t[w], len(docs)) / len(docs)) / math.log(len(texts) / min(len(c_e[e]), len(texts) / 2))
            if share >= pii.DISCLOSES:
                out[w] = max(share, out.get(w, 0))
    return out


@pytest.fixture(scope="module")
def told():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    common = [word() for _ in range(60)]
    some = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [some(60) for _ in range(300)]
    for i in range(6):
        texts[i] = f"{some(10)} Marvolo Quirinus wrote to mq.42@mail.example.com {some(8)} tomorrow"
    texts[7] = f"{some(40)} as Quirinus said {some(4)}"
    texts[8:12] = [f"{some(5)} call +1 (555) 010-99{i} {some(30)}" for i in range(10, 14)]
    texts[20:26] = [f"{some(5)} rareword near 10.0.0.{i} {some(30)}" for i in range(6)]
    texts[30:34] = ["kopie here 4111 1111 1111 1111 kopie"] * 4  # one text only
    return [*texts, None, ""]


def test_disclosing_terms_same_as_plain_counts(spark, told):
    df = spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")
    want = brute_terms(told)
    got = {r["term"]: r["disclosure"] for r in pii.disclosing_terms(df).collect()}
    assert {"marvolo", "quirinus"} <= set(want) and "kopie" not in want and "rareword" not in want
    assert set(got) == set(want) and all(abs(got[w] - want[w]) < 1e-9 for w in want)
    for r in op13_pii(df).collect():
        t = told[r["doc_id"]] or ""
        base = brute_base(t)
        terms = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W\d_]{4,}", t) if m[0].lower() in want and not any(m.start() < e and s < m.end() for s, _, e in base)]
        assert r["spans"] == listed(sorted(base + terms))


def test_sanitised_texts(spark, told):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(told)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.sanitised(df).collect()}
    assert len(got) == len(told) and pii.sanitised(df).columns == df.columns
    want = brute_terms(told)
    shown = lambda w: "" if want[w.lower()] >= pii.REMOVES else "[name]"
    assert f" {shown('Marvolo')} {shown('Quirinus')} " in got[0]["text"] and "[email]" in got[0]["text"] and "mq.42" not in got[0]["text"]
    assert f"as {shown('Quirinus')} said" in got[7]["text"]
    assert got[50]["text"] == told[50] and got[len(told) - 2]["text"] is None and "[card]" in got[30]["text"]


def test_without_entities_and_empty(spark):
    df = spark.createDataFrame([(1, "plain words only"), (1, None)], "doc_id long, text string")
    assert [(r["n_email"], r["spans"]) for r in op13_pii(df).collect()] == [(0, "")] * 2
    assert op13_pii(df.limit(0)).count() == 0 and op13_pii(df).columns == COLUMNS


def test_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        got = spark.range(1).select(pii.running(F.array(*[F.lit(i).cast("long") for i in range(n)]) if n < 70 else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: x.cast("long"))) if n else pii.running(F.array().cast("array<long>"))).first()[0]
        assert got == [sum(range(i)) for i in range(n)]
