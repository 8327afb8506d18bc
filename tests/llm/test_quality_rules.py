"""Sequential covering against a plain search over the rows themselves."""

import math
import random

from pyspark.sql import functions as F

from tracebraid.llm import quality_rules as qr


def covered(rule, row):
    return all((row[s] > t) == above for s, above, t in rule)


def best_condition(rows, cuts):
    bad0, good0 = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
    if bad0 < qr.LEAST_COVER or not good0:
        return None
    found = []
    for s in qr.STATISTICS:
        for t in cuts[s]:
            for above in (False, True):
                side = [r for r in rows if covered([(s, above, t)], r)]
                bad = sum(r["bad"] for r in side)
                if bad >= qr.LEAST_COVER:
                    gain = bad * (math.log2(bad / len(side)) - math.log2(bad0 / len(rows)))
                    found.append((gain, s, above, t))
    top = max((f[0] for f in found), default=0)
    if top <= 1e-9:
        return None
    ties = [f[1:] for f in found if f[0] == top]
    ties = [f for f in ties if f[:2] == ties[0][:2]]
    return ties[len(ties) // 2]


def plain_rules(rows, cuts):
    rules = []
    while len(rules) < qr.MOST_RULES:
        rest = [r for r in rows if not any(covered(x, r) for x in rules)]
        rule, part = [], [r for r in rest if r["fold"]]
        while len(rule) < qr.MOST_CONDITIONS and (c := best_condition(part, cuts)):
            rule.append(c)
            part = [r for r in part if covered([c], r)]
        scores = []
        for n in range(1, len(rule) + 1):
            held = [r["bad"] for r in rest if not r["fold"] and covered(rule[:n], r)]
            scores.append(((2 * sum(held) - len(held)) / (len(held) + 2), -n, sum(held), len(held)))
        if not scores:
            break
        _, n, bad, size = max(scores)
        if not bad or bad < qr.LEAST_PRECISION * size:
            break
        rules.append(rule[:-n])
    return rules


def labelled_rows(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words, symbols, repeats = rng.randint(50, 90), rng.choice([0, 0, 3, 40]), rng.choice([0, 6, 12, 30])
        bad = symbols == 40 or (repeats == 30 and words < 70) or rng.random() < 0.04
        rows.append((i, words, 5 * words + rng.randint(0, 40), symbols, rng.randint(0, 2), repeats, words - rng.randint(0, 9), rng.randint(0, 5), rng.randint(0, 3), bad, i % 3))
    return rows


def test_covering_against_plain_search(spark):
    for seed in (1, 2):
        df = spark.createDataFrame(labelled_rows(seed), "doc_id long, " + ", ".join(f"{c} long" for c in qr.COUNTS) + ", bad boolean, fold int")
        values = df.select("doc_id", "bad", "fold", *[F.expr(x).alias(s) for s, x in qr.STATISTICS.items()])
        rows = [r.asDict() for r in values.collect()]
        want = plain_rules(rows, qr.thresholds(values))
        rules = qr.learn_rules(df)
        assert want and [[(c.statistic, c.above, c.threshold) for c in rule] for rule in rules] == want
        judged = {r["doc_id"]: r["rule"] for r in qr.apply_rules(df, rules).collect()}
        for r in rows:
            assert judged[r["doc_id"]] == next((i for i, x in enumerate(want, 1) if covered(x, r)), None)


def test_no_labels_of_one_class_no_rules(spark):
    df = spark.createDataFrame([(*r[:-2], False, r[-1]) for r in labelled_rows(3, 40)], "doc_id long, " + ", ".join(f"{c} long" for c in qr.COUNTS) + ", bad boolean, fold int")
    assert qr.learn_rules(df) == [] and qr.learn_rules(df.limit(0)) == []
