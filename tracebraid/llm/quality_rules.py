"""Quality rules: an ordered list of threshold conjunctions learned from labelled text statistics.

Statistics of every whole text are Spark expressions on its array of words; no
text is shuffled.  Rules for the low-quality class are found by sequential
covering: a rule grows by the threshold with the best information gain, counted
in one aggregation of a histogram per step over all labelled rows, is pruned on
rows held back, and the rows it covers leave before the next rule.  The list
becomes one ``CASE WHEN`` expression.

Everything is DataFrame operations; the driver sees only histograms of a fixed
number of bins.

Cases: null and empty texts have no words and fail the base rule; labels that
are null or belong to no document are ignored; repeated label rows count
repeatedly; without labels of both classes the list is empty and only the base
rule decides; repeated documents each get their row; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .store import written

#: Base rule: fewer words fail, and so do texts with more than this percentage of repeated words.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Candidate thresholds of a statistic, conditions of a rule, rules of a list.
BINS, MOST_CONDITIONS, MOST_RULES = 24, 4, 12
#: A rule stays when so large a share of the held-back rows it covers is of low quality.
LEAST_PRECISION = 0.8
#: A rule must cover as many labelled rows of low quality.
LEAST_COVER = 5

STATISTICS = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1D)",
    "word_length": "word_chars / greatest(n_words, 1D)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1D)",
    "duplicate_lines_per_word": "n_dup_lines / greatest(n_words, 1D)",
    "distinct_share": "n_distinct / greatest(n_words, 1D)",
    "capitals_per_char": "n_capitals / greatest(word_chars, 1D)",
    "exclamations_per_word": "n_exclamations / greatest(n_words, 1D)",
    "words": "CAST(n_words AS DOUBLE)",
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_capitals", "n_exclamations"]


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(STATISTICS[self.statistic])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def text_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id as ``doc_id`` and the counts of COUNTS, from the whole text.

    A window is three words, compared by a 64-bit hash; positions of windows
    found twice or more are sorted, and each covers what the next one leaves.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    d = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    d = d.select("*", F.array_remove(F.split("text", "[ \\t-\\r]+"), "").alias("w"), F.split("text", "\n").alias("lines"))
    d = d.select(
        "doc_id",
        "w",
        F.filter("lines", lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        F.transform(
            F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)),
        ).alias("windows"),
    )
    d = d.select(
        "doc_id",
        "n_symbols",
        "n_capitals",
        "n_exclamations",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).alias("placed"),
    )
    d = d.withColumn(
        "placed",
        F.sort_array(
            F.transform(
                F.filter("placed", lambda x, k: (x.h == F.get("placed", k - 1).h) | (x.h == F.get("placed", k + 1).h)),
                lambda x: x.i,
            )
        ),
    )
    covered = F.transform("placed", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("placed", k + 1) - x, F.lit(3))))
    repeated = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0).cast("long"))).select("doc_id", *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def thresholds(values: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds by statistic, ascending: quantiles of all rows and of the bad ones, and the middles between them."""
    names = list(STATISTICS)
    # Some lie in the tails.
    shares = sorted([i / BINS for i in range(1, BINS)] + [0.001, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.999])
    got = values.agg(*[F.percentile_approx(x, shares, 2000).alias(n) for s in names for n, x in ((s, s), (f"bad_{s}", F.when(F.col("bad"), F.col(s))))]).first()
    cuts = {s: sorted({*(got[s] or ()), *(got[f"bad_{s}"] or ())}) for s in names}
    return {s: sorted({*t, *((a + b) / 2 for a, b in zip(t, t[1:], strict=False))}) for s, t in cuts.items()}


def _bin(statistic: str, cuts: list[float]) -> Column:
    """How many thresholds are below the value; one expression over a constant array, whatever their number."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in cuts]), lambda c: c < F.col(statistic))).cast("byte").alias(statistic)


def learn_rules(labelled: DataFrame) -> list[Rule]:
    """Learn from rows with the counts, ``bad`` (boolean) and ``fold`` (0 to 2; 0 is held back)."""
    values = labelled.select("bad", "fold", *[F.expr(STATISTICS[s]).alias(s) for s in STATISTICS])
    cuts = thresholds(values)
    if not any(cuts.values()):
        return []
    binned = written(values.select("bad", "fold", *[_bin(s, cuts[s]) for s in STATISTICS]), "rule-bins")
    rules, rest = [], F.lit(True)
    while len(rules) < MOST_RULES and (rule := _grow(binned.filter(rest), cuts)):
        rule = _prune(binned.filter(rest), rule, cuts)
        if not rule:
            break
        rules.append(rule)
        rest = rest & ~_covers(rule, cuts)
    return rules


def _covers(rule: Rule, cuts: dict[str, list[float]]) -> Column:
    out = F.lit(True)
    for c in rule:
        k = cuts[c.statistic].index(c.threshold)
        out = out & ((F.col(c.statistic) > k) if c.above else (F.col(c.statistic) <= k))
    return out


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS:
        bins = rows.filter((F.col("fold") != 0) & _covers(rule, cuts)).select(
            "bad", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).alias("b")) for s in cuts])).alias("x")
        )
        counts = bins.groupBy("x.s", "x.b").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
        table = {s: [[0, 0] for _ in range(len(t) + 1)] for s, t in cuts.items()}
        for s, b, bad, good in counts:
            table[s][b] = [bad, good]
        all_bad, all_good = (sum(x[i] for x in next(iter(table.values()))) for i in (0, 1))
        if all_bad < LEAST_COVER or not all_good:
            break
        best, gained = [], 1e-9
        for s, hist in table.items():
            low_bad = low_good = 0
            for k, t in enumerate(cuts[s]):
                low_bad, low_good = low_bad + hist[k][0], low_good + hist[k][1]
                for above, bad, good in ((False, low_bad, low_good), (True, all_bad - low_bad, all_good - low_good)):
                    if bad >= LEAST_COVER:
                        gain = bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good)))
                        if gain > gained:
                            best, gained = [], gain
                        if gain == gained and (not best or best[0].statistic == s and best[0].above == above):
                            best.append(Condition(s, above, t))
        if not best:
            break
        rule += (best[len(best) // 2],)  # the middle of thresholds that do equally well
    return rule


def _prune(rows: DataFrame, rule: Rule, cuts: dict[str, list[float]]) -> Rule:
    """The beginning of the rule that does best on the held-back rows; nothing if none is precise."""
    prefixes = [rule[:n] for n in range(1, len(rule) + 1)]
    held = rows.filter("fold = 0")
    got = held.agg(*[F.count_if(_covers(p, cuts) & b).alias(f"{k}{i}") for i, p in enumerate(prefixes) for k, b in (("bad", F.col("bad")), ("good", ~F.col("bad")))]).first()
    # The score is bounded towards its prior, so that a wider rule wins over an equally pure narrow one.
    score = lambda i: (got[f"bad{i}"] - got[f"good{i}"]) / (got[f"bad{i}"] + got[f"good{i}"] + 2)
    best = max(range(len(prefixes)), key=lambda i: (score(i), -i))
    bad, good = got[f"bad{best}"], got[f"good{best}"]
    return prefixes[best] if bad and bad >= LEAST_PRECISION * (bad + good) else ()


def verdict(rules: list[Rule]) -> Column:
    """The decision list as a Spark expression: the number of the first rule that rejects, else null."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(i + 1)).otherwise(out)
    return out


def apply_rules(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """The counts with ``base_failed``, ``rule`` (its number, or null) and ``kept``."""
    judged = counts.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def label_rows(counts: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """Counts of labelled documents that pass the base rule, with ``bad`` and ``fold``."""
    y = labels.select(F.col("doc_id").alias("labelled_id"), (F.col(label_col) == 0).alias("bad")).dropna()
    joined = counts.filter(~base_failed()).join(y, F.col("doc_id") == F.col("labelled_id"))
    return joined.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(3))).drop("labelled_id")


def op1_quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept and the rejecting rule's number."""
    counts = written(text_counts(documents), "text-counts")
    rules = learn_rules(label_rows(counts, labels))
    judged = apply_rules(counts, rules)
    return judged.select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")
