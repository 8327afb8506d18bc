"""Joint logic of an incident's causes: the minimum of squared hinges, over graphs that may be split over tasks.

Variables are the causes of hypotheses and the reach of nodes that are no
symptoms; labels that are visible are fixed causes, symptoms have reach 1.
Every rule belongs to an edge or to an edge and its reverse, so edges are dealt
into parts, each pair with its reverse.  Parts agree on the reach of nodes that
they share by consensus: each minimises its own rules and the distance to the
agreed values, then the values become means of the parts' (alternating direction
method of multipliers, over-relaxed).  A case of at most ``PART_EDGES`` edges is
one part and solved at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import CAUSAL, NON_CAUSAL
from .graph import cut, spent

PAIR = ["source", "target"]
#: Edges of a part, about.
PART_EDGES = 100_000
#: Weight of the distance to agreed values, over-relaxation, largest disagreement at the end, rounds at most.
AGREEMENT, RELAXED, TOLERANCE, MOST_ROUNDS = 1.0, 1.6, 5e-7, 500


def minimise(t, a, s, k, source, target, fixed, symptom, centre=None, weight=None, start=None, steps: int = 4000, least: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(causes, reach) at the minimum over one part, by accelerated projected gradient.

    ``fixed`` has (source, target, value) of visible labels; ``centre`` and
    ``weight`` (0 for nodes of this part alone) hold reach near agreed values.  A
    rule is grounded only where all its observed atoms exist.
    """
    m, n = len(t), len(symptom)
    fs, ft = (np.array([f[i] for f in fixed], int) for i in (0, 1))
    fv = np.array([f[2] for f in fixed], float)
    src, dst = np.concatenate((source, fs)), np.concatenate((target, ft))
    place = {(int(x), int(y)): i for i, (x, y) in enumerate(zip(src, dst, strict=True))}
    back = np.array([place.get((int(y), int(x)), -1) for x, y in zip(src, dst, strict=True)], int)
    pair = np.flatnonzero(back >= 0)
    weight = np.zeros(n) if weight is None else weight
    centre = np.zeros(n) if centre is None else centre

    def gradient(c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate((c, fv))
        gc = np.zeros(len(every))
        gc[:m] += -2.4 * np.maximum(0, t - c) - 2.2 * np.maximum(0, a - c) + 1.6 * np.maximum(0, c - t) + 2.4 * np.maximum(0, c - a) + 0.5 * c
        if s is not None:
            gc[:m] += -2.0 * np.maximum(0, s - c) + 2.0 * np.maximum(0, k + c - 1)
        on = 3.2 * np.maximum(0, every + r[dst] - 1 - r[src])
        early = 1.6 * np.maximum(0, t + r[target] - 1 - c)
        gc += on
        gc[:m] -= early
        both = np.maximum(0, every[pair] + every[back[pair]] - 1)
        gc += np.bincount(pair, both, len(every)) + np.bincount(back[pair], both, len(every))
        gr = weight * (r - centre) + np.bincount(dst, on, n) - np.bincount(src, on, n) + np.bincount(target, early, n)
        return gc[:m], gr

    degree = np.bincount(np.concatenate((src, dst)), minlength=n).max() if len(src) else 1
    step = 1 / (12.0 + 5.0 * degree + weight.max(initial=0))
    c, r = (np.full(m, 0.5), np.where(symptom, 1.0, 0.5)) if start is None else start
    yc, yr, momentum = c.copy(), r.copy(), 1.0
    for _ in range(steps):
        gc, gr = gradient(yc, yr)
        nc = np.clip(yc - step * gc, 0, 1)
        nr = np.where(symptom, 1.0, np.clip(yr - step * gr, 0, 1))
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        moved = max(np.abs(nc - c).max(initial=0), np.abs(nr - r).max(initial=0))
        if ((nc - c) @ (yc - nc) + (nr - r) @ (yr - nr)) > 0:
            following = momentum = 1.0
        yc, yr = nc + (momentum - 1) / following * (nc - c), nr + (momentum - 1) / following * (nr - r)
        c, r, momentum = nc, nr, following
        if moved < least:
            break
    return c, r


def solve_global(t, a, s, k, source, target, fixed, symptom, steps: int = 4000) -> np.ndarray:
    """The causes of a whole case."""
    return minimise(t, a, s, k, source, target, fixed, symptom, steps=steps)[0]


def _edges(h: DataFrame, known: DataFrame, symptoms: DataFrame) -> DataFrame:
    """Hypotheses and visible labels (``v``, null for hypotheses), with whether their ends are symptoms."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    semantic = F.col("semantic_support").isNotNull()
    hyp = h.select("case_id", *PAIR, F.col("temporal_score").alias("t"), F.col("anomaly_score").alias("a"), number("semantic_support").alias("s"), number("semantic_contradiction").alias("k"), F.lit(None).cast("double").alias("v"), semantic.alias("semantic"))
    hard = known.filter(F.col("relation").isin(CAUSAL, NON_CAUSAL)).select("case_id", *PAIR, (F.col("relation") == CAUSAL).cast("double").alias("v")).distinct()
    hard = hard.join(h.select("case_id").distinct(), "case_id", "left_semi")
    e = hyp.unionByName(hard, allowMissingColumns=True)
    flag = lambda end: symptoms.select("case_id", F.col("node").alias(end)).distinct().withColumn(f"{end}_symptom", F.lit(True))
    for end in PAIR:
        e = e.join(flag(end), ["case_id", end], "left").withColumn(f"{end}_symptom", F.coalesce(f"{end}_symptom", F.lit(False)))
    return e


def _parts(e: DataFrame, part_edges: int) -> tuple[DataFrame, int]:
    """(one row per case and part: its edges in order, the nodes it shares in order; the most parts of a case)."""
    e = cut(e)
    cases = cut(e.groupBy("case_id").agg(F.ceil(F.count("*") / part_edges).cast("int").alias("n_parts"), F.coalesce(F.max("semantic"), F.lit(False)).alias("semantic")))
    most = cases.agg(F.coalesce(F.max("n_parts"), F.lit(0))).first()[0]
    e = e.drop("semantic").join(cases, "case_id")
    edge = F.struct(*PAIR, "t", "a", "s", "k", "v", *[f"{x}_symptom" for x in PAIR])
    if most <= 1:
        parts = e.groupBy("case_id", F.lit(0).alias("part"), "semantic").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
        return parts.withColumn("shared", F.array().cast("array<string>")), most
    # An edge and its reverse go together, by the lesser end; the edges of an end with very many are dealt by both.
    least, other = F.least(*PAIR), F.greatest(*PAIR)
    degree = e.groupBy("case_id", least.alias("_end")).agg(F.count("*").alias("_degree"))
    e = e.withColumn("_end", least).join(degree, ["case_id", "_end"])
    at = F.when(F.col("_degree") > part_edges, F.xxhash64(least, other)).otherwise(F.xxhash64(least))
    e = cut(e.withColumn("part", F.pmod(at, F.col("n_parts")).cast("int")).drop("_end", "_degree"))
    ends = e.select("case_id", "part", F.inline(F.array(*[F.struct(F.col(x).alias("node"), F.col(f"{x}_symptom").alias("symptom")) for x in PAIR]))).filter("NOT symptom").select("case_id", "part", "node").distinct()
    shared = ends.groupBy("case_id", "node").agg(F.collect_list("part").alias("parts")).filter(F.size("parts") > 1)
    shared = shared.select("case_id", "node", F.explode("parts").alias("part")).groupBy("case_id", "part").agg(F.array_sort(F.collect_list("node")).alias("shared"))
    parts = e.groupBy("case_id", "part", "semantic").agg(F.array_sort(F.collect_list(edge)).alias("edges")).join(shared, ["case_id", "part"], "left")
    return cut(parts.withColumn("shared", F.coalesce("shared", F.array().cast("array<string>")))), most


_STATE = "case_id string, part int, c array<double>, r array<double>, nodes array<string>, shared array<string>, sent array<double>, z array<double>, apart double"


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each part's minimum near the agreed values ``z``; ``sent`` is what its shared nodes bring to the next means."""
    for batch in batches:
        for row in batch.itertuples():
            edges, shared = list(row.edges), list(row.shared)
            nodes = sorted({x[end] for x in edges for end in PAIR})
            at = {x: i for i, x in enumerate(nodes)}
            symptom = np.zeros(len(nodes), bool)
            symptom[[at[x[end]] for x in edges for end in PAIR if x[f"{end}_symptom"]]] = True
            h = [x for x in edges if x["v"] is None]
            column = lambda c: np.array([x[c] for x in h], float)  # noqa: E731, B023
            ends = lambda c: np.array([at[x[c]] for x in h], int)  # noqa: E731, B023
            s, k = (column("s"), column("k")) if row.semantic else (None, None)
            fixed = [(at[x["source"]], at[x["target"]], x["v"]) for x in edges if x["v"] is not None]
            mine = np.array([at[x] for x in shared], int)
            centre, weight = np.zeros(len(nodes)), np.zeros(len(nodes))
            z = np.full(len(shared), 0.5) if row.z is None else np.asarray(row.z, float)
            u = np.zeros(len(shared)) if row.sent is None else np.asarray(row.sent, float) - z
            weight[mine], centre[mine] = AGREEMENT, z - u
            start = None if row.c is None else (np.asarray(row.c, float), np.asarray(row.r, float))
            c, r = minimise(column("t"), column("a"), s, k, ends("source"), ends("target"), fixed, symptom, centre, weight, start, least=1e-10 if shared else 1e-9)
            sent = RELAXED * r[mine] + (1 - RELAXED) * z + u
            before = z if row.was is None else np.asarray(row.was, float)
            apart = max(np.abs(r[mine] - z).max(initial=0), AGREEMENT * np.abs(z - before).max(initial=0))
            yield pd.DataFrame({"case_id": [row.case_id], "part": [row.part], "c": [c], "r": [r], "nodes": [nodes], "shared": [shared], "sent": [sent], "z": [z], "apart": [apart]})


def _agreed(state: DataFrame) -> DataFrame:
    """(case_id, part, new): means of what the parts sent for each shared node, within 0 and 1, in the order of ``shared``."""
    sent = state.select("case_id", "part", F.inline(F.arrays_zip(F.col("shared").alias("node"), F.col("sent").alias("x"))))
    means = sent.groupBy("case_id", "node").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("x"))).alias("z"), F.collect_list("part").alias("parts"))
    back = means.select("case_id", "node", "z", F.explode("parts").alias("part")).groupBy("case_id", "part").agg(F.array_sort(F.collect_list(F.struct("node", "z"))).alias("new"))
    return back.select("case_id", "part", F.transform("new", lambda x: x.z).alias("new"))


def infer(h: DataFrame, known: DataFrame, symptoms: DataFrame, part_edges: int = PART_EDGES, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(causes: case_id, source, target, y; reaches: case_id, node, y; the latter of nodes that are no symptoms)."""
    parts, most = _parts(_edges(h, known, symptoms), part_edges)
    nothing = lambda df, *names: df.withColumns({c: F.lit(None).cast("array<double>") for c in names})
    state = cut(nothing(parts, "c", "r", "sent", "z", "was").mapInPandas(_solved, _STATE))
    if most > 1:
        for _ in range(MOST_ROUNDS):
            key = ["case_id", "part"]
            before = state
            given = state.select(*key, "c", "r", "sent", F.col("z").alias("was")).join(_agreed(state), key, "left").withColumn("z", F.coalesce("new", F.array().cast("array<double>"))).drop("new")
            state = cut(parts.drop("c").join(given, key).mapInPandas(_solved, _STATE))
            spent(before)
            if state.agg(F.max("apart")).first()[0] < tolerance:
                break
        else:
            raise RuntimeError("the parts did not agree")
    edges = parts.select("case_id", "part", F.filter("edges", lambda x: x.v.isNull()).alias("h"))
    y = state.select("case_id", "part", "c").join(edges, ["case_id", "part"]).select("case_id", F.inline(F.zip_with("h", "c", lambda x, c: F.struct(x.source.alias("source"), x.target.alias("target"), c.alias("y")))))
    reach = state.select("case_id", F.inline(F.arrays_zip(F.col("nodes").alias("node"), F.col("r").alias("y")))).groupBy("case_id", "node").agg(F.avg("y").alias("y"))
    return y, reach.join(symptoms.select("case_id", "node"), ["case_id", "node"], "left_anti")


def psl(h: DataFrame, known: DataFrame, symptoms: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """Hypotheses with ``soft_logic_score`` from joint inference."""
    y, _ = infer(h, known, symptoms, part_edges)
    out = h.drop("soft_logic_score").join(y, ["case_id", *PAIR]).withColumn("soft_logic_score", F.col("y"))
    return out.select(*h.columns)


def residuals(h: DataFrame, known: DataFrame, symptoms: DataFrame, y: DataFrame, reach: DataFrame) -> DataFrame:
    """How far each variable is from optimal: (case_id, kind, source, target, residual), ``target`` null for reach.

    The residual is the change of the variable by a projected step against the
    gradient; all are 0 at the minimum, and nowhere else, for the loss is convex.
    """
    e = _edges(h, known, symptoms).join(y.withColumnRenamed("y", "_y"), ["case_id", *PAIR], "left").withColumn("y", F.coalesce("v", "_y"))
    for end in PAIR:
        e = e.join(reach.select("case_id", F.col("node").alias(end), F.col("y").alias(f"r_{end}")), ["case_id", end], "left")
        e = e.withColumn(f"r_{end}", F.when(F.col(f"{end}_symptom"), 1.0).otherwise(F.col(f"r_{end}")))
    cases = h.groupBy("case_id").agg(F.max(F.col("semantic_support").isNotNull()).alias("by_words"))
    e = cut(e.join(cases, "case_id"))
    plus = lambda x: F.greatest(F.lit(0.0), x)
    c, t, a = F.col("y"), F.col("t"), F.col("a")
    on = 3.2 * plus(c + F.col("r_target") - 1 - F.col("r_source"))
    early = F.when(F.col("v").isNull(), 1.6 * plus(t + F.col("r_target") - 1 - c)).otherwise(0.0)
    back = e.select("case_id", F.col("source").alias("target"), F.col("target").alias("source"), F.col("y").alias("y_back"))
    words = F.when(F.col("by_words"), -2.0 * plus(F.col("s") - c) + 2.0 * plus(F.col("k") + c - 1)).otherwise(0.0)
    slope = -2.4 * plus(t - c) - 2.2 * plus(a - c) + 1.6 * plus(c - t) + 2.4 * plus(c - a) + 0.5 * c + words + on - early + F.coalesce(2 * plus(c + F.col("y_back") - 1), F.lit(0.0))

    def residual(x: Column, g: Column) -> Column:
        return F.abs(x - F.greatest(F.lit(0.0), F.least(F.lit(1.0), x - g)))

    of_causes = e.filter("v IS NULL").join(back, ["case_id", *PAIR], "left").select("case_id", F.lit("cause").alias("kind"), *PAIR, residual(c, slope).alias("residual"))
    pulls = e.select("case_id", F.inline(F.array(F.struct(F.col("target").alias("node"), (on + early).alias("g")), F.struct(F.col("source").alias("node"), (-on).alias("g")))))
    of_nodes = pulls.groupBy("case_id", "node").agg(F.sum("g").alias("g")).join(reach, ["case_id", "node"])
    return of_causes.unionByName(of_nodes.select("case_id", F.lit("reach").alias("kind"), F.col("node").alias("source"), F.lit(None).cast("string").alias("target"), residual(F.col("y"), F.col("g")).alias("residual")))
