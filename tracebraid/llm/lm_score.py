"""Log-bilinear language model: trained by noise-contrastive estimation, scored with exact normalisation.

Counts of all words in all learning documents are exact.  Documents are dealt
into chunks by a hash; each chunk's distinct words travel as packed arrays to
hash ranges, are counted there across all chunks, and the counts travel back to
the chunk.  No vocabulary is broadcast but the ``CLASSES`` most frequent words.
All other words, the tail, are modelled where their hash range is.

The model predicts a token's class from the classes of the two tokens before:
``s(w | u, v) = b_w + r_w . (C1 r_v + C2 r_u)``.  All learning documents are read
once; documents are dealt to folds by a hash, every fold trains from common
parameters, and the results are averaged by their numbers of tokens, in ``ROUNDS``
rounds over disjoint parts of the documents.  So the model does not depend on how
files or tasks hold the documents.  As the context adds up, all bilinear scores
are two matrix products, and the normalisers of all contexts a third.

Classes are the frequent words, the end of a text, and ``TAIL`` classes of tail
words by their hash.  A tail word's probability is that of its class times that
within the class, which is log-bilinear too: each seen word has a bias and a vector
of its own that meets the context, the context being the sum of two of
``NEAR`` and ``FAR`` mean context vectors, those of the group of either class before.
The biases give a word the share of its count plus one, with one more for words
never seen; the vectors are one regularised Newton step from there over all
learning tokens.  A matrix product of the words of a piece of the hash space and all
contexts gives the normalisers, so the probabilities of all words and the end add
up to one.  The words grow with the corpus; each range has its own.

Cases: a null or empty text is only its end; texts of any length count whole;
repeated rows count repeatedly; a null doc_id counts as held in; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import written
from .text import Words, text_chunks

#: Frequent words that are classes of their own; numbers of a class's vector.
CLASSES, WIDTH = 1_500, 24
#: Classes of tail words, at most; strength of the prior of a tail word's vector.
TAIL, PRIOR = 64, 24.0
#: Groups of classes as contexts of tail words: of the class before, and of the one before that.
NEAR, FAR = 16, 4
#: Noise classes of a step (shared by its tokens), distinct tokens of a step, step size, rounds.
NOISE, STEP, RATE, ROUNDS = 48, 4096, 0.08, 2
#: Text bytes of a training fold, about; it sees a part of them in each round.
FOLD_BYTES = 32 << 20
#: Text bytes of a chunk; distinct words of a hash range, about.
CHUNK, RANGE_WORDS = 8 << 20, 1_000_000
FOLDS, HELD_OUT = 7, 2


def _chunk_words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and first positions, for runs of texts."""
    batch = pa.record_batch({"text": pa.array(texts, pa.binary())})
    for _, part in text_chunks(batch, "text"):
        w = Words([t.lower() for t in part])
        yield w.hashes, w.first


def _ranges_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins among sorted hashes."""
    where = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(where, np.arange(ranges + 1, dtype=np.uint64))


def _count_chunk(key: tuple, table: pa.Table, ranges: int) -> pa.Table:
    texts = [t or b"" for t in table.column("text").to_pylist()]
    learn = ~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
    words, weights, row = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], 0
    for h, first in _chunk_words(texts):
        size = np.diff(first)
        words.append(h)
        weights.append(np.repeat(learn[row : row + len(size)], size))
        row += len(size)
    distinct, back = np.unique(np.concatenate(words), return_inverse=True)
    count = np.bincount(back, np.concatenate(weights), len(distinct)).astype(np.uint32)
    cuts = _ranges_of(distinct, ranges)
    used = [r for r in range(ranges) if cuts[r] < cuts[r + 1]]
    return pa.table(
        {
            "range": pa.array(used, pa.int64()),
            "chunk": pa.array([key[0].as_py()] * len(used), pa.int64()),
            "words": pa.array([distinct[cuts[r] : cuts[r + 1]].tobytes() for r in used], pa.binary()),
            "counts": pa.array([count[cuts[r] : cuts[r + 1]].tobytes() for r in used], pa.binary()),
        }
    )


def pieces_of(ranges: int) -> tuple[int, int, int]:
    """Numbers of ranges, of tail classes, and of the pieces that are parts of both."""
    if ranges <= TAIL:
        pieces = ranges * (TAIL // ranges)
        return ranges, pieces, pieces
    ranges = -(-ranges // TAIL) * TAIL
    return ranges, TAIL, ranges


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _count_range(key: tuple, table: pa.Table, classes: int, ranges: int, pieces: int) -> pa.Table:
    """Back to each chunk its words' total counts; and (chunk -1) the range's totals, by pieces too, and most frequent words."""
    words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
    counts = [np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]
    distinct, back = np.unique(np.concatenate(words), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, back, np.concatenate(counts).astype(np.int64))
    top = np.lexsort((distinct, -total))[:classes]
    top = top[total[top] > 0]
    got = total[back].astype(np.uint64)
    at = np.cumsum([0, *map(len, words)])
    n = len(words)
    each = pieces // ranges
    piece = _part_of(distinct, pieces) - key[0].as_py() * each
    by_piece = np.stack([np.bincount(piece, total, each), np.bincount(piece, total > 0, each)]).astype(np.int64)
    return pa.table(
        {
            "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int64()),
            "range": pa.array([key[0].as_py()] * (n + 1), pa.int64()),
            "totals": pa.array([*(got[at[i] : at[i + 1]].tobytes() for i in range(n)), None], pa.binary()),
            "distinct": pa.array([0] * n + [int((total > 0).sum())], pa.int64()),
            "tokens": pa.array([0] * n + [int(total.sum())], pa.int64()),
            "pieces": pa.array([None] * n + [by_piece.tobytes()], pa.binary()),
            "top": pa.array([None] * n + [np.stack([distinct[top].view(np.int64), total[top]], 1).tolist()], pa.list_(pa.list_(pa.int64()))),
        }
    )


class Vocabulary:
    """The frequent words and the totals; class ``n`` is the end, those from ``n + 1`` on are tail words.

    ``pieces`` are tokens and distinct words by hash piece, frequent words included.
    """

    def __init__(self, top: list[tuple[int, int]], distinct: int, tokens: int, texts: int, pieces: np.ndarray | None = None, tails: int = 1):
        words = np.array([t[0] for t in top], np.int64).view(np.uint64)
        order = np.argsort(words)
        self.words = words[order]
        self.counts = np.array([t[1] for t in top], np.int64)[order]
        self.end, self.other, self.tails = len(words), len(words) + 1, tails
        self.distinct, self.tokens, self.texts = distinct + (texts > 0), tokens + texts, texts
        pieces = np.array([[tokens], [distinct]]) if pieces is None else pieces
        self.pieces = pieces.shape[1]
        where = _part_of(self.words, self.pieces)
        left = pieces - np.stack([np.bincount(where, w, self.pieces) for w in (self.counts, np.ones(len(words)))]).astype(np.int64)
        tail_tokens = left[0].reshape(tails, -1).sum(axis=1)
        # Of a tail word by its class: a piece's weight, and that of all with one for words never seen.
        self.weights = left.sum(axis=0).astype(np.float64)
        self.class_weights = self.weights.reshape(tails, -1).sum(axis=1) + 1
        shares = np.array([*self.counts, texts, *tail_tokens], np.float64) + 1
        self.shares = shares / shares.sum()

    @property
    def size(self) -> int:
        return self.other + self.tails

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        tail = self.other + _part_of(hashes, self.tails)
        if not len(self.words):
            return tail
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, tail)

    def tokens_of(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of all texts' tokens with their ends, the places of the words, and the places of the ends."""
        size = np.diff(first)
        ends = np.cumsum(size + 1) - 1
        places = np.arange(len(hashes)) + np.repeat(np.arange(len(size)), size)
        out = np.full(len(hashes) + len(size), self.end)
        out[places] = self.classes(hashes)
        return out, places, ends


def contexts(tokens: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before each token; before a text stand ends."""
    one = np.concatenate(([end], tokens[:-1])) if len(tokens) else tokens
    two = np.concatenate(([end], one[:-1])) if len(tokens) else tokens
    begins = np.concatenate(([0], ends[:-1] + 1))
    two = two.copy()
    two[begins] = end
    second = begins + 1
    two[second[second < len(two)]] = end
    return one, two


class LogBilinear:
    """Parameters as one flat array, for averaging."""

    def __init__(self, classes: int, flat: np.ndarray | None = None, shares: np.ndarray | None = None):
        self.n = classes
        if flat is None:
            rng = np.random.default_rng(3)
            r = rng.normal(0, 0.3, (classes, WIDTH))
            flat = np.concatenate((r.ravel(), np.eye(WIDTH).ravel() * 0.1, np.eye(WIDTH).ravel() * 0.1, np.log(shares)))
        self.flat = flat.astype(np.float32)
        a, b = classes * WIDTH, WIDTH * WIDTH
        self.r = self.flat[:a].reshape(classes, WIDTH)
        self.c1, self.c2 = (self.flat[a + i * b : a + (i + 1) * b].reshape(WIDTH, WIDTH) for i in (0, 1))
        self.b = self.flat[a + 2 * b :]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 scores by (previous class, class) and (class before it, class), and log10 normalisers by both contexts."""
        one, two = (np.clip(self.r @ c.T @ self.r.T, -20, 20) for c in (self.c1, self.c2))
        z = np.exp(one + self.b).astype(np.float64) @ np.exp(two).astype(np.float64).T
        scale = 1 / np.log(10)
        return ((one + self.b) * scale).astype(np.float32), (two * scale).astype(np.float32), (np.log10(z)).astype(np.float32)


    def context_tables(self, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By previous class and class before it, parts of a context's vector, whose coordinates are brought to mean 0 and variance 1."""
        parts = [(self.r @ c.T).astype(np.float64) for c in (self.c1, self.c2)]
        parts = [x - shares @ x for x in parts]
        values, vectors = np.linalg.eigh(sum((x * shares[:, None]).T @ x for x in parts))
        scale = vectors / np.sqrt(np.maximum(values, max(values.max() * 1e-3, 1e-12)))
        return tuple((x @ scale).astype(np.float32) for x in parts)


def grouped_contexts(model: LogBilinear, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By class, its number as the near and as the far context of a tail word; and the context vectors by the sum of both."""
    groups, means = zip(*(_k_means(x, shares, k) for x, k in zip(model.context_tables(shares), (NEAR, FAR), strict=True)), strict=True)
    vectors = (means[0][:, None] + means[1][None]).reshape(-1, WIDTH)
    return (groups[0] * len(means[1])).astype(np.uint8), groups[1].astype(np.uint8), vectors.astype(np.float32)


def _k_means(x: np.ndarray, shares: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row and the groups' means, weighted by ``shares``."""
    rng = np.random.default_rng(5)
    x = x.astype(np.float64)
    means = x[rng.choice(len(x), min(k, len(x)), replace=False, p=shares)]
    for _ in range(rounds):
        group = ((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        weight = np.bincount(group, shares, len(means))
        total = np.stack([np.bincount(group, shares * c, len(means)) for c in x.T], 1)
        means = np.where(weight[:, None] > 0, total / np.maximum(weight, 1e-300)[:, None], means)
    return group, means


def tail_scores(counts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """log10 probabilities of one piece's words (rows) in every context (columns), from the words' counts by context.

    Words without a count have none (minus infinity); those of the others add up to one.
    """
    total = counts.sum(axis=1, dtype=np.float64)
    sums = counts @ vectors
    mean = sums.sum(axis=0) / max(1.0, total.sum())
    r = (sums - total[:, None] * mean) / (PRIOR + total)[:, None]
    with np.errstate(divide="ignore"):
        scores = np.where(total > 0, np.log(total + 1), -np.inf)[:, None] + r @ vectors.T.astype(np.float64)
    top = scores.max(axis=0)
    scores -= top + np.log(np.exp(scores - top).sum(axis=0))
    return (scores / np.log(10)).astype(np.float32)


class Trainer:
    """Noise-contrastive steps over distinct (context, token) triples, weighted by their counts."""

    def __init__(self, model: LogBilinear, shares: np.ndarray, seed: int):
        self.m, self.log_noise = model, np.log(NOISE * shares).astype(np.float32)
        self.shares, self.rng = shares, np.random.default_rng(seed)
        self.squares = np.full(len(model.flat), 1e-8, np.float32)
        self.seen = 0

    def learn(self, tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        self.seen += len(tokens)
        n = self.m.n
        codes, counts = np.unique((two.astype(np.int64) * n + one) * n + tokens, return_counts=True)
        order = self.rng.permutation(len(codes))
        codes, counts = codes[order], counts[order].astype(np.float32)
        for i in range(0, len(codes), STEP):
            c = codes[i : i + STEP]
            self.step(c // (n * n), c // n % n, c % n, counts[i : i + STEP])

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, weight: np.ndarray) -> None:
        m = self.m
        weight = weight / weight.sum()
        noise = self.rng.choice(m.n, NOISE, p=self.shares)
        ru, rv, rw, rn = m.r[u], m.r[v], m.r[w], m.r[noise]
        q = rv @ m.c1.T + ru @ m.c2.T
        real = (q * rw).sum(axis=1) + m.b[w] - self.log_noise[w]
        fake = q @ rn.T + m.b[noise] - self.log_noise[noise]
        g = weight / (1 + np.exp(np.clip(real, -30, 30)))
        h = -weight[:, None] / (1 + np.exp(np.clip(-fake, -30, 30)))
        dq = g[:, None] * rw + h @ rn
        grad = np.zeros_like(m.flat)
        into = LogBilinear(m.n, grad)
        grad = into.flat
        rows = np.concatenate((w, noise, v, u))
        values = np.concatenate((g[:, None] * q, h.T @ q, dq @ m.c1, dq @ m.c2))
        for k in range(WIDTH):
            into.r[:, k] = np.bincount(rows, values[:, k], m.n)
        into.c1[:] = dq.T @ rv
        into.c2[:] = dq.T @ ru
        into.b[:] = np.bincount(w, g, m.n) + np.bincount(noise, h.sum(axis=0), m.n)
        self.squares += grad * grad
        m.flat += RATE * grad / np.sqrt(self.squares)


#: A model comes in so many rows.
SLICES = 16


def _train_fold(key: tuple, table: pa.Table, flat: np.ndarray, vocabulary: Vocabulary) -> pa.Table:
    """The model that a fold's documents give, from ``flat``."""
    table = table.sort_by([("h", "ascending"), ("text", "ascending")])
    model = LogBilinear(vocabulary.size, flat.copy())
    trainer = Trainer(model, vocabulary.shares, int(key[0].as_py()))
    for batch in table.select(["text"]).combine_chunks().to_batches():
        for _, texts in text_chunks(batch, "text"):
            w = Words([t.lower() for t in texts])
            tokens, _, ends = vocabulary.tokens_of(w.hashes, w.first)
            trainer.learn(tokens, *contexts(tokens, ends, vocabulary.end))
    parts = [s.tobytes() for s in np.array_split(model.flat, SLICES)]
    return pa.table({"slice": pa.array(range(SLICES), pa.int64()), "fold": pa.array([key[0].as_py()] * SLICES, pa.int64()), "tokens": pa.array([trainer.seen] * SLICES, pa.int64()), "params": pa.array(parts, pa.binary())})


def _averaged(key: tuple, table: pa.Table) -> pa.Table:
    """The mean of some models' slice, by their tokens, in order of their folds."""
    table = table.sort_by("fold")
    weight = table.column("tokens").to_numpy().astype(np.float64)
    total = sum(w * np.frombuffer(x.as_py(), np.float32) for w, x in zip(weight / weight.sum(), table.column("params"), strict=True))
    one = {"slice": key[0].as_py(), "fold": table.column("fold")[0].as_py(), "tokens": int(weight.sum()), "params": total.astype(np.float32).tobytes()}
    return pa.Table.from_pylist([one], schema=table.schema)


def _fold_trainer(held):
    return lambda key, table: _train_fold(key, table, *held.value)


MODEL_ROWS = "slice long, fold long, tokens long, params binary"


def train(learning: DataFrame, vocabulary: Vocabulary, folds: int) -> LogBilinear:
    """Average the folds' models, round by round; ``learning`` has doc_id and text."""
    flat = LogBilinear(vocabulary.size, shares=vocabulary.shares).flat
    h = F.xxhash64("doc_id", "text")
    dealt = learning.select("doc_id", "text", h.alias("h"), F.pmod(F.xxhash64(h, F.lit("fold")), F.lit(folds)).alias("fold"))
    for k in range(ROUNDS):
        part = dealt.filter(F.pmod(F.xxhash64("h", F.lit("round")), F.lit(ROUNDS)) == k).select("fold", "h", "text")
        held = learning.sparkSession.sparkContext.broadcast((flat, vocabulary))
        models = part.groupBy("fold").applyInArrow(_fold_trainer(held), MODEL_ROWS)
        # In two steps, so that no task gathers the models of all others.
        some = models.groupBy("slice", (F.col("fold") % 64).alias("some")).applyInArrow(lambda key, t: _averaged(key, t.select(["slice", "fold", "tokens", "params"])), MODEL_ROWS)
        got = some.groupBy("slice").applyInArrow(_averaged, MODEL_ROWS).collect()
        if got:
            flat = np.concatenate([np.frombuffer(r["params"], np.float32) for r in sorted(got)])
    return LogBilinear(vocabulary.size, flat)


def _score_chunk(docs: pa.Table, totals: pa.Table, ranges: int, vocabulary: Vocabulary, tables: tuple, near: np.ndarray, far_context: np.ndarray) -> pa.Table:
    """A row per document, with the scores of its tokens' classes; and a row per range with the tail's tokens, in order of their words."""
    one_table, two_table, z = tables
    texts = [t or b"" for t in docs.column("text").to_pylist()]
    chunk = docs.column("chunk")[0].as_py() if len(texts) else 0
    parts = list(_chunk_words(texts))
    distinct = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)]))
    count = np.zeros(len(distinct), np.int64)
    cuts = _ranges_of(distinct, ranges)
    for r, x in zip(totals.column("range").to_pylist(), totals.column("totals").to_pylist(), strict=True):
        count[cuts[r] : cuts[r + 1]] = np.frombuffer(x, np.uint64)
    out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
    tail, row = [(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint32))], 0
    base_n = np.log10(vocabulary.tokens + vocabulary.distinct + 1)
    for h, first in parts:
        c = count[np.searchsorted(distinct, h)]
        tokens, places, ends = vocabulary.tokens_of(h, first)
        one, two = contexts(tokens, ends, vocabulary.end)
        score = one_table[one, tokens] + two_table[two, tokens].astype(np.float64) - z[one, two]
        each = np.full(len(tokens), vocabulary.texts, np.int64)
        each[places] = c
        base = np.log10(each + 1.0)
        begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        n = np.diff(first) + 1
        far = tokens[places] >= vocabulary.other
        at = places[far]
        tail.append((h[far], near[one[at]] + far_context[two[at]], np.repeat(np.arange(row, row + len(n), dtype=np.uint32), n - 1)[far]))
        row += len(n)
        out["n_tokens"].append(n)
        out["n_known"].append(np.add.reduceat((each > 0).astype(np.int64), begins))
        out["base_score"].append(np.add.reduceat(base, begins) - n * base_n)
        out["score"].append(np.add.reduceat(score, begins))
    rows = pa.table({"chunk": docs.column("chunk"), "doc": pa.array(np.arange(row, dtype=np.int64)), "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), **{k: np.concatenate(v) for k, v in out.items()}})
    words, context, doc = (np.concatenate(x) for x in zip(*tail, strict=True))
    learn = ~docs.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
    order = np.argsort(words, kind="stable")
    words, context, doc = words[order], context[order], doc[order]
    cuts = _ranges_of(words, ranges)
    packed: dict[str, list] = {k: [] for k in ("range", "words", "sizes", "contexts", "docs", "learn")}
    for r in range(ranges):
        part = slice(cuts[r], cuts[r + 1])
        if part.start < part.stop:
            own, sizes = np.unique(words[part], return_counts=True)
            values = (r, own, sizes.astype(np.uint32), context[part], doc[part], np.packbits(learn[doc[part]]))
            for k, v in zip(packed, values, strict=True):
                packed[k].append(v if k == "range" else v.tobytes())
    tails = pa.table({"chunk": pa.array([chunk] * len(packed["range"]), pa.int64()), **{k: pa.array(v, pa.int64() if k == "range" else pa.binary()) for k, v in packed.items()}})
    return pa.concat_tables([rows, tails], promote_options="default").select(SCORED_COLUMNS)


SCORED = (
    "chunk long, doc long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
    "range long, words binary, sizes binary, contexts binary, docs binary, learn binary"
)
SCORED_COLUMNS = [x.split()[0] for x in SCORED.split(", ")]


def _tail_range(key: tuple, table: pa.Table, vocabulary: Vocabulary, vectors: np.ndarray) -> pa.Table:
    """Learn the vectors of a range's words from all chunks, then give each chunk its documents' scores of them."""
    kinds = {"words": np.uint64, "sizes": np.uint32, "contexts": np.uint8, "docs": np.uint32, "learn": np.uint8}
    columns = {k: [np.frombuffer(x.as_buffer(), t) for x in table.column(k)] for k, t in kinds.items()}
    rows = list(zip(*columns.values(), strict=True))
    distinct = np.unique(np.concatenate(columns["words"]))
    width = len(vectors)
    counts = np.zeros(len(distinct) * width, np.float32)
    for words, sizes, context, _, bits in rows:
        cells = np.repeat(np.searchsorted(distinct, words), sizes) * width + context
        cells, n = np.unique(cells[np.unpackbits(bits, count=len(context)).astype(bool)], return_counts=True)
        counts[cells] += n
    counts = counts.reshape(-1, width)
    seen = counts.any(axis=1)
    piece = _part_of(distinct, vocabulary.pieces)
    unseen = -np.log10(vocabulary.class_weights)[piece // (vocabulary.pieces // vocabulary.tails)]
    # The counts make way for the scores, piece by piece.
    for p, a, b in zip(*_runs(piece), strict=True):
        if seen[a:b].any():
            counts[a:b] = tail_scores(counts[a:b], vectors) + np.log10(vocabulary.weights[p])
    scores = np.where(seen[:, None], counts, np.float32(0)).ravel()
    out_docs, out_scores = [], []
    for words, sizes, context, docs, _ in rows:
        at = np.repeat(np.searchsorted(distinct, words), sizes)
        own, back = np.unique(docs, return_inverse=True)
        out_docs.append(own.tobytes())
        out_scores.append(np.bincount(back, unseen[at] + scores[at * width + context]).astype(np.float32).tobytes())
    return pa.table({"chunk": table.column("chunk"), "docs": pa.array(out_docs, pa.binary()), "scores": pa.array(out_scores, pa.binary())})


def _runs(sorted_values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Each value, and where it begins and ends."""
    values, begins = np.unique(sorted_values, return_index=True)
    return values.tolist(), begins.tolist(), [*begins[1:].tolist(), len(sorted_values)]


def _add_tails(docs: pa.Table, tails: pa.Table) -> pa.Table:
    score, doc = docs.column("score").to_numpy().copy(), docs.column("doc").to_numpy()
    more = np.zeros(int(doc.max(initial=-1)) + 1)
    for d, x in zip(tails.column("docs"), tails.column("scores"), strict=True):
        more[np.frombuffer(d.as_buffer(), np.uint32)] += np.frombuffer(x.as_buffer(), np.float32)
    out = docs.select(["doc_id", "held_out", "n_tokens", "n_known", "base_score"])
    return out.append_column("score", pa.array(score + more[doc]))


def score_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    row = docs.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    size, texts = int(row[0] or 0), int(row[1])
    chunks = max(spark.sparkContext.defaultParallelism, -(-size // CHUNK))
    ranges, tails, pieces = pieces_of(max(8, -(-size // (40 * RANGE_WORDS))))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    packed = dealt.groupBy("chunk").applyInArrow(lambda k, t: _count_chunk(k, t, ranges), "range long, chunk long, words binary, counts binary")
    counted = packed.groupBy("range").applyInArrow(
        lambda k, t: _count_range(k, t, CLASSES, ranges, pieces),
        "chunk long, range long, totals binary, distinct long, tokens long, pieces binary, top array<array<bigint>>",
    )
    counted = written(counted, "word-counts")
    heads = counted.filter("chunk = -1")
    sums = heads.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    top = heads.select(F.explode("top").alias("t")).select(F.get("t", F.lit(0)).alias("word"), F.get("t", F.lit(1)).alias("n"))
    top = top.orderBy(F.desc("n"), "word").limit(CLASSES).collect()
    by_piece = np.zeros((2, pieces), np.int64)
    for r in heads.select("range", "pieces").collect():
        each = pieces // ranges
        by_piece[:, r["range"] * each : (r["range"] + 1) * each] = np.frombuffer(r["pieces"], np.int64).reshape(2, each)
    vocabulary = Vocabulary([(r["word"], r["n"]) for r in top], int(sums[0]), int(sums[1]), texts, by_piece, tails)
    model = train(docs.filter("NOT held_out"), vocabulary, max(4, -(-size // FOLD_BYTES)))
    near, far, vectors = grouped_contexts(model, vocabulary.shares)
    held = spark.sparkContext.broadcast((vocabulary, model.tables(), near, far))
    of_tail = spark.sparkContext.broadcast((vocabulary, vectors))
    scored = (
        dealt.groupBy("chunk")
        .cogroup(counted.filter("chunk >= 0").select("chunk", "range", "totals").groupBy("chunk"))
        .applyInArrow(lambda d, t: _score_chunk(d, t, ranges, *held.value), SCORED)
    )
    scored = written(scored, "class-scores")
    tail = scored.filter("range IS NOT NULL").select("range", "chunk", "words", "sizes", "contexts", "docs", "learn")
    tail = tail.groupBy("range").applyInArrow(lambda k, t: _tail_range(k, t, *of_tail.value), "chunk long, docs binary, scores binary")
    rows = scored.filter("range IS NULL").select("chunk", "doc", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")
    scored = (
        rows.groupBy("chunk")
        .cogroup(tail.groupBy("chunk"))
        .applyInArrow(_add_tails, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_score(documents: DataFrame) -> DataFrame:
    return score_documents(documents)
