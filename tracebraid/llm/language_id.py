"""Language identification of every word by a linear-chain conditional random field.

A word's features are hashed: its affixes of up to four characters' bytes with
the word's edges, the two- and three-byte sequences inside it, and the word itself
(the lexicon).  Weights per language add up to the word's emission; transitions
between the languages of neighbouring words are learned with them, on sequences
that switch between documents of different languages.  Forward-backward over
the whole text gives each word's language probabilities; a document's language
is the one with the largest sum, its score the mean probability.

Training reads at most ``LEARNED_DOCS`` documents of all languages together (but
one of each language at least) and ``LEARNED_PER_LANGUAGE`` of one, the first by a
hash within each language in the learning folds.  A text above ``LEARNED_BYTES`` is
only learned from where its language has no other.  One task trains on them.

Cases: a null text and one without a letter is ``und`` with score 0; texts of any
length are one chain; a null lang teaches nothing, and neither does a row with a
null doc_id, which is not held out; if no language is known, every text is
``und``; of languages that do equally well the first by name is taken; repeated rows
get equal results; other columns are ignored by the query and carried along by
``tag_documents``, where ``lang_pred`` and ``score`` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .quality_classifier import HELD_OUT, fold
from .store import bounded_broadcast, written
from .text import CHUNK_BYTES, Words, mix

BITS = 16
#: Documents that training reads at most, of all languages and of one, and the bytes of one.
LEARNED_DOCS, LEARNED_PER_LANGUAGE, LEARNED_BYTES = 2_400, 400, 1 << 17
#: Sequences per step, their words, steps, step size.
BATCH, LENGTH, STEPS, RATE = 64, 40, 300, 0.3
#: Probability that a training sequence switches its language at a word.
SWITCH = 0.08

_KINDS = 8


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words in a row and where each word's begin (no word is empty)."""
    a = np.frombuffer(b"  " + b"  ".join(words) + b"    ", np.uint8).astype(np.uint64)
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(np.concatenate(([2], size[:-1] + 2))) if len(words) else np.zeros(0, np.int64)
    # Sequences by their middle byte, inside the word and over its edges.
    n = len(a)
    two = a[: n - 3] | a[1 : n - 2] << np.uint64(8)
    three = two | a[2 : n - 1] << np.uint64(16)
    four = three | a[3:] << np.uint64(24)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    mask = np.uint64((1 << BITS) - 1)
    number = lambda x, kind: (mix(x * np.uint64(_KINDS) + np.uint64(kind)) & mask).astype(np.int64)
    found = [number(two[within], 1), number(three[within - 1], 2)]
    owner = [np.repeat(np.arange(len(words)), size)] * 2
    lexicon = Words([b" ".join(words)]).hashes if words else np.zeros(0, np.uint64)
    each = np.arange(len(words))
    for kind, x in ((3, four[first - 1]), (4, four[first + size - 3]), (5, three[first]), (6, three[first + size - 3]), (7, lexicon)):
        found.append(number(x, kind))
        owner.append(each)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(owner[order], each)


def messages(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: its emission factors, and the forward and backward messages, each row scaled to sum to 1.

    Chain ``i`` is ``emission[first[i]:first[i + 1]]``.  All chains move one word a
    step; they are ordered by length, so that those still running are the first ones.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    e = np.exp(emission - emission.max(axis=1, keepdims=True)) if len(emission) else emission
    move, away = np.exp(transition), np.exp(start)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    running = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    state = None
    for t, k in enumerate(running):
        at = begin[:k] + t
        state = (away if t == 0 else state[:k] @ move) * e[at]
        state = state / state.sum(axis=1, keepdims=True)
        alpha[at] = state
    for t in range(len(running) - 2, -1, -1):
        k = running[t + 1]
        after = begin[:k] + t + 1
        state = (e[after] * beta[after]) @ move.T
        beta[after - 1] = state / state.sum(axis=1, keepdims=True)
    return e, alpha, beta


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of every word."""
    _, alpha, beta = messages(emission, first, transition, start)
    out = alpha * beta
    return out / out.sum(axis=1, keepdims=True)


def gradients(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the log-likelihood of ``labels``, by emission, transition and start."""
    e, alpha, beta = messages(emission, first, transition, start)
    p = alpha * beta
    by_word = -p / p.sum(axis=1, keepdims=True)
    by_word[np.arange(len(labels)), labels] += 1
    # A word with its predecessor in the same chain.
    begins = first[:-1][np.diff(first) > 0]
    inner = np.delete(np.arange(len(labels)), begins)
    pair = alpha[inner - 1][:, :, None] * np.exp(transition)[None] * (e[inner] * beta[inner])[:, None, :]
    by_move = -(pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    np.add.at(by_move, (labels[inner - 1], labels[inner]), 1)
    return by_word, by_move, by_word[begins].sum(axis=0)


class Tagger:
    """The trained field: languages, emission weights, transitions."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        k = len(languages)
        self.weights = np.zeros((1 << BITS, k), np.float32)
        self.transition, self.start = np.zeros((k, k)), np.zeros(k)

    def emissions(self, words: Words) -> np.ndarray:
        distinct, where, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        found, first = word_features([words.data[a:b] for a, b in zip(words.starts[where].tolist(), words.ends[where].tolist(), strict=True)])
        if not len(distinct):
            return np.zeros((0, len(self.languages)))
        return np.add.reduceat(self.weights[found], first, axis=0).astype(np.float64)[back]

    def train(self, docs: list[tuple[str, bytes]]) -> None:
        """Gradient steps on the log-likelihood of sequences that switch between documents."""
        rng = np.random.default_rng(11)
        k = len(self.languages)
        number = {x: i for i, x in enumerate(self.languages)}
        by = [[] for _ in range(k)]
        for lang, text in docs:
            if w := text.split():
                by[number[lang]].append(w)
        have = [i for i in range(k) if by[i]]
        squares = np.full((1 << BITS, k), 1e-2, np.float32)
        grown = [np.full((k, k), 1e-1), np.full(k, 1e-1)]
        for _ in range(STEPS if have else 0):
            words: list[bytes] = []
            labels: list[int] = []
            for _ in range(BATCH):
                end = len(words) + LENGTH
                while len(words) < end:
                    lang = have[rng.integers(len(have))]
                    doc = by[lang][rng.integers(len(by[lang]))]
                    at = int(rng.integers(len(doc)))
                    part = doc[at : at + min(int(rng.geometric(SWITCH)), end - len(words))]
                    words += part
                    labels += [lang] * len(part)
            y = np.array(labels)
            found, first = word_features(words)
            emission = np.add.reduceat(self.weights[found], first, axis=0).astype(np.float64)
            chains = np.arange(0, len(words) + 1, LENGTH)
            gradient, moves, starts = gradients(emission, chains, self.transition, self.start, y)
            each = np.repeat(np.arange(len(words)), np.diff(np.append(first, len(found))))
            add = np.stack([np.bincount(found, gradient[each, c], 1 << BITS) for c in range(k)], 1).astype(np.float32)
            squares += add * add
            self.weights += RATE * add / np.sqrt(squares)
            for value, step, total in ((self.transition, moves, grown[0]), (self.start, starts, grown[1])):
                total += step * step
                value += 0.1 * step / np.sqrt(total)

    def tag(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text: the sum of its words' probabilities and their number; texts are lower-cased."""
        words = Words(texts)
        p = marginals(self.emissions(words), words.first, self.transition, self.start)
        total = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(p, axis=0)))
        return zip(total[words.first[1:]] - total[words.first[:-1]], np.diff(words.first), strict=True)

    def label_words(self, text: str) -> list[tuple[str, str, float]]:
        """Every word of one (code-switched) text with its language and probability."""
        own, words = Words([text.encode()]), Words([text.lower().encode()])
        p = marginals(self.emissions(words), words.first, self.transition, self.start)
        spelled = [own.data[a:b].decode() for a, b in zip(own.starts.tolist(), own.ends.tolist(), strict=True)]
        return [(w, self.languages[int(x.argmax())], float(x.max())) for w, x in zip(spelled, p, strict=True)]


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the languages, and the field that their documents (lang, text) give."""
    docs = [(r["lang"], r["text"]) for batch in batches for r in batch.to_pylist()]
    if docs:
        tagger = Tagger(sorted({lang for lang, _ in docs}))
        tagger.train(docs)
        yield pa.RecordBatch.from_pydict({"languages": [tagger.languages], "weights": [tagger.weights.tobytes()], "moves": [np.vstack((tagger.transition, tagger.start)).tobytes()]})


def train(documents: DataFrame, docs: int = LEARNED_DOCS, most: int = LEARNED_PER_LANGUAGE, most_bytes: int = LEARNED_BYTES) -> Tagger:
    """A tagger learned from documents with a language outside the held-out fold."""
    known = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != HELD_OUT))
    known = known.select("lang", F.lower("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text", F.lit("lang")).alias("h"))
    long = F.octet_length("text") > most_bytes
    least = lambda c: F.min(F.when(c, F.pmod("h", F.lit(1 << 40))))
    counts = written(known.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~long).alias("short"), F.coalesce(least(~long), least(long)).alias("least")), "languages")
    share = max(1, min(most, docs // max(1, counts.count())))
    # By the hash about twice as many as are wanted come first, so that no language has many rows in one place;
    # the row of the smallest hash always comes, so that hashes that lie close together lose no language.
    enough = F.when(F.col("short") > 0, F.col("short")).otherwise(F.col("n"))
    known = known.join(bounded_broadcast(counts.withColumnRenamed("lang", "of")), F.col("lang") == F.col("of"))
    known = known.filter(~long | (F.col("short") == 0)).filter((F.pmod("h", F.lit(1 << 40)) * enough < float(1 << 40) * (2 * share + 40)) | (F.pmod("h", F.lit(1 << 40)) == F.col("least")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    chosen = known.withColumn("place", place).filter((F.col("place") <= share) & (~long | (F.col("place") == 1)))
    one = chosen.select("h", "lang", "text").repartition(1).sortWithinPartitions("h", "lang", "text").select("lang", "text")
    got = one.mapInArrow(_trained, "languages array<string>, weights binary, moves binary").first()
    if got is None:
        return Tagger([])
    tagger = Tagger(got["languages"])
    k = len(tagger.languages)
    tagger.weights = np.frombuffer(got["weights"], np.float32).reshape(-1, k)
    moves = np.frombuffer(got["moves"]).reshape(k + 1, k)
    tagger.transition, tagger.start = moves[:k], moves[k]
    return tagger


def tag_documents(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """The documents with ``lang_pred`` and ``score``, which replace columns of these names."""
    held = documents.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf("lang_pred string, score double")
    def tagged(texts: pd.Series) -> pd.DataFrame:
        model = held.value
        out: list[tuple[str, float]] = []
        rows, size = [], 0
        for i, t in enumerate(texts):
            rows.append(bytes(t) if t is not None else b"")
            size += len(rows[-1])
            if size >= CHUNK_BYTES or i == len(texts) - 1:
                for total, n in model.tag(rows):
                    best = int(total.argmax())
                    out.append((model.languages[best], float(min(1.0, total[best] / n))) if n else ("und", 0.0))
                rows, size = [], 0
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    kept = [F.col(f"`{c}`") for c in documents.columns if c not in ("lang_pred", "score")]
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    und = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    got = F.when(letters, tagged(F.when(letters, F.lower("text").cast("binary")))).otherwise(und) if tagger.languages else und
    tag = documents.select(F.struct(*kept, F.lit(0).alias("_")).alias("row"), got.alias("tag"))
    return tag.select(*[F.col(f"row.`{c}`") for c in documents.columns if c not in ("lang_pred", "score")], "tag.lang_pred", "tag.score")


def op7_language_id(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    tagger = train(documents.select("doc_id", "text", "lang"))
    held_out = F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out")
    return tag_documents(documents.select("doc_id", held_out, "text"), tagger).select("doc_id", "held_out", "lang_pred", "score")
