"""The field against all its paths, and its cases."""

import math

import numpy as np

from tracebraid.llm import language_id
from tracebraid.llm.text import Words


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def path_weights(e, move, start):
    """Every path of one chain with its weight."""
    for path in np.ndindex(*[e.shape[1]] * len(e)):
        yield path, math.exp(start[path[0]] + sum(e[t, y] for t, y in enumerate(path)) + sum(move[x, y] for x, y in zip(path, path[1:], strict=False)))


def likelihood(e, first, move, start, labels):
    out = 0.0
    for a, b in zip(first, first[1:], strict=False):
        if a < b:
            got = dict(path_weights(e[a:b], move, start))
            out += math.log(got[tuple(labels[a:b].tolist())] / sum(got.values()))
    return out


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(2)
    e, move, start, labels = rng.normal(size=(10, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.integers(0, 3, 10)
    first = np.array([0, 5, 5, 6, 10])
    for which, got in enumerate(language_id.gradients(e, first, move, start, labels)):
        want = np.zeros_like(got)
        for at in np.ndindex(*got.shape):
            ends = []
            for step in (1e-5, -1e-5):
                values = [e.copy(), move.copy(), start.copy()]
                values[which][at] += step
                ends.append(likelihood(values[0], first, values[1], values[2], labels))
            want[at] = (ends[0] - ends[1]) / 2e-5
        assert np.allclose(got, want, atol=1e-6)


def test_predictions_against_all_paths(spark):
    tagger = language_id.train(docs_of(spark, "/root/testdata/sf0.001"))
    texts = ["the and of", "les des une avec the", "and", "der die das und the of", "la de que los y el", "x! the\tthe\nA"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.tag_documents(df, tagger).collect()}
    for i, t in enumerate(texts):
        e = tagger.emissions(Words([t.lower().encode()]))
        e = e - e.max(axis=1, keepdims=True)
        total = np.zeros(len(tagger.languages))
        whole = 0.0
        for path, w in path_weights(e, tagger.transition, tagger.start):
            whole += w
            total += w * np.bincount(path, minlength=len(total))
        total /= whole
        assert got[i]["lang_pred"] == tagger.languages[int(total.argmax())] and math.isclose(got[i]["score"], total.max() / len(e), rel_tol=1e-6)


def test_words_with_odd_spaces_and_clashing_columns(spark):
    tagger = language_id.train(docs_of(spark, "/root/testdata/sf0.001"))
    assert [w for w, _, _ in tagger.label_words("a B \x1cc d\n É")] == ["a B", "\x1cc d", "É"]
    df = spark.createDataFrame([(1, "the and", "x", 5.0, 7, 8), (None, "les une", "y", None, 1, 2)], "doc_id long, text string, lang_pred string, score double, tag int, `row` int")
    got = language_id.tag_documents(df, tagger)
    assert got.columns == ["doc_id", "text", "tag", "row", "lang_pred", "score"] and {r["tag"] for r in got.collect()} == {7, 1}


def test_learning_rows_are_bounded_and_stable(spark):
    rows = [(i, "the and of " * 5, "en") for i in range(40)] + [(100, "les une des " * 9, "fr"), (101, "der und " * 100, "de"), (None, "und", "xx"), (3, "no", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = language_id.train(df, docs=4, most=2, most_bytes=200)
    two = language_id.train(df.repartition(5), docs=4, most=2, most_bytes=200)
    assert one.languages == two.languages and set(one.languages) <= {"de", "en", "fr"} and "de" in one.languages
    assert (one.weights == two.weights).all() and (one.transition == two.transition).all()
    assert language_id.train(df.limit(0)).languages == []


def test_a_language_whose_rows_share_an_id_is_learned(spark):
    from zlib import crc32

    hot = next(i for i in range(10**6, 10**6 + 9) if crc32(str(i).encode()) % 3 != 1)
    rows = [(hot, f"der hund {i} schläft und die katze auch", "de") for i in range(600)] + [(i, f"the dog {i} sleeps and the cat too", "en") for i in range(60)]
    rows += [(hot, "ein satz der immer gleich ist", "nl")] * 600
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.train(df, docs=12, most=4).languages == ["de", "en", "nl"]
