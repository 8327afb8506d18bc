import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_tools import brute_components
from tracebraid.llm import decontaminate, mixing, queries
from tracebraid.llm.store import written


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(written(f(spark, out[-1], sf_dir), "stage-" + str(zlib.crc32(name.encode()))))
    return sf_dir, out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_and_whole_work(stages):
    _, out = stages
    assert all(x.columns == out[0].columns for x in out[:-1])
    assert out[-1].count() == out[-2].count()


def test_classifier_rejects_junk_and_keeps_clean(spark, stages):
    sf_dir, out = stages
    gone = ids(out[0]) - ids(out[1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [labels[i] for i in gone if i in labels]
    assert judged and sum(judged) <= 0.1 * len(judged)


def test_one_of_each_group(stages):
    _, out = stages
    docs = {r["doc_id"]: r["text"] for r in out[1].collect()}
    assert ids(out[2]) == set(brute_components(docs).values())


def test_decontamination(spark, stages):
    sf_dir, out = stages
    bad = decontaminate.op2_decontaminate(out[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated")
    assert ids(out[3]) == ids(out[2]) - ids(bad) and ids(bad)


def test_mix_and_tokens(stages):
    _, out = stages
    plan = mixing.op6_mixing(out[3]).agg(F.sum("taken")).first()[0]
    words = out[4].agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == plan
    starts = [(r["start"], r["n_tokens"]) for r in out[5].orderBy("start").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_run_is_all_stages_in_order(spark, stages):
    """run() against the stages one by one, and its ids against the plain tokenizer on their texts."""
    from tokenizers import Tokenizer

    sf_dir, out = stages
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted(tuple(r) for r in out[5].collect())
    tk = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((r["doc_id"], zlib.crc32(np.array([*tk.encode(r["text"], add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in out[4].select("doc_id", "text").collect())
    assert sorted((doc, crc) for doc, _, _, crc in got) == want


def test_odd_tables(spark, tmp_path):
    """Nulls, repeated rows and ids, empty and clashing columns go through; empty tables too."""
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long, "s", 1), (2, long, None, 2), (2, "unlike " * 3 + long[::-1], "s", 3), (None, None, None, None), (None, "", "s", 5), (None, long, "t", 6), (7, "a b c", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").selectExpr("doc_id", "text", "'en' AS lang", "source", "5L AS n_chars", "size", "1 AS row", "2 AS scan", "3 AS rid", "4 AS hash", "5 AS score")
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, None), ("x", "")], "item_id string, text string")
    for name, whole in (("odd", True), ("empty", False)):
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
            (df if whole else df.limit(0)).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        got = docs if whole else docs.limit(0)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = written(stage(spark, got, f"{tmp_path}/{name}"), "odd")
            assert got.columns == docs.columns
        done = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert done.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and done.count() == got.count()
        assert whole or done.count() == 0


def test_queries_have_names(spark):
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in queries.queries()}
