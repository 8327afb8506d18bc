"""What a worker of the token stage holds."""

import sys

from pyspark.sql import functions as F

from tracebraid.llm import store, token_output as t
from tracebraid.llm.queries import tokenizer_path


def test_few_pieces_are_remembered():
    e = t.PieceEncoder(tokenizer_path())
    texts = [" ".join(f"w{i}x" for i in range(k, k + 5_000)).encode() for k in range(0, 300_000, 5_000)]
    for text in texts:
        got, _ = e.encode_run([text])
    held = sys.getsizeof(e.known) + sum(map(sys.getsizeof, e.known)) + 28 * len(e.known) + e.flat.nbytes + e.at.nbytes
    # All 300,000 pieces, 45 MB, were kept before.
    assert held < 20 << 20
    assert got.tolist() == [*e._ids([texts[-1]])[0].tolist(), e.end_id]


def test_files_are_small(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 350_000).alias("text"))
    files = t.write_tokens(docs, tokenizer_path(), base=f"file://{tmp_path}/tokens").collect()
    # 42 MB of text; with files of 32 MB it was as many as there are cores, 4.
    assert len(files) > 4 and sum(f["n_docs"] for f in files) == 40


def test_memory_is_given_back():
    import pyarrow as pa

    buffers = [pa.allocate_buffer(1 << 20) for _ in range(8)]
    del buffers
    store.give_back()
    assert pa.total_allocated_bytes() < 8 << 20
