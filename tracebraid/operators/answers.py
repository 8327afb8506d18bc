"""Running language models over prompts: token budgets, a store of answers, accounts of a run.

A prompt is cut at its budget exactly, at the end of its last token.  Answers are
kept by a hash of model and prompt: a second run, a retried job or an equal prompt
of another case asks nothing again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from .adjudication import Client

#: A tokenizer: for each text the ends of its tokens, in characters.
Tokenizer = Callable[[list[str]], list[list[int]]]
STORED = "key string, answer string, seconds double, output_tokens long"


def within_budget(prompt_rows: DataFrame, make_tokenizer: Callable[[], Tokenizer], most: int) -> DataFrame:
    """case_id, prompt cut after ``most`` tokens, raw_tokens, input_tokens, truncated; the tokenizer is made once per task.

    ``most`` is what the model's window leaves after the tokens it may write.  A
    null prompt counts as empty.
    """
    if most < 1:
        raise ValueError("a budget has one token at least")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenize = make_tokenizer()
        for b in batches:
            texts = [t or "" for t in b.prompt]
            ends = tokenize(texts)
            if len(ends) != len(texts):
                raise ValueError(f"the tokenizer gave {len(ends)} results for {len(texts)} texts")
            raw = [len(e) for e in ends]
            cut = [t if n <= most else t[: e[most - 1]] for t, e, n in zip(texts, ends, raw, strict=True)]
            yield pd.DataFrame({"case_id": b.case_id, "prompt": cut, "raw_tokens": raw, "input_tokens": [min(n, most) for n in raw], "truncated": [n > most for n in raw]})

    return prompt_rows.select("case_id", "prompt").mapInPandas(run, "case_id string, prompt string, raw_tokens long, input_tokens long, truncated boolean")


def answered(prompt_rows: DataFrame, model: str, make_client: Callable[[], Client], store: str, batch: int = 8, make_tokenizer: Callable[[], Tokenizer] | None = None) -> DataFrame:
    """The prompt rows with answer, seconds and output_tokens (null without a tokenizer), from the store at ``store`` or, if new, from the client.

    ``model`` names the model with all that changes its answers.  Different new
    prompts are asked once each, sorted by length within a partition so that
    batches are even, and join the store when their job commits; a task that is
    run again before that asks its own partition again.  ``seconds`` is an equal
    share of its batch's time.
    """
    spark = prompt_rows.sparkSession
    keyed = prompt_rows.withColumn("key", F.sha2(F.concat_ws("\0", F.lit(model), F.coalesce("prompt", F.lit(""))), 256))

    def stored() -> DataFrame:
        try:
            return spark.read.schema(STORED).parquet(store)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], STORED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, tokenize = make_client(), make_tokenizer() if make_tokenizer else None
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                began = time.perf_counter()
                got = client(list(part.prompt))
                if len(got) != len(part):
                    raise ValueError(f"the client gave {len(got)} answers to {len(part)} prompts")
                tokens = [len(e) for e in tokenize([x or "" for x in got])] if tokenize else [None] * len(got)
                yield pd.DataFrame({"key": part.key, "answer": got, "seconds": (time.perf_counter() - began) / len(part), "output_tokens": pd.array(tokens, "Int64")})

    new = keyed.join(stored().select("key"), "key", "left_anti").groupBy("key").agg(F.any_value(F.coalesce("prompt", F.lit(""))).alias("prompt"))
    new = new.repartition("key").sortWithinPartitions(F.length("prompt"))
    new.mapInPandas(run, STORED).write.mode("append").parquet(store)
    # Two runs at a time may both have asked: one answer of a key counts.
    one = stored().groupBy("key").agg(F.min_by(F.struct("answer", "seconds", "output_tokens"), F.struct("answer", "seconds")).alias("a"))
    return keyed.join(one, "key").select(*prompt_rows.columns, "a.*")


def run_account(rows: DataFrame) -> DataFrame:
    """One row: cases, tokens in and out, share of cut prompts, seconds in all and for a case; null where a column is missing or empty."""
    have = lambda c, f: f(F.col(c)) if c in rows.columns else F.lit(None)
    return rows.agg(
        F.count("*").alias("n"),
        have("raw_tokens", F.sum).cast("long").alias("raw_tokens"),
        have("input_tokens", F.sum).cast("long").alias("input_tokens"),
        have("output_tokens", F.sum).cast("long").alias("output_tokens"),
        have("truncated", lambda c: F.avg(c.cast("double"))).alias("truncation_rate"),
        have("seconds", F.sum).alias("seconds"),
        have("seconds", F.avg).alias("mean_seconds"),
    )


def require_run(run: dict, ratio: float, variant: str = "full") -> None:
    """Raises unless a scored run's document is of the variant and masks as much as this one."""
    if str(run.get("variant")) != variant:
        raise ValueError(f"the scored run must be of variant {variant}, not {run.get('variant')}")
    if run.get("mask_ratio") is None or abs(float(run["mask_ratio"]) - ratio) > 1e-9:
        raise ValueError(f"the scored run masks {run.get('mask_ratio')}, this one {ratio}")
