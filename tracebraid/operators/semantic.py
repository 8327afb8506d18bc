"""Language-model support for hypotheses: premises and claims in SQL, a model by injection, exact arithmetic in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import clip01, evidence_text, structural_text
from ..schemas import PHRASES

#: A model: premises and claims to entailment probabilities, batch by batch.
Model = Callable[[list[str], list[str]], list[float]]
BATCH = 16
#: The model that the published method names; its files are not part of this repository.
MODEL_ID = "MoritzLaurer/DeBERTa-v3-base-mnli-fever-anli"


def contrast(positive: Column, negative: Column) -> dict[str, Column]:
    """Support, contradiction and neutral mass from the entailment of a claim and of its opposite."""
    mass = positive + negative
    preference = F.when(mass > 1e-12, (positive - negative) / mass).otherwise(0.0)
    relevance = clip01(mass / 0.5)
    margin = preference * relevance
    return {"semantic_support": 0.5 + 0.5 * margin, "semantic_contradiction": 0.5 - 0.5 * margin, "semantic_neutral": 1 - relevance}


def structural_claims(h: DataFrame, observations: DataFrame) -> DataFrame:
    """Adds premise, positive and negative claim of every relation hypothesis."""
    o = observations.select("case_id", "observation_id", structural_text().alias("sentence"))
    ids = h.select("case_id", "source", "relation", "target", F.posexplode("observation_ids").alias("at", "observation_id"))
    said = ids.join(o, ["case_id", "observation_id"]).groupBy("case_id", "source", "relation", "target")
    said = said.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence"))), lambda x: x.sentence), " ").alias("said"))
    phrases = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    phrase = F.coalesce(F.try_element_at(phrases, F.col("relation")), F.concat(F.lit("has relation "), "relation", F.lit(" with")))
    claim = F.concat("source", F.lit(" "), phrase, F.lit(" "), "target")
    j = h.join(said, ["case_id", "source", "relation", "target"], "left")
    return j.withColumns(
        {
            "premise": F.concat(F.lit("Operational telemetry observations for a possible structural relation: "), F.coalesce("said", F.lit("No direct relation evidence was retained."))),
            "positive": F.concat(claim, F.lit(".")),
            "negative": F.concat(F.lit("The telemetry does not support that "), claim, F.lit("; the endpoints are only co-observed.")),
        }
    ).drop("said")


def causal_claims(h: DataFrame, ev: DataFrame) -> DataFrame:
    """Adds premise, positive and negative claim of every causal hypothesis; evidence of both ends in its order."""
    sentences = ev.select("case_id", "node", "pos", evidence_text().alias("sentence"))
    ends = h.select("case_id", "source", "target", F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    said = ends.join(sentences, ["case_id", "node"]).groupBy("case_id", "source", "target")
    said = said.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x.sentence), " ").alias("said"))
    j = h.join(said, ["case_id", "source", "target"], "left")
    return j.withColumns(
        {
            "premise": F.concat(F.lit("The telemetry collector observed a dependency from "), "source", F.lit(" to "), "target", F.lit(". Incident telemetry for the two endpoints: "), F.coalesce("said", F.lit(""))),
            "positive": F.concat(F.lit("The incident anomaly at "), "source", F.lit(" causally propagated to "), "target", F.lit(".")),
            "negative": F.concat(F.lit("The observed dependency from "), "source", F.lit(" to "), "target", F.lit(" did not causally propagate the incident anomaly.")),
        }
    ).drop("said")


def entailments(claims: DataFrame, make_model: Callable[[], Model], key: list[str]) -> DataFrame:
    """``e_pos`` and ``e_neg`` of each claim; the model is made once per task and fed in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for b in batches:
            out = {"e_pos": [], "e_neg": []}
            for i in range(0, len(b), BATCH):
                part = b.iloc[i : i + BATCH]
                got = model([*part.premise, *part.premise], [*part.positive, *part.negative])
                if len(got) != 2 * len(part):
                    raise ValueError(f"the model gave {len(got)} scores for {2 * len(part)} claims")
                out["e_pos"] += got[: len(part)]
                out["e_neg"] += got[len(part) :]
            yield b[key].assign(**out)

    rows = claims.select(*key, "premise", "positive", "negative")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*key).dtypes) + ", e_pos double, e_neg double"
    return rows.mapInPandas(run, schema)


def structural_scorer(make_model: Callable[[], Model]):
    """A scorer for ``structural.recover``."""

    def score(observations: DataFrame, h: DataFrame) -> DataFrame:
        key = ["case_id", "source", "relation", "target"]
        e = entailments(structural_claims(h, observations), make_model, key)
        return h.drop("semantic_support", "semantic_contradiction", "semantic_neutral").join(e, key).withColumns(contrast(F.col("e_pos"), F.col("e_neg"))).drop("e_pos", "e_neg")

    score.whole = True
    return score


def causal_scorer(make_model: Callable[[], Model]):
    """A scorer for ``incident.predict``."""

    def score(ev: DataFrame, h: DataFrame) -> DataFrame:
        key = ["case_id", "source", "target"]
        e = entailments(causal_claims(h, ev), make_model, key)
        return h.drop("semantic_support", "semantic_contradiction", "semantic_neutral").join(e, key).withColumns(contrast(F.col("e_pos"), F.col("e_neg"))).drop("e_pos", "e_neg")

    return score


def deterministic_causal(ev: DataFrame, h: DataFrame) -> DataFrame:
    """Support from the abductive score alone."""
    s = clip01("abductive_score")
    return h.withColumn("semantic_support", s).withColumn("semantic_contradiction", 1 - s).withColumn("semantic_neutral", F.lit(0.0))
