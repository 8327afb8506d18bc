"""Language models as adjudicators: prompts in SQL, an injected client, parsing and validation."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.expressions import compact, fixed, is_loadgen, normalize_service
from ..functions.predicates import without_loadgen
from ..schemas import CAUSAL, MASKED

Client = Callable[[list[str]], list[str]]


def lines(df: DataFrame, line: Column, order: list, name: str) -> DataFrame:
    """Per case the lines in order, joined; ``NONE`` is left to the caller."""
    g = df.withColumn("_l", line).groupBy("case_id")
    return g.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_l"))), lambda x: x["_l"]), "\n").alias(name))


def candidates(known: DataFrame, keep_loadgen: bool = False) -> DataFrame:
    """Masked pairs of every case with their ids, from 0 in order."""
    c = known.filter(F.col("relation") == MASKED)
    c = c if keep_loadgen else c.filter(without_loadgen())
    return c.withColumn("id", (F.row_number().over(Window.partitionBy("case_id").orderBy("pos")) - 1).cast("int"))


def evidence_lines(ev: DataFrame) -> DataFrame:
    at = F.when(F.col("ts_s").isNull(), F.lit("NA")).otherwise(fixed(F.col("ts_s")))
    line = F.concat_ws("|", "node", "kind", "signal", F.concat(F.lit("abn="), fixed(F.col("abnormality"))), F.concat(F.lit("t="), at), compact("text"))
    order = [(-F.col("abnormality")).alias("o1"), F.coalesce("ts_s", F.lit(float("inf"))).alias("o2"), F.col("evidence_id").alias("o3")]
    return lines(ev, line, order, "evidence_lines")


#: What a prompt may show of a scored run, and its name there.  Truth columns of a diagnostic table are never read.
SIGNALS = {
    "abductive_score": "abd", "temporal_score": "temporal", "anomaly_score": "anomaly",
    "semantic_margin": "margin", "soft_logic_score": "logic", "final_score": "final",
}


def pair_signals(scores: DataFrame) -> DataFrame:
    """Per case and normalised pair the signals and the decision of a scored run; of pairs with one name the last counts."""
    have = scores.columns
    optional = lambda c, kind="double": F.col(c) if c in have else F.lit(None).cast(kind)
    margin = optional("semantic_margin") if "semantic_margin" in have else optional("semantic_support") - optional("semantic_contradiction")
    values = [margin.alias(c) if c == "semantic_margin" else optional(c).alias(c) for c in SIGNALS]
    decided = F.col("predicted_causal") if "predicted_causal" in have else F.coalesce(optional("final_score") >= 0.5, F.lit(False))
    order = F.col("pos") if "pos" in have else optional("candidate_id", "long")
    norm = [normalize_service("source").alias("source_norm"), normalize_service("target").alias("target_norm")]
    last = F.max_by(F.struct(decided.alias("decided"), *values), F.struct(order, "source", "target"))
    return scores.groupBy("case_id", *norm).agg(last.alias("s")).select("case_id", "source_norm", "target_norm", "s.*")


def require_scored(known: DataFrame, scored: DataFrame) -> None:
    """Raises when a case is missing in the scored run."""
    missing = known.select("case_id").distinct().join(scored.select("case_id").distinct(), "case_id", "left_anti").orderBy("case_id").limit(5).collect()
    if missing:
        raise KeyError(f"no scored run of cases {', '.join(r['case_id'] for r in missing)}")


def prompts(known: DataFrame, ev: DataFrame, symptoms: DataFrame, scores: DataFrame | None = None, keep_loadgen: bool = True, roots: DataFrame | None = None) -> DataFrame:
    """case_id and prompt: masked candidates by id, visible causal pairs, symptoms, telemetry.

    With ``scores`` each candidate carries the signals of a scored run (NA where it
    has none); ``roots`` are its ranked roots.  Gold is never read.
    """
    c = candidates(known, keep_loadgen)
    parts = [F.col("id").cast("string"), F.col("source"), F.col("target")]
    if scores is not None:
        c = c.withColumn("source_norm", normalize_service("source")).withColumn("target_norm", normalize_service("target"))
        c = c.join(pair_signals(scores), ["case_id", "source_norm", "target_norm"], "left")
        parts.append(F.concat(F.lit("decision="), F.coalesce(F.col("decided").cast("int"), F.lit(0)).cast("string")))
        parts += [F.concat(F.lit(f"{short}="), F.when(F.col(c).isNull(), F.lit("NA")).otherwise(fixed(F.col(c)))) for c, short in SIGNALS.items()]
    seen = known.filter(F.col("relation") == CAUSAL)
    seen = seen if keep_loadgen else seen.filter(without_loadgen())
    said = symptoms.groupBy("case_id").agg(F.to_json(F.array_sort(F.collect_set("node"))).alias("symptoms"))
    tables = [lines(c, F.concat_ws("|", *parts), ["id"], "masked"), lines(seen, F.concat_ws("|", "source", "target"), ["pos"], "visible"), said, evidence_lines(ev)]
    if roots is not None:
        ranked = F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"])
        tables.append(roots.groupBy("case_id").agg(F.to_json(F.slice(ranked, 1, 3)).alias("scored_roots")))
    j = known.select("case_id").distinct()
    for t in tables:
        j = j.join(t, "case_id", "left")
    block = lambda title, c, none="NONE": F.concat(F.lit(title + "\n"), F.coalesce(c, F.lit(none)))
    blocks = [block("SCORED_ROOTS", "scored_roots", "[]")] if roots is not None else []
    blocks += [block("MASKED_CANDIDATES", "masked"), block("VISIBLE_RELATIONS", "visible"), block("SYMPTOM_SERVICES", "symptoms"), block("TELEMETRY", "evidence_lines")]
    return j.select("case_id", F.concat_ws("\n\n", F.lit(SCORED_TASK if scores is not None else TASK), *blocks).alias("prompt"))


TASK = """Below is one incident of a service system. Pairs marked as masked were observed, their labels are hidden.
Name the masked pairs over which the incident spread, by id, and up to three services where it began, the likeliest first.
Reply with one JSON object and nothing else: {"causal_ids":[0,2],"root_causes":["service-a"]}"""
SCORED_TASK = TASK + """
Each masked pair carries what an earlier analysis found: its decision, scores from 0 to 1, and a margin from -1 to 1. It may be wrong.
The visible relations are causal already and need no id."""
PAIR_TASK = f"""Below is one incident of a service system, as JSON. All pairs were observed; those labelled {MASKED} hide whether the incident spread over them.
List the hidden pairs over which it did, and up to three services where it began, the likeliest first. Pairs that are not listed do not exist.
Reply with one JSON object and nothing else: {{"causal_pairs":[["source","target"]],"root_causes":["service"]}}"""


def pair_prompts(known: DataFrame, ev: DataFrame, symptoms: DataFrame) -> DataFrame:
    """case_id and prompt of the direct baseline: relations, evidence and symptoms as JSON; answers name pairs, not ids."""
    listed = lambda df, order, row, name: df.groupBy("case_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("row")))), lambda x: x["row"])).alias(name))
    relations = listed(known, "pos", F.struct("source", "relation", "target"), "relations")
    seen = F.struct("node", "kind", "signal", F.round("abnormality", 4).alias("abnormality"), F.col("ts_s").alias("timestamp"), "text")
    j = relations.join(listed(ev, "pos", seen, "evidence"), "case_id", "left")
    j = j.join(symptoms.groupBy("case_id").agg(F.to_json(F.array_sort(F.collect_set("node"))).alias("symptoms")), "case_id", "left")
    block = lambda title, c: F.concat(F.lit(title + "\n"), F.coalesce(c, F.lit("[]")))
    return j.select("case_id", F.concat_ws("\n\n", F.lit(PAIR_TASK), block("RELATIONS", "relations"), block("TELEMETRY", "evidence"), block("SYMPTOM_SERVICES", "symptoms")).alias("prompt"))


def ask(prompt_rows: DataFrame, make_client: Callable[[], Client], batch: int = 8) -> DataFrame:
    """case_id and answer; the client is made once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            got: list[str] = []
            for i in range(0, len(b), batch):
                got += client(list(b.prompt.iloc[i : i + batch]))
            yield pd.DataFrame({"case_id": b.case_id, "answer": got})

    return prompt_rows.mapInPandas(run, "case_id string, answer string")


def parse_object(text: str) -> dict:
    """The first JSON object inside an answer, whatever stands around it."""
    decoder, at = json.JSONDecoder(), -1
    while (at := text.find("{", at + 1)) >= 0:
        try:
            return decoder.raw_decode(text, at)[0]
        except ValueError:
            continue
    raise ValueError("no JSON object")


_TOKEN = re.compile(r"(?P<key>causal_ids|root_causes)\s*[:=]|(?P<open>\[)|(?P<close>\])|(?P<text>'[^'\"]+'|\"[^'\"]+\")|(?P<number>-?\d+)", re.IGNORECASE)


def _listed(text: str) -> dict[str, list[str]]:
    """Lists after the two keys in text that is no JSON: a list's numbers, and its quoted texts without the quotes."""
    found: dict[str, list[str]] = {}
    key, inside = None, False
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "key":
            key, inside = m["key"].lower(), False
        elif kind == "open" and key is not None and not inside and key not in found:
            found[key], inside = [], True
        elif kind == "close":
            key, inside = None, False
        elif inside and kind == ("number" if key == "causal_ids" else "text"):
            found[key].append(m[kind].strip("'\""))
    return found


def _whole(x: object) -> int | None:
    try:
        return int(str(x))
    except ValueError:
        return None


def parse_answer(text: str | None) -> tuple[list[str], list[str], str]:
    """(ids as decimal text, of any size, roots, mode): from JSON, else from lists behind the keys (``regex_fallback``), else nothing (``failed``)."""
    try:
        answer = parse_object(text or "")
        numbers, names, mode = list(answer.get("causal_ids") or []), list(answer.get("root_causes") or []), "json"
    except (ValueError, TypeError):
        lists = _listed(text or "")
        numbers, names = lists.get("causal_ids", []), lists.get("root_causes", [])
        mode = "regex_fallback" if lists else "failed"
    ids = [str(n) for n in map(_whole, numbers) if n is not None]
    return ids, [str(x) for x in names], mode


def parse_pairs(text: str | None) -> tuple[list[tuple[str, str]], list[str], str]:
    """(pairs, roots, mode) of a direct answer; what is no list of two names or more is left out."""
    try:
        answer = parse_object(text or "")
        pairs = [(str(x[0]), str(x[1])) for x in answer.get("causal_pairs") or [] if isinstance(x, list) and len(x) >= 2]
        return pairs, [str(x) for x in answer.get("root_causes") or []][:3], "json"
    except (ValueError, TypeError):
        return [], [], "failed"


_PARSED = T.StructType([T.StructField("ids", T.ArrayType(T.StringType())), T.StructField("roots", T.ArrayType(T.StringType())), T.StructField("mode", T.StringType())])


@F.pandas_udf(_PARSED)
def parsed(answers: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_answer(a) for a in answers], columns=["ids", "roots", "mode"])


_NAMES = T.ArrayType(T.StringType())
_PAIR = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType())])
_PAIRS = T.StructType([T.StructField("pairs", T.ArrayType(_PAIR)), T.StructField("roots", _NAMES), T.StructField("mode", T.StringType())])


@F.pandas_udf(_PAIRS)
def parsed_pairs(answers: pd.Series) -> pd.DataFrame:
    rows = [parse_pairs(a) for a in answers]
    return pd.DataFrame([([{"source": a, "target": b} for a, b in pairs], roots, mode) for pairs, roots, mode in rows], columns=["pairs", "roots", "mode"])


def decide_pairs(answers: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges: the answered pairs and the visible causal ones, roots by rank) of direct answers; names are taken as they are."""
    p = answers.withColumn("p", parsed_pairs("answer")).select("case_id", "p.*")
    pairs = p.select("case_id", F.inline("pairs")).select("case_id", "source", F.lit(CAUSAL).alias("relation"), "target")
    visible = known.filter(F.col("relation") == CAUSAL).join(p.select("case_id"), "case_id", "left_semi").select("case_id", "source", "relation", "target")
    roots = p.select("case_id", F.posexplode("roots").alias("at", "node"))
    return visible.unionByName(pairs).distinct(), roots.select("case_id", "node", (F.col("at") + 1).cast("long").alias("rank"))


def decide(answers: DataFrame, known: DataFrame, ev: DataFrame | None, keep_loadgen: bool = False, most: int = 3, scored_roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges chosen by valid ids and visible causal ones, roots as canonical services, counts) of parsed answers.

    A case whose answer names no valid root keeps those of ``scored_roots`` (case_id, node, rank).
    """
    p = answers.withColumn("p", parsed("answer")).select("case_id", "p.*")
    c = candidates(known, keep_loadgen).select("case_id", "id", "source", "target")
    # An id that is no candidate's, however large, joins with none and counts as invalid.
    ids = p.select("case_id", F.explode(F.array_distinct("ids")).alias("id")).withColumn("id", F.col("id").try_cast("long"))
    edges = ids.join(c, ["case_id", "id"]).select("case_id", "source", F.lit(CAUSAL).alias("relation"), "target")
    nodes = known.select("case_id", F.explode(F.array("source", "target")).alias("node"))
    if ev is not None:
        nodes = nodes.unionByName(ev.select("case_id", "node"))
    if not keep_loadgen:
        nodes = nodes.filter(~is_loadgen("node"))
    canon = nodes.groupBy("case_id", normalize_service("node").alias("norm")).agg(F.min("node").alias("node"))
    raw = p.select("case_id", F.posexplode("roots").alias("at", "raw")).withColumn("norm", normalize_service("raw"))
    found = raw.join(canon, ["case_id", "norm"], "left")
    first = found.filter("node IS NOT NULL").groupBy("case_id", "node").agg(F.min("at").alias("at"))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("at")).cast("long")).filter(F.col("rank") <= most)
    # Names that are none count until the last root is found.
    last = first.filter(F.col("rank") == most).select("case_id", F.col("at").alias("last"))
    wrong = found.filter("node IS NULL").join(last, "case_id", "left").filter("last IS NULL OR at < last").groupBy("case_id").agg(F.count("*").alias("n_invalid_roots"))
    valid = edges.groupBy("case_id").agg(F.count("*").alias("n_valid_ids"))
    counts = p.select("case_id", "mode", F.size(F.array_distinct("ids")).cast("long").alias("n_ids")).join(valid, "case_id", "left").join(wrong, "case_id", "left").na.fill(0)
    visible = known.filter(F.col("relation") == CAUSAL).join(p.select("case_id"), "case_id", "left_semi")
    edges = visible.select("case_id", "source", "relation", "target").unionByName(edges).distinct()
    roots = first.select("case_id", "node", "rank")
    if scored_roots is not None:
        open_ = p.select("case_id").join(roots, "case_id", "left_anti")
        kept = scored_roots.select("case_id", F.col("rank").alias("at"), normalize_service("node").alias("norm")).join(open_, "case_id", "left_semi")
        kept = kept.join(canon, ["case_id", "norm"]).groupBy("case_id", "node").agg(F.min("at").alias("at"))
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("at")).cast("long")).filter(F.col("rank") <= most)
        roots = roots.unionByName(kept.select("case_id", "node", "rank"))
    return edges, roots, counts.withColumn("n_invalid_ids", F.col("n_ids") - F.col("n_valid_ids"))
