"""The queries of this subpackage, by name, and their DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, hard_negatives, jaccard_join, language_id, lm_score, mixing, periodic_runs, pii, quality_classifier, quality_rules, token_output, url_filter, warc

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tables(names: str, f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names.split()])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": _tables("documents labels", quality_rules.op1_quality_rules),
        "op2_decontaminate": _tables("documents benchmark", decontaminate.op2_decontaminate),
        "op3_jaccard_join": _tables("documents", jaccard_join.op3_jaccard_join),
        "op4_lm_score": _tables("documents", lm_score.op4_lm_score),
        "op5_quality_classifier": _tables("documents labels", quality_classifier.op5_quality_classifier),
        "op6_mixing": _tables("documents", mixing.op6_mixing),
        "op7_language_id": _tables("documents", language_id.op7_language_id),
        "op8_url_filter": _tables("pages", url_filter.op8_url_filter),
        "op9_token_output": _tables("documents", lambda d: token_output.op9_token_output(d, tokenizer_path())),
        "op10_warc": _tables("pages", warc.op10_warc),
        "op11_hard_negatives": _tables("embeddings", hard_negatives.op11_hard_negatives),
        "op12_periodic_runs": _tables("documents", periodic_runs.op12_periodic_runs),
        "op13_pii": _tables("documents", pii.op13_pii),
    }


OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS row_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT row_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT row_id, i, n, item FROM places JOIN windows USING (n, win)),
words AS (
  SELECT row_id, count(DISTINCT p) AS n_hit
  FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT row_id, i, n FROM hits)) GROUP BY row_id),
found AS (
  SELECT row_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (row_id) LEFT JOIN found USING (row_id)
"""

OP3_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM docs),
sizes AS (SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), chr(10))) END AS class FROM sets),
reps AS (SELECT class AS rep, min(doc_id) AS least, min(n) AS n, count(*) AS class_size, any_value(s) AS s FROM sizes WHERE class IS NOT NULL GROUP BY class),
shingles AS (SELECT rep, n, unnest(s) AS x FROM reps),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.rep <> b.rep
  GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
reach AS (SELECT rep AS node, rep AS other FROM reps UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
parts AS (SELECT node, min(least) AS component FROM reach JOIN reps ON other = rep GROUP BY node)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, CASE WHEN s.class IS NULL THEN s.doc_id ELSE component END AS component_id, coalesce(class_size, 1)::BIGINT AS class_size
FROM sizes s LEFT JOIN reps r ON s.class = r.rep LEFT JOIN parts p ON p.node = r.rep
"""

OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
largest AS (SELECT digest, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND last IS DISTINCT FROM page_id AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND last IS DISTINCT FROM page_id THEN last END AS refers_to
FROM p LEFT JOIN largest USING (digest)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op6_mixing": mixing.ORACLE, "op8_url_filter": url_filter.ORACLE, "op10_warc": OP10_SQL, "op11_hard_negatives": hard_negatives.ORACLE}
