"""The same queries in DuckDB SQL: one chain of common table expressions and a final SELECT each."""

from __future__ import annotations

import re

#: The sample run's numbers, stated here again and not taken from the library.
CASES, SERVICES, EVENT_SERVICES, GROUPS, RATIO = 20, 61, 6, 4, 0.4
LINE_CUT, EVENT_CUT, START = "1998-05-24", "2024-01-21", 10370.0


def norm(x: str) -> str:
    return f"replace(replace(regexp_replace(regexp_replace(lower(trim({x})), '^(service|svc)[:/]', ''), '^ts-', ''), '-', ''), '_', '')"


def kind(x: str) -> str:
    return f"CASE WHEN contains({x}, ':') THEN split_part({x}, ':', 1) ELSE 'service' END"


def value(x: str) -> str:
    return f"substr({x}, instr({x}, ':') + 1)"


def clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def moved(x: str) -> str:
    """A score moved by a quarter of the deterministic scorer's margin."""
    return clamp(f"{x} + 0.25::DOUBLE * (2 * {clamp(x)} - 1)")


# Fixed values, stated here again and not taken from the library.
SCHEMA = """('service', 'service', 'calls'), ('service', 'pod', 'deployed_on'), ('pod', 'node', 'runs_on'), ('service', 'database', 'uses_database'),
      ('service', 'messaging', 'uses_messaging'), ('system', 'service', 'has_service')"""
PRIOR = """('trace_parent_child', 'calls', 0.98::DOUBLE), ('service_pod_cooccurrence', 'deployed_on', 0.98), ('pod_node_cooccurrence', 'runs_on', 0.98),
      ('db_client_context', 'uses_database', 0.95), ('messaging_context', 'uses_messaging', 0.95), ('system_inventory', 'has_service', 1.0)"""
PHRASE = """('calls', 'calls'), ('deployed_on', 'is deployed on'), ('runs_on', 'runs on'), ('uses_database', 'uses the database'),
      ('uses_messaging', 'uses the messaging target'), ('has_service', 'contains the service')"""

_RAW = """
  SELECT DISTINCT case_id, 'service:' || service_name AS source, 'pod:' || pod AS target, 'service_pod_cooccurrence' AS evidence_kind, 0.98::DOUBLE AS confidence,
    'Telemetry for ' || service_name || ' is emitted with Kubernetes pod ' || pod || '.' AS text FROM {t}
  UNION ALL SELECT DISTINCT case_id, 'pod:' || pod, 'node:' || node, 'pod_node_cooccurrence', 0.98::DOUBLE,
    'Pod ' || pod || ' is observed with node/host resource ' || node || '.' FROM {t} WHERE node IS NOT NULL
  UNION ALL SELECT DISTINCT case_id, 'service:' || service_name, 'database:' || concat_ws(':', db_system, addr), 'db_client_context', 0.95::DOUBLE,
    'A span from ' || service_name || ' carries database system ' || db_system || coalesce(' and database/server target ' || addr, '') || '.' FROM {t} WHERE db_system IS NOT NULL
  UNION ALL SELECT DISTINCT case_id, 'service:' || service_name, 'messaging:' || concat_ws(':', msg_system, addr), 'messaging_context', 0.95::DOUBLE,
    'A span from ' || service_name || ' carries messaging system ' || msg_system || coalesce(' and destination ' || addr, '') || '.' FROM {t} WHERE msg_system IS NOT NULL
  UNION ALL SELECT DISTINCT case_id, 'system:shop', 'service:' || service_name, 'system_inventory', 1.0::DOUBLE,
    'System inventory contains service ' || service_name || '.' FROM (SELECT case_id, service_name FROM {t} UNION SELECT case_id, service_name FROM {e})
  UNION ALL SELECT c.case_id, 'service:' || p.service_name, 'service:' || c.service_name, 'trace_parent_child', 0.98::DOUBLE,
    'A parent span from ' || p.service_name || ' has a child span executed by ' || c.service_name || '.'
    FROM {t} c JOIN {t} p ON c.case_id = p.case_id AND c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE c.service_name <> p.service_name
"""
_OBS = """
  SELECT case_id, source, target, evidence_kind, count(*) AS observation_count, max(confidence) AS confidence, min(text) AS text,
    'ro-' || substr(sha256(evidence_kind || '|' || source || '|' || target), 1, 16) AS observation_id FROM {raw} GROUP BY ALL
"""
_HYP = f"""
  SELECT case_id, source, relation, target, 1 - product(1 - score) AS support,
    array_to_string(list_sort(list(observation_id)), ',') AS observation_ids, count(DISTINCT evidence_kind) AS n_kinds
  FROM (SELECT o.*, s.relation, {clamp(f'confidence * coalesce(p.prior, 0.35)')} AS score
    FROM (SELECT *, {kind('source')} AS sk, {kind('target')} AS tk FROM {{obs}}) o
    JOIN (VALUES {SCHEMA}) s(sk, tk, relation) ON o.sk = s.sk AND o.tk = s.tk
    LEFT JOIN (VALUES {PRIOR}) p(evidence_kind, relation, prior) ON p.evidence_kind = o.evidence_kind AND p.relation = s.relation)
  GROUP BY case_id, source, relation, target
"""


def _prf(pred: str, gold: str, key: str, by: str = "case_id", cases: bool = True, empty_recall: str = "0.0") -> str:
    """Scores of two relations with columns ``by, key``."""
    k = ", ".join(f"{c}" for c in [by, *key.split(", ")])
    n = f"""SELECT {by}, count(p) FILTER (g IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn
      FROM (SELECT DISTINCT {k}, 1 AS p FROM {pred}) FULL JOIN (SELECT DISTINCT {k}, 1 AS g FROM {gold}) USING ({k}) GROUP BY {by}"""
    if cases:
        n = f"SELECT case_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (SELECT case_id FROM cases) LEFT JOIN ({n}) USING (case_id)"
    return _scores(n, empty_recall)


def _scores(n: str, empty_recall: str = "0.0") -> str:
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (
      SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1.0::DOUBLE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
        CASE WHEN tp + fp + fn = 0 THEN 1.0::DOUBLE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE {empty_recall} END AS recall FROM ({n}))"""


_PSL_C = "(0.2 + 2.0 * conflict)"

CTES: list[tuple[str, str]] = [
    ("cases", f"SELECT 'case-' || i AS case_id, 'sys-' || (i % {GROUPS}) AS group_id, {START}::DOUBLE AS start_s FROM range({CASES}) r(i)"),
    ("traces", f"""SELECT 'case-' || (l_orderkey % {CASES}) AS case_id, CASE WHEN l_shipdate < TIMESTAMP '{LINE_CUT}' THEN 'normal' ELSE 'abnormal' END AS win,
      l_orderkey::VARCHAR AS trace_id, l_linenumber::VARCHAR AS span_id, CASE WHEN l_linenumber > 1 THEN (l_linenumber - 1)::VARCHAR END AS parent_span_id,
      'svc-' || (l_suppkey % {SERVICES}) AS service_name, 'pod-' || l_suppkey AS pod, 'node-' || s_nationkey AS node,
      CASE WHEN l_linestatus = 'F' THEN lower(p_type) END AS db_system, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'queue' END AS msg_system, p_brand AS addr,
      date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::DOUBLE AS ts_s, l_extendedprice AS duration, (l_returnflag = 'R' OR l_tax >= 0.08) AS err
      FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey"""),
    ("ev_rows", f"""SELECT 'case-' || (event_id % {CASES}) AS case_id, CASE WHEN ts < TIMESTAMP '{EVENT_CUT}' THEN 'normal' ELSE 'abnormal' END AS win,
      'svc-' || (user_id % {EVENT_SERVICES}) AS service_name, event_type AS metric, value, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
      {START}::DOUBLE + (epoch_us(ts) - epoch_us(TIMESTAMP '{EVENT_CUT}')) / 864e8 AS ts_s FROM events"""),
    ("traces_n", "SELECT * FROM traces WHERE win = 'normal'"),
    ("ev_rows_n", "SELECT * FROM ev_rows WHERE win = 'normal'"),
    ("raw_obs", _RAW.format(t="traces", e="ev_rows")),
    ("raw_obs_n", _RAW.format(t="traces_n", e="ev_rows_n")),
    ("obs", _OBS.format(raw="raw_obs")),
    ("obs_n", _OBS.format(raw="raw_obs_n")),
    ("hyp", _HYP.format(obs="obs")),
    ("hyp_n", _HYP.format(obs="obs_n")),
    ("rel", f"SELECT case_id, source, relation, target, group_id FROM hyp JOIN cases USING (case_id) WHERE {clamp('support')} >= 0.5"),
    ("ranked", """SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sha256('42:' || group_id || ':' || source || '|' || relation || '|' || target), source, relation, target) AS rank,
      count(*) OVER (PARTITION BY group_id) AS n FROM (SELECT DISTINCT group_id, source, relation, target FROM rel)"""),
    ("visible", f"SELECT r.* FROM rel r JOIN ranked USING (group_id, source, relation, target) WHERE rank > round_even(n * {RATIO}::DOUBLE, 0)"),
    ("missing", f"SELECT r.* FROM rel r JOIN ranked USING (group_id, source, relation, target) WHERE rank <= round_even(n * {RATIO}::DOUBLE, 0)"),
    ("conflicts", """SELECT h.*, CASE WHEN (h.relation = 'runs_on' AND EXISTS (SELECT 1 FROM visible v WHERE v.case_id = h.case_id AND v.relation = 'runs_on' AND v.source = h.source)
        AND NOT EXISTS (SELECT 1 FROM visible v WHERE v.case_id = h.case_id AND v.relation = 'runs_on' AND v.source = h.source AND v.target = h.target))
      OR (h.relation = 'has_service' AND EXISTS (SELECT 1 FROM visible v WHERE v.case_id = h.case_id AND v.relation = 'has_service' AND v.target = h.target)
        AND NOT EXISTS (SELECT 1 FROM visible v WHERE v.case_id = h.case_id AND v.relation = 'has_service' AND v.source = h.source AND v.target = h.target))
      THEN 1 ELSE 0 END AS conflict FROM hyp_n h"""),
    ("psl_n", f"SELECT *, 1.4::DOUBLE * support / (1.4::DOUBLE + {_PSL_C}) AS score FROM conflicts"),
    ("added", "SELECT case_id, source, relation, target FROM psl_n WHERE score >= 0.5 AND (case_id, source, relation, target) NOT IN (SELECT case_id, source, relation, target FROM visible)"),
    ("stage1_rows", _prf("added", "missing", "source, relation, target", empty_recall="1.0")),
    ("known", f"""SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY source, target) AS pos FROM (
      SELECT DISTINCT case_id, {value('target')} AS source, 'dependency_propagates_to' AS relation, {value('source')} AS target FROM hyp_n
      WHERE relation = 'calls' AND {clamp('support')} >= 0.5)"""),
    ("stats", """SELECT case_id, win, service_name, count(*) AS n, avg(err::INT) AS error_rate, quantile_cont(duration, 0.95) AS p95, quantile_cont(duration, 0.99) AS p99 FROM traces GROUP BY ALL"""),
    ("log_rates", "SELECT case_id, win, service_name, avg((upper(level) IN ('ERROR', 'FATAL', 'CRITICAL'))::INT) AS log_rate FROM ev_rows GROUP BY ALL"),
    ("m_base", r"""SELECT * FROM (SELECT case_id, service_name, metric, median(value) FILTER (win = 'normal') AS nmed, median(value) FILTER (win = 'abnormal') AS amed,
      count(*) FILTER (win = 'normal') AS nn, count(*) FILTER (win = 'abnormal') AS na FROM ev_rows WHERE NOT regexp_matches(lower(metric), '(\.time|_time)$') GROUP BY ALL) WHERE nn >= 3 AND na >= 2"""),
    ("m_mad", "SELECT case_id, service_name, metric, median(abs(value - nmed)) AS mad FROM ev_rows JOIN m_base USING (case_id, service_name, metric) WHERE win = 'normal' GROUP BY ALL"),
    ("m_shift", f"""SELECT *, {clamp('abs(amed - nmed) / scale / 6')} AS score FROM (SELECT *, greatest(1.4826::DOUBLE * mad, 0.05::DOUBLE * abs(nmed), 1e-9) AS scale FROM m_base JOIN m_mad USING (case_id, service_name, metric))"""),
    ("m_onset", "SELECT case_id, service_name, metric, min(ts_s) AS onset FROM ev_rows JOIN m_shift USING (case_id, service_name, metric) WHERE win = 'abnormal' AND abs(value - nmed) / scale >= 3 GROUP BY ALL"),
    ("m_best", "SELECT * FROM (SELECT s.*, onset, row_number() OVER (PARTITION BY s.case_id, s.service_name ORDER BY score DESC, s.metric) AS rn FROM m_shift s LEFT JOIN m_onset USING (case_id, service_name, metric) WHERE score > 0) WHERE rn = 1"),
    ("both_stats", """SELECT coalesce(n.case_id, a.case_id) AS case_id, coalesce(n.service_name, a.service_name) AS service_name, coalesce(n.n, 0) AS nn, coalesce(a.n, 0) AS an,
      coalesce(n.error_rate, 0) AS ne, coalesce(a.error_rate, 0) AS ae, coalesce(n.p95, 0) AS np, coalesce(a.p95, 0) AS ap, coalesce(n.p99, 0) AS n99
      FROM (SELECT * FROM stats WHERE win = 'normal') n FULL JOIN (SELECT * FROM stats WHERE win = 'abnormal') a ON n.case_id = a.case_id AND n.service_name = a.service_name"""),
    ("first_error", "SELECT case_id, service_name, min(ts_s) AS t FROM traces WHERE win = 'abnormal' AND err GROUP BY ALL"),
    ("first_slow", "SELECT t.case_id, t.service_name, min(ts_s) AS t FROM traces t JOIN both_stats b USING (case_id, service_name) WHERE win = 'abnormal' AND nn > 0 AND duration > greatest(1.25 * n99, 1.5 * np) GROUP BY ALL"),
    ("first_log", "SELECT case_id, service_name, min(ts_s) AS t FROM ev_rows WHERE win = 'abnormal' AND upper(level) IN ('ERROR', 'FATAL', 'CRITICAL') GROUP BY ALL"),
    ("both_logs", """SELECT coalesce(n.case_id, a.case_id) AS case_id, coalesce(n.service_name, a.service_name) AS service_name, coalesce(n.log_rate, 0) AS nl, coalesce(a.log_rate, 0) AS al
      FROM (SELECT * FROM log_rates WHERE win = 'normal') n FULL JOIN (SELECT * FROM log_rates WHERE win = 'abnormal') a ON n.case_id = a.case_id AND n.service_name = a.service_name"""),
    ("signals", f"""
      SELECT 0 AS phase, case_id, service_name, 1 AS ko, 'trace' AS kind, 'availability_drop' AS signal, CASE WHEN nn > 0 THEN {clamp('(nn - an) / nn')} ELSE 0.0 END AS abnormality, {START}::DOUBLE AS ts_s, 0.10::DOUBLE AS least FROM both_stats
      UNION ALL SELECT 0, b.case_id, b.service_name, 2, 'trace', 'error_rate', {clamp('greatest(0, ae - ne) * 3')}, coalesce(nullif(t, 0), {START}), 0.10 FROM both_stats b LEFT JOIN first_error USING (case_id, service_name)
      UNION ALL SELECT 0, b.case_id, b.service_name, 3, 'trace', 'latency', CASE WHEN np > 0 AND ap > np THEN {clamp('log2(greatest(ap / np, 1.0)) / 3')} ELSE 0.0 END, coalesce(nullif(t, 0), {START}), 0.10 FROM both_stats b LEFT JOIN first_slow USING (case_id, service_name)
      UNION ALL SELECT 0, b.case_id, b.service_name, 4, 'log', 'error_log_rate', {clamp('greatest(0, al - nl) * 3')}, coalesce(nullif(t, 0), {START}), 0.10 FROM both_logs b LEFT JOIN first_log USING (case_id, service_name)
      UNION ALL SELECT 0, case_id, service_name, 5, 'metric', metric, score, coalesce(nullif(onset, 0), {START}), 0.15 FROM m_best"""),
    ("found", "SELECT * FROM signals WHERE abnormality >= least"),
    ("evid", f"""SELECT case_id, pos, 'e' || pos AS evidence_id, service_name AS node, kind, signal, abnormality, ts_s FROM (
      SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY phase, service_name, ko) AS pos FROM (
        SELECT phase, case_id, service_name, ko, kind, signal, abnormality, ts_s FROM found
        UNION ALL SELECT 1, case_id, service_name, 6, 'trace', 'stable_presence', 0.05::DOUBLE, {START}::DOUBLE FROM stats s
          WHERE win = 'normal' AND NOT EXISTS (SELECT 1 FROM found f WHERE f.case_id = s.case_id AND f.service_name = s.service_name)))"""),
    ("node_an", "SELECT case_id, node, max(abnormality) AS anomaly, min(ts_s) FILTER (abnormality >= 0.5) AS first_s FROM evid GROUP BY ALL"),
    ("sinks", "SELECT DISTINCT case_id, target AS node FROM known k WHERE NOT EXISTS (SELECT 1 FROM known x WHERE x.case_id = k.case_id AND x.source = k.target)"),
    ("sym1", "SELECT * FROM (SELECT case_id, node, row_number() OVER (PARTITION BY case_id ORDER BY anomaly DESC, node) AS rank FROM sinks JOIN node_an USING (case_id, node) WHERE anomaly >= 0.5) WHERE rank <= 2"),
    ("symptoms", "SELECT * FROM sym1 UNION ALL SELECT * FROM (SELECT case_id, node, row_number() OVER (PARTITION BY case_id ORDER BY anomaly DESC, node) AS rank FROM node_an WHERE case_id NOT IN (SELECT case_id FROM sym1)) WHERE rank = 1"),
    ("chyp", """SELECT *, 0.55::DOUBLE * t + 0.45::DOUBLE * a AS abd FROM (SELECT k.case_id, k.source, k.target, k.pos,
        CASE WHEN t.first_s - s.first_s IS NULL OR t.first_s < s.first_s THEN 0.0::DOUBLE WHEN t.first_s - s.first_s <= 5 THEN 1.0 WHEN t.first_s - s.first_s <= 30 THEN 0.8 WHEN t.first_s - s.first_s <= 120 THEN 0.55 ELSE 0.2 END AS t,
        least(s.anomaly, t.anomaly) AS a FROM known k JOIN node_an s ON s.case_id = k.case_id AND s.node = k.source JOIN node_an t ON t.case_id = k.case_id AND t.node = k.target)"""),
    ("chosen", f"SELECT case_id, source, target, abd AS score FROM chyp WHERE {clamp('abd')} >= 0.5"),
    ("ends", "SELECT case_id, source AS node, max(score) AS o FROM chosen WHERE (case_id, source) NOT IN (SELECT case_id, node FROM symptoms) GROUP BY ALL"),
    ("cand", """SELECT case_id, node, o, coalesce(i, 0) AS i, coalesce(anomaly, 0) AS anomaly, first_s FROM ends
      LEFT JOIN (SELECT case_id, target AS node, max(score) AS i FROM chosen GROUP BY ALL) USING (case_id, node) LEFT JOIN node_an USING (case_id, node)"""),
    ("root_scores", """SELECT case_id, node, 0.38::DOUBLE * o + 0.30::DOUBLE * anomaly + 0.20::DOUBLE * early + 0.12::DOUBLE * (1 - i) AS score FROM (SELECT *, coalesce(1 - (first_s - min(first_s) OVER w) / greatest(max(first_s) OVER w - min(first_s) OVER w, 1e-9), 0) AS early
      FROM cand WINDOW w AS (PARTITION BY case_id))"""),
    ("roots1", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, node) AS rank FROM root_scores) WHERE rank <= 3"),
    ("ev_nodes", "SELECT n.*, s.node IS NOT NULL AS sym, bool_or(s.node IS NULL) OVER (PARTITION BY n.case_id) AS others FROM node_an n LEFT JOIN (SELECT DISTINCT case_id, node FROM symptoms) s USING (case_id, node)"),
    ("ev_scores", """SELECT case_id, node, 0.75::DOUBLE * anomaly + 0.25::DOUBLE * coalesce(1 - (first_s - min(first_s) OVER w) / greatest(max(first_s) OVER w - min(first_s) OVER w, 1e-9), 0) AS score FROM ev_nodes WHERE NOT sym OR NOT others WINDOW w AS (PARTITION BY case_id)"""),
    ("ev_roots", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, node) AS rank FROM ev_scores) WHERE rank <= 3"),
    ("roots", "SELECT * FROM roots1 UNION ALL SELECT * FROM ev_roots WHERE case_id NOT IN (SELECT case_id FROM roots1)"),
    ("gold_spans", """SELECT c.case_id, c.service_name AS source, p.service_name AS target, count(*) AS n FROM traces c JOIN traces p ON c.case_id = p.case_id AND c.trace_id = p.trace_id AND c.parent_span_id = p.span_id
      WHERE c.win = 'abnormal' AND p.win = 'abnormal' AND c.err AND p.err AND c.service_name <> p.service_name GROUP BY ALL"""),
    ("gold_roots", "SELECT case_id, node FROM (SELECT case_id, source AS node, row_number() OVER (PARTITION BY case_id ORDER BY sum(n) DESC, source) AS rank FROM gold_spans GROUP BY case_id, source) WHERE rank <= 2"),
    ("alarms", "SELECT case_id, node FROM (SELECT case_id, target AS node, row_number() OVER (PARTITION BY case_id ORDER BY sum(n) DESC, target) AS rank FROM gold_spans GROUP BY case_id, target) WHERE rank <= 2"),
    ("pred_pairs", f"SELECT DISTINCT case_id, {norm('source')} AS source, {norm('target')} AS target FROM chosen"),
    ("gold_pairs", f"SELECT DISTINCT case_id, {norm('source')} AS source, {norm('target')} AS target FROM gold_spans"),
    ("pred_roots", f"SELECT case_id, {norm('node')} AS node, rank FROM roots"),
    ("true_roots", f"SELECT case_id, {norm('node')} AS node FROM gold_roots"),
    ("true_alarms", f"SELECT case_id, {norm('node')} AS node FROM (SELECT case_id, node FROM alarms UNION ALL SELECT case_id, node FROM symptoms WHERE case_id NOT IN (SELECT case_id FROM alarms))"),
    ("edge_rows", _prf("pred_pairs", "gold_pairs", "source, target")),
    ("pred_nodes", "SELECT case_id, source AS node FROM pred_pairs UNION SELECT case_id, target FROM pred_pairs UNION SELECT case_id, node FROM pred_roots"),
    ("gold_nodes", "SELECT case_id, source AS node FROM gold_pairs UNION SELECT case_id, target FROM gold_pairs UNION SELECT case_id, node FROM true_roots"),
    ("node_rows", _prf("pred_nodes", "gold_nodes", "node")),
    ("root_rows", _prf("pred_roots", "true_roots", "node")),
    ("reach", "SELECT p.case_id, p.node AS root, p.node FROM pred_roots p JOIN true_roots USING (case_id, node) UNION SELECT r.case_id, r.root, e.target FROM reach r JOIN pred_pairs e ON e.case_id = r.case_id AND e.source = r.node"),
    ("local", f"SELECT *, {clamp('0.55::DOUBLE * t + 0.45::DOUBLE * a - (0.30::DOUBLE * (1 - a) + 0.15::DOUBLE * (1 - t))')} AS w FROM chyp"),
]


#: Tables of a run that depend on the known edges, in order; ``run`` builds them anew for other ones.
_RUN = "ends cand root_scores roots1 ev_nodes ev_scores ev_roots roots pred_pairs gold_pairs pred_roots true_roots true_alarms edge_rows pred_nodes gold_nodes node_rows root_rows reach".split()
_GIVEN = "cases known evid node_an symptoms gold_spans gold_roots alarms chosen chyp".split()


def run(x: str, known: str, score: str = "abd", spread: str | None = None) -> list[tuple[str, str]]:
    """The incident run over other known edges (case_id, source, relation, target, pos), as tables named with ``_x``.

    Hidden and observed pairs are scored, visible causal ones count as 1.
    ``spread`` is a table of names that go into the case ids, for several topologies at once.
    """
    own = lambda q: re.sub(rf"\b({'|'.join([*_RUN, *_GIVEN])})\b(?!\s*\()", rf"\1_{x}", q)
    source = lambda t: f"SELECT * FROM {t}" if spread is None else f"SELECT * REPLACE (case_id || '|' || name AS case_id) EXCLUDE (name) FROM (SELECT t.*, name FROM {t} t, {spread})"
    tables = [(f"{t}_{x}", source(t).replace("SELECT * REPLACE (case_id || '|' || name AS case_id) EXCLUDE (name)", "SELECT * EXCLUDE (name) REPLACE (case_id || '|' || name AS case_id)")) for t in ("cases", "evid", "node_an", "symptoms", "gold_spans", "gold_roots", "alarms")]
    base = dict(CTES)
    tables += [
        (f"known_{x}", known),
        (f"pairs_{x}", f"SELECT case_id, source, target, min(pos) AS pos FROM known_{x} WHERE relation IN ('__MASKED_RELATION__', 'dependency_propagates_to') GROUP BY ALL"),
        (f"hard_{x}", f"SELECT DISTINCT case_id, source, target FROM known_{x} WHERE relation = 'causal_propagates_to'"),
        (f"chyp_{x}", re.sub(r"\bknown\b", f"pairs_{x}", re.sub(r"\bnode_an\b", f"node_an_{x}", base["chyp"]))),
        (f"final_{x}", f"SELECT *, {score} AS score FROM chyp_{x}"),
        (f"chosen_{x}", f"SELECT case_id, source, target, score FROM final_{x} WHERE {clamp('score')} >= 0.5 UNION ALL SELECT case_id, source, target, 1.0 FROM hard_{x}"),
    ]
    return tables + [(f"{t}_{x}", own(base[t])) for t in _RUN]


def scores_of(x: str, extra: str = "") -> str:
    """A row of scores per case of a run: edges, nodes, roots, hits, reachability."""
    hits = f"""SELECT case_id, (SELECT count(DISTINCT p.node) FROM pred_roots_{x} p JOIN true_roots_{x} t USING (case_id, node) WHERE p.case_id = c.case_id) AS right_n,
      (SELECT count(DISTINCT node) FROM true_roots_{x} t WHERE t.case_id = c.case_id) AS g, (SELECT count(DISTINCT node) FROM pred_roots_{x} t WHERE t.case_id = c.case_id) AS p,
      (SELECT count(*) FROM pred_roots_{x} p JOIN true_roots_{x} t USING (case_id, node) WHERE p.case_id = c.case_id AND p.rank = 1) AS one FROM cases_{x} c"""
    path = f"SELECT case_id, (count(a.node) > 0)::INT::DOUBLE AS path_reachability FROM cases_{x} LEFT JOIN reach_{x} USING (case_id) LEFT JOIN true_alarms_{x} a USING (case_id, node) GROUP BY case_id"
    return f"""SELECT case_id, (right_n > 0)::INT::DOUBLE AS any_hit, (g > 0 AND right_n = g)::INT::DOUBLE AS all_hit, (right_n = g AND p = g)::INT::DOUBLE AS exact,
      (one > 0)::INT::DOUBLE AS hit_1, (right_n > 0)::INT::DOUBLE AS hit_3, path_reachability,
      e.precision AS edge_precision, e.recall AS edge_recall, e.f1 AS edge_f1, n.precision AS node_precision, n.recall AS node_recall, n.f1 AS node_f1,
      r.precision AS root_precision, r.recall AS root_recall, r.f1 AS root_f1{extra}
      FROM ({hits}) JOIN ({path}) USING (case_id) JOIN edge_rows_{x} e USING (case_id) JOIN node_rows_{x} n USING (case_id) JOIN root_rows_{x} r USING (case_id)"""


def sql(final: str, more: list[tuple[str, str]] = ()) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({q})" for n, q in [*CTES, *more]) + "\n" + final


#: Known edges with labels, two of every five hidden; and with those edges removed.
_IS_GOLD = f"EXISTS (SELECT 1 FROM gold_pairs g WHERE g.case_id = k.case_id AND g.source = {norm('k.source')} AND g.target = {norm('k.target')})"
_LABEL = f"CASE WHEN {_IS_GOLD} THEN 'causal_propagates_to' ELSE 'non_causal_dependency' END"
_LABELLED = f"SELECT case_id, source, target, pos, {_LABEL} AS truth, (pos - 1) % 5 < 2 AS picked FROM known k"
_HIDDEN = f"SELECT case_id, source, CASE WHEN picked THEN '__MASKED_RELATION__' ELSE truth END AS relation, target, pos FROM ({_LABELLED})"
_REMOVED = "SELECT case_id, source, relation, target, pos FROM known WHERE (pos - 1) % 5 >= 2"


def _topology(edges: str, name: str) -> str:
    return f"""SELECT DISTINCT case_id || '|{name}' AS case_id, {value('target')} AS source, {value('source')} AS target FROM ({edges})
      WHERE relation = 'calls' AND {kind('source')} = 'service' AND {kind('target')} = 'service' AND source <> target"""


_ADDED_TOO = "SELECT case_id, source, relation, target FROM visible UNION SELECT case_id, source, relation, target FROM added"
_CONDITIONS = [
    ("condition_names", "SELECT * FROM (VALUES ('incomplete'), ('recovered'), ('complete')) v(name)"),
    *run(
        "t",
        f"""SELECT *, 'dependency_propagates_to' AS relation, row_number() OVER (PARTITION BY case_id ORDER BY source, target) AS pos FROM (
          {_topology('SELECT * FROM visible', 'incomplete')} UNION ALL {_topology(_ADDED_TOO, 'recovered')} UNION ALL {_topology('SELECT * FROM rel', 'complete')})""",
        spread="condition_names",
    ),
    (
        "t_rows",
        "SELECT * REPLACE (split_part(case_id, '|', 1) AS case_id), split_part(case_id, '|', 2) AS condition FROM ("
        + scores_of("t", ", (SELECT count(*) FROM pred_roots_t p WHERE p.case_id = e.case_id) AS n_predicted_roots, (SELECT count(*) FROM (SELECT DISTINCT case_id, source, target FROM chosen_t) p WHERE p.case_id = e.case_id) AS n_predicted_edges")
        + ")",
    ),
]
_ALL_SCORES = [f"{k}_{c}" for k in ("edge", "node", "root") for c in ("precision", "recall", "f1")] + ["any_hit", "all_hit", "exact", "hit_1", "hit_3", "path_reachability"]
_DELTAS = ("edge_f1", "node_f1", "root_f1", "any_hit", "exact", "path_reachability")


def _ablation(known: str, score: str = "abd", truth: bool = True, graph_only: bool = False) -> str:
    """Scores of an ablation row over known edges; ``truth``: with those of the hidden pairs."""
    tables = run("a", known, score)
    if graph_only:
        at = dict(tables)
        at["chosen_a"] = "SELECT case_id, source, target, 1.0 AS score FROM hard_a"
        at["roots_a"] = """SELECT * FROM (SELECT case_id, node, anomaly AS score, row_number() OVER (PARTITION BY case_id ORDER BY anomaly DESC, first_s NULLS LAST, node) AS rank
          FROM node_an WHERE (case_id, node) NOT IN (SELECT case_id, node FROM symptoms)) WHERE rank <= 3"""
        tables = list(at.items())
    columns = ["edge_precision", "edge_recall", "edge_f1", "node_f1", "root_f1", "any_hit", "all_hit", "exact", "hit_1", "hit_3", "path_reachability"]
    if not truth:
        return sql(f"SELECT case_id, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM ({scores_of('a')})", tables)
    tables.append(
        (
            "hidden_rows",
            f"""SELECT case_id, count(*) AS n, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn FROM (
              SELECT l.case_id, truth = 'causal_propagates_to' AS y, EXISTS (SELECT 1 FROM pred_pairs_a p WHERE p.case_id = l.case_id AND p.source = {norm('l.source')} AND p.target = {norm('l.target')}) AS p
              FROM ({_LABELLED}) l WHERE picked) GROUP BY case_id""",
        )
    )
    more = """round((n - fp - fn) / n, 6) AS relation_accuracy, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 6) AS relation_f1"""
    return sql(f"SELECT case_id, {', '.join(f'round({c}, 6) AS {c}' for c in columns)}, {more} FROM ({scores_of('a')}) LEFT JOIN hidden_rows USING (case_id)", tables)


#: The controlled run over hidden labels with the deterministic scorer: seven values per case.
_QUALIFIED = ("causal_relation_accuracy", "causal_relation_precision", "causal_relation_recall", "causal_relation_f1", "root_hit_at_1", "root_hit_at_3", "process_path_reachability")
_QUALIFICATION = [
    *run("q", _HIDDEN, moved("abd")),
    (
        "judged_q",
        f"""SELECT l.case_id, truth = 'causal_propagates_to' AS y, EXISTS (SELECT 1 FROM pred_pairs_q p WHERE p.case_id = l.case_id AND p.source = {norm('l.source')} AND p.target = {norm('l.target')}) AS p
          FROM ({_LABELLED}) l WHERE picked""",
    ),
    ("counted_q", "SELECT case_id, avg((p = y)::INT) AS accuracy, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p) AS said, count(*) FILTER (y) AS true_ FROM judged_q GROUP BY case_id"),
    (
        "qualified",
        f"""SELECT s.case_id, coalesce(accuracy, 0) AS causal_relation_accuracy, coalesce(tp / nullif(said, 0), 0) AS causal_relation_precision, coalesce(tp / nullif(true_, 0), 0) AS causal_relation_recall,
          coalesce(2 * tp / nullif(said + true_, 0), 0) AS causal_relation_f1, hit_1 AS root_hit_at_1, hit_3 AS root_hit_at_3,
          EXISTS (SELECT 1 FROM reach_q r JOIN (SELECT case_id, {norm('node')} AS node FROM alarms) a USING (case_id, node) WHERE r.case_id = s.case_id)::INT::DOUBLE AS process_path_reachability
          FROM ({scores_of('q')}) s LEFT JOIN counted_q c ON s.case_id = c.case_id""",
    ),
]

_SEM = run("m", _HIDDEN, moved("abd"))
_DECIDED = "SELECT f.case_id, f.source, f.target FROM final_m f JOIN known_m k USING (case_id, source, target) WHERE k.relation = '__MASKED_RELATION__' AND score >= 0.5"
_WORDS = lambda x: f"list_distinct(string_split({x}, ' '))"
_SHARE = lambda c: f"(len(list_intersect({_WORDS(c)}, {_WORDS('premise')})) / len({_WORDS(c)}))"
#: Reach of symptoms over scored edges, by as many rounds as a path of services may have edges.
_SOFT = [
    ("soft_edges", "SELECT case_id, source, target, w FROM local UNION ALL SELECT DISTINCT case_id, node, node, 1.0::DOUBLE FROM (SELECT case_id, source AS node FROM local UNION SELECT case_id, target FROM local UNION SELECT case_id, node FROM symptoms)"),
    ("soft_best", "SELECT case_id, source, target, max(w) AS w FROM soft_edges GROUP BY ALL"),
    ("soft_rounds", f"SELECT DISTINCT 0 AS round, case_id, node, 1.0::DOUBLE AS value FROM symptoms UNION ALL SELECT r.round + 1, e.case_id, e.source, max(e.w * r.value) FROM soft_rounds r JOIN soft_best e ON e.case_id = r.case_id AND e.target = r.node WHERE r.round < {SERVICES} GROUP BY r.round, e.case_id, e.source"),
    ("soft_reach", f"SELECT case_id, node, value FROM soft_rounds WHERE round = {SERVICES}"),
]


def _variant(name: str, score: str | None) -> str:
    """Pooled counts of a stage-1 variant."""
    if score is None:
        return f"SELECT '{name}' AS variant, 0 AS tp, 0 AS fp, count(*) AS fn FROM (SELECT DISTINCT case_id, source, relation, target FROM missing)"
    added = f"""SELECT DISTINCT c.case_id, c.source, c.relation, c.target FROM conflicts c ANTI JOIN visible USING (case_id, source, relation, target) WHERE {score} >= 0.5"""
    return f"""SELECT '{name}' AS variant, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND g IS NULL) AS fp, count(*) FILTER (p IS NULL AND g) AS fn
      FROM (SELECT *, true AS p FROM ({added})) FULL JOIN (SELECT DISTINCT case_id, source, relation, target, true AS g FROM missing) USING (case_id, source, relation, target)"""


_VARIANTS = " UNION ALL ".join(
    _variant(n, q)
    for n, q in (
        ("topology_only", None),
        ("abduction", clamp("support")),
        ("abduction_semantic", moved("support")),
        ("abduction_psl", f"1.4::DOUBLE * support / (1.4::DOUBLE + {_PSL_C})"),
        # Support and semantic support are equal here, so both hinges pull to the same side.
        ("abduction_semantic_psl", f"2.5::DOUBLE * {clamp('support')} / (2.5::DOUBLE + {_PSL_C})"),
    )
)


#: Lines of hidden pairs, three tokens each; what 32 tokens leave of them.
_LINES = f"SELECT *, 32 - 3 * id AS room FROM (SELECT case_id, source, target, row_number() OVER (PARTITION BY case_id ORDER BY pos) - 1 AS id FROM ({_HIDDEN}) WHERE relation = '__MASKED_RELATION__')"
_BUDGETS = f"""SELECT case_id, 3 * count(*) AS raw_tokens, least(3 * count(*), 32) AS input_tokens, 3 * count(*) > 32 AS truncated,
  string_agg(CASE WHEN room >= 3 THEN id || '|' || source || '|' || target WHEN room = 2 THEN id || '|' || source ELSE id::VARCHAR END, chr(10) ORDER BY id) FILTER (room > 0) AS prompt FROM ({_LINES}) GROUP BY case_id"""

_EDGE = "case_id, source, relation, target"
_R = lambda *c: ", ".join(f"round({x}, 6) AS {x.split('.')[-1]}" for x in c)
_SCORES = "tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, " + _R("precision", "recall", "f1")
_OBS_COLUMNS = "case_id, source, target, evidence_kind, observation_count, confidence, text, observation_id"


def _observations(*kinds: str) -> str:
    return sql(f"SELECT {_OBS_COLUMNS} FROM obs WHERE evidence_kind IN ({', '.join(repr(k) for k in kinds)})")


ORACLES: dict[str, str] = {
    "span_calls_observations": _observations("trace_parent_child"),
    "laid_out_calls": sql("""SELECT c.case_id, p.service_name AS caller, c.service_name AS callee, count(*)::BIGINT AS times, count(*) FILTER (p.win = 'normal' AND c.win = 'normal')::BIGINT AS normal_times
      FROM traces c JOIN traces p ON c.case_id = p.case_id AND c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE c.service_name <> p.service_name GROUP BY ALL"""),
    "deployment_observations": _observations("service_pod_cooccurrence", "pod_node_cooccurrence"),
    "db_msg_observations": _observations("db_client_context", "messaging_context"),
    "system_inventory": _observations("system_inventory"),
    "observation_type_counts": sql("SELECT case_id, evidence_kind, count(*) AS n FROM obs GROUP BY ALL"),
    "abductive_hypotheses": sql(f"SELECT {_EDGE}, {_R('support')}, observation_ids, n_kinds FROM hyp"),
    "structural_soft_logic": sql(f"SELECT {_EDGE}, conflict::INT AS conflict, round({clamp(clamp('0.7::DOUBLE * support + 0.3::DOUBLE * support') + ' - 0.65::DOUBLE * conflict')}, 6) AS score FROM conflicts"),
    "structural_psl_closed_form": sql(f"SELECT {_EDGE}, conflict::INT AS conflict, {_R('score')} FROM psl_n"),
    "structural_semantic_scores": sql(f"SELECT {_EDGE}, round({clamp('support')}, 6) AS support, round(1 - {clamp('support')}, 6) AS contradiction, round({moved('support')}, 6) AS final_score FROM hyp"),
    "propagation_edges": sql("SELECT case_id, source, relation, target, pos FROM known"),
    "relation_type_counts": sql("SELECT case_id, relation, count(*) AS n FROM rel GROUP BY ALL"),
    **{
        f"group_mask_{int(r * 100)}": sql(f"SELECT group_id, source, relation, target, rank, rank <= round_even(n * {r}::DOUBLE, 0) AS missing FROM ranked")
        for r in (0.2, 0.4, 0.6)
    },
    "case_mask": sql(
        "SELECT case_id, source, relation, target, rank, rank <= round_even(n * 0.4::DOUBLE, 0) AS missing FROM ("
        "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sha256('42:' || case_id || ':' || source || '|' || relation || '|' || target), source, relation, target) AS rank, count(*) OVER (PARTITION BY case_id) AS n FROM rel)"
    ),
    "type_mask": sql(
        "SELECT case_id, source, CASE WHEN rank <= round_even(n * 0.4::DOUBLE, 0) THEN '__MASKED_STRUCTURAL_RELATION__' ELSE relation END AS relation, target, relation AS truth FROM ("
        "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sha256('42:' || case_id || ':' || source || '|' || relation || '|' || target), source, relation, target) AS rank, count(*) OVER (PARTITION BY case_id) AS n FROM rel)"
    ),
    "mask_audit": sql("SELECT n_full, n_missing, round(n_missing / n_full, 6) AS realized_ratio FROM (SELECT (SELECT count(*) FROM rel) AS n_full, (SELECT count(*) FROM missing) AS n_missing)"),
    "recovered_topology": sql(f"SELECT {_EDGE} FROM visible UNION SELECT {_EDGE} FROM added"),
    "added_relations": sql(f"SELECT {_EDGE} FROM added"),
    "stage1_missing_prf": sql(f"SELECT case_id, {_SCORES} FROM stage1_rows"),
    "stage1_micro": sql(f"SELECT {_SCORES} FROM ({_scores('SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM stage1_rows', '1.0')})"),
    "stage1_per_type": sql(f"SELECT relation, {_SCORES} FROM ({_prf('added', 'missing', 'case_id, source, target', 'relation', False, '1.0')})"),
    "candidate_ceiling": sql(
        "SELECT case_id, n_missing, n_candidates, round(n_candidates / n_missing, 6) AS ceiling FROM (SELECT m.case_id, count(*) AS n_missing, count(h.case_id) AS n_candidates FROM missing m LEFT JOIN hyp_n h USING (case_id, source, relation, target) GROUP BY ALL)"
    ),
    "false_insertion_rate": sql("SELECT round(coalesce(sum(fp) / nullif(sum(tp) + sum(fp), 0), 0), 6) AS rate FROM stage1_rows"),
    "service_stats": sql(f"SELECT case_id, win, service_name, n, {_R('error_rate', 'p95', 'p99')} FROM stats"),
    "log_error_rate": sql(f"SELECT case_id, win, service_name, {_R('log_rate')} FROM log_rates"),
    "metric_shift": sql(f"SELECT s.case_id, s.service_name, s.metric, {_R('nmed', 'amed', 'scale', 'score')}, round(onset, 6) AS onset FROM m_shift s LEFT JOIN m_onset USING (case_id, service_name, metric)"),
    "metric_argmax": sql(f"SELECT case_id, service_name, metric, {_R('score', 'onset')} FROM m_best"),
    "evidence_all": sql(f"SELECT case_id, pos, evidence_id, node, kind, signal, {_R('abnormality', 'ts_s')} FROM evid"),
    "node_anomaly": sql(f"SELECT case_id, node, {_R('anomaly', 'first_s')} FROM node_an"),
    "symptoms": sql("SELECT case_id, node, rank::INT AS rank FROM symptoms"),
    "incident_hypotheses": sql("SELECT case_id, source, target, pos, round(t, 6) AS temporal_score, round(a, 6) AS anomaly_score, round(abd, 6) AS abductive_score FROM chyp"),
    "predicted_edges": sql("SELECT DISTINCT case_id, source, target FROM chosen"),
    "root_ranking": sql(f"SELECT case_id, node, rank, {_R('score')} FROM roots"),
    "root_ranking_evidence_only": sql(f"SELECT case_id, node, rank, {_R('score')} FROM ev_roots"),
    "graph_only_roots": sql(
        "SELECT case_id, node, rank, round(anomaly, 6) AS score FROM (SELECT case_id, node, anomaly, row_number() OVER (PARTITION BY case_id ORDER BY anomaly DESC, first_s NULLS LAST, node) AS rank "
        "FROM node_an WHERE (case_id, node) NOT IN (SELECT case_id, node FROM symptoms)) WHERE rank <= 3"
    ),
    "edge_prf": sql(f"SELECT case_id, {_SCORES} FROM edge_rows"),
    "node_prf": sql(f"SELECT case_id, {_SCORES} FROM node_rows"),
    "root_prf": sql(f"SELECT case_id, {_SCORES} FROM root_rows"),
    "root_hits": sql(
        "SELECT case_id, (any_n > 0)::INT::DOUBLE AS any_hit, (g > 0 AND all_n = g)::INT::DOUBLE AS all_hit, (any_n = g AND p = g)::INT::DOUBLE AS exact, (one > 0)::INT::DOUBLE AS hit_1, (any_n > 0)::INT::DOUBLE AS hit_3 FROM ("
        "SELECT case_id, (SELECT count(DISTINCT p.node) FROM pred_roots p JOIN true_roots t USING (case_id, node) WHERE p.case_id = c.case_id) AS any_n, (SELECT count(DISTINCT p.node) FROM pred_roots p JOIN true_roots t USING (case_id, node) WHERE p.case_id = c.case_id) AS all_n,"
        "(SELECT count(DISTINCT node) FROM true_roots t WHERE t.case_id = c.case_id) AS g, (SELECT count(DISTINCT node) FROM pred_roots t WHERE t.case_id = c.case_id) AS p, (SELECT count(*) FROM pred_roots p JOIN true_roots t USING (case_id, node) WHERE p.case_id = c.case_id AND p.rank = 1) AS one FROM cases c)"
    ),
    "path_reachability": sql("SELECT case_id, (count(a.node) > 0)::INT::DOUBLE AS path_reachability FROM cases LEFT JOIN reach USING (case_id) LEFT JOIN true_alarms a USING (case_id, node) GROUP BY case_id"),
    "per_system_summary": sql(
        f"SELECT system, n, {_R('edge_f1', 'root_f1')} FROM (SELECT coalesce(group_id, 'overall') AS system, count(*) AS n, avg(e.f1) AS edge_f1, avg(r.f1) AS root_f1 FROM cases JOIN edge_rows e USING (case_id) JOIN root_rows r USING (case_id) GROUP BY ROLLUP (group_id))"
    ),
    "coverage_audit": sql(
        f"SELECT relation, n, n_cases, round(n_cases / {CASES}, 6) AS case_coverage, examples FROM (SELECT relation, count(*) AS n, count(DISTINCT case_id) AS n_cases FROM rel GROUP BY ALL) JOIN ("
        "SELECT relation, string_agg(pair, '; ' ORDER BY pair) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY pair) AS rn FROM (SELECT DISTINCT relation, source || ' -> ' || target AS pair FROM rel)) WHERE rn <= 5 GROUP BY relation) USING (relation)"
    ),
    "observation_audit": sql(
        "SELECT count(*) AS n_cases, count(*) FILTER (n > 0) AS n_observed_cases, sum(n)::BIGINT AS n_observations, round(avg(n), 6) AS mean_observations FROM (SELECT case_id, coalesce(n, 0) AS n FROM cases LEFT JOIN (SELECT case_id, count(*) AS n FROM obs GROUP BY ALL) USING (case_id))"
    ),
    "score_diagnostics": sql(
        f"SELECT count(*) AS n, round(avg(abd), 6) AS mean_abductive, round(avg(abs(2 * {clamp('abd')} - 1)), 6) AS mean_abs_margin, round(avg(fin), 6) AS mean_final, round(avg(abs(fin - abd)), 6) AS mean_abs_shift, "
        f"round(avg((abd >= 0.5)::INT), 6) AS abductive_positive_rate, round(avg((fin >= 0.5)::INT), 6) AS final_positive_rate FROM (SELECT *, {moved('abd')} AS fin FROM chyp)"
    ),
    "a2_a3_compare": sql(
        "SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_common, count(*) FILTER (b IS NULL) AS n_only_left, count(*) FILTER (a IS NULL) AS n_only_right, count(*) FILTER ((a >= 0.5) <> (b >= 0.5)) AS n_disagree, "
        "count(*) FILTER (a >= 0.5 AND b < 0.5) AS n_left_only_up, count(*) FILTER (a < 0.5 AND b >= 0.5) AS n_right_only_up, round(avg(((a >= 0.5) <> (b >= 0.5))::INT), 6) AS disagreement_rate, "
        "round(avg(abs(a - b)), 6) AS mean_abs_error, round(corr(a, b), 6) AS pearson, round(avg((abs(a - b) <= 1e-12)::INT), 6) AS equal_rate, "
        "round(avg(abs(a - abd)) FILTER (b IS NOT NULL), 6) AS mean_abs_left_shift, round(avg(abs(b - abd)) FILTER (a IS NOT NULL), 6) AS mean_abs_right_shift "
        f"FROM (SELECT abd, CASE WHEN (pos - 1) % 5 >= 2 THEN {clamp('abd')} END AS a, CASE WHEN (pos - 1) % 3 >= 1 THEN {moved('abd')} END AS b FROM chyp) WHERE a IS NOT NULL OR b IS NOT NULL"
    ),
    "normalize_service": sql(f"SELECT DISTINCT service_name, {norm('service_name')} AS normalized FROM traces"),
    "entity_parts": sql(f"SELECT DISTINCT source, {kind('source')} AS kind, {value('source')} AS value FROM obs"),
    "claims": sql(
        "SELECT case_id, source, relation, target, source || ' ' || phrase || ' ' || target || '.' AS positive, 'The telemetry does not support that ' || source || ' ' || phrase || ' ' || target || '; the endpoints are only co-observed.' AS negative FROM hyp JOIN "
        f"(VALUES {PHRASE}) p(relation, phrase) USING (relation)"
    ),
    "candidate_ceiling_pooled": sql("SELECT count(*) AS n_missing, count(h.case_id) AS n_candidates, round(count(h.case_id) / count(*), 6) AS ceiling FROM missing m LEFT JOIN hyp_n h USING (case_id, source, relation, target)"),
    "stage1_variants": sql(f"SELECT variant, {_SCORES} FROM ({_scores(_VARIANTS, '1.0')})"),
    "incident_soft_logic": sql(
        f"SELECT l.case_id, l.source, l.target, round(w, 6) AS local, round({clamp('0.82::DOUBLE * w + 0.18::DOUBLE * least(w, coalesce(value, 0.0))')}, 6) AS soft_logic_score FROM local l LEFT JOIN soft_reach r ON r.case_id = l.case_id AND r.node = l.target",
        _SOFT,
    ),
    # The minimum is no SQL; that every variable is at it is: all hypotheses and all nodes but symptoms, in cases with hypotheses.
    "incident_psl_optimality": sql(
        "SELECT case_id, 'cause' AS kind, source, target, true AS optimal FROM chyp_m UNION ALL SELECT case_id, 'reach', node, NULL, true FROM ("
        "SELECT case_id, source AS node FROM joint_edges UNION SELECT case_id, target FROM joint_edges) WHERE (case_id, node) NOT IN (SELECT case_id, node FROM symptoms)",
        [*_SEM, ("joint_edges", f"SELECT case_id, source, target FROM chyp_m UNION SELECT case_id, source, target FROM ({_HIDDEN}) WHERE relation <> '__MASKED_RELATION__' AND case_id IN (SELECT case_id FROM chyp_m)")],
    ),
    "causal_graph_gold": sql("SELECT case_id, 'edge' AS role, source, target FROM gold_spans UNION ALL SELECT case_id, 'root', node, NULL FROM gold_roots UNION ALL SELECT case_id, 'alarm', node, NULL FROM alarms"),
    "prompt_budgets": sql(_BUDGETS),
    "run_account": sql(f"SELECT count(*) AS n, sum(raw_tokens)::BIGINT AS raw_tokens, sum(input_tokens)::BIGINT AS input_tokens, round(avg(truncated::INT), 6) AS truncation_rate FROM ({_BUDGETS})"),
    "candidate_cap": sql("SELECT case_id, source, target, pos, round(abd, 6) AS abductive_score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY abd DESC, pos) AS place FROM chyp) WHERE place <= 3"),
    "legacy_reachability": sql(
        "SELECT case_id, round(coalesce(x, 0), 6) AS reachability FROM cases LEFT JOIN (SELECT p.case_id, avg((EXISTS (SELECT 1 FROM far f WHERE f.case_id = p.case_id AND f.root = p.node AND f.node = s.norm))::INT) AS x "
        f"FROM pred_roots p JOIN (SELECT case_id, {norm('node')} AS norm FROM symptoms) s USING (case_id) GROUP BY p.case_id) USING (case_id)",
        [("far", "SELECT case_id, node AS root, node FROM pred_roots UNION SELECT f.case_id, f.root, e.target FROM far f JOIN pred_pairs e ON e.case_id = f.case_id AND e.source = f.node")],
    ),
    "causal_mask": sql(_HIDDEN),
    "removal_mask": sql(_REMOVED),
    "contrastive_scores": sql(
        f"SELECT {_EDGE}, round(0.5 + 0.5 * margin, 6) AS semantic_support, round(0.5 - 0.5 * margin, 6) AS semantic_contradiction, round(1 - relevance, 6) AS semantic_neutral, round({clamp('support + 0.25::DOUBLE * margin')}, 6) AS final_score FROM ("
        f"SELECT *, {clamp('(pos + neg) / 0.5')} AS relevance, CASE WHEN pos + neg > 1e-12 THEN (pos - neg) / (pos + neg) ELSE 0.0 END * {clamp('(pos + neg) / 0.5')} AS margin FROM ("
        f"SELECT *, {_SHARE('positive')} AS pos, {_SHARE('negative')} AS neg FROM ("
        "SELECT h.*, 'Operational telemetry observations for a possible structural relation: ' || coalesce(said, 'No direct relation evidence was retained.') AS premise, h.source || ' ' || phrase || ' ' || h.target || '.' AS positive, "
        "'The telemetry does not support that ' || h.source || ' ' || phrase || ' ' || h.target || '; the endpoints are only co-observed.' AS negative "
        f"FROM hyp h JOIN (VALUES {PHRASE}) p(relation, phrase) USING (relation) LEFT JOIN ("
        "SELECT case_id, source, target, string_agg('[' || source || ' -> ' || target || '] ' || trim(text) || ' evidence_kind=' || evidence_kind || '; confidence=' || printf('%.3f', confidence) || '; count=' || observation_count || '.', ' ' ORDER BY observation_id) AS said "
        "FROM obs GROUP BY ALL) USING (case_id, source, target))))"
    ),
    "adjudication": sql(
        "SELECT case_id, 'json' AS mode, n + 1 AS n_ids, n AS n_valid_ids, 1::BIGINT AS n_invalid_roots, 1::BIGINT AS n_invalid_ids FROM (SELECT c.case_id, count(d.case_id) AS n FROM (SELECT DISTINCT case_id FROM known) c LEFT JOIN "
        f"({_DECIDED}) d USING (case_id) GROUP BY ALL)",
        _SEM,
    ),
    "adjudication_edges": sql(f"SELECT case_id, source, 'causal_propagates_to' AS relation, target FROM ({_DECIDED} UNION SELECT case_id, source, target FROM hard_m)", _SEM),
    "adjudication_roots": sql(
        "SELECT case_id, node, row_number() OVER (PARTITION BY case_id ORDER BY least) AS rank FROM (SELECT case_id, node, min(o) AS least FROM ("
        "SELECT case_id, min(node) AS node, 1 AS o FROM symptoms GROUP BY case_id UNION ALL SELECT case_id, node, 2 FROM roots_m WHERE rank = 1) GROUP BY ALL)",
        _SEM,
    ),
    "direct_pairs_edges": sql(f"SELECT DISTINCT case_id, source, 'causal_propagates_to' AS relation, target FROM ({_HIDDEN}) WHERE relation = 'causal_propagates_to' OR (relation = '__MASKED_RELATION__' AND source < target)"),
    "direct_pairs_roots": sql("SELECT case_id, max(node) AS node, 1::BIGINT AS rank FROM symptoms WHERE case_id IN (SELECT case_id FROM known) GROUP BY case_id"),
    "pair_diagnostics": sql(
        "SELECT l.case_id, row_number() OVER (PARTITION BY l.case_id ORDER BY l.pos) - 1 AS candidate_id, l.source, l.target, truth AS truth_relation, truth = 'causal_propagates_to' AS truth_causal, "
        "c.case_id IS NOT NULL AS predicted_causal, round(abd, 6) AS abductive_score, round(t, 6) AS temporal_score, round(a, 6) AS anomaly_score, "
        f"round(2 * {clamp('abd')} - 1, 6) AS semantic_margin, round(score, 6) AS final_score FROM ({_LABELLED}) l LEFT JOIN final_m f USING (case_id, source, target) "
        "LEFT JOIN (SELECT DISTINCT case_id, source, target FROM chosen_m) c USING (case_id, source, target) WHERE picked",
        _SEM,
    ),
    "topology_condition_rows": sql(f"SELECT case_id, condition, n_predicted_roots, n_predicted_edges, {_R(*_ALL_SCORES)} FROM t_rows", _CONDITIONS),
    "topology_condition_deltas": sql(
        "SELECT r.case_id, " + ", ".join(f"round(r.{c} - i.{c}, 6) AS delta_{c}, round(c.{c} - r.{c}, 6) AS gap_{c}" for c in _DELTAS) + " FROM (SELECT * FROM t_rows WHERE condition = 'recovered') r "
        "JOIN (SELECT * FROM t_rows WHERE condition = 'incomplete') i USING (case_id) JOIN (SELECT * FROM t_rows WHERE condition = 'complete') c USING (case_id)",
        _CONDITIONS,
    ),
    "topology_condition_summary": sql("SELECT condition, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _ALL_SCORES) + " FROM t_rows GROUP BY condition", _CONDITIONS),
    "ablation_graph_only": _ablation(_HIDDEN, graph_only=True),
    "ablation_abduction": _ablation(_HIDDEN),
    "ablation_semantic": _ablation(_HIDDEN, moved("abd")),
    "ablation_edge_mask": _ablation(_REMOVED, truth=False),
    "ablation_no_mask": _ablation("SELECT * FROM known", truth=False),
    "qualification": sql("SELECT case_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _QUALIFIED) + " FROM qualified", _QUALIFICATION),
    "qualification_summary": sql("SELECT count(*) AS n, " + ", ".join(f"round(coalesce(avg({c}), 0), 6) AS {c}" for c in _QUALIFIED) + " FROM qualified", _QUALIFICATION),
    "standard_track": sql(
        "SELECT case_id, root_causes, coalesce(propagation, '') AS propagation FROM (SELECT case_id, string_agg(node, ',' ORDER BY rank) AS root_causes FROM roots GROUP BY case_id) LEFT JOIN "
        "(SELECT case_id, string_agg(source || '->' || target, ';' ORDER BY source, target) AS propagation FROM (SELECT DISTINCT case_id, source, target FROM chosen) GROUP BY case_id) USING (case_id)"
    ),
}
