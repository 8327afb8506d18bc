"""Collectors: telemetry to typed relation observations, for all cases at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import clean, col, entity, first_column, observation_id, strip
from ..schemas import DB_SYSTEM_COLUMNS, DB_TARGET_COLUMNS, MSG_SYSTEM_COLUMNS, MSG_TARGET_COLUMNS, NODE_COLUMNS, POD_COLUMNS
from . import meeting

RAW = ("case_id", "source", "target", "evidence_kind", "confidence", "text")


def _observed(df: DataFrame, source: Column, target: Column, kind: str, confidence: float, text: Column) -> DataFrame:
    times = [F.col(c) for c in ("times", "normal_times") if c in df.columns]
    return df.select("case_id", *times, source.alias("source"), target.alias("target"), F.lit(kind).alias("evidence_kind"), F.lit(confidence).alias("confidence"), text.alias("text"))


def _calls(traces: DataFrame) -> DataFrame | None:
    """case_id, caller and callee of every parent and child span of different services; none without the columns."""
    need = ("trace_id", "span_id", "parent_span_id", "service_name")
    if any(c not in traces.columns for c in need):
        return None
    s = traces.select("case_id", *[clean(c).alias(c) for c in need])
    parent = s.filter("trace_id IS NOT NULL AND span_id IS NOT NULL").select("case_id", "trace_id", F.col("span_id").alias("parent_span_id"), F.col("service_name").alias("caller"))
    child = s.filter("trace_id IS NOT NULL AND parent_span_id IS NOT NULL").select("case_id", "trace_id", "parent_span_id", F.col("service_name").alias("callee"))
    j = child.join(parent, ["case_id", "trace_id", "parent_span_id"]).filter("caller IS NOT NULL AND callee IS NOT NULL AND caller <> callee")
    return j.select("case_id", "caller", "callee")


def _call_rows(calls: DataFrame) -> DataFrame:
    text = F.concat(F.lit("A parent span from "), "caller", F.lit(" has a child span executed by "), "callee", F.lit("."))
    return _observed(calls, entity("service", "caller"), entity("service", "callee"), "trace_parent_child", 0.98, text)


def span_calls(traces: DataFrame) -> DataFrame:
    """Parent and child spans of different services; every joined pair is a row."""
    calls = _calls(traces)
    return _none(traces) if calls is None else _call_rows(calls)


def deployments(frames: list[DataFrame]) -> DataFrame:
    """Services with their pods and pods with their nodes, once per frame and pair."""
    out = []
    for df in frames:
        pod, node = first_column(df, POD_COLUMNS), first_column(df, NODE_COLUMNS)
        for a, b, kind_a, kind_b, kind in (
            ("service_name" if "service_name" in df.columns else None, pod, "service", "pod", "service_pod_cooccurrence"),
            (pod, node, "pod", "node", "pod_node_cooccurrence"),
        ):
            if a and b:
                d = df.select("case_id", col(a).alias("a"), col(b).alias("b")).distinct()
                d = d.select("case_id", clean("a").alias("a"), clean("b").alias("b")).dropna()
                text = (
                    F.concat(F.lit("Telemetry for "), "a", F.lit(" is emitted with Kubernetes pod "), "b", F.lit("."))
                    if kind_b == "pod"
                    else F.concat(F.lit("Pod "), "a", F.lit(" is observed with node/host resource "), "b", F.lit("."))
                )
                out.append(_observed(d, entity(kind_a, "a"), entity(kind_b, "b"), kind, 0.98, text))
    return reduce(DataFrame.unionByName, out) if out else _none(frames[0])


def _context(traces: DataFrame, systems, targets, kind: str, evidence_kind: str, said: str, target_said: str) -> DataFrame:
    system, target = first_column(traces, systems), first_column(traces, targets)
    if "service_name" not in traces.columns or not system:
        return _none(traces)
    b = col(target) if target else F.lit(None).cast("string")
    d = traces.select("case_id", col("service_name").alias("s"), col(system).alias("y"), b.alias("t")).distinct()
    d = d.select("case_id", *[clean(c).alias(c) for c in "syt"]).filter("s IS NOT NULL AND y IS NOT NULL")
    text = F.concat(F.lit("A span from "), "s", F.lit(f" carries {said} system "), "y", F.coalesce(F.concat(F.lit(f" and {target_said} "), "t"), F.lit("")), F.lit("."))
    return _observed(d, entity("service", "s"), entity(kind, F.concat_ws(":", "y", "t")), evidence_kind, 0.95, text)


def databases(traces: DataFrame) -> DataFrame:
    return _context(traces, DB_SYSTEM_COLUMNS, DB_TARGET_COLUMNS, "database", "db_client_context", "database", "database/server target")


def messaging(traces: DataFrame) -> DataFrame:
    return _context(traces, MSG_SYSTEM_COLUMNS, MSG_TARGET_COLUMNS, "messaging", "messaging_context", "messaging", "destination")


def inventory(frames: list[DataFrame], system: Column) -> DataFrame:
    """The system's services: one row per distinct one over all frames."""
    s = reduce(DataFrame.union, [f.select("case_id", clean("service_name").alias("s")) for f in frames if "service_name" in f.columns])
    d = s.filter("s IS NOT NULL").distinct()
    text = F.concat(F.lit("System inventory contains service "), "s", F.lit("."))
    return _observed(d, F.concat(F.lit("system:"), system), entity("service", "s"), "system_inventory", 1.0, text)


def dedupe(rows: DataFrame) -> DataFrame:
    """One observation per (case, source, target, kind): count, largest confidence, first text.

    A row counts ``times`` times where there is such a column and it is not null.
    """
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    n = F.sum(F.coalesce("times", F.lit(1))) if "times" in rows.columns else F.count("*")
    g = rows.groupBy("case_id", "source", "target", "evidence_kind").agg(n.alias("observation_count"), F.max(c).alias("confidence"), F.min("text").alias("text"))
    return g.withColumn("observation_id", observation_id("evidence_kind", "source", "target"))


SPAN_KEY = ("trace_id", "span_id", "parent_span_id", "service_name")


def spans(traces: DataFrame) -> DataFrame | None:
    """case_id, normal and the cleaned ids and service of each span that has a trace and a service; none without the columns."""
    if any(c not in traces.columns for c in SPAN_KEY):
        return None
    s = traces.select("case_id", _is_normal(traces).alias("normal"), *[clean(c).alias(c) for c in SPAN_KEY])
    return s.filter("trace_id IS NOT NULL AND service_name IS NOT NULL")


def call_counts(traces: DataFrame) -> DataFrame | None:
    """case_id, caller, callee, times, normal_times of parent and child spans, from one scan; none without the columns."""
    if any(c not in traces.columns for c in SPAN_KEY):
        return None
    # Dealt once by trace, a row a span; a number sorts faster than names.  Names are cleaned where they meet, in batches;
    # here spans without a trace are left out, lest they all go to one task.
    s = traces.select("case_id", _is_normal(traces).alias("normal"), *[col(c).cast("string").alias(c) for c in SPAN_KEY])
    s = s.filter("lower(trace_id) NOT IN ('', 'none', 'null', 'nan')").withColumn("place", F.xxhash64("case_id", strip("trace_id")))
    met = s.repartition("place").sortWithinPartitions("place").mapInArrow(meeting.calls, meeting.CALLS)
    return met.groupBy("case_id", "caller", "callee").agg(F.sum("times").alias("times"), F.sum("normal_times").alias("normal_times"))


def count_calls(s: DataFrame) -> DataFrame:
    """Calls of ``spans``; those laid out by (case_id, trace_id) meet without an exchange."""
    return _counted(_roles(s))


#: Where parent and child spans meet.
MEET = ("case_id", "trace_id", "key")


def _roles(s: DataFrame) -> DataFrame:
    """A span as a row at its own key and one at its parent's; ``place`` is a hash of where it meets others, which sorts faster than the names."""
    role = lambda c, parent: F.struct(F.col(c).alias("key"), F.lit(parent).alias("parent"))
    return s.select("case_id", "trace_id", "normal", "service_name", F.inline_outer(F.array(role("span_id", True), role("parent_span_id", False)))).filter("key IS NOT NULL").withColumn("place", F.xxhash64(*MEET))


def _counted(roles: DataFrame, *before: str) -> DataFrame:
    """Rows of a key are counted by role, service and window before they meet, so a key holds no more than its services, however many spans there are.

    Each child then has its key's parents beside it, which takes one sort by the key.
    """
    at = [*before, *MEET]
    g = roles.groupBy(*at, "parent", "service_name", "normal").agg(F.count("*").alias("n"))
    up = F.when(F.col("parent"), F.struct(F.col("service_name").alias("caller"), F.col("normal").alias("up_normal"), F.col("n").alias("up_n")))
    met = g.withColumn("up", F.collect_list(up).over(Window.partitionBy(*at))).filter("NOT parent")
    pairs = met.select("case_id", F.col("service_name").alias("callee"), "normal", "n", F.inline("up")).filter("caller <> callee")
    n = F.col("n") * F.col("up_n")
    return pairs.groupBy("case_id", "caller", "callee").agg(F.sum(n).alias("times"), F.sum(F.when(F.col("normal") & F.col("up_normal"), n).otherwise(0)).alias("normal_times"))


def _is_normal(df: DataFrame) -> Column:
    return F.coalesce(F.col("win") == "normal", F.lit(False)) if "win" in df.columns else F.lit(True)


def _typed(df: DataFrame, frame: int, traces: bool, system: Column | None) -> DataFrame | None:
    """What each row of a frame observes, all kinds at once: frame, kind and up to four names, with whether it is in the normal window.

    Where a row was seen (service, pod, node and system) is one kind, ``PLACE``: places are
    few, and ``_kinds`` makes the kinds that they observe from distinct ones.
    """
    pod, node, service = first_column(df, POD_COLUMNS), first_column(df, NODE_COLUMNS), "service_name" if "service_name" in df.columns else None
    said = []
    if traces:
        for kind, systems, targets in (("db_client_context", DB_SYSTEM_COLUMNS, DB_TARGET_COLUMNS), ("messaging_context", MSG_SYSTEM_COLUMNS, MSG_TARGET_COLUMNS)):
            said.append((kind, service, first_column(df, systems), first_column(df, targets)))
    name = lambda c: col(c).cast("string") if c else F.lit(None).cast("string")
    row = lambda kind, *names: F.struct(F.lit(frame).alias("frame"), F.lit(kind).alias("kind"), *[x.alias(n) for n, x in zip("abcd", names, strict=True)])
    rows = [row(kind, name(a), name(b), name(c), name(None)) for kind, a, b, c in said if a and b]
    listed = name(None) if system is None or not service else F.concat(F.lit("system:"), system)
    if (service and pod) or (pod and node) or (system is not None and service):
        rows.append(row(PLACE, name(service), name(pod), name(node), listed))
    if not rows:
        return None
    # A row whose first two names are null says nothing.
    says = (F.col("kind") == PLACE) | (F.col("a").isNotNull() & F.col("b").isNotNull())
    return df.select("case_id", _is_normal(df).alias("normal"), F.inline_outer(F.array(*rows))).filter(says)


PLACE = "place"


def _kinds(typed: DataFrame) -> DataFrame:
    """Distinct rows of all frames by kind; places first become the services' pods, the pods' nodes and the inventory."""
    distinct = typed.groupBy("case_id", "frame", "kind", *"abcd").agg(F.max("normal").alias("normal"))
    none = F.lit(None).cast("string")
    row = lambda frame, kind, *names: F.struct(F.col("frame") if frame is None else F.lit(frame).alias("frame"), F.lit(kind).alias("kind"), *[x.alias(n) for n, x in zip("abc", names, strict=True)])
    a, b, c, d = map(F.col, "abcd")
    places = F.array(
        row(None, "service_pod_cooccurrence", a, b, none),
        row(None, "pod_node_cooccurrence", b, c, none),
        # Services of all frames are one list.
        row(-1, "system_inventory", d, clean("a"), none),
    )
    as_it_is = F.array(F.struct("frame", "kind", "a", "b", "c"))
    rows = distinct.select("case_id", "normal", F.inline(F.when(F.col("kind") == PLACE, places).otherwise(as_it_is))).filter("a IS NOT NULL AND b IS NOT NULL")
    return rows.groupBy("case_id", "frame", "kind", *"abc").agg(F.max("normal").alias("normal"))


def _said(rows: DataFrame) -> DataFrame:
    """Observations of typed rows: source, target, confidence and text by kind."""
    d = rows.select("case_id", "kind", "normal", *[F.when(F.col("kind") == "system_inventory", F.col(c)).otherwise(clean(c)).alias(c) for c in "abc"]).filter("a IS NOT NULL AND b IS NOT NULL")
    k, a, b, c = (F.col(x) for x in ("kind", "a", "b", "c"))
    context = lambda said, at: F.concat(F.lit("A span from "), a, F.lit(f" carries {said} system "), b, F.coalesce(F.concat(F.lit(f" and {at} "), c), F.lit("")), F.lit("."))
    kinds = {
        "service_pod_cooccurrence": (entity("service", "a"), entity("pod", "b"), 0.98, F.concat(F.lit("Telemetry for "), a, F.lit(" is emitted with Kubernetes pod "), b, F.lit("."))),
        "pod_node_cooccurrence": (entity("pod", "a"), entity("node", "b"), 0.98, F.concat(F.lit("Pod "), a, F.lit(" is observed with node/host resource "), b, F.lit("."))),
        "db_client_context": (entity("service", "a"), entity("database", F.concat_ws(":", "b", "c")), 0.95, context("database", "database/server target")),
        "messaging_context": (entity("service", "a"), entity("messaging", F.concat_ws(":", "b", "c")), 0.95, context("messaging", "destination")),
        "system_inventory": (a, entity("service", "b"), 1.0, F.concat(F.lit("System inventory contains service "), b, F.lit("."))),
    }
    pick = lambda i: F.coalesce(*[F.when(k == n, F.lit(v[i]) if i == 2 else v[i]) for n, v in kinds.items()])
    return d.select("case_id", pick(0).alias("source"), pick(1).alias("target"), k.alias("evidence_kind"), pick(2).alias("confidence"), pick(3).alias("text"), F.lit(1).cast("long").alias("times"), F.col("normal").cast("long").alias("normal_times"))


def collect_windows(traces: DataFrame, metrics: DataFrame | None = None, logs: DataFrame | None = None, system: Column | None = None) -> DataFrame:
    """All collectors, deduplicated, over both windows at once; ``normal_count`` and ``normal_text`` are those of the normal window alone.

    Each frame is scanned once, traces once more for calls: a generator makes the
    typed rows of a span, a partial aggregation the distinct ones.
    """
    frames = [(f, i == 0) for i, f in enumerate((traces, metrics, logs)) if f is not None]
    typed = [d for i, (f, is_traces) in enumerate(frames) if (d := _typed(f, i, is_traces, system)) is not None]
    parts = []
    if typed:
        parts.append(_said(_kinds(reduce(DataFrame.unionByName, typed))))
    if (calls := call_counts(traces)) is not None:
        parts.append(_call_rows(calls))
    if not parts:
        parts.append(_none(traces).withColumns({"times": F.lit(1).cast("long"), "normal_times": F.lit(1).cast("long")}))
    return _windows(reduce(DataFrame.unionByName, parts))


def collect_calls(traces: DataFrame) -> DataFrame:
    """Of ``collect_windows`` the calls between services alone, without what the other collectors read; the columns of ``SPAN_KEY`` are needed."""
    return _windows(_call_rows(call_counts(traces)))


def _windows(rows: DataFrame) -> DataFrame:
    """One observation per (case, source, target, kind) of both windows, and what the normal one has of it."""
    normal = F.min(F.when(F.col("normal_times") > 0, F.col("text"))).alias("normal_text")
    g = rows.groupBy("case_id", "source", "target", "evidence_kind").agg(F.sum("times").alias("observation_count"), F.max("confidence").alias("confidence"), F.min("text").alias("text"), F.sum("normal_times").alias("normal_count"), normal)
    return g.withColumn("observation_id", observation_id("evidence_kind", "source", "target"))


def normal_only(rows: DataFrame) -> DataFrame:
    """Of ``collect_windows`` the observations of the normal window, as ``collect`` gives them."""
    return rows.filter("normal_count > 0").select("case_id", "source", "target", "evidence_kind", F.col("normal_count").alias("observation_count"), "confidence", F.col("normal_text").alias("text"), "observation_id")


def collect(traces: DataFrame, metrics: DataFrame | None = None, logs: DataFrame | None = None, system: Column | None = None) -> DataFrame:
    """All collectors, deduplicated."""
    return collect_windows(traces, metrics, logs, system).drop("normal_count", "normal_text")


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "case_id string, source string, target string, evidence_kind string, confidence double, text string")
