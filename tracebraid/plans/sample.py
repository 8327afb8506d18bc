"""The sample tables taken through both stages; each table is a lazy DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expressions import normalize_service
from ..functions.predicates import trace_error
from ..operators import evaluation, evidence, incident, masking, observations, structural
from ..operators.graph import cut
from ..sources.telemetry import sample_telemetry

#: Groups of cases with one topology; masked share and threshold of the sample runs.
GROUPS, RATIO = 4, 0.4
EDGE = ["source", "relation", "target"]


class Sample:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = sample_telemetry(spark, sf_dir)

    @cached_property
    def cases(self) -> DataFrame:
        return self.t.starts.select("case_id", F.concat(F.lit("sys-"), F.substring_index("case_id", "-", -1).cast("int") % GROUPS).alias("group_id"))

    @cached_property
    def collected(self) -> DataFrame:
        """Observations of both windows, for queries that read a few kinds of them once."""
        return observations.collect_windows(self.t.traces, self.t.metrics, self.t.logs, F.lit("shop"))

    @cached_property
    def both_windows(self) -> DataFrame:
        return cut(self.collected)

    @cached_property
    def observed(self) -> DataFrame:
        """Observations of both windows."""
        return self.both_windows.drop("normal_count", "normal_text")

    @cached_property
    def observed_normal(self) -> DataFrame:
        return observations.normal_only(self.both_windows)

    @cached_property
    def relations(self) -> DataFrame:
        """The reference topology: what both windows support, with its group."""
        r = structural.recover(self.observed).filter("selected").select("case_id", *EDGE)
        return cut(r.join(self.cases, "case_id"))

    @cached_property
    def stage1(self) -> dict[str, DataFrame]:
        return evaluation.stage1(self.relations, self.observed_normal, self.cases, RATIO, logic=structural.psl)

    @cached_property
    def calls_normal(self) -> DataFrame:
        """Calls of the normal window: the only observations of two services, so those that propagation edges come from."""
        rows = self.both_windows.filter("evidence_kind = 'trace_parent_child'") if "both_windows" in self.__dict__ else observations.collect_calls(self.t.traces)
        return observations.normal_only(rows)

    @cached_property
    def known(self) -> DataFrame:
        r = structural.recover(self.calls_normal).filter("selected")
        return cut(evaluation.with_positions(structural.propagation_edges(r)))

    def picks(self, of: int = 5, first: int = 2) -> DataFrame:
        """Places of edges to be masked: of every ``of`` the ``first`` ones; a rule that SQL can say, unlike a seeded sample."""
        place = (F.col("pos") - 1).alias("place")
        return self.known.select("case_id", place).filter(F.col("place") % of < first)

    @cached_property
    def hidden(self) -> tuple[DataFrame, DataFrame]:
        """Known edges with hidden labels, and the hidden ones' truth."""
        visible, truth = masking.causal_mask(self.known, self.gold_edges, RATIO, picks=self.picks())
        return cut(visible), cut(truth)

    @cached_property
    def evidence(self) -> DataFrame:
        return cut(evidence.evidence(self.t))

    @cached_property
    def symptoms(self) -> DataFrame:
        return cut(evidence.symptoms(self.known, self.evidence))

    @cached_property
    def gold_spans(self) -> DataFrame:
        """Pairs of failing spans in the abnormal window, callee first, with their number."""
        t = self.t.traces.filter("win = 'abnormal'").filter(trace_error(self.t.traces))
        # Edges, roots and alarms read it.
        return cut(observations.call_counts(t).select("case_id", F.col("callee").alias("source"), F.col("caller").alias("target"), F.col("times").alias("n")))

    @cached_property
    def gold_edges(self) -> DataFrame:
        return cut(self.gold_spans.select("case_id", "source", F.lit("causal_propagates_to").alias("relation"), "target"))

    def _first_two(self, end: str) -> DataFrame:
        n = self.gold_spans.groupBy("case_id", F.col(end).alias("node")).agg(F.sum("n").alias("n"))
        rank = F.expr("row_number() OVER (PARTITION BY case_id ORDER BY n DESC, node)")
        return n.withColumn("rank", rank).filter("rank <= 2").select("case_id", "node")

    @cached_property
    def gold_roots(self) -> DataFrame:
        return cut(self._first_two("source"))

    @cached_property
    def alarms(self) -> DataFrame:
        return cut(self._first_two("target"))

    @cached_property
    def prediction(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        h, edges, roots = incident.predict(self.known, self.evidence, self.symptoms)
        return h, cut(edges), cut(roots)

    @cached_property
    def rca(self) -> DataFrame:
        s = self.stage1
        topologies = cut(evaluation.conditions(s["visible"], s["added"], self.relations))
        return cut(evaluation.topology_rca(topologies, self.evidence, self.symptoms, self.gold_edges, self.gold_roots, self.alarms, self.cases))

    def services(self) -> DataFrame:
        s = self.t.traces.select("service_name").distinct()
        return s.withColumn("normalized", normalize_service("service_name"))
