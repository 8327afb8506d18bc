"""Relation types, entity kinds, priors, column names, table schemas."""

from __future__ import annotations

#: Relation types of an operational topology, by the kinds they join (fixed values).
RELATION_BY_KINDS = {
    ("service", "service"): "calls",
    ("service", "pod"): "deployed_on",
    ("pod", "node"): "runs_on",
    ("service", "database"): "uses_database",
    ("service", "messaging"): "uses_messaging",
    ("system", "service"): "has_service",
}
STRUCTURAL = tuple(RELATION_BY_KINDS.values())

#: How strongly a kind of evidence supports a relation (fixed values); any other pair has GENERIC_PRIOR.
PRIORS = {
    ("trace_parent_child", "calls"): 0.98,
    ("service_pod_cooccurrence", "deployed_on"): 0.98,
    ("pod_node_cooccurrence", "runs_on"): 0.98,
    ("db_client_context", "uses_database"): 0.95,
    ("messaging_context", "uses_messaging"): 0.95,
    ("system_inventory", "has_service"): 1.0,
}
GENERIC_PRIOR = 0.35

#: Labels of incident edges (fixed values).
CAUSAL = "causal_propagates_to"
NON_CAUSAL = "non_causal_dependency"
MASKED = "__MASKED_RELATION__"
OBSERVED = "dependency_propagates_to"
MASKED_STRUCTURAL = "__MASKED_STRUCTURAL_RELATION__"

#: Functional relations: one target per source, or one source per target.
ONE_TARGET, ONE_SOURCE = "runs_on", "has_service"

#: Columns that may hold an attribute, in order of preference (fixed values).
POD_COLUMNS = ("attr.k8s.pod.name", "k8s.pod.name", "resource.k8s.pod.name")
NODE_COLUMNS = ("attr.k8s.node.name", "k8s.node.name", "resource.k8s.node.name", "attr.host.name", "host.name")
DB_SYSTEM_COLUMNS = ("attr.db.system", "db.system", "attr.db.system.name", "db.system.name")
DB_TARGET_COLUMNS = (
    "attr.server.address",
    "server.address",
    "attr.net.peer.name",
    "net.peer.name",
    "attr.db.namespace",
    "db.namespace",
    "attr.db.name",
    "db.name",
)
MSG_SYSTEM_COLUMNS = ("attr.messaging.system", "messaging.system")
MSG_TARGET_COLUMNS = (
    "attr.messaging.destination.name",
    "messaging.destination.name",
    "attr.messaging.destination",
    "messaging.destination",
    "attr.server.address",
    "server.address",
)

#: Phrases of the relations in claims (fixed values).
PHRASES = {
    "calls": "calls",
    "deployed_on": "is deployed on",
    "runs_on": "runs on",
    "uses_database": "uses the database",
    "uses_messaging": "uses the messaging target",
    "has_service": "contains the service",
}

EDGE = "struct<source:string,relation:string,target:string>"
OBSERVATION_COLUMNS = ("case_id", "observation_id", "source", "target", "evidence_kind", "confidence", "text", "observation_count")
#: One case per JSON line; edges may be objects or lists of three.
CASE_SCHEMA = (
    "case_id string, symptom_nodes array<string>, known_edges variant, evidence array<struct<evidence_id:string,node:string,kind:string,"
    "signal:string,abnormality:double,timestamp:double,text:string,metadata:variant>>, structural_relations variant, "
    "relation_observations array<struct<observation_id:string,source:string,target:string,evidence_kind:string,confidence:double,"
    "text:string,metadata:variant>>, gold_root_causes array<string>, gold_edges variant, gold_paths array<array<string>>, "
    "gold_alarm_nodes array<string>, metadata variant"
)

#: Marks of a reference that was made from the model's own observations (fixed values).
DERIVED = ("observation_abduction", "telemetry_observation", "collector_observation", "recover_structural_relations")
