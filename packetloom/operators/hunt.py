"""Hunt queries: a request object turned into one Column predicate, sorted and paged."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.columns import tag_string

c = F.col
NUMERIC = frozenset((">", ">=", "<", "<=", "BETWEEN"))
TEXT = frozenset(("=", "!=", "IN", "NOT_IN", "CONTAINS", "STARTS_WITH", "ENDS_WITH"))
ANY = frozenset(("EXISTS", "NOT_EXISTS"))

# Field -> (target, column, type). Operators follow from the type.
FIELDS = {
    "entity.ip": ("ENTITY", "entity", "string"), "entity.role": ("ENTITY", "roles", "string"),
    "entity.attack_state": ("ENTITY", "current_state", "string"), "entity.priority": ("ENTITY", "priority_level", "string"),
    "entity.risk_score": ("ENTITY", "score", "number"), "entity.fanout": ("ENTITY", "peer_count", "number"),
    "entity.port_diversity": ("ENTITY", "targeted_ports_count", "number"), "entity.failure_ratio": ("ENTITY", "failure_ratio", "number"),
    "entity.packet_volume": ("ENTITY", "packet_volume", "number"), "entity.behavior_change": ("ENTITY", "has_change", "boolean"),
    "entity.beaconing": ("ENTITY", "beaconing_detected", "boolean"), "event.type": ("EVENT", "event_type", "string"),
    "event.phase": ("EVENT", "phase", "string"), "phase.state": ("PHASE", "phase", "string"),
    "evidence.technique": ("EVIDENCE", "technique", "string"), "evidence.source": ("EVIDENCE", "source", "string"),
    "campaign.severity": ("CAMPAIGN", "severity", "string"), "campaign.size": ("CAMPAIGN", "episode_count", "number")}


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: Any = None
    to: Any = None


@dataclass(frozen=True)
class Temporal:
    relation: str = "ANY"  # ANY, DURING, BEFORE, AFTER, WITHIN, OVERLAPS
    window: tuple[int, int] | None = None
    reference: int | None = None


@dataclass(frozen=True)
class Request:
    target: str
    predicates: Sequence[Predicate] = ()
    temporal: Temporal = field(default_factory=Temporal)
    sort_by: str | None = None
    descending: bool = True
    scope: str | None = None
    limit: int | None = None  # all rows, unless the caller pages
    offset: int = 0


def allowed_operators(kind: str) -> frozenset[str]:
    return ANY | {"=", "!="} | (NUMERIC if kind == "number" else TEXT if kind == "string" else frozenset())


def predicate(col: Column, op: str, value: Any = None, to: Any = None, is_array: bool = False) -> Column:
    """One comparison: text is case-insensitive, numbers are coerced, a missing value passes only NOT_EXISTS."""
    if op == "EXISTS":
        return col.isNotNull()
    if op == "NOT_EXISTS":
        return col.isNull()
    low = F.lower(col.cast("string")) if not is_array else None
    text = str(value).lower() if not isinstance(value, (list, tuple, set, frozenset)) else None
    if op in ("IN", "NOT_IN"):
        if text is not None:
            raise ValueError(f"{op} needs a list of values")
        hit = col.cast("string").isin(*[str(v) for v in value])
        out = hit if op == "IN" else ~hit
    elif op == "=":
        out = low == text
    elif op == "!=":
        out = low != text
    elif op == "CONTAINS":
        out = F.exists(col, lambda x: F.lower(x.cast("string")).contains(text)) if is_array else low.contains(text)
    elif op == "STARTS_WITH":
        out = low.startswith(text)
    elif op == "ENDS_WITH":
        out = low.endswith(text)
    elif op in NUMERIC:
        n = col.try_cast("double")
        v = float(value)
        out = {">": n > v, ">=": n >= v, "<": n < v, "<=": n <= v}[op] if op != "BETWEEN" else n.between(v, float(to))
    else:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(out, F.lit(False))


def where(request: Request) -> Column:
    """The AND of all predicates; unknown fields, wrong targets and disallowed operators are rejected."""
    cond = F.lit(True)
    for p in request.predicates:
        if p.field not in FIELDS:
            raise ValueError(f"unknown field {p.field}")
        target, col, kind = FIELDS[p.field]
        if target != request.target:
            raise ValueError(f"{p.field} does not belong to {request.target}")
        if p.op not in allowed_operators(kind):
            raise ValueError(f"{p.op} is not allowed on {p.field}")
        cond = cond & predicate(c(col), p.op, p.value, p.to)
    return cond


def temporal(t: Temporal, first: str = "first_seen_window", last: str = "last_seen_window") -> Column:
    f, e = c(first), c(last)
    if t.relation in ("DURING", "OVERLAPS") and t.window:
        out = (e >= t.window[0]) & (f <= t.window[1])
    elif t.relation == "WITHIN" and t.window:
        out = (f >= t.window[0]) & (e <= t.window[1])
    elif t.relation == "BEFORE" and t.reference is not None:
        out = f < t.reference
    elif t.relation == "AFTER" and t.reference is not None:
        out = e > t.reference
    else:
        return F.lit(True)
    return F.coalesce(out, F.lit(False))


def run(df: DataFrame, request: Request, tiebreak: str, first: str = "first_seen_window", last: str = "last_seen_window",
        score: str = "match_score") -> DataFrame:
    """Filter, order and page; the predicate reaches the scan of a stored table."""
    out = df.filter(where(request) & temporal(request.temporal, first, last))
    if request.scope and "scope" in df.columns:
        out = out.filter(c("scope") == request.scope)
    key = request.sort_by if request.sort_by in df.columns else (score if score in df.columns else None)
    order = ([F.desc_nulls_last(key) if request.descending else F.asc_nulls_last(key)] if key else []) + [F.asc(tiebreak)]
    page = out.orderBy(*order).offset(max(request.offset, 0))
    return page if request.limit is None else page.limit(request.limit)


def count_matches(df: DataFrame, request: Request, first: str = "first_seen_window", last: str = "last_seen_window") -> DataFrame:
    """Total matches and whether the page was cut."""
    n = df.filter(where(request) & temporal(request.temporal, first, last)).agg(F.count("*").alias("total"))
    return n.withColumn("truncated", F.lit(False) if request.limit is None else c("total") > request.offset + request.limit)


def evidence_text(facts: DataFrame) -> DataFrame:
    """Why an entity matched, as text parts."""
    return facts.withColumn("supporting_evidence", tag_string(
        (c("targeted_ports_count") >= 5, "MANY_PORTS"), (c("peer_count") >= 5, "WIDE_FANOUT"), (c("failure_ratio") >= 0.5, "HIGH_FAILURE"),
        (c("beaconing_detected"), "BEACONING"), (c("change_count") > 0, "BEHAVIOR_CHANGE")))


def explain(scored: DataFrame, entity: str) -> DataFrame:
    """Why one entity is prioritised."""
    return scored.filter(c("entity") == entity).select(
        "entity", "roles", "priority_level", "score", c("targeted_ports_count").alias("ports"), c("peer_count").alias("fanout"),
        tag_string((F.lit(True), "ROLE_AND_PRIORITY"), (c("targeted_ports_count") >= 5, "PORT_SWEEP"), (c("peer_count") >= 5, "HOST_FANOUT")).alias("reasons"))


_P = Predicate
TEMPLATES: dict[str, Request] = {
    "hunt_recon_fanout": Request("ENTITY", [_P("entity.port_diversity", ">=", 5)], sort_by="targeted_ports_count"),
    "hunt_recon_state": Request("ENTITY", [_P("entity.attack_state", "=", "RECONNAISSANCE")], sort_by="score"),
    "hunt_behavior_change": Request("ENTITY", [_P("entity.behavior_change", "=", True)], sort_by="score"),
    "hunt_beaconing_c2": Request("ENTITY", [_P("entity.beaconing", "=", True)], sort_by="packet_volume"),
    "hunt_technique_t1046": Request("EVIDENCE", [_P("evidence.technique", "=", "T1046")], sort_by="confidence"),
    "hunt_failed_connection_spike": Request("ENTITY", [_P("entity.failure_ratio", ">=", 0.70)], sort_by="failure_ratio"),
    "hunt_incident_events": Request("EVENT", sort_by="timestamp", descending=False),
    "hunt_campaign_clusters": Request("CAMPAIGN", sort_by="episode_count")}


def rollup(df: DataFrame, *columns: str) -> DataFrame:
    """Counts over all prefixes of the columns (severity, then category, then stage)."""
    return df.rollup(*columns).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def cube(df: DataFrame, *columns: str) -> DataFrame:
    return df.cube(*columns).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
