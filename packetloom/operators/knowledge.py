"""Evidence property graph as two tables (nodes, edges) and the traversals over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.columns import stable_id
from packetloom.session import durable, shared, stored

c = F.col
NODE = ("id", "node_type", "label", "entity_key", "scope", "window")
#: The kinds of node at the source and the target of each kind of edge.
ENDS = {"COMMUNICATES_WITH": ("IP", "TCP_SESSION"), "TARGETS": ("TCP_SESSION", "IP"), "USES_PORT": ("TCP_SESSION", "PORT"),
        "MAPS_TO_TECHNIQUE": ("FINDING", "MITRE_TECHNIQUE"), "INDICATES": ("BEHAVIOR_SIGNAL", "FINDING"), "PART_OF_EPISODE": ("FINDING", "EPISODE"),
        "MANIFESTS_CHANGE": ("IP", "CHANGE_SIGNAL"), "PART_OF_CAMPAIGN": ("EPISODE", "CAMPAIGN"), "PARTICIPATES_IN_PATTERN": ("IP", "PATTERN"),
        "TRANSITIONS_TO": ("ATTACK_STATE", "ATTACK_STATE"), "EXHIBITS_STATE": ("IP", "ATTACK_STATE"), "TEMPORALLY_PRECEDES": ("FINDING", "FORECAST_SIGNAL")}


#: What identifies a node: a column, or several that ``stable_id`` keeps apart.
Key = Column | tuple[Column, ...]


def _id(kind: str, key: Key) -> Column:
    return stable_id(kind.lower(), *(key if isinstance(key, tuple) else (key,)))


def _node(df: DataFrame, kind: str, key: Key, label: Column, entity: Column | None = None, scope: str = "OBSERVED",
          window: Column | None = None) -> DataFrame:
    null = F.lit(None)
    return df.select(_id(kind, key).alias("id"), F.lit(kind).alias("node_type"), label.cast("string").alias("label"),
                     (entity if entity is not None else null).cast("string").alias("entity_key"), F.lit(scope).alias("scope"),
                     (window if window is not None else null).cast("bigint").alias("window"))


def _edge(df: DataFrame, kind: str, src: Key, dst: Key, src_entity: Column, dst_entity: Column) -> DataFrame:
    a, b = (_id(k, key) for k, key in zip(ENDS[kind], (src, dst)))
    return df.select(a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("edge_type"),
                     src_entity.cast("string").alias("source_key"), dst_entity.cast("string").alias("target_key"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def build_graph(sessions: DataFrame, findings: DataFrame, beacons: DataFrame, episodes: DataFrame, changes: DataFrame, campaigns: DataFrame,
                patterns: DataFrame, transitions: DataFrame, forecasts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from all evidence tables; ids are hashes of keys, so equal things merge.

    Sessions are first reduced to one row per (src, dst, port): a busy pair is one node. Edges keep
    only ends that exist as nodes, and carry the entity of both (``source_key``, ``target_key``).

    Nodes and edges of sessions are most of the graph. They are distinct as they come, and their ends are nodes, so
    they are made from the reduced sessions wherever they are read: only the rest is merged, checked against the nodes and written.
    """
    s = shared(sessions.groupBy("src_ip", "dst_ip", "dst_port").agg(F.count("*").alias("n")))
    skey = (c("src_ip"), c("dst_ip"), c("dst_port"))
    f, b = findings, beacons.filter("is_beaconing")
    bkey = (*skey, c("protocol"))
    ckey = (c("entity"), c("bucket"), c("change_type"))
    tech = F.when(F.lower("attack_category").rlike("scan|recon"), "T1046").when(F.lower("attack_category").rlike("dos|flood"), "T1498")
    ft = f.withColumn("_t", tech).filter("_t IS NOT NULL")
    steps = transitions.select("entity", "from_state", "to_state").distinct()
    skey_state = lambda col: (c("entity"), c(col))
    ip, ent = c("ip"), c("entity")
    ips = _union([s.select(c("src_ip").alias("ip")).distinct(), s.select(c("dst_ip").alias("ip")).distinct(), f.select(ent.alias("ip")).distinct()]).distinct()
    nodes = [
        _node(ips, "IP", ip, ip, ip), _node(s.select("dst_port").distinct(), "PORT", c("dst_port"), c("dst_port"), c("dst_port")),
        _node(f, "FINDING", c("finding_id"), c("attack_category"), ent, window=c("bucket")),
        _node(ft.select("_t").distinct(), "MITRE_TECHNIQUE", c("_t"), c("_t"), c("_t")), _node(b, "BEHAVIOR_SIGNAL", bkey, F.lit("beaconing"), c("src_ip")),
        _node(episodes, "EPISODE", c("episode_id"), c("categories"), ent, window=c("start_window")),
        _node(changes, "CHANGE_SIGNAL", ckey, c("change_type"), ent, window=c("bucket")),
        _node(campaigns, "CAMPAIGN", c("campaign_id"), c("campaign_id"), ent, window=c("start_window")),
        _node(patterns, "PATTERN", c("pattern_id"), c("pattern_type"), ent, window=c("start_window")),
        _node(steps, "ATTACK_STATE", skey_state("from_state"), c("from_state"), ent), _node(steps, "ATTACK_STATE", skey_state("to_state"), c("to_state"), ent),
        _node(forecasts, "FORECAST_SIGNAL", c("horizon"), F.concat(F.lit("T+"), c("horizon")), scope="FORECAST")]
    # one row per id: grouped minimum combines map-side, unlike a window per id
    few = stored(_union(nodes).groupBy("id").agg(*[F.min(x).alias(x) for x in NODE[1:]]))
    last = f.groupBy("entity").agg(F.max_by("finding_id", F.struct("bucket", "finding_id")).alias("finding_id"))
    fid, eid, pid, cid = (c(n) for n in ("finding_id", "episode_id", "pattern_id", "campaign_id"))
    sure = [
        _edge(ft, "MAPS_TO_TECHNIQUE", fid, c("_t"), ent, c("_t")),
        _edge(b.join(f.select("entity", "finding_id"), b.src_ip == f.entity), "INDICATES", bkey, fid, ent, ent),
        _edge(f.join(episodes.select("entity", "episode_id", "start_window", "end_window"), "entity").filter(
            c("bucket").between(c("start_window"), c("end_window"))), "PART_OF_EPISODE", fid, eid, ent, ent),
        _edge(episodes.join(campaigns.select("entity", "campaign_id", c("start_window").alias("_a"), c("end_window").alias("_b")), "entity").filter(
            (c("start_window") >= c("_a")) & (c("end_window") <= c("_b"))), "PART_OF_CAMPAIGN", eid, cid, ent, ent),
        _edge(steps.filter("from_state <> to_state"), "TRANSITIONS_TO", skey_state("from_state"), skey_state("to_state"), ent, ent)]
    from_ip = [
        _edge(changes, "MANIFESTS_CHANGE", ent, ckey, ent, ent), _edge(patterns, "PARTICIPATES_IN_PATTERN", ent, pid, ent, ent),
        _edge(steps.select("entity", "to_state").distinct(), "EXHIBITS_STATE", ent, skey_state("to_state"), ent, ent)]
    to_forecast = _edge(last.withColumn("horizon", F.explode(F.array(*[F.lit(k) for k in range(1, 6)]))), "TEMPORALLY_PRECEDES", fid, c("horizon"), ent, F.lit(None))
    ids = lambda kind, end: few.filter(c("node_type") == kind).select(c("id").alias(end))
    rest = _union([*sure, _union(from_ip).join(ids("IP", "source_id"), "source_id", "left_semi").select("source_id", "target_id", "edge_type", "source_key", "target_key"),
                   to_forecast.join(ids("FORECAST_SIGNAL", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "edge_type", "source_key", "target_key")])
    e = _union([
        _edge(s, "COMMUNICATES_WITH", c("src_ip"), skey, c("src_ip"), c("src_ip")), _edge(s, "TARGETS", skey, c("dst_ip"), c("src_ip"), c("dst_ip")),
        _edge(s, "USES_PORT", skey, c("dst_port"), c("src_ip"), c("dst_port")), stored(rest.distinct())])
    n = _union([few, _node(s, "TCP_SESSION", skey, F.concat_ws(":", *skey), c("src_ip")).select(*few.columns)])
    return n, e.withColumn("edge_id", stable_id("edge", c("source_id"), c("target_id"), c("edge_type")))


def _of_kinds(nodes: DataFrame, kinds: Sequence[str], end: int) -> DataFrame:
    """The nodes that can be the source (``end`` 0) or target (1) of edges of these kinds; all where a kind is not in ``ENDS``."""
    return nodes.filter(c("node_type").isin(*{ENDS[k][end] for k in kinds})) if set(kinds) <= set(ENDS) else nodes


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per entity the nodes one step away, in either direction, that belong to someone else."""
    kind = lambda end: F.element_at(F.create_map(*[F.lit(v) for k, ends in ENDS.items() for v in (k, ends[end])]), c("edge_type"))
    step = edges.select(c("source_key").alias("entity_key"), c("target_id").alias("other"), kind(1).alias("neighbour_type"), c("target_key").alias("other_key")).unionByName(
        edges.select(c("target_key").alias("entity_key"), c("source_id").alias("other"), kind(0).alias("neighbour_type"), c("source_key").alias("other_key")))
    far = step.filter("entity_key IS NOT NULL AND (other_key IS NULL OR other_key <> entity_key)")
    return far.select("entity_key", "other", "neighbour_type").distinct()


def edges_of_kind(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str], target_type: str | None = None) -> DataFrame:
    """(node, evidence) along the given edge kinds: supporting, preceding, contradicting, technique, related."""
    e = edges.filter(c("edge_type").isin(*kinds)).select(c("target_id").alias("id"), c("source_id").alias("evidence_id"), "edge_type")
    n = _of_kinds(nodes, kinds, 1) if target_type is None else nodes.filter(c("node_type") == target_type)
    return e.join(n.select("id", "label", "node_type"), "id")


def two_hop(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per IP: session peers out and in, and ports, two steps away."""
    to_session, from_session = ([k for k, ends in ENDS.items() if ends[i] == "TCP_SESSION"] for i in (1, 0))
    e1 = edges.filter(c("edge_type").isin(*to_session)).select(c("source_key").alias("entity"), c("target_id").alias("sid"))
    e2 = edges.filter(c("edge_type").isin(*from_session)).select(c("source_id").alias("sid"), (c("edge_type") == "USES_PORT").alias("_port"), c("target_key").alias("far_key"))
    hop = e1.join(e2, "sid").filter("far_key <> entity").select("entity", "_port", "far_key").distinct()
    out = hop.select("entity", F.when(c("_port"), "PORT").otherwise("OUT_PEER").alias("relation"), c("far_key").alias("other"))
    inn = hop.filter("NOT _port").select(c("far_key").alias("entity"), F.lit("IN_PEER").alias("relation"), c("entity").alias("other"))
    return out.unionByName(inn)


def evidence_chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per finding and forecast node how many predecessors ground it, and of which kinds."""
    end = nodes.filter("node_type IN ('FINDING', 'FORECAST_SIGNAL')").select("id", "node_type", "label", "scope")
    kinds = ("SUPPORTS", "CORRELATES_WITH", "INDICATES", "TEMPORALLY_PRECEDES")
    # kinds whose ends are known meet nodes of those kinds only
    part = lambda some: edges.filter(c("edge_type").isin(*some)).join(_of_kinds(nodes, some, 0).select(c("id").alias("source_id"), c("node_type").alias("src_type")), "source_id")
    e = part([k for k in kinds if k in ENDS]).unionByName(part([k for k in kinds if k not in ENDS]))
    e = e.groupBy(c("target_id").alias("id")).agg(
        F.count("*").alias("predecessors"), F.array_join(F.array_sort(F.collect_set("src_type")), ",").alias("predecessor_types"))
    return end.join(e, "id", "left").withColumns({"predecessors": F.coalesce("predecessors", F.lit(0).cast("bigint")),
                                                  "predecessor_types": F.coalesce("predecessor_types", F.lit("direct observation"))})


def backward_trace(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """All transitive predecessors of the start nodes with their distance: one join per level over the new frontier."""
    typed = "edge_type" in edges.columns
    by_kind = edges.select(c("target_id").alias("id"), c("source_id").alias("prev"), c("edge_type") if typed else F.lit("").alias("edge_type"))
    # edges that can't end at the frontier are left out
    kind_of = _kind_of("id")
    seen = stored(starts.select(c("id").alias("start"), c("id"), F.lit(0).alias("depth")))
    frontier = seen
    depth = 0
    while True:
        depth += 1
        kinds = {x[0] for x in frontier.select(kind_of).distinct().collect()} if typed else set()
        step = by_kind
        if kinds and None not in kinds:
            step = by_kind.filter(~c("edge_type").isin(*[k for k, ends in ENDS.items() if ends[1] not in kinds]))
        step = step.select("id", "prev").distinct()
        nxt = frontier.select("start", "id").join(step, "id").select("start", c("prev").alias("id")).distinct()
        nxt = stored(nxt.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if nxt.isEmpty():
            break
        seen, frontier = seen.unionByName(nxt), nxt
    return seen


def _kind_of(id_col: str) -> Column:
    """The kind of a node, which ``build_graph``'s ids begin with; null for ids of another make."""
    kind = F.upper(F.regexp_replace(id_col, "_[0-9a-f]{64}$", ""))
    return F.when(kind.isin(*{k for ends in ENDS.values() for k in ends}), kind)


def parent_pointers(edges: DataFrame, kinds: Sequence[str] = ("DERIVED_FROM", "INDICATES", "FORECASTS"), starts: DataFrame | None = None) -> DataFrame:
    """``id, parent``: the one node a backward trace goes on to: the target of a node's own edge, else the source of an edge of
    ``kinds`` that points to it; of several the smallest id. Nodes with neither have no row.

    With ``starts`` (``id``) nodes of kinds that no chain from them can come to may be left out: their edges are not read.
    """
    if starts is not None:
        near = {x[0] for x in starts.select(_kind_of("id")).distinct().collect()}
        if None not in near and edges.filter(c("edge_type").isNull() | ~c("edge_type").isin(*ENDS)).isEmpty():
            while more := ({b for a, b in ENDS.values() if a in near} | {a for k, (a, b) in ENDS.items() if k in kinds and b in near}) - near:
                near |= more
            edges = edges.filter(c("edge_type").isin(*[k for k, (a, b) in ENDS.items() if a in near or (k in kinds and b in near)]))
    own = edges.groupBy(c("source_id").alias("id")).agg(F.min("target_id").alias("_own"))
    held = edges.filter(c("edge_type").isin(*kinds)).groupBy(c("target_id").alias("id")).agg(F.min("source_id").alias("_held"))
    return own.join(held, "id", "full").select("id", F.coalesce("_own", "_held").alias("parent"))


def trace_roots(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, root, depth, cyclic`` for each start (``id``): where its chain of parents ends, and after how many steps.

    Pointer doubling: round ``k`` knows the node ``2**k`` steps up, so the rounds are the logarithm of the longest chain, and
    every round is one join of the pointers with themselves. A chain that runs into a cycle has no end: its root is the
    smallest id of that cycle, ``cyclic`` is true and ``depth`` is null. A start without a parent is its own root.
    """
    first = parents.filter("parent IS NOT NULL").select("id", "parent").groupBy("id").agg(F.min("parent").alias("parent"))
    known = first.select("id").unionByName(first.select(c("parent").alias("id"))).unionByName(starts.select("id")).distinct()
    # up: the node reached, steps: how many it took, open: whether the chain goes on, low: the smallest id on the way, the start included
    now = stored(known.join(first, "id", "left").select("id", F.coalesce("parent", "id").alias("up"), c("parent").isNotNull().cast("bigint").alias("steps"),
                                                        c("parent").isNotNull().alias("open"), c("id").alias("low")))
    n, reach = now.count(), 1
    while True:
        far = now.select(c("id").alias("up"), c("up").alias("_up"), c("steps").alias("_steps"), c("open").alias("_open"), c("low").alias("_low"))
        on = now.filter("open").join(far, "up").select("id", c("_up").alias("up"), (c("steps") + c("_steps")).alias("steps"), c("_open").alias("open"), F.least("low", "_low").alias("low"))
        now = stored(on.unionByName(now.filter("NOT open")))  # a chain that has ended stays as it is
        reach *= 2
        # a chain that goes on after as many steps as there are nodes is a cycle
        if reach >= n or now.filter("open").isEmpty():
            break
    ring = now.filter("open").select(c("id").alias("up"), c("low").alias("_ring"))
    out = starts.select("id").distinct().join(now, "id").join(ring, "up", "left")
    return out.select(c("id").alias("start"), F.coalesce("_ring", "up").alias("root"), F.when(c("_ring").isNull(), c("steps")).alias("depth"), c("_ring").isNotNull().alias("cyclic"))


def trace_path(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, depth, id``: the whole chain of each start, a row a step, the start at depth 0; a cycle is walked once.

    The known part of each path is doubled in every round.
    """
    jump = durable(parents.filter("parent IS NOT NULL").groupBy("id").agg(F.min("parent").alias("up")))
    path = durable(starts.select(c("id").alias("start"), F.lit(0).cast("bigint").alias("depth"), "id").distinct())
    length = 1
    while True:
        more = path.join(jump, "id").select("start", (c("depth") + length).alias("depth"), c("up").alias("id"))
        seen = path.unionByName(more).groupBy("start", "id").agg(F.min("depth").alias("depth"))
        grown = durable(seen.select("start", "depth", "id"))
        if grown.count() == path.count():
            return grown
        path, length = grown, 2 * length
        far = jump.select(c("id").alias("up"), c("up").alias("_up"))
        jump = durable(jump.join(far, "up").select("id", c("_up").alias("up")))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.groupBy(F.lit("node_type").alias("kind"), c("node_type").alias("value")).agg(F.count("*").alias("n"))
    s = nodes.groupBy(F.lit("scope").alias("kind"), c("scope").alias("value")).agg(F.count("*").alias("n"))
    e = edges.groupBy(F.lit("edge_type").alias("kind"), c("edge_type").alias("value")).agg(F.count("*").alias("n"))
    return a.unionByName(s).unionByName(e)


def entity_context(nodes: DataFrame) -> DataFrame:
    """Nodes per entity by type."""
    return nodes.filter("entity_key IS NOT NULL").groupBy("entity_key", "node_type").agg(
        F.count("*").alias("nodes"), F.min("window").alias("first_window"), F.max("window").alias("last_window"))
