"""Near-duplicate embeddings by sorted random projection passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.llm.common import query, running_sum, staged, table
from packetloom.llm.components import components

#: Sorted rows are compared inside segments of so many rows; a segment also holds the first rows of the next one.
SEGMENT = 2048
#: Members of a component are counted against one another in blocks of about so many vectors.
BLOCK = 512


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, group_col: str) -> DataFrame:
    """``vec_id, grp, dim, unit``: vectors of length one in double precision; unusable ones are left out.

    Left out: null ids, groups and vectors, empty vectors, zero vectors, null or non-finite components. The vector is
    divided by its largest component first, so neither squares nor sums overflow.
    """
    v = F.col(vector_col).cast("array<double>")
    ok = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(group_col).cast("string").alias("grp"), v.alias("v")).filter(
        F.col(id_col).isNotNull() & F.col(group_col).isNotNull() & ok)
    rows = rows.withColumn("top", F.array_max(F.transform("v", F.abs))).filter("top > 0").withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    return rows.select("vec_id", "grp", F.size("v").alias("dim"), F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def projected(units: DataFrame, passes: int, hashes: int, seed: int) -> DataFrame:
    """One row per vector and pass with its sort key: ``hashes`` concatenated random hashes.

    A hash is the axis (with sign) on which a random rotation of the vector is longest, one of ``2 * dim`` values, so
    close vectors mostly share it and others seldom do.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in turns:
                    turns[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((passes, hashes, dim, dim))
                x = _matrix(part.column("unit"))
                for p in range(passes):
                    key = np.zeros((len(x), hashes), ">u4")
                    for h in range(hashes):
                        y = x @ turns[dim][p, h]
                        axis = np.abs(y).argmax(axis=1)
                        key[:, h] = 2 * axis + (y[np.arange(len(x)), axis] < 0)
                    keys = pa.array([k.tobytes() for k in key], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), part.column("grp"), part.column("dim"), keys, part.column("vec_id"), part.column("unit")],
                                                     ["pass", "grp", "dim", "key", "vec_id", "unit"])

    return units.mapInArrow(run, "pass int, grp string, dim int, key binary, vec_id long, unit array<double>")


def _window_links(window: int, least: float):
    """Compare each row with its next ``window`` rows and return a spanning forest of the pairs at or above ``least``."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("place", "ascending")])
        ids, place = group.column("vec_id").to_numpy(), group.column("place").to_numpy()
        start = place[0] // SEGMENT * SEGMENT
        own = place < start + SEGMENT  # the other rows only serve as right ends
        block = group.column("grp").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        run_of = (group.column("pass").to_numpy().astype(np.int64) << 40) + block
        dim = group.column("dim").to_numpy()
        root = np.arange(len(ids))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        a, b = [], []
        for d in np.unique(dim):
            at = np.flatnonzero(dim == d)
            x = _matrix(group.column("unit").combine_chunks().take(pa.array(at)))
            for step in range(1, min(window, len(at) - 1) + 1):
                left, right = at[:-step], at[step:]
                fit = (run_of[left] == run_of[right]) & own[left]
                near = fit & (np.einsum("ij,ij->i", x[:-step], x[step:]) >= least)
                for i, j in zip(left[near], right[near], strict=True):
                    p, q = find(i), find(j)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        a.append(ids[i])
                        b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _across_links(least: float):
    """A spanning forest of the links between different components of two blocks (or of one)."""
    def run(group: pa.Table) -> pa.Table:
        ids, comp, side = (group.column(c).to_numpy() for c in ("vec_id", "component", "side"))
        x = _matrix(group.column("unit").combine_chunks())
        left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
        hit = (x[left] @ x[right].T >= least) & (comp[left][:, None] != comp[right][None, :])
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = root.setdefault(root[c], root[c])
                c = root[c]
            return c

        a, b = [], []
        for i, j in zip(*np.nonzero(hit), strict=True):
            p, q = find(comp[left[i]]), find(comp[right[j]])
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(ids[left[i]])
                b.append(ids[right[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def across_runs(placed: DataFrame, units: DataFrame, found: DataFrame, window: int, prefix: int, similarity: float) -> DataFrame:
    """``a, b``: links between different components inside runs of more than ``window`` + 1 rows of a pass that share their first
    ``prefix`` hashes; shorter runs lie inside the window.

    A run that is one component already needs no comparison. Of the others, the largest component and the remaining members are
    cut into blocks of about ``BLOCK``; one task compares two blocks, of which at most one belongs to the largest component.
    """
    run = ["pass", "grp", "dim", "run"]
    rows = placed.select("pass", "grp", "dim", F.substring("key", 1, 4 * prefix).alias("run"), "vec_id")
    long = staged(rows.groupBy(*run).agg(F.count("*").alias("n")).filter(F.col("n") > window + 1).select(*run), "runs")
    rows = rows.join(long, run).join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    rows = staged(rows.withColumn("component", F.coalesce("component", "vec_id")), "run-members")
    count = rows.groupBy(*run, "component").agg(F.count("*").alias("n"))
    top = count.groupBy(*run).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all")).filter(F.col("all") > F.col("top.n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    top = staged(top.select(*run, F.col("top.component").alias("top"), blocks(F.col("top.n")).alias("many"), blocks(F.col("all") - F.col("top.n")).alias("few")), "run-tops")
    rows = rows.join(top, run).withColumn("main", F.col("component") == F.col("top"))
    own = F.pmod(F.xxhash64("vec_id"), F.when(F.col("main"), F.col("many")).otherwise(F.col("few"))).cast("int")
    # blocks of the largest component are -1, -2, ...; the others 0, 1, ...
    rows = rows.withColumn("own", F.when(F.col("main"), -1 - own).otherwise(own))
    rest = F.sequence(F.lit(0), F.col("few") - 1)
    rows = rows.withColumn("other", F.explode(F.when(F.col("main"), rest).otherwise(F.concat(rest, F.sequence(-F.col("many"), F.lit(-1))))))
    cells = rows.select(*run, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "vec_id", "component")
    return cells.join(units.select("vec_id", "unit"), "vec_id").groupBy(*run, "i", "j").applyInArrow(_across_links(similarity), "a long, b long")


def _block_counts(least: float):
    """Links of each vector of one block, copies included, with the vectors of another block (or of its own)."""
    def run(group: pa.Table) -> pa.Table:
        ids, side, copies = group.column("vec_id").to_numpy(), group.column("mine").to_numpy(), group.column("copies").to_numpy()
        x = _matrix(group.column("unit").combine_chunks())
        same = bool(group.column("same")[0].as_py())
        left = np.flatnonzero(side)
        right = left if same else np.flatnonzero(~side)
        if not len(left) or not len(right):
            return pa.table({"vec_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        hit = x[left] @ x[right].T >= least
        if same:
            hit &= ids[left][:, None] != ids[right][None, :]
            counts, names = hit @ copies[right] + copies[left] - 1, ids[left]
        else:
            counts, names = np.concatenate([hit @ copies[right], copies[left] @ hit]), np.concatenate([ids[left], ids[right]])
        return pa.table({"vec_id": pa.array(names, pa.int64()), "n": pa.array(counts, pa.int64())})
    return run


def count_links(members: DataFrame, similarity: float) -> DataFrame:
    """``vec_id, n``: direct links of each member of a component (``vec_id, component, dim, unit, copies``).

    A component is cut into blocks of about ``BLOCK`` vectors by a hash of the id; one task compares one pair of blocks
    and returns counts, so no pair of vectors is ever emitted and memory stays bounded however large the component.
    """
    sizes = staged(members.groupBy("component", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    rows = members.join(sizes, ["component", "dim"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "vec_id", "unit", "copies", (F.col("block") <= F.col("other")).alias("mine"), (F.col("block") == F.col("other")).alias("same"))
    parts = cells.groupBy("component", "dim", "i", "j").applyInArrow(_block_counts(similarity), "vec_id long, n long")
    return parts.groupBy("vec_id").agg(F.sum("n").alias("n"))


def embedding_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", similarity: float = 0.98,
                         passes: int = 12, hashes: int = 4, window: int = 16, seed: int = 5) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row, by links of cosine >= ``similarity`` inside a group.

    Equal vectors are folded to the smallest id first. Each pass sorts the others by (group, concatenated random hashes) in one
    global order, compares every vector with its next ``window`` neighbours and keeps a spanning forest of the verified pairs;
    the passes' forests are united into components. The order is cut into segments by position, so no key is too hot for a
    task. Vectors that share all hashes of a pass but the last are all compared unless they are in one component by then: in
    the window, or block against block where they are more than it holds. Links are then counted inside components, block
    against block: every link lies inside one, so a count misses a link only if no chain of verified pairs of any pass joins
    its ends.

    Null, empty, zero and non-finite vectors and null groups or ids link with nothing (0 links, own component, kept).
    Vectors of unequal length don't link. Rows repeating an id are one vector with the content of the smallest row; each
    such row is returned. Ties in the sort key are ordered by a hash of id and pass. Other columns play no part.
    """
    src = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(group_col).alias("label"))
    units = unit_vectors(src, "vec_id", "embedding", "label")
    units = staged(units.groupBy("vec_id").agg(F.min(F.struct("grp", "dim", "unit")).alias("x")).select("vec_id", "x.*"), "units")
    same = ["grp", "dim", "unit"]
    folds = staged(units.groupBy(*same).agg(F.min("vec_id").alias("lead"), F.count("*").alias("copies")).filter("copies > 1"), "folds")
    copies = staged(units.join(folds, same).filter("vec_id > lead").select("vec_id", "lead"), "copies")
    leads = units.join(copies, "vec_id", "left_anti").join(folds.select(F.col("lead").alias("vec_id"), "copies"), "vec_id", "left")
    leads = staged(leads.withColumn("copies", F.coalesce("copies", F.lit(1).cast("long"))), "leads")
    order = ["pass", "grp", "dim", "key", "tie", "vec_id"]
    keyed = projected(leads.drop("copies"), passes, hashes, seed).withColumn("one", F.lit(1)).withColumn("tie", F.xxhash64("pass", "vec_id"))
    rows, placed = running_sum(keyed, order, ["one"], "passes")
    rows = rows.withColumnRenamed("before_one", "place")
    seg, rest = F.floor(F.col("place") / SEGMENT), F.col("place") % SEGMENT
    rows = rows.withColumn("segment", F.explode(F.when((rest < window) & (seg > 0), F.array(seg, seg - 1)).otherwise(F.array(seg))))
    # the running-sum row that opens a segment belongs to it; rows of the next one come after
    pairs = rows.select("segment", "place", "pass", "grp", "dim", "vec_id", "unit").groupBy("segment").applyInArrow(_window_links(window, similarity), "a long, b long")
    pairs = staged(pairs, "near")
    near = staged(components(pairs, "a", "b"), "near-components")
    across = across_runs(placed, leads, near, window, max(1, hashes - 1), similarity)
    pairs = pairs.unionByName(staged(across, "across")).unionByName(copies.select(F.col("lead").alias("a"), F.col("vec_id").alias("b")))
    found = staged(components(pairs, "a", "b"), "components")
    members = staged(leads.join(found.withColumnRenamed("node", "vec_id"), "vec_id"), "members")
    links = staged(count_links(members, similarity), "link-counts")
    links = links.unionByName(copies.join(links.withColumnRenamed("vec_id", "lead"), "lead").select("vec_id", "n"))
    out = src.select("vec_id").join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left").join(links, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
                      F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


@query("op1_projection_dedup", """with recursive
ok as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len(embedding) > 0
       and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
          where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on l.a = r.b)
select v.vec_id, coalesce(n, 0)::bigint as n_links, c as component_id, v.vec_id = c as kept
from embeddings v join (select a, min(b) as c from reach group by a) r on r.a = v.vec_id left join (select a, count(*) as n from links group by a) l on l.a = v.vec_id""")
def op1_projection_dedup(spark: SparkSession, d: str) -> DataFrame:
    return embedding_components(table(spark, d, "embeddings"))
