"""Near-duplicate documents by MinHash signatures, banding, verification and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.llm.common import as_bytes, numbered, query, slices, staged, table, unboxed
from packetloom.llm.components import components

U = np.uint64
GOLD, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bucket members are compared in blocks of about so many.
CELL = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``n``-word shingles; fewer words are one shingle, none give none.

    Words are maximal runs without ASCII white space; only A-Z are lower-cased.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    take = min(n, len(words))
    acc = np.full(len(words) - take + 1, U(take))
    for i in range(take):
        acc = mix(acc * GOLD + h[i:len(h) - take + 1 + i])
    return np.unique(acc)


class Hashes:
    """``count`` universal hash functions ``(a x + b mod 2^64) >> 32`` with odd ``a``."""

    def __init__(self, count: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, (count, 1), dtype=U) * U(2) + U(1)
        self.b = rng.integers(0, 2**63, (count, 1), dtype=U)

    def minima(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 2**32 - 1, np.uint32)
        for i in range(0, len(x), 4096):  # bounded memory, however long the text
            block = ((self.a * x[i:i + 4096] + self.b) >> U(32)).astype(np.uint32)
            np.minimum(out, block.min(axis=1), out=out)
        return out


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int, seed: int) -> DataFrame:
    """Per row: id, set size, 128-bit set digest, band keys and minima; an empty set has neither keys nor minima."""
    schema = "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, minima array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(bands * rows, seed)
        salt = np.arange(1, bands + 1, dtype=U) * GOLD
        for whole in batches:
            for part in slices(whole):
                size, d1, d2, keys, minima = [], [], [], [], []
                for text in as_bytes(part.column("text")):
                    s = shingles(text, words)
                    size.append(len(s))
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    d1.append(digest[0])
                    d2.append(digest[1])
                    if len(s):
                        m = hashes.minima(s)
                        acc = salt
                        for column in m.reshape(bands, rows).T.astype(U):
                            acc = mix(acc * GOLD + column)
                        keys.append(acc.view(np.int64))
                        minima.append(m.view(np.int32))
                full = np.array(size, np.int64) > 0
                lists = lambda parts, n, kind: pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(full * n)]).astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.empty(0, kind)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                     lists(keys, bands, np.int64), lists(minima, bands * rows, np.int32)], ["doc_id", "n_shingles", "d1", "d2", "keys", "minima"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, size, items``: the full shingle set of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                sets = [shingles(t, words).view(np.int64) for t in as_bytes(part.column("text"))]
                n = [len(s) for s in sets]
                items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), items], ["doc_id", "size", "items"])

    return docs.mapInArrow(run, "doc_id long, size long, items array<long>")


def _placed(members: DataFrame, links: DataFrame) -> DataFrame:
    """``key, doc_id, component``: bucket members with their component so far."""
    near = components(links, "a", "b").withColumnRenamed("node", "doc_id")
    return staged(members.join(near, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")), "placed")


def _open(placed: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    return staged(placed.join(staged(keys, "open"), "key"), "open-members")


def _across(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that join different components of a bucket.

    The largest component of a bucket and the other members are cut into blocks of about ``CELL``; a task compares two
    blocks, of which at most one belongs to the largest component, through a matrix of shared shingles, and returns a
    spanning forest of the links. No pair is emitted that isn't one.
    """
    count = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    top = count.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / CELL)).cast("int")
    top = staged(top.select("key", F.col("top.component").alias("top"), blocks(F.col("top.n")).alias("many"), blocks(F.col("all") - F.col("top.n")).alias("few")), "tops")
    rows = placed.join(top, "key").withColumn("main", F.col("component") == F.col("top"))
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("main"), F.col("many")).otherwise(F.col("few"))).cast("int")
    # blocks of the largest component are -1, -2, ...; the others 0, 1, ...
    rows = rows.withColumn("own", F.when(F.col("main"), -1 - own).otherwise(own))
    rest = F.sequence(F.lit(0), F.col("few") - 1)
    rows = rows.withColumn("other", F.explode(F.when(F.col("main"), rest).otherwise(F.concat(rest, F.sequence(-F.col("many"), F.lit(-1))))))
    cells = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "doc_id", "component")
    cells = cells.join(sets, "doc_id")

    def run(cell: pa.Table) -> pa.Table:
        ids, comp, side, size = (cell.column(c).to_numpy() for c in ("doc_id", "component", "side", "size"))
        items = cell.column("items").combine_chunks().flatten().to_numpy()
        shingle, column, seen = np.unique(items, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), size)
        shared = seen[column] > 1
        row, column = row[shared], (np.cumsum(seen > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
        common = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            lo, hi = np.searchsorted(column, [at, at + 2048])
            has = np.zeros((len(ids), 2048), np.float32)
            has[row[lo:hi], column[lo:hi] - at] = 1
            common += has[left] @ has[right].T
        hit = (100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)) & (comp[left][:, None] != comp[right][None, :])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        a, b = [], []
        for i, j in zip(*np.nonzero(hit), strict=True):
            p, q = find(comp[left[i]]), find(comp[right[j]])
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(ids[left[i]])
                b.append(ids[right[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return staged(cells.groupBy("key", "i", "j").applyInArrow(run, "a long, b long"), "across")


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8,
                       bands: int = 25, rows: int = 4, seed: int = 11) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row, by links of Jaccard similarity >= ``similarity``.

    1. Rows with equal shingle sets are folded to their smallest id, so copies never meet in a bucket.
    2. Every bucket (band key) first compares its members with its most central one only; pairs pass the signature estimate
       (five standard errors below the threshold) and then the exact comparison of full sets.
    3. Buckets whose members still lie in several components compare them across components, block against block. A pair
       inside one component needs no comparison, so every candidate pair is settled, and no bucket's pairs are ever listed.

    A pair of similarity ``s`` shares no bucket with probability ``(1 - s^rows)^bands`` (2e-8 at 0.85 with the defaults).
    Null, empty and blank texts have an empty set and link with nothing. A null id is its own row with a null component and
    is kept. Rows repeating an id are one node that links if any of its texts does. Other columns play no part.
    """
    sig = staged(signatures(docs, id_col, text_col, words, bands, rows, seed), "signatures")
    full = sig.filter("n_shingles > 0 and doc_id is not null")
    folds = staged(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"))
                   .filter("lead < last").drop("last"), "folds")
    copies = staged(full.select("doc_id", "d1", "d2").join(folds, ["d1", "d2"]).filter("doc_id > lead").select("doc_id", "lead"), "copies")
    keyed = full.select("doc_id", "keys").join(copies, "doc_id", "left_anti").select(F.explode("keys").alias("key"), "doc_id")
    buckets = staged(keyed.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y").select("key"), "buckets")
    members = staged(keyed.join(buckets, "key"), "members")
    wanted = members.select("doc_id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = staged(shingle_sets(texts.join(wanted, "doc_id", "left_semi"), words), "sets")
    minima = staged(full.select("doc_id", "minima").join(wanted, "doc_id", "left_semi"), "minima")
    least = int(bands * rows * similarity - 5 * np.sqrt(bands * rows * similarity * (1 - similarity)))
    percent = round(similarity * 100)

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}_{x}") for c in df.columns])

    def confirmed(pairs: DataFrame) -> DataFrame:
        same = F.size(F.filter(F.zip_with("minima_a", "minima_b", lambda p, q: p == q), lambda p: p))
        likely = pairs.join(side(minima, "a").withColumnRenamed("doc_id_a", "a"), "a").join(side(minima, "b").withColumnRenamed("doc_id_b", "b"), "b")
        likely = likely.filter(same >= least).select("a", "b")
        both = likely.join(side(sets, "a").withColumnRenamed("doc_id_a", "a"), "a").join(side(sets, "b").withColumnRenamed("doc_id_b", "b"), "b")
        inter = F.size(F.array_intersect("items_a", "items_b"))
        return staged(both.withColumn("common", inter).filter(F.expr(f"100L * common >= {percent} * (size_a + size_b - common)")).select("a", "b").distinct(), "links")

    # the member that shares most buckets is close to the others' common source: most of them link with it
    central = staged(members.groupBy("doc_id").agg(F.count("*").alias("n")), "central")
    leads = staged(members.join(central, "doc_id").groupBy("key").agg(F.max(F.struct("n", "doc_id")).alias("top")).select("key", F.col("top.doc_id").alias("lead")), "leads")
    pairs = members.join(leads, "key").filter("doc_id <> lead").select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b")).distinct()
    links = confirmed(pairs)
    second = _across(_open(_placed(members, links)), sets, percent)
    links = links.unionByName(second).unionByName(copies.select(F.col("lead").alias("a"), F.col("doc_id").alias("b")))
    found = components(links, "a", "b").withColumnRenamed("node", "doc_id")
    return (sig.select("doc_id", "n_shingles").join(found, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id. Rows without an id stay.

    Groups are of rows, by their number: rows that repeat an id with unrelated texts are no group, and rows of one id that are
    near copies keep one. Rows keep their numbers on every read (see ``numbered``). Null, empty and blank texts stay; an
    empty table gives an empty one.
    """
    held = numbered(docs, "near-dedup")
    own = F.col("_d").getField
    rows = held.select("_row", own(id_col).cast("long").alias("_id"), own(text_col).cast("string").alias("_text")).filter("_id is not null")
    marks = minhash_components(rows, "_row", "_text", **options).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_component"))
    # only groups of several rows lose any
    many = staged(marks.groupBy("_component").agg(F.count("*").alias("n")).filter("n > 1").select("_component"), "groups")
    grouped = staged(rows.select("_row", "_id").join(marks.join(many, "_component"), "_row"), "grouped")
    first = grouped.groupBy("_component").agg(F.min(F.struct("_id", "_row")).alias("first")).select(F.col("first._row").alias("_row"))
    gone = staged(grouped.select("_row").join(first, "_row", "left_anti"), "gone")
    return unboxed(held.join(gone, "_row", "left_anti"))


_SHINGLES_SQL = r"""
words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from words),
items as (select doc_id, unnest(s) as item from sets),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from items a join items b on a.item = b.item and a.doc_id <> b.doc_id group by all),
links as (select a, b from pairs join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * common >= 85 * (len(x.s) + len(y.s) - common)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on l.a = r.b)
"""


@query("op2_minhash_dedup", f"""with recursive {_SHINGLES_SQL}
select sets.doc_id, len(s)::bigint as n_shingles, c as component_id, sets.doc_id = c as kept
from sets join (select a, min(b) as c from reach group by a) r on r.a = sets.doc_id""")
def op2_minhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return minhash_components(table(spark, d, "documents"), words=3, similarity=0.85)
