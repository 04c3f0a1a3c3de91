"""Order MinHash fingerprints of texts, and of their edited forms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from packetloom.llm.common import query, slices, staged, table
from packetloom.llm.minhash_dedup import GOLD, U, mix

BLOCK = 1 << 14


class OrderMinHash:
    """Signatures of ``count`` entries. Per entry, the ``least`` minimal occurrence-numbered ``k``-mers of code points under one
    hash function, in text order, are hashed to 32 bits.

    Two texts agree in an entry when they share those k-mers and their order, so the share of equal entries falls with
    moved blocks and repeats as the edit distance does. A text shorter than ``k`` is one k-mer; an empty one has none, and
    its entries equal those of any other empty text.
    """

    def __init__(self, k: int = 8, least: int = 2, count: int = 32, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.k, self.least, self.count = k, least, count
        self.a = rng.integers(0, 2**31, (count, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, (count, 1), dtype=np.uint32)

    def kmers(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hash of each k-mer, and 32-bit hash of it with its occurrence number."""
        n = len(points) - self.k + 1
        if n < 1:
            h = U(len(points))
            acc = np.full(1, h)
            for c in points.astype(U):
                acc = acc * GOLD + c + U(1)
            return mix(acc), mix(acc).astype(np.uint32)
        # polynomial over k points by doubling
        x, width, acc, done, left = points.astype(U) + U(1), 1, None, 0, self.k
        power = GOLD
        with np.errstate(over="ignore"):
            while left:
                if left & 1:
                    piece = x[done:done + n]
                    acc = piece.copy() if acc is None else acc * power + piece
                    done += width
                left >>= 1
                if left:
                    x = x[:-width] * power + x[width:]
                    power = power * power
                    width *= 2
        h = mix(acc)
        # occurrence numbers: position inside the run of equal k-mers once sorted by (k-mer, place)
        place = np.argsort(h, kind="stable")
        group = h[place]
        fresh = np.empty(n, bool)
        fresh[0] = True
        np.not_equal(group[1:], group[:-1], out=fresh[1:])
        again = np.flatnonzero(~fresh)
        numbered = h.astype(np.uint32)
        if len(again):
            first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            at = place[again]
            numbered[at] = mix(h[at] + GOLD * (again - first[again]).astype(U)).astype(np.uint32)
        return h, numbered

    def entries(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(self.count, np.uint32)
        h, x = self.kmers(points)
        m = min(self.least, len(x))
        rows, lows, places = np.arange(self.count), [], []
        for i in range(0, len(x), BLOCK):  # bounded memory, however long the text
            y = self.a * x[i:i + BLOCK] + self.b
            for _ in range(min(m, y.shape[1])):
                at = y.argmin(axis=1)
                lows.append(y[rows, at])
                places.append(at + i)
                y[rows, at] = 2**32 - 1
        where = np.column_stack(places)
        if len(places) > m:  # the least of all blocks; of equal ones, the earlier in the text
            where = np.take_along_axis(where, np.lexsort((where, np.column_stack(lows)), axis=1)[:, :m], 1)
        where.sort(axis=1)
        acc = np.full(self.count, U(m))
        for column in where.T:
            acc = mix(acc * GOLD + h[column])
        return acc.astype(np.uint32)


def hexed(entries: np.ndarray) -> str:
    return entries.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, fingerprint``: the Order MinHash signature of each whole text as hex, one row per input row; null is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = OrderMinHash(**options)
        for whole in batches:
            for part in slices(whole):
                marks = [hexed(sketch.entries(t or "")) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pair(sketch: OrderMinHash, one: tuple, two: tuple) -> dict:
    """The row of a document (id, text, entries) followed by another."""
    n = len(one[1])
    take = n // 4
    edited = one[1][:n - take] + two[1][:take]
    marks = sketch.entries(edited)
    return {"doc_id": one[0], "n_chars": n, "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": hexed(one[2]),
            "edited_fingerprint": hexed(marks), "near_edited": likeness(one[2], marks), "near_next": likeness(one[2], two[2])}


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last quarter is replaced by the beginning of the next text.

    Texts are range-partitioned by id once; a task walks its range in order and holds two texts at a time. The first and
    last text of each range are written aside and joined to the neighbouring range (the last range to the first one).

    Order: id ascending, null ids first, ties by text; a null text is empty. A single document is followed by itself.
    Repeated rows are separate documents. Other columns play no part.
    """
    held = f"{_OUT}, range int, edge string, edge_text string"
    columns = [c.split()[0] for c in held.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, before, out, at = OrderMinHash(**options), None, [], TaskContext.get().partitionId()
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
                            ("near_edited", pa.float64()), ("near_next", pa.float64()), ("range", pa.int32()), ("edge", pa.string()), ("edge_text", pa.string())])
        flush = lambda: pa.RecordBatch.from_pylist([{c: r.get(c) for c in columns} for r in out], schema)
        edge = lambda kind, row: {"doc_id": row[0], "range": at, "edge": kind, "edge_text": row[1]}
        for whole in batches:
            for part in slices(whole, size=4 << 20):
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    now = (i, t or "", sketch.entries(t or ""))
                    out.append(_pair(sketch, before, now) if before else edge("first", now))
                    before = now
                yield flush()
                out = []
        if before:
            out = [edge("last", before)]
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the beginning of a text is a range key so that rows of one id spread; it agrees with the order by whole text
    done = staged(rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text").mapInArrow(run, held), "fingerprints")
    # one row per range; the texts themselves are joined, not gathered
    ends = done.filter("edge = 'last'").select("range")
    ring = ends.select("range", F.coalesce(F.lead("range").over(Window.partitionBy(F.lit(0)).orderBy("range")), F.min("range").over(Window.partitionBy(F.lit(0)))).alias("next"))
    last = done.filter("edge = 'last'").select("range", "doc_id", F.col("edge_text").alias("text"))
    first = done.filter("edge = 'first'").select(F.col("range").alias("next"), F.col("edge_text").alias("next_text"))
    borders = last.join(ring, "range").join(first, "next").select("doc_id", "text", "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = OrderMinHash(**options)
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
                            ("near_edited", pa.float64()), ("near_next", pa.float64())])
        for batch in batches:
            for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True):
                yield pa.RecordBatch.from_pylist([_pair(sketch, (i, a, sketch.entries(a)), (None, b, sketch.entries(b)))], schema)

    return done.filter("edge is null").drop("range", "edge", "edge_text").unionByName(borders.mapInArrow(close, _OUT))


@query("op4_order_minhash")
def op4_order_minhash(spark: SparkSession, d: str) -> DataFrame:
    return edited_likeness(table(spark, d, "documents"))
