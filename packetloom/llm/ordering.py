"""Training-order materialisation: a keyed permutation gives every token sequence a slot; shards hold consecutive slots."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.llm.bpe import load
from packetloom.llm.common import query, scratch, slices, staged, table
from packetloom.llm.minhash_dedup import GOLD, U, mix
from packetloom.llm.packing import END_ID, tokenizer_path

ROUNDS = 6


class Feistel:
    """A keyed bijection of ``0 .. size-1``: a balanced Feistel network over the next power of four, walked until inside."""

    def __init__(self, size: int, key: int):
        half = max(1, -(-max(size - 1, 1).bit_length() // 2))
        self.size, self.half, self.mask = size, U(half), U((1 << half) - 1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=U) * GOLD + U(key % 2**64))

    def _round(self, right: np.ndarray, key: np.uint64) -> np.ndarray:
        return mix(right * GOLD + key) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys:
            left, right = right, left ^ self._round(right, k)
        return left << self.half | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1]:
            left, right = right ^ self._round(left, k), left
        return left << self.half | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x, U))
        outside = np.flatnonzero(out >= self.size)
        while len(outside):  # the domain is below four times the size, so a few steps do
            out[outside] = step(out[outside])
            outside = outside[out[outside] >= self.size]
        return out

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self._once)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self._back)


def _sequences(docs: DataFrame, path: str, length: int, id_col: str, text_col: str, end: int, placed: tuple[dict[int, int], int, int, int] | None = None) -> DataFrame:
    """The ids of each input partition end to end, cut into sequences of ``length``.

    Only the last sequence of a partition is short; its rest is filled with ``end``. Ids are 16-bit where they fit, else 32-bit.
    Without ``placed`` only ``part, n``, the count of sequences of each input partition. With it (the first number of each
    partition, all sequences, sequences per shard, key) ``slot, shard, sequence_id, n_tokens, first_doc, ids``.
    """
    counting = placed is None
    begins, total, per_shard, key = placed or ({}, 0, 1, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part_id, nth = load(path, end), TaskContext.get().partitionId(), 0
        kind = "<u2" if bpe.library.get_vocab_size() <= 1 << 16 else "<u4"
        rest, rest_doc = np.empty(0, np.uint32), None
        order = None if counting else Feistel(total, key)

        def rows(ids: np.ndarray, filled: list[int], first: list[int | None]) -> pa.RecordBatch:
            n, size = len(filled), length * np.dtype(kind).itemsize
            number = begins[part_id] + np.arange(nth, nth + n)
            slot = order.slot(number.astype(U)).astype(np.int64)
            binary = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(ids.astype(kind).tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), pa.array(number), pa.array(filled, pa.int64()), pa.array(first, pa.int64()), binary],
                                              ["slot", "shard", "sequence_id", "n_tokens", "first_doc", "ids"])

        for whole in batches:
            for part in slices(whole, size=2 << 20):
                ids, counts = bpe.encode(part.column("text").to_pylist())
                ids = np.concatenate([rest, ids])
                opens = np.concatenate([[0], len(rest) + np.cumsum(counts) - counts])
                n = len(ids) // length
                owner = np.searchsorted(opens, np.arange(n + 1) * length, "right") - 1
                names = [rest_doc, *part.column("doc_id").to_pylist()]
                if not len(rest):
                    owner = np.maximum(owner, 1)
                if n and not counting:
                    yield rows(ids[:n * length], [length] * n, [names[k] for k in owner[:n]])
                nth += n
                rest, rest_doc = ids[n * length:], names[min(owner[n], len(names) - 1)]
        if counting:
            yield pa.RecordBatch.from_arrays([pa.array([part_id], pa.int32()), pa.array([nth + (len(rest) > 0)], pa.int64())], ["part", "n"])
        elif len(rest):
            yield rows(np.concatenate([rest, np.full(length - len(rest), end, np.uint32)]), [len(rest)], [rest_doc])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "part int, n long" if counting else "slot long, shard long, sequence_id long, n_tokens long, first_doc long, ids binary")


def write_shards(docs: DataFrame, folder: str, length: int = 2048, per_shard: int = 1024, key: int = 2024, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", end: int = END_ID) -> DataFrame:
    """Write ``folder/shard-<n>.bin`` and return one row per sequence: ``sequence_id, first_doc, n_tokens, slot, shard, place, byte_offset, stride, ids_crc32``.

    A first pass over the texts only counts sequences; their total fixes the permutation. A second pass makes them and sends
    each to the range of its slot. Slot ``s`` lies in shard ``s // per_shard`` at byte ``s % per_shard * stride``; every shard
    but the last holds ``per_shard`` sequences, so a reader resumes at any step by arithmetic. Tokens are written twice
    to disk at most (shuffle and shard): making them again costs less than keeping a third copy.

    A shard is written under a name of its task attempt and then renamed, so a lost executor or a second attempt leaves one
    whole file with the same bytes. ``folder`` is any place pyarrow's file systems reach from the executors.

    Sequences are numbered by input partition. ``docs`` must be a written table; the count that its split size goes by is fixed
    for both passes, so executors that come or go between them move no border. The shards are written before the call
    returns, the result is a written table too. Null and empty texts are an end id alone; null or repeated ids are separate
    documents. An empty table gives no shards and no rows.
    """
    conf, splits = docs.sparkSession.conf, "spark.sql.files.minPartitionNum"
    before = conf.get(splits, None)
    if before is None:
        conf.set(splits, conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(docs.sparkSession.sparkContext.defaultParallelism))
    try:
        return staged(_written(docs, folder, length, per_shard, key, path or tokenizer_path(), id_col, text_col, end), "manifest")
    finally:
        if before is None:
            conf.unset(splits)


def _written(docs: DataFrame, folder: str, length: int, per_shard: int, key: int, path: str, id_col: str, text_col: str, end: int) -> DataFrame:
    """Both passes of ``write_shards``; shards are written when the result is."""
    counts = sorted(_sequences(docs, path, length, id_col, text_col, end).collect())  # one row per input partition
    ends = np.cumsum([r.n for r in counts]).tolist() or [0]
    total, begins = ends[-1], {r.part: e - r.n for r, e in zip(counts, ends)}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        now, out, name, done = None, None, None, []

        def close() -> None:
            out.close()
            fs.move(name, f"{root}/shard-{now:08d}.bin")

        for b in batches:
            slots, shards = b.column("slot").to_pylist(), b.column("shard").to_pylist()
            for i, (slot, shard, ids) in enumerate(zip(slots, shards, b.column("ids").to_pylist(), strict=True)):
                if shard != now:
                    if out:
                        close()
                    now, name = shard, f"{root}/.shard-{shard:08d}-{TaskContext.get().taskAttemptId()}"
                    out = fs.open_output_stream(name)
                out.write(ids)
                at = slot % per_shard
                done.append((b.column("sequence_id")[i].as_py(), b.column("first_doc")[i].as_py(), b.column("n_tokens")[i].as_py(), slot, shard, at, at * len(ids), len(ids), zlib.crc32(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)] if done else [pa.array([], pa.int64())] * 9, COLUMNS)
            done = []
        if out:
            close()

    placed = _sequences(docs, path, length, id_col, text_col, end, (begins, total, per_shard, key))
    # whole shards per task: a contiguous range of shards each, about 64 MB of ids
    tasks = max(1, -(-total * length * 2 // (64 << 20)), min(docs.sparkSession.sparkContext.defaultParallelism, -(-total // per_shard)))
    shards = max(1, -(-total // per_shard))
    wide = placed.withColumn("task", (F.col("shard") * tasks / shards).cast("int"))
    return _ranged(wide, tasks).mapInArrow(write, ", ".join(f"{c} long" for c in COLUMNS))


COLUMNS = ["sequence_id", "first_doc", "n_tokens", "slot", "shard", "place", "byte_offset", "stride", "ids_crc32"]


def _ranged(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows by ranges of slots that never split a shard, each in slot order.

    Slots are dense, so equal ranges are even and known beforehand: no sampling pass, which would tokenise everything again.
    """
    return rows.repartitionById(tasks, "task").sortWithinPartitions("slot").drop("task")


def read_shards(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """``slot, ids_crc32``: each sequence of the manifest read back from its place in its shard, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        now, file = None, None
        for b in batches:
            crc = []
            for shard, offset, stride in zip(*(b.column(c).to_pylist() for c in ("shard", "byte_offset", "stride")), strict=True):
                if shard != now:
                    now, file = shard, fs.open_input_file(f"{root}/shard-{shard:08d}.bin")
                file.seek(offset)
                crc.append(zlib.crc32(file.read(stride)))
            yield pa.RecordBatch.from_arrays([b.column("slot"), pa.array(crc, pa.int64())], ["slot", "ids_crc32"])

    return manifest.select("slot", "shard", "byte_offset", "stride").sortWithinPartitions("slot").mapInArrow(run, "slot long, ids_crc32 long")


@query("op10_training_order")
def op10_training_order(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "shards")
    manifest = write_shards(table(spark, d, "documents"), folder)
    read = read_shards(spark, manifest, folder).withColumnRenamed("ids_crc32", "read_crc32")
    return manifest.join(read, "slot").select("sequence_id", "first_doc", "n_tokens", "slot", "shard", "place", "byte_offset", "read_crc32", (F.col("ids_crc32") == F.col("read_crc32")).alias("intact"))
