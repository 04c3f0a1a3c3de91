"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.llm.bpe import load
from packetloom.llm.common import join_lookup, query, running_sum, scratch, slices, staged, table

#: Id appended to each document.
END_ID = 1


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def token_chunks(docs: DataFrame, path: str, chunk: int, id_col: str, source_col: str, text_col: str, end: int = END_ID) -> DataFrame:
    """One row per ``chunk`` ids of a row of ``docs``: ``row, chunk, doc_id, source, doc_tokens, start, length, ids`` (32-bit little-endian).

    ``row`` numbers the input rows; write the result once before using it twice.
    """
    schema = "row long, chunk long, doc_id long, source string, doc_tokens long, start long, length long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, at = load(path, end), TaskContext.get().partitionId() << 36
        for whole in batches:
            for part in slices(whole, size=4 << 20):
                ids, counts = bpe.encode(part.column("text").to_pylist())
                pieces = -(-counts // chunk)
                which = np.repeat(np.arange(len(counts)), pieces)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(chunk, counts[which] - nth * chunk)
                bounds = np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4").tobytes())])
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + which), pa.array(nth), part.column("doc_id").take(take), part.column("source").take(take), pa.array(counts[which]),
                     pa.array(nth * chunk), pa.array(length), binary], ["row", "chunk", "doc_id", "source", "doc_tokens", "start", "length", "ids"])
                at += len(counts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, window: int = 2048, chunk: int = 512, weights: DataFrame | None = None,
         id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Pieces ``doc_id, source, doc_tokens, start, length, sequence_id, offset, round, ids`` of gapless windows.

    Every source is a queue of its documents by id, cut into chunks of at most ``chunk`` ids. In each round a source earns
    its share of a window (``weights``: ``source, weight``; by default its share of all ids, so that all queues drain
    together) and sends the chunks its saved-up deficit covers. A deficit is never reset while the queue lasts, so the
    chunk that ends at id ``S`` of its queue goes out in round ``ceil(S / quantum)``: the schedule is two running sums and
    a sort, on rows without ids, and deficits cross windows and partitions by construction. Windows are cut from the rounds
    laid end to end; a chunk over a border becomes two pieces. Only the last window can be short.

    A null or empty text is its end id alone. A null source is a queue of its own; a null id sorts first; a source missing
    from ``weights``, or with a weight that is null or not above 0, goes out with the weight 1. Repeated rows are separate documents.
    """
    raw = token_chunks(docs, path or tokenizer_path(), chunk, id_col, source_col, text_col)
    where = scratch(docs.sparkSession, "chunks")
    raw.write.option("compression", "zstd").parquet(where)
    chunks = docs.sparkSession.read.schema(raw.schema).parquet(where)
    narrow = chunks.select("source", "doc_id", "row", "chunk", "length")
    queued, _ = running_sum(narrow, ["source", "doc_id", "row", "chunk"], ["length"], "queues")
    queued = staged(queued, "queued")
    shares = queued.groupBy("source").agg(F.min("before_length").alias("begin"), F.sum("length").alias("total"))
    if weights is None:
        shares = shares.withColumn("weight", F.col("total").cast("double"))
    else:
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("_w")).groupBy("_s").agg(F.max("_w").alias("_w"))
        shares = shares.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("weight", F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0)).drop("_s", "_w")
    shares = staged(shares, "shares")
    everything = shares.agg(F.sum("weight")).first()[0] or 1.0
    quanta = shares.select("source", "begin", (F.col("weight") / everything * window).alias("quantum"))
    sent = join_lookup(queued, quanta, ["source"]).withColumn("upto", F.col("before_length") - F.col("begin") + F.col("length"))
    sent = sent.select(F.ceil(F.col("upto") / F.col("quantum")).alias("round"), "source", "upto", "row", "chunk", "length")
    laid, _ = running_sum(sent, ["round", "source", "upto"], ["length"], "rounds")
    at, room = F.col("before_length") % window, window - F.col("before_length") % window
    laid = laid.select("row", "chunk", "round", F.floor(F.col("before_length") / window).alias("sequence"), at.alias("at"), F.least("length", room).alias("first"))
    whole = chunks.join(laid, ["row", "chunk"])
    piece = lambda seq, skip, n, off: F.struct((F.col("sequence") + seq).alias("sequence_id"), skip.cast("long").alias("skip"), n.cast("long").alias("n"), off.cast("long").alias("off"))
    head = piece(0, F.lit(0), F.col("first"), F.col("at"))
    tail = piece(1, F.col("first"), F.col("length") - F.col("first"), F.lit(0))
    cut = whole.withColumn("p", F.explode(F.when(F.col("length") > F.col("first"), F.array(head, tail)).otherwise(F.array(head))))
    return cut.select("doc_id", "source", "doc_tokens", (F.col("start") + F.col("p.skip")).alias("start"), F.col("p.n").alias("length"), F.col("p.sequence_id").alias("sequence_id"),
                      F.col("p.off").alias("offset"), "round", F.expr("substring(ids, cast(p.skip * 4 + 1 as int), cast(p.n * 4 as int))").alias("ids"))


@query("op6_mixture_packing")
def op6_mixture_packing(spark: SparkSession, d: str) -> DataFrame:
    pieces = pack(table(spark, d, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
