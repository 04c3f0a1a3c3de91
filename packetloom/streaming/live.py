"""Live versions of the window, dedup, session, memory, enrichment and belief operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.functions.columns import choose, count_when, has_flag
from packetloom.session import checkpoint_root

c = F.col


def window_stats(packets: DataFrame, window: str = "60 seconds", delay: str = "2 minutes", slide: str | None = None) -> DataFrame:
    """Mergeable window statistics; distinct counts are HyperLogLog estimates and quantiles are left to the batch form."""
    w = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    return (packets.withWatermark("event_time", delay).groupBy(w.alias("w")).agg(
        F.count("*").alias("packet_count"), F.avg("packet_length").alias("packet_size_mean"), F.min("packet_length").alias("packet_size_min"),
        F.max("packet_length").alias("packet_size_max"), count_when(has_flag("tcp_flags", 0x02)).alias("syn_count"),
        count_when(has_flag("tcp_flags", 0x10)).alias("ack_count"), F.approx_count_distinct("src_ip").alias("approx_src_ips"))
        .select(F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"), "packet_count", "packet_size_mean",
                "packet_size_min", "packet_size_max", "syn_count", "ack_count", "approx_src_ips"))


def dedup(packets: DataFrame, fingerprint: list[str], delay: str = "2 minutes") -> DataFrame:
    return packets.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(fingerprint)


def sessions(packets: DataFrame, key: str, gap: str, delay: str = "2 minutes") -> DataFrame:
    return (packets.withWatermark("event_time", delay).groupBy(c(key), F.session_window("event_time", gap).alias("w"))
            .agg(F.count("*").alias("packets"), F.sum("packet_length").alias("bytes"))
            .select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "packets", "bytes"))


MEMORY_OUT = "entity string, observations bigint, peers bigint, ports bigint, divergence_score double, active_regime string"
NOVEL, QUIET = 0.15, 0.02
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def memory_step(score: float, novel_at: list[int], rows: int) -> float:
    """The score after ``rows`` observations of which those at ``novel_at`` are novel: +0.15 each, -0.02 for every other, kept in [0, 1].

    Steps down compose, so a quiet stretch is taken at once; the loop has one turn for each novelty.
    """
    at = -1
    for i in novel_at:
        score = min(1.0, max(0.0, score - QUIET * (i - at - 1)) + NOVEL)
        at = i
    return max(0.0, score - QUIET * (rows - at - 1))


def entity_memory(packets: DataFrame, idle: str | None = None, delay: str = "2 minutes") -> DataFrame:
    """Novelty memory per entity, as revisions: a row for each entity a batch touches.

    ``packets``: ``event_time, packet_index, entity, peer, port``. An observation is novel if its peer or its port is new to
    an entity that knows another one. Known peers and ports are map state, an entry each, so a batch reads and writes the
    entries of its own peers and ports alone, however many an entity has; counts and score are one small value. The store is
    RocksDB (``run_available(..., rocksdb=True)``): state lives on disk, not on the heap.

    With ``idle`` an entity that stays silent so long, by the watermark of ``delay``, is forgotten by a timer. A batch puts the rows of
    one entity into one task: the trigger's limit on new files bounds them. Null peers and ports are no peers and ports.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    seconds = packets.sparkSession.sql(f"SELECT CAST(CAST(INTERVAL {idle} AS INTERVAL DAY TO SECOND) AS DECIMAL(20, 6)) * 1000").first()[0] if idle else None
    span = int(seconds) if seconds is not None else None

    class Memory(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.head = handle.getValueState("head", "observations bigint, score double, peers bigint, ports bigint, seen bigint")
            self.maps = {"peer": handle.getMapState("peers", "peer string", "first bigint"), "port": handle.getMapState("ports", "port int", "first bigint")}

        def handleInputRows(self, key, rows, timerValues):
            n, score, peers, ports, seen = self.head.get() if self.head.exists() else (0, 0.0, 0, 0, 0)
            x = pd.concat(list(rows)).sort_values(["event_time", "packet_index"], ignore_index=True)
            novel, known = set(), {"peer": peers, "port": ports}
            for name, entries in self.maps.items():
                first = x[name].dropna().drop_duplicates()
                new = [(i, v) for i, v in zip(first.index.tolist(), first.tolist()) if not known[name] or not entries.containsKey((v if name == "peer" else int(v),))]
                for i, v in new:
                    entries.updateValue((v if name == "peer" else int(v),), (n + i,))
                novel |= {i for i, _ in (new if known[name] else new[1:])}
                known[name] += len(new)
            score = memory_step(score, sorted(novel), len(x))
            n, seen = n + len(x), max(seen, int(x["event_time"].max().timestamp() * 1000))
            self.head.update((n, score, known["peer"], known["port"], seen))
            if span is not None:
                self.handle.registerTimer(seen + span)
            regime = "SEVERE_REGIME_DEPARTURE" if score >= 0.70 else "ELEVATED_NOVELTY" if score >= 0.35 else "BENIGN_EQUILIBRIUM"
            yield pd.DataFrame([[key[0], n, known["peer"], known["port"], score, regime]], columns=[f.split()[0] for f in MEMORY_OUT.split(", ")])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            # a timer of an earlier batch says nothing once the entity was seen again
            if self.head.exists() and self.head.get()[4] + span <= expiredTimerInfo.getExpiryTimeInMs():
                self.head.clear()
                for entries in self.maps.values():
                    entries.clear()
            return iter([])

        def close(self) -> None:
            pass

    timed = packets.withWatermark("event_time", delay) if idle else packets
    return timed.groupBy("entity").transformWithStateInPandas(Memory(), MEMORY_OUT, "Update", "EventTime" if idle else "None")


def alert_enrich(alerts: DataFrame, flows: DataFrame, span: str = "60 seconds", delay: str = "2 minutes") -> DataFrame:
    """Alerts joined to flows of the same endpoints within ``span`` either way (stream-stream interval join)."""
    a = alerts.withWatermark("event_time", delay).alias("a")
    f = flows.withWatermark("flow_time", delay).alias("f")
    cond = F.expr(f"a.src_ip = f.flow_src AND a.dst_ip = f.flow_dst AND f.flow_time BETWEEN a.event_time - INTERVAL {span} AND a.event_time + INTERVAL {span}")
    return a.join(f, cond)


def belief_evidence(groups) -> DataFrame:
    """Counts of supporting and contradicting evidence of each group (silent or housekeeping traffic contradicts), and the belief factor."""
    quiet = (F.coalesce("bytes", F.lit(0)) == 0) | F.upper("protocol").isin("NTP", "ARP")
    g = groups.agg(count_when(quiet).alias("contradicting"), count_when(~quiet).alias("supporting"))
    return g.withColumn("factor", choose((c("contradicting") > c("supporting"), 0.75), (c("supporting") > 0, 1.15), default=1.0))


def belief_factors(evidence: DataFrame, delay: str, window: str) -> DataFrame:
    """Per window the belief factor from supporting and contradicting evidence."""
    g = belief_evidence(evidence.withWatermark("event_time", delay).groupBy(F.window("event_time", window).alias("w")))
    return g.select(F.unix_seconds("w.start").alias("window_start"), "contradicting", "supporting", "factor")


def finished_batches(spark: SparkSession, folder: str) -> list[int]:
    """Ids of the ``batch=<id>`` folders whose write was completed, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
    # a folder without the writer's mark is a batch that did not finish
    return sorted(int(p.getName().split("=")[1]) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


class BeliefTable:
    """Stored probabilities that every batch of evidence revises once, however often the batch is run.

    ``points``: ``key, horizon, p``, the forecast the stream starts from. Batch ``n`` reads the table that the batch before it
    left, scales the probabilities of the keys it has evidence on (0.75 if most contradicts, 1.15 if any supports, kept in
    [0.01, 0.99]) and overwrites the folder named by its own id. A batch that is run again after a failure starts from the same
    table and leaves the same one. The table has one row per key and horizon; its two latest states are kept.
    """

    def __init__(self, points: DataFrame, folder: str, key: str = "case_id"):
        self.points, self.folder, self.key = points, folder, key

    def read(self, before: int | None = None) -> DataFrame:
        """``key, horizon, p, revisions`` after the last batch, or after the last one before ``before``."""
        spark = self.points.sparkSession
        done = [b for b in finished_batches(spark, self.folder) if before is None or b < before]
        if not done:
            return self.points.select(self.key, "horizon", F.col("p").cast("double").alias("p"), F.lit(0).cast("bigint").alias("revisions"))
        return spark.read.parquet(f"{self.folder}/batch={done[-1]}")

    def revise(self, evidence: DataFrame, batch: int) -> None:
        """One batch of evidence (``key, protocol, bytes``); to be given to ``foreachBatch``."""
        e = belief_evidence(evidence.groupBy(self.key))
        now = self.read(batch).join(e, self.key, "left")
        p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), c("p") * c("factor")))
        out = now.select(self.key, "horizon", F.when(c("factor").isNull(), c("p")).otherwise(p).alias("p"), (c("revisions") + c("factor").isNotNull().cast("bigint")).alias("revisions"))
        out.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        spark = self.points.sparkSession
        for old in [b for b in finished_batches(spark, self.folder) if b < batch - 1][:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class LateRows:
    """Side output of rows behind the watermark, batch by batch.

    The watermark of a batch is the latest event time of all batches before it, less ``delay_seconds``, as the stateful
    operators have it. ``split`` writes the batch's late rows with ``lateness`` (seconds behind the watermark) and ``dropped``
    (their window had closed, so a windowed aggregate no longer takes them), and one row of counts. Both go to folders named
    by the batch id, so a batch that is run again replaces what it wrote.
    """

    def __init__(self, folder: str, delay_seconds: int, window_seconds: int):
        self.folder, self.delay, self.window = folder, delay_seconds, window_seconds

    def split(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        done = [b for b in finished_batches(spark, f"{self.folder}/counts") if b < batch]
        # the row of the batch before holds the latest time so far
        seen = spark.read.parquet(f"{self.folder}/counts/batch={done[-1]}").first()["latest"] if done else None
        t = F.unix_micros("event_time") / 1e6
        mark = F.lit(None).cast("double") if seen is None else F.lit(float(seen) - self.delay)
        x = rows.withColumn("lateness", F.when(t < mark, mark - t)).withColumn("dropped", (F.floor(t / self.window) + 1) * self.window <= mark)
        x.filter("lateness is not null").write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch}")
        x.agg(F.count("*").alias("packets"), F.count("lateness").alias("late"), count_when(F.coalesce("dropped", F.lit(False))).alias("dropped"), F.max("lateness").alias("max_lateness"), F.greatest(F.max(t), F.lit(seen)).alias("latest")).write.mode("overwrite").parquet(f"{self.folder}/counts/batch={batch}")

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", f"{self.folder}/counts").parquet(f"{self.folder}/counts")

    def late(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", f"{self.folder}/late").parquet(f"{self.folder}/late")


def stream_root(spark: SparkSession) -> str:
    """A new folder for a stream's output and checkpoint, in the shared folder."""
    return f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, root: str | None = None, rocksdb: bool = False) -> tuple[DataFrame | None, list]:
    """Drain what is there now into a table in the shared folder; returns (table, progress reports).

    ``each`` replaces the file sink by a ``foreachBatch`` function of its own output (the table is then None). The query's checkpoint lies
    in the folder ``root``: a query started again with the same one goes on where it stopped. ``rocksdb`` keeps state on disk.
    """
    spark = stream.sparkSession
    root = root or stream_root(spark)
    out = f"{root}/out"

    def save(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    if rocksdb:
        spark.conf.set(store, ROCKSDB)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
        sink = writer.format("parquet").option("path", out).start() if mode == "append" and each is None else writer.foreachBatch(each or save).start()
    finally:
        spark.conf.set(store, before)
    sink.awaitTermination()
    if each is not None:
        return None, sink.recentProgress
    table = spark.read.schema(stream.schema).parquet(out) if mode == "append" else spark.read.parquet(f"{out}/batch=*")
    return table, sink.recentProgress


def dropped_late(progress: list) -> int:
    """Rows dropped behind the watermark over all stateful operators and batches."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in progress for op in p["stateOperators"])


def files(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
