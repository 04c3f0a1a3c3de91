"""Durable outputs: analyses with findings, experiment artifacts, split manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def finding_values(findings: DataFrame) -> DataFrame:
    """Lift rule, value and threshold of the first piece of evidence into columns."""
    first = F.try_element_at("evidence", F.lit(1))
    return findings.withColumns({"rule_id": first["rule_id"], "value": first["value"], "threshold": first["threshold"]})


class AnalysisStore:
    """``analyses`` and ``findings`` as versions: rows of a change are written first, then the ids it concerns, then one marker.

    A version counts once its one-file marker exists, so a failed change leaves the analyses as they were, and readers
    see either all of it or nothing. An id shows the rows of its latest version; a delete is a version without rows, so child
    rows never outlive their analysis. Files are few and large, however many ids there are. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/markers")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "version int")
        return self.spark.read.schema("version int").parquet(f"{self.root}/markers")

    def _change(self, ids: DataFrame, deleted: bool, tables: dict[str, DataFrame]) -> None:
        number = (self._versions().agg(F.max("version")).first()[0] or 0) + 1  # one row per change
        rows = {**tables, "ids": ids.select("analysis_id").distinct().withColumn("deleted", F.lit(deleted))}
        for name, df in rows.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}/version={number}")
        self.spark.range(1).select(F.lit(number).alias("version")).coalesce(1).write.mode("append").parquet(f"{self.root}/markers")

    def upsert(self, analyses: DataFrame, findings: DataFrame) -> None:
        self._change(analyses, False, {"analyses": analyses, "findings": finding_values(findings)})

    def delete(self, ids: DataFrame) -> None:
        self._change(ids, True, {})

    def read(self, table: str) -> DataFrame:
        ids = self.spark.read.parquet(f"{self.root}/ids").join(self._versions(), "version")
        last = ids.groupBy("analysis_id").agg(F.max(F.struct("version", "deleted")).alias("_l")).select("analysis_id", "_l.*")
        return self.spark.read.parquet(f"{self.root}/{table}").join(last.filter("NOT deleted").drop("deleted"), ["analysis_id", "version"]).drop("version")

    def get(self, analysis_id: str) -> tuple[DataFrame, DataFrame]:
        hit = F.col("analysis_id") == analysis_id
        return self.read("analyses").filter(hit), self.read("findings").filter(hit)


def experiment_summary(metrics: DataFrame) -> DataFrame:
    """Mean Brier score, F1 and calibration error per model over its horizons."""
    return metrics.groupBy("model").agg(F.count("*").alias("horizons"), F.avg("brier").alias("mean_brier"),
                                        F.avg("f1").alias("mean_f1"), F.avg("ece").alias("mean_ece"))


def write_experiment(predictions: DataFrame, metrics: DataFrame, root: str) -> None:
    predictions.write.mode("overwrite").json(f"{root}/predictions")
    metrics.write.mode("overwrite").json(f"{root}/metrics")
    experiment_summary(metrics).write.mode("overwrite").json(f"{root}/summary")


def split_manifest(rows: DataFrame) -> DataFrame:
    """Per split: episodes, windows by label and onset events (``split, episode_id, attack_state, is_onset``)."""
    return rows.groupBy("split").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("episode_id").cast("bigint"))), ",").alias("episode_ids"),
        F.count("*").alias("windows"), F.count_if(F.col("attack_state") == 1).alias("attack_windows"),
        F.count_if(F.col("attack_state") == 0).alias("benign_windows"), F.count_if(F.col("is_onset")).alias("events"))
