"""Scoring as results arrive, and windows over event streams (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from benchloom.operators.scoring import score_samples, measurements


def running_metrics(results: DataFrame) -> DataFrame:
    """Model metrics over a stream of sample results; state is one row a model."""
    rows = score_samples(measurements(results)).where("not skipped")
    return rows.groupBy("model_id").agg(F.count("*").alias("n"), F.avg("weighted_score").alias("relax_score"), F.avg(F.col("strict").cast("int").cast("double")).alias("strict_pass_rate"), F.avg(F.col("weighted_score") * F.col("gate")).alias("gated_score"))


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means by event type and tumbling window; rows later than ``late`` are left out."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Keeps what changes (``update``) or the whole result (``complete``) of each batch as a part of a table, and ends when its input is read.

    Parts are written by the executors; a batch that is run again replaces its part.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The state of a kept table: the last version of each key, or without keys the last batch."""
    rows = spark.read.parquet(path)
    if not keys:
        last = rows.agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(last), "batch", "left_semi").drop("batch")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return kept.select(*keys, "v.*")
