"""Views kept up to date from streams: aggregates by key, event-time windows, presence, row deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, glob: str = "events*", files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; at most `files` new ones per batch. ts becomes a timestamp."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def running_aggregates(events: DataFrame, key: str, value: str) -> DataFrame:
    """SUM, COUNT, AVERAGE, MIN and MAX per key, updated with each batch (output mode update or complete)."""
    v = F.col(value)
    return events.groupBy(key).agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("sum_value"), F.count(v).alias("n"), F.avg(v).alias("avg_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"))


def windowed(events: DataFrame, ts: str, key: str, value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding event-time windows, with a watermark for late rows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum_value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "sum_value")


def presence(beats: DataFrame, ts: str, user: str, stale: str = "45 seconds", late: str = "1 minute") -> DataFrame:
    """Stretches in which a user's heartbeats never pause longer than `stale`."""
    return beats.withWatermark(ts, late).groupBy(F.session_window(ts, stale).alias("w"), user).agg(F.count(F.lit(1)).alias("beats")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "beats")


def deduplicated(events: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Each key once, remembered as long as the watermark allows."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def to_rows(deltas: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each batch of typed deltas (key, kind, payload, version) to `merge`, latest per key."""
    def batch(df: DataFrame, epoch: int) -> None:
        last = df.groupBy("key").agg(F.max_by(F.struct("kind", "payload", "version"), "version").alias("d")).select("key", "d.*")
        merge(last, epoch)

    return deltas.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now and return its result, written to the folder as Parquet.

    Each batch overwrites its own part (one part for all in complete mode), so a batch that runs again adds nothing.
    """
    spark, out = df.sparkSession, f"{folder}/out"
    spark.createDataFrame([], df.schema).write.parquet(f"{out}/epoch=-1")

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/epoch={0 if mode == 'complete' else epoch}")

    q = df.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out).select(*[F.col(f"`{c}`") for c in df.columns])
