"""Monitoring jobs on unbounded records: daily aggregates and threshold alerts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.functions.levels import ALERT_THRESHOLDS, alert_level, tripped_threshold


def stream_daily(
    stream: DataFrame, delay: str = "1 day", key: str = "event_type", time: str = "ts", value: str = "value"
) -> DataFrame:
    """Daily mean, deviation, extremes and count per key on event time.

    Late records are accepted up to ``delay``; state for a day is dropped once the watermark passes it,
    except where the sink asks for all groups again (complete mode).
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    out = timed.groupBy(F.window(time, "1 day"), F.col(key)).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(value).alias("count"),
    )
    return out.select(key, F.to_date(F.col("window.start")).alias("day"), "mean", "std", "min", "max", "count")


def stream_alerts(
    stream: DataFrame, thresholds: Mapping = ALERT_THRESHOLDS, variable: str = "variable", value: str = "value"
) -> DataFrame:
    """Alert level of every arriving record; no state, hence no watermark."""
    out = stream.withColumn("level", alert_level(F.col(variable), F.col(value), thresholds))
    out = out.where(F.col("level").isNotNull())
    return out.withColumn("threshold", tripped_threshold(F.col(variable), F.col("level"), thresholds))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived into parquet files and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_available_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """``work`` on every batch as a plain table, for what needs joins that a stream hasn't; a batch that is run again
    replaces its own ``epoch`` folder."""

    def add(batch: DataFrame, epoch: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_available_update(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Update mode: each batch writes the groups that it changed below its own ``epoch`` folder.

    The watermark drops the state of groups that can't change any more, and no batch rewrites what
    earlier ones wrote; a batch that is run again replaces its own folder.  ``latest_groups`` reads the table.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_groups(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each group that ``run_available_update`` wrote."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "epoch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in values])
