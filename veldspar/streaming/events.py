"""Append-only logs, count triggers, state with a time to live, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def append_log(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream to a log of JSON lines, each row with the time of its arrival unless it has one."""
    if "recorded_at" not in stream.columns:
        stream = stream.withColumn("recorded_at", F.current_timestamp())
    writer = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


class CountTrigger:
    """Calls ``action`` with all rows gathered since the last call, once ``every`` or more of them are pending, after a micro-batch.

    Micro-batches come one after another, so an action never runs beside itself.  Every batch is kept under ``path``, once however often it is retried, and what is pending is
    counted from there, so a restarted stream goes on where the old one stopped; ``fired`` there names the last batch that an action has seen.
    """

    def __init__(self, every: int, action: Callable[[DataFrame, int], None], path: str):
        self.every, self.action, self.path, self.runs, self.rows = every, action, path, 0, 0

    def pending(self, spark: SparkSession) -> DataFrame | None:
        """The rows that no action has seen."""
        try:
            seen = spark.read.parquet(f"{self.path}/fired").agg(F.max("batch_id")).first()[0]
        except AnalysisException:
            seen = -1
        try:
            return spark.read.parquet(f"{self.path}/batches").where(F.col("batch_id") > seen).drop("batch_id")
        except AnalysisException:
            return None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.path}/batches/batch_id={batch_id}")
        rows = self.pending(spark)
        n = rows.count() if rows is not None else 0
        self.rows += batch.count()
        if n >= self.every:
            self.runs += 1
            self.action(rows, batch_id)
            spark.createDataFrame([(batch_id,)], "batch_id bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/fired")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``(start, end, event_type, n, total)`` per window of event time; for streams and tables alike."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``(user_id, start, end, n)`` per session of a user."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(stream: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the lateness allowed; state older than that is dropped."""
    if not stream.isStreaming:
        return stream.dropDuplicates([key])
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latest_with_ttl(stream: DataFrame, key: str, value: str, ttl_ms: int) -> DataFrame:
    """``(key, value, n, expired)``: the last value and the count of a key, and one row more when it has been silent for its time to live."""

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            v, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], value: [v], "n": [n], "expired": [True]})
            return
        v, n = state.get if state.exists else (None, 0)
        for pdf in rows:
            if len(pdf):
                v, n = pdf.sort_values("ts")[value].iloc[-1], n + len(pdf)
        state.update((float(v), int(n)))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({key: [k[0]], value: [float(v)], "n": [int(n)], "expired": [False]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {value} double, n bigint, expired boolean", "v double, n bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)


def trigger_points(log: DataFrame, every: int, key: str = "event_id", order: str = "ts") -> DataFrame:
    """Rows of a stored log at which a count trigger of one sample per call fires: each ``every``-th in order.

    Rows are numbered within ranges of time and offset by the ranges' counts, so the log is never ordered in one task.
    """
    day = F.floor(F.unix_timestamp(order) / 3600)
    rows = log.select(key, order, day.alias("part"))
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(order, key)) + F.col("offset")
    return rows.join(F.broadcast(counts), "part").withColumn("at", at).where(F.col("at") % every == 0).select(key, (F.col("at") / every).cast("bigint").alias("run"))


def stage_timings(events: DataFrame) -> DataFrame:
    """``(type, n, mean, p95)`` of timing events."""
    return events.groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.95).alias("p95"))
