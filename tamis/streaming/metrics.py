"""Metrics over event time; the same functions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Snapshot period and alert level.
SNAPSHOT, ALERT_PERCENT, SLOT_US = "300 seconds", 80.0, 300_000_000


def tumbling(events: DataFrame, ts: str, keys: list[str], value: str, width: str = SNAPSHOT, watermark: str | None = None) -> DataFrame:
    """Count, sum and mean per window and key. With a watermark, late data are dropped and windows close."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if watermark:
        rows = rows.withWatermark("__ts", watermark)
    g = rows.groupBy(F.window("__ts", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", "total", "mean")


def snapshots(events: DataFrame, ts: str, keys: list[str], value: str, width: str = SNAPSHOT) -> DataFrame:
    """Cumulative counters at the end of every window."""
    t = tumbling(events, ts, keys, value, width)
    w = Window.partitionBy(*keys).orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("window_start", *keys, F.sum("n").over(w).alias("n"), F.sum("total").over(w).alias("total"))


def sessions(events: DataFrame, ts: str, key: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Session windows by gap."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if watermark:
        rows = rows.withWatermark("__ts", watermark)
    g = rows.groupBy(F.session_window("__ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def requests(events: DataFrame, id_col: str, phase: Column, ts: str) -> DataFrame:
    """Start and finish of a request side by side, with its duration in seconds; open requests have none."""
    rows = events.select(F.col(id_col).alias("request_id"), phase.alias("phase"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    g = rows.groupBy("request_id").agg(F.min(F.when(F.col("phase") == "start", F.col("us"))).alias("a"), F.max(F.when(F.col("phase") == "finish", F.col("us"))).alias("b"))
    return g.select("request_id", F.col("a").isNotNull().alias("started"), F.col("b").isNotNull().alias("finished"), ((F.col("b") - F.col("a")) / 1e6).alias("seconds"))


def join_requests(starts: DataFrame, finishes: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Stream-stream join of request starts and finishes (request_id, ts), with bounded state on both sides."""
    a = starts.select(F.col("request_id").alias("a_id"), F.col("ts").alias("a_ts")).withWatermark("a_ts", within)
    b = finishes.select(F.col("request_id").alias("b_id"), F.col("ts").alias("b_ts")).withWatermark("b_ts", within)
    on = F.expr(f"a_id = b_id AND b_ts >= a_ts AND b_ts <= a_ts + INTERVAL {within}")
    return a.join(b, on).select(F.col("a_id").alias("request_id"), ((F.unix_micros("b_ts") - F.unix_micros("a_ts")) / 1e6).alias("seconds"))


def alerts(samples: DataFrame, level: float = ALERT_PERCENT) -> DataFrame:
    return samples.filter(F.col("percent") > level)


def job_states(updates: DataFrame) -> DataFrame:
    """Latest state and greatest progress of every job from its updates (job_id, ts, status, progress)."""
    return updates.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "progress")).alias("status"), F.max(F.least(F.greatest("progress", F.lit(0)), F.lit(100))).alias("progress"))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source holds now into an in-memory table (tests and small results only)."""
    spark: SparkSession = stream.sparkSession
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def snapshot_sink(stream: DataFrame, path: str, checkpoint: str, period: str = SNAPSHOT):
    """Writes every period's result as a dated batch; a repeated batch overwrites itself."""
    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").json(f"{path}/batch={batch}")

    return stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=period).start()
