"""Token batching of generated answers, and the events around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: tokens per batch.
BATCH = 10


def batches(tokens: DataFrame, size: int = BATCH) -> DataFrame:
    """(stream_id, token_idx, token) -> stream_id, batch, content, n: every ``size`` tokens, the rest at the end."""
    g = tokens.groupBy("stream_id", F.floor(F.col("token_idx") / size).alias("batch"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("token_idx", "token"))), lambda s: s["token"])  # ``size`` at most
    return g.agg(F.array_join(listed, "").alias("content"), F.count("*").alias("n"))


def events(tokens: DataFrame, size: int = BATCH) -> DataFrame:
    """Token events, then one completion event per stream with its number of tokens."""
    parts = batches(tokens, size).select("stream_id", "batch", F.lit("token").alias("event"), F.to_json(F.struct("content")).alias("data"))
    done = tokens.groupBy("stream_id").agg(F.count("*").alias("tokens_generated")).select("stream_id", F.lit(None).cast("long").alias("batch"), F.lit("complete").alias("event"), F.to_json(F.struct("tokens_generated")).alias("data"))
    return parts.unionByName(done)


def errors(failures: DataFrame) -> DataFrame:
    return failures.select("stream_id", F.lit(None).cast("long").alias("batch"), F.lit("error").alias("event"), F.to_json(F.struct("error")).alias("data"))
