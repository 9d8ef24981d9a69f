"""Cache behaviour as operators: which look-ups of an access log would hit, and what is evicted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Life of an entry, entries, and the share evicted at once.
TTL_SECONDS, MAX_ENTRIES, EVICT_SHARE = 3600, 1000, 0.2


def ttl_hits(log: DataFrame, key: str, ts: str, order: str, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """Adds hit: whether the entry written at the last miss of the key still lives (entries are set on a miss and not renewed).

    A key's accesses are walked in order with one time as the state.
    """
    rows = log.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    pause = F.when(F.col("__us") - F.lag("__us").over(Window.partitionBy(key).orderBy("__us", order)) >= int(ttl_seconds * 1e6), 1).otherwise(0)
    rows = rows.withColumn("__p", pause).withColumn("__s", F.sum("__p").over(Window.partitionBy(key).orderBy("__us", order))).drop("__p")
    rows = rows.repartition(key, "__s").sortWithinPartitions(key, "__s", "__us", order)
    names = log.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, born = None, None
        for b in batches:
            out = []
            for k, s, us in zip(b[key], b["__s"], b["__us"]):
                if (k, s) != open_:
                    open_, born = (k, s), None
                hit = born is not None and us - born < ttl_seconds * 1e6
                born = born if hit else us
                out.append(hit)
            yield b[names].assign(hit=out)

    return rows.mapInPandas(run, log.withColumn("hit", F.lit(True)).schema)


def evicted(entries: DataFrame, cache: str, most: int = MAX_ENTRIES, share: float = EVICT_SHARE) -> DataFrame:
    """(cache, key, access_count, last_accessed): of full caches the share least used, then longest unused."""
    n = entries.groupBy(cache).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(cache).orderBy("access_count", "last_accessed", "key"))
    full = entries.join(n, cache).withColumn("rn", rank)
    return full.filter((F.col("n") >= most) & (F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * share)))).select(cache, "key")
