"""Incremental sync: which remote files are new or changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(remote: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """(key, hash) listings -> key and state (new or changed)."""
    old = manifest.select(key, F.col("hash").alias("old_hash"))
    joined = remote.join(old, key, "left")
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("hash") != F.col("old_hash"), "changed")
    return joined.select(key, state.alias("state")).filter("state is not null")
