"""Sharding by a permutation-filled lookup table.

Every shard ranks all slots of a prime-sized table (offset and step from its name, so the ranking is a
permutation). Shards take turns; on its turn a shard claims its first slot that is still free. The table is
balanced to one slot, and when a shard joins or leaves, nearly all other slots keep their owner.

The table's size is fixed by a parameter (checked against :data:`MAX_SLOTS`), never by the data, so it is
broadcast, and a document is placed by one hash and one look-up. There is no shuffle, so a hot key costs nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Upper bound of the broadcast table.
MAX_SLOTS = 1 << 20
#: Production parameters: 128 shards, a prime of slots well over 100 times as large.
SHARDS, SLOTS = 128, 16381


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int) -> list[int]:
    """The lookup table: for every slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if not is_prime(slots) or slots < len(shards) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime between the number of shards and {MAX_SLOTS}")
    at = [_number(f"{s}/offset") % slots for s in shards]
    step = [_number(f"{s}/step") % (slots - 1) + 1 for s in shards] if slots > 2 else [1] * len(shards)
    owner, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                return owner


def lookup(spark: SparkSession, table: list[int]) -> DataFrame:
    """The table as rows (slot, shard), made by SQL functions from one literal."""
    packed = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1).select(F.posexplode(packed).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    """60 bits of the key's md5, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, n_shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """One row per input row: the id, its slot, its shard and its text's bytes.

    The key is the id as text; rows with a null id go by their text (null text: empty), so they spread too.
    Repeated rows get the same shard; an empty table gives no rows; other columns are ignored.
    """
    table = fill(names or [f"shard-{i:05d}" for i in range(n_shards)], slots)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(text.cast("binary"))))
    rows = docs.select(F.col(id_col).alias("doc_id"), slot_of(key, slots).alias("slot"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.join(F.broadcast(lookup(docs.sparkSession, table)), "slot").select("doc_id", "slot", "shard", "n_bytes")


def manifest(placed: DataFrame) -> DataFrame:
    """Documents and bytes per shard; Spark sums within each task before the shuffle."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(read(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same placement in SQL; the table is stated as a literal."""
    table = ",".join(map(str, fill([f"shard-{i:05d}" for i in range(SHARDS)], SLOTS)))
    return f"""
WITH t AS (SELECT string_split('{table}', ',') AS owners),
d AS (SELECT doc_id, coalesce(text, '') AS txt, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(k), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot, CAST(strlen(txt) AS BIGINT) AS n_bytes FROM d)
SELECT doc_id, slot, CAST(owners[slot + 1] AS INTEGER) AS shard, n_bytes FROM s, t"""
