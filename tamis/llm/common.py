"""Shared helpers of the training-data operators: table reading, shared work folders, batch slicing."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch while a work table is written; documents can be long, so batches are kept short.
ROWS_PER_BATCH = 1000
#: Text bytes that a Python stage works on at once (a single longer document is taken alone).
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table of a query, through Spark's own reader (paths may be in any Hadoop-readable store)."""
    lower_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@functools.cache
def _local_base() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tamis-')}"


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only on a single machine, where that setting is absent, a local folder is chosen. On a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lower_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to :data:`ROWS_PER_BATCH` rows, and never raises them.

    Queries and pipeline stages call this, because they return lazy results: batches of 64 MB, which Spark makes of
    documents by default, cost a worker and the JVM beside it several times their size. Operators called directly
    leave the session alone.
    """
    now = int(spark.conf.get(_BATCH))
    if not 0 < now <= ROWS_PER_BATCH:
        spark.conf.set(_BATCH, str(ROWS_PER_BATCH))


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of :data:`ROWS_PER_BATCH` rows for what runs inside; the session's own setting is put back."""
    before = spark.conf.get(_BATCH)
    lower_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to a shared folder and reads it back: lineage ends there and lost executors cost no recomputation."""
    path = work_dir(df.sparkSession, label)
    with short_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tamis_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what :func:`materialize` wrote for ``df`` (for loop states that nothing reads any more)."""
    path = getattr(df, "_tamis_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64-bit key of a row's id and text. Used beside the id, so that it only has to tell rows of one id apart."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def apart(counts: DataFrame) -> DataFrame:
    """Aggregated keys dealt evenly, off their aggregation's partitioning.

    A join to an aggregate on the same keys would reuse its partitioning, and Spark could not split a hot key's rows on
    the other side; with an exchange of its own on either side it can. These rows are distinct keys, so they are few.
    """
    return counts.repartition(max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def plain_names(df: DataFrame) -> DataFrame:
    """Columns renamed to c0, c1, ...: clashing, dotted or reserved names are out of the way."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def named_again(df: DataFrame, names: list[str]) -> DataFrame:
    """Undoes :func:`plain_names`; further columns go."""
    return df.select(*(F.col(f"c{i}") for i in range(len(names)))).toDF(*names)


def whole_row_key(df: DataFrame, seed: str) -> Column:
    """64-bit key over all columns; types that Spark can't hash (maps) count by their JSON."""
    cols = []
    for i, f in enumerate(df.schema.fields):
        kind = f.dataType.simpleString()
        c = F.col(df.columns[i])
        cols.append(F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c)
    return F.xxhash64(F.lit(seed), *cols)


def crc_of_id(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def slices(batch: pa.RecordBatch, text_col: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold about ``limit`` bytes together."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
