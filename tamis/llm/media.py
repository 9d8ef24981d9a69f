"""Media payloads in a content-defined chunk store.

A payload is cut where a rolling gear hash of its last 32 bytes has its top bits zero, so equal stretches of different
payloads are cut alike. Chunks are named by digest and stored once, each as one compressed frame; a payload is the
ordered list of its chunks, and its stored form is their frames in that order (a stream that any decoder of the format
reads). Reading back joins the lists with the store on the digest, checks every chunk against its digest and the
whole against the payload's, and computes features from the bytes read.

Chunk bytes move when equal chunks meet for storing; the store stays dealt by digest (a bucketed table), so lists come
to the chunks and not the other way. Only chunks of payloads of more than one chunk move again, to be put in
order. Equal payloads are one entry, so copies move as digests only.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, materialize, read, short_batches, slices, work_dir

#: Payload lengths are positive multiples of this (a 24 x 24 frame of 8-bit samples).
UNIT, FILL = 576, b"\xff"
#: Least and greatest chunk; between them a cut falls every 2**MASK_BITS bytes on average.
MIN_CHUNK, MAX_CHUNK, MASK_BITS = 2 << 10, 8 << 10, 11
LEVEL = 19
_GEAR = np.random.default_rng(20260201).integers(0, 2**32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the bytes padded to a positive multiple of :data:`UNIT`."""
    raw = text.encode("utf-8", "replace") if text else b""
    return len(raw), raw + FILL * (-len(raw) % UNIT or (0 if raw else UNIT))


def cut(payload: bytes) -> list[int]:
    """Ends of the payload's chunks."""
    n = len(payload)
    if n <= MIN_CHUNK:
        return [n]
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    step = 1
    while step < 32:  # h[i] sums gear values of the last 32 bytes, each shifted by its age
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    spots = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    ends, at = [], 0
    while n - at > MIN_CHUNK:
        k = int(np.searchsorted(spots, at + MIN_CHUNK))
        end = min(int(spots[k]) if k < len(spots) else n, at + MAX_CHUNK, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def features(payload: bytes) -> str:
    """Sum, distinct values and byte entropy of the samples, in plain text."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    return f"sum={int((counts * np.arange(256)).sum())};distinct={int((counts > 0).sum())};entropy={-(p * np.log2(p)).sum():.6f}"


def recipes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, the payload's digest, and its ordered chunk digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                n, pid, chunks = [], [], []
                for text in batch.column("text").to_pylist():
                    size, payload = payload_of(text)
                    ends = cut(payload)
                    n.append(size)
                    pid.append(digest(payload))
                    chunks.append([pid[-1]] if len(ends) == 1 else [digest(payload[a:b]) for a, b in zip([0, *ends], ends)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(pid, pa.binary()), pa.array(chunks, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "pid", "chunks"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, pid binary, chunks array<binary>")


def chunk_rows(docs: DataFrame) -> DataFrame:
    """Chunks with their bytes compressed, each once per task: digest, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        sent: set[bytes] = set()  # 16 bytes a chunk of this task's split
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for text in batch.column("text").to_pylist():
                    payload = payload_of(text)[1]
                    ends = cut(payload)
                    for a, b in zip([0, *ends], ends):
                        piece = payload[a:b]
                        name = digest(piece)
                        if name not in sent:
                            sent.add(name)
                            rows.append((name, pack(piece)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=["digest", "data"])

    return docs.mapInArrow(run, "digest binary, data binary")


class ChunkStore:
    """Distinct chunks in the shared folder, dealt by digest; later batches add only what no earlier one holds."""

    def __init__(self, spark: SparkSession):
        self.spark, self.parts = spark, []

    def add(self, chunks: DataFrame) -> None:
        for part in self.parts:
            chunks = chunks.join(part.select("digest"), "digest", "left_anti")
        once = chunks.groupBy("digest").agg(F.first("data").alias("data"))
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"tamis_chunks_{uuid.uuid4().hex}"
        with short_batches(self.spark):
            once.write.bucketBy(buckets, "digest").option("path", work_dir(self.spark, "chunks")).saveAsTable(name)
        self.parts.append(self.spark.table(name))

    def find(self, refs: DataFrame) -> DataFrame:
        """``refs`` with the data of their digest. A digest is in one part only."""
        out = None
        for part in self.parts:
            found = refs.join(part, "digest")
            out = found if out is None else out.unionByName(found)
        return out


OUT = "pid binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(pid: bytes, frames: list[tuple[bytes, bytes]]) -> tuple:
    """Values of a payload from its stored chunks (digest, compressed bytes), each verified."""
    unpack = zstandard.ZstdDecompressor().decompress
    parts = []
    for name, data in frames:
        piece = unpack(data)
        if digest(piece) != name:
            raise ValueError(f"chunk {name.hex()} does not match its digest")
        parts.append(piece)
    payload, stored = b"".join(parts), b"".join(data for _, data in frames)
    if digest(payload) != pid:
        raise ValueError(f"payload {pid.hex()} is not what was stored")
    return pid, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload)


_TYPES = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
_NAMES = ["pid", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def read_back(store: ChunkStore, lists: DataFrame) -> DataFrame:
    """Values of every payload (pid and its chunks, one row each), from the store."""

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_describe(p, [(d, z)]) for p, d, z in zip(*(b.column(c).to_pylist() for c in ("pid", "digest", "data")))]
            if rows:
                yield _batch(rows)

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, frames = None, []  # the open payload: one document at most
        for b in batches:
            rows = []
            for p, d, z in zip(*(b.column(c).to_pylist() for c in ("pid", "digest", "data"))):
                if p != pid:
                    if frames:
                        rows.append(_describe(pid, frames))
                    pid, frames = p, []
                frames.append((d, z))
            if rows:
                yield _batch(rows)
        if frames:
            yield _batch([_describe(pid, frames)])

    one = lists.filter(F.size("chunks") == 1).select("pid", F.element_at("chunks", 1).alias("digest"))
    many = lists.filter(F.size("chunks") > 1).select("pid", F.posexplode("chunks").alias("seq", "digest"))
    one = store.find(one).select("pid", "digest", "data").mapInArrow(singles, OUT)
    many = store.find(many).repartition("pid").sortWithinPartitions("pid", "seq").select("pid", "digest", "data").mapInArrow(longer, OUT)
    return one.unionByName(many)


def ingest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", store: ChunkStore | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, then the values that :func:`read_back` gives for its payload.

    Null and empty texts store one unit of fill bytes. Repeated rows and equal texts get equal values. An empty table
    gives no rows; extra columns are ignored. With a ``store`` of earlier batches, only new chunks are added, and
    only this batch's payloads are read back.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(recipes(plain), "recipes")
    store = store or ChunkStore(docs.sparkSession)
    store.add(chunk_rows(plain.select("text")))
    lists = rows.groupBy("pid").agg(F.first("chunks").alias("chunks"))
    values = materialize(read_back(store, lists), "values")
    return rows.select("doc_id", "n_bytes", "pid").join(apart(values), "pid").drop("pid")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest(read(spark, sf_dir, "documents"))
