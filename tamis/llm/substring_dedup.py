"""Substring de-duplication over a log-structured index of window fingerprints.

A window is 35 consecutive words. Its anchor is the least hash among its eight-word grams, so equal windows have
equal anchors, and neighbouring windows mostly share one: an index entry is a *run*, the consecutive windows of one
document with one anchor, with a hash of the words they span. That is one entry for about fourteen windows.

The index is log-structured. Each batch of documents becomes an immutable run file set, sorted by anchor; when
:data:`FANOUT` runs of a level have gathered they are compacted into one of the next level, whose files each merge as
many sorted files. A query over a whole table feeds it in :data:`BATCHES` batches and merge-joins the runs on the
anchor at the end; an incremental batch is merge-joined with the earlier runs on the anchors that it holds. Either
way the join yields the candidates:

* an anchor of one entry only: nothing repeats;
* all entries of an anchor span the same words: every window in them repeats;
* otherwise the windows of one entry per distinct span are compared by a 128-bit hash of the whole window
  (verification), and the windows that start more than once are the repeats.

Counts are pre-aggregated in each task, and repeats are found by joins that Spark can split when skewed; entries of
an anchor are never gathered in one task, and no pairs are formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, drop, materialize, named_again, plain_names, read, slices

WINDOW, GRAM = 35, 8
#: Runs of one level that are merged into one of the next.
FANOUT = 4
#: Batches in which the query feeds the documents to the index.
BATCHES = 4
#: Windows of one entry at most. A place packs, from the lowest bit, the number of windows, whether the anchor's gram
#: occurs in them more than once, and the first window.
LONGEST = 1 << 20
SIZE_BITS, FIRST_SHIFT = (1 << 21) - 1, 22
#: Text bytes hashed together.
HASH_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.default_rng(20260101)
#: Random 64-bit values by byte offset in a word (modulo 64) and byte, for two independent word hashes.
_TABLES = _RANDOM.integers(0, 2**64, (2, 64 * 256), dtype=np.uint64)
_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 2 * n
            for name, x in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, x, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASES]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hash_part(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every word of ``raw`` and the words' first bytes."""
    buf = np.frombuffer(raw, np.uint8)
    space = _SPACE[buf]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), starts
    length = ends - starts
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    offset = np.arange(int(length.sum())) - np.repeat(first, length)
    cell = (offset & 63) * 256 + buf[~space]
    out = []
    for table in _TABLES:
        v = table[cell]
        if int(length.max()) > 64:  # later stretches of long words count differently
            v = v * (2 * (offset >> 6) + 1).astype(np.uint64)
        out.append(_mix(np.add.reduceat(v, first) + length.astype(np.uint64)))
    return out[0], out[1], starts


def hash_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of all words of the texts one after another, and the number of words of each text."""
    h1, h2, counts = [], [], np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    held_at: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            a, b, starts = _hash_part(b"\n".join(held))
            bounds = np.cumsum([len(x) + 1 for x in held])
            np.add.at(counts, held_at, np.diff(np.searchsorted(starts, bounds), prepend=0))
            h1.append(a)
            h2.append(b)
            held.clear()
            held_at.clear()
            size = 0

    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace") if text else b""
        at = 0
        while at < len(raw):  # very long texts in parts that end at white space
            end = at + HASH_BYTES
            if end < len(raw):
                cut = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut <= at:
                    later = [x for x in (raw.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
                    cut = min(later, default=len(raw))
                end = cut
            held.append(raw[at:end])
            held_at.append(i)
            size += end - at
            at = end
            if size >= HASH_BYTES:
                flush()
    flush()
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return join(h1), join(h2), counts


def _prefix(h: np.ndarray, which: int) -> np.ndarray:
    up, _ = _POWERS[which].get(len(h) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])


def _span(prefix: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from start to end, wherever they stand."""
    _, down = _POWERS[which].get(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def windows_hash(h1: np.ndarray, h2: np.ndarray, starts: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_mix(_span(_prefix(h, k), k, starts, starts + width)) for k, h in enumerate((h1, h2)))


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, x
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m if size == width else np.minimum(m[: len(m) - (width - size)], m[width - size :])


def runs(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, width: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text number, place, anchor and span hash of every run."""
    n = len(h1)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    if n < width:
        return none
    at = np.arange(n - width + 1)
    grams = np.arange(n - gram + 1)
    gram_hash = _mix(_span(_prefix(h1, 0), 0, grams, grams + gram))
    anchor = _slide_min(gram_hash, width - gram + 1)
    ends = np.cumsum(counts)
    text = np.searchsorted(ends, at, side="right")
    valid = at + width <= ends[text]
    at, text, anchor = at[valid], text[valid], anchor[valid]
    if not len(at):
        return none
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(fresh)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(fresh | (place % LONGEST == 0))
    size = np.diff(np.append(first, len(at)))
    begin = at[first]
    span = _mix(_span(_prefix(h2, 1), 1, begin, begin + size + width - 1) + size.astype(np.uint64))
    held = size + width - gram  # grams in the run's windows
    step = np.cumsum(held) - held
    owner = np.repeat(np.arange(len(first)), held)
    same = gram_hash[begin[owner] + np.arange(len(owner)) - step[owner]] == anchor[first][owner]
    several = np.add.reduceat(same.astype(np.int64), step) > 1
    place = ((begin - (ends - counts)[text[first]]) << FIRST_SHIFT) | (several.astype(np.int64) << (FIRST_SHIFT - 1)) | size
    return text[first], place, anchor[first], span


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2 (a 128-bit key of the row's id and text; equal rows share it), doc_id, text."""
    i, t = F.col(id_col), F.col(text_col)
    return docs.select(F.xxhash64(i, t).alias("k1"), F.xxhash64(t, i, F.lit("key")).alias("k2"), i.alias("doc_id"), t.alias("text"))


ENTRY = "anchor long, span long, k1 long, k2 long, place long"


def entries(rows: DataFrame) -> DataFrame:
    """Index entries of keyed rows; place packs the first window and the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                text, place, anchor, span = runs(*hash_texts(batch.column("text").to_pylist()))
                k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
                cols = [anchor.view(np.int64), span.view(np.int64), k1[text], k2[text], place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "span", "k1", "k2", "place"])

    return rows.select("k1", "k2", "text").mapInArrow(run, ENTRY)


class FingerprintIndex:
    """Immutable sorted runs of entries, by level, in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def append(self, batch: DataFrame) -> None:
        """Writes a batch's entries as a new run, every file sorted by anchor, and compacts levels that are full."""
        self.levels[0].append(self._write(batch))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            merged = old[0]
            for r in old[1:]:
                merged = merged.unionByName(r)
            files = max(1, -(-merged.rdd.getNumPartitions() // self.fanout))
            self.levels[level + 1].append(self._write(merged.coalesce(files)))
            for r in old:
                drop(r)
            level += 1

    def _write(self, rows: DataFrame) -> DataFrame:
        return materialize(rows.sortWithinPartitions("anchor", "span"), "run")

    def all(self) -> DataFrame:
        found = [r for level in self.levels for r in level]
        out = found[0]
        for r in found[1:]:
            out = out.unionByName(r)
        return out

    def candidates(self, anchors: DataFrame | None = None) -> DataFrame:
        """Entries whose anchor occurs elsewhere, by a merge join of all runs on the anchor: what is ``whole`` repeats altogether.

        With ``anchors`` (of an incremental batch, distinct) only theirs: earlier repeats are not found again.
        """
        rows = self.all()
        if anchors is not None:
            rows = materialize(rows.join(apart(anchors), "anchor", "left_semi"), "met")
        several = F.col("place").bitwiseAND(F.lit(1 << (FIRST_SHIFT - 1)))
        groups = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi"), F.max(several).alias("several"))
        groups = groups.filter((F.col("n") > 1) | (F.col("several") > 0))
        whole = (F.col("n") > 1) & (F.col("lo") == F.col("hi"))
        return rows.join(apart(groups.select("anchor", whole.alias("whole"))), "anchor")


def repeated(rows: DataFrame, index: FingerprintIndex, anchors: DataFrame | None = None) -> DataFrame:
    """k1, k2, place of all repeated windows of keyed rows whose entries the index holds (with ``anchors``, those alone)."""
    found = materialize(index.candidates(anchors), "candidates")
    mixed = found.filter("not whole")
    spans = mixed.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one"))
    again = mixed.join(apart(spans.filter("n > 1").select("anchor", "span")), ["anchor", "span"], "left_semi")
    open_ = spans.select("one.k1", "one.k2", F.struct(F.col("one.place").alias("place"), (F.col("n") == 1).alias("open")).alias("r"))
    wanted = open_.groupBy("k1", "k2").agg(F.collect_list("r").alias("wanted"))  # at most the runs of one document

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                h1, h2, counts = hash_texts(batch.column("text").to_pylist())
                base = np.cumsum(counts) - counts
                lists = batch.column("wanted")
                doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                place = flat.field("place").to_numpy(zero_copy_only=False)
                size, first = place & SIZE_BITS, place >> FIRST_SHIFT
                owner = np.repeat(np.arange(len(place)), size)
                begin = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
                w1, w2 = windows_hash(h1, h2, base[doc[owner]] + begin)
                is_open = flat.field("open").to_numpy(zero_copy_only=False)[owner]
                k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False)[doc[owner]] for c in ("k1", "k2"))
                cols = [w1.view(np.int64), w2.view(np.int64), k1, k2, np.where(is_open, begin, -1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["w1", "w2", "k1", "k2", "begin"])

    windows = rows.join(wanted, ["k1", "k2"]).select("k1", "k2", "doc_id", "text", "wanted").mapInArrow(explode, "w1 long, w2 long, k1 long, k2 long, begin long")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2")
    single = windows.filter("begin >= 0").join(apart(twice), ["w1", "w2"], "left_semi").select("k1", "k2", (F.shiftleft("begin", FIRST_SHIFT) + 1).alias("place"))
    return found.filter("whole").select("k1", "k2", "place").unionByName(again.select("k1", "k2", "place")).unionByName(single)


def removed_words(places: np.ndarray, n_words: int) -> np.ndarray:
    """Which words the repeated windows cover."""
    first, size = places >> FIRST_SHIFT, places & SIZE_BITS
    delta = np.zeros(n_words + 1, np.int64)
    np.add.at(delta, first, 1)
    np.add.at(delta, first + size + WINDOW - 1, -1)
    return np.cumsum(delta[:-1]) > 0


def _kept(text: str | None, places: list[int] | None) -> tuple[int, int, bytes]:
    words = text.encode("utf-8", "replace").split() if text else []
    if not places:
        return len(words), 0, b" ".join(words)
    gone = removed_words(np.array(places, np.int64), len(words))
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def build_index(rows: DataFrame, batches: int = BATCHES) -> FingerprintIndex:
    index = FingerprintIndex(rows.sparkSession)
    for b in range(batches):
        index.append(entries(rows.filter(F.pmod("k2", F.lit(batches)) == b)))
    return index


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: FingerprintIndex | None = None, history: DataFrame | None = None, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and kept, the text left, if asked for).

    Every occurrence of a repeated window is removed. Null texts have no words. Repeated rows are repeats of each
    other. Texts under 35 words lose nothing. An empty table gives no rows; extra columns are ignored. With an
    ``index`` that holds earlier batches, ``docs`` is appended to it and judged against them too; ``history``, the
    documents of those batches, is required then: the verification reads the windows of their entries there.
    """
    rows = known = keyed(docs, id_col, text_col)
    anchors = None
    if index is None:
        index = build_index(rows)
    else:
        if any(index.levels):
            if history is None:
                raise ValueError("the index holds earlier batches; pass their documents as history")
            known = rows.unionByName(keyed(history, id_col, text_col))
        own = materialize(entries(rows), "batch")
        anchors = own.select("anchor").distinct()
        index.append(own)
    marks = repeated(known, index, anchors).groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))
    both = rows.join(marks, ["k1", "k2"], "left").select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                got = [_kept(t, p) for t, p in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist())]
                cols = [batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    cols.append(pa.array([g[2].decode("utf-8", "replace") for g in got], pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else ""))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with repeated passages cut out of their text; every other column, and a text that loses nothing, stays as it is.

    Rows of any number of equal ids are judged each; null texts stay null; an empty table gives no rows; other columns
    may have any name and type.
    """
    names = docs.columns
    plain = plain_names(docs)
    i, t = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    rows = keyed(plain, i, t)
    marks = repeated(rows, build_index(rows)).groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))
    both = plain.withColumns({"k1": F.xxhash64(i, t), "k2": F.xxhash64(t, i, F.lit("key"))}).join(marks, ["k1", "k2"], "left").drop("k1", "k2")
    at, size = names.index(text_col), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, t):
                texts = [_kept(x, p)[2].decode("utf-8", "replace") if p else x for x, p in zip(b.column(at).to_pylist(), b.column(size).to_pylist())]
                cols = [b.column(k) for k in range(size)]
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, schema=b.schema.remove(size))

    return named_again(both.mapInArrow(run, plain.schema), names)
