"""Benchmark decontamination with an FM-index per training shard.

The benchmark's windows of words are the test phrases. Each task cuts its documents into shards of a bounded
number of words, maps words to the phrases' own alphabet (every other word is a break), and indexes the shard:
suffix order, Burrows-Wheeler transform, a wavelet tree for ranks, and sampled suffix positions. All phrases are
searched backwards together, occurrences are located by walking to a sampled position, and the spans found are
merged per document. Nothing is shuffled: only phrases travel, in blocks of checked size.

A break compares as a symbol of its own, so no suffix is ordered by what lies beyond it and no phrase can cross it.
Stretches of alphabet words shorter than the shortest phrase hold no occurrence and are left out of the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices

WINDOW = 13
#: Every so many text positions the index keeps the position itself.
SAMPLE = 16
#: Words indexed together.
SHARD_WORDS = 1 << 20
#: Bytes of benchmark text whose phrases are broadcast at once; a larger benchmark is taken in several such blocks.
BLOCK_BYTES = 4 << 20
#: Share of hit words from which a document counts as contaminated: one in so many.
ONE_IN = 20
#: Lower-cases A-Z, keeps digits, letters and bytes of non-ASCII characters, blanks everything else.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


class Phrases:
    """Distinct windows of a block of benchmark items, as rows of word ids (0 pads), and which items hold each."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple, set[int]] = {}
        self.items = ["" if i is None else str(i) for i, _ in items]
        for k, (_, text) in enumerate(items):
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text)]
            for at in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[at : at + window]), set()).add(k)
        self.length = np.array([len(p) for p in found], np.int64)
        self.words = np.zeros((len(found), window), np.int32)
        for r, p in enumerate(found):
            self.words[r, : len(p)] = p
        self.owners = [sorted(v) for v in found.values()]
        self.least = int(self.length.min()) if len(found) else 0


class WaveletTree:
    """Ranks over a sequence of small integers: one stably partitioned bit vector per bit, from the highest."""

    def __init__(self, seq: np.ndarray, top: int):
        self.ones, self.zeros = [], []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            b = (seq >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(b, dtype=np.int64)]))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[b == 0], seq[b == 1]])
        self.bits = len(self.ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its position."""
        low = np.zeros_like(at)
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = self.ones[k][low], self.ones[k][at]
            low, at = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, at - b)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for k in range(self.bits):
            a = self.ones[k][at]
            one = self.ones[k][at + 1] > a
            at = np.where(one, self.zeros[k] + a, at - a)
            symbol = 2 * symbol + one
        return symbol


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; every 0 (a break) is a symbol of its own, ordered by place."""
    breaks = text == 0
    rank = text.astype(np.int64) + int(breaks.sum())
    rank[breaks] = np.arange(int(breaks.sum()))
    step, n = 1, len(text)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + int(breaks.sum()) + int(text.max(initial=0)) + 2) + second if step == 1 else rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = fresh
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


class FmIndex:
    """Over a text of word ids that ends with a break (0)."""

    def __init__(self, text: np.ndarray, top: int):
        order = suffix_order(text)
        bwt = text[order - 1].astype(np.int64)  # the word before the first one is the last break
        self.tree = WaveletTree(bwt, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        # a break's own order is its place in the text, so its LF step is not a rank: positions just after one are sampled too
        kept = (order % SAMPLE == 0) | (bwt == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]

    def search(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases at once: the suffix range of each."""
        rows = np.arange(len(words))
        last = words[rows, length - 1].astype(np.int64)
        low, high = self.before[last], self.before[last + 1]
        for back in range(2, words.shape[1] + 1):
            go = rows[(length >= back) & (low < high)]
            if not len(go):
                break
            c = words[go, length[go] - back].astype(np.int64)
            low[go], high[go] = self.before[c] + self.tree.rank(c, low[go]), self.before[c] + self.tree.rank(c, high[go])
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: LF steps until a sampled row."""
        out, steps, open_ = np.zeros(len(at), np.int64), 0, np.arange(len(at))
        while len(open_):
            done = self.kept[at + 1] > self.kept[at]
            out[open_[done]] = self.places[self.kept[at[done]]] + steps
            at, open_ = at[~done], open_[~done]
            if len(at):
                c = self.tree.access(at)
                at = self.before[c] + self.tree.rank(c, at)
            steps += 1
        return out


def occurrences(docs: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrase number and position, in the concatenated words of ``docs``, of every occurrence."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.length):
        return none
    get = phrases.ids.get
    parts = []
    for w in docs:
        parts.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
        parts.append(np.zeros(1, np.int32))
    text = np.concatenate([np.zeros(1, np.int32), *parts])
    breaks = np.flatnonzero(text == 0)
    run = np.diff(np.append(breaks, len(text))) - 1  # alphabet words after each break
    long = run >= phrases.least
    if not long.any():
        return none
    keep = np.repeat(long, run + 1)
    place = np.flatnonzero(keep)
    index_text = np.append(text[place], 0)
    index = FmIndex(index_text, len(phrases.ids))
    low, high = index.search(phrases.words, phrases.length)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    at = place[index.locate(rows)] - 1  # in text, after its first break
    doc_break = np.cumsum([len(w) + 1 for w in docs])
    return which, at - np.searchsorted(doc_break, at, side="right")


def merge(which: np.ndarray, at: np.ndarray, n_words: np.ndarray, phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """Merged removal spans (start, end) and item ids of each document."""
    base = np.concatenate([[0], np.cumsum(n_words)])
    spans: list[list[tuple[int, int]]] = [[] for _ in n_words]
    items: list[set[str]] = [set() for _ in n_words]
    if len(at):
        end = at + phrases.length[which]
        order = np.argsort(at, kind="stable")
        at, end, which = at[order], end[order], which[order]
        doc = np.searchsorted(base, at, side="right") - 1
        for d, p in np.unique(np.stack([doc, which]), axis=1).T:
            items[d].update(phrases.items[k] for k in phrases.owners[p])
        reach = np.maximum.accumulate(end)
        first = np.concatenate([[True], (at[1:] > reach[:-1]) | (doc[1:] != doc[:-1])])
        starts = np.flatnonzero(first)
        for s, e, d in zip(at[starts], np.append(reach[starts[1:] - 1], reach[-1]), doc[starts]):
            spans[d].append((int(s - base[d]), int(e - base[d])))
    return spans, items


def blocks(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in blocks of at most ``limit`` bytes of text (one longer item stands alone)."""
    part, total = [], 0
    for r in bench.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull()).orderBy("i", "t").toLocalIterator():
        n = len(r["t"].encode("utf-8", "replace"))
        if part and total + n > limit:
            yield part
            part, total = [], 0
        part.append((r["i"], r["t"]))
        total += n
    yield part


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds to every row: n_words, spans (merged, in words) and items (ids of benchmark items with an occurring window).

    ``docs`` has a column ``text``. Null texts have no words. Each block of the benchmark is one more map over the
    rows, which widens spans and items; rows never move.
    """
    spark = docs.sparkSession
    fields = docs.schema.names
    out = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for block in blocks(bench, limit=block_bytes):
        shared = spark.sparkContext.broadcast(Phrases(block, window))
        out = out.mapInArrow(_scan_block(shared, len(fields)), out.schema)
    return out


def _scan_block(shared, n_fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for whole in batches:
            for batch in slices(whole):
                docs = [words_of(t) for t in batch.column("text").to_pylist()]
                spans, items, n = [], [], [len(w) for w in docs]
                start = 0
                while start < len(docs):  # shards of about SHARD_WORDS words
                    stop, total = start, 0
                    while stop < len(docs) and (stop == start or total + n[stop] <= SHARD_WORDS):
                        total += n[stop]
                        stop += 1
                    s, i = merge(*occurrences(docs[start:stop], phrases), np.array(n[start:stop]), phrases)
                    spans += s
                    items += i
                    start = stop
                old_spans, old_items = batch.column(n_fields + 1).to_pylist(), batch.column(n_fields + 2).to_pylist()
                joined = [union([(x["start"], x["end"]) for x in a] + b) if a else b for a, b in zip(old_spans, spans)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k) for k in range(n_fields)),
                        pa.array(n, pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in x] for x in joined], batch.schema.field(n_fields + 1).type),
                        pa.array([sorted({*a, *b}) for a, b in zip(old_items, items)], batch.schema.field(n_fields + 2).type),
                    ],
                    schema=batch.schema,
                )

    return run


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def verdict(scanned: DataFrame) -> DataFrame:
    """Counts and the contamination rule, from spans and items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return scanned.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the merged spans.

    Null or empty texts: no words, not contaminated. Repeated rows give equal rows; null item texts are no items;
    an item without an id counts under the empty id; an empty benchmark hits nothing; extra columns are ignored.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    done = verdict(scan(plain, bench))
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Drops contaminated documents; the others keep all their columns and their text."""
    tagged = docs.toDF(*("text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    kept = verdict(scan(tagged, bench)).filter(~F.col("contaminated"))
    return kept.select(*(F.col(t).alias(c) for t, c in zip(tagged.columns, docs.columns)))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
