"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

A bin is filled greedily (largest piece that fits, again and again). Then its smallest piece is taken out, and if two
unpacked pieces fill the widened gap more tightly, they take its place. Pieces are whole documents, but for longer
ones, which are cut at the capacity.

Tokens never move: the tokenizing map emits one small row per piece, these rows are dealt evenly into shards of a
bounded number of pieces, and each shard is packed in one task. A shard leaves at most one bin open, a share of a
thousandth or less at :data:`SHARD_PIECES`.

Tokenizing. The vocabulary's pre-tokenizer never joins what white space separates, so ids depend on one
white-space-delimited word alone: the tokenizer runs once per distinct word of a bounded table. Texts with
characters outside a plain range (where Unicode rules could differ), or with the text of a special token, are
encoded whole by the tokenizer itself, and so is every text where another vocabulary cuts or cleans words in its own way.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, slices

CAPACITY, END_ID = 4096, 1
SHARD_PIECES = 32_768
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker keeps at once.
CACHE_WORDS = 250_000
#: Texts made only of these characters take the word-wise path.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ‐-‟…€]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: The steps before the model that the word-wise path stands for, as the vocabulary file writes them.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The file's place on this machine (executors look it up for themselves)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """ids of a text as little-endian unsigned 32-bit integers, word by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        told = json.loads(self.whole.to_str())
        self.wordwise = all(told[k] == v for k, v in STEPS.items())
        self.model = self.whole.model
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))  # the byte-level alphabet: visible bytes stand for themselves, the rest follow from 256
        self.alphabet = {b: chr(b) if b in visible else chr(next(hidden)) for b in range(256)}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids: list[int] = []
        for p in PIECE.findall(word):
            spelled = p if p.isascii() else "".join(map(self.alphabet.__getitem__, p.encode()))
            ids += [t.id for t in self.model.tokenize(spelled)]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.wordwise or not PLAIN.fullmatch(text) or "<|" in text or not unicodedata.is_normalized("NFC", text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
            return b"".join([known[w] for w in words])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str | None) -> WordTokenizer:
    key = path or ""
    if key not in _tokenizers:
        _tokenizers[key] = WordTokenizer(path or vocabulary_path())
    return _tokenizers[key]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Null texts are empty; every text ends with :data:`END_ID`."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for whole in batches:
            for batch in slices(whole):
                ids, piece, start, length, crc = [], [], [], [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    raw = encode(text) + end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        ids.append(doc)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE_SCHEMA)


class Stock:
    """Unpacked pieces by length, with the largest length within a limit found by one bit operation."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(lengths, kind="stable")
        self.of: dict[int, list[int]] = {}
        for i in order[::-1].tolist():
            self.of.setdefault(int(lengths[i]), []).append(i)
        self.mask = 0
        for n in self.of:
            self.mask |= 1 << n

    def largest(self, limit: int) -> int:
        return (self.mask & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 else -1

    def take(self, n: int) -> int:
        own = self.of[n]
        i = own.pop()
        if not own:
            self.mask ^= 1 << n
        return i

    def put(self, n: int, i: int) -> None:
        self.of[n].append(i)
        self.mask |= 1 << n

    def best_two(self, gap: int) -> tuple[int, int] | None:
        """The two lengths in stock whose sum is nearest to ``gap`` without passing it."""
        best, found, a = 0, None, self.largest(gap - 1)
        while a > 0 and 2 * a > best:
            b = self.largest(min(a, gap - a))
            if b == a and len(self.of[a]) < 2:
                b = self.largest(b - 1)
            if b > 0 and a + b > best:
                best, found = a + b, (a, b)
                if best == gap:
                    break
            a = self.largest(a - 1)
        return found


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every piece, and each bin's free space. Lengths are from 1 to ``capacity``."""
    stock = Stock(lengths)
    bins, offsets, free = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    while stock.mask:
        content, gap = [], capacity
        while (n := stock.largest(gap)) > 0:
            content.append((n, stock.take(n)))
            gap -= n
        if gap and len(content) > 1:  # greedy picks fall in size, so the last is the smallest
            n, i = content[-1]
            two = stock.best_two(gap + n)
            if two and sum(two) > n:
                content[-1:] = [(m, stock.take(m)) for m in two]
                stock.put(n, i)
                gap += n - sum(two)
        at = 0
        for n, i in content:
            bins[i], offsets[i] = len(free), at
            at += n
        free.append(gap)
    return bins, offsets, np.array(free, np.int64)


def pack_pieces(rows: DataFrame, n_rows: int, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset. ``rows`` are pieces, ``n_rows`` about their number."""
    shards = max(1, round(n_rows / shard_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]  # five numbers a piece, at most about the shard's bound
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        shard = table.column("shard")[0].as_py()
        bins, offsets, _ = best_two_fit(table.column("length").to_numpy(), capacity)
        ids = pa.array(bins + (shard << 32))
        table = table.drop_columns(["shard"]).append_column("sequence_id", ids).append_column("offset", pa.array(offsets))
        yield from table.to_batches(max_chunksize=10_000)

    # an even deal without a key: Spark sorts before dealing, so a task run again deals the same
    dealt = rows.repartition(shards).withColumn("shard", F.spark_partition_id().cast("long"))
    return dealt.mapInArrow(run, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty texts are one piece of one token. Repeated rows are packed each. Null ids stay null.
    An empty table gives no rows; extra columns are ignored. Pieces are written to the shared folder first, so
    that no lost executor makes the tokenizer run again.
    """
    rows = materialize(pieces(docs, id_col, text_col, capacity, path), "pieces")
    return pack_pieces(rows, rows.count(), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
