"""Token counts per section by offset-mapped attribution.

A document is encoded once, whole. Byte-level tokens spell their text, so running sums of their lengths give every
token's span, in bytes and from there in characters. Sections (lines by default) are spans too, and an interval join
of the two, a merge of sorted bounds, tells for each section its tokens.

The rule for a token that crosses a boundary: it belongs to the section that holds most of its characters; of equals,
to the first. Every token is counted exactly once, so a document's section counts add up to its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long"


class Encoder:
    """ids and token byte lengths of a text."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def spans(self, text: str) -> np.ndarray:
        """End of every token, in bytes."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    key = path or ""
    if key not in _encoders:
        _encoders[key] = Encoder(path)
    return _encoders[key]


def line_sections(text: str) -> np.ndarray:
    """Ends of the lines, in characters; a line holds its line feed. An empty text is one empty section."""
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(chars == 10) + 1
    return ends if len(ends) and ends[-1] == len(chars) else np.append(ends, len(chars))


def attribute(token_ends: np.ndarray, raw: bytes, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary. Section ends are in characters."""
    n = len(section_ends)
    if not len(token_ends):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1  # a byte's character
    start, last = char[np.concatenate([[0], token_ends[:-1]])], char[token_ends - 1]
    first, final = (np.searchsorted(section_ends, x, side="right") for x in (start, last))
    owner = first.copy()
    for t in np.flatnonzero(final > first).tolist():
        best = -1
        for s in range(int(first[t]), int(final[t]) + 1):
            low = max(int(start[t]), int(section_ends[s - 1]) if s else 0)
            held = min(int(last[t]) + 1, int(section_ends[s])) - low
            if held > best:
                best, owner[t] = held, s
    return np.bincount(owner, minlength=n), np.bincount(owner[final > first], minlength=n)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, sections=line_sections) -> DataFrame:
    """One row per section: doc_id, section (from 0), char_start, char_end, n_tokens, n_crossing.

    A token across a boundary goes to the section with most of its characters, of equals to the first. Null and empty texts have one empty section without tokens. Repeated rows give equal rows; null ids stay null;
    an empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in slices(whole):
                sizes, ends, counts, crossing = [], [], [], []
                for text in batch.column("text").to_pylist():
                    text = text or ""
                    own = sections(text)
                    a, b = attribute(enc.spans(text), text.encode("utf-8", "replace"), own)
                    sizes.append(len(own))
                    ends.append(own)
                    counts.append(a)
                    crossing.append(b)
                size = np.array(sizes)
                first = np.cumsum(size) - size
                section = np.arange(int(size.sum())) - np.repeat(first, size)
                end = np.concatenate(ends).astype(np.int64)
                start = np.concatenate([[0], end[:-1]])
                start[first] = 0
                doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(size)), size)))
                yield pa.RecordBatch.from_arrays([doc, pa.array(section.astype(np.int32)), pa.array(start), pa.array(end), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(crossing).astype(np.int64))], names=["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def count_field_tokens(docs: DataFrame, fields: list[str], id_col: str = "doc_id", separator: str = "\n", path: str | None = None) -> DataFrame:
    """One row per row and field: doc_id, field, n_tokens, n_crossing.

    A row's fields, in the given order, are one text, encoded once; the separator between two fields belongs to the
    former, so a row's counts add up to the tokens of its whole text. Null fields are empty; extra columns are
    ignored; an empty table gives no rows.
    """
    cells = F.array(*(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))
    rows = docs.select(F.col(id_col).alias("doc_id"), cells.alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            counts, crossing = [], []
            for own in b.column("cells").to_pylist():
                text = separator.join(own)
                ends = np.cumsum([len(x) + len(separator) for x in own])
                ends[-1] -= len(separator)
                n, c = attribute(enc.spans(text), text.encode("utf-8", "replace"), ends)
                counts.append(n)
                crossing.append(c)
            doc = b.column("doc_id").take(pa.array(np.repeat(np.arange(b.num_rows), len(fields))))
            flat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([doc, pa.array(fields * b.num_rows, pa.string()), flat(counts), flat(crossing)], names=["doc_id", "field", "n_tokens", "n_crossing"])

    return rows.mapInArrow(run, "doc_id long, field string, n_tokens long, n_crossing long")


def field_totals(counted: DataFrame) -> DataFrame:
    """Tokens, sections and boundary tokens per document; summed within tasks before the shuffle."""
    return counted.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_sections"), F.sum("n_crossing").alias("n_crossing"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
