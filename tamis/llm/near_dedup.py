"""SimHash near-de-duplication with sharded Burkhard-Keller trees.

Fingerprints. Words and shingles follow ASCII white space; a fingerprint bit is the majority of that bit over the
XXH64 values of all shingles, repeats included.

Links. Only distinct fingerprints are compared. Cut into ``radius + 1`` blocks, two linked fingerprints agree on one
block at least, so each fingerprint is dealt once per block, keyed by the block's first bits: as many as make shards
of about ``TREE`` fingerprints. Every shard is a BK-tree, whose children are keyed by the integer Hamming distance to
their parent; a query follows only edges within the radius of its own distance. A shard with more than ``LIMIT``
fingerprints is dealt again, by the bits that its key leaves open, cut into ``radius + 1`` blocks once more, and so on;
after a few deals so few bits are open that no shard can be larger, so the bound holds for any data and nothing is
dropped. The trees hold the fingerprints of all documents, so they are not broadcast (that would pass through the
driver): a shard's tree and queries meet in one task by the shuffle. Per tree only the links of a spanning forest
leave the task, which is all that components need.

Components come from :mod:`tamis.llm.graph`; a class of equal fingerprints is one node, so copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, materialize, named_again, plain_names, read, slices, whole_row_key
from .graph import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints of a shard tree on average, and beyond which a shard is dealt again (a power of two).
TREE, LIMIT = 2048, 1 << 14
#: Fingerprint rows per task of the tree stage, for choosing its number of tasks.
ROWS_PER_TASK = 60_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """SimHash of a text; 0 without words. Fewer words than a shingle: the whole sequence is the one shingle."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(words[i:] for i in range(k))) if len(words) >= k else [words]
    h = np.fromiter((digest(join(s), SEED) for s in shingles), np.uint64, max(1, len(words) - k + 1))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # a long text's bits are counted in parts
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def memo(k: int):
    """:func:`fingerprint` that reads equal texts once, for one slice of rows."""
    seen: dict[str | None, int] = {}

    def of(text: str | None) -> int:
        if text not in seen:
            seen[text] = fingerprint(text, k)
        return seen[text]

    return of


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                fp = np.fromiter(map(memo(k), batch.column("text").to_pylist()), np.uint64, batch.num_rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class BkTree:
    """Over distinct fingerprints. Stored flat: a node's value and its children by distance."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[list[tuple[int, int]]] = [[] for _ in values]
        todo = [(0, np.arange(1, len(values)))]
        while todo:
            root, rest = todo.pop()
            if not len(rest):
                continue
            d = np.bitwise_count(values[rest] ^ values[root])
            order = np.argsort(d, kind="stable")
            rest, d = rest[order], d[order]
            cuts = np.flatnonzero(np.diff(d)) + 1
            for part, edge in zip(np.split(rest, cuts), d[np.concatenate([[0], cuts])]):
                self.children[root].append((int(edge), int(part[0])))
                todo.append((int(part[0]), part[1:]))

    def links(self, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For every node: the higher-numbered nodes within ``radius``. All values descend together as queries.

        A child has the least number of its subtree, so queries below it have nothing to find there.
        """
        todo = [(0, np.arange(len(self.values)))] if len(self.values) else []
        while todo:
            node, queries = todo.pop()
            d = np.bitwise_count(self.values[queries] ^ self.values[node]).astype(np.int16)
            near = queries[(d <= radius) & (queries > node)]
            if len(near):
                yield node, near
            for edge, child in self.children[node]:
                go = queries[(np.abs(d - edge) <= radius) & (queries > child - 1)]
                if len(go):
                    todo.append((child, go))


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of values within ``radius``, as index pairs."""
    label = np.arange(len(values))
    members: dict[int, list[np.ndarray]] = {}
    size = np.ones(len(values), np.int64)
    out = []
    for a, near in BkTree(values).links(radius):
        open_ = near[label[near] != label[a]]
        while len(open_):  # one link per component met; the smaller takes the larger's label
            b = int(open_[0])
            keep, gone = (label[a], label[b]) if size[label[a]] >= size[label[b]] else (label[b], label[a])
            moved = members.pop(int(gone), [np.array([gone])])
            members.setdefault(int(keep), [np.array([keep])]).extend(moved)
            for m in moved:
                label[m] = keep
            size[keep] += size[gone]
            out.append((a, b))
            open_ = open_[label[open_] != label[a]]
    return out


def _trees(radius: int):
    """Rows (key columns, fp) sorted by key -> links of each key's shard tree."""

    def emit(key_fps: np.ndarray) -> list[tuple[int, int]]:
        return [(int(a), int(b)) for i, j in spanning_links(key_fps.view(np.uint64), radius) for a, b in [(key_fps[i], key_fps[j])]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the open key's fingerprints: at most the bound of a key
        open_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            keys, fps = np.stack(cols[:-1]), cols[-1]
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            links = []
            for s, e in zip(np.concatenate([[0], cuts]), np.append(cuts, len(fps))):
                key = tuple(keys[:, s])
                if key != open_key:
                    if sum(map(len, held)) > 1:
                        links += emit(np.unique(np.concatenate(held)))
                    held, open_key = [], key
                held.append(fps[s:e])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["u", "v"])
        if sum(map(len, held)) > 1 and (links := emit(np.unique(np.concatenate(held)))):
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["u", "v"])

    return run


def deals(fixed: int, radius: int, bits: int | None = None) -> list[int]:
    """Masks of further deals of fingerprints that agree on the bits of the mask ``fixed``.

    The open bits are cut into ``radius + 1`` blocks; a mask adds one block's bits (its first ``bits``, if given) to ``fixed``.
    """
    free = [i for i in range(64) if not fixed >> i & 1]
    out = []
    for k in range(radius + 1):
        block = free[len(free) * k // (radius + 1) : len(free) * (k + 1) // (radius + 1)]
        out.append(fixed | sum(1 << i for i in block[:bits]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(distinct: DataFrame, n: int, radius: int = RADIUS, tree: int = TREE, limit: int = LIMIT) -> DataFrame:
    """Rows (mask, key, fp): fingerprints dealt so that linked ones meet in a shard (mask, key) of at most ``limit``."""
    spark = distinct.sparkSession
    least = max(radius + 1, limit.bit_length() - 1)  # so few open bits that a shard can't pass the limit
    bits = min(64 // (radius + 1), max(1, ceil(log2(max(n, 2) / tree)))) if n > tree else 0
    masks = deals(0, radius, bits) if bits else [0]

    def deal(rows: DataFrame, table: list[tuple[int, int]]) -> DataFrame:
        pairs = spark.createDataFrame([(_signed(a), _signed(b)) for a, b in table], "old long, new long")
        joined = rows.join(F.broadcast(pairs), F.col("mask") == F.col("old"))
        return joined.select(F.col("new").alias("mask"), F.col("fp").bitwiseAND(F.col("new")).alias("key"), "fp")

    open_ = deal(distinct.select(F.lit(0).cast("long").alias("mask"), "fp"), [(0, m) for m in masks])
    done = []
    while True:
        hot = open_.groupBy("mask", "key").agg(F.count("*").alias("size")).filter(F.col("size") > limit).select("mask", "key")
        hot = materialize(hot, "hot")
        masks = [m for m in masks if 64 - m.bit_count() > least]
        if not masks or hot.isEmpty():
            break
        done.append(open_.join(apart(hot), ["mask", "key"], "left_anti"))
        table = [(m, x) for m in masks for x in deals(m, radius)]
        open_ = materialize(deal(open_.join(apart(hot), ["mask", "key"], "left_semi"), table), "dealt")
        masks = sorted({x for _, x in table})
    for part in done:
        open_ = open_.unionByName(part)
    return open_


def links(distinct: DataFrame, n: int, radius: int = RADIUS, tree: int = TREE, limit: int = LIMIT) -> DataFrame:
    """Enough links (u, v) between distinct fingerprints (column fp, ``n`` of them) within ``radius`` to connect their components."""
    tasks = max(1, -(-n * (radius + 1) // ROWS_PER_TASK))
    rows = shards(distinct, n, radius, tree, limit).repartition(tasks, "mask", "key").sortWithinPartitions("mask", "key")
    return rows.select("mask", "key", "fp").mapInArrow(_trees(radius), "u long, v long")


def rooted(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp and the root of its component (a fingerprint) for every distinct fingerprint of ``fps``."""
    classes = materialize(fps.select("fp").distinct(), "classes")
    graph = components(links(classes, classes.count(), radius))
    return materialize(classes.join(graph, classes.fp == graph.node, "left").select("fp", F.coalesce("root", "fp").alias("root")), "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable through links).

    Null or blank texts have fingerprint zero and link like any other. Repeated rows share their component; rows with
    a null id take part, and a component of only such rows has a null component_id. An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, k), "fingerprints")
    named = rooted(fps, radius)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = named.join(apart(least), "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(apart(ids), "root").select("fp", "component_id")
    return fps.join(by_fp, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """Keeps one row of each group of near duplicates, with all its columns.

    Rows are judged one by one, whatever ids they share: of a group the row with the least id stays (rows without one
    come last), of equals the one with the least key of all its columns; rows equal in every column are one.
    Only keys are grouped; rows move once, to meet them.
    """
    names = docs.columns
    plain = plain_names(docs)
    i, t = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    plain = plain.withColumns({"k1": whole_row_key(plain, "a"), "k2": whole_row_key(plain, "b")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                fp = np.fromiter(map(memo(k), batch.column("text").to_pylist()), np.uint64, batch.num_rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(fp)], names=["k1", "k2", "id", "fp"])

    kind = plain.schema[i].dataType.simpleString()
    marks = plain.select("k1", "k2", F.col(i).alias("id"), F.col(t).alias("text")).mapInArrow(run, f"k1 long, k2 long, id {kind}, fp long")
    marks = materialize(marks, "marks")
    rows = marks.join(rooted(marks, radius), "fp").groupBy("root", "id", "k1", "k2").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2", "n")).alias("w"))
    first = materialize(first.select("w.k1", "w.k2", "w.n"), "kept")
    once = plain.join(apart(first.filter("n = 1").select("k1", "k2")), ["k1", "k2"], "left_semi")
    cells = F.struct(*(f"c{j}" for j in range(len(names))))
    several = plain.join(apart(first.filter("n > 1").select("k1", "k2")), ["k1", "k2"], "left_semi")
    several = several.groupBy("k1", "k2").agg(F.first(cells).alias("r")).select("r.*")  # equal rows
    return named_again(once, names).union(several.toDF(*names))
