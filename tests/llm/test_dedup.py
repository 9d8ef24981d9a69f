"""Near-duplicates and repeated passages against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tamis.llm import near_dedup, substring_dedup
from tamis.llm.graph import components

from .conftest import EDGE


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for g in range(40):
        base = words(rng, 220)
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows) + 10, " ".join(w)))
    return rows + [(5000 + i, "same short text") for i in range(30)] + EDGE


def plain_components(rows):
    fp = [plain_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = collections.defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None:
            k = find(i)
            least[k] = r[0] if least[k] is None else min(least[k], r[0])
    return sorted((r[0] is None, r[0] or 0, f"{fp[i]:016x}", least[find(i)]) for i, r in enumerate(rows))


def test_near_duplicates(spark, make_docs):
    rows = near_corpus()
    got = near_dedup.near_duplicates(make_docs(rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in got) == plain_components(rows)


@pytest.mark.parametrize("tree,limit", [(2048, 1 << 14), (64, 256), (16, 8)])
def test_links_connect_what_brute_force_connects(spark, tree, limit):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base.tolist():  # clusters that drift, so that chains and hot keys occur
        x = b
        for _ in range(40):
            for _ in range(rng.integers(1, 4)):
                x ^= 1 << int(rng.integers(0, 63))
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    sizes = near_dedup.shards(df, len(fps), tree=tree, limit=limit).groupBy("mask", "key").count().collect()
    assert max(r["count"] for r in sizes) <= limit and (tree > len(fps) or len(sizes) > 3)
    got = {r["node"]: r["root"] for r in components(near_dedup.links(df, len(fps), tree=tree, limit=limit)).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {x: got.get(x, x) for x in fps} == {x: find(x) for x in fps}


def test_bk_tree_links():
    rng = np.random.default_rng(8)
    v = np.unique(rng.integers(0, 2**12, 300, dtype=np.uint64))
    got = {(int(a), int(b)) for a, near in near_dedup.BkTree(v).links(2) for b in near}
    assert got == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if bin(int(v[i] ^ v[j])).count("1") <= 2}


def test_dense_tree_gives_a_spanning_forest():
    """Everything within the radius of everything: links stay fewer than nodes."""
    v = np.unique(np.array([(1 << i) | (1 << j) for i in range(40) for j in range(40)] + [0], np.uint64))
    assert len(near_dedup.spanning_links(v, 4)) == len(v) - 1


def test_keep_one(spark, make_docs):
    docs = make_docs([(3, "one two three four"), (2, "one two three four"), (9, "something else entirely here"), (None, "a"), (None, "b"), (2, "one two three four")])
    got = near_dedup.keep_one(docs)
    assert got.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "a"), (0, "b"), (2, "one two three four"), (9, "something else entirely here")]


def test_keep_one_judges_rows_not_ids(spark, make_docs):
    a, b, c = "one two three four", "something else entirely here", "and a third text for good measure"
    got = near_dedup.keep_one(make_docs([(3, a), (5, a), (5, b), (5, c), (None, c), (7, b)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(3, a), (5, b), (5, c)])


def test_keep_one_edges(spark, make_docs):
    docs = make_docs(EDGE).withColumn("k1", F.lit("x")).withColumn("a.b", F.create_map(F.lit("k"), F.col("text"))).withColumn("__kept", F.lit(1))
    got = near_dedup.keep_one(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    fps = {plain_fingerprint(r[1]) for r in EDGE}
    assert len(rows) == len(fps) and {plain_fingerprint(r["text"]) for r in rows} == fps
    assert near_dedup.keep_one(make_docs([])).collect() == []


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


def test_near_duplicates_empty(spark, make_docs):
    assert near_dedup.near_duplicates(make_docs([])).collect() == []


def plain_removed(rows):
    w = [(r[1] or "").encode().split() for r in rows]
    seen = collections.Counter(tuple(x[i : i + 35]) for x in w for i in range(len(x) - 34))
    out = []
    for r, x in zip(rows, w):
        gone = [False] * len(x)
        for i in range(len(x) - 34):
            if seen[tuple(x[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((r[0] is None, r[0] or 0, len(x), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out)


def passage_corpus(seed=2):
    rng = random.Random(seed)
    shared = [words(rng, n) for n in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), words(rng, rng.randrange(0, 40))]
        rows.append((i, " ".join(x for p in parts for x in p)))
    for period in (1, 3, 20, 29, 33, 34, 35, 36, 50):  # texts that repeat within themselves, for all spacings
        for n in (35, 36, 45, 70, 71, 120):
            unit = [f"p{period}-{n}-{j}" for j in range(period)]
            rows.append((len(rows), " ".join((unit * 200)[:n])))
    return rows + [(900 + i, "  ".join(shared[4]) + "\n") for i in range(3)] + EDGE


def test_repeated_passages(spark, make_docs):
    rows = passage_corpus()
    got = substring_dedup.deduplicate(make_docs(rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == plain_removed(rows)


def test_incremental_index(spark, make_docs):
    """Batches fed one after another, with a merge of runs, mark in the last batch what one pass over all would."""
    rows = [r for r in passage_corpus(3) if r[0] is not None and r[0] < 900]
    index = substring_dedup.FingerprintIndex(spark, fanout=2)
    parts = [rows[i::3] for i in range(3)]
    for p in parts[:-1]:
        index.append(substring_dedup.entries(substring_dedup.keyed(make_docs(p))))
    assert [len(x) for x in index.levels] == [0, 1]
    got = substring_dedup.deduplicate(make_docs(parts[2]), index=index, history=make_docs(parts[0] + parts[1]), keep_text=True).collect()
    own = {d for d, *_ in parts[2]}
    assert sorted((False, r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == [r for r in plain_removed(rows) if r[1] in own]
    assert any(r["n_removed"] for r in got) and all(len(r["kept"].split()) == r["n_words"] - r["n_removed"] for r in got)


def test_index_needs_its_history(spark, make_docs):
    index = substring_dedup.FingerprintIndex(spark)
    first = substring_dedup.deduplicate(make_docs([(1, " ".join(map(str, range(60))))]), index=index).collect()
    assert [r["n_removed"] for r in first] == [0]
    with pytest.raises(ValueError):
        substring_dedup.deduplicate(make_docs([(2, " ".join(map(str, range(60))))]), index=index)
    got = substring_dedup.deduplicate(make_docs([(2, " ".join(map(str, range(60))))]), index=index, history=make_docs([(1, " ".join(map(str, range(60))))]))
    assert [r["n_removed"] for r in got.collect()] == [60]


def test_query_compacts(spark, make_docs):
    index = substring_dedup.build_index(substring_dedup.keyed(make_docs(passage_corpus())))
    assert [len(x) for x in index.levels] == [0, 1]


def test_cut_repeats_against_plain(spark, make_docs):
    rows = passage_corpus() + [(900, "  ".join(f"w{i}" for i in range(80)))] * 2
    docs = make_docs(rows).withColumn("n_chars", F.lit("about ten")).withColumn("c0", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("places", F.lit(1)).withColumn("x.y", F.array("text"))
    got = substring_dedup.cut_repeats(docs)
    assert got.columns == docs.columns
    texts = collections.defaultdict(list)
    for r in got.collect():
        assert r["n_chars"] == "about ten" and r["places"] == 1 and r["c0"] == {"a": r["doc_id"]}
        whole = r["x.y"][0]
        gone = whole != r["text"]
        texts[r["doc_id"] is None, r["doc_id"] or 0].append((whole or "", r["text"] or "", gone))
    plain = collections.defaultdict(list)
    for no_id, i, n, removed, digest in plain_removed(rows):
        plain[no_id, i].append((n, removed, digest))
    assert {k: len(v) for k, v in texts.items()} == {k: len(v) for k, v in plain.items()}
    for k, own in texts.items():
        assert sorted((len(w.encode().split()), len(w.encode().split()) - len(t.encode().split()), hashlib.sha256(b" ".join(t.encode().split())).hexdigest()) for w, t, _ in own) == sorted(plain[k])
        assert all(gone == (len(w.encode().split()) != len(t.encode().split())) for w, t, gone in own)
    assert substring_dedup.cut_repeats(make_docs([])).collect() == []


def test_dedup_empty(spark, make_docs):
    assert substring_dedup.deduplicate(make_docs([])).collect() == []


def test_hash_texts_parts(monkeypatch):
    """Cutting long texts changes no word's hash."""
    texts = ["a bb ccc " * 500, None, "", "x" * 300, " \n lead", "tail \t"]
    whole = substring_dedup.hash_texts(texts)
    monkeypatch.setattr(substring_dedup, "HASH_BYTES", 50)
    parts = substring_dedup.hash_texts(texts)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert whole[2].tolist() == [len((t or "").split()) for t in texts]
