"""Packing, token counts, media and sharding: exact round trips and brute force."""

import hashlib
import random
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest

from tamis.llm import media, packing, sharding, token_counts

from .conftest import EDGE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


def test_word_tokenizer_equals_whole(plain_tokenizer):
    rng = random.Random(4)
    odd = [chr(c) for c in [*range(32, 0x250), 9, 10, 11, 12, 13, 0x1C, 0x85, 0x2019, 0x20AC, 0x301, 0x3A3, 0x4E2D, 0x1F600]]
    words = packing.WordTokenizer(packing.vocabulary_path())
    texts = [t or "" for _, t, *_ in EDGE] + ["<|endoftext|> a", "it's we'll O'Neil 12x3_y", unicodedata.normalize("NFD", "été Ångström")]
    texts += ["".join(rng.choice(odd if rng.random() < 0.3 else "aeiou ntrs'd.12_-") for _ in range(rng.randrange(60))) for _ in range(1500)]
    for t in texts:
        assert words.encode(t) == np.array(plain_tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_pack(spark, make_docs, plain_tokenizer):
    rows = EDGE + [(100 + i, "lorem ipsum " * (3 + 11 * (i % 40))) for i in range(150)] + [(300, "tok " * 9000)]
    got = packing.pack(make_docs(rows)).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        assert sum(r["length"] for r in own) <= 4096 and [r["offset"] for r in own] == np.cumsum([0] + [r["length"] for r in own][:-1]).tolist()
    expected = []
    for r in rows:
        raw = np.array(plain_tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(raw), 4096)):
            part = raw[at : at + 4096]
            expected.append((r[0] is None, r[0] or 0, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 4096) + 1
    assert packing.pack(make_docs([])).collect() == []


def test_best_two_fit():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n = rng.integers(1, 60)
        lengths, cap = rng.integers(1, 21, n), 20
        bins, offsets, free = packing.best_two_fit(lengths, cap)
        for b in range(len(free)):
            own = np.flatnonzero(bins == b)
            order = own[np.argsort(offsets[own])]
            assert lengths[own].sum() + free[b] == cap and offsets[order].tolist() == np.cumsum([0, *lengths[order][:-1]]).tolist()
        assert sorted(set(bins.tolist())) == list(range(len(free)))
    # greedy takes 6 and leaves 4; 5 + 5 in its place fill the bin
    bins, _, free = packing.best_two_fit(np.array([10, 6, 5, 5]), 20)
    assert free[0] == 0 and bins[0] == bins[2] == bins[3] and bins[1] != bins[0]


def test_best_two_against_all_pairs():
    rng = np.random.default_rng(9)
    for _ in range(300):
        lengths = rng.integers(1, 30, rng.integers(2, 12))
        stock, gap = packing.Stock(lengths), int(rng.integers(2, 50))
        sums = [int(a + b) for i, a in enumerate(lengths) for b in lengths[:i] if a + b <= gap]
        found = stock.best_two(gap)
        assert (sum(found) if found else 0) == max(sums, default=0)


def test_media_round_trip(spark, make_docs):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghij \n") for _ in range(500_000))
    rows = EDGE + [(50, long), (51, long), (52, "prefix " + long), (53, long[: 576 * 3])]
    docs = make_docs(rows)
    got = media.ingest(docs).collect()
    assert len(got) == len(rows)
    expected = []
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        expected.append((r[0] is None, r[0] or 0, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), media.features(payload)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"]) for r in got) == sorted(expected)
    assert len({(r["payload_sha256"], r["media_sha256"], r["media_bytes"]) for r in got}) == len({r["payload_sha256"] for r in got})
    assert media.ingest(make_docs([])).collect() == []


def test_cuts_are_content_defined():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 2_000_000, dtype=np.uint8).tobytes()
    pieces = lambda b: [b[s:e] for s, e in zip([0, *media.cut(b)], media.cut(b))]
    a, b = pieces(base), pieces(b"inserted" + base)
    assert b"".join(a) == base and all(len(p) <= media.MAX_CHUNK for p in a) and all(len(p) >= media.MIN_CHUNK for p in a[:-1])
    assert len(set(a) & set(b)) > 0.8 * len(a)


def test_store_adds_only_new_chunks(spark, make_docs):
    store = media.ChunkStore(spark)
    store.add(media.chunk_rows(make_docs([(1, "one"), (2, "two")]).select("text")))
    store.add(media.chunk_rows(make_docs([(3, "two"), (4, "three")]).select("text")))
    assert [p.count() for p in store.parts] == [2, 1]


def test_store_across_batches(spark, make_docs):
    """A chunk is found whether an earlier batch stored it alone or inside a longer payload, and values don't depend on batches."""
    rng = random.Random(4)
    while True:  # until the first chunk is a payload of its own, without fill bytes
        long = "".join(rng.choice("abcdefghij ") for _ in range(12_000))
        payload = media.payload_of(long)[1]
        first = media.cut(payload)[0]
        if first % media.UNIT == 0:
            break
    piece = long[:first]
    assert media.cut(piece.encode()) == [first]
    alone = {r["doc_id"]: r for r in media.ingest(make_docs([(1, piece), (2, long)])).collect()}
    for order in ([(1, piece), (2, long)], [(2, long), (1, piece)]):
        store = media.ChunkStore(spark)
        for row in order:
            (got,) = media.ingest(make_docs([row]), store=store).collect()
            assert got == alone[row[0]]


def test_damaged_chunk_is_found():
    import zstandard

    with pytest.raises(ValueError):
        media._describe(b"x" * 16, [(media.digest(b"right"), zstandard.compress(b"wrong"))])


def test_token_attribution(spark, make_docs):
    rows = EDGE + [(70, "a\n\n\nb"), (71, "é\n\n漢字\n  x\n"), (72, "no line end"), (73, "\n" * 40 + "x")]
    got = token_counts.count_tokens(make_docs(rows))
    enc = token_counts.encoder(None)
    by: dict = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    for r in rows:
        if r[0] in (None, 1):
            continue
        text, own = r[1] or "", sorted(by[r[0]], key=lambda x: x["section"])
        assert "".join(text[s["char_start"] : s["char_end"]] for s in own) == text
        assert sum(s["n_tokens"] for s in own) == len(enc.encoding.encode_ordinary(text))
    totals = {r["doc_id"]: r["n_sections"] for r in token_counts.field_totals(got.filter("doc_id = 73")).collect()}
    assert totals == {73: 41} and token_counts.count_tokens(make_docs([])).collect() == []


def plain_attribution(text, ends, enc):
    """Tokens per section: every token decoded, every character of it dealt, one after another."""
    raw = text.encode()
    of_byte = [k for k, c in enumerate(text) for _ in c.encode()]
    section_of = [next(s for s, e in enumerate(ends) if k < e) for k in range(len(text))]
    counts, crossing, at = [0] * len(ends), [0] * len(ends), 0
    for token in enc.encoding.encode_ordinary(text):
        spelled = enc.encoding.decode_single_token_bytes(token)
        assert raw[at : at + len(spelled)] == spelled
        held = {}
        for k in sorted(set(of_byte[at : at + len(spelled)])):
            held[section_of[k]] = held.get(section_of[k], 0) + 1
        owner = min(held, key=lambda s: (-held[s], s))
        counts[owner] += 1
        crossing[owner] += len(held) > 1
        at += len(spelled)
    return counts, crossing


def test_sections_against_plain(spark, make_docs):
    rng = random.Random(12)
    alphabet = ["a", "the ", "\n", "\n\n\n", "  ", "é", "漢字", "\t", "x1", ", ", "🙂", "\n  \n"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120)))) for i in range(60)] + [(99, "one two\n" * 2000)]
    enc, by = token_counts.encoder(None), {}
    for r in token_counts.count_tokens(make_docs(rows)).collect():
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in rows:
        own = sorted(by[i], key=lambda r: r["section"])
        counts, crossing = plain_attribution(text, [r["char_end"] for r in own], enc)
        assert [r["n_tokens"] for r in own] == counts and [r["n_crossing"] for r in own] == crossing
        assert [r["char_start"] for r in own] == [0, *(r["char_end"] for r in own[:-1])]


def test_fields_against_plain(spark, make_docs):
    rows = [(1, "some text\nhere", "en"), (2, None, "fr"), (3, "", None), (4, "é漢字 " * 30, "de")]
    docs = make_docs(rows).select("doc_id", "text", "lang", "n_chars")
    enc, got = token_counts.encoder(None), {}
    for r in token_counts.count_field_tokens(docs, ["lang", "text", "n_chars"], separator="\n\n").collect():
        got.setdefault(r["doc_id"], {})[r["field"]] = (r["n_tokens"], r["n_crossing"])
    for i, text, lang in rows:
        cells = [lang or "", text or "", "" if text is None else str(len(text))]
        whole, ends, at = "\n\n".join(cells), [], 0
        for c in cells:
            at += len(c) + 2
            ends.append(min(at, len(whole)))
        ends[-1] = len(whole)
        counts, crossing = plain_attribution(whole, ends, enc)
        assert got[i] == dict(zip(["lang", "text", "n_chars"], zip(counts, crossing)))
    assert token_counts.count_field_tokens(make_docs([]), ["text"]).collect() == []


def test_boundary_rule():
    """A token goes to the section with most of its characters, of equals to the first."""
    raw = b"abcdef"
    counts, crossing = token_counts.attribute(np.array([4, 6]), raw, np.array([1, 6]))
    assert counts.tolist() == [0, 2] and crossing.tolist() == [0, 1]
    counts, crossing = token_counts.attribute(np.array([4, 6]), raw, np.array([2, 6]))
    assert counts.tolist() == [1, 1] and crossing.tolist() == [1, 0]


def test_sharding(spark, make_docs):
    docs = make_docs(EDGE)
    got = sharding.place(docs).collect()
    assert len(got) == len(EDGE) and len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    assert sharding.place(make_docs([])).collect() == []
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = {r[0]: r[1:] for r in c.sql(sharding.oracle()).fetchall()}
    df = sharding.op10_sharding(spark, SF)
    assert "Python" not in df._jdf.queryExecution().toString()
    assert {r["doc_id"]: (r["slot"], r["shard"], r["n_bytes"]) for r in df.collect()} == expected
    assert sharding.manifest(df).agg({"n_docs": "sum"}).first()[0] == len(expected)


def test_table_is_balanced_and_stable():
    names = [f"s{i}" for i in range(10)]
    a, b = sharding.fill(names, 1009), sharding.fill(names[:9], 1009)
    counts = np.bincount(a)
    assert counts.max() - counts.min() <= 1
    moved = sum(x != y for x, y in zip(a, b) if x != 9)
    assert moved < 0.15 * 1009
    # by the rule itself: replay turns
    at = {i: [(sharding._number(f"{n}/offset") + j * (sharding._number(f"{n}/step") % 1008 + 1)) % 1009 for j in range(1009)] for i, n in enumerate(names)}
    owner: dict[int, int] = {}
    while len(owner) < 1009:
        for i in range(10):
            if len(owner) < 1009:
                owner[next(s for s in at[i] if s not in owner)] = i
    assert [owner[s] for s in range(1009)] == a
    for bad in ([], ["x", "x"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 11)
    with pytest.raises(ValueError):
        sharding.fill(["x"], 12)


def test_other_vocabularies_are_encoded_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["The Cat's  hat, 12 times", "plain words only", "a\n\nb"]
    for text in texts:
        expected = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packing.WordTokenizer(path).encode(text), "<u4").tolist() == expected
    assert packing.WordTokenizer(packing.vocabulary_path()).wordwise and not packing.WordTokenizer(path).wordwise
