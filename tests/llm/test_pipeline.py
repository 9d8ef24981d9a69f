"""The corpus pipeline: every stage against a plain version of its rule, on its own input."""

import random

import pytest
from pyspark.sql import functions as F

from tamis.llm import language_id, packing
from tamis.llm.common import materialize, read

from .conftest import EDGE
from .test_dedup import plain_fingerprint, plain_removed
from .test_text_models import plain_contamination

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Copies, near copies, shared passages, benchmark passages, repeated ids, nulls, long and empty texts in a small table."""
    rng = random.Random(21)
    vocabulary = {"en": "the house is there and they were with some other things when it would".split(), "fr": "les maisons sont dans cette grande ville avec quelque chose pour vous".split()}
    say = lambda lang, n: [rng.choice(vocabulary[lang]) + rng.choice(["", "s", "ly", "ment"]) + rng.choice("abcdefgh") for _ in range(n)]
    bench = [(i, " ".join(say("en", 30))) for i in range(4)]
    shared = [say("en", 50), say("fr", 80)]
    rows = []
    for i in range(80):
        lang = ("en", "fr")[i % 2]
        w = say(lang, rng.randrange(5, 150))
        if i % 7 == 0:
            w[2:2] = rng.choice(shared)
        if i % 11 == 0:
            w[3:3] = bench[i % 4][1].split()
        rows.append((i, " ".join(w), lang))
    rows += [(200 + i, rows[3][1], "fr") for i in range(5)] + [(3, rows[8][1], "en"), (3, "quite another text under an id that is taken", "en"), rows[5], rows[5]]
    rows += [(*r, "en") for r in EDGE] + [(300, "12 34 ... 56", "en"), (301, "the house is there " * 4000, "en")]
    d = str(tmp_path_factory.mktemp("pipeline"))
    full = [(i, t, lang, "src", None if t is None else len(t)) for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def stages(spark, d, start=None):
    """Name, input rows and output rows of every stage, run as the pipeline does."""
    import corpus_pipeline as P

    docs = read(spark, d, "documents") if start is None else start
    for name, stage in P.STAGES:
        out = materialize(stage(spark, docs, d), name)
        yield name, docs, out
        docs = out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_each_stage(spark, fixture):
    by = {name: (before, after) for name, before, after in stages(spark, fixture)}
    columns = read(spark, fixture, "documents").columns
    assert list(by) == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    assert all(after.columns == columns for name, (_, after) in by.items() if name != "packing")

    before, after = by["language_id"]  # every row with a letter stays here, and nothing else
    assert rows(after) == [r for r in rows(before) if r[1] and any(c.isalpha() for c in r[1])]

    before, after = by["near_dedup"]  # one row per component, of its least id
    given, kept = [r[:2] for r in rows(before)], [r[:2] for r in rows(after)]
    groups: list[tuple[set, list]] = []  # fingerprints that hang together, and their rows
    for r in given:
        fp = plain_fingerprint(r[1])
        near = [g for g in groups if any(bin(fp ^ x).count("1") <= 2 for x in g[0])]
        groups = [g for g in groups if g not in near] + [({fp}.union(*(g[0] for g in near)), [r] + [x for g in near for x in g[1]])]
    assert len(kept) == len(groups) < len(given)
    for _, own in groups:
        (stays,) = [r for r in kept if r in own]
        assert stays[0] == min((r[0] for r in own if r[0] is not None), default=None)

    before, after = by["substring_dedup"]
    expected, left = {}, {}
    for _, i, n, gone, _ in plain_removed([r[:2] for r in rows(before)]):
        expected.setdefault(i, []).append(n - gone)
    for r in rows(after):
        left.setdefault(r[0] or 0, []).append(len(r[1].encode().split()))
        assert r[4] == len(r[1])
    assert {k: sorted(v) for k, v in left.items()} == {k: sorted(v) for k, v in expected.items()}
    assert sum(map(sum, left.values())) < sum(len(r[1].encode().split()) for r in rows(before))

    before, after = by["decontamination"]
    bad = plain_contamination([r[:2] for r in rows(before)], [tuple(r) for r in read(spark, fixture, "benchmark").collect()])
    assert len(rows(after)) == sum(not r[-1] for r in bad) < len(bad) and set(rows(after)) <= set(rows(before))

    before, after = by["packing"]
    pieces, encode = after.collect(), packing.WordTokenizer(packing.vocabulary_path()).encode
    total: dict = {}
    for r in pieces:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    wanted: dict = {}
    for r in rows(before):
        wanted[r[0]] = wanted.get(r[0], 0) + len(encode(r[1])) // 4 + 1
    assert total == wanted
    bins: dict = {}
    for r in pieces:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_ids_that_are_taken(spark, fixture):
    """A text under an id that another text has is judged by itself."""
    by = {name: after for name, _, after in stages(spark, fixture)}
    assert "quite another text under an id that is taken" in {r[1] for r in rows(by["near_dedup"])}


def test_run_is_the_stages(spark, fixture):
    import corpus_pipeline as P

    *_, (_, _, last) = stages(spark, fixture)
    assert rows(P.run(spark, fixture).drop("sequence_id", "offset")) == rows(last.drop("sequence_id", "offset"))


def test_stages_on_an_empty_table(spark, fixture):
    for name, _, after in stages(spark, fixture, read(spark, fixture, "documents").limit(0)):
        assert after.count() == 0, name


def test_stages_on_the_smallest_set(spark):
    for name, before, after in stages(spark, SF):
        assert 0 < after.select("doc_id").distinct().count() <= before.select("doc_id").distinct().count(), name


def test_stages_leave_extra_columns(spark, fixture):
    docs = read(spark, fixture, "documents").withColumns({"spans": F.lit("mine"), "places": F.lit(1), "fp": F.array("doc_id"), "c0": F.create_map(F.lit("a"), F.lit(2))})
    for name, before, after in stages(spark, fixture, docs):
        if name != "packing":
            assert after.columns == before.columns and after.filter("spans <> 'mine' or places <> 1").count() == 0, name


def test_language_stage_rejects_low_scores(spark, fixture, monkeypatch):
    docs = read(spark, fixture, "documents")
    monkeypatch.setattr(language_id, "MIN_SCORE", 1.1)
    assert language_id.keep_identified(docs).count() == 0
