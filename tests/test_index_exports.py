"""The stored text index, exports, file housekeeping and change stamps, in small cases."""

import io
import os
import re
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators import geometry as G
from tamis.operators import history as H
from tamis.operators import retrieval as R
from tamis.operators import tables as X
from tamis.operators.text_index import TextIndex
from tamis.sources import export, files

DOCS = "doc_id long, content string"


def ranked(df):
    return [(r["query_id"], r["doc_id"], round(r["score"], 9)) for r in df.orderBy("query_id", F.desc("score"), "doc_id").collect()]


def test_index_equals_search_over_what_is_live(spark, tmp_path):
    first = [(1, "red fox and red hen"), (2, "blue fox"), (3, "a hen"), (None, "no id"), (4, ""), (5, None)]
    index = TextIndex(spark, str(tmp_path / "i"), {"content": F.col("content")}, buckets=4)
    asks = spark.createDataFrame([("a", "red fox"), ("b", "hen"), ("c", "green")], "query_id string, query string")
    assert index.search(asks).collect() == []
    bad = index.add(spark.createDataFrame(first, DOCS)).collect()
    assert [(r["content"], r["error"]) for r in bad] == [("no id", "no doc_id")]

    def check(rows):
        live = spark.createDataFrame(rows, DOCS)
        for every in (True, False):
            assert ranked(index.search(asks, all_terms=every)) == ranked(R.bm25(live, asks, {"content": F.col("content")}, all_terms=every))

    check([r for r in first if r[0]])
    index.update(spark.createDataFrame([(2, "green hen"), (9, "red red fox")], DOCS))
    check([(1, first[0][1]), (2, "green hen"), (3, "a hen"), (4, ""), (9, "red red fox")])
    index.delete(spark.createDataFrame([(1,), (77,)], "doc_id long"))
    check([(2, "green hen"), (3, "a hen"), (4, ""), (9, "red red fox")])
    index.add(spark.createDataFrame([(1, "fox again")], DOCS))
    check([(1, "fox again"), (2, "green hen"), (3, "a hen"), (4, ""), (9, "red red fox")])


def test_index_reads_only_its_terms_buckets(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), {"content": F.col("content")}, buckets=8)
    index.add(spark.createDataFrame([(i, f"word{i} fox") for i in range(50)], DOCS))
    plan = index.search(spark.createDataFrame([("a", "fox")], "query_id string, query string"))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(term,fox\)", plan)


@pytest.mark.parametrize("block", [3, 4096])
@pytest.mark.parametrize("measure", ["cosine", "l2", "script"])
def test_blocks_against_loops(spark, block, measure):
    g = np.random.default_rng(3)
    v = [[float(x) for x in g.integers(-3, 4, 5)] for _ in range(40)] + [[0.0] * 5]
    rows = spark.createDataFrame([(i, x, i % 3) for i, x in enumerate(v)] + [(99, None, 0)], "doc_id long, embedding array<float>, label int")
    asked = [(i, v[i]) for i in range(0, 40, 5)]
    got = R.search_blocks(rows, spark.createDataFrame(asked, "query_id long, q array<float>"), 4, measure, others=True, group="label", block_rows=block).collect()
    expected = set()
    for i, q in asked:
        for label in range(3):
            scored = []
            for j, x in enumerate(v):
                if j == i or j % 3 != label:
                    continue
                a, b = np.array(x), np.array(q)
                n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
                s = 1 - np.sqrt(((a - b) ** 2).sum()) if measure == "l2" else (a @ b / n if n else 0.0) + (measure == "script")
                scored.append((-round(float(s), 6), j))
            expected |= {(i, label, j, -s) for s, j in sorted(scored)[:4]}
    assert {(r["query_id"], r["label"], r["doc_id"], r["score"] + 0.0) for r in got} == {(a, b, c, s + 0.0) for a, b, c, s in expected}
    assert R.search_blocks(rows, spark.createDataFrame([], "query_id long, q array<float>"), 4).collect() == []


def test_zip_of_csv(spark):
    cells = spark.createDataFrame([("d", "t1", 0, 0, "a", 'x,"y"'), ("d", "t1", 0, 1, "b", None), ("d", "t2", 0, 0, "c", "1")], "doc_id string, table_id string, row_idx int, col_idx int, col_name string, value string")
    (r,) = export.csv_zips(cells, "today").collect()
    with zipfile.ZipFile(io.BytesIO(bytes(r["content"]))) as z:
        assert z.read("table_1.csv").decode() == 'a,b\n"x,""y""",\n' and z.read("table_2.csv").decode() == "c\n1\n"
        assert "Tables: 2" in z.read("README.txt").decode() and "today" in z.read("README.txt").decode()


def test_export_types(spark):
    values = {0: ["1", "2", "300", "4"], 1: ["1.5", "2", "3", "4"], 2: ["a", "a", "a", "b"], 3: ["a", "b", "c", "c"], 4: ["1", None, "3", "4"], 5: [None] * 4}
    cells = spark.createDataFrame([("t", i, c, v) for c, col in values.items() for i, v in enumerate(col)] + [("t", 9, 0, None)], "table_id string, row_idx int, col_idx int, value string")
    assert {r["col_idx"]: r["type"] for r in X.export_types(cells).collect()} == {0: "int16", 1: "float", 2: "text", 3: "text", 4: "text"}
    more = spark.createDataFrame([("t", i, 0, "ab"[i % 2]) for i in range(5)], "table_id string, row_idx int, col_idx int, value string")
    assert X.export_types(more).first()["type"] == "category"


def test_files_metadata_summary_and_purge(spark, tmp_path):
    for name, body in (("a.txt", "one\ftwo"), ("b.txt", "broken")):
        (tmp_path / name).write_text(body)
    os.utime(tmp_path / "a.txt", (time.time() - 7200, time.time() - 7200))
    found = files.scan(spark, str(tmp_path), "*.txt")

    def reader(content):
        if content == b"broken":
            raise ValueError("not readable")
        return {"title": "T", "pages": content.count(b"\f") + 1, "other": 1}

    got = {r["path"][-5:]: r for r in files.metadata(found, reader).collect()}
    assert got["a.txt"]["metadata"]["pages"] == "2" and got["a.txt"]["metadata"]["author"] == "" and "other" not in got["a.txt"]["metadata"] and got["b.txt"]["error"] == "not readable"
    assert tuple(files.scan_summary(files.metadata(found, reader)).first()) == (1, 1)
    assert export.purge_old(spark, str(tmp_path), 1) == 1 and sorted(p.name for p in tmp_path.glob("*.txt")) == ["b.txt"]


def test_context_updates(spark):
    now = F.expr("TIMESTAMP '2024-01-01 00:00:00'")
    schema = "session_id int, " + H.CONTEXT
    old = spark.createDataFrame([(1, [(str(i), "r", None) for i in range(5)], {"a": "1"}), (2, [], None), (3, [("q", "r", None)], {"x": "y"})], schema)
    change = spark.createDataFrame([(1, "new", "answer", {"a": "2", "b": "3"}), (2, "no response", None, {"c": "4"}), (9, "q", "r", None)], "session_id int, query string, response string, metadata map<string,string>")
    got = {r["session_id"]: r for r in H.update_contexts(old, change, now).collect()}
    assert [h["query"] for h in got[1]["history"]] == ["1", "2", "3", "4", "new"] and got[1]["metadata"] == {"a": "2", "b": "3"}
    assert got[2]["history"] == [] and got[2]["metadata"] == {"c": "4"} and got[3]["metadata"] == {"x": "y"} and got[3]["last_updated"] is None and 9 not in got


def test_stamps(spark):
    old = spark.sql("SELECT * FROM VALUES (1, 'a', TIMESTAMP '2020-01-01'), (2, NULL, TIMESTAMP '2020-01-01') AS t(id, v, updated_at)")
    new = spark.sql("SELECT * FROM VALUES (1, 'b', TIMESTAMP '2020-01-01'), (2, NULL, TIMESTAMP '2020-01-01'), (3, 'c', TIMESTAMP '2020-01-01') AS t(id, v, updated_at)")
    got = {r["id"]: r["updated_at"].year for r in H.stamped(old, new, "id", F.expr("TIMESTAMP '2024-01-01'")).collect()}
    assert got == {1: 2024, 2: 2020, 3: 2024}


def test_region_merge_against_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(f"t{i:02d}", "d", i // 8, int(rng.integers(0, 30)), int(rng.integers(0, 20)), 20, 15, float(rng.integers(0, 50))) for i in range(24)]
    alike = [(f"t{i:02d}", f"t{j:02d}") for i in range(24) for j in range(i) if rng.random() < 0.6]
    got = X.merge_by_region(spark.createDataFrame(rows, "table_id string, doc_id string, page int, x int, y int, width int, height int, confidence double"), spark.createDataFrame(alike, "left_id string, right_id string"))
    like = {frozenset(p) for p in alike}
    expected = set()
    for page in range(3):
        kept = []
        for r in sorted((r for r in rows if r[2] == page), key=lambda r: (-r[7], r[0])):
            def overlap(k, r=r):
                w = min(k[3] + 20, r[3] + 20) - max(k[3], r[3])
                h = min(k[4] + 15, r[4] + 15) - max(k[4], r[4])
                i = max(0, w) * max(0, h)
                return i / (600 - i)
            if not any(frozenset((k[0], r[0])) in like and overlap(k) > X.MERGE_OVERLAP for k in kept):
                kept.append(r)
        expected |= {r[0] for r in kept[:5]}
    assert {r["table_id"] for r in got.collect()} == expected


def test_detections_are_cut_before_suppression(spark):
    rows = [("d", 1, i, 0, 0, 10, 10, 1 - i / 100) for i in range(12)] + [("d", 1, 50, 500, 500, 10, 10, 0.1)]
    boxes = spark.createDataFrame(rows, "doc_id string, page int, box_id int, x int, y int, width int, height int, confidence double").withColumn("type", F.lit("symbol"))
    assert [r["box_id"] for r in G.nms(G.detection_top_k(boxes)).collect()] == [0]
