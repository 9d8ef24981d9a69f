"""Hand-computed cases, and greedy operators against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tamis.functions import analyzer, classify, text
from tamis.functions.vectors import cosine, l2_similarity
from tamis.operators import admission, geometry, history, invoice, retrieval, tables
from tamis.sources import export, files
from tamis.streaming import batching, cache, metrics, ratelimit


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("v")).first()["v"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([], [1.0]), ([0.0], [1.0])], "a array<float>, b array<float>")
    got = [tuple(r) for r in df.select(F.round(l2_similarity(F.col("a"), F.col("b")), 6), F.round(cosine(F.col("a"), F.col("b")), 6)).collect()]
    assert got[0] == (0.105573, 0.6) and got[1][1] == 0.0 and got[2][1] == 0.0


@pytest.mark.parametrize("method,expected", [("weighted_sum", [0.8, 0.5, 0.5]), ("average", [0.8, 0.5, 0.5]), ("max", [0.8, 0.6, 0.5])])
def test_fusion(spark, method, expected):
    rag = spark.createDataFrame([("q", "a", 0.8), ("q", "b", 0.6), ("q", None, 0.9)], "query_id string, doc_id string, score double")
    sem = spark.createDataFrame([("q", "b", 0.4), ("q", "c", 0.5)], "query_id string, doc_id string, score double")
    got = {r["doc_id"]: round(r["score"], 9) for r in retrieval.fuse(rag, sem, method).collect()}
    assert got == dict(zip("abc", expected))


def test_block_rerank(spark):
    rows = [("q", d, s, float(c)) for d, s, c in [("a", 0.9, 0), ("b", 0.8, 1), ("c", 0.7, 0.5), ("d", 0.6, 0), ("e", 0.5, 1)]]
    out = retrieval.block_rerank(spark.createDataFrame(rows, "query_id string, doc_id string, score double, cos double"))
    assert [r["doc_id"] for r in out.orderBy("new_rank").collect()] == ["b", "c", "a", "e", "d"]


def test_concept_scores(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, retrieval.jaccard(arr("A", "b"), arr("B", "c"))) == pytest.approx(1 / 3)
    assert one(spark, retrieval.exact_match_boost(F.lit(0.8), F.lit("x y z"), arr("X", "y", "Z"))) == 1.0


def test_analysis_sections(spark):
    t = "Concepts: a, b; c\n\nIntention: trouver\n\nContraintes:\nlieu: Paris\nan: 2020\n\nRelations:\nx -> y\nz -> w"
    row = spark.createDataFrame([(t,)], ["t"]).select(
        retrieval.concepts_of(F.col("t")).alias("c"), retrieval.intent_of(F.col("t")).alias("i"), retrieval.constraints_of(F.col("t")).alias("k"), retrieval.relations_of(F.col("t")).alias("r")
    ).first()
    assert row["c"] == ["a", "b", "c"] and row["i"] == "trouver" and row["k"] == {"lieu": "Paris", "an": "2020"}
    assert [tuple(x) for x in row["r"]] == [("x", "y"), ("z", "w")]
    assert one(spark, retrieval.intent_of(F.lit("nothing"))) == "unknown"


def test_parameters():
    assert retrieval.clamp_params(99, 3, rag_weight=-1) == {"max_docs": 20, "min_score": 1.0, "rag_weight": 0.0}
    with pytest.raises(ValueError):
        retrieval.validate_params("nope", {})
    with pytest.raises(ValueError):
        retrieval.validate_params("rag", {"max_docs": 0})
    assert retrieval.merge_filters({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3}


def test_analyzer(spark):
    got = one(spark, analyzer.french_tokens(F.lit("L'étude des chevaux et qu'il aime les grandes maisons")))
    assert got[0] == "etud" and "cheval" in got and "et" not in got and "grand" in got


def test_cleaning(spark):
    assert one(spark, text.clean(F.lit("A  b\n\n\nc"))) == "A b c"
    assert one(spark, text.clean(F.lit("intro\nHistorique des révisions v1\nfin"))) == "intro"
    assert one(spark, text.clean(F.lit("ACME – rue X\nY 99000 Ville, tel\nreste"), (("ACME", "99000 Ville"),))) == "reste"
    assert one(spark, text.revision(F.lit("CMA001_rev12"))) == "12" and one(spark, text.revision(F.lit("x"))) == "00"


def test_sections(spark):
    df = spark.createDataFrame([(1, "Intro\n1) Ouvrir\ntexte\n2) Fermer")], ["doc_id", "content"])
    rows = text.scored_sections(df).orderBy("section_idx").collect()
    assert [round(r["importance_score"], 6) for r in rows] == [1.0, 1.0, 0.95]
    assert rows[1]["content"] == "1) Ouvrir\ntexte" and rows[1]["has_steps"]


def test_keywords(spark):
    assert one(spark, text.keyword_positions(F.lit("aaaa"), F.lit("aa"))) == [0, 1, 2]
    assert one(spark, text.keyword_positions(F.lit("b.a.a"), F.lit(".a"))) == [1, 3]
    assert one(spark, text.keyword_positions(F.lit(""), F.lit("a"))) == []
    assert one(spark, text.keyword_count(F.lit("aaaa"), F.lit("aa"))) == 2


def test_chunks_cover_text(spark):
    t = "".join(chr(97 + i % 26) for i in range(4321))
    rows = text.chunks(spark.createDataFrame([(1, t)], ["doc_id", "content"])).orderBy("chunk_index").collect()
    whole = rows[0]["content"] + "".join(r["content"][text.CHUNK_OVERLAP :] for r in rows[1:])
    assert whole == t and all(a["content"][-150:] == b["content"][:150] for a, b in zip(rows, rows[1:]))
    with pytest.raises(ValueError):
        text.chunks(spark.createDataFrame([(1, t)], ["doc_id", "content"]), 10, 10)


def test_classification(spark):
    q = F.lit("Comment créer une commande ?")
    assert one(spark, classify.query_type(q)) == "procedural" and one(spark, classify.complexity(q)) == 0.5
    assert one(spark, classify.is_ambiguous(F.lit("cela ?"))) and not one(spark, classify.is_ambiguous(q))
    assert one(spark, classify.clean_response(F.lit("a[/INST] <s>"))) == classify.EMPTY_ANSWER
    assert classify.overlay_settings({"t": 1}, {"x": {"t": 2, "style": "s"}}, "x") == {"t": 2}


def test_amounts(spark):
    assert one(spark, invoice.amount(F.lit("1 234,50 €"))) == 1234.5 and one(spark, invoice.amount(F.lit("1.234,50"))) == 0.0


def test_state(spark):
    df = spark.createDataFrame([(1, {"pending_clarification": "x", "k": "v"})], "id int, m map<string,string>")
    assert df.select(history.drop_transient(F.col("m")).alias("m")).first()["m"] == {"k": "v"}
    rows = spark.createDataFrame([(1, 1, 1, "q", "r", None, None, 0.5, 3, 0.1, [("t", None, 0.9)])], "id int, user_id int, session_id int, query string, response string, query_vector array<float>, response_vector array<float>, confidence_score double, tokens_used int, processing_time double, documents array<struct<title:string,page:int,score:double>>")
    out = history.chat_interaction(rows, 3)
    assert out["chat_history"].first()["query_vector"] == [0.0] * 3 and out["referenced_documents"].first()["page_number"] == 1 and out["message_embeddings"].count() == 2


def test_admission_range(spark):
    df = spark.createDataFrame([("10.0.0.9",), ("10.1.0.9",), ("bad",), ("300.1.1.1",), (None,)], ["ip"])
    assert [r[0] for r in df.select(admission.ip_trusted(F.col("ip"), ["10.0.0.0/24"])).collect()] == [True, False, False, False, False]


def box(i, x, y, w, h, c, t="rectangular"):
    return ("d", 1, i, x, y, w, h, c, t, False, "")


BOXES = "doc_id string, page int, box_id int, x int, y int, width int, height int, confidence double, type string, is_checked boolean, text_context string"


def test_nms(spark):
    df = spark.createDataFrame([box(1, 0, 0, 10, 10, 0.9), box(2, 1, 1, 10, 10, 0.8), box(3, 20, 20, 10, 10, 0.7)], BOXES)
    assert sorted(r["box_id"] for r in geometry.nms(df).collect()) == [1, 3]
    assert geometry.overlapping(df).first()["iou"] == pytest.approx(81 / 119)


def test_nms_against_loop(spark):
    rng = random.Random(5)
    rows = [box(i, rng.randrange(60), rng.randrange(60), rng.randrange(5, 20), rng.randrange(5, 20), rng.randrange(100) / 100) for i in range(80)]
    kept = []
    as_dict = lambda r: dict(zip(["x", "y", "width", "height"], r[3:7]))
    for r in sorted(rows, key=lambda r: (-r[7], r[2])):
        if all(geometry.iou_py(as_dict(r), as_dict(k)) <= 0.5 for k in kept):
            kept.append(r)
    got = geometry.nms(spark.createDataFrame(rows, BOXES)).collect()
    assert sorted(r["box_id"] for r in got) == sorted(r[2] for r in kept)
    pairs = {(r["left_id"], r["right_id"]): r["iou"] for r in geometry.overlapping(spark.createDataFrame(rows, BOXES), 16).collect()}
    loop = {(a[2], b[2]): v for a in rows for b in rows if a[2] < b[2] and (v := geometry.iou_py(as_dict(a), as_dict(b))) > 0}
    assert pairs == pytest.approx(loop)


def test_quartiles(spark):
    df = spark.createDataFrame([box(i, 0, 0, w, 10, 0.9) for i, w in enumerate([10, 12, 14, 20])], BOXES)
    r = geometry.size_stats(df).first()
    assert (r["q1_width"], r["q2_width"], r["q3_width"]) == (12, 14, 20)


def test_proximity_filter(spark):
    rows = [box(i, 100 * (i // 2), 3 * (i % 2), 20, 20, 0.9 - i / 100) for i in range(8)]
    assert sorted(r["box_id"] for r in geometry.proximity_filter(spark.createDataFrame(rows, BOXES)).collect()) == [0, 2, 4, 6]


def test_error_markers(spark):
    df = spark.createDataFrame([("t", 1, 0, 0, "a", "error!")], "table_id string, page int, row_idx int, col_idx int, col_name string, value string")
    assert tables.error_counts(df).first()["marker_hits"] == 3


def test_stitch_pairs_only(spark):
    t = spark.createDataFrame([("d", f"t{p}", p, 2, 0.5 + p / 10, "m") for p in (1, 2, 3)], "doc_id string, table_id string, page int, n_cols int, confidence double, method string")
    names = t.select("table_id", F.array(F.lit("nom"), F.lit("prix")).alias("names"))
    got = {r["table_id"]: r["part_of"] for r in tables.stitch(t, names).collect()}
    assert got == {"t1": "t1", "t2": "t1", "t3": "t3"}


def test_greedy_merge(spark):
    t = spark.createDataFrame([("d", 1, n, 3, 2, c) for n, c in [("a", 0.9), ("b", 0.8), ("c", 0.7)]], "doc_id string, page int, table_id string, n_rows int, n_cols int, confidence double")
    alike = spark.createDataFrame([("a", "b"), ("b", "c")], ["left_id", "right_id"])
    assert sorted(r["table_id"] for r in tables.merge_by_signature(t, alike).collect()) == ["a", "c"]


def test_row_bands(spark):
    df = spark.createDataFrame([(1, 5, 0), (1, 1, 8), (1, 2, 15), (1, 9, 27)], "doc_id int, x int, y int")
    assert {(r["x"], r["row"]) for r in tables.band_rows(df).collect()} == {(5, 0), (1, 0), (2, 1), (9, 2)}


def test_header_similarity_and_columns(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, tables.header_similarity(arr("nom", "prix"), arr("nom", "prix"))) == 1.0
    assert one(spark, tables.header_similarity(arr("nom"), arr("nom", "prix"))) == 0.0
    assert one(spark, tables.guess_columns(F.lit("a b   c"))) == ["a b", "c"] and one(spark, tables.guess_columns(F.lit("a b"))) == ["a", "b"]
    assert one(spark, tables.page_indexes(F.lit("1,3,5-7"), F.lit(9))) == [0, 2, 4, 5, 6]


def test_rate_limit_case(spark):
    rows = [("ip", i, s) for i, s in enumerate([0, 1, 2, 10, 11])]
    df = spark.createDataFrame(rows, ["ip", "id", "s"]).withColumn("ts", F.timestamp_seconds("s"))
    assert [r["id"] for r in ratelimit.admit(df, "ip", "ts", "id", 2, 10).collect() if not r["accepted"]] == [2]


def test_rate_limit_against_loop(spark):
    rng = random.Random(9)
    rows = [(f"k{rng.randrange(4)}", i, rng.randrange(4000)) for i in range(600)]
    df = spark.createDataFrame(rows, ["ip", "id", "s"]).withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["accepted"] for r in ratelimit.admit(df, "ip", "ts", "id", 3, 60).collect()}
    logs, loop = {}, {}
    for k, i, s in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        log = logs.setdefault(k, [])
        log[:] = [t for t in log if s - t < 60]
        loop[i] = len(log) < 3
        if loop[i]:
            log.append(s)
    assert got == loop


def test_rate_limit_stream(spark, tmp_path):
    rows = [("ip", 1000 + s) for s in [0, 1, 2, 10, 11]]
    spark.createDataFrame(rows, ["ip", "s"]).select("ip", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ip string, ts timestamp").parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    out = metrics.run_available(ratelimit.admit_stream(stream, "ip", "ts", 2, 10), "rate_case")
    assert sorted(r["us"] // 10**6 for r in out.collect() if not r["accepted"]) == [1002]


def test_request_stream_join(spark, tmp_path):
    for name, rows in (("a", [("r1", 1000), ("r2", 1005)]), ("b", [("r1", 1003)])):
        spark.createDataFrame(rows, ["request_id", "s"]).select("request_id", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / name))
    read = lambda n: spark.readStream.schema("request_id string, ts timestamp").parquet(str(tmp_path / n))
    out = metrics.run_available(metrics.join_requests(read("a"), read("b")), "req_case")
    assert [(r["request_id"], r["seconds"]) for r in out.collect()] == [("r1", 3.0)]


def test_batches(spark):
    df = spark.createDataFrame([(1, i, "x") for i in range(23)], ["stream_id", "token_idx", "token"])
    assert [r["n"] for r in batching.batches(df).orderBy("batch").collect()] == [10, 10, 3]
    assert '{"tokens_generated":23}' in [r["data"] for r in batching.events(df).collect()]


def test_cache_ttl(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate([0, 5, 11, 30, 31])], ["k", "id", "s"]).withColumn("ts", F.timestamp_seconds("s"))
    assert [r["hit"] for r in cache.ttl_hits(df, "k", "ts", "id", 10).orderBy("id").collect()] == [False, True, False, False, True]


def test_files_and_export(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ftwo")
    scanned = files.with_kind(files.scan(spark, str(tmp_path / "in"), "*.txt"))
    assert scanned.first()["kind"] == "txt"
    doc = files.document_text(files.decode(scanned, files.plain_text)).first()
    assert doc["n_pages"] == 2 and "=== Page 2 ===\ntwo" in doc["text"]
    cells = spark.createDataFrame([("t", 0, 0, "a", "x<"), ("t", 0, 1, "b", None)], "table_id string, row_idx int, col_idx int, col_name string, value string")
    assert export.markdown_body(cells).first()["body"] == "| x< |  |"
    assert "&lt;" in export.html_body(cells).first()["body"] and export.csv_body(cells).first()["body"] == "x<,"
    export.export(cells, "json", str(tmp_path / "out"))
    assert "x<" in spark.read.text(str(tmp_path / "out")).first()["value"]
    with pytest.raises(ValueError):
        export.export(cells, "doc", str(tmp_path / "no"))
    assert export.mapping_drift(cells, {"table_id": "string", "page": "int"}) == {"page": (None, "int")}
