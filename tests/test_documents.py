"""Cell sources, labels, strategy choice and kept search results."""

from pyspark.sql import functions as F

from tamis.functions import classify, labels
from tamis.operators import documents, invoice
from tamis.operators.search_session import SearchSession
from tamis.sources import cells


def test_sources_round_trip(spark):
    t = spark.createDataFrame([("t", 1, '[{"a":"1","b":"x"},{"a":null,"b":"y"}]')], ["table_id", "page", "json"])
    c = cells.from_json_records(t)
    assert [(r["row_idx"], r["col_name"], r["value"]) for r in c.orderBy("row_idx", "col_idx").collect()] == [(0, "a", "1"), (0, "b", "x"), (1, "a", None), (1, "b", "y")]
    back = cells.from_json_records(cells.to_records(c).withColumn("page", F.lit(1)))
    assert sorted(map(str, back.select("row_idx", "col_name", "value").collect())) == sorted(map(str, c.select("row_idx", "col_name", "value").collect()))


def test_csv_quotes(spark):
    t = spark.createDataFrame([("t", 1, 'a;b\n"x; ""y""";\n')], ["table_id", "page", "text"])
    assert [(r["col_name"], r["value"]) for r in cells.from_csv_text(t, separator=";").orderBy("col_idx").collect()] == [("a", 'x; "y"'), ("b", None)]


def test_html_without_header(spark):
    t = spark.createDataFrame([(1, "<table><tr><td>a</td><td>b</td></tr></table><p>no table</p>"), (2, "none")], ["doc_id", "html"])
    assert [(r["col_name"], r["value"]) for r in cells.from_html(t).orderBy("col_idx").collect()] == [("Col_1", "a"), ("Col_2", "b")]


def test_labels(spark):
    df = spark.createDataFrame([("Date_livraison : demain",), ("",), ("!!",), ("12 34",)], ["t"])
    got = [tuple(r) for r in df.select(labels.label(F.col("t")), labels.field_name(F.col("t"))).collect()]
    assert got[0] == ("date_livraison", "date_livraison") and got[1] == ("", "") and got[2][0].startswith("checkbox_") and got[3][1].startswith("checkbox_")


def test_nearby_text(spark):
    df = spark.createDataFrame([("\n\n".join(f"p{i}" for i in range(10)), 500)], ["t", "y"])
    assert df.select(labels.nearby_text(F.col("t"), F.col("y"))).first()[0] == "p3\np4\np5\np6\np7"


def test_strategy(spark):
    df = spark.createDataFrame([("scanned", 0.9, 0.5), ("digital", 0.5, 0.7), ("digital", 0.5, 0.2), ("hybrid", 0.5, 0.5)], ["k", "s", "c"])
    pick = lambda **o: [r[0] for r in df.select(documents.strategy(F.col("k"), F.col("s"), F.col("c"), **o)).collect()]
    assert pick() == ["enhanced", "enhanced", "tabula", "enhanced"] and pick(enhanced=False) == ["ocr", "camelot", "tabula", "hybrid"]
    assert pick(enhanced=False, detector=True)[-1] == "ai"


def test_prompt_parts(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(
        classify.clarification_text(F.lit("multiple_themes"), a("A", "B"), F.lit(""), a("c"), a("d")).alias("t"),
        classify.chat_prompt(F.lit("sys"), F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit("q"), F.lit("t5")).alias("p"),
        classify.answer(F.lit("  "), F.array().cast("array<string>"), F.lit(None).cast("double"), F.lit(3)).alias("a"),
    ).first()
    assert "- A\n- B" in row["t"] and row["p"] == "system: sys\nquestion: q" and row["a"]["response"] == classify.EMPTY_ANSWER


def test_search_session(spark):
    now, calls = [0.0], []

    def search(q, **params):
        calls.append((q, params))
        return spark.createDataFrame([(q, i) for i in range(1, 6)], ["q", "rank"])

    s = SearchSession(search, most=2, ttl=10, clock=lambda: now[0])
    assert s.results("a", 2).count() == 2 and s.results("a", 4).count() == 4 and len(calls) == 1
    s.results("a", 1, lang="fr")
    assert len(calls) == 2  # other parameters are another search
    s.results("b", 1)
    s.results("a", 1)
    assert len(calls) == 4  # the oldest was dropped
    now[0] = 11
    s.results("b", 1)
    assert len(calls) == 5 and s.hit_rate() == round(100 / 6, 2)


def test_type_scores():
    assert set(invoice.document_type_scores().values()) == {0.25}


def test_flatten_and_results(spark):
    df = spark.createDataFrame([([1, 2], {"a": 1})], "x array<int>, m map<string,int>").withColumn("t", F.expr("TIMESTAMP '2024-01-02 03:04:05'"))
    from tamis.sources import export

    assert tuple(export.flatten(df).first()) == ("[1,2]", '{"a":1}', "2024-01-02 03:04:05")
    c = spark.createDataFrame([("t", 0, 0, "a", "x")], "table_id string, row_idx int, col_idx int, col_name string, value string")
    assert export.result(c, "raw") is c and export.result(c, "html").count() == 1 and export.result(c, "records").count() == 1


def test_table_process(spark):
    from tamis.operators import tables

    rows = [("t", 1, r, c, n, v) for r, vals in enumerate([("x", "1"), ("y", "2"), ("x", "1")]) for c, (n, v) in enumerate(zip(("a!", "b"), vals))]
    rows.append(("small", 1, 0, 0, "a", "v"))
    got = tables.process(spark.createDataFrame(rows, "table_id string, page int, row_idx int, col_idx int, col_name string, value string"))
    assert sorted((r["table_id"], r["row_idx"], r["col_name"], r["value"]) for r in got.collect()) == [("t", 0, "a", "x"), ("t", 0, "b", "1"), ("t", 1, "a", "y"), ("t", 1, "b", "2")]
