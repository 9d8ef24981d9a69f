"""Whole-document, label, prompt and cell-source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.catalog import register
from tamis.functions import classify as C
from tamis.functions import labels as L
from tamis.operators import documents as D
from tamis.operators import invoice as I
from tamis.plans.text import asks
from tamis.sources import cells as S
from tamis.sources.tables import table

#: Page statistics of documents, made from part rows: forty pages a document.
_PAGES = "SELECT p_partkey // 40 AS doc_id, p_partkey % 40 AS page, p_partkey * 37 % 6000 AS chars, p_partkey * 37 % 6000 // 6 AS words, p_partkey % 13 AS f, p_partkey * 11 % 45 AS elements, p_partkey % 7 % 3 AS images, p_partkey * 3 % 50 AS lines, p_partkey % 12 AS rects FROM part"


def pages(spark, d):
    base = spark.sql(_PAGES.replace("//", "div").replace("FROM part", "FROM {p}"), p=table(spark, d, "part"))
    return base.withColumns({"fonts": F.when(F.col("f") > 5, F.array(F.concat(F.lit("font"), F.col("f").cast("string")))).otherwise(F.array().cast("array<string>")), "word_variance": F.lit(3.0)})


def _bands(x: str, bands, low: float) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {b} THEN {s}" for b, s in bands) + f" ELSE {low} END"


_CPX = f"""SELECT doc_id, count(*) AS n_pages, round(0.05 * {_bands('count(*)', D.PAGE_BANDS, 0.2)} + 0.15 * {_bands('count(DISTINCT CASE WHEN f > 5 THEN f END)', D.FONT_BANDS, 0.2)} + 0.25 * {_bands('avg(elements)', D.LAYOUT_BANDS, 0.3)}
 + 0.15 * CASE WHEN sum(images) > 0 AND sum(chars) > 0 THEN {_bands('sum(images) / (sum(chars) / 1000.0)', D.IMAGE_BANDS, 0.2)} ELSE 0.0 END + 0.15 * {_bands('avg(chars)', D.TEXT_BANDS, 0.3)} + 0.25 * greatest({_bands('avg(lines)', D.LINE_BANDS, 0.2)}, {_bands('avg(rects)', D.RECT_BANDS, 0.2)}), 6) AS complexity FROM ({_PAGES}) GROUP BY 1"""
_SCORE = "0.5 * avg(CASE WHEN chars < 50 THEN 0.9 ELSE least(1.0, words / 500.0) END) + 0.25 * avg(CASE WHEN f > 5 THEN 0.7 ELSE 0.9 END) + 0.15 * avg(CASE WHEN images > 0 THEN 0.8 ELSE 0.2 END) + 0.1 * avg(least(1.0, lines / 100.0))"
_KIND = f"SELECT doc_id, CASE WHEN s > 0.65 THEN 'scanned' WHEN s < 0.35 THEN 'digital' ELSE 'hybrid' END AS kind, round(CASE WHEN s > 0.65 THEN s WHEN s < 0.35 THEN 1 - s ELSE 0.5 END, 6) AS confidence FROM (SELECT doc_id, {_SCORE} AS s FROM ({_PAGES}) GROUP BY 1)"


@register("document_complexity", _CPX, doubles=("complexity",))
def document_complexity(spark, d):
    return D.complexity(pages(spark, d)).withColumn("complexity", F.round("complexity", 6))


@register("document_kind", _KIND)
def document_kind(spark, d):
    return D.kind(pages(spark, d)).withColumn("confidence", F.round("confidence", 6))


@register("strategy_choice", f"SELECT doc_id, CASE WHEN kind = 'scanned' AND confidence > 0.8 THEN 'ocr' WHEN complexity > 0.6 THEN 'camelot' WHEN complexity < 0.3 THEN 'tabula' ELSE 'hybrid' END AS strategy FROM ({_KIND}) JOIN ({_CPX}) USING (doc_id)")
def strategy_choice(spark, d):
    p = pages(spark, d)
    both = D.kind(p).join(D.complexity(p), "doc_id")
    return both.select("doc_id", D.strategy(F.col("kind"), F.col("confidence"), F.col("complexity"), enhanced=False).alias("strategy"))


@register("strategy_plan", f"""SELECT doc_id, m AS method, w AS weight, round(t * least(2.5, greatest(1.0, complexity * 1.8)), 6) AS seconds FROM ({_KIND}) JOIN ({_CPX}) USING (doc_id) JOIN (VALUES ('scanned', 'ocr', 1.2, 90.0), ('hybrid', 'camelot', 1.1, 30.0), ('hybrid', 'tabula', 0.9, 25.0), ('hybrid', 'pdfplumber', 0.8, 20.0), ('hybrid', 'ocr', 0.7, 60.0),
('digital', 'camelot', 1.1, 25.0), ('digital', 'tabula', 1.0, 20.0), ('digital', 'pdfplumber', 0.8, 15.0)) AS v(k, m, w, t) ON k = kind WHERE NOT (kind = 'hybrid' AND m = 'ocr' AND complexity >= 0.6)""", doubles=("weight", "seconds"))
def strategy_plan(spark, d):
    p = pages(spark, d)
    return D.strategy_plan(D.kind(p).join(D.complexity(p), "doc_id").select("doc_id", "kind", F.round("complexity", 6).alias("complexity"))).withColumn("seconds", F.round("seconds", 6))


@register("prepared_documents")
def prepared_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("CMA_rev"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"), F.lit(" a ").alias("author"), F.lit("2024").alias("created"))
    return D.prepare(docs).select("doc_id", "content", "metadata.revision", F.size("sections").alias("n_sections"), F.element_at("sections", 1)["importance_score"].alias("best"))


_CTX = "CASE p_partkey % 5 WHEN 0 THEN 'Nom_client : Dupont' WHEN 1 THEN '[Adresse] ici' WHEN 2 THEN 'pour le produit ' || p_partkey WHEN 3 THEN '' ELSE 'Montant = 12' END"


@register("field_labels", "SELECT p_partkey AS box_id, CASE p_partkey % 5 WHEN 0 THEN 'nom_client' WHEN 1 THEN 'adresse' WHEN 2 THEN 'pour' WHEN 3 THEN '' ELSE 'montant' END AS label FROM part")
def field_labels(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("box_id"), L.label(F.expr(_CTX)).alias("label"))


@register("nearby_text", """SELECT doc_id, trim(CASE WHEN length(t) > 800 THEN substr(t, 1, 800) || '...' ELSE t END) AS nearby FROM (SELECT doc_id, array_to_string(list_slice(p, greatest(0, i - 2) + 1, least(len(p), i + 3)), chr(10)) AS t FROM (SELECT doc_id, p, least(CAST(floor((doc_id % 1000) / 1000.0 * len(p)) AS BIGINT), len(p) - 1) AS i FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM documents WHERE text <> '')))""")
def nearby_text(spark, d):
    docs = table(spark, d, "documents").filter("text <> ''")
    return docs.select("doc_id", L.nearby_text(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.col("doc_id") % 1000).alias("nearby"))


@register("clarification_texts")
def clarification_texts(spark, d):
    q = F.col("query")
    reason = C.clarification_reason(F.size(C.themes(q)), F.col("confidence"), F.col("doc_id") % 4, C.is_ambiguous(q))
    return asks(spark, d).select("doc_id", reason.alias("reason"), C.clarification_text(reason, C.themes(q), q, C.key_concepts(q), F.array(q)).alias("text"), C.process_suggestions(C.process(q)).alias("suggestions"))


@register("full_prompts")
def full_prompts(spark, d):
    q = F.col("query")
    fam = C.model_family(F.expr("CASE doc_id % 3 WHEN 0 THEN 'mistral' WHEN 1 THEN 't5' ELSE 'llama' END"))
    styles = {"technical": ("Réponse technique", "précis"), "concise": ("Réponse courte", "bref")}
    system = C.system_message("Tamis", C.process_response_type(C.process(q)), fam, F.expr("DATE '2024-01-31'"), styles=styles)
    return asks(spark, d).select("doc_id", C.chat_prompt(system, F.lit("contexte"), F.array(F.lit("[INST] a [/INST]b")), q, fam).alias("prompt"))


@register("cells_from_json", "SELECT 'N' || n_regionkey AS table_id, CAST(k AS INTEGER) AS row_idx, c AS col_name, CASE c WHEN 'name' THEN n_name ELSE CAST(n_nationkey AS VARCHAR) END AS value FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation), (VALUES ('key'), ('name')) AS v(c)")
def cells_from_json(spark, d):
    t = table(spark, d, "nation").groupBy(F.concat(F.lit("N"), F.col("n_regionkey").cast("string")).alias("table_id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))))).alias("json"))
    return S.from_json_records(t.withColumn("page", F.lit(1))).select("table_id", "row_idx", "col_name", "value")


@register("cells_from_csv", "SELECT 'C' || c_custkey AS table_id, 0 AS row_idx, v.i AS col_idx, v.n AS col_name, CASE v.i WHEN 0 THEN c_name WHEN 1 THEN 'a, \"b\"' ELSE c_mktsegment END AS value FROM customer, (VALUES (0, 'name'), (1, 'note'), (2, 'segment')) AS v(i, n)")
def cells_from_csv(spark, d):
    t = table(spark, d, "customer").select(F.expr("'C' || c_custkey").alias("table_id"), F.lit(1).alias("page"), F.concat(F.lit("name,note,segment\n"), "c_name", F.lit(',"a, ""b""",'), "c_mktsegment").alias("text"))
    return S.from_csv_text(t).select("table_id", "row_idx", "col_idx", "col_name", "value")


@register("cells_from_html", "SELECT c_custkey || '/0' AS table_id, 0 AS row_idx, v.i AS col_idx, v.n AS col_name, CASE v.i WHEN 0 THEN c_name ELSE c_mktsegment END AS value FROM customer, (VALUES (0, 'Name'), (1, 'Segment')) AS v(i, n)")
def cells_from_html(spark, d):
    html = F.concat(F.lit("<p>x</p><table class='a'><tr><th>Name</th><th>Segment</th></tr><tr><td><b>"), "c_name", F.lit("</b></td><td>\n"), "c_mktsegment", F.lit("</td></tr></table>"))
    return S.from_html(table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), html.alias("html"))).select("table_id", "row_idx", "col_idx", "col_name", "value")


@register("section_lookup", "SELECT n_regionkey AS section, CAST(rn - 1 AS BIGINT) AS place, n_nationkey AS id, n_name AS label FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation)")
def section_lookup(spark, d):
    n = table(spark, d, "nation")
    lists = n.groupBy(F.col("n_regionkey").alias("section")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("ids"))
    boxes = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit(0).alias("position")).unionByName(n.select(F.col("n_nationkey").alias("id"), F.lit("later").alias("label"), F.lit(1).alias("position")))
    return I.section_boxes(lists, boxes).withColumn("place", F.col("place").cast("long"))


@register("technical_counts", "SELECT 'Q' || (p_partkey // 50) AS doc_id, count(*) AS products, 0::BIGINT AS services, 0::BIGINT AS options FROM part GROUP BY 1")
def technical_counts(spark, d):
    c = table(spark, d, "part").select(F.expr("'Q' || (p_partkey div 50)").alias("doc_id"), F.expr("'P' || (p_partkey div 50)").alias("table_id"), F.expr("CAST(p_partkey % 50 AS INT)").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("Référence").alias("col_name"), F.col("p_name").alias("value"))
    return I.kind_counts(c)


@register("form_maps", "SELECT 'Q' || (p_partkey // 50) AS doc_id, count(DISTINCT p_brand) AS n_fields FROM part GROUP BY 1")
def form_maps(spark, d):
    c = table(spark, d, "part").select(F.expr("'Q' || (p_partkey div 50)").alias("doc_id"), F.lit("t").alias("table_id"), F.col("p_partkey").alias("row_idx"), I.normalise_key(F.col("p_brand")).alias("key"), F.col("p_name").alias("value"))
    return I.form_map(c).select("doc_id", F.size("fields").cast("long").alias("n_fields"))
