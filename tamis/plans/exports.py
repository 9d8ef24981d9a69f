"""Export types and archives, detections, session contexts, change stamps and further table comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.catalog import register
from tamis.operators import geometry as G
from tamis.operators import history as H
from tamis.operators import invoice as I
from tamis.operators import tables as X
from tamis.plans import history as P
from tamis.plans.tables import _B, _C, _NUM, _PAIRS, _SHAPE, _SIM, boxes, cells, neighbours
from tamis.sources import export as E
from tamis.sources.tables import table

_INTS = "CASE " + " ".join(f"WHEN low >= {-(2 ** (b - 1))} AND high < {2 ** (b - 1)} THEN 'int{b}'" for b in (8, 16, 32)) + " ELSE 'int64' END"


@register("export_types", _C + f""", n AS (SELECT table_id, count(DISTINCT row_idx) AS n_rows FROM c WHERE value IS NOT NULL GROUP BY 1),
g AS (SELECT table_id, col_idx, count({_NUM}) AS numbers, count(DISTINCT value) AS different, count(*) FILTER (WHERE {_NUM} % 1 = 0) AS whole, min({_NUM}) AS low, max({_NUM}) AS high FROM c GROUP BY 1, 2 HAVING count(value) > 0)
SELECT table_id, col_idx, CASE WHEN numbers = n_rows THEN CASE WHEN whole = n_rows THEN {_INTS} ELSE 'float' END WHEN different < 0.5 * n_rows THEN 'category' ELSE 'text' END AS type FROM g JOIN n USING (table_id)""")
def export_types(spark, d):
    return X.export_types(cells(spark, d))


@register("csv_zip_entries", """WITH t AS (SELECT DISTINCT p_partkey // 20 AS k FROM part), r AS (SELECT p_partkey // 20 AS k, count(DISTINCT p_partkey % 20) AS n FROM part GROUP BY 1),
o AS (SELECT 'D' || (k // 4) AS doc_id, n, row_number() OVER (PARTITION BY k // 4 ORDER BY 'T' || k) AS i FROM r)
SELECT doc_id, 'table_' || i || '.csv' AS name, n + 1 AS n_lines FROM o UNION ALL SELECT DISTINCT doc_id, 'README.txt', 5 FROM o""")
def csv_zip_entries(spark, d):
    """A ZIP of CSV files per document of four tables, listed from its bytes."""
    rows = cells(spark, d).withColumn("doc_id", F.expr("'D' || (CAST(substr(table_id, 2) AS BIGINT) div 4)"))
    return E.zip_entries(E.csv_zips(rows))


@register("detection_topk", _B + "SELECT doc_id, page, box_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY confidence DESC, box_id) AS rn FROM b) WHERE rn <= 10")
def detection_topk(spark, d):
    return G.detection_top_k(boxes(spark, d)).select("doc_id", "page", "box_id")


@register("detected_tables")
def detected_tables(spark, d):
    """The most confident detections of a page, then suppression among them."""
    return G.nms(G.detection_top_k(boxes(spark, d))).select("doc_id", "page", "box_id")


_TURNS = "SELECT conv_id, turn, text AS query, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations"


@register("session_context_update", f"""WITH p AS (SELECT conv_id, turn, query, response, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM ({_TURNS}) WHERE role = 'user' AND next_role = 'assistant')
SELECT conv_id AS session_id, least(5, count(*)) AS total_interactions, arg_min(md5(query), back) AS last_query, arg_max(md5(response), back) FILTER (WHERE back <= 5) AS first_response,
'web' AS origin, CASE WHEN conv_id % 2 = 0 THEN 'answered' ELSE 'open' END AS state FROM p GROUP BY conv_id""")
def session_context_update(spark, d):
    """Contexts of up to five earlier pairs take the conversation's last pair and metadata."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w), "response": F.lead("text").over(w)}).filter("role = 'user' and next_role = 'assistant'")
    pairs = H.last_n(rows, "conv_id", ["turn"], H.KEPT_PAIRS + 1)
    now = F.expr(P.NOW)
    held = F.array_sort(F.collect_list(F.when(F.col("from_end") > 1, F.struct("turn", F.col("text").alias("query"), "response"))))  # five at most
    contexts = pairs.groupBy(F.col("conv_id").alias("session_id")).agg(held.alias("h")).select("session_id", F.transform("h", lambda x: F.struct(x["query"].alias("query"), x["response"].alias("response"), F.expr(P.NOW).alias("timestamp"))).alias("history"), F.create_map(F.lit("origin"), F.lit("web"), F.lit("state"), F.lit("open")).alias("metadata"))
    state = F.when(F.col("conv_id") % 2 == 0, F.create_map(F.lit("state"), F.lit("answered")))
    changes = pairs.filter("from_end = 1").select(F.col("conv_id").alias("session_id"), F.col("text").alias("query"), "response", state.alias("metadata"))
    out = H.update_contexts(contexts, changes, now)
    return out.select("session_id", F.col("total_interactions").cast("long").alias("total_interactions"), F.md5(F.element_at("history", -1)["query"]).alias("last_query"), F.md5(F.element_at("history", 1)["response"]).alias("first_response"), F.col("metadata")["origin"].alias("origin"), F.col("metadata")["state"].alias("state"))


@register("updated_at_stamps", f"SELECT o_orderkey AS session_id, o_orderstatus = 'O' AND o_orderkey % 3 <> 0 AS is_active, strftime(CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN {P.NOW} ELSE o_orderdate END, '%Y-%m-%d') AS updated FROM orders")
def updated_at_stamps(spark, d):
    """Every third session is closed; only those that were open change, and take the new time."""
    old = P.sessions(spark, d).select("session_id", "is_active", "updated_at")
    new = old.withColumn("is_active", F.col("is_active") & (F.col("session_id") % 3 != 0))
    return H.stamped(old, new, "session_id", F.expr(P.NOW)).select("session_id", "is_active", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@register("string_similarity", "SELECT p_partkey AS part_id, len(list_filter(string_split(p_name, ''), lambda c: c <> '' AND contains(p_type, c))) / greatest(length(p_name), length(p_type), 1) AS share FROM part")
def string_similarity(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), X.string_similarity(F.col("p_name"), F.col("p_type")).alias("share"))


_FUZZY = _SIM.replace("CASE WHEN x = '' AND y = ''", "CASE WHEN x = y THEN true WHEN x = '' AND y = ''", 1)


@register("fuzzy_table_similarity", _C + f""", {_SHAPE}, {_PAIRS}, v AS (SELECT left_id, right_id, lower(trim(coalesce(a.value, ''))) AS x, lower(trim(coalesce(b.value, ''))) AS y FROM p JOIN s l ON l.table_id = left_id JOIN s r ON r.table_id = right_id AND l.n_rows = r.n_rows AND l.n_cols = r.n_cols
JOIN c a ON a.table_id = left_id JOIN c b ON b.table_id = right_id AND b.row_idx = a.row_idx AND b.col_name = a.col_name) SELECT left_id, right_id, round(count(*) FILTER (WHERE {_FUZZY}) / count(*), 6) AS similarity FROM v GROUP BY 1, 2""")
def fuzzy_table_similarity(spark, d):
    return X.similarity(cells(spark, d), neighbours(spark, d), fuzzy=True).withColumn("similarity", F.round("similarity", 6))


@register("client_info", "SELECT 'K' || c_custkey AS table_id, f AS field, CASE f WHEN 'name' THEN c_name WHEN 'address' THEN c_nationkey || ' rue' WHEN 'phone' THEN coalesce(CASE WHEN c_custkey % 3 <> 0 THEN '0' || c_custkey END, '') ELSE c_mktsegment END AS value FROM customer, (VALUES ('name'), ('address'), ('phone'), ('Segment')) AS v(f)")
def client_info(spark, d):
    fields = [("Nom complet", "c_name"), ("Adresse", "c_nationkey || ' rue'"), ("Téléphone", "CASE WHEN c_custkey % 3 <> 0 THEN '0' || c_custkey END"), ("Segment", "c_mktsegment")]
    made = F.array(*(F.struct(F.lit(i).alias("col_idx"), F.lit(n).alias("col_name"), F.expr(f"CAST({v} AS STRING)").alias("value")) for i, (n, v) in enumerate(fields)))
    return I.client_info(table(spark, d, "customer").select(F.expr("'K' || c_custkey").alias("table_id"), F.lit(0).alias("row_idx"), F.inline(made)))


@register("region_merge")
def region_merge(spark, d):
    """Tables whose regions overlap and whose cells are alike: the more confident one of each pair stays."""
    t = X.shape(cells(spark, d)).select("table_id", F.lit("doc").alias("doc_id"), F.expr("CAST(substr(table_id, 2) AS INT) div 4").cast("int").alias("page"), F.expr("CAST(substr(table_id, 2) AS INT) % 4 * 4").alias("x"), F.lit(0).alias("y"), F.lit(20).alias("width"), F.lit(10).alias("height"), (F.col("n_cells") / 130 + F.expr("CAST(substr(table_id, 2) AS INT) % 3")).alias("confidence"))
    alike = X.similarity(cells(spark, d), neighbours(spark, d)).filter("similarity > 0.08")
    return X.merge_by_region(t, alike)
