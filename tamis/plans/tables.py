"""Table, invoice and geometry queries over cells and boxes derived from part, nation and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.catalog import register
from tamis.operators import geometry as G
from tamis.operators import invoice as I
from tamis.operators import tables as X
from tamis.sources.tables import table

#: Twenty parts make a table; nulls, errors, repeated rows and outliers come by modulus, the same in both engines.
_COLS = [
    (0, "'Name'", "CASE WHEN p_partkey % 11 <> 0 THEN p_name END"),
    (1, "'Brand !'", "CASE WHEN p_partkey % 13 = 0 THEN '#REF!' WHEN p_partkey % 17 = 0 THEN 'error' ELSE p_brand END"),
    (2, "'Size'", "CASE WHEN p_partkey % 10 = 0 THEN 'n/a' ELSE CAST(p_size AS {s}) END"),
    (3, "'Prix (cents)'", "CAST(CAST(round(p_retailprice * 100) AS BIGINT) * CASE WHEN p_partkey % 19 = 0 THEN 100000 ELSE 1 END AS {s})"),
    (4, "'Note'", "CASE WHEN p_partkey % 3 = 0 THEN '  ' || p_type || ' ' END"),
    (5, "'Note'", "CASE WHEN p_partkey % 3 <> 0 THEN p_type END"),
]
_SQL_CELLS = " UNION ALL ".join(
    f"SELECT 'T' || (p_partkey // 20) AS table_id, CAST(1 + (p_partkey // 20) % 3 AS INTEGER) AS page, CAST(p_partkey % 20 AS INTEGER) AS row_idx, {i} AS col_idx, {n} AS col_name, {v.format(s='VARCHAR')} AS value FROM part" for i, n, v in _COLS
)
_C = f"WITH c AS ({_SQL_CELLS}) "
_NUM = "TRY_CAST(trim(value) AS DOUBLE)"
_LOW = "lower(coalesce(value, 'nan'))"
_MARKERS = " + ".join(f"CASE WHEN contains({_LOW}, '{m}') THEN 1 ELSE 0 END" for m in X.ERROR_MARKERS)
_ERR = f"e AS (SELECT table_id, CAST(sum(m) AS BIGINT) AS marker_hits, CAST(sum(o) AS BIGINT) AS odd_cells FROM (SELECT table_id, {_MARKERS} AS m, CASE WHEN value IS NOT NULL AND {_NUM} IS NULL AND count({_NUM}) OVER w > 0.7 * count(*) OVER w THEN 1 ELSE 0 END AS o FROM c WINDOW w AS (PARTITION BY table_id, col_idx)) GROUP BY 1)"
_SHAPE = "s AS (SELECT table_id, count(DISTINCT row_idx) AS n_rows, count(DISTINCT col_idx) AS n_cols, count(*) AS n_cells, count(*) FILTER (WHERE value IS NULL) AS n_null FROM c GROUP BY 1)"


def cells(spark, d):
    rows = table(spark, d, "part")
    fields = F.array(*(F.struct(F.lit(i).alias("col_idx"), F.expr(n).alias("col_name"), F.expr(v.format(s="STRING")).alias("value")) for i, n, v in _COLS))
    base = rows.select(F.expr("'T' || (p_partkey div 20)").alias("table_id"), F.expr("CAST(1 + (p_partkey div 20) % 3 AS INT)").alias("page"), F.expr("CAST(p_partkey % 20 AS INT)").alias("row_idx"), F.inline(fields))
    return base


@register("cells_validate", _C + f", {_SHAPE}, {_ERR} SELECT table_id, n_rows, n_cols, round(n_null / n_cells, 6) AS empty_ratio, round((marker_hits + odd_cells) / n_cells, 6) AS error_ratio, n_rows >= 2 AND n_cols >= 2 AS structure_ok, n_null / n_cells <= 0.7 AND (marker_hits + odd_cells) / n_cells <= 0.3 AS content_ok, n_rows >= 2 AND n_cols >= 2 AND n_null / n_cells <= 0.7 AND (marker_hits + odd_cells) / n_cells <= 0.3 AS valid FROM s JOIN e USING (table_id)")
def cells_validate(spark, d):
    v = X.verdicts(cells(spark, d))
    return v.withColumns({"empty_ratio": F.round("empty_ratio", 6), "error_ratio": F.round("error_ratio", 6)})


@register("error_cells", _C + f", {_ERR} SELECT * FROM e")
def error_cells(spark, d):
    return X.error_counts(cells(spark, d))


_NULLED = "n AS (SELECT * EXCLUDE value, CASE WHEN value NOT IN (" + ", ".join(f"'{v}'" for v in X.ERROR_VALUES) + ") THEN value END AS value FROM c), f AS (SELECT table_id, page, row_idx, col_idx, col_name, count(" + _NUM + ") OVER w > 0.7 * count(*) OVER w AS numeric, value FROM n WINDOW w AS (PARTITION BY table_id, col_idx)), g AS (SELECT * REPLACE (CASE WHEN NOT numeric OR " + _NUM + " IS NOT NULL THEN value END AS value) FROM f)"


@register("error_values_to_null", _C + f", {_NULLED} SELECT table_id, row_idx, col_idx, value FROM g")
def error_values_to_null(spark, d):
    return X.errors_to_null(cells(spark, d)).select("table_id", "row_idx", "col_idx", "value")


@register("outlier_fences", _C + f", {_NULLED} SELECT table_id, col_idx, round(q1 - 3 * (q9 - q1), 4) AS low, round(q9 + 3 * (q9 - q1), 4) AS high FROM (SELECT table_id, col_idx, quantile_cont({_NUM}, 0.1) AS q1, quantile_cont({_NUM}, 0.9) AS q9 FROM g WHERE numeric GROUP BY 1, 2)")
def outlier_fences(spark, d):
    return X.fences(X.errors_to_null(cells(spark, d))).select("table_id", "col_idx", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


_DUP = "r AS (SELECT 'D' || (l_orderkey % 50) AS table_id, CAST(l_orderkey // 50 * 10 + l_linenumber AS INTEGER) AS row_idx, min(l_returnflag) AS a, CASE WHEN l_linenumber % 2 = 0 THEN min(l_returnflag) ELSE min(l_linestatus) END AS b, CAST(l_linenumber AS VARCHAR) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def line_cells(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("s"))
    rows = rows.withColumn("l_linestatus", F.expr("CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE s END"))
    rows = rows.select(F.expr("'D' || (l_orderkey % 50)").alias("table_id"), F.lit(1).alias("page"), F.expr("CAST(l_orderkey div 50 * 10 + l_linenumber AS INT)").alias("row_idx"),
        F.inline(F.array(*(F.struct(F.lit(i).alias("col_idx"), F.lit(n).alias("col_name"), F.col(c).cast("string").alias("value")) for i, (n, c) in enumerate([("flag", "l_returnflag"), ("status", "l_linestatus"), ("line", "l_linenumber")])))))
    return rows


@register("dup_rows", f"WITH {_DUP} SELECT table_id, min(row_idx) AS row_idx FROM r GROUP BY table_id, a, b, c")
def dup_rows(spark, d):
    return X.drop_repeated_rows(line_cells(spark, d)).select("table_id", "row_idx").distinct()


@register("column_types", _C + f" SELECT table_id, col_idx, CASE WHEN count(value) > 0 AND count({_NUM}) > 0.7 * count(value) THEN CASE WHEN count(*) FILTER (WHERE {_NUM} % 1 = 0) = count(*) THEN 'integer' ELSE 'float' END ELSE 'text' END AS type FROM c GROUP BY 1, 2")
def column_types(spark, d):
    return X.column_types(cells(spark, d)).select("table_id", "col_idx", "type")


@register("date_formats", """SELECT k AS table_id, CASE k WHEN 0 THEN 'dd/MM/yyyy' WHEN 1 THEN 'yyyy-MM-dd' ELSE 'dd.MM.yyyy' END AS date_format, 'date' AS type FROM (SELECT DISTINCT o_orderkey % 3 AS k FROM orders)""")
def date_formats(spark, d):
    v = F.expr("CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE date_format(o_orderdate, 'dd.MM.yyyy') END")
    c = table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("table_id"), F.lit(0).alias("col_idx"), F.when(F.col("o_orderkey") % 10 != 9, v).otherwise("?").alias("value"))
    return X.column_types(c).select("table_id", "date_format", "type")


@register("header_clean", """SELECT 'T' || k AS table_id, i AS col_idx, h AS header FROM (SELECT DISTINCT p_partkey // 20 AS k FROM part), (VALUES (0, 'Name'), (1, 'Brand'), (2, 'Size'), (3, 'Prix cents'), (4, 'Note'), (5, 'Note_1')) AS v(i, h)""")
def header_clean(spark, d):
    return X.clean_headers(cells(spark, d).select("table_id", "col_idx", "col_name").distinct()).select("table_id", "col_idx", "header")


@register("value_clean", _C + " SELECT table_id, row_idx, col_idx, CASE WHEN trim(value) <> '' AND trim(value) NOT IN ('n/a', 'na', 'none', 'null', '-', '--') THEN trim(value) END AS value FROM c")
def value_clean(spark, d):
    return X.clean_values(cells(spark, d)).select("table_id", "row_idx", "col_idx", "value")


@register("complement_pairs", _C + " SELECT a.table_id, a.col_idx AS left_col, b.col_idx AS right_col, round(count(*) FILTER (WHERE a.value IS NULL AND b.value IS NULL) / count(*), 6) AS both_empty, round(count(*) FILTER (WHERE (a.value IS NULL) <> (b.value IS NULL)) / count(*), 6) AS complementary FROM c a JOIN c b ON a.table_id = b.table_id AND a.row_idx = b.row_idx AND a.col_idx < b.col_idx GROUP BY 1, 2, 3")
def complement_pairs(spark, d):
    p = X.column_pairs(cells(spark, d))
    return p.withColumns({"both_empty": F.round("both_empty", 6), "complementary": F.round("complementary", 6)})


@register("merge_fragments", _C + """, p AS (SELECT DISTINCT a.table_id FROM c a) SELECT table_id, row_idx, col_idx, value FROM (SELECT table_id, row_idx, CASE WHEN col_idx = 5 THEN 4 ELSE col_idx END AS col_idx, max(value) AS value FROM c WHERE col_idx IN (0, 1, 2, 3) OR value IS NOT NULL GROUP BY 1, 2, 3)""")
def merge_fragments(spark, d):
    return X.merge_fragments(cells(spark, d)).select("table_id", "row_idx", "col_idx", "value")


@register("base_clean", _C + " SELECT table_id, row_idx, col_idx, nullif(trim(value), '') AS value FROM c WHERE col_idx < 6")
def base_clean(spark, d):
    return X.drop_empty(cells(spark, d)).select("table_id", "row_idx", "col_idx", "value")


@register("header_test", _C + " SELECT table_id, coalesce(avg(CASE WHEN row_idx = 0 THEN dg END) < 0.5 * avg(CASE WHEN row_idx > 0 THEN dg END), false) AS is_header FROM (SELECT table_id, row_idx, CASE WHEN regexp_full_match(replace(value, '.', ''), '[0-9]+') THEN 1 ELSE 0 END AS dg FROM c WHERE row_idx <= 5) GROUP BY 1")
def header_test(spark, d):
    return X.is_header(cells(spark, d))


@register("table_cell_search", _C + " SELECT table_id, page, row_idx, col_idx, col_name, value FROM c WHERE contains(lower(value), 'steel')")
def table_cell_search(spark, d):
    return X.search(cells(spark, d), "STEEL")


@register("table_profile_rollup", _C + f", {_SHAPE} SELECT table_id, n_rows, n_cols, n_cells, round(100.0 * n_null / n_cells, 2) AS null_pct FROM s UNION ALL SELECT NULL, sum(n_rows)::BIGINT, sum(n_cols)::BIGINT, sum(n_cells)::BIGINT, round(100.0 * sum(n_null) / sum(n_cells), 2) FROM s")
def table_profile_rollup(spark, d):
    return X.profile(cells(spark, d))


@register("numeric_column_profile", _C + f" SELECT table_id, col_name, count({_NUM}) AS numbers, min({_NUM}) AS least, max({_NUM}) AS most, round(avg({_NUM}), 4) AS mean, median({_NUM}) AS median FROM c GROUP BY 1, 2 HAVING count({_NUM}) = count(value) AND count(value) > 0")
def numeric_column_profile(spark, d):
    return X.numeric_profile(cells(spark, d)).withColumn("mean", F.round("mean", 4))


_PAIRS = "p AS (SELECT 'T' || k AS left_id, 'T' || (k + 1) AS right_id FROM (SELECT DISTINCT p_partkey // 20 AS k FROM part))"


def neighbours(spark, d):
    k = table(spark, d, "part").select(F.expr("p_partkey div 20").alias("k")).distinct()
    return k.select(F.expr("'T' || k").alias("left_id"), F.expr("'T' || (k + 1)").alias("right_id"))


@register("table_similarity", _C + f", {_SHAPE}, {_PAIRS} SELECT left_id, right_id, round(count(*) FILTER (WHERE coalesce(a.value, 'nan') = coalesce(b.value, 'nan')) / count(*), 6) AS similarity FROM p JOIN s l ON l.table_id = left_id JOIN s r ON r.table_id = right_id AND l.n_rows = r.n_rows AND l.n_cols = r.n_cols JOIN c a ON a.table_id = left_id JOIN c b ON b.table_id = right_id AND a.row_idx = b.row_idx AND a.col_idx = b.col_idx GROUP BY 1, 2")
def table_similarity(spark, d):
    return X.similarity(cells(spark, d), neighbours(spark, d)).withColumn("similarity", F.round("similarity", 6))


_SIM = """CASE WHEN x = '' AND y = '' THEN true WHEN x = '' OR y = '' THEN false WHEN contains(x, y) OR contains(y, x) THEN true WHEN greatest(length(x), length(y)) / least(length(x), length(y)) > 2 THEN false
ELSE len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(y, '')))) / greatest(len(list_distinct(string_split(x, ''))), len(list_distinct(string_split(y, '')))) >= 0.85 END"""


@register("near_equal_strings", f"SELECT a.p_partkey AS part_id, {_SIM} AS alike FROM (SELECT p_partkey, lower(p_name) AS x FROM part) a JOIN (SELECT p_partkey, lower(p_name) AS y FROM part) b ON b.p_partkey = a.p_partkey + 1")
def near_equal_strings(spark, d):
    p = table(spark, d, "part")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.lower("p_name").alias("y"))
    return p.join(b, "p_partkey").select(F.col("p_partkey").alias("part_id"), X.nearly_equal(F.lower("p_name"), F.col("y")).alias("alike"))


_TABLES = "t AS (SELECT 'O' || o_orderkey AS table_id, 'doc' || (o_custkey % 100) AS doc_id, CAST(1 + o_orderkey % 3 AS INTEGER) AS page, (o_orderkey % 97) / 100.0 AS confidence FROM orders)"


def extracted(spark, d):
    return table(spark, d, "orders").select(F.expr("'O' || o_orderkey").alias("table_id"), F.expr("'doc' || (o_custkey % 100)").alias("doc_id"), F.expr("CAST(1 + o_orderkey % 3 AS INT)").alias("page"), F.expr("(o_orderkey % 97) / 100.0D").alias("confidence"))


@register("tables_per_page_cap", f"WITH {_TABLES} SELECT doc_id, page, table_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY confidence DESC, table_id) AS rn FROM t) WHERE rn <= 5")
def tables_per_page_cap(spark, d):
    return X.cap_per_page(extracted(spark, d)).select("doc_id", "page", "table_id")


@register("strategy_weighting", f"WITH {_TABLES} SELECT table_id, round(confidence * CASE page WHEN 1 THEN 0.9 WHEN 2 THEN 1.2 ELSE 1.0 END, 6) AS confidence, round(least(greatest(confidence * 1.8, 1.0), 2.5), 6) AS timeout_factor FROM t")
def strategy_weighting(spark, d):
    t = extracted(spark, d).withColumn("method", F.expr("CASE page WHEN 1 THEN 'stream' WHEN 2 THEN 'lattice' ELSE 'ocr' END"))
    weighed = X.weigh(t.withColumn("f", X.timeout_factor(F.col("confidence"))), {"stream": 0.9, "lattice": 1.2})
    return weighed.select("table_id", F.round("confidence", 6).alias("confidence"), F.round("f", 6).alias("timeout_factor"))


@register("fallback_chain", f"WITH {_TABLES} SELECT table_id, doc_id FROM t WHERE confidence > 0.9 UNION ALL SELECT table_id, doc_id FROM t WHERE confidence < 0.2 AND doc_id NOT IN (SELECT doc_id FROM t WHERE confidence > 0.9)")
def fallback_chain(spark, d):
    t = extracted(spark, d).select("table_id", "doc_id", "confidence")
    return X.fall_back(t.filter("confidence > 0.9"), t.filter("confidence < 0.2")).select("table_id", "doc_id")


@register("separator_vote", "SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'whitespace' WHEN a = greatest(a, b, c) THEN '|' WHEN b = greatest(a, b, c) THEN ',' ELSE ';' END AS separator FROM (SELECT doc_id, length(text) - length(replace(text, '|', '')) AS a, length(text) - length(replace(text, ',', '')) AS b, length(text) - length(replace(text, ';', '')) AS c FROM documents)")
def separator_vote(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return X.separator(lines)


@register("ragged_rows", """WITH l AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS row_idx, len(regexp_extract_all(line, '[^ ]+')) AS w FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE trim(line) <> ''),
m AS (SELECT doc_id, w FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, w DESC) AS rn FROM l GROUP BY 1, 2) WHERE rn = 1) SELECT l.doc_id, l.row_idx, CAST(m.w AS BIGINT) AS width FROM l JOIN m USING (doc_id)""")
def ragged_rows(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_idx", "line")).filter(F.trim("line") != "")
    parts = lines.select("doc_id", "row_idx", F.filter(F.split("line", " +"), lambda x: x != "").alias("parts"))
    return X.square_rows(parts).select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), F.size("parts").cast("long").alias("width"))


@register("grid_clusters", "WITH p AS (SELECT p_size AS doc_id, p_partkey % 400 AS v FROM part), g AS (SELECT *, sum(CASE WHEN v - lv > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY v) AS lv FROM p)) SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, CAST(floor(avg(v)) AS BIGINT) AS centre, count(*) AS n FROM g GROUP BY 1, 2")
def grid_clusters(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("doc_id"), (F.col("p_partkey") % 400).alias("v"))
    return X.cluster_lines(p).select("doc_id", F.col("cluster").cast("long").alias("cluster"), "centre", "n")


@register("row_bands")
def row_bands(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("doc_id"), (F.col("p_partkey") % 300).cast("int").alias("x"), (F.col("p_partkey") * 7 % 200).cast("int").alias("y"))
    return X.band_rows(p)


@register("page_ranges", "SELECT o_orderkey AS job_id, array_to_string(CASE o_orderkey % 3 WHEN 0 THEN list_transform(generate_series(0, o_orderkey % 7), lambda x: x) WHEN 1 THEN [0, 2, 4, 5, 6] ELSE [o_orderkey % 9] END, ',') AS pages FROM orders")
def page_ranges(spark, d):
    spec = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN '1,3,5-7' ELSE CAST(o_orderkey % 9 + 1 AS STRING) END")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.array_join(X.page_indexes(spec, (F.col("o_orderkey") % 7 + 1).cast("int")), ",").alias("pages"))


@register("near_duplicate_columns", "WITH " + _DUP + ", x AS (SELECT table_id, count(*) FILTER (WHERE a = b) / count(*) AS ab, count(*) FILTER (WHERE a = c) / count(*) AS ac, count(*) FILTER (WHERE b = c) / count(*) AS bc FROM r GROUP BY 1) SELECT table_id, 0 AS left_col, 1 AS right_col, round(ab, 6) AS share FROM x WHERE ab > 0.1 UNION ALL SELECT table_id, 0, 2, round(ac, 6) FROM x WHERE ac > 0.1 UNION ALL SELECT table_id, 1, 2, round(bc, 6) FROM x WHERE bc > 0.1")
def near_duplicate_columns(spark, d):
    return X.near_duplicate_columns(line_cells(spark, d), 0.1).withColumn("share", F.round("share", 6))


@register("stitch_tables")
def stitch_tables(spark, d):
    t = extracted(spark, d).filter("confidence > 0.5").withColumns({"method": F.lit("stream"), "n_cols": F.lit(3)})
    names = t.select("table_id", F.expr("array('name', 'brand', CASE WHEN page = 2 THEN 'prize' ELSE 'price' END)").alias("names"))
    return X.stitch(t, names)


@register("greedy_table_merge")
def greedy_table_merge(spark, d):
    t = X.shape(cells(spark, d)).select("table_id", F.lit("doc").alias("doc_id"), F.expr("CAST(substr(table_id, 2) AS INT) div 4").cast("int").alias("page"), F.col("n_rows").cast("int").alias("n_rows"), F.col("n_cols").cast("int").alias("n_cols"), (F.col("n_cells") / 130).alias("confidence"))
    alike = X.similarity(cells(spark, d), neighbours(spark, d)).filter("similarity > 0.08")
    return X.merge_by_signature(t, alike)


# invoices: line items of an order are a table, its sums another, its header a third
_LI = "li AS (SELECT 'L' || l_orderkey AS table_id, CAST(l_linenumber - 1 AS INTEGER) AS row_idx, 'part ' || min(l_partkey) AS description, CAST(CAST(min(l_quantity) AS BIGINT) AS VARCHAR) AS q, CAST(CAST(round(min(l_extendedprice)) AS BIGINT) AS VARCHAR) || ',50 €' AS t FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def invoice_cells(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_quantity", "l_extendedprice")))
    items = li.select(F.expr("'L' || l_orderkey").alias("table_id"), F.expr("'F' || l_orderkey").alias("doc_id"), F.expr("CAST(l_linenumber - 1 AS INT)").alias("row_idx"), F.inline(F.array(
        F.struct(F.lit(0).alias("col_idx"), F.lit("Description").alias("col_name"), F.expr("'part ' || l_partkey").alias("value")),
        F.struct(F.lit(1).alias("col_idx"), F.lit("Quantité").alias("col_name"), F.expr("CAST(CAST(l_quantity AS BIGINT) AS STRING)").alias("value")),
        F.struct(F.lit(2).alias("col_idx"), F.lit("Montant").alias("col_name"), F.expr("CAST(CAST(round(l_extendedprice) AS BIGINT) AS STRING) || ',50 €'").alias("value")),
    )))
    o = table(spark, d, "orders")
    head = o.select(F.expr("'H' || o_orderkey").alias("table_id"), F.expr("'F' || o_orderkey").alias("doc_id"), F.lit(0).alias("row_idx"), F.inline(F.array(
        F.struct(F.lit(0).alias("col_idx"), F.lit("Facture n°").alias("col_name"), F.expr("'FA-' || o_orderkey").alias("value")),
        F.struct(F.lit(1).alias("col_idx"), F.lit("Date").alias("col_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value")),
        F.struct(F.lit(2).alias("col_idx"), F.lit("Client").alias("col_name"), F.expr("'C' || o_custkey").alias("value")),
    )))
    sums = o.select(F.expr("'S' || o_orderkey").alias("table_id"), F.expr("'F' || o_orderkey").alias("doc_id"), F.inline(F.array(*(F.struct(F.lit(i).alias("row_idx"), F.lit(lab).alias("lab"), F.expr(v).alias("v")) for i, (lab, v) in enumerate(
        [("Total HT", "CAST(CAST(o_totalprice AS BIGINT) AS STRING) || '.00'"), ("TVA 20%", "CAST(CAST(o_totalprice AS BIGINT) div 5 AS STRING) || ',00'"), ("Total TTC", "CAST(CAST(o_totalprice AS BIGINT) * 6 div 5 AS STRING) || '.25'")])))))
    sums = sums.select("table_id", "doc_id", "row_idx", F.inline(F.array(F.struct(F.lit(0).alias("col_idx"), F.lit("Libellé TTC").alias("col_name"), F.lit("").alias("value")), F.struct(F.lit(1).alias("col_idx"), F.lit("Libre").alias("col_name"), F.col("lab").alias("value")), F.struct(F.lit(2).alias("col_idx"), F.lit("Valeur").alias("col_name"), F.col("v").alias("value")))))
    return items.unionByName(head).unionByName(sums)


@register("invoice_line_items", f"WITH {_LI} SELECT table_id, row_idx, description, CAST(q AS DOUBLE) AS quantity, CAST(replace(replace(t, ' €', ''), ',', '.') AS DOUBLE) AS total FROM li")
def invoice_line_items(spark, d):
    return I.line_items(invoice_cells(spark, d).filter("table_id like 'L%'")).select("table_id", "row_idx", "description", "quantity", "total")


@register("invoice_table_roles", "SELECT 'L' || l_orderkey AS table_id, 'line_items' AS role FROM lineitem GROUP BY 1 UNION ALL SELECT 'H' || o_orderkey, 'header' FROM orders UNION ALL SELECT 'S' || o_orderkey, 'totals' FROM orders")
def invoice_table_roles(spark, d):
    return I.table_names(invoice_cells(spark, d)).select("table_id", I.invoice_role(F.col("names"), F.col("n_rows")).alias("role"))


@register("technical_table_roles", "SELECT 'T' || (p_partkey // 20) AS table_id, CASE WHEN count(*) < 5 THEN 'client_info' ELSE 'unknown' END AS role FROM part GROUP BY 1")
def technical_table_roles(spark, d):
    return I.table_names(cells(spark, d)).select("table_id", I.technical_role(F.col("names"), F.col("n_rows")).alias("role"))


@register("invoice_totals", """SELECT 'S' || o_orderkey AS table_id, l.label, CASE l.label WHEN 'total_ht' THEN CAST(o_totalprice AS BIGINT) WHEN 'tax' THEN CAST(o_totalprice AS BIGINT) // 5 ELSE CAST(o_totalprice AS BIGINT) * 6 // 5 + 0.25 END AS amount FROM
(SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders), (VALUES ('total_ht'), ('tax'), ('total_ttc')) AS l(label)""", doubles=("amount",))
def invoice_totals(spark, d):
    return I.totals(invoice_cells(spark, d).filter("table_id like 'S%' and col_idx > 0"))


@register("invoice_header_fields", "SELECT 'H' || o_orderkey AS table_id, f AS field, CASE f WHEN 'invoice_number' THEN 'FA-' || o_orderkey WHEN 'invoice_date' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'C' || o_custkey END AS value FROM orders, (VALUES ('invoice_number'), ('invoice_date'), ('client_name')) AS x(f)")
def invoice_header_fields(spark, d):
    return I.first_row_fields(invoice_cells(spark, d).filter("table_id like 'H%'"), I.HEADER_FIELDS)


@register("invoice_assembly", f"WITH {_LI} SELECT 'F' || o_orderkey AS doc_id, coalesce(n, 0) AS item_count, coalesce(s, 0.0) AS total_amount, 'FA-' || o_orderkey AS invoice_number FROM orders LEFT JOIN (SELECT substr(table_id, 2) AS k, count(*) AS n, sum(CAST(replace(replace(t, ' €', ''), ',', '.') AS DOUBLE)) AS s FROM li GROUP BY 1) ON k = CAST(o_orderkey AS VARCHAR)")
def invoice_assembly(spark, d):
    return I.assemble(invoice_cells(spark, d)).select("doc_id", "item_count", "total_amount", F.try_element_at("header", F.lit("invoice_number")).alias("invoice_number"))


@register("invoice_reference", "SELECT 'F' || o_orderkey AS doc_id, 'FA-' || o_orderkey AS reference FROM orders WHERE o_orderkey >= 10")
def invoice_reference(spark, d):
    c = invoice_cells(spark, d).filter("table_id like 'H%'").withColumn("col_name", F.when(F.col("col_idx") == 0, "Numéro").otherwise(F.col("col_name")))
    return I.reference(c)


_TERM = "CASE p_partkey % 6 WHEN 0 THEN 'Garantie de deux ans' WHEN 1 THEN 'Livraison sous huit jours' WHEN 2 THEN 'Paiement à trente jours' WHEN 3 THEN 'Annulation possible' WHEN 4 THEN 'Politique de confidentialité' ELSE p_name END"


@register("term_category", f"SELECT p_partkey AS part_id, CASE p_partkey % 6 WHEN 0 THEN 'warranty' WHEN 1 THEN 'delivery' WHEN 2 THEN 'payment' WHEN 3 THEN 'cancellation' WHEN 4 THEN 'confidentiality' ELSE 'general' END AS category FROM part WHERE length({_TERM}) > 10")
def term_category(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("table_id"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), F.expr(_TERM).alias("value"))
    return I.terms(c).select(F.col("table_id").alias("part_id"), "category")


@register("boolean_parse", "SELECT p_partkey AS part_id, p_partkey % 8 IN (0, 1, 4, 5) AS truth FROM part")
def boolean_parse(spark, d):
    v = F.expr("CASE p_partkey % 8 WHEN 0 THEN ' Oui ' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'non' WHEN 3 THEN NULL WHEN 4 THEN 'x' WHEN 5 THEN 'coché' WHEN 6 THEN '0' ELSE p_name END")
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), I.truth(v).alias("truth"))


@register("amount_parse", "SELECT p_partkey AS part_id, CASE p_partkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN p_partkey + 1000.5 ELSE p_partkey END AS amount FROM part", doubles=("amount",))
def amount_parse(spark, d):
    v = F.expr("CASE p_partkey % 3 WHEN 0 THEN '1.' || p_partkey || ',5' WHEN 1 THEN substr(CAST(p_partkey + 1000 AS STRING), 1, 1) || ' ' || substr(CAST(p_partkey + 1000 AS STRING), 2) || ',50 €' ELSE CAST(p_partkey AS STRING) END")
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), I.amount(v).alias("amount"))


@register("key_normalise", "SELECT p_partkey AS part_id, substr(lower(replace(p_name, ' ', '_')) || '_' || p_partkey, 1, 50) AS key FROM part")
def key_normalise(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), I.normalise_key(F.expr("' ' || p_name || '! ' || p_partkey || ' '")).alias("key"))


@register("form_rows", "SELECT 'P' || (p_partkey // 50) AS table_id, CAST(p_partkey % 50 AS INTEGER) AS row_idx, 'case_cochée_' AS key, CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE p_brand END AS value FROM part")
def form_rows(spark, d):
    c = table(spark, d, "part").select(F.expr("'P' || (p_partkey div 50)").alias("table_id"), F.expr("CAST(p_partkey % 50 AS INT)").alias("row_idx"), F.lit("Case cochée ?").alias("col_name"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Oui' WHEN 1 THEN 'NO' ELSE p_brand END").alias("value"))
    return I.form_rows(c)


# boxes: arithmetic over part
_BOX = "p_partkey % 25 AS doc_id, CAST(1 + p_partkey % 2 AS INTEGER) AS page, p_partkey AS box_id, CAST(p_partkey * 37 % 500 AS INTEGER) AS x, CAST(p_partkey * 53 % 700 AS INTEGER) AS y, CAST(12 + p_partkey % 17 AS INTEGER) AS width, CAST(11 + p_partkey % 13 AS INTEGER) AS height, 0.5 + (p_partkey * 31 % 100) / 200.0 AS confidence"
_TYPE = "CASE p_partkey % 4 WHEN 0 THEN 'circular' WHEN 1 THEN 'rectangular' WHEN 2 THEN 'symbol' ELSE 'form_widget' END"
_CTX = "CASE p_partkey % 5 WHEN 0 THEN 'oui ou non' WHEN 1 THEN '' WHEN 2 THEN 'Adresse et téléphone' WHEN 3 THEN '#!? -' ELSE 'montant de la facture [ ]' END"
_B = f"WITH b AS (SELECT {_BOX}, {_TYPE} AS type, {_CTX} AS ctx FROM part) "


def boxes(spark, d):
    expr = f"SELECT {_BOX.replace('200.0', '200.0D').replace('0.5 +', '0.5D +').replace('INTEGER', 'INT')}, {_TYPE} AS type, {_CTX} AS text_context, p_partkey % 3 = 0 AS is_checked FROM {{p}}"
    return spark.sql(expr, p=table(spark, d, "part"))


_IOU = "greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))"


@register("iou_pairs", _B + f"SELECT doc_id, page, left_id, right_id, round(i / (s - i), 6) AS iou FROM (SELECT a.doc_id, a.page, a.box_id AS left_id, b.box_id AS right_id, {_IOU} AS i, a.width * a.height + b.width * b.height AS s FROM b a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND a.box_id < b.box_id) WHERE i > 0")
def iou_pairs(spark, d):
    # as SQL rounds doubles; Spark's own rounding goes through decimals, which takes longer than the join
    return G.overlapping(boxes(spark, d)).withColumn("iou", F.floor(F.col("iou") * 1_000_000 + 0.5) / 1_000_000)


@register("quartile_size_fence", _B + "SELECT doc_id, page, count(*) AS n, list_sort(list(width))[count(*) // 4 + 1] AS q1_width, list_sort(list(width))[count(*) // 2 + 1] AS q2_width, list_sort(list(width))[3 * count(*) // 4 + 1] AS q3_width, list_sort(list(height))[count(*) // 2 + 1] AS q2_height FROM b GROUP BY 1, 2")
def quartile_size_fence(spark, d):
    return G.size_stats(boxes(spark, d)).select("doc_id", "page", "n", "q1_width", "q2_width", "q3_width", "q2_height")


@register("box_quality", _B + """, m AS (SELECT doc_id, page, (list_sort(list(width))[count(*) // 2 + 1] + list_sort(list(height))[count(*) // 2 + 1]) / 2.0 AS ms FROM b GROUP BY 1, 2)
SELECT box_id, round(confidence * (1 - least(abs(1 - width / height), 0.6) * 1.5) * greatest(0.0, 1 - abs((width + height) / 2.0 - ms) / ms) * CASE type WHEN 'circular' THEN 1.1 WHEN 'rectangular' THEN 1.0 WHEN 'symbol' THEN 0.9 ELSE 1.2 END, 6) AS quality FROM b JOIN m USING (doc_id, page)""")
def box_quality(spark, d):
    return G.quality(boxes(spark, d)).select("box_id", F.round("quality", 6).alias("quality"))


@register("nms_keep")
def nms_keep(spark, d):
    return G.nms(boxes(spark, d)).select("doc_id", "page", "box_id")


@register("proximity_filter")
def proximity_filter(spark, d):
    return G.proximity_filter(boxes(spark, d)).select("doc_id", "page", "box_id")


@register("post_validate_boxes")
def post_validate_boxes(spark, d):
    return G.post_validate(boxes(spark, d)).select("doc_id", "page", "box_id", F.round("confidence", 6).alias("confidence"))


@register("dense_page_cap", _B + "SELECT box_id FROM (SELECT box_id, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id, page ORDER BY confidence DESC, box_id) AS rn FROM b) WHERE n <= 70 OR rn <= 30")
def dense_page_cap(spark, d):
    return G.cap_dense(boxes(spark, d), 70).select("box_id")


@register("form_section_vote", _B + "SELECT box_id, CASE ctx WHEN 'Adresse et téléphone' THEN 'contact' WHEN 'montant de la facture [ ]' THEN 'facturation' WHEN 'oui ou non' THEN '' ELSE '' END AS section FROM b")
def form_section_vote(spark, d):
    return boxes(spark, d).select("box_id", G.form_section(F.col("text_context")).alias("section"))


@register("context_meaningful", _B + "SELECT box_id, ctx NOT IN ('', '#!? -') AS meaningful FROM b")
def context_meaningful(spark, d):
    return boxes(spark, d).select("box_id", G.context_meaningful(F.col("text_context")).alias("meaningful"))


@register("box_report", "WITH b AS (SELECT " + _BOX + ", p_partkey % 3 = 0 AS is_checked FROM part) SELECT doc_id, count(*) AS n_boxes, round(avg(CASE WHEN is_checked THEN 1.0 ELSE 0.0 END), 6) AS checked_ratio, count(*) FILTER (WHERE confidence < 0.6) AS low, count(*) FILTER (WHERE confidence >= 0.6 AND confidence < 0.8) AS medium, count(*) FILTER (WHERE confidence >= 0.8) AS high FROM b GROUP BY 1")
def box_report(spark, d):
    return G.box_report(boxes(spark, d))


@register("form_value_maps", "WITH b AS (SELECT " + _BOX + ", p_partkey % 3 = 0 AS is_checked, p_brand AS label FROM part) SELECT doc_id, count(*) AS n_labels, count(*) FILTER (WHERE is_checked) AS n_checked FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY confidence DESC, box_id) AS rn FROM b) WHERE rn = 1 GROUP BY 1")
def form_value_maps(spark, d):
    b = boxes(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("box_id"), F.col("p_brand").alias("label")), "box_id").withColumn("section", G.form_section(F.col("text_context")))
    m = G.form_values(b)
    return m.select("doc_id", F.size("form_values").cast("long").alias("n_labels"), F.size(F.filter(F.map_values("form_values"), lambda v: v)).cast("long").alias("n_checked"))


@register("images_near_text", _B + "SELECT DISTINCT a.box_id FROM b a JOIN b t ON a.doc_id = t.doc_id AND a.page = t.page WHERE a.type = 'symbol' AND t.type = 'circular' AND least(abs(a.y - (t.y + t.height)), abs(t.y - (a.y + a.height))) <= 10")
def images_near_text(spark, d):
    b = boxes(spark, d).select("doc_id", "page", "box_id", "type", F.col("y").alias("y0"), (F.col("y") + F.col("height")).alias("y1"))
    return G.images_near_text(b.filter("type = 'symbol'"), b.filter("type = 'circular'"), 10).select("box_id")


@register("grid_cells", _B + "SELECT box_id, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x, box_id) AS BIGINT) AS cell_no FROM b WHERE width >= 20 AND height >= 20")
def grid_cells(spark, d):
    return G.grid_cells(boxes(spark, d)).select("box_id", F.col("cell_no").cast("long").alias("cell_no"))


@register("table_sanity", _C + ", s AS (SELECT table_id, count(DISTINCT row_idx) AS r, count(*) FILTER (WHERE value IS NULL) / count(*) AS e FROM c GROUP BY 1), k AS (SELECT table_id, col_idx, count(value) > 0 AND count(" + _NUM + ") > 0.7 * count(value) AS num, count(DISTINCT value) AS u FROM c GROUP BY 1, 2), m AS (SELECT table_id, count(*) FILTER (WHERE num) AS n, count(*) FILTER (WHERE NOT num) AS t, max(u) AS u FROM k GROUP BY 1) SELECT table_id, r >= 2 AND e <= 0.8 AND NOT (((n = 1 AND t > 3) OR (t = 1 AND n > 3)) AND u = r AND r > 4) AS sane FROM s JOIN m USING (table_id)")
def table_sanity(spark, d):
    return X.sane(cells(spark, d))


@register("export_markdown", _C + ", r AS (SELECT table_id, row_idx, '| ' || string_agg(coalesce(value, ''), ' | ' ORDER BY col_idx) || ' |' AS line FROM c GROUP BY 1, 2) SELECT table_id, string_agg(line, chr(10) ORDER BY row_idx) AS body FROM r GROUP BY 1")
def export_markdown(spark, d):
    from tamis.sources import export

    return export.markdown_body(cells(spark, d))


@register("export_json_rows", _C + " SELECT table_id, row_idx, count(value) FILTER (WHERE col_idx <> 4) AS n_values FROM c GROUP BY 1, 2")
def export_json_rows(spark, d):
    from tamis.sources import export

    rows = export.json_rows(cells(spark, d))
    return rows.select("table_id", "row_idx", F.size(F.filter(F.map_values(F.from_json("json", "map<string,string>")), lambda v: v.isNotNull())).cast("long").alias("n_values"))


@register("table_pipeline")
def table_pipeline(spark, d):
    return X.process(cells(spark, d))


@register("table_status", _C + f", {_SHAPE}, {_ERR} SELECT table_id, CASE WHEN n_rows >= 2 AND n_cols >= 2 AND n_null / n_cells <= 0.7 AND (marker_hits + odd_cells) / n_cells <= 0.3 THEN 'kept' ELSE 'rejected' END AS status FROM s JOIN e USING (table_id)")
def table_status(spark, d):
    c = cells(spark, d)
    return X.with_status(c.select("table_id").distinct(), X.verdicts(c).filter("valid"))
