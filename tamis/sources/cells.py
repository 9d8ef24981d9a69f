"""Readers that turn tables in JSON, CSV text and HTML into cells (table_id, page, row_idx, col_idx, col_name, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows: keep, header (array), body (array of arrays)."""
    each = rows.select(*keep, "header", F.posexplode("body").alias("row_idx", "values"))
    return each.select(*keep, "row_idx", "header", F.posexplode("values").alias("col_idx", "value")).select(*keep, "row_idx", "col_idx", F.coalesce(F.try_element_at("header", F.col("col_idx") + 1), F.concat(F.lit("Col_"), (F.col("col_idx") + 1).cast("string"))).alias("col_name"), "value")


def from_json_records(tables: DataFrame, json_col: str = "json") -> DataFrame:
    """(table_id, page, json): an array of objects; columns in the order of their names."""
    maps = F.from_json(json_col, "array<map<string,string>>")
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(maps, lambda m: F.map_keys(m)))))
    rows = tables.select("table_id", "page", names.alias("header"), maps.alias("m"))
    body = F.transform("m", lambda r: F.transform(F.col("header"), lambda k: F.try_element_at(r, k)))
    return _cells(rows.withColumn("body", body), ["table_id", "page"])


def csv_fields(line: Column, separator: str = ",") -> Column:
    """Fields of a CSV line; quoted fields may hold separators and doubled quotes."""
    s = "\\" + separator
    raw = F.regexp_extract_all(F.concat(line, F.lit(separator)), F.lit(f'("(?:[^"]|"")*"|[^{s}]*){s}'), 1)
    return F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def from_csv_text(tables: DataFrame, text_col: str = "text", separator: str = ",") -> DataFrame:
    """(table_id, page, text): the first line names the columns; empty fields are null."""
    lines = F.filter(F.split(text_col, r"\r?\n"), lambda x: x != "")
    parsed = tables.select("table_id", "page", F.transform(lines, lambda x: F.transform(csv_fields(x, separator), lambda v: F.nullif(v, F.lit("")))).alias("l"))
    return _cells(parsed.filter(F.size("l") > 0).select("table_id", "page", F.try_element_at("l", F.lit(1)).alias("header"), F.slice("l", F.lit(2), F.size("l")).alias("body")), ["table_id", "page"])


def from_html(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(doc_id, html): every table of a page without nesting; a first row of th cells names the columns."""
    tables = pages.select("doc_id", F.posexplode(F.regexp_extract_all(html_col, F.lit(r"(?is)<table\b[^>]*>(.*?)</table\s*>"), 1)).alias("n", "t"))
    rows = F.regexp_extract_all("t", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), 1)
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))
    fields = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), 1), clean)
    parsed = tables.select(F.concat_ws("/", "doc_id", "n").alias("table_id"), F.lit(1).alias("page"), rows.alias("r")).filter(F.size("r") > 0)
    head = F.lower(F.element_at("r", 1)).contains("<th")
    body = F.transform(F.when(head, F.slice("r", F.lit(2), F.size("r"))).otherwise(F.col("r")), fields)
    return _cells(parsed.select("table_id", "page", F.when(head, fields(F.element_at("r", 1))).otherwise(F.array().cast("array<string>")).alias("header"), body.alias("body")), ["table_id", "page"])


def to_records(cells: DataFrame) -> DataFrame:
    """Cells back as one JSON array of objects per table (a table is small; many tables are spread)."""
    row = cells.groupBy("table_id", "row_idx", "col_name").agg(F.max_by("value", "col_idx").alias("value")).groupBy("table_id", "row_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col_name", "value")))).alias("m"))
    return row.groupBy("table_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.to_json("m").alias("j")))), lambda s: F.from_json(s["j"], "map<string,string>"))).alias("json"))


def jdbc(spark, url: str, dbtable: str, key: str | None = None, bounds: tuple[int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table; with a numeric key and (least, most, parts) it is read in parallel ranges."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable).options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", bounds[2])
    return r.load()
