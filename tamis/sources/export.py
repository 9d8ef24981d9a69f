"""Sinks: tables as Markdown, JSON, HTML and CSV, and the index, log and file housekeeping writers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lines(cells: DataFrame, join: str, before: str, after: str) -> DataFrame:
    """One line per row: values in column order. A row's cells are few."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", F.coalesce("value", F.lit("")).alias("value")))), lambda s: s["value"])
    return cells.groupBy("table_id", "row_idx").agg(F.concat(F.lit(before), F.array_join(values, join), F.lit(after)).alias("line"))


def _body(lines: DataFrame) -> DataFrame:
    return lines.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda s: s["line"]), "\n").alias("body"))


def markdown_body(cells: DataFrame) -> DataFrame:
    return _body(_lines(cells, " | ", "| ", " |"))


def html_body(cells: DataFrame) -> DataFrame:
    escaped = F.replace(F.replace(F.replace("value", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return _body(_lines(cells.withColumn("value", escaped), "</td><td>", "<tr><td>", "</td></tr>"))


def csv_body(cells: DataFrame) -> DataFrame:
    quoted = F.when(F.col("value").rlike('[",\n]'), F.concat(F.lit('"'), F.replace("value", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("value"))
    return _body(_lines(cells.withColumn("value", quoted), ",", "", ""))


def json_rows(cells: DataFrame) -> DataFrame:
    """One JSON object per row; of equal names the later column wins."""
    named = cells.groupBy("table_id", "row_idx", "col_name").agg(F.max_by("value", "col_idx").alias("value"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("#", "col_name").alias("k"), "value")))
    return named.groupBy("table_id", "row_idx").agg(F.to_json(entries).alias("json"))


FORMATS = {"markdown": markdown_body, "html": html_body, "csv": csv_body}


def export(cells: DataFrame, form: str, path: str) -> None:
    """One text file set per call, a folder per table. Unknown formats raise ValueError."""
    if form == "json":
        json_rows(cells).select("table_id", F.col("json").alias("value")).write.partitionBy("table_id").text(path)
    elif form in FORMATS:
        FORMATS[form](cells).select("table_id", F.col("body").alias("value")).write.partitionBy("table_id").text(path)
    else:
        raise ValueError(f"unknown export format: {form}")


def write_index(docs: DataFrame, path: str, dim: int | None = None) -> None:
    """Overwrites the document index, stamped; vectors of another dimension are an error at run time."""
    out = docs.withColumn("processed_date", F.current_timestamp())
    if dim is not None:
        wrong = F.col("embedding").isNotNull() & (F.size("embedding") != dim)
        out = out.withColumn("embedding", F.when(wrong, F.raise_error(F.lit("vector of another dimension")).cast("array<float>")).otherwise(F.col("embedding")))
    out.write.mode("overwrite").parquet(path)


def mapping_drift(df: DataFrame, expected: dict[str, str]) -> dict[str, tuple[str | None, str]]:
    """Fields whose type differs from the mapping: found and expected."""
    have = dict(df.dtypes)
    return {k: (have.get(k), v) for k, v in expected.items() if have.get(k) != v}


def append_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def old_files(spark, path: str, hours: float) -> DataFrame:
    """Files below a path not modified for so many hours."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    return files.filter(F.col("modificationTime") < F.current_timestamp() - F.make_dt_interval(hours=F.lit(int(hours))))


def flatten(df: DataFrame) -> DataFrame:
    """Nested columns as JSON and times as text, for formats without them."""
    out = {}
    for name, kind in df.dtypes:
        if kind.startswith(("array", "map", "struct")):
            out[name] = F.to_json(name)
        elif kind.startswith(("timestamp", "date")):
            out[name] = F.col(name).cast("string")
    return df.withColumns(out)


def csv_zips(cells: DataFrame, stamp: str = "") -> DataFrame:
    """doc_id, filename and content of one ZIP archive per document: its tables as CSV with a header, and a README.

    ``cells`` also has doc_id. Nulls are empty cells. A document's tables are gathered as CSV bodies, never the table of all cells.
    """
    names = cells.groupBy("doc_id", "table_id", "col_idx").agg(F.max("col_name").alias("value")).withColumn("row_idx", F.lit(-1))
    rows = cells.select("doc_id", "table_id", "row_idx", "col_idx", "value").unionByName(names)
    docs = cells.select("doc_id", "table_id").distinct()
    bodies = csv_body(rows).join(docs, "table_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("table_id", "body"))).alias("tables"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, tables in zip(b["doc_id"], b["tables"]):
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                    for i, t in enumerate(tables):
                        z.writestr(zipfile.ZipInfo(f"table_{i + 1}.csv"), t["body"] + "\n", zipfile.ZIP_DEFLATED)
                    z.writestr(zipfile.ZipInfo("README.txt"), f"Tables: {len(tables)}\nDate: {stamp}\nFormat: CSV\nEncoding: UTF-8\nSeparator: ,\n", zipfile.ZIP_DEFLATED)
                out.append((doc, f"{doc}.zip", buf.getvalue()))
            yield pd.DataFrame(out, columns=["doc_id", "filename", "content"])

    return bodies.mapInPandas(run, f"doc_id {bodies.schema['doc_id'].dataType.simpleString()}, filename string, content binary")


def zip_entries(zips: DataFrame) -> DataFrame:
    """doc_id, name and number of lines of every entry of the archives, read back from their bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, content in zip(b["doc_id"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    out += [(doc, name, z.read(name).decode().count("\n")) for name in z.namelist()]
            yield pd.DataFrame(out, columns=["doc_id", "name", "n_lines"])

    return zips.select("doc_id", "content").mapInPandas(run, f"doc_id {zips.schema['doc_id'].dataType.simpleString()}, name string, n_lines long")


def purge_old(spark, path: str, hours: float) -> int:
    """Deletes the files that :func:`old_files` finds, one listing row at a time, and returns their number."""
    jvm, n = spark._jvm, 0
    for r in old_files(spark, path, hours).select("path").toLocalIterator():
        p = jvm.org.apache.hadoop.fs.Path(r["path"])
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False))
    return n


def result(cells: DataFrame, form: str) -> DataFrame:
    """A result in the format asked for: raw cells, records, csv or html."""
    if form == "raw":
        return cells
    if form == "records":
        return json_rows(cells)
    if form in FORMATS:
        return FORMATS[form](cells)
    raise ValueError(f"unknown result format: {form}")
