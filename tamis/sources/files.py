"""File scans with plug-in decoders. Decoding (PDF text, OCR, detection) is a boundary: a function of bytes, run in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported extensions.
EXTENSIONS = ["pdf", "docx", "txt"]


def scan(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)


def with_kind(files: DataFrame) -> DataFrame:
    """Adds kind by extension; others raise at run time."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("kind", F.when(ext.isin(EXTENSIONS), ext).otherwise(F.raise_error(F.concat(F.lit("unsupported format: "), ext)).cast("string")))


def decode(files: DataFrame, decoder: Callable[[bytes], list[str]]) -> DataFrame:
    """path, page, text, error: a decoder gives the texts of the pages; its failures are rows, not lost jobs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    out += [(path, i + 1, t, None) for i, t in enumerate(decoder(bytes(content)))]
                except Exception as e:  # noqa: BLE001  whatever a plug-in raises is reported beside the file
                    out.append((path, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "page", "text", "error"]).astype({"page": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, page long, text string, error string")


METADATA = ["title", "author", "subject", "creator", "producer", "creation_date", "modification_date", "pages"]


def metadata(files: DataFrame, reader: Callable[[bytes], dict]) -> DataFrame:
    """path, metadata and error of every file: a reader gives a file's properties; absent ones are empty, unknown ones go."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    found = reader(bytes(content))
                    out.append((path, {k: str(found.get(k) or "") for k in METADATA}, None))
                except Exception as e:  # noqa: BLE001  whatever a plug-in raises is reported beside the file
                    out.append((path, {}, str(e)))
            yield pd.DataFrame(out, columns=["path", "metadata", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, metadata map<string,string>, error string")


def scan_summary(decoded: DataFrame) -> DataFrame:
    """Files read and files that failed, of a decoded scan: one row."""
    each = decoded.groupBy("path").agg(F.max(F.col("error").isNotNull()).alias("bad"))
    return each.agg(F.count_if(~F.col("bad")).alias("ok"), F.count_if("bad").alias("failed"))


def plain_text(content: bytes) -> list[str]:
    """Decoder of text files: form feeds part pages."""
    return content.decode("utf-8", "replace").split("\f")


def document_text(pages: DataFrame) -> DataFrame:
    """Pages of a file as one text with page marks."""
    mark = F.concat(F.lit("=== Page "), F.col("page").cast("string"), F.lit(" ===\n"), "text")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page", mark.alias("t")))), lambda s: s["t"])
    return pages.filter("error is null").groupBy("path").agg(F.array_join(listed, "\n").alias("text"), F.count("*").alias("n_pages"))
