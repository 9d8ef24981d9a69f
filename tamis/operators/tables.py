"""Extracted tables as cells: (table_id, page, row_idx, col_idx, col_name, value STRING).

Tables of any shape share this one form, so every step is a grouped aggregate or a join over cells. Greedy steps that
depend on order run per document or page in ``applyInPandas`` over one row per table, never over cells of many tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.sources.work import work_dir

# Limits, error marks, placeholders and date formats.
MIN_ROWS, MIN_COLS, MAX_EMPTY, MAX_ERROR, NUMERIC_SHARE = 2, 2, 0.7, 0.3, 0.7
ERROR_MARKERS = ["#", "?", "!", "error", "err", "null", "none"]
ERROR_VALUES = ["#VALUE!", "#REF!", "#DIV/0!", "#ERROR!", "error", "null", "none", "nan"]
PLACEHOLDERS = ["n/a", "na", "none", "null", "-", "--"]
DATE_FORMATS = ["dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy.MM.dd"]
SEPARATORS = ["|", ",", ";", "\t"]
TABLES_PER_PAGE, MERGE_SIMILARITY, MERGE_OVERLAP = 5, 0.7, 0.6
COLUMN, ROW = ["table_id", "col_idx"], ["table_id", "row_idx"]


def by_merge(side: DataFrame) -> DataFrame:
    """A side of a join that follows the corpus: Spark judges it by the bytes of compressed files and would broadcast millions of cells."""
    return side.hint("merge")


def number(value: Column) -> Column:
    return F.trim(value).try_cast("double")


def shape(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id").agg(F.count_distinct("row_idx").alias("n_rows"), F.count_distinct("col_idx").alias("n_cols"), F.count("*").alias("n_cells"))


def column_stats(cells: DataFrame) -> DataFrame:
    """Per column: cells, filled cells, numbers, and whether all filled numbers are whole."""
    n = number(F.col("value"))
    return cells.groupBy(*COLUMN).agg(F.count("*").alias("cells"), F.count("value").alias("filled"), F.count(n).alias("numbers"), F.count_if(n % 1 == 0).alias("whole"))


def column_faults(cells: DataFrame) -> DataFrame:
    """Per column: cells, empty ones, hits of error marks (each mark counts), and words if the column is mostly numbers."""
    n, text = number(F.col("value")), F.lower(F.col("value"))
    marks = F.lit(0)
    for m in ERROR_MARKERS:
        marks = marks + F.when(F.contains(text, F.lit(m)), 1).otherwise(0)
    g = cells.groupBy(*COLUMN).agg(F.count("*").alias("cells"), F.count("value").alias("filled"), F.count(n).alias("numbers"), F.sum(marks).alias("marks"))
    odd = F.when(F.col("numbers") > NUMERIC_SHARE * F.col("cells"), F.col("filled") - F.col("numbers")).otherwise(0)
    return g.select(*COLUMN, "cells", (F.col("cells") - F.col("filled")).alias("empty"), "marks", odd.alias("odd"))


def error_counts(cells: DataFrame) -> DataFrame:
    """Per table: hits of error marks and words in columns that are mostly numbers."""
    return column_faults(cells).groupBy("table_id").agg(F.sum("marks").alias("marker_hits"), F.sum("odd").alias("odd_cells"))


def verdicts(cells: DataFrame) -> DataFrame:
    """Structure and content rules per table, and whether both hold, in one pass over the cells.

    Tables are rectangular: a cell for every row and column, null where it is empty.
    """
    g = column_faults(cells).groupBy("table_id").agg(F.max("cells").alias("n_rows"), F.count("*").alias("n_cols"), F.sum("cells").alias("n_cells"), F.sum("empty").alias("n_empty"), (F.sum("marks") + F.sum("odd")).alias("n_errors"))
    empty, error = F.col("n_empty") / F.col("n_cells"), F.col("n_errors") / F.col("n_cells")
    structure, content = (F.col("n_rows") >= MIN_ROWS) & (F.col("n_cols") >= MIN_COLS), (empty <= MAX_EMPTY) & (error <= MAX_ERROR)
    return g.select("table_id", "n_rows", "n_cols", empty.alias("empty_ratio"), error.alias("error_ratio"), structure.alias("structure_ok"), content.alias("content_ok"), (structure & content).alias("valid"))


def name_columns(cells: DataFrame) -> DataFrame:
    return cells.withColumn("col_name", F.coalesce("col_name", F.concat(F.lit("Col_"), (F.col("col_idx") + 1).cast("string"))))


def errors_to_null(cells: DataFrame) -> DataFrame:
    """Error strings become null; in columns mostly of numbers, words do too."""
    c = cells.withColumn("value", F.when(~F.col("value").isin(ERROR_VALUES), F.col("value")))
    w = Window.partitionBy(*COLUMN)
    numeric = F.count(number(F.col("value"))).over(w) > NUMERIC_SHARE * F.count("*").over(w)
    return c.withColumn("numeric", numeric).withColumn("value", F.when(~F.col("numeric") | number(F.col("value")).isNotNull(), F.col("value")))


def drop_repeated_rows(cells: DataFrame) -> DataFrame:
    """First of rows with equal cells, per table. A row travels whole, so nothing is joined back."""
    rest = [c for c in cells.columns if c not in ("table_id", "row_idx", "col_idx", "value")]
    rows = cells.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("sig"), F.array_sort(F.collect_list(F.struct("col_idx", "value", *rest))).alias("c"))
    first = rows.groupBy("table_id", "sig").agg(F.min_by(F.struct("row_idx", "c"), "row_idx").alias("r"))
    return first.select("table_id", "r.row_idx", F.inline("r.c")).select(*cells.columns)


def fences(cells: DataFrame) -> DataFrame:
    """Per numeric column the bounds beyond which a value is an outlier: deciles, three spans outside."""
    q = cells.filter("numeric").groupBy(*COLUMN).agg(F.percentile(number(F.col("value")), F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    span = F.col("q")[1] - F.col("q")[0]
    return q.select(*COLUMN, (F.col("q")[0] - 3 * span).alias("low"), (F.col("q")[1] + 3 * span).alias("high"))


def outliers_to_null(cells: DataFrame) -> DataFrame:
    """Values outside their column's fences become null; the fences are a window over the column, so nothing is joined back."""
    w = Window.partitionBy(*COLUMN)
    n = number(F.col("value"))
    q = F.when(F.col("numeric"), F.percentile(n, F.array(F.lit(0.1), F.lit(0.9))).over(w))
    c = cells.withColumn("q", q)
    span = F.col("q")[1] - F.col("q")[0]
    fine = F.col("q").isNull() | n.between(F.col("q")[0] - 3 * span, F.col("q")[1] + 3 * span)
    return c.withColumn("value", F.when(fine, F.col("value"))).drop("q")


def fix(cells: DataFrame) -> DataFrame:
    return outliers_to_null(drop_repeated_rows(errors_to_null(name_columns(cells))))


def validate(cells: DataFrame) -> DataFrame:
    """Cells of tables with a sound structure, mended, whose content is sound."""
    sound = shape(cells).filter((F.col("n_rows") >= MIN_ROWS) & (F.col("n_cols") >= MIN_COLS)).select("table_id")
    mended = fix(cells.join(by_merge(sound), "table_id", "left_semi")).drop("numeric")
    return _content_ok(mended)


def _content_ok(cells: DataFrame) -> DataFrame:
    """Cells of tables that hold the content rule of :func:`verdicts`, by windows: the cells are not computed twice and joined."""
    table, column = Window.partitionBy("table_id"), Window.partitionBy(*COLUMN)
    n, text = number(F.col("value")), F.lower(F.col("value"))
    marks = F.lit(0)
    for m in ERROR_MARKERS:
        marks = marks + F.when(F.contains(text, F.lit(m)), 1).otherwise(0)
    numeric = F.count(n).over(column) > NUMERIC_SHARE * F.count("*").over(column)
    c = cells.withColumns({"odd": F.when(numeric & F.col("value").isNotNull() & n.isNull(), 1).otherwise(0), "marks": marks})
    total = F.count("*").over(table)
    empty, error = F.count_if(F.col("value").isNull()).over(table) / total, F.sum(F.col("marks") + F.col("odd")).over(table) / total
    return c.withColumn("ok", (empty <= MAX_EMPTY) & (error <= MAX_ERROR)).filter("ok").drop("odd", "marks", "ok")


def column_types(cells: DataFrame) -> DataFrame:
    """integer, float, date (with the first format that fits) or text per column, by shares of filled cells."""
    dates = [F.count(F.try_to_timestamp(F.trim("value"), F.lit(f))).alias(f"d{i}") for i, f in enumerate(DATE_FORMATS)]
    n = number(F.col("value"))
    g = cells.groupBy(*COLUMN).agg(F.count("*").alias("cells"), F.count("value").alias("filled"), F.count(n).alias("numbers"), F.count_if(n % 1 == 0).alias("whole"), *dates)
    most = F.col("filled") > 0
    kind = F.when(most & (F.col("numbers") > NUMERIC_SHARE * F.col("filled")), F.when(F.col("whole") == F.col("cells"), "integer").otherwise("float"))
    form = F.lit(None).cast("string")
    for i, f in reversed(list(enumerate(DATE_FORMATS))):
        form = F.when(most & (F.col(f"d{i}") > NUMERIC_SHARE * F.col("filled")), f).otherwise(form)
    return g.select(*COLUMN, F.coalesce(kind, F.when(form.isNotNull(), "date"), F.lit("text")).alias("type"), F.when(kind.isNull(), form).alias("date_format"))


def clean_headers(columns: DataFrame) -> DataFrame:
    """(table_id, col_idx, col_name) -> header: letters and digits, single spaces, Col_n if empty, repeated names numbered."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("col_name", F.lit("")), r"(?U)[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    named = columns.withColumn("header", F.coalesce(F.nullif(bare, F.lit("")), F.concat(F.lit("Col_"), (F.col("col_idx") + 1).cast("string"))))
    n = F.row_number().over(Window.partitionBy("table_id", "header").orderBy("col_idx")) - 1
    return named.withColumn("n", n).withColumn("header", F.when(F.col("n") > 0, F.concat("header", F.lit("_"), F.col("n").cast("string"))).otherwise(F.col("header"))).drop("n")


def clean_values(cells: DataFrame) -> DataFrame:
    """Trimmed; blanks and placeholders to null; columns of numbers with more than four decimals rounded to two."""
    t = F.trim("value")
    c = cells.withColumn("value", F.when((t != "") & ~t.isin(PLACEHOLDERS), t))
    w = Window.partitionBy(*COLUMN)
    numeric = F.count(number(F.col("value"))).over(w) == F.count("value").over(w)
    decimals = F.length(F.regexp_extract("value", r"\.(\d+)$", 1))
    c = c.withColumns({"n": numeric, "d": F.max(decimals).over(w)})
    return c.withColumn("value", F.when(F.col("n") & (F.col("d") > 4), F.round(number(F.col("value")), 2).cast("string")).otherwise(F.col("value"))).drop("n", "d")


def column_pairs(cells: DataFrame) -> DataFrame:
    """Per pair of columns of a table: shares of rows where both are empty, and where exactly one is."""
    row = cells.dropna(subset=ROW).groupBy(*ROW).agg(F.collect_list(F.struct("col_idx", F.col("value").isNull().alias("empty"))).alias("c"))  # a row's cells
    left = row.select("table_id", "c", F.inline("c")).select("table_id", "c", F.col("col_idx").alias("left_col"), F.col("empty").alias("na"))
    both = left.select("table_id", "left_col", "na", F.inline("c")).withColumnsRenamed({"col_idx": "right_col", "empty": "nb"}).filter("left_col < right_col")
    return both.groupBy("table_id", "left_col", "right_col").agg((F.count_if(F.col("na") & F.col("nb")) / F.count("*")).alias("both_empty"), (F.count_if(F.col("na") != F.col("nb")) / F.count("*")).alias("complementary"))


def combine(a: Column, b: Column) -> Column:
    """The one that is there; of two, the longer, the first of equals."""
    return F.when(a.isNull(), b).when(b.isNull(), a).when(F.length(a) >= F.length(b), a).otherwise(b)


def merge_fragments(cells: DataFrame) -> DataFrame:
    """Columns that complement each other become one. Which, is decided greedily per table over its few column pairs."""
    pairs = column_pairs(cells).filter("both_empty <= 0.5 and complementary > 0.7")
    wide = shape(cells).filter("n_cols > 2").select("table_id")

    def choose(taken: Column, p: Column) -> Column:
        gone = F.exists(taken, lambda t: (t["col_idx"] == p["left_col"]) | (t["col_idx"] == p["right_col"]))
        return F.when(gone, taken).otherwise(F.array_append(taken, F.struct(p["left_col"].cast("int").alias("main"), p["right_col"].cast("int").alias("col_idx"))))

    listed = pairs.join(by_merge(wide), "table_id", "left_semi").groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("left_col", "right_col"))).alias("p"))
    chosen = listed.select("table_id", F.inline(F.aggregate("p", F.array().cast("array<struct<main:int,col_idx:int>>"), choose)))
    moved = cells.join(by_merge(chosen), COLUMN, "left")
    keyed = moved.withColumn("to", F.coalesce("main", "col_idx"))
    # longest value wins, the earliest column of equals: combine() over any number of fragments
    best = F.max_by("value", F.when(F.col("value").isNotNull(), F.struct(F.length("value"), -F.col("col_idx"))))
    return keyed.groupBy("table_id", "row_idx", F.col("to").alias("col_idx")).agg(F.min("page").alias("page"), F.min_by("col_name", "col_idx").alias("col_name"), best.alias("value"))


def header_similarity(a: Column, b: Column) -> Column:
    """Share of positions whose names share over 0.7 of the longer one's characters (1 for equal lists)."""
    close = F.zip_with(a, b, lambda x, y: F.when(
        F.greatest(F.length(x), F.length(y)) > 0,
        F.size(F.filter(F.split(x, ""), lambda c: (c != "") & F.contains(y, c))) / F.greatest(F.length(x), F.length(y)) > 0.7,
    ).otherwise(False))
    return F.when(a == b, 1.0).when(F.size(a) != F.size(b), 0.0).otherwise(F.size(F.filter(close, lambda c: c)) / F.size(a))


def export_types(cells: DataFrame) -> DataFrame:
    """table_id, col_idx, type that an export stores a column as, after blank rows and columns are dropped.

    A column whose every cell is a number gets the least integer type that holds it, or float; a text column with
    fewer distinct values than half its rows is a category, another one text.
    """
    n = F.expr("try_cast(trim(value) AS double)")
    rows = cells.filter("value is not null").select("table_id", "row_idx").distinct().groupBy("table_id").agg(F.count("*").alias("n_rows"))
    g = cells.groupBy("table_id", "col_idx").agg(
        F.count("value").alias("filled"), F.count(n).alias("numbers"), F.count_distinct("value").alias("different"),
        F.count_if(n % 1 == 0).alias("whole"), F.min(n).alias("low"), F.max(n).alias("high"),
    ).filter("filled > 0").join(rows, "table_id")
    integer = F.lit("int64")
    for bits in (32, 16, 8):
        integer = F.when((F.col("low") >= -(2 ** (bits - 1))) & (F.col("high") < 2 ** (bits - 1)), f"int{bits}").otherwise(integer)
    kind = F.when(F.col("numbers") == F.col("n_rows"), F.when(F.col("whole") == F.col("n_rows"), integer).otherwise("float"))
    return g.select("table_id", "col_idx", kind.otherwise(F.when(F.col("different") < F.col("n_rows") * 0.5, "category").otherwise("text")).alias("type"))


def string_similarity(a: Column, b: Column) -> Column:
    """Characters of the first that the second holds, over the longer length."""
    return F.size(F.filter(F.split(a, ""), lambda c: (c != "") & F.contains(b, c))) / F.greatest(F.length(a), F.length(b), F.lit(1))


def nearly_equal(a: Column, b: Column, threshold: float = 0.85) -> Column:
    """Equal, one in the other, or of like length with mostly the same characters."""
    chars = lambda s: F.filter(F.array_distinct(F.split(s, "")), lambda c: c != "")
    ratio = F.size(F.array_intersect(chars(a), chars(b))) / F.greatest(F.size(chars(a)), F.size(chars(b)))
    length = F.greatest(F.length(a), F.length(b)) / F.least(F.length(a), F.length(b))
    return F.when((a == "") & (b == ""), True).when((a == "") | (b == ""), False).when(F.contains(a, b) | F.contains(b, a), True).when(length > 2, False).otherwise(ratio >= threshold)


def similarity(cells: DataFrame, pairs: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(left_id, right_id) pairs of equally shaped tables -> share of equal cells (nearly equal if fuzzy, by column name)."""
    s = shape(cells).select("table_id", "n_rows", "n_cols")
    l, r = (s.select(*(F.col(c).alias(f"{p}_{c}") for c in s.columns)) for p in ("l", "r"))
    alike = pairs.join(by_merge(l), F.col("left_id") == F.col("l_table_id")).join(by_merge(r), F.col("right_id") == F.col("r_table_id")).filter("l_n_rows = r_n_rows and l_n_cols = r_n_cols").select("left_id", "right_id")
    place = "col_name" if fuzzy else "col_idx"
    a = cells.select(F.col("table_id").alias("left_id"), "row_idx", place, F.col("value").alias("a"))
    b = cells.select(F.col("table_id").alias("right_id"), "row_idx", place, F.col("value").alias("b"))
    both = alike.join(by_merge(a), "left_id").join(by_merge(b), ["right_id", "row_idx", place])
    if fuzzy:
        x, y = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("a", "b"))
        equal = (x == y) | nearly_equal(x, y)
    else:
        equal = F.coalesce("a", F.lit("nan")) == F.coalesce("b", F.lit("nan"))
    return both.groupBy("left_id", "right_id").agg((F.count_if(equal) / F.count("*")).alias("similarity"))


def cap_per_page(tables: DataFrame, most: int = TABLES_PER_PAGE) -> DataFrame:
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("confidence"), F.asc("table_id"))
    return tables.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).drop("rn")


def merge_by_signature(tables: DataFrame, alike: DataFrame) -> DataFrame:
    """Of tables of a page with one shape and similar content, the most confident stays.

    ``alike`` holds (left_id, right_id) pairs above the similarity. Greedy over a page's tables, which are few.
    """
    return _greedy(tables, alike.select("left_id", "right_id"), lambda a, b: a["n_rows"] == b["n_rows"] and a["n_cols"] == b["n_cols"])


def merge_by_region(tables: DataFrame, alike: DataFrame, overlap: float = MERGE_OVERLAP) -> DataFrame:
    """As :func:`merge_by_signature`, for tables whose regions overlap enough; at most five per page stay."""
    from tamis.operators.geometry import iou_py

    return cap_per_page(_greedy(tables, alike.select("left_id", "right_id"), lambda a, b: iou_py(a, b) > overlap))


def _greedy(tables: DataFrame, alike: DataFrame, near) -> DataFrame:
    both = alike.union(alike.select("right_id", "left_id"))
    links = both.groupBy(F.col("left_id").alias("table_id")).agg(F.collect_set("right_id").alias("like"))  # a page's tables
    rows = tables.join(by_merge(links), "table_id", "left")
    schema = tables.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "table_id"], ascending=[False, True])
        kept: list[dict] = []
        for r in pdf.to_dict("records"):
            like = set(r["like"]) if r["like"] is not None else set()
            if not any(k["table_id"] in like and near(k, r) for k in kept):
                kept.append(r)
        return pd.DataFrame(kept, columns=pdf.columns)[schema.names]

    return rows.groupBy("doc_id", "page").applyInPandas(run, schema)


def stitch(tables: DataFrame, headers: DataFrame) -> DataFrame:
    """Continued tables joined in pairs: adds part_of (the table a continuation was joined to) and the method and confidence of the joint.

    ``headers``: table_id and the array of lower-cased names. Neighbours in page order; a joined pair takes no third.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "table_id")
    rows = tables.join(headers, "table_id").withColumns({"next_page": F.lead("page").over(w), "next_cols": F.lead("n_cols").over(w), "next_names": F.lead("names").over(w)})
    fits = F.col("next_page").isNotNull() & (F.col("next_page") - F.col("page")).isin(0, 1) & (F.col("next_cols") == F.col("n_cols")) & (header_similarity(F.col("names"), F.col("next_names")) > 0.7)
    rows = rows.select("doc_id", "page", "table_id", "confidence", "method", F.coalesce(fits, F.lit(False)).alias("fits"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "table_id"], ignore_index=True)
        out, i = [], 0
        while i < len(pdf):
            a = pdf.iloc[i]
            if a["fits"] and i + 1 < len(pdf):
                b = pdf.iloc[i + 1]
                out += [(a["doc_id"], a["table_id"], a["table_id"], f"{a['method']}-merged", max(a["confidence"], b["confidence"])), (a["doc_id"], b["table_id"], a["table_id"], f"{a['method']}-merged", max(a["confidence"], b["confidence"]))]
                i += 2
            else:
                out.append((a["doc_id"], a["table_id"], a["table_id"], a["method"], a["confidence"]))
                i += 1
        return pd.DataFrame(out, columns=["doc_id", "table_id", "part_of", "method", "confidence"])

    return rows.groupBy("doc_id").applyInPandas(run, "doc_id string, table_id string, part_of string, method string, confidence double")


def drop_empty(cells: DataFrame) -> DataFrame:
    """Trimmed cells without rows and columns that are empty throughout."""
    c = cells.withColumn("value", F.nullif(F.trim("value"), F.lit("")))
    rows = c.filter("value is not null").select(*ROW).distinct()
    cols = c.filter("value is not null").select(*COLUMN).distinct()
    return c.join(rows, ROW, "left_semi").join(cols, COLUMN, "left_semi")


def is_header(cells: DataFrame, sample: int = 5) -> DataFrame:
    """Whether a table's first row looks like a header: less than half as numeric as the rows after it."""
    digits = F.when(F.regexp_replace("value", r"\.", "").rlike(r"^\d+$"), 1).otherwise(0)
    g = cells.filter(F.col("row_idx") <= sample).groupBy("table_id").agg(F.avg(F.when(F.col("row_idx") == 0, digits)).alias("head"), F.avg(F.when(F.col("row_idx") > 0, digits)).alias("body"))
    return g.select("table_id", F.coalesce(F.col("head") < 0.5 * F.col("body"), F.lit(False)).alias("is_header"))


def weigh(tables: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Confidence times the weight of the method."""
    m = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v))))
    return tables.withColumn("confidence", F.col("confidence") * F.coalesce(F.try_element_at(m, F.col("method")), F.lit(1.0)))


def timeout_factor(complexity: Column) -> Column:
    return F.least(F.greatest(complexity * 1.8, F.lit(1.0)), F.lit(2.5))


def fall_back(main: DataFrame, other: DataFrame, key: str = "doc_id") -> DataFrame:
    """Results, and for keys without any those of another method."""
    return main.unionByName(other.join(main.select(key).distinct(), key, "left_anti"))


def search(cells: DataFrame, query: str) -> DataFrame:
    """Cells that hold the query, in any case, with their place."""
    return cells.filter(F.contains(F.lower("value"), F.lit(query.lower()))).select("table_id", "page", "row_idx", "col_idx", "col_name", "value")


def profile(cells: DataFrame) -> DataFrame:
    """Per table, and over all (null table_id): rows, columns, cells and share of empty ones, in one pass."""
    g = cells.withColumn("r", F.concat_ws("/", "table_id", "row_idx")).withColumn("c", F.concat_ws("/", "table_id", "col_idx"))
    out = g.rollup("table_id").agg(F.count_distinct("r").alias("n_rows"), F.count_distinct("c").alias("n_cols"), F.count("*").alias("n_cells"), F.round(100 * F.count_if(F.col("value").isNull()) / F.count("*"), 2).alias("null_pct"))
    return out


def numeric_profile(cells: DataFrame) -> DataFrame:
    n = number(F.col("value"))
    g = cells.groupBy("table_id", "col_name").agg(F.count(n).alias("numbers"), F.count("value").alias("filled"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.median(n).alias("median"))
    return g.filter("numbers = filled and numbers > 0").drop("filled")


def separator(lines: DataFrame) -> DataFrame:
    """(doc_id, line) -> the separator with most occurrences, the first of equals; ``whitespace`` if there is none."""
    counts = [F.sum(F.length("line") - F.length(F.translate("line", s, ""))).alias(f"s{i}") for i, s in enumerate(SEPARATORS)]
    g = lines.groupBy("doc_id").agg(*counts)
    best = F.greatest(*(F.col(f"s{i}") for i in range(len(SEPARATORS))))
    out = F.lit("whitespace")
    for i, s in reversed(list(enumerate(SEPARATORS))):
        out = F.when((best > 0) & (F.col(f"s{i}") == best), s).otherwise(out)
    return g.select("doc_id", out.alias("separator"))


def guess_columns(line: Column) -> Column:
    """Three spaces part columns; without any, single spaces do."""
    wide = F.filter(F.transform(F.split(line, " {3}"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(wide) > 1, wide).otherwise(F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != ""))


def square_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, row_idx, parts) -> parts cut or padded to the document's most frequent width, the largest of equals."""
    widths = lines.groupBy("doc_id", F.size("parts").alias("w")).agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max_by("w", F.struct("n", "w")).alias("width"))
    padded = F.slice(F.concat("parts", F.array_repeat(F.lit(""), F.col("width"))), F.lit(1), F.col("width"))
    return lines.join(widths, "doc_id").select("doc_id", "row_idx", padded.alias("parts"))


def band_rows(cells: DataFrame, tolerance: int = 10) -> DataFrame:
    """(doc_id, x, y) -> row number: a row's anchor is its first cell, and takes cells up to ``tolerance`` below it.

    The anchor depends on the one before, so cells of a page, sorted, are folded in its own row.
    """
    sorted_ = cells.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("c"))  # one page's cells
    start = F.struct(F.lit(-(2**30)).alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<struct<y:int,x:int,row:int>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        fresh = c["y"] > acc["anchor"] + tolerance
        row = acc["row"] + F.when(fresh, 1).otherwise(0)
        return F.struct(F.when(fresh, c["y"]).otherwise(acc["anchor"]).alias("anchor"), row.alias("row"), F.array_append(acc["out"], F.struct(c["y"].alias("y"), c["x"].alias("x"), row.alias("row"))).alias("out"))

    return sorted_.select("doc_id", F.inline(F.aggregate("c", start, step)["out"]))


def cluster_lines(points: DataFrame, gap: int = 5) -> DataFrame:
    """(doc_id, v) -> clusters of values at most ``gap`` apart in a chain, each with its whole mean."""
    w = Window.partitionBy("doc_id").orderBy("v")
    cut = F.when(F.col("v") - F.lag("v").over(w) > gap, 1).otherwise(0)
    return points.withColumn("cut", cut).withColumn("cluster", F.sum("cut").over(w)).groupBy("doc_id", "cluster").agg(F.floor(F.avg("v")).alias("centre"), F.count("*").alias("n"))


def page_indexes(spec: Column, n_pages: Column) -> Column:
    """``all`` or ``1,3,5-7`` -> page numbers from 0."""
    parts = F.transform(F.split(spec, ","), lambda p: F.split(F.trim(p), "-"))
    ranges = F.transform(parts, lambda p: F.sequence(F.element_at(p, 1).cast("int") - 1, F.element_at(p, -1).cast("int") - 1))
    return F.when(spec == "all", F.sequence(F.lit(0), n_pages - 1)).otherwise(F.flatten(ranges))


def near_duplicate_columns(cells: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs of columns of a table whose cells are equal in so many rows."""
    a = cells.select("table_id", "row_idx", F.col("col_idx").alias("left_col"), F.col("value").alias("a"))
    b = cells.select("table_id", "row_idx", F.col("col_idx").alias("right_col"), F.col("value").alias("b"))
    g = a.join(b, ROW).filter("left_col < right_col").groupBy("table_id", "left_col", "right_col").agg((F.count_if(F.col("a").eqNullSafe(F.col("b"))) / F.count("*")).alias("share"))
    return g.filter(F.col("share") > threshold)


def optimize(cells: DataFrame) -> DataFrame:
    """Values cleaned, headers cleaned, fragments merged."""
    names = clean_headers(cells.select("table_id", "col_idx", "col_name").distinct()).select("table_id", "col_idx", "header")
    c = clean_values(cells).join(by_merge(names), COLUMN).drop("col_name").withColumnRenamed("header", "col_name")
    return merge_fragments(c.select("table_id", "page", "row_idx", "col_idx", "col_name", "value"))


def sane(cells: DataFrame) -> DataFrame:
    """Tables that are none: too small, over four fifths empty, or a long list with one column of all distinct values beside columns of another kind."""
    t = column_types(cells).groupBy("table_id").agg(F.count_if(F.col("type").isin("integer", "float")).alias("numeric"), F.count_if(F.col("type") == "text").alias("text"))
    distinct = cells.groupBy(*COLUMN).agg(F.count_distinct("value").alias("u")).groupBy("table_id").agg(F.max("u").alias("most"))
    empty = cells.groupBy("table_id").agg((F.count_if(F.col("value").isNull()) / F.count("*")).alias("empty"))
    g = shape(cells).join(t, "table_id").join(distinct, "table_id").join(empty, "table_id")
    uneven = ((F.col("numeric") == 1) & (F.col("text") > 3)) | ((F.col("text") == 1) & (F.col("numeric") > 3))
    listing = uneven & (F.col("most") == F.col("n_rows")) & (F.col("n_rows") > 4)
    return g.select("table_id", ((F.col("n_rows") >= 2) & (F.col("n_cols") >= 2) & (F.col("empty") <= 0.8) & ~listing).alias("sane"))


def process(cells: DataFrame) -> DataFrame:
    """Sound tables, mended and optimised: what an extraction hands on."""
    path = work_dir(cells.sparkSession, "cells")  # several steps read the mended cells
    validate(cells).select("table_id", "page", "row_idx", "col_idx", "col_name", "value").write.parquet(path)
    return optimize(cells.sparkSession.read.parquet(path))


def with_status(tables: DataFrame, processed: DataFrame) -> DataFrame:
    """(table_id) of an extraction with its outcome: kept or rejected."""
    kept = processed.select("table_id").distinct().withColumn("k", F.lit(True))
    return tables.join(kept, "table_id", "left").select("table_id", F.when(F.col("k"), "kept").otherwise("rejected").alias("status"))
