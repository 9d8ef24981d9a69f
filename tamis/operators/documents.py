"""Documents from page statistics: complexity, kind, extraction strategy; and whole-document preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import text as T

# Weights and bands (above a bound: its score) of the complexity factors.
WEIGHTS = {"page_count": 0.05, "font_variety": 0.15, "layout_complexity": 0.25, "image_ratio": 0.15, "text_density": 0.15, "table_indicators": 0.25}
PAGE_BANDS = [(100, 1.0), (50, 0.8), (20, 0.6), (5, 0.4)]
FONT_BANDS = [(10, 1.0), (5, 0.7), (2, 0.4)]
LAYOUT_BANDS = [(30, 1.0), (20, 0.8), (10, 0.5)]
IMAGE_BANDS = [(0.5, 1.0), (0.2, 0.7), (0.1, 0.4)]
TEXT_BANDS = [(5000, 1.0), (2500, 0.8), (1000, 0.5)]
LINE_BANDS, RECT_BANDS = [(20, 1.0), (10, 0.7), (5, 0.4)], [(10, 1.0), (5, 0.7), (2, 0.4)]
KIND_WEIGHTS = {"text": 0.5, "font": 0.25, "image": 0.15, "line": 0.1}
# Strategies by kind, with weight and base seconds.
STRATEGIES = {
    "scanned": [("ocr", 1.2, 90.0)],
    "hybrid": [("camelot", 1.1, 30.0), ("tabula", 0.9, 25.0), ("pdfplumber", 0.8, 20.0), ("ocr", 0.7, 60.0)],
    "digital": [("camelot", 1.1, 25.0), ("tabula", 1.0, 20.0), ("pdfplumber", 0.8, 15.0)],
}


def band(x: Column, bands: list[tuple[float, float]], low: float) -> Column:
    out = F.lit(low)
    for bound, score in reversed(bands):
        out = F.when(x > bound, score).otherwise(out)
    return out


def complexity(pages: DataFrame) -> DataFrame:
    """(doc_id, page, chars, words, fonts array, elements, images, lines, rects) -> doc_id, n_pages, complexity."""
    fonts = pages.select("doc_id", F.explode_outer("fonts").alias("font")).groupBy("doc_id").agg(F.count_distinct("font").alias("n_fonts"))
    g = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum("images").alias("images"), F.sum("chars").alias("chars"), *(F.avg(c).alias(c) for c in ("elements", "lines", "rects")), F.avg("chars").alias("avg_chars"))
    f = {
        "page_count": band(F.col("n_pages"), PAGE_BANDS, 0.2), "font_variety": band(F.col("n_fonts"), FONT_BANDS, 0.2), "layout_complexity": band(F.col("elements"), LAYOUT_BANDS, 0.3),
        "image_ratio": F.when((F.col("images") > 0) & (F.col("chars") > 0), band(F.col("images") / (F.col("chars") / 1000), IMAGE_BANDS, 0.2)).otherwise(0.0),
        "text_density": band(F.col("avg_chars"), TEXT_BANDS, 0.3), "table_indicators": F.greatest(band(F.col("lines"), LINE_BANDS, 0.2), band(F.col("rects"), RECT_BANDS, 0.2)),
    }
    total = F.lit(0.0)
    for k, w in WEIGHTS.items():
        total = total + f[k] * w
    return g.join(fonts, "doc_id").select("doc_id", "n_pages", total.alias("complexity"))


def kind(pages: DataFrame) -> DataFrame:
    """doc_id, kind (scanned, digital, hybrid) and how sure: mean page scores of text, fonts, images and lines, weighted."""
    words = F.col("words")
    text = F.when(F.col("chars") < 50, 0.9).otherwise(F.least(F.lit(1.0), words / 500))
    text = F.when((words > 20) & (F.coalesce("word_variance", F.lit(0.0)) > 10), F.least(F.lit(0.8), text + 0.3)).otherwise(text)
    font = F.when(F.size("fonts") > 3, 0.2).when(F.size("fonts") > 0, 0.7).otherwise(0.9)
    image = F.when(F.col("images") > 0, 0.8).otherwise(0.2)
    line = F.least(F.lit(1.0), F.col("lines") / 100)
    score = F.lit(0.0)
    for c, w in zip((text, font, image, line), KIND_WEIGHTS.values()):
        score = score + F.avg(c) * w
    g = pages.groupBy("doc_id").agg(score.alias("score"))
    s = F.col("score")
    return g.select("doc_id", F.when(s > 0.65, "scanned").when(s < 0.35, "digital").otherwise("hybrid").alias("kind"), F.when(s > 0.65, s).when(s < 0.35, 1 - s).otherwise(0.5).alias("confidence"))


def strategy(kind_: Column, sure: Column, complexity_: Column, enhanced: bool = True, detector: bool = False) -> Column:
    """The extraction strategy: scanned for certain, complex, simple, else what is at hand."""
    best = F.lit("enhanced") if enhanced else None
    return (
        F.when((kind_ == "scanned") & (sure > 0.8), best if enhanced else F.lit("ocr")).when(complexity_ > 0.6, best if enhanced else F.lit("camelot"))
        .when(complexity_ < 0.3, "tabula").otherwise(best if enhanced else F.lit("ai" if detector else "hybrid"))
    )


def strategy_plan(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, complexity) -> one row per strategy to run: weight, and seconds stretched by the complexity."""
    rows = F.lit(None).cast("array<struct<method:string,weight:double,seconds:double>>")
    for k, plan in STRATEGIES.items():
        own = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(w).alias("weight"), F.lit(s).alias("seconds")) for m, w, s in plan))
        rows = F.when(F.col("kind") == k, own).otherwise(rows)
    factor = F.least(F.lit(2.5), F.greatest(F.lit(1.0), F.col("complexity") * 1.8))
    out = docs.select("doc_id", "kind", "complexity", factor.alias("factor"), F.inline(rows))
    return out.filter(~((F.col("kind") == "hybrid") & (F.col("method") == "ocr") & (F.col("complexity") >= 0.6))).select("doc_id", "method", "weight", (F.col("seconds") * F.col("factor")).alias("seconds"))


def prepare(docs: DataFrame) -> DataFrame:
    """(doc_id, title, content, author, created) -> cleaned content, metadata and scored sections, best first, one row per document."""
    cleaned = docs.select("doc_id", "title", T.clean(F.col("content")).alias("content"), T.metadata(F.col("author"), F.col("title"), F.col("created")).alias("metadata"))
    rows = T.scored_sections(cleaned)
    listed = F.sort_array(F.collect_list(F.struct("importance_score", (-F.col("section_idx")).alias("order"), "title", "content", "word_count", "has_steps", "has_actions")), asc=False)  # one document's sections
    return cleaned.join(rows.groupBy("doc_id").agg(listed.alias("sections")), "doc_id", "left")
