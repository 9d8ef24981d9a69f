"""Text cleaning, sections, fragments and chunks, as column expressions and narrow DataFrame steps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Clean-up patterns in their order (all with dot-matches-newline, multi-line, ignore case).
CLEANUP = [
    (r"Tél : [\d\.-]+", ""),
    (r"CMA\d+_rev\d+\s.*?\bOrganisme déclaré sous le n°\d+.*?\n", ""),
    (r"^Page \d+ sur \d+$", ""),
    (r"=== Page \d+ ===", ""),
    (r"Historique des révisions.*", ""),
    (r"Droit de reproduction.*", ""),
    (r"Responsabilité.*", ""),
    (r"\s{2,}", " "),
    (r"^\s+", ""),
    (r"\s+$", ""),
    (r"\n{3,}", "\n\n"),
    (r"<\|\w+\|>.*?</\|\w+\|>", ""),
    (r"Droit de reproduction.*?\n", ""),
    (r"Responsabilité.*?\n", ""),
]
# What opens a section, and words of action.
SECTION_MARKERS = [
    r"^(?:Pour|Comment)\s+[a-zéèêë].*?$",
    r"^(?:\d+[\).]|[-•])\s+.*$",
    r"^(?:Étape|Phase|Partie)\s+.*:?$",
    r"^.*?\b(?:cliquez|sélectionnez|renseignez|faites)\b.*$",
]
ACTION_WORDS = r"\b(?:cliquez|sélectionnez|renseignez|faites)\b"
CHUNK_SIZE, CHUNK_OVERLAP = 1500, 150


def lines_of(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def clean(text: Column, letterheads: tuple[tuple[str, str], ...] = ()) -> Column:
    """All clean-up patterns in order, then trimmed lines without blank ones.

    ``letterheads`` are (name, town) of page headers that go first: from ``name –`` to the end of the line with the town.
    """
    heads = [(rf"{re.escape(name)}\s*–\s*.*?{re.escape(town)}.*?\n", "") for name, town in letterheads]
    out = F.coalesce(text, F.lit(""))
    for pattern, by in [*heads, *CLEANUP]:
        out = F.regexp_replace(out, F.lit(f"(?imsu){pattern}"), F.lit(by))
    return F.array_join(lines_of(out), "\n")


def revision(title: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(title), r"rev(\d+)", 1), F.lit("")), F.lit("00"))


def metadata(author: Column, title: Column, created: Column) -> Column:
    return F.struct(F.trim(F.coalesce(author, F.lit(""))).alias("author"), revision(F.coalesce(title, F.lit(""))).alias("revision"), F.coalesce(created, F.lit("")).alias("date"), F.lit("documentation").alias("source"))


def opens_section(line: Column) -> Column:
    out = F.lit(False)
    for p in SECTION_MARKERS:
        out = out | line.rlike(f"(?iu){p}")
    return out


def sections(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """doc_id, section_idx (from 0), content: a new section starts at every marker line but the first line.

    Lines are folded into sections inside their row, so no line leaves its document and nothing is shuffled.
    """
    flagged = F.transform(lines_of(F.col(text_col)), lambda x: F.struct(x.alias("line"), opens_section(x).alias("open")))
    start = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc)
        grown = F.concat(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc, n), F.lit("\n"), x["line"])))
        return F.when((n == 0) | x["open"], F.concat(acc, F.array(x["line"]))).otherwise(grown)

    return docs.select("doc_id", F.posexplode(F.aggregate(flagged, start, step)).alias("section_idx", "content"))


def score_section(content: Column, idx: Column) -> dict[str, Column]:
    actions = F.regexp_count(F.lower(content), F.lit(f"(?U){ACTION_WORDS}"))
    steps = F.regexp_count(content, F.lit(r"(?m)^\d+[.)]"))
    size = F.length(content)
    score = actions * 0.2 + steps * 0.15 + F.greatest(F.lit(0.0), 1 - idx * 0.1) + F.when((size > 100) & (size < 1000), 0.1).otherwise(0.0)
    return {
        "title": F.trim(F.substring(F.substring_index(content, "\n", 1), 1, 100)), "importance_score": F.least(F.lit(1.0), score),
        "word_count": F.size(F.filter(F.split(content, r"\s+"), lambda w: w != "")), "has_steps": steps > 0, "has_actions": actions > 0,
    }


def scored_sections(docs: DataFrame, text_col: str = "content") -> DataFrame:
    rows = sections(docs, text_col)
    return rows.withColumns(score_section(F.col("content"), F.col("section_idx")))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def query_relevance(content: Column, query: Column) -> Column:
    """Share of the query's distinct words that the content holds."""
    q = F.array_distinct(words(query))
    return F.size(F.array_intersect(q, words(content))) / F.greatest(F.size(q), F.lit(1))


def keyword_positions(text: Column, keyword: Column) -> Column:
    """Places (from 0) of a keyword, overlapping ones too. The text is cut before every place, so the work is one pass."""
    t, k = F.lower(text), F.lower(keyword)
    pieces = F.split(t, F.concat(F.lit(r"(?=\Q"), k, F.lit(r"\E)")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.when((acc["at"] > 0) | F.startswith(t, k), F.array_append(acc["out"], acc["at"])).otherwise(acc["out"]).alias("out"))
    return F.when(F.length(k) > 0, F.aggregate(pieces, start, step)["out"]).otherwise(F.array().cast("array<int>"))


def keyword_count(text: Column, keyword: Column) -> Column:
    """Occurrences that do not overlap."""
    return (F.length(text) - F.length(F.replace(text, keyword))) / F.length(keyword)


def keyword_relevance(text: Column, keywords: list[str]) -> Column:
    t = F.lower(text)
    n = F.greatest(F.size(words(text)), F.lit(1))
    total = F.lit(0.0)
    for k in keywords:
        total = total + keyword_count(t, F.lit(k.lower())) * (100 / n)
    return F.least(total / len(keywords), F.lit(1.0))


def fragments(pages: DataFrame, keywords: list[str], context: int = 200, around: int = 100) -> DataFrame:
    """(doc_id, page, text) -> one row per keyword place: its text, what stands before and after, and its relevance.

    Long texts are first cut to those that hold the keyword at all; places are found inside the row.
    """
    rows = pages.select("*", F.explode(F.array(*map(F.lit, keywords))).alias("keyword")).filter(F.contains(F.lower("text"), F.lower("keyword")))
    rows = rows.select("*", F.explode(keyword_positions(F.col("text"), F.col("keyword"))).alias("pos"))
    start = F.greatest(F.lit(0), F.col("pos") - context)
    end = F.least(F.length("text"), F.col("pos") + F.length("keyword") + context)
    rows = rows.withColumns({"start": start, "end": end})
    cut = lambda a, b: F.substr(F.col("text"), a + 1, b - a)
    before = F.greatest(F.lit(0), F.col("start") - around)
    fragment = cut(F.col("start"), F.col("end"))
    return rows.select("doc_id", "page", "keyword", "pos", fragment.alias("fragment"), cut(before, F.col("start")).alias("context_before"), cut(F.col("end"), F.least(F.length("text"), F.col("end") + around)).alias("context_after"), keyword_relevance(fragment, keywords).alias("confidence"))


def chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text_col: str = "content") -> DataFrame:
    """doc_id, chunk_index, content, chunk_size: pieces of ``size`` characters that share ``overlap`` with the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the size")
    n = F.length(text_col)
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / (size - overlap)) - 1)
    rows = docs.filter(n > 0).select("doc_id", F.col(text_col).alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_index"))
    piece = F.substr(F.col("t"), (F.col("chunk_index") * (size - overlap) + 1).cast("int"), F.lit(size))
    return rows.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), piece.alias("content"), F.length(piece).alias("chunk_size"))


def strip_html(html: Column) -> Column:
    """Text of a page: comments, scripts, styles and tags out, white space single."""
    out = html
    for p in (r"(?s)<!--.*?-->", r"(?is)<(script|style)\b.*?</\1\s*>", r"(?s)<[^>]*>", r"\s+"):
        out = F.regexp_replace(out, p, " ")
    return F.trim(out)


def links_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)


def summary_input(docs: DataFrame, group: str, limit: int = 1024) -> DataFrame:
    """Per group ``[Source: app]`` and content of its documents, joined and cut. Only the leading documents that can show are gathered."""
    w = Window.partitionBy(group).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    text = F.concat(F.lit("[Source: "), F.coalesce("application", F.lit("unknown")), F.lit("]\n"), F.trim("content"))
    rows = docs.filter(F.trim("content") != "").select(group, "doc_id", F.substring(text, 1, limit).alias("x"))
    # a document takes 17 characters at least, so later ones can't show: ranks are cut within tasks, before a large group moves
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("doc_id"))).filter(F.col("rank") <= limit // 17 + 1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("x") + 5).over(w), F.lit(0))).filter(F.col("before") < limit)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "x"))), lambda s: s["x"])
    return rows.groupBy(group).agg(F.substring(F.array_join(listed, "\n---\n"), 1, limit).alias("summary_input"))


def md5_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def token_proxy(text: Column) -> Column:
    """White-space words, where no tokenizer is plugged in."""
    return F.size(words(text))
