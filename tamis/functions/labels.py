"""Names of form fields from the text around a box."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of field names in their order, and words that name nothing.
PATTERNS = [
    r"(?i)(?:^|\s)([A-Za-z][A-Za-z0-9_]{3,30})(?:\s*[:=])",
    r"(?i)(?:champ|field|input|form|formulaire|question)(?:\s*[:=]\s*)([A-Za-z][A-Za-z0-9_]{3,30})",
    r"(?i)\[([A-Za-z][A-Za-z0-9_]{3,30})\]",
]
STOP = ["champ", "field", "input", "form", "the", "les", "des", "pour"]
PARAGRAPHS, MOST_CHARS, PAGE_HEIGHT = 2, 800, 1000.0


def _squeeze(text: Column, noise: str) -> Column:
    out = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    for p in (r"(?U)(\s|^)[^\w\s]{1,2}(\s|$)", r"\s+") if noise == "" else (r"(?U)(\s|^)[^\w\s]{1,2}(\s|$)", r"\s+", noise):
        out = F.regexp_replace(out, p, " ")
    return out


def _name(context: Column, word_pattern: str, least: int) -> Column:
    def usable(found: Column) -> Column:
        bare = F.regexp_replace(F.lower(found), "[^a-z0-9_]", "")
        return F.when(~F.lower(found).isin(STOP) & (F.length(bare) >= 3), bare)

    named = F.coalesce(*(usable(F.nullif(F.regexp_extract(context, p, 1), F.lit(""))) for p in [*PATTERNS, word_pattern]))
    words = F.transform(F.split(context, r"\s+"), lambda w: F.regexp_replace(w, "[^a-zA-Z0-9]", ""))
    first = F.try_element_at(F.filter(words, lambda w: (F.length(w) >= least) & ~w.rlike(r"^\d+$")), F.lit(1))
    letters = F.lower(F.regexp_replace(F.substring(context, 1, 20), r"[^\p{L}]", ""))
    return F.coalesce(
        named, F.substring(F.lower(first), 1, 30), F.when((F.length(context) >= 3) & (F.length(letters) >= 3), letters),
        F.concat(F.lit("checkbox_"), F.pmod(F.xxhash64(context), F.lit(1000)).cast("string")),
    )


def label(context: Column) -> Column:
    """Label of a box; empty without a context. The last resort numbers the context by a hash."""
    c = _squeeze(context, r"(\s|^)[a-zA-Z0-9]{1,2}(\s|$)")
    return F.when(F.coalesce(context, F.lit("")) == "", "").otherwise(_name(c, r"(?i)\b([A-Za-z][A-Za-z]{2,}[A-Za-z0-9_]*)\b", 3))


def field_name(text: Column) -> Column:
    """Name of a form field; empty for texts under three characters."""
    c = F.regexp_replace(_squeeze(text, r"(\s|^)\d{1,2}(\s|$)"), r"\s+", " ")
    return F.when(F.length(F.coalesce(text, F.lit(""))) < 3, "").otherwise(_name(c, r"(?i)\b([A-Za-z][A-Za-z]{3,}[A-Za-z0-9_]*)\b", 4))


def nearby_text(page_text: Column, y: Column) -> Column:
    """Paragraphs around the height ``y`` of a page, cut at 800 characters."""
    parts = F.split(page_text, "\n\n")
    at = F.least(F.floor(y / PAGE_HEIGHT * F.size(parts)), F.size(parts) - 1)
    low = F.greatest(F.lit(0), at - PARAGRAPHS)
    text = F.array_join(F.slice(parts, (low + 1).cast("int"), (at + PARAGRAPHS + 1 - low).cast("int")), "\n")
    return F.when(F.coalesce(page_text, F.lit("")) == "", "").otherwise(F.trim(F.when(F.length(text) > MOST_CHARS, F.concat(F.substring(text, 1, MOST_CHARS), F.lit("..."))).otherwise(text)))
