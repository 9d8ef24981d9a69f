"""Tokens for lexical search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elided articles, and French stop words (a published list's core).
ELISIONS = ["l", "m", "t", "qu", "n", "s", "j", "d", "c"]
STOP_WORDS = (
    "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas "
    "pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y est sont a ont"
).split()


def ascii_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits: the rule every engine shares."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def standard_tokens(text: Column) -> Column:
    """Lower-cased words with inner apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"), 0)


def strip_elision(token: Column) -> Column:
    marked = F.contains(token, F.lit("'")) | F.contains(token, F.lit("’"))
    return F.when(marked, F.regexp_replace(token, f"^(?:{'|'.join(ELISIONS)})['’]", "")).otherwise(token)


def _without(t: Column, n: int) -> Column:
    return F.substr(t, F.lit(1), F.length(t) - n)


#: Plural, feminine and accent folding of French words in a light way: -aux to -al, then final s or x, e, accents, doubled letters.
_STEPS = [
    lambda t: F.when((F.length(t) > 4) & F.endswith(t, F.lit("aux")), F.concat(_without(t, 2), F.lit("l"))).otherwise(t),
    lambda t: F.when((F.length(t) > 3) & (F.endswith(t, F.lit("s")) | F.endswith(t, F.lit("x"))), _without(t, 1)).otherwise(t),
    lambda t: F.when((F.length(t) > 3) & F.endswith(t, F.lit("e")), _without(t, 1)).otherwise(t),
    lambda t: F.translate(t, "àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc"),
    lambda t: F.when((F.length(t) > 4) & (F.right(t, F.lit(1)) == F.substr(t, F.length(t) - 1, F.lit(1))), _without(t, 1)).otherwise(t),
]


def light_stems(tokens: Column, keep: list[str] | None = None) -> Column:
    """Stems of an array of words; words in ``keep`` stay. One pass per step, so that no step is worked out more than once."""
    if keep:
        return F.transform(tokens, lambda t: F.when(t.isin(keep), t).otherwise(F.element_at(light_stems(F.array(t)), 1)))
    for step in _STEPS:
        tokens = F.transform(tokens, step)
    return tokens


def french_tokens(text: Column, keep: list[str] | None = None) -> Column:
    """Standard tokens, elisions off, stop words out, lightly stemmed; words in ``keep`` are not stemmed."""
    bare = F.transform(standard_tokens(text), strip_elision)
    return light_stems(F.filter(bare, lambda t: ~t.isin(STOP_WORDS) & (F.length(t) > 0)), keep)
