"""Row-wise text expressions (T1–T4, T15, N1).  All are built-in Spark
functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from aspectra.functions.ops import bound
from aspectra.lexicons import in_words

# Java regex: \w is ASCII only, so Unicode word characters are spelled out.
NON_WORD = r"[^\p{L}\p{N}_\s\-]"

# A run of white space other than one blank, which would be replaced by itself.
GAP = r"\s{2,}|[^\S ]"

# Other than [a-z0-9], white space and .,!? — listed one by one, Java finds a character by its bit;
# ranges are tried one after the other.
NOT_LIGHT = r"[^abcdefghijklmnopqrstuvwxyz0123456789 \t\n\x0B\f\r.,!?]"

# Fixed value: check marks, smileys, heart, variation selector, star and the U+2600–U+26FF block.
SYMBOLS = r"[\x{2705}\x{2714}\x{2713}\x{263A}\x{2639}\x{2764}\x{FE0F}\x{2605}\x{2600}-\x{26FF}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ws(c) -> Column:
    """lower(trim(collapse whitespace))."""
    return F.lower(F.trim(F.regexp_replace(_c(c), GAP, " ")))


def normalize_light(c) -> Column:
    """Lower; keep [a-z0-9], whitespace and .,!?; collapse whitespace."""
    t = F.regexp_replace(F.lower(_c(c)), NOT_LIGHT, " ")
    return F.trim(F.regexp_replace(t, GAP, " "))


def clean_words(c) -> Column:
    """Null / '' / 'nan' -> ''; non-word characters (hyphen kept) -> space; runs of
    whitespace and hyphens -> one space."""
    x = _c(c)
    t = F.regexp_replace(F.lower(x), NON_WORD, " ")
    t = F.trim(F.regexp_replace(t, r"[\s\-]+", " "))
    return F.when(x.isNull() | (x == "") | (F.lower(x) == "nan"), F.lit("")).otherwise(t)


def symbol_cleanup(c) -> Column:
    """T4: check marks, hearts, stars and the U+2600–U+26FF block, runs of '+' and
    ellipses become sentence ends; whitespace collapsed."""
    t = F.regexp_replace(_c(c), SYMBOLS, ". ")
    t = F.regexp_replace(t, r"\+{2,}", ". ")
    t = F.regexp_replace(t, r"\x{2026}+", ". ")
    return F.trim(F.regexp_replace(t, GAP, " "))


def tokens(c) -> Column:
    """Whitespace tokens of an already-cleaned text ('' -> empty array)."""
    return bound(_c(c), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " ")))


def valid_word(w: Column, stop: Iterable[str], irrelevant: Iterable[str]) -> Column:
    """At least 2 characters, not a stop or irrelevant word, not all digits,
    at most half of its characters digits."""
    n_digits = F.length(F.regexp_replace(w, r"[^0-9]", ""))
    return (
        (F.length(w) >= 2)
        & ~in_words(w, stop)
        & ~in_words(w, irrelevant)
        & ~w.rlike(r"^[0-9]+$")
        & (n_digits * 2 <= F.length(w))
    )


def generic_phrase(c, generic: Iterable[str]) -> Column:
    """Empty phrase, or every whitespace token in the generic list."""
    x = F.trim(_c(c))
    toks = F.split(x, r"\s+")
    return F.when(x == "", F.lit(True)).otherwise(F.forall(toks, lambda t: in_words(t, generic)))
