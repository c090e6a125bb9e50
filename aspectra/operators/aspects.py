"""Clause segmentation, aspect chunks and snippets.

Everything here works inside a review's row: clauses are a ``split`` of the text,
chunks are runs of lexicon-tagged tokens found with array functions, and the
first-occurrence distinct is ``array_distinct`` (which keeps first occurrences in
order).  Only the final ``posexplode`` widens the rows; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra import lexicons as L
from aspectra.functions.ops import bound
from aspectra.functions.text import GAP, normalize_ws
from aspectra.operators.entities import name_marks, names_in, pattern_kinds

#: Ends a run; marks a token of an entity.
SEP, ENTITY = "\u0001", "\u0002"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clause_marked(c, contrast: Iterable[str] = L.CONTRAST_WORDS) -> Column:
    """Text with a separator at every clause start: after ';', after a contrast
    word (which stays in the previous clause), after ', <conjunction>', before a
    capitalised token that follows a comma, and after sentence ends."""
    words = "|".join(contrast)
    t = F.regexp_replace(_c(c), r";\s*", ";" + SEP)
    # contrast word preceded by start or a non-word character (explicit class: the
    # meaning of \b differs between regex engines for non-ASCII letters)
    t = F.regexp_replace(t, r"(?i)(^|[^\p{L}\p{N}_])(" + words + r")\s+", "$1$2" + SEP)
    t = F.regexp_replace(t, r",\s+(and|or|but|nor|yet|so|for)\s+", ", $1" + SEP)
    t = F.regexp_replace(t, r",\s+([A-Z])", "," + SEP + "$1")
    t = F.regexp_replace(t, r"([.!?])\s+", "$1" + SEP)
    return t


def clauses(c, contrast: Iterable[str] = L.CONTRAST_WORDS) -> Column:
    """Array of trimmed, non-empty clauses in order."""
    parts = F.split(clause_marked(c, contrast), SEP)
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, GAP, " "))), lambda p: p != "")


def segment(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """T16 as rows: (key, clause_pos, clause)."""
    return df.select(key, F.posexplode(clauses(text_col)).alias("clause_pos", "clause")).select(
        key, F.col("clause_pos").cast("long"), "clause")


# ---------------------------------------------------------------------------
# A1–A3: chunks
# ---------------------------------------------------------------------------

def clause_tokens(clause: Column) -> Column:
    """Lower-case tokens; other than letters, digits, hyphens and apostrophes become a ``|`` of their own."""
    toks = F.split(F.regexp_replace(F.lower(clause), r"[^\p{L}\p{N}\s'-]", " | "), r"\s+")
    return F.filter(toks, lambda t: t != "")


def chunk_phrases(clause: Column, adjectives: Iterable[str], nouns: Iterable[str],
                  determiners: Iterable[str] = ("the", "a", "an", "this", "that", "these", "those", "my", "our",
                                                "your", "their", "his", "her", "its"),
                  stop_aspects: Iterable[str] = L.STOP_ASPECTS, informative: bool = False,
                  names: Column | None = None) -> Column:
    """A1 (re-aimed noun chunks): maximal runs of determiner / adjective / noun tokens
    (tags from the word lists; punctuation ends a run) that contain a noun; phrase =
    normalised run text.  Dropped: empty, stop aspects, length <= 2; distinct in order.
    ``informative`` (A2): a chunk also needs >= 2 alphabetic tokens, not only determiners, and
    no token of a number, date, time or quantity, or of one of ``names`` (arrays of tokens); such
    tokens belong to the run they stand in."""
    nouns, determiners, stop_aspects = list(nouns), list(determiners), list(stop_aspects)
    in_run = [*adjectives, *nouns, *determiners]

    def chunks(toks):
        marked = F.transform(toks, lambda t: F.when(L.in_words(t, in_run), t).otherwise(F.lit(SEP)))
        if informative:
            entity = F.transform(pattern_kinds(toks), lambda k: k.isNotNull())
            if names is not None:
                entity = F.zip_with(entity, name_marks(toks, names), lambda a, b: a | b)
            marked = F.zip_with(marked, F.zip_with(toks, entity, lambda t, e: F.when(e, F.concat(F.lit(ENTITY), t))), lambda m, e: F.coalesce(e, m))
        runs = F.filter(F.split(F.array_join(marked, " "), SEP), lambda r: F.trim(r) != "")
        if informative:
            runs = F.filter(runs, lambda r: ~r.contains(ENTITY))
        runs = F.transform(runs, lambda r: normalize_ws(r))
        runs = F.filter(runs, lambda r: F.exists(F.split(r, " "), lambda t: L.in_words(t, nouns)))
        keep = F.filter(runs, lambda r: (r != "") & ~L.in_words(r, stop_aspects) & (F.length(r) > 2))
        if informative:
            keep = F.filter(keep, lambda r: (F.size(F.filter(F.split(r, " "), lambda t: t.rlike(r"^\p{L}+$"))) >= 2)
                            & ~F.forall(F.split(r, " "), lambda t: L.in_words(t, determiners)))
        return F.array_distinct(keep)

    return bound(clause_tokens(clause), chunks)


def _words(clause: Column) -> Column:
    return F.split(F.trim(clause), r"\s+")


def _head(w: Column, n: int) -> Column:
    head = F.array_join(F.slice(w, 1, n), " ")
    return F.when(F.size(w) > n, F.concat(head, F.lit(" ..."))).otherwise(head)


def _window(w: Column, phrase: Column, window: int, cap: int) -> Column:
    def around(idx):
        start = F.greatest(F.lit(0), idx - window)
        end = F.least(F.size(w), idx + window + 1)
        length = F.least(end - start, F.lit(cap))
        win = F.array_join(F.slice(w, start + 1, length), " ")
        return F.when(idx.isNull(), _head(w, cap)).otherwise(win)

    hit = F.filter(F.transform(w, lambda t, i: F.when(F.lower(t).contains(phrase), i)), lambda x: x.isNotNull())
    return bound(F.try_element_at(hit, F.lit(1)), around)  # 0-based index of the first match


def _centered(w: Column, n: int) -> Column:
    size = F.size(w)
    start = F.greatest(F.lit(0), F.floor(size / 2).cast("int") - n // 2)
    length = F.least(size, start + n) - start
    return F.when(size <= n, F.array_join(w, " ")).otherwise(F.array_join(F.slice(w, start + 1, length), " "))


def _match(w: Column, phrase: Column) -> Column:
    return F.exists(w, lambda t: F.lower(t).contains(phrase))


def snippet_head(clause: Column, n: int) -> Column:
    """A4: first n whitespace words, ' ...' appended when the clause is longer."""
    return bound(_words(clause), lambda w: _head(w, n))


def snippet_window(clause: Column, phrase: Column, window: int = 12, cap: int = 32) -> Column:
    """A5: tokens within +-window of the first token that contains the phrase (or equals
    it, lower-cased), at most ``cap`` tokens; no match -> head snippet of ``cap`` words."""
    return bound(_words(clause), lambda w: _window(w, phrase, window, cap))


def snippet_centered(clause: Column, n: int = 48) -> Column:
    """More than n tokens -> the n tokens centred on the middle token."""
    return bound(_words(clause), lambda w: _centered(w, n))


def token_match(clause: Column, phrase: Column) -> Column:
    """True when one whitespace token of the clause contains the whole phrase."""
    return _match(_words(clause), phrase)


def extract_aspects(df: DataFrame, key: str, text_col: str, adjectives, nouns, *, strict: bool = False,
                    snippet_len: int | None = None, window: int = 12,
                    stop_aspects=L.STOP_ASPECTS, gazetteer: DataFrame | None = None) -> DataFrame:
    """A1–A7 per review: (key, text, aspect_pos, aspect_phrase, aspect_snippet).

    Default (aspect program): chunks per clause; snippet = the clause trimmed to 48
    centred tokens when one token contains the phrase, else the clause head (48 words).
    ``strict`` (trail program): informative chunks only, window snippet +-12 capped at 32; chunks that
    overlap a name of ``gazetteer`` (column ``name``, of undesired kinds where it has a ``kind``; ``key``
    is then unique) are not informative.
    First-occurrence distinct of (phrase, snippet) per review; a review without aspects
    yields ('general', full text).  Blank or null texts yield nothing."""
    n = snippet_len or (32 if strict else 48)
    cl = clauses(F.col(text_col))
    names = None
    if strict and gazetteer is not None:
        names = F.col("_names")
        if "kind" in gazetteer.columns:
            gazetteer = gazetteer.where(F.col("kind").isin(sorted(L.UNDESIRED_ENTITIES)))
        df = df.join(names_in(df, key, clause_tokens(F.col(text_col)), gazetteer, out="_names"), key, "left")

    def per_clause(c):
        ph = chunk_phrases(c, adjectives, nouns, stop_aspects=stop_aspects, informative=strict, names=names)
        if strict:
            snip = lambda w, p: _window(w, p, window, n)
        else:
            snip = lambda w, p: F.when(_match(w, p), _centered(w, n)).otherwise(_head(w, n))
        return bound(_words(c), lambda w: F.transform(ph, lambda p: F.struct(p.alias("phrase"), snip(w, p).alias("snippet"))))

    # a column of its own, read twice, is computed once
    rows = df.where(F.col(text_col).isNotNull() & (F.trim(F.col(text_col)) != "")).select(
        key, F.col(text_col), F.array_distinct(F.flatten(F.transform(cl, per_clause))).alias("_pairs"))
    full = F.trim(F.col(text_col))
    pairs = F.when(F.size("_pairs") > 0, F.col("_pairs")).otherwise(
        F.array(F.struct(F.lit("general").alias("phrase"), full.alias("snippet"))))
    return rows.select(key, F.col(text_col), F.posexplode(pairs).alias("aspect_pos", "a")).select(
        key, text_col, F.col("aspect_pos").cast("long"), F.col("a.phrase").alias("aspect_phrase"),
        F.col("a.snippet").alias("aspect_snippet"))
