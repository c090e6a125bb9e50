"""Lexicon n-gram keywords.

Plan shape: one narrow stage builds every candidate n-gram inside its row with
array higher-order functions (no shuffle to find neighbours), then ONE
aggregation on (type, keyword) with map-side partial counts — a keyword that
holds a third of all occurrences is pre-aggregated per partition before the
shuffle, so skew costs one row per partition.  The report windows run on the
aggregated keyword table only (its size is bounded by the lexicon).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra import lexicons as L
from aspectra.functions.text import clean_words, tokens, valid_word

TYPES = [("unigrams", 1), ("bigrams", 2), ("trigrams", 3)]


def _seq(n: Column, k: int) -> Column:
    """0 .. n-k as an array, empty when n < k (``sequence`` would count down)."""
    return F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))


def with_word_flags(df: DataFrame, text_col: str, adjectives: Iterable[str], nouns: Iterable[str],
                    stop: Iterable[str], irrelevant: Iterable[str]) -> DataFrame:
    """Adds ``_w``: array<struct<w, v (valid), a (adjective), n (noun)>> of the cleaned text."""
    adjectives, nouns = list(adjectives), list(nouns)
    toks = tokens(clean_words(text_col))
    return df.withColumn(
        "_w",
        F.transform(toks, lambda t: F.struct(
            t.alias("w"), valid_word(t, stop, irrelevant).alias("v"),
            L.in_words(t, adjectives).alias("a"), L.in_words(t, nouns).alias("n"))),
    )


def ngram_occurrences(df: DataFrame, key: str = "review_key", text_col: str = "text",
                      adjectives: Iterable[str] = L.HOTEL_ADJECTIVES, nouns: Iterable[str] = L.HOTEL_NOUNS,
                      stop: Iterable[str] = L.NGRAM_STOPWORDS,
                      irrelevant: Iterable[str] = L.IRRELEVANT_WORDS,
                      types: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """One row per keyword occurrence: (key, ngram_type, type_rank, pos, keyword).

    unigram: valid and adjective-or-noun; bigram: adj+noun or noun+noun; trigram:
    adj+adj+noun or adj+noun+noun; neighbours are taken in the UNFILTERED token list.
    """
    w = with_word_flags(df.select(key, text_col), text_col, adjectives, nouns, stop, irrelevant)
    arr = F.col("_w")
    n = F.size(arr)

    def at(i):
        return arr[i]

    def item(rank: int, i, kw: Column) -> Column:
        return F.struct(F.lit(rank).alias("type_rank"), i.alias("pos"), kw.alias("keyword"))

    parts = []
    if 1 in types:
        parts.append(F.transform(
            F.filter(_seq(n, 1), lambda i: at(i)["v"] & (at(i)["a"] | at(i)["n"])),
            lambda i: item(1, i, at(i)["w"])))
    if 2 in types:
        parts.append(F.transform(
            F.filter(_seq(n, 2), lambda i: at(i)["v"] & at(i + 1)["v"]
                     & (at(i)["a"] | at(i)["n"]) & at(i + 1)["n"]),
            lambda i: item(2, i, F.concat_ws(" ", at(i)["w"], at(i + 1)["w"]))))
    if 3 in types:
        parts.append(F.transform(
            F.filter(_seq(n, 3), lambda i: at(i)["v"] & at(i + 1)["v"] & at(i + 2)["v"] & at(i)["a"]
                     & (at(i + 1)["a"] | at(i + 1)["n"]) & at(i + 2)["n"]),
            lambda i: item(3, i, F.concat_ws(" ", at(i)["w"], at(i + 1)["w"], at(i + 2)["w"]))))
    grams = parts[0] if len(parts) == 1 else F.concat(*parts)
    out = w.select(F.col(key), F.explode(grams).alias("g"))
    type_name = F.element_at(F.array(*[F.lit(t) for t, _ in TYPES]), F.col("g.type_rank"))
    return out.select(
        F.col(key),
        type_name.alias("ngram_type"),
        F.col("g.type_rank").cast("long").alias("type_rank"),
        F.col("g.pos").cast("long").alias("pos"),
        F.col("g.keyword").alias("keyword"),
    )


def keyword_counts(occ: DataFrame, key: str = "review_key", min_freq: int = 2) -> DataFrame:
    """Every occurrence counts; keep frequency >= min_freq.  ``first_key``/``first_pos``
    record first appearance (review order, then position) for stable report order."""
    g = occ.groupBy("ngram_type", "type_rank", "keyword").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.min(F.struct(F.col(key), F.col("pos"))).alias("_first"),
    )
    return g.where(F.col("frequency") >= min_freq).select(
        "ngram_type", "type_rank", "keyword", "frequency",
        F.col(f"_first.{key}").alias("first_key"), F.col("_first.pos").alias("first_pos"))


def category_rules(categories: Sequence[tuple[str, str | Iterable[str]]]):
    """Normalise [(category, words)] to [(rank, category, [words])]."""
    out = []
    for rank, (cat, ws) in enumerate(categories, start=1):
        ws = ws.split() if isinstance(ws, str) else list(ws)
        out.append((rank, cat, ws))
    return out


def category_of(kw: Column, categories, default: str = L.DEFAULT_CATEGORY) -> tuple[Column, Column]:
    """First category with any word as a SUBSTRING of the keyword; (category, rank)."""
    rules = category_rules(categories)
    cat = None
    rank = None
    low = F.lower(kw)
    for r, name, ws in rules:
        hit = F.lit(False)
        for w in ws:
            hit = hit | low.contains(w)
        cat = F.when(hit, F.lit(name)) if cat is None else cat.when(hit, F.lit(name))
        rank = F.when(hit, F.lit(r)) if rank is None else rank.when(hit, F.lit(r))
    if cat is None:
        return F.lit(default), F.lit(len(rules) + 1)
    return cat.otherwise(F.lit(default)), rank.otherwise(F.lit(len(rules) + 1))


def categorize(counts: DataFrame, categories=L.HOTEL_CATEGORIES, default: str = L.DEFAULT_CATEGORY) -> DataFrame:
    cat, rank = category_of(F.col("keyword"), categories, default)
    return counts.withColumn("category", cat).withColumn("category_rank", rank.cast("long"))


def report(categorized: DataFrame) -> DataFrame:
    """Per category, frequency desc; ties in type order, then first appearance."""
    w = Window.partitionBy("category").orderBy(
        F.col("frequency").desc(), "type_rank", "first_key", "first_pos")
    return categorized.withColumn("rank_in_category", F.row_number().over(w).cast("long"))


def top_per_category(rep: DataFrame, k: int = 3) -> DataFrame:
    """Keyword count and the k most frequent keywords per non-empty category."""
    n = F.count(F.lit(1)).over(Window.partitionBy("category")).cast("long")
    return rep.withColumn("n_keywords", n).where(F.col("rank_in_category") <= k)


def keyword_report(reviews: DataFrame, key: str = "review_key", text_col: str = "text", *,
                   adjectives=L.HOTEL_ADJECTIVES, nouns=L.HOTEL_NOUNS, stop=L.NGRAM_STOPWORDS,
                   irrelevant=L.IRRELEVANT_WORDS, categories=L.HOTEL_CATEGORIES,
                   default=L.DEFAULT_CATEGORY, min_freq: int = 2) -> DataFrame:
    """Chain C: reviews -> categorised keyword report (Category, Keyword, Type, Frequency)."""
    occ = ngram_occurrences(reviews, key, text_col, adjectives, nouns, stop, irrelevant)
    return report(categorize(keyword_counts(occ, key, min_freq), categories, default))


def text_fallback(df: DataFrame, columns: Sequence[str] = ("HIGHLIGHTED_REVIEW_CONTENT", "review", "content", "text"),
                  out: str = "text") -> DataFrame:
    """First NON-EMPTY of the candidate columns that exist; rows left blank are dropped."""
    present = [c for c in columns if c in df.columns]
    if not present:
        raise KeyError(f"none of the text columns {list(columns)} is present")
    picked = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in present], F.lit(""))
    return df.withColumn(out, picked).where(F.col(out).rlike(r"\S"))
