"""Spelling correction, part-of-speech / lemma lexicon, noun tests.

Spelling: candidates are found by the symmetric-delete rule (two words within edit
distance k share a key made of at most k deletions from each), so the candidate
search is an equi-join on delete keys followed by an exact ``levenshtein`` check —
never an all-pairs comparison.  A vocabulary of a bounded share has few keys: they are
counted and sent to the words, whose own keys are then not shuffled.  Corrections are computed once per DISTINCT unknown
word and joined back.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra import lexicons as L
from aspectra.functions.ops import bound, saved, sent_if_small


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# spelling
# ---------------------------------------------------------------------------

def spell_vocabulary(texts: DataFrame, text_col: str, min_share: float = 1e-4, min_len: int = 1) -> DataFrame:
    """A dictionary from a corpus: [a-z]+ tokens that make up at least ``min_share`` of all of
    them, with their frequency.  A share, unlike a count, keeps rare misspellings out however
    large the corpus is; short words belong to it, or they would be "corrected" away.  Any
    (term, freq) table can stand in its place."""
    t = texts.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]+"), 0)).alias("term"))
    counts = t.where(F.length("term") >= min_len).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    total = counts.agg(F.sum("freq").alias("_total"))  # one row
    return counts.crossJoin(F.broadcast(total)).where(F.col("freq") >= F.col("_total") * min_share).select("term", "freq")


def correctable(w: Column) -> Column:
    """Words a spelling corrector may touch: two characters or more, letters among them, no digits."""
    return (F.length(w) >= 2) & w.rlike(r"\p{L}") & ~w.rlike(r"\p{N}")


def delete_keys(df: DataFrame, word: str, k: int) -> DataFrame:
    """``df`` with ``key``: the word without up to ``k`` of its characters, one row per choice of them
    (equal neighbours give equal keys)."""
    out = df.withColumns({"key": F.col(word), "_from": F.lit(1)})
    for _ in range(k):
        n, i = F.length("key"), F.col("_i")
        places = F.when(F.col("_from") <= n, F.sequence(F.col("_from"), n)).otherwise(F.array().cast("array<int>"))
        cut = F.concat(F.substr("key", F.lit(1), i - 1), F.substr("key", i + 1, n))
        out = out.withColumn("_i", F.explode(F.concat(F.array(F.lit(0)), places))).withColumns({
            "key": F.when(i == 0, F.col("key")).otherwise(cut), "_from": F.when(i == 0, n + 1).otherwise(i)})
    return out.drop("_i", "_from")


def _unknown(words: DataFrame, col: str, vocab: DataFrame) -> DataFrame:
    """Rows whose word a corrector may touch and the vocabulary does not hold."""
    return words.where(F.col(col).isNotNull() & correctable(F.col(col))).join(
        sent_if_small(vocab.select(F.col("term").alias(col))), col, "left_anti")


def corrections(words: DataFrame, word_col: str, vocab: DataFrame, max_distance: int,
                prefer: str = "closest") -> DataFrame:
    """Best vocabulary term within ``max_distance`` for each distinct word not in the
    vocabulary.  prefer='closest': smallest distance, then highest frequency, then term;
    prefer='frequent': highest frequency among all candidates, then term.
    Returns (word, correction); words without a candidate are absent."""
    vocab = saved(vocab.select("term", "freq"), "vocabulary")
    return _best_terms(_unknown(words.select(F.col(word_col).alias("word")), "word", vocab), vocab, max_distance, prefer)


def _best_terms(unknown: DataFrame, vocab: DataFrame, max_distance: int, prefer: str) -> DataFrame:
    """``corrections`` of words that the (saved) vocabulary does not hold.  A word makes many keys: words
    are dealt to enough tasks first, and the keys of a counted vocabulary come to them."""
    spark = vocab.sparkSession
    longest = vocab.agg((F.max(F.length("term")) + max_distance).alias("_longest"))  # one row
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = (unknown.select("word").distinct()
             # a longer word has no term within the distance
             .crossJoin(F.broadcast(longest)).where(F.length("word") <= F.col("_longest")).drop("_longest")
             .repartition(tasks, "word"))
    vk = delete_keys(vocab, "term", max_distance).distinct()
    cand = delete_keys(words, "word", max_distance).join(sent_if_small(vk), "key")
    cand = cand.withColumn("dist", F.levenshtein("word", "term", max_distance)).where(
        (F.col("dist") >= 0) & (F.col("dist") <= max_distance))
    if prefer == "closest":
        order = F.struct(F.col("dist"), -F.col("freq"), F.col("term"))
    else:
        order = F.struct(-F.col("freq"), F.col("term"))
    return cand.groupBy("word").agg(F.min_by("term", order).alias("correction"))


#: A token in more rows than this is spread over several tasks.
HOT_TOKEN = 100_000


def correct_tokens(df: DataFrame, key: str, tokens_col: str, vocab: DataFrame, max_distance: int,
                   prefer: str = "closest", out: str = "corrected", salts: int = 16) -> DataFrame:
    """Replace unknown tokens of an array column by their correction (unchanged when none);
    order kept.  Only the distinct unknown tokens of a row, saved once, meet the corrections;
    those of frequent tokens are repeated once per salt so that none fills one task; a row
    gets its own corrections back and replaces in place."""
    vocab = saved(vocab.select("term", "freq"), "vocabulary")
    ex = saved(_unknown(df.select(key, F.explode(F.array_distinct(tokens_col)).alias("tok")), "tok", vocab), "unknown")
    hot = sent_if_small(ex.groupBy("tok").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_TOKEN).select("tok", F.lit(salts).alias("_salts")))
    parts = F.coalesce("_salts", F.lit(1))
    corr = _best_terms(ex.select(F.col("tok").alias("word")), vocab, max_distance, prefer).withColumnRenamed("word", "tok")
    corr = corr.join(hot, "tok", "left").select("tok", "correction", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_salt"))
    fixes = (ex.join(hot, "tok", "left").select(key, "tok", F.pmod(F.xxhash64(key), parts).cast("int").alias("_salt"))
             .join(corr, ["tok", "_salt"]).groupBy(key).agg(F.collect_set(F.struct("tok", "correction")).alias("_fixes")))
    fixed = F.when(F.col("_fixes").isNull(), F.col(tokens_col)).otherwise(_replaced(F.col(tokens_col), F.col("_fixes")))
    return df.join(fixes, key, "left").withColumn(out, F.coalesce(fixed, F.array().cast("array<string>"))).drop("_fixes")


def _replaced(tokens: Column, fixes: Column, each: int = 8) -> Column:
    """Tokens replaced by their (tok, correction).  A map is searched from its beginning, so a row's
    corrections lie in small maps of about ``each`` entries, found by the token's hash."""
    def with_maps(n):
        place = lambda t: F.pmod(F.xxhash64(t), n).cast("int")
        placed = F.transform(fixes, lambda f: F.struct(place(f["tok"]).alias("at"), f.alias("f")))
        maps = bound(placed, lambda all_: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.map_from_entries(
            F.transform(F.filter(all_, lambda f: f["at"] == i), lambda f: f["f"]))))
        return bound(maps, lambda m: F.transform(tokens, lambda t: F.coalesce(F.element_at(F.get(m, place(t)), t), t)))

    return bound(F.ceil(F.size(fixes) / each).cast("int"), with_maps)


# ---------------------------------------------------------------------------
# Part of speech, lemma, noun tests
# ---------------------------------------------------------------------------

def tag_tokens(tokens: DataFrame, tok_col: str, lexicon: DataFrame) -> DataFrame:
    """Tag and lemma from a (word, tag, lemma) lexicon; unknown word -> NN, lemma =
    word.  Adds ``tag``, ``lemma`` and ``keep`` (tag starts with NN or JJ)."""
    lx = lexicon.select(F.col("word").alias(tok_col), F.col("tag").alias("_tag"), F.col("lemma").alias("_lemma"))
    j = tokens.join(sent_if_small(lx), tok_col, "left")
    return (j.withColumn("tag", F.coalesce("_tag", F.lit("NN"))).withColumn("lemma", F.coalesce("_lemma", F.col(tok_col)))
            .withColumn("keep", F.substring("tag", 1, 2).isin("NN", "JJ")).drop("_tag", "_lemma"))


def noun_senses(senses: DataFrame) -> DataFrame:
    """T14 + word-net domains per lemma: (lemma, n_senses, any_concrete, any_abstract)."""
    return senses.groupBy("lemma").agg(
        F.count(F.lit(1)).alias("n_senses"),
        F.bool_or(L.in_words(F.col("domain"), L.CONCRETE_DOMAINS)).alias("any_concrete"),
        F.bool_or(L.in_words(F.col("domain"), L.ABSTRACT_DOMAINS)).alias("any_abstract"))


def with_noun_tests(df: DataFrame, lemma_col: str, senses: DataFrame, abstract_nouns: Iterable[str],
                    domain_nouns: Iterable[str], noise_nouns: Iterable[str],
                    suffixes=L.ABSTRACT_SUFFIXES) -> DataFrame:
    """T12, T13, T14 as columns: is_abstract, is_concrete, n_senses."""
    s = noun_senses(senses).withColumnRenamed("lemma", lemma_col)
    j = df.join(sent_if_small(s), lemma_col, "left")
    lem = F.col(lemma_col)
    suffix = F.lit(False)
    for suf in suffixes:
        suffix = suffix | lem.endswith(suf)
    abstract_nouns = list(abstract_nouns)
    is_abstract = (F.when(L.in_words(lem, abstract_nouns), True).when(suffix, True)
                   .when(F.coalesce("any_concrete", F.lit(False)), False)
                   .when(F.coalesce("any_abstract", F.lit(False)), True).otherwise(False))
    is_concrete = (F.when(L.in_words(lem, domain_nouns), True)
                   .when(L.in_words(lem, noise_nouns) | L.in_words(lem, abstract_nouns), False)
                   .otherwise(~is_abstract))
    return (j.withColumn("is_abstract", is_abstract).withColumn("is_concrete", is_concrete)
            .withColumn("n_senses", F.coalesce("n_senses", F.lit(0)).cast("long"))
            .drop("any_concrete", "any_abstract"))


def lemma_filter(tagged: DataFrame, stop: Iterable[str], noise: Iterable[str], abstract: Iterable[str],
                 domain: Iterable[str], whitelist: Iterable[str]) -> DataFrame:
    """Keep NN*/JJ* lemmas, not stop words, length > 2; nouns also not noise, not
    abstract, and (domain or whitelisted or concrete).  Needs ``is_concrete``."""
    lem = F.col("lemma")
    noun = F.col("tag").startswith("NN")
    ok = (F.col("keep") & ~L.in_words(lem, stop) & (F.length(lem) > 2))
    noun_ok = (~L.in_words(lem, noise) & ~L.in_words(lem, abstract)
               & (L.in_words(lem, domain) | L.in_words(lem, whitelist) | F.col("is_concrete")))
    return tagged.where(ok & (~noun | noun_ok))


def lexicon_table(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(w, t, lm) for w, t, lm, *_ in rows], "word string, tag string, lemma string")


def senses_table(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "lemma string, sense int, domain string")

