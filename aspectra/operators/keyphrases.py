"""Embedding-ranked keyword extraction (X1–X10), re-aimed on Spark.

Per document, inside its row (no shuffle): 1–3-gram candidates of the
stop-word-free tokens, relevance = cosine(document vector, phrase vector) from the
hashed character-gram encoder, the top 30, the ordered rejection cascade and the
top 6 kept phrases.  Only phrase frequencies (X7/X8) and the funnel (X9/X10) are
aggregations — decomposable counts, map-side combined, so a phrase present in a
third of all documents costs one partial row per partition.

Word attributes (tags, senses, abstract/concrete) are a table of any size, joined to
the distinct tokens of the top candidates; only the fixed word lists are literal sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra import lexicons as L
from aspectra.functions.ops import bound, small_batches

REASONS = ["pattern", "similarity", "praise", "noise", "abstract", "generic", "sentiment", "other_tag", "sense",
           "wordnet"]
# reasons with an example list (the similarity cut, other tags and the sense test have none)
EXAMPLE_REASONS = ["noise", "abstract", "pattern", "generic", "sentiment", "docfreq_high", "docfreq_low", "wordnet",
                   "praise"]


@dataclass(frozen=True)
class WordClasses:
    """Word sets that drive the cascade (all bounded lexicons)."""
    adjectives: frozenset = frozenset()        # tagged JJ*
    other_tags: frozenset = frozenset()        # tagged neither NN* nor JJ* (unknown words are nouns)
    sense_words: frozenset = frozenset()       # words with at least one sense
    multi_sense: frozenset = frozenset()       # nouns with >= min_single_word_senses senses
    any_concrete: frozenset = frozenset()      # a sense in a concrete domain
    any_abstract: frozenset = frozenset()      # a sense in an abstract domain
    praise: frozenset = L.PRAISE_TARGETS
    noise: frozenset = L.NOISE_NOUNS
    abstract_list: frozenset = L.ABSTRACT_IDEA_NOUNS
    generic: frozenset = L.GENERIC_PHRASE_COMPONENTS
    functional: frozenset = L.FUNCTIONAL_ADJECTIVES
    domain: frozenset = L.HOTEL_DOMAIN_NOUNS
    whitelist: frozenset = L.ASPECT_NOUN_WHITELIST
    suffixes: tuple = field(default=L.ABSTRACT_SUFFIXES)


#: Bits of a word's attributes.
ADJECTIVE, OTHER_TAG, MULTI_SENSE, CONCRETE, ABSTRACT, HAS_SENSE = 1, 2, 4, 8, 16, 32


def word_attributes(lexicon: DataFrame, senses: DataFrame, min_senses: int = 2) -> DataFrame:
    """(word, bits) from lexicon (word, tag, lemma) and senses (lemma, sense, domain); one row per word."""
    tag = F.col("tag")
    tags = lexicon.select("word", F.when(tag.startswith("JJ"), F.lit(ADJECTIVE)).when(tag.startswith("NN"), F.lit(0))
                          .otherwise(F.lit(OTHER_TAG)).alias("bits"))
    per = senses.groupBy(F.col("lemma").alias("word")).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(L.in_words(F.col("domain"), L.CONCRETE_DOMAINS)).alias("c"),
        F.bool_or(L.in_words(F.col("domain"), L.ABSTRACT_DOMAINS)).alias("a"))
    bit = lambda test, b: F.when(test, F.lit(b)).otherwise(F.lit(0))
    sense_bits = per.select("word", (F.lit(HAS_SENSE) + bit(F.col("n") >= min_senses, MULTI_SENSE) + bit(F.col("c"), CONCRETE)
                                     + bit(F.col("a"), ABSTRACT)).alias("bits"))
    return tags.unionByName(sense_bits).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _in(c: Column, ws: Iterable[str]) -> Column:
    return L.in_words(c, ws)


def document_text(raw, normalized, clean) -> Column:
    """Raw text, else normalised, else cleaned (first non-empty)."""
    def ne(c):
        c = F.col(c) if isinstance(c, str) else c
        return F.nullif(c, F.lit(""))
    return F.coalesce(ne(raw), ne(normalized), ne(clean))


def candidate_tokens(doc: Column, stop: Iterable[str] = L.ENGLISH_STOPWORDS) -> Column:
    """Lower-cased word tokens (>= 2 word characters) without stop words."""
    toks = F.regexp_extract_all(F.lower(doc), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    stop = list(stop)
    return F.filter(toks, lambda t: ~_in(t, stop))


def ngrams_of(kept: Column, max_n: int = 3) -> Column:
    """Distinct 1..max_n-grams of a token array, built from shifted slices (the array
    is only ever a direct argument, never re-evaluated inside a lambda)."""
    n = F.size(kept)
    parts = [kept]
    for k in range(2, max_n + 1):
        m = F.greatest(n - (k - 1), F.lit(0))
        g = F.slice(kept, 1, m)
        for j in range(1, k):
            g = F.zip_with(g, F.slice(kept, j + 1, m), lambda a, b: F.concat_ws(" ", a, b))
        parts.append(g)
    return F.array_distinct(F.concat(*parts))


#: Candidates or characters scored in one piece; bounds the count matrix.
SCORED_TOGETHER, CHARS_TOGETHER = 20_000, 2_000_000


def _gram_places(texts: list[str], dim: int, n: int, known: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each hashed character n-gram (n <= 3).  Distinct grams are hashed
    once, as ``gram_bucket`` does: first 8 hex digits of md5(gram) mod dim."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(points)) + n <= np.repeat(np.cumsum(sizes), sizes)
    at = np.flatnonzero(inside)
    codes = np.zeros(len(at), dtype=np.int64)
    for i in range(n):
        codes = (codes << 21) | points[at + i]
    place, distinct = pd.factorize(codes)
    buckets = np.empty(len(distinct), dtype=np.int64)
    for k, code in enumerate(distinct.tolist()):
        bucket = known.get(code)
        if bucket is None:
            gram = "".join(chr(code >> 21 * (n - 1 - i) & 0x1FFFFF) for i in range(n))
            bucket = known[code] = int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % dim
        buckets[k] = bucket
    return owner[at], buckets[place]


def _counts(owner: np.ndarray, bucket: np.ndarray, rows: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each row's buckets, and the length of each row."""
    m = np.bincount(owner * dim + bucket, minlength=rows * dim).reshape(rows, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m).astype(np.float64))
    return m, np.where(norm == 0, 1.0, norm)


def candidate_scorer(dim: int = 64, n: int = 3, tie_decimals: int = 12):
    """X3 relevance scorer (the re-aimed embedding model call): one Arrow pass over (candidate
    list, document text) -> cosine per candidate.  Documents and candidates of a batch are
    counted together; scores are rounded to ``tie_decimals`` so equal cosines tie exactly
    (phrase order then decides).  Marked non-deterministic so that Catalyst never runs it twice."""
    @F.pandas_udf("array<double>")
    def _score(cands: pd.Series, docs: pd.Series) -> pd.Series:
        known: dict[int, int] = {}

        def flush(part):
            docs_counts, docs_norm = _counts(*_gram_places([t for _, t in part], dim, n, known), len(part), dim)
            sizes = [len(c) for c, _ in part]
            texts = [x for c, _ in part for x in c]
            doc = np.repeat(np.arange(len(part)), sizes)
            owner, bucket = _gram_places(texts, dim, n, known)
            norm = _counts(owner, bucket, len(texts), dim)[1]
            # products of counts are whole numbers: their sums are exact in any order
            dot = np.bincount(owner, weights=docs_counts[doc[owner], bucket], minlength=len(texts))
            s = dot / (docs_norm[doc] * norm)
            return np.split(np.round(s, tie_decimals), np.cumsum(sizes)[:-1])

        out, part, phrases, chars = [], [], 0, 0
        for c, t in zip(cands, docs):
            part.append((list(c), t))
            phrases, chars = phrases + len(c), chars + len(t)
            if phrases >= SCORED_TOGETHER or chars >= CHARS_TOGETHER:
                out += flush(part)
                part, phrases, chars = [], 0, 0
        return pd.Series(out + (flush(part) if part else []))

    return _score.asNondeterministic()


def top_candidates(scored: Column, k: int = 30) -> Column:
    """Top k by score desc, phrase asc (in-row sort of those that reach the k-th score)."""
    def first(least):
        reach = F.filter(scored, lambda x: least.isNull() | (x["score"] >= least))
        keyed = F.transform(reach, lambda x: F.struct((-x["score"]).alias("k"), x["phrase"].alias("phrase"),
                                                      x["score"].alias("score")))
        return F.slice(F.sort_array(keyed), 1, k)

    return bound(F.get(F.sort_array(F.transform(scored, lambda x: x["score"]), asc=False), F.lit(k - 1)), first)


def phrase_tokens(phrase: Column) -> Column:
    """Lower-cased letters-only tokens of a phrase."""
    return F.filter(F.transform(F.split(phrase, " "), lambda t: F.regexp_replace(F.lower(t), "[^a-z]+", "")),
                    lambda t: t != "")


def cascade(phrase: Column, score: Column, wc: WordClasses, min_cosine: float = 0.6,
            attributes: Column | None = None) -> tuple[Column, Column]:
    """``attributes``: map token -> bits, in addition to the sets of ``wc``.  X4 + X5: (reason, sentiments).  First failing test wins: pattern (no letters) ->
    similarity -> praise target -> no noun -> noise -> abstract -> generic -> non-functional
    adjective ('sentiment') -> other tag -> sense -> word-net; null = kept.  Sentiments =
    the functional adjectives of the phrase."""
    facts = token_facts(phrase_tokens(phrase), wc, attributes)
    return bound(facts, lambda f: _reason(f, score, min_cosine)), bound(facts, _sentiments)


def token_facts(toks: Column, wc: WordClasses, attributes: Column | None = None) -> Column:
    """What the cascade asks about each token: its attributes are looked up once, each word set at most twice."""
    def facts(x):
        t = x["t"]

        def has(words, bit):
            return _in(t, words) | (x["bits"].bitwiseAND(F.lit(bit)) != 0)

        adjective = has(wc.adjectives, ADJECTIVE)
        noun = ~adjective & ~has(wc.other_tags, OTHER_TAG)
        listed = _in(t, wc.abstract_list)
        abstract = (listed | (_any_suffix(t, wc.suffixes) if wc.suffixes else F.lit(False))
                    | (~has(wc.any_concrete, CONCRETE) & has(wc.any_abstract, ABSTRACT)))
        concrete = _in(t, wc.domain) | (~_in(t, wc.noise) & ~listed & ~abstract)
        functional = _in(t, wc.functional)
        return F.struct(
            t.alias("t"), noun.alias("noun"), _in(t, wc.praise).alias("praise"), _in(t, wc.noise).alias("noise"),
            abstract.alias("abstract"), _in(t, wc.generic).alias("generic"),
            (adjective & ~functional).alias("quality"), (adjective & functional).alias("functional"),
            has(wc.other_tags, OTHER_TAG).alias("other"),
            (noun & (_in(t, wc.whitelist | wc.domain) | concrete | has(wc.multi_sense, MULTI_SENSE))).alias("meant"),
            has(wc.sense_words, HAS_SENSE).alias("sense"))

    def bits(t):
        return F.lit(0) if attributes is None else F.coalesce(F.element_at(attributes, t), F.lit(0))

    return F.transform(F.transform(toks, lambda t: F.struct(t.alias("t"), bits(t).alias("bits"))), facts)


def _reason(facts: Column, score: Column, min_cosine: float) -> Column:
    def some(fact):
        return F.exists(facts, lambda x: x[fact])

    return (F.when(F.size(facts) == 0, F.lit("pattern"))
            .when(score < min_cosine, F.lit("similarity"))
            .when(some("praise"), F.lit("praise"))
            .when(~some("noun"), F.lit("pattern"))
            .when(some("noise"), F.lit("noise"))
            .when(some("abstract"), F.lit("abstract"))
            .when(F.forall(facts, lambda x: x["generic"]), F.lit("generic"))
            .when(some("quality"), F.lit("sentiment"))
            .when(some("other"), F.lit("other_tag"))
            .when(~some("meant"), F.lit("sense"))
            .when(F.forall(facts, lambda x: ~x["sense"]), F.lit("wordnet")))


def _sentiments(facts: Column) -> Column:
    return F.transform(F.filter(facts, lambda x: x["functional"]), lambda x: x["t"])


def _any_suffix(t: Column, suffixes) -> Column:
    c = F.lit(False)
    for s in suffixes:
        c = c | t.endswith(s)
    return c


def candidate_table(docs: DataFrame, key: str, source_col: str, doc_col: str, wc: WordClasses, *,
                    attributes: DataFrame | None = None, stop=L.ENGLISH_STOPWORDS, top_n: int = 6,
                    min_cosine: float = 0.6, dim: int = 64, salts: int = 16) -> DataFrame:
    """X2–X6 as rows: one row per top-30 candidate of each document with
    (key, source, cand_rank, phrase, score, n_tokens, reason, sentiments, kept_rank, selected);
    the first ``top_n`` kept candidates (score order) are the document's records.
    The top 30 are found inside the document's row and checkpointed; their distinct tokens
    then meet ``attributes`` (word, bits), repeated per salt against frequent tokens, and
    come back as one map per document."""
    n_cand = max(top_n * 5, top_n + 5)
    d = docs.select(key, source_col, F.col(doc_col).alias("_doc")).where(F.col("_doc").isNotNull())
    # each step is its own column, referenced more than once, so Catalyst keeps it materialised
    d = d.withColumn("_kept", candidate_tokens(F.col("_doc"), stop))
    d = d.withColumn("_c", ngrams_of(F.col("_kept")))
    d = d.withColumn("_s", candidate_scorer(dim)(F.col("_c"), F.col("_doc")))
    scored = F.zip_with("_c", "_s", lambda c, v: F.struct(c.alias("phrase"), v.alias("score")))
    with small_batches(docs.sparkSession):
        d = d.select(key, source_col, top_candidates(scored, n_cand).alias("_top")).checkpoint()
    if attributes is None:
        d = d.withColumn("_words", F.expr("cast(map() as map<string,int>)"))
    else:
        toks = F.array_distinct(F.flatten(F.transform("_top", lambda x: phrase_tokens(x["phrase"]))))
        words = d.select(key, F.explode(toks).alias("word")).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
        known = attributes.where("bits != 0").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        maps = words.join(known, ["word", "_salt"]).groupBy(key).agg(
            F.map_from_entries(F.collect_set(F.struct("word", "bits"))).alias("_words"))  # a document's top tokens only
        d = d.join(maps, key, "left").withColumn("_words", F.coalesce("_words", F.expr("cast(map() as map<string,int>)")))

    def judge(x):
        return bound(token_facts(phrase_tokens(x["phrase"]), wc, F.col("_words")), lambda f: F.struct(
            x["phrase"].alias("phrase"), x["score"].alias("score"), _reason(f, x["score"], min_cosine).alias("reason"),
            _sentiments(f).alias("sentiments"), F.size(f).cast("long").alias("n_tokens")))

    d = d.withColumn("_cand", F.transform("_top", judge))
    # both columns in one projection: _cand stays materialised (two references)
    d = d.select(key, source_col, "_cand", F.slice(F.transform(F.filter("_cand", lambda c: c["reason"].isNull()),
                                                               lambda c: c["phrase"]), 1, top_n).alias("_sel"))
    x = d.select(key, source_col, "_sel", F.posexplode("_cand").alias("cand_rank", "c"))
    kr = F.array_position(F.col("_sel"), F.col("c.phrase"))
    return x.select(
        key, source_col, F.col("cand_rank").cast("long"), F.col("c.phrase").alias("phrase"),
        F.col("c.score").alias("score"), F.col("c.n_tokens").alias("n_tokens"), F.col("c.reason").alias("reason"),
        F.col("c.sentiments").alias("sentiments"),
        F.when(kr > 0, kr).cast("long").alias("kept_rank"), (kr > 0).alias("selected"))


def phrase_frequencies(cands: DataFrame) -> DataFrame:
    """Per phrase the number of selected records and of distinct documents (rows)."""
    rec = cands.where("selected")
    return rec.groupBy("phrase").agg(F.count(F.lit(1)).alias("count"), F.count(F.lit(1)).alias("doc_freq"))


def prune(cands: DataFrame, freqs: DataFrame, n_documents: Column | int, allowed: Iterable[str],
          min_freq: int = 2, max_doc_freq: float = 0.25) -> DataFrame:
    """Selected records with ``prune`` = 'docfreq_low' (multi-word, count < min_freq),
    'docfreq_high' (share of documents > max_doc_freq and no allowed token) or null."""
    rec = cands.where("selected").join(freqs, "phrase")
    n = F.lit(n_documents) if isinstance(n_documents, int) else n_documents
    toks = F.split("phrase", " ")
    low = (F.size(toks) > 1) & (F.col("count") < min_freq)
    high = (F.col("doc_freq") / n > max_doc_freq) & ~F.exists(toks, lambda t: _in(t, list(allowed)))
    return rec.withColumn("prune", F.when(low, "docfreq_low").when(high, "docfreq_high"))


def funnel(cands: DataFrame, pruned: DataFrame, n_documents: int) -> DataFrame:
    """One (metric, value) row per counter."""
    r = F.col("reason")
    ng = F.col("n_tokens")
    a = cands.agg(
        F.count(F.lit(1)).alias("raw_candidates"),
        F.count_if(ng == 1).alias("raw_unigrams"),
        F.count_if(ng == 2).alias("raw_bigrams"),
        F.count_if(ng >= 3).alias("raw_trigrams"),
        *[F.count_if(r == x).alias(f"{x}_pruned") for x in REASONS if x != "sentiment"],
        F.count_if(r == "sentiment").alias("sentiment_captured"),
        F.countDistinct(F.when(F.col("selected"), F.col("phrase"))).alias("unique_candidates"))
    p = pruned.agg(
        F.count_if(F.col("prune") == "docfreq_low").alias("low_freq_pruned"),
        F.count_if(F.col("prune") == "docfreq_high").alias("high_docfreq_pruned"),
        F.countDistinct(F.when(F.col("prune").isNull(), F.col("phrase"))).alias("post_freq_candidates"),
        F.count_if(F.col("prune").isNull()).alias("final_records"))
    j = a.crossJoin(p).withColumn("documents", F.lit(max(n_documents, 1))).withColumn(
        "token_pruned", F.lit(0)).withColumn("accepted", F.col("final_records"))
    cols = [c for c in j.columns]
    return j.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value"))
                                        for c in cols])).alias("m")).select("m.metric", "m.value")


def drop_examples(cands: DataFrame, pruned: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent phrases per drop reason (reasons that keep examples)."""
    a = cands.where(F.col("reason").isin(EXAMPLE_REASONS)).select("reason", "phrase")
    b = pruned.where(F.col("prune").isNotNull()).select(F.col("prune").alias("reason"), "phrase")
    c = a.unionByName(b).groupBy("reason", "phrase").agg(F.count(F.lit(1)).alias("n"))
    from aspectra.functions.ops import topk
    return topk(c, ["reason"], [F.col("n").desc(), F.col("phrase")], k)


def top_phrases(cands: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent selected phrases before frequency pruning (each task keeps its own k)."""
    c = cands.where("selected").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    top = c.orderBy(F.col("n").desc(), "phrase").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "phrase")).cast("long"))
