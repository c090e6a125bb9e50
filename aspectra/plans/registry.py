"""

Each query wires fixture views (``aspectra.plans.fixtures``) to library
operators; its oracle SQL lives in ``aspectra.plans.oracle`` and is written
independently.  Outputs are flat (strings, longs, doubles) so that the oracle
compare hashes the same values; vectors are reported per dimension.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra import lexicons as L
from aspectra.functions import text as T
from aspectra.operators import ngrams as N
from aspectra.plans import fixtures as FX
from aspectra.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    """Register a query; the wrapper makes sure the session has its checkpoint folder
    (the cluster's ``spark.checkpoint.dir``, or a scratch folder only when unset)."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf):
            checkpoint_dir(spark)
            return fn(spark, sf)
        QUERIES[name] = run
        return fn
    return deco


# ---------------------------------------------------------------------------
# N: lexicon n-gram keywords over the part-derived catalogue reviews
# ---------------------------------------------------------------------------

FX_NGRAM = dict(adjectives=FX.FX_ADJECTIVES, nouns=FX.FX_NOUNS, stop=L.NGRAM_STOPWORDS, irrelevant=())


def _catalog_occ(spark, sf, types=(1, 2, 3)):
    return N.ngram_occurrences(FX.catalog_reviews(spark, sf), "review_key", "text", types=types, **FX_NGRAM)


def _catalog_report(spark, sf):
    occ = _catalog_occ(spark, sf)
    counts = N.keyword_counts(occ, "review_key", 2)
    return N.report(N.categorize(counts, FX.FX_CATEGORIES, L.DEFAULT_CATEGORY))


@query("ng_valid_words")
def q_ng_valid_words(spark, sf):
    d = FX.documents_reviews(spark, sf)
    toks = d.select(F.explode(T.tokens(T.clean_words("text"))).alias("word"))
    return (toks.withColumn("is_valid", T.valid_word(F.col("word"), L.NGRAM_STOPWORDS, L.IRRELEVANT_WORDS))
            .groupBy("word", "is_valid").agg(F.count(F.lit(1)).alias("n")))


@query("ng_unigrams")
def q_ng_unigrams(spark, sf):
    return _catalog_occ(spark, sf, (1,)).select("review_key", "pos", "keyword")


@query("ng_bigrams")
def q_ng_bigrams(spark, sf):
    return _catalog_occ(spark, sf, (2,)).select("review_key", "pos", "keyword")


@query("ng_trigrams")
def q_ng_trigrams(spark, sf):
    return _catalog_occ(spark, sf, (3,)).select("review_key", "pos", "keyword")


@query("ng_counts_min2")
def q_ng_counts_min2(spark, sf):
    return N.keyword_counts(_catalog_occ(spark, sf)).select("ngram_type", "keyword", "frequency")


@query("ng_categorize")
def q_ng_categorize(spark, sf):
    c = N.categorize(N.keyword_counts(_catalog_occ(spark, sf)), FX.FX_CATEGORIES)
    return c.select("ngram_type", "keyword", "frequency", "category")


@query("ng_report")
def q_ng_report(spark, sf):
    return _catalog_report(spark, sf).select(
        F.col("category"), F.col("keyword"), F.col("ngram_type"), F.col("frequency"),
        F.col("category_rank"), F.col("rank_in_category"))


@query("ng_top3")
def q_ng_top3(spark, sf):
    return N.top_per_category(_catalog_report(spark, sf), 3).select(
        "category", "n_keywords", "rank_in_category", "keyword", "frequency")


# ---------------------------------------------------------------------------
# Text normalisation, language, tokens
# ---------------------------------------------------------------------------
from aspectra.operators import tokens as TK  # noqa: E402
from aspectra.sources import reviews as S  # noqa: E402
from aspectra.sources import sinks as SK  # noqa: E402


@query("txt_normalize")
def q_txt_normalize(spark, sf):
    d = FX.documents_reviews(spark, sf)
    return d.select("review_key", T.normalize_ws("text").alias("normalized_text"))


@query("txt_normalize_light")
def q_txt_normalize_light(spark, sf):
    d = FX.documents_reviews(spark, sf)
    return d.select("review_key", T.normalize_light("text").alias("light_text"))


@query("txt_clean_words")
def q_txt_clean_words(spark, sf):
    d = FX.documents_reviews(spark, sf)
    return d.select("review_key", T.clean_words("text").alias("clean_text"))


@query("txt_symbol_cleanup")
def q_txt_symbol_cleanup(spark, sf):
    p = FX.table(spark, sf, "pages")
    return p.select("page_id", T.symbol_cleanup("html").alias("clean_html"))


def _ingested(spark, sf):
    return TK.ingest(FX.documents_reviews(spark, sf), "text", FX.FX_LANG_STOPWORDS)


@query("txt_skip_counts")
def q_txt_skip_counts(spark, sf):
    return TK.skip_counts(_ingested(spark, sf))


@query("lang_detect")
def q_lang_detect(spark, sf):
    d = TK.detect_language(FX.documents_reviews(spark, sf), "text", FX.FX_LANG_STOPWORDS)
    return d.select("review_key", "lang", "lang_detected")


@query("lang_filter_en")
def q_lang_filter_en(spark, sf):
    d = TK.detect_language(FX.documents_reviews(spark, sf), "text", FX.FX_LANG_STOPWORDS)
    return d.where(F.col("lang_detected") == "en").select("review_key", "organization_id")


@query("tok_clean")
def q_tok_clean(spark, sf):
    d = FX.documents_reviews(spark, sf)
    toks = TK.clean_tokens(T.normalize_ws("text"))
    return d.select("review_key", F.array_join(toks, " ").alias("tokens"), F.size(toks).cast("long").alias("n_tokens"))


# ---------------------------------------------------------------------------
# S: sources and sinks
# ---------------------------------------------------------------------------

@query("src_reviews")
def q_src_reviews(spark, sf):
    return S.reviews(FX.table(spark, sf, "documents"), "text", "source")


@query("src_row_ids")
def q_src_row_ids(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id", "text")
    return S.reviews(d, "text", None).select(F.col("source_id").cast("long").alias("row_pos"),
                                             F.col("text").alias("text"))


@query("src_reviews_csv")
def q_src_reviews_csv(spark, sf):
    """Documents written as CSV (quotes, line breaks), read back without an id column: the id is the file position."""
    d = FX.table(spark, sf, "documents").select("doc_id", "text").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    path = SK.write_csv(d.select("text"), SK.scratch_path(spark, "documents_csv"))
    return S.reviews(S.read_table(spark, path, "csv"), "text", None)


@query("dim_label_list_csv")
def q_dim_label_list_csv(spark, sf):
    p = FX.table(spark, sf, "part").select("p_partkey", "p_name").repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey")
    # every seventh name is missing: its row is dropped and leaves no gap
    named = p.select(F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("label"), F.lit("x").alias("other"))
    path = SK.write_csv(named, SK.scratch_path(spark, "labels_csv"))
    return S.label_list(S.read_table(spark, path, "csv"))


@query("src_nonnull_reviews")
def q_src_nonnull_reviews(spark, sf):
    d = FX.table(spark, sf, "documents").select(F.col("doc_id").alias("ID"),
                                                F.col("text").alias("HIGHLIGHTED_REVIEW_CONTENT"))
    return S.nonnull_reviews(d).select("REVIEW_ID", "ORGANIZATION_ID", "text")


@query("src_text_fallback")
def q_src_text_fallback(spark, sf):
    c = FX.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit("")).alias("HIGHLIGHTED_REVIEW_CONTENT"),
        F.lit(None).cast("string").alias("review"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("content"),
        F.lit("").alias("text"))
    return N.text_fallback(c, out="picked").select("conv_id", "turn", F.col("picked").alias("text"))


def _mapping_source(spark, sf):
    p = FX.table(spark, sf, "part")
    return p.select(
        F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
        .alias("KEYWORD_NAME"),
        F.col("p_partkey").alias("KPI_ID"), F.col("p_brand").alias("KPI_NAME"),
        F.col("p_size").cast("long").alias("DEPARTMENT_ID"), F.col("p_type").alias("DEPARTMENT_NAME"),
        F.col("p_partkey").alias("row_pos"))


@query("dim_mapping")
def q_dim_mapping(spark, sf):
    return S.keyword_mapping(_mapping_source(spark, sf), "row_pos")


@query("dim_label_list")
def q_dim_label_list(spark, sf):
    n = FX.table(spark, sf, "nation").select("n_name", "n_regionkey")
    return S.label_list(n)


@query("sink_csv_roundtrip")
def q_sink_csv_roundtrip(spark, sf):
    rep = _catalog_report(spark, sf).select(
        F.col("category").alias("Category"), F.col("keyword").alias("Keyword"),
        F.col("ngram_type").alias("Type"), F.col("frequency").alias("Frequency"))
    path = SK.write_csv(rep, SK.scratch_path(spark, "keywords_csv"))
    return SK.read_csv(spark, path, "Category string, Keyword string, Type string, Frequency long")


@query("run_serial")
def q_run_serial(spark, sf):
    d = FX.table(spark, sf, "documents")
    names = d.select(F.when(F.col("lang") == "en", F.concat(F.col("n_chars").cast("string"), F.lit("_keywords.json")))
                     .otherwise(F.concat(F.col("source"), F.lit("_keywords.json"))).alias("name"))
    return S.next_run_serial(names, "name", 4)


# ---------------------------------------------------------------------------
# sentiment
# ---------------------------------------------------------------------------
from aspectra.operators import sentiment as E  # noqa: E402

FX_ID2LABEL = {0: "LABEL_0", 1: "neg", 2: "POSITIVE"}


def _probs(spark, sf, k):
    e = FX.table(spark, sf, "embeddings")
    return e.select("vec_id", E.softmax(F.slice("embedding", 1, k)).alias("p"))


@query("sent_softmax")
def q_sent_softmax(spark, sf):
    p = _probs(spark, sf, 5)
    return p.select("vec_id", E.argmax_index("p").alias("pred_idx"),
                    F.round(F.array_max("p"), 6).alias("confidence"))


@query("sent_stars5")
def q_sent_stars5(spark, sf):
    p = _probs(spark, sf, 5).withColumn("stars", E.argmax_index("p") + 1)
    return p.select("vec_id", "stars", E.stars5_label("stars").alias("label"),
                    F.round(F.array_max("p"), 6).alias("confidence"))


@query("sent_class3")
def q_sent_class3(spark, sf):
    p = _probs(spark, sf, 3).withColumn("idx", E.argmax_index("p"))
    return p.select("vec_id", (F.col("idx") + 1).alias("stars"), E.class3_label("idx").alias("label"),
                    F.round(F.array_max("p"), 6).alias("confidence"))


@query("sent_label_names")
def q_sent_label_names(spark, sf):
    ev = FX.table(spark, sf, "events").select("event_id", (F.floor("value") % 4).cast("long").alias("pred_idx"))
    lab, stars = E.normalize_label("pred_idx", FX_ID2LABEL)
    return ev.select("event_id", "pred_idx", lab.alias("label"), stars.alias("stars"))


ASPECT_KEYS = ["review_id", "review_part"]


@query("sent_vote_majority")
def q_sent_vote_majority(spark, sf):
    return E.vote_majority(FX.aspect_scores(spark, sf), ASPECT_KEYS)


@query("sent_vote_topk")
def q_sent_vote_topk(spark, sf):
    return E.vote_topk(FX.aspect_scores(spark, sf), ASPECT_KEYS, "pos", 5)


@query("sent_broadcast")
def q_sent_broadcast(spark, sf):
    a = FX.aspect_scores(spark, sf)
    v = E.vote_majority(a, ASPECT_KEYS).drop("n_aspects")
    return E.attach_verdict(a, v, ASPECT_KEYS, "MajorityVote+TieBreak+NeutralFix").select(
        "pos", "review_id", "review_part", "label", "confidence", "review_sentiment", "review_confidence",
        "aggregation_method")


# ---------------------------------------------------------------------------
# V: vectors, similarity, de-duplication, mapping
# ---------------------------------------------------------------------------
from aspectra.functions.ops import global_rank, sent_if_small  # noqa: E402
from aspectra.operators import cooccurrence as W  # noqa: E402
from aspectra.operators import vectors as V  # noqa: E402

DEDUP_THRESHOLD = 0.40      # fixture value (FIXTURES.md): 0.9 matches nothing in the driver vectors
MAP_THRESHOLD = 0.30


@query("vec_encode_hashed")
def q_vec_encode_hashed(spark, sf):
    c = FX.catalog_reviews(spark, sf)
    enc = V.encode_distinct(c, "text", 64)
    return enc.select(F.col("text").alias("phrase"), F.posexplode("vector").alias("bucket", "w")).where(
        F.col("w") != 0).select("phrase", F.col("bucket").cast("long"), F.round("w", 6).alias("weight"))


@query("vec_ppmi")
def q_vec_ppmi(spark, sf):
    return W.ppmi(W.cooccurrences(FX.table(spark, sf, "documents"), "text", 4, 50)).select("a", "b", F.round("v", 6).alias("ppmi"))


@query("vec_encode_trained")
def q_vec_encode_trained(spark, sf):
    """Every word of the trained encoder with its nearest other word."""
    v = W.train_vectors(FX.table(spark, sf, "documents"), "text", 64, 4, 50)
    v = global_rank(v, F.col("word"), "id")
    near = V.nearest_other(V.knn_self(v, "id", "vector", 2), "id", -1.0)
    names = v.select(F.col("id").alias("nn"), F.col("word").alias("neighbour"))
    return v.select("id", "word").join(near, "id").join(names, "nn").select("word", "neighbour", F.round("nn_sim", 4).alias("sim"))


@query("vec_normalize")
def q_vec_normalize(spark, sf):
    e = FX.table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(V.l2_normalize("embedding")).alias("dim", "v")).select(
        "vec_id", F.col("dim").cast("long"), F.round("v", 6).alias("value"))


def _knn(spark, sf, k=5):
    e = FX.table(spark, sf, "embeddings")
    return V.knn_self(e, "vec_id", "embedding", k)


@query("vec_topk_neighbors")
def q_vec_topk_neighbors(spark, sf):
    return _knn(spark, sf).select("vec_id", "rank", "nbr", F.round("sim", 6).alias("sim"))


def _canonical(spark, sf):
    ph = FX.phrases(spark, sf)
    nn = V.nearest_within(FX.table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", DEDUP_THRESHOLD)
    can = V.canonical_ids(ph.select("vec_id"), nn, "vec_id")
    names = ph.select(F.col("vec_id").alias("canonical"), F.col("phrase").alias("canonical_phrase"))
    return ph.join(can, "vec_id").join(names, "canonical")


@query("vec_canonical")
def q_vec_canonical(spark, sf):
    return _canonical(spark, sf).select("phrase", "canonical_phrase")


@query("vec_dedup_group")
def q_vec_dedup_group(spark, sf):
    c = _canonical(spark, sf)
    p = FX.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", "p_name")
    rows = c.join(p, c.vec_id == p.p_partkey).select(
        F.col("p_brand").alias("source_id"), F.col("canonical_phrase").alias("phrase"),
        F.round(F.col("p_retailprice") / 2000, 6).alias("score"),
        F.filter(F.split("p_name", " "), lambda t: L.in_words(t, FX.FX_FUNCTIONAL)).alias("sentiments"))
    g = V.dedup_group(rows, "source_id", "phrase", "score", "sentiments")
    return g.select("source_id", "phrase", "score", F.array_join("sentiments", ",").alias("sentiments"))


@query("vec_pca")
def q_vec_pca(spark, sf):
    e = FX.table(spark, sf, "embeddings")
    r = V.pca_reduce(e, "embedding", 50)
    return r.select("vec_id", F.size("reduced").cast("long").alias("n_dims"))


def _keyword_catalogue(spark, sf):
    ph = FX.phrases(spark, sf)
    return ph.where(F.col("vec_id") < 20).select(
        F.col("vec_id").alias("kw_index"), F.col("phrase").alias("Matched_Keyword"), F.col("embedding").alias("kv"),
        F.col("label").cast("long").alias("KPI_ID"), F.concat(F.lit("KPI "), F.col("label")).alias("KPI_Name"),
        F.col("vec_id").alias("Department_ID"), F.concat(F.lit("Dept "), F.col("vec_id")).alias("Department_Name"))


def _mapped(spark, sf):
    ph = FX.phrases(spark, sf)
    aspects = ph.where(F.col("vec_id") >= 20).select(F.col("vec_id").alias("aspect_id"),
                                                     F.col("phrase").alias("aspect_phrase"), "embedding")
    cat = _keyword_catalogue(spark, sf)
    m = V.nearest_keyword(aspects, "embedding", cat, "kw_index", "kv")
    return m.join(sent_if_small(cat.drop("kv")), "kw_index", "left")


@query("map_best")
def q_map_best(spark, sf):
    return _mapped(spark, sf).select("aspect_id", "Matched_Keyword", F.round("cosine_similarity", 4).alias(
        "cosine_similarity"), "KPI_ID", "KPI_Name", "Department_ID", "Department_Name")


def _thresholded(spark, sf):
    return V.apply_threshold(_mapped(spark, sf), "aspect_phrase", "Matched_Keyword", MAP_THRESHOLD)


@query("map_threshold")
def q_map_threshold(spark, sf):
    return _thresholded(spark, sf).select(
        "aspect_id", "Matched_Keyword", F.round("cosine_similarity", 4).alias("cosine_similarity"),
        "KPI_ID", "KPI_Name", "Department_ID", "Department_Name", "unmapped_before")


@query("map_unmapped_counts")
def q_map_unmapped_counts(spark, sf):
    return V.unmapped_counts(_thresholded(spark, sf), "Matched_Keyword")


# ---------------------------------------------------------------------------
# R: domain rules
# ---------------------------------------------------------------------------
from aspectra.operators import rules as R  # noqa: E402


def _rules(spark, sf):
    kpis = FX.kpi_names(spark, sf)
    deps = FX.department_names(spark, sf)
    syn = R.synonym_table(spark, FX.FX_SYNONYMS)
    return R.build_rules(kpis, deps, syn, FX.FX_DEPT_HINTS)


@query("rule_idf")
def q_rule_idf(spark, sf):
    kt = R.kpi_tokens(FX.kpi_names(spark, sf))
    return R.token_idf(kt).select("kpi", F.col("keyword").alias("token"), F.round("weight", 6).alias("idf"))


@query("rule_synonyms")
def q_rule_synonyms(spark, sf):
    kt = R.kpi_tokens(FX.kpi_names(spark, sf))
    w = R.keyword_weights(kt, R.synonym_table(spark, FX.FX_SYNONYMS))
    return w.where(F.col("source") == "synonym").select("kpi", "keyword", "weight")


@query("rule_department")
def q_rule_department(spark, sf):
    kt = R.kpi_tokens(FX.kpi_names(spark, sf))
    return R.infer_department(kt, FX.FX_DEPT_HINTS, FX.department_names(spark, sf))


@query("rule_table")
def q_rule_table(spark, sf):
    rules, _ = _rules(spark, sf)
    return rules.select("kpi", "department", F.array_join("keywords", ",").alias("keywords"),
                        F.size("keywords").cast("long").alias("n_keywords"), "primary_phrase",
                        F.round("target_weight", 6).alias("target_weight"))


def _matches(spark, sf):
    rules, w = _rules(spark, sf)
    return R.match_rules(FX.phrases(spark, sf), "phrase", rules, w)


@query("rule_match")
def q_rule_match(spark, sf):
    m = _matches(spark, sf)
    return m.select("phrase", "kpi", "department", F.round("confidence", 6).alias("confidence"))


@query("rule_annotate")
def q_rule_annotate(spark, sf):
    a = R.annotate(FX.phrases(spark, sf).select("vec_id", "phrase"), "phrase", _matches(spark, sf), 0.5)
    return a.select("vec_id", "domain_kpi", "domain_department",
                    F.round("domain_confidence", 6).alias("domain_confidence"))


@query("rule_retention")
def q_rule_retention(spark, sf):
    rows = FX.fx_clusters(spark, sf).select("vec_id", "phrase", "cluster")
    a = R.annotate(rows, "phrase", _matches(spark, sf), 0.5)
    return R.retention(rows, a)


# ---------------------------------------------------------------------------
# T8–T16, A: spelling, lexicon tags, noun tests, clauses, aspects
# ---------------------------------------------------------------------------
from aspectra.operators import aspects as A  # noqa: E402
from aspectra.operators import lexical as LX  # noqa: E402


def _en_docs(spark, sf):
    return FX.documents_reviews(spark, sf).where(F.col("lang") == "en")


def _vocab(spark, sf):
    return LX.spell_vocabulary(FX.documents_reviews(spark, sf), "text")


@query("spell_correct_1")
def q_spell_correct_1(spark, sf):
    d = FX.documents_reviews(spark, sf).select("review_key", TK.clean_tokens(T.normalize_ws("text")).alias("toks"))
    c = LX.correct_tokens(d, "review_key", "toks", _vocab(spark, sf), 1, prefer="frequent")
    return c.select("review_key", F.array_join("corrected", " ").alias("tokens"))


@query("spell_correct_2")
def q_spell_correct_2(spark, sf):
    d = FX.documents_reviews(spark, sf).select("review_key", T.normalize_light("text").alias("t"))
    d = d.select("review_key", T.tokens("t").alias("toks"))
    c = LX.correct_tokens(d, "review_key", "toks", _vocab(spark, sf), 2, prefer="closest")
    return c.select("review_key", F.array_join("corrected", " ").alias("text"))


def _catalog_tokens(spark, sf):
    c = FX.catalog_reviews(spark, sf)
    return c.select("review_key", F.posexplode(F.split("text", " ")).alias("pos", "token"))


def _tagged(spark, sf):
    lex = LX.lexicon_table(spark, FX.fx_token_lexicon_rows())
    return LX.tag_tokens(_catalog_tokens(spark, sf), "token", lex)


@query("tok_pos_lemma")
def q_tok_pos_lemma(spark, sf):
    return _tagged(spark, sf).where("keep").select("review_key", F.col("pos").cast("long"), "token", "tag", "lemma")


def _noun_tested(df, spark):
    return LX.with_noun_tests(df, "lemma", LX.senses_table(spark, FX.FX_SENSES), FX.FX_ABSTRACT,
                              FX.FX_DOMAIN_NOUNS, FX.FX_NOISE)


@query("tok_lemma_filter")
def q_tok_lemma_filter(spark, sf):
    t = _noun_tested(_tagged(spark, sf), spark)
    kept = LX.lemma_filter(t, L.ENGLISH_STOPWORDS, FX.FX_NOISE, FX.FX_ABSTRACT, FX.FX_DOMAIN_NOUNS, FX.FX_WHITELIST)
    g = kept.groupBy("review_key").agg(F.array_sort(F.collect_list(F.struct("pos", "lemma", "tag"))).alias("s"))
    return g.select("review_key", F.array_join(F.transform("s", lambda x: x["lemma"]), " ").alias("clean_text"),
                    F.array_join(F.transform("s", lambda x: F.substring(x["tag"], 1, 2)), " ").alias("pos_tags"))


def _lemmas(spark, sf):
    t = _catalog_tokens(spark, sf).select(F.col("token").alias("lemma")).distinct()
    return _noun_tested(t, spark)


@query("noun_abstract")
def q_noun_abstract(spark, sf):
    return _lemmas(spark, sf).select("lemma", "is_abstract")


@query("noun_concrete")
def q_noun_concrete(spark, sf):
    return _lemmas(spark, sf).select("lemma", "is_concrete")


@query("noun_sense_count")
def q_noun_sense_count(spark, sf):
    return _lemmas(spark, sf).select("lemma", "n_senses")


@query("phrase_generic")
def q_phrase_generic(spark, sf):
    c = FX.catalog_reviews(spark, sf)
    return c.select("review_key", T.generic_phrase("text", FX.FX_GENERIC).alias("is_generic"))


def _doc_clauses(spark, sf):
    return A.segment(FX.documents_reviews(spark, sf), "review_key", "text")


@query("seg_clauses")
def q_seg_clauses(spark, sf):
    return _doc_clauses(spark, sf)


def _order_clause_chunks(spark, sf, informative):
    o = FX.order_reviews(spark, sf)
    cl = o.select("review_key", F.posexplode(A.clauses(F.col("text"))).alias("clause_pos", "clause"))
    ch = cl.select("review_key", "clause_pos", F.posexplode(
        A.chunk_phrases(F.col("clause"), FX.FX_ADJECTIVES, FX.FX_NOUNS, informative=informative))
        .alias("chunk_pos", "phrase"))
    return ch.select("review_key", F.col("clause_pos").cast("long"), F.col("chunk_pos").cast("long"), "phrase")


@query("asp_chunks")
def q_asp_chunks(spark, sf):
    return _order_clause_chunks(spark, sf, False)


@query("asp_informative")
def q_asp_informative(spark, sf):
    return _order_clause_chunks(spark, sf, True)


@query("asp_distinct")
def q_asp_distinct(spark, sf):
    a = A.extract_aspects(FX.order_reviews(spark, sf), "review_key", "text", FX.FX_ADJECTIVES, FX.FX_NOUNS)
    return a.select("review_key", "aspect_pos", "aspect_phrase", "aspect_snippet")


@query("asp_entities")
def q_asp_entities(spark, sf):
    """Strict aspects; the part names that begin with hot or cold are the names they must not overlap."""
    names = FX.table(spark, sf, "part").select(F.col("p_name").alias("name")).where(F.split("p_name", " ")[0].isin("hot", "cold")).distinct()
    a = A.extract_aspects(FX.order_reviews(spark, sf), "review_key", "text", FX.FX_ADJECTIVES, FX.FX_NOUNS, strict=True, gazetteer=names)
    return a.select("review_key", "aspect_pos", "aspect_phrase", "aspect_snippet")


@query("asp_general_fallback")
def q_asp_general_fallback(spark, sf):
    a = A.extract_aspects(FX.documents_reviews(spark, sf), "review_key", "text", FX.FX_ADJECTIVES, FX.FX_NOUNS)
    return a.select("review_key", "aspect_pos", "aspect_phrase", "aspect_snippet")


@query("snip_head")
def q_snip_head(spark, sf):
    return _doc_clauses(spark, sf).select("review_key", "clause_pos", A.snippet_head(F.col("clause"), 48).alias("snippet"))


@query("snip_window")
def q_snip_window(spark, sf):
    c = _doc_clauses(spark, sf)
    phrase = F.lower(F.coalesce(F.try_element_at(F.split("clause", " "), F.lit(2)), F.lit("")))
    return c.select("review_key", "clause_pos", A.snippet_window(F.col("clause"), phrase, 12, 32).alias("snippet"))


@query("snip_centered")
def q_snip_centered(spark, sf):
    return _doc_clauses(spark, sf).select("review_key", "clause_pos",
                                          A.snippet_centered(F.col("clause"), 48).alias("snippet"))


# ---------------------------------------------------------------------------
# C: clustering
# ---------------------------------------------------------------------------
from aspectra.operators import clusters as C  # noqa: E402

NON_NOUNS = sorted({w for w, t, _l, _e in FX.fx_token_lexicon_rows() if not t.startswith("NN")})


def _fx_nouns(c):
    """Tokens tagged NN* by the fixture lexicon (unknown words count as nouns)."""
    return F.filter(F.split(c, " "), lambda t: ~L.in_words(t, NON_NOUNS))


def _clusters_scored(spark, sf):
    c = FX.fx_clusters(spark, sf)
    p = FX.table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return c.join(p, c.vec_id == p.p_partkey).drop("p_partkey").withColumn(
        "score", F.round(F.col("p_retailprice") / 2000, 6)).drop("p_retailprice")


@query("clu_silhouette")
def q_clu_silhouette(spark, sf):
    s = C.silhouette(FX.fx_clusters(spark, sf), "vec_id", "embedding", "cluster")
    return s.select(F.round("silhouette", 6).alias("silhouette"))


@query("clu_silhouette_sq")
def q_clu_silhouette_sq(spark, sf):
    s = C.silhouette_sq(FX.fx_clusters(spark, sf), "vec_id", "embedding", "cluster")
    return s.select(F.round("silhouette_sq", 6).alias("silhouette_sq"))


@query("clu_davies_bouldin")
def q_clu_davies_bouldin(spark, sf):
    d = C.davies_bouldin(FX.fx_clusters(spark, sf), "embedding", "cluster")
    return d.select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query("clu_reassign")
def q_clu_reassign(spark, sf):
    r = C.reassign(FX.fx_clusters(spark, sf).select("vec_id", "embedding", "cluster"), "embedding", "cluster", "vec_id")
    return r.select("vec_id", F.col("cluster").cast("long").alias("cluster"))


@query("clu_drop_small")
def q_clu_drop_small(spark, sf):
    d = C.drop_small(FX.fx_clusters(spark, sf).select("vec_id", "cluster"), "cluster", 3)
    return d.select("vec_id", F.col("cluster").cast("long").alias("cluster"))


@query("clu_centroids")
def q_clu_centroids(spark, sf):
    c = C.centroids(FX.fx_clusters(spark, sf), "embedding", "cluster")
    return c.select(F.col("cluster").cast("long").alias("cluster"), F.posexplode("centroid").alias("dim", "v")).select(
        "cluster", F.col("dim").cast("long"), F.round("v", 6).alias("value"))


def _profiled(spark, sf):
    rows = FX.fx_clusters(spark, sf).select("vec_id", "phrase", "cluster")
    m = _matches(spark, sf).select("phrase", "confidence")
    rows = rows.join(m, "phrase", "left").withColumn("is_generic", T.generic_phrase("phrase", FX.FX_GENERIC))
    return C.profile(rows, "cluster", "is_generic", "confidence", 0.5)


@query("clu_profile")
def q_clu_profile(spark, sf):
    p = _profiled(spark, sf)
    return p.select(F.col("cluster").cast("long").alias("cluster"), F.col("size").cast("long"),
                    *[F.round(c, 6).alias(c) for c in ("pass_ratio", "noise_ratio", "generic_ratio", "min_confidence",
                                                       "max_confidence")])


@query("clu_merge_map")
def q_clu_merge_map(spark, sf):
    c = FX.fx_clusters(spark, sf).select("vec_id", "embedding", "cluster")
    return C.merge_map(c, "embedding", _profiled(spark, sf))


@query("clu_labels")
def q_clu_labels(spark, sf):
    lab = C.label_clusters(_clusters_scored(spark, sf), "cluster", "phrase", "score", _fx_nouns)
    return lab.select(F.col("cluster").cast("long").alias("cluster"), "label")


@query("clu_highlights")
def q_clu_highlights(spark, sf):
    h = C.highlights(_clusters_scored(spark, sf), "cluster", "phrase", "score", 5)
    return h.select(F.col("cluster").cast("long").alias("cluster"), "rank", "phrase")


@query("clu_sizes")
def q_clu_sizes(spark, sf):
    s = C.sizes(FX.fx_clusters(spark, sf), "cluster")
    return s.select(F.col("cluster").cast("long").alias("cluster"), F.col("size").cast("long"), "size_rank",
                    F.round("noise_ratio", 6).alias("noise_ratio"), "cluster_count")


@query("clu_noisiest")
def q_clu_noisiest(spark, sf):
    n = C.noisiest(_profiled(spark, sf), "cluster", 5)
    return n.select(F.col("cluster").cast("long").alias("cluster"), "noise_ratio", "rank")


@query("clu_kmeans_sweep")
def q_clu_kmeans_sweep(spark, sf):
    e = FX.table(spark, sf, "embeddings").select("vec_id", "embedding")
    labels, _ = C.kmeans_sweep(e, "embedding")
    return labels.select("vec_id", F.col("cluster").cast("long").alias("cluster"))


DENSITY_CUT = 0.9


@query("clu_density")
def q_clu_density(spark, sf):
    e = FX.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return C.density_labels(e, "vec_id", "embedding", DENSITY_CUT, 2, 2).select("vec_id", F.col("cluster").cast("long").alias("cluster"))


@query("clu_density_tree")
def q_clu_density_tree(spark, sf):
    e = FX.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return C.hierarchy_labels(e, "vec_id", "embedding", 5).select("vec_id", F.col("cluster").cast("long").alias("cluster"))


@query("clu_select_density")
def q_clu_select_density(spark, sf):
    c = FX.fx_clusters(spark, sf).select("vec_id", "embedding", "cluster")
    return C.select_labels(c, "vec_id", "embedding").select("vec_id", F.col("cluster").cast("long").alias("cluster"), "method")


@query("clu_select")
def q_clu_select(spark, sf):
    c = FX.fx_clusters(spark, sf)
    km = C.silhouette(c, "vec_id", "embedding", "cluster").crossJoin(C.davies_bouldin(c, "embedding", "cluster"))
    d = C.drop_small(c, "cluster", 3)
    dens = C.silhouette(d, "vec_id", "embedding", "cluster").crossJoin(
        d.where(F.col("cluster") >= 0).agg(F.countDistinct("cluster").alias("n_clusters")))
    return C.select_method(km, dens, "auto")


# ---------------------------------------------------------------------------
# M: training samples, classifier, fusion
# ---------------------------------------------------------------------------
from aspectra.operators import training as M  # noqa: E402

FX_MODEL_CLASSES = ["Bolt", "Gear", "Ring", "__noise__"]   # probs_noise fixture: 4th class is noise


def _annotated(spark, sf):
    """Domain-filtered rows: phrases matching a rule with confidence >= 0.5, cluster >= 0."""
    rows = FX.fx_clusters(spark, sf).select("vec_id", "phrase", "embedding", "cluster")
    return R.annotate(rows, "phrase", _matches(spark, sf), 0.5).where(F.col("cluster") >= 0)


def _centroids(spark, sf):
    return C.centroids(FX.fx_clusters(spark, sf), "embedding", "cluster")


def _samples(spark, sf):
    rules, _ = _rules(spark, sf)
    ann = _annotated(spark, sf)
    cen = _centroids(spark, sf)
    return (M.seed_samples(rules), M.rule_samples(ann, "vec_id", 0.7), M.cluster_samples(ann, cen),
            M.negative_samples(ann, cen, "vec_id", 42))


def _training_table(spark, sf):
    seed, rule, clus, neg = _samples(spark, sf)
    u = M.union_dedup(seed, rule, clus, neg)
    cen = _centroids(spark, sf).select(F.col("cluster").cast("int").alias("cluster"), "centroid")
    emb = FX.table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("_e"))
    u = u.join(cen, "cluster", "left").join(emb, "seq", "left")
    e = (F.when(F.col("source_rank") == 0, V.hashed_vector("phrase", 64))
         .when(F.col("source_rank") == 2, F.col("centroid"))
         .otherwise(F.transform("_e", lambda x: x.cast("double"))))
    c = F.when(F.col("source_rank") == 0, e).otherwise(F.coalesce(F.col("centroid"), e))
    u = u.withColumn("emb", e).withColumn("cen", c)
    return u.withColumn("features", M.concat_features("emb", "cen")).drop("_e", "centroid")


@query("trn_seed")
def q_trn_seed(spark, sf):
    return _samples(spark, sf)[0].select("phrase", "kpi", "department", F.col("cluster").cast("long"), "seq")


@query("trn_rule")
def q_trn_rule(spark, sf):
    return _samples(spark, sf)[1].select("phrase", "kpi", "department", F.col("cluster").cast("long"), "seq")


@query("trn_cluster")
def q_trn_cluster(spark, sf):
    return _samples(spark, sf)[2].select("phrase", "kpi", "department", F.col("cluster").cast("long"))


@query("trn_negatives")
def q_trn_negatives(spark, sf):
    return _samples(spark, sf)[3].select("phrase", "kpi", "department", F.col("cluster").cast("long"), "seq")


def _union(spark, sf):
    return M.union_dedup(*_samples(spark, sf))


@query("trn_union_dedup")
def q_trn_union_dedup(spark, sf):
    return _union(spark, sf).select("phrase", "kpi", "department", F.col("cluster").cast("long"),
                                    F.col("source_rank").cast("long"))


@query("feat_concat")
def q_feat_concat(spark, sf):
    c = FX.fx_clusters(spark, sf).select("vec_id", "embedding", "cluster")
    cen = _centroids(spark, sf).select("cluster", F.slice("centroid", 1, 48).alias("centroid"))
    j = c.join(F.broadcast(cen), "cluster", "left")  # one row per cluster
    feats = M.concat_features("embedding", F.coalesce(F.col("centroid"), F.array().cast("array<double>")))
    return j.select("vec_id", F.posexplode(feats).alias("dim", "v")).select(
        "vec_id", F.col("dim").cast("long"), F.round("v", 6).alias("value"))


@query("feat_label_index")
def q_feat_label_index(spark, sf):
    return M.label_index(_union(spark, sf), "kpi")


def _split(spark, sf):
    return M.split(_union(spark, sf), ["phrase", "kpi", "cluster"], "kpi", 42)


@query("feat_split")
def q_feat_split(spark, sf):
    return _split(spark, sf).select("phrase", "kpi", F.col("cluster").cast("long"), "is_test")


@query("feat_weights")
def q_feat_weights(spark, sf):
    tr = _split(spark, sf).where(~F.coalesce(F.col("is_test"), F.lit(False)))
    return M.class_weights(tr, "kpi").select("kpi", F.round("weight", 6).alias("weight"))


@query("clf_train_select")
def q_clf_train_select(spark, sf):
    model, labels, s = M.train_classifier(_training_table(spark, sf), "features", "kpi", 42)
    test = s.where(F.coalesce(F.col("is_test"), F.lit(True)))
    pred = model.transform(test).select("phrase", "kpi", F.col("prediction").cast("long").alias("pred_index"))
    return pred.join(F.broadcast(labels.select(F.col("label_index").alias("pred_index"),
                                               F.col("kpi").alias("predicted"))), "pred_index").drop("pred_index")


@query("clf_metrics")
def q_clf_metrics(spark, sf):
    m = M.macro_metrics(FX.pred_pairs(spark, sf))
    return m.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("clf_confusion")
def q_clf_confusion(spark, sf):
    return M.confusion(FX.pred_pairs(spark, sf)).select("y_true", "y_pred", F.col("n").cast("long"))


@query("clf_support")
def q_clf_support(spark, sf):
    return M.support(FX.pred_pairs(spark, sf), "y_true")


@query("clf_proba")
def q_clf_proba(spark, sf):
    t = _training_table(spark, sf)
    model, labels, _ = M.train_classifier(t, "features", "kpi", 42)
    p = M.class_probabilities(model, t.select("phrase", "kpi", "cluster", "features"), "features", labels)
    return p.select("phrase", "kpi", F.col("cluster").cast("long"),
                    F.posexplode("probs").alias("class_index", "probability")).select(
        "phrase", "kpi", "cluster", F.col("class_index").cast("long"), F.round("probability", 6).alias("probability"))


def _fused(spark, sf):
    ph = FX.phrases(spark, sf).select("vec_id", "phrase", "embedding")
    m = _matches(spark, sf).select("phrase", F.col("kpi").alias("rule_kpi"), F.col("department").alias("rule_dept"),
                                   F.col("confidence").alias("rule_conf"))
    rows = ph.join(m, "phrase", "left").withColumn("probs", E.softmax(F.slice("embedding", 1, 4)))
    rules, _ = _rules(spark, sf)
    return M.fuse(rows, "probs", FX_MODEL_CLASSES, "rule_kpi", "rule_dept", "rule_conf", rules.select("kpi", "department"))


@query("fuse_decision")
def q_fuse_decision(spark, sf):
    f = _fused(spark, sf)
    return f.select("vec_id", "kpi", "department", F.round("probability", 6).alias("probability"), "rule_applied",
                    F.round("noise_probability", 6).alias("noise_probability"), "accepted")


@query("fuse_accepted")
def q_fuse_accepted(spark, sf):
    f = _fused(spark, sf).where("accepted")
    return f.select("vec_id", "kpi", F.round("probability", 6).alias("probability"))


# ---------------------------------------------------------------------------
# E1, E6, E10, G, S8: scoring, chains, reports
# ---------------------------------------------------------------------------
from aspectra.operators import report as G  # noqa: E402
from aspectra.operators import textmodel as TM  # noqa: E402
from aspectra.plans import chains as CH  # noqa: E402


@query("sent_lexicon_score")
def q_sent_lexicon_score(spark, sf):
    d = FX.documents_reviews(spark, sf).withColumn("lg", E.lexicon_logits("text", FX.FX_POSITIVE, FX.FX_NEGATIVE))
    p = E.softmax("lg")
    return d.select("review_key", (E.argmax_index(p) + 1).alias("stars"), F.round(F.array_max(p), 6).alias("confidence"))


@query("sent_review")
def q_sent_review(spark, sf):
    d = FX.documents_reviews(spark, sf).select("review_key", T.tokens(T.normalize_light("text")).alias("toks"))
    c = LX.correct_tokens(d, "review_key", "toks", _vocab(spark, sf), 2, prefer="closest")
    c = c.withColumn("text", F.array_join("corrected", " "))
    c = c.withColumn("lg", E.lexicon_logits("text", FX.FX_POSITIVE, FX.FX_NEGATIVE))
    return E.review_sentiment(c, "text", "lg").select("review_key", "text", "sentiment", "confidence")


def _mapping_dim(spark, sf):
    return S.keyword_mapping(_mapping_source(spark, sf), "row_pos")


def _labelled_texts(spark, sf):
    """Labelled documents: 0 toxic, 1 of low quality, 2 good."""
    y = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return FX.table(spark, sf, "documents").join(FX.table(spark, sf, "labels").select("doc_id", y.alias("y")), "doc_id").select("text", "y")


@query("sent_trained")
def q_sent_trained(spark, sf):
    """Every document by the trained scorer: its class, and how far the logits of the others lie below."""
    model = TM.train(_labelled_texts(spark, sf), "text", "y", 3)
    d = E.score_texts(FX.table(spark, sf, "documents").select("doc_id", "text"), "text", TM.scorer(spark, model), 3)
    top = F.array_max("logits")
    return d.select("doc_id", (F.array_position("logits", top) - 1).cast("long").alias("label_index"), F.lit(model.temperature).alias("temperature"),
                    *[F.round(F.get("logits", F.lit(k)) - top, 4).alias(f"below_{k}") for k in range(3)])


def _aspect_table(spark, sf, **kw):
    return CH.aspect_table(FX.orders_reviews(spark, sf), _mapping_dim(spark, sf), FX.FX_ADJECTIVES, FX.FX_NOUNS,
                           FX.FX_ASPECT_POSITIVE, FX.FX_ASPECT_NEGATIVE, **kw)


@query("aspect_table")
def q_aspect_table(spark, sf):
    return _aspect_table(spark, sf)


@query("aspect_table_class3")
def q_aspect_table_class3(spark, sf):
    return _aspect_table(spark, sf, classes=3, source_name="LexiconScorer(3-class)")


@query("aspect_table_trained")
def q_aspect_table_trained(spark, sf):
    """The three-class program with the trained scorer in place of the word lists."""
    model = TM.train(_labelled_texts(spark, sf), "text", "y", 3)
    return _aspect_table(spark, sf, classes=3, scorer=TM.scorer(spark, model), source_name="TrainedScorer(3-class)")


@query("aspect_table_strict")
def q_aspect_table_strict(spark, sf):
    """Symbols cleaned, informative chunks, window snippets, mapping threshold, top-5 weighted vote."""
    return _aspect_table(spark, sf, strict=True, clean_symbols=True, threshold=0.4, top_k_vote=5, classes=3,
                         model_labels={0: "LABEL_NEGATIVE", 1: "LABEL_NEUTRAL", 2: "LABEL_POSITIVE"},
                         source_name="LexiconScorer(strict)")


def _assignments(spark, sf):
    f = _fused(spark, sf).where("accepted")
    c = FX.fx_clusters(spark, sf).select("vec_id", "phrase", "cluster")
    a = f.select("vec_id", "kpi", "department", "probability", "rule_applied").join(c, "vec_id")
    return (a.withColumn("sentiments", F.filter(F.split("phrase", " "), lambda t: L.in_words(t, FX.FX_FUNCTIONAL)))
            .withColumn("is_generic", T.generic_phrase("phrase", FX.FX_GENERIC)))


def _cluster_records(spark, sf):
    labels = C.label_clusters(_clusters_scored(spark, sf), "cluster", "phrase", "score", _fx_nouns)
    return SK.cluster_records(_assignments(spark, sf), labels)


@query("rep_clusters")
def q_rep_clusters(spark, sf):
    cl, _ = _cluster_records(spark, sf)
    return cl.select(F.col("cluster_id").cast("long"), "label", F.round("generic_ratio", 6).alias("generic_ratio"),
                     F.col("n_keywords").cast("long"))


@query("rep_cluster_top15")
def q_rep_cluster_top15(spark, sf):
    t = G.cluster_top_keywords(_assignments(spark, sf), 15, 3)
    return t.select(F.col("cluster").cast("long"), "rank", "phrase", "kpi", "department",
                    F.round("probability", 6).alias("probability"), "source", "sentiments")


@query("rep_run_summary")
def q_rep_run_summary(spark, sf):
    c = FX.fx_clusters(spark, sf)
    sizes = C.sizes(c, "cluster").agg(F.max("cluster_count").alias("cluster_count"),
                                      F.max("noise_ratio").alias("noise_ratio"))
    acc = _fused(spark, sf).agg(F.count_if("accepted").alias("total_keywords"))
    ann = _annotated(spark, sf).agg(F.count(F.lit(1)).alias("retained_candidates"))
    out = G.run_summary({
        "sil": C.silhouette(c, "vec_id", "embedding", "cluster"),
        "dbi": C.davies_bouldin(c, "embedding", "cluster"),
        "clf": M.macro_metrics(FX.pred_pairs(spark, sf)),
        "sizes": sizes, "acc": acc, "ann": ann})
    return out.select(
        F.round("silhouette", 6).alias("silhouette"), F.round("davies_bouldin", 6).alias("davies_bouldin"),
        F.round("precision", 6).alias("classifier_precision"), F.round("recall", 6).alias("classifier_recall"),
        F.round("f1", 6).alias("classifier_f1"), F.round("accuracy", 6).alias("classifier_accuracy"),
        F.col("cluster_count").cast("long"), F.round("noise_ratio", 6).alias("noise_ratio"),
        F.col("total_keywords").cast("long"), F.col("retained_candidates").cast("long"),
        F.lit(0.6).alias("threshold"))


@query("rep_counts")
def q_rep_counts(spark, sf):
    r = FX.order_reviews(spark, sf)
    a = A.extract_aspects(r, "review_key", "text", FX.FX_ADJECTIVES, FX.FX_NOUNS)
    return G.processed_counts(r, a, "review_key")


@query("sink_json_roundtrip")
def q_sink_json_roundtrip(spark, sf):
    cl, kws = _cluster_records(spark, sf)
    summary = spark.range(1).select(F.lit("aspectra").alias("run_name"))
    path = SK.write_json_report(summary, cl, kws, SK.scratch_path(spark, "keywords_json"))
    back = spark.read.schema("cluster_id int, label string, generic_ratio double, n_keywords long").json(f"{path}/clusters")
    kw = spark.read.schema("cluster_id int, rank long, phrase string").json(f"{path}/keywords")
    top = kw.where(F.col("rank") == 1).select("cluster_id", F.col("phrase").alias("top_phrase"))
    return back.join(top, "cluster_id", "left").select(
        F.col("cluster_id").cast("long"), "label", F.round("generic_ratio", 6).alias("generic_ratio"), "n_keywords",
        "top_phrase")


# ---------------------------------------------------------------------------
# X: embedding-ranked keywords (re-aimed: hashed-vector relevance)
# ---------------------------------------------------------------------------
from aspectra.operators import keyphrases as X  # noqa: E402

KX_MIN_COSINE = 0.6


def _kx_docs(spark, sf):
    """Ingested English documents (the data's language column), source = organisation."""
    d = FX.documents_reviews(spark, sf).where(F.col("lang") == "en")
    norm = T.normalize_ws("text")
    clean = F.array_join(TK.clean_tokens(norm), " ")
    return d.select("review_key", F.col("organization_id").alias("source_id"),
                    X.document_text(F.col("text"), norm, clean).alias("document_text"))


def _kx_attributes(spark, sf):
    """Tags from the fixture lexicon; senses: the fixture senses plus every dictionary word
    (the spelling vocabulary) as a one-sense artifact noun."""
    lex = LX.lexicon_table(spark, FX.fx_token_lexicon_rows())
    senses = LX.senses_table(spark, FX.FX_SENSES).unionByName(
        _vocab(spark, sf).select(F.col("term").alias("lemma"), F.lit(1).alias("sense"),
                                 F.lit("noun.artifact").alias("domain")))
    return X.word_attributes(lex, senses, 2)


def _kx_cands(spark, sf):
    return X.candidate_table(_kx_docs(spark, sf), "review_key", "source_id", "document_text", X.WordClasses(),
                             attributes=_kx_attributes(spark, sf), min_cosine=KX_MIN_COSINE)


@query("kx_document_text")
def q_kx_document_text(spark, sf):
    return _kx_docs(spark, sf).select("review_key", "document_text")


@query("kx_candidates")
def q_kx_candidates(spark, sf):
    d = _kx_docs(spark, sf)
    d = d.withColumn("_kept", X.candidate_tokens(F.col("document_text")))
    return d.select("review_key", F.explode(X.ngrams_of(F.col("_kept"))).alias("phrase"))


@query("kx_raw_counts")
def q_kx_raw_counts(spark, sf):
    c = _kx_cands(spark, sf)
    return c.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))


@query("kx_rank_candidates")
def q_kx_rank_candidates(spark, sf):
    return _kx_cands(spark, sf).select("review_key", "cand_rank", "phrase", F.round("score", 6).alias("score"))


@query("kx_reject_reason")
def q_kx_reject_reason(spark, sf):
    return _kx_cands(spark, sf).select("review_key", "cand_rank", "phrase", "reason")


@query("kx_sentiments")
def q_kx_sentiments(spark, sf):
    c = _kx_cands(spark, sf).where(F.col("reason").isNull())
    return c.select("review_key", "phrase", F.array_join("sentiments", ",").alias("sentiments"))


@query("kx_top_per_doc")
def q_kx_top_per_doc(spark, sf):
    c = _kx_cands(spark, sf).where("selected")
    return c.select("review_key", "source_id", "kept_rank", "phrase", F.round("score", 6).alias("score"))


@query("kx_doc_freq")
def q_kx_doc_freq(spark, sf):
    return X.phrase_frequencies(_kx_cands(spark, sf))


def _kx_pruned(spark, sf):
    c = _kx_cands(spark, sf).checkpoint()  # the top-30 table feeds several outputs
    n_docs = _kx_docs(spark, sf).count()
    return c, X.prune(c, X.phrase_frequencies(c), max(n_docs, 1), L.ASPECT_NOUN_WHITELIST | L.HOTEL_DOMAIN_NOUNS), n_docs


@query("kx_prune_freq")
def q_kx_prune_freq(spark, sf):
    _, p, _ = _kx_pruned(spark, sf)
    return p.select("review_key", "phrase", "count", "doc_freq", "prune")


@query("kx_funnel")
def q_kx_funnel(spark, sf):
    c, p, n = _kx_pruned(spark, sf)
    return X.funnel(c, p, n)


@query("kx_drop_examples")
def q_kx_drop_examples(spark, sf):
    c, p, _ = _kx_pruned(spark, sf)
    return X.drop_examples(c, p, 10).select("reason", "rank", "phrase", "n")


@query("kx_top_phrases")
def q_kx_top_phrases(spark, sf):
    return X.top_phrases(_kx_cands(spark, sf), 10).select("rank", "phrase", "n")


def _main_program(spark, sf):
    """Chain A over the documents; the KPIs are the corpus's ten most frequent keyphrases."""
    cands, pruned, _ = _kx_pruned(spark, sf)
    kpis = X.top_phrases(cands, 10).select(F.initcap("phrase").alias("kpi"))
    return CH.phrase_program(pruned.where(F.col("prune").isNull()).select("phrase", "score"), kpis,
                             FX.department_names(spark, sf), R.synonym_table(spark, FX.FX_SYNONYMS), FX.FX_DEPT_HINTS)


@query("main_assignments")
def q_main_assignments(spark, sf):
    a = _main_program(spark, sf)["assignments"]
    return a.select("vec_id", "phrase", F.col("n").cast("long"), F.col("cluster").cast("long"), "kpi", "department",
                    F.round("probability", 6).alias("probability"), "rule_applied", "accepted")


@query("main_summary")
def q_main_summary(spark, sf):
    out = _main_program(spark, sf)
    return G.run_summary({k: out[k] for k in ("decisions", "clusters", "quality", "classifier")})
