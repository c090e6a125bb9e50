"""End-to-end chains of the reference programs, as one lineage each.

* ``aspect_table`` — reviews -> aspects -> nearest catalogue keyword -> aspect
  sentiment -> review verdict -> the 19-column table (chain B).
* ``phrase_program`` — keyphrase records -> canonical phrases -> clusters -> rules ->
  classifier -> fused decisions (chain A).
* ``keyword_report`` lives in ``operators.ngrams`` (chain C).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.functions.ops import global_rank
from aspectra.functions.text import symbol_cleanup
from aspectra.operators import aspects as A
from aspectra.operators import clusters as C
from aspectra.operators import rules as R
from aspectra.operators import sentiment as E
from aspectra.operators import training as M
from aspectra.operators import vectors as V

ASPECT_COLUMNS = [
    "REVIEW_ID", "ORGANIZATION_ID", "Original_Review", "N_gram", "Matched_Keyword", "Cosine_Similarity", "KPI_ID",
    "KPI_Name", "Department_ID", "Department_Name", "Aspect_Phrase", "Aspect_Snippet", "Aspect_Sentiment",
    "Confidence_Sentiment", "Stars", "Sentiment_Source", "Review_Sentiment", "Review_Confidence", "Aggregation_Method",
]


def aspect_table(reviews: DataFrame, mapping: DataFrame, adjectives, nouns, positive, negative, *,
                 key: str = "review_key", text_col: str = "text", org_col: str | None = "organization_id",
                 dim: int = 64, strict: bool = False, threshold: float | None = None, top_k_vote: int | None = None,
                 classes: int = 5, model_labels: dict[int, str] | None = None, clean_symbols: bool = False,
                 scorer=None, gazetteer: DataFrame | None = None, source_name: str = "LexiconScorer(aspect-first)") -> DataFrame:
    """Chain B.  ``key``: unique per review (the row position when the source has no id).
    ``mapping``: (keyword, pos, KPI_ID, KPI_NAME, DEPARTMENT_ID, DEPARTMENT_NAME), one row per
    keyword (S5).  ``clean_symbols`` applies T4 first; ``threshold`` enables the strict mapping
    (V8); ``top_k_vote`` the confidence-weighted vote (E8) instead of the majority vote (E7);
    ``classes`` = 3 scores three classes, named by E4 or, with ``model_labels``, by E5;
    ``gazetteer`` holds the names that strict aspects must not overlap (A2);
    ``scorer`` (see ``textmodel``) gives the logits, else the word lists do.

    Aspects are scored and voted on before they are mapped, and carry no review text: text,
    organisation and verdict join them once, at the end."""
    if clean_symbols:
        reviews = reviews.withColumn(text_col, symbol_cleanup(text_col))
    asp = A.extract_aspects(reviews, key, text_col, adjectives, nouns, strict=strict, gazetteer=gazetteer).drop(text_col)
    if scorer is not None:
        asp = E.score_texts(asp, "aspect_snippet", scorer, classes, "_lg")
    else:
        asp = asp.withColumn("_lg", E.lexicon_logits("aspect_snippet", positive, negative, classes))
    asp = E.score_aspects(asp, "aspect_snippet", "_lg", classes == 5)
    if model_labels:
        label, stars = E.normalize_label(E.argmax_index(E.softmax("_lg")), model_labels)
        asp = asp.withColumns({"Aspect_Sentiment": label, "Stars": stars})
    asp = asp.drop("_lg")
    # the scored rows feed the vote, the phrase encoding and the final join: materialised once
    asp = asp.checkpoint()
    if top_k_vote:
        verdict = E.vote_topk(asp, [key], "aspect_pos", top_k_vote, "Aspect_Sentiment", "Confidence_Sentiment")
    else:
        verdict = E.vote_majority(asp, [key], "Aspect_Sentiment", "Confidence_Sentiment").drop("n_aspects")
    cat = mapping.select("keyword", "pos", "KPI_ID", "KPI_NAME", "DEPARTMENT_ID", "DEPARTMENT_NAME",
                         V.hashed_vector("keyword", dim).alias("kv"))
    # each distinct phrase is encoded and matched once, then joined back to its aspect rows
    ph = V.encode_distinct(asp, "aspect_phrase", dim, "_av")
    best = V.nearest_keyword(ph, "_av", cat, "pos", "kv").drop("_av")
    best = best.join(cat.drop("kv"), best.kw_index == cat.pos, "left").drop("kw_index", "pos").select(
        "aspect_phrase", "cosine_similarity", F.col("keyword").alias("Matched_Keyword"), "KPI_ID",
        F.col("KPI_NAME").alias("KPI_Name"), F.col("DEPARTMENT_ID").alias("Department_ID"),
        F.col("DEPARTMENT_NAME").alias("Department_Name"))
    if threshold is not None:
        best = V.apply_threshold(best, "aspect_phrase", "Matched_Keyword", threshold,
                                 ("KPI_ID", "KPI_Name", "Department_ID", "Department_Name")).drop("unmapped_before")
    org = F.col(org_col).cast("string") if org_col else F.lit(None).cast("string")
    about = reviews.select(key, F.trim(F.col(text_col)).alias("Original_Review"), org.alias("ORGANIZATION_ID")).join(
        verdict, key, "left")
    out = asp.join(best, "aspect_phrase", "left").join(about, key)
    return out.select(
        F.col(key).alias("REVIEW_ID"), "ORGANIZATION_ID", "Original_Review",
        F.col("aspect_phrase").alias("N_gram"), "Matched_Keyword",
        F.round("cosine_similarity", 4).alias("Cosine_Similarity"), F.col("KPI_ID").cast("string").alias("KPI_ID"),
        "KPI_Name", F.col("Department_ID").cast("string").alias("Department_ID"), "Department_Name",
        F.col("aspect_phrase").alias("Aspect_Phrase"), F.col("aspect_snippet").alias("Aspect_Snippet"),
        "Aspect_Sentiment", "Confidence_Sentiment", "Stars", F.lit(source_name).alias("Sentiment_Source"),
        F.col("review_sentiment").alias("Review_Sentiment"),
        F.round("review_confidence", 3).alias("Review_Confidence"),
        F.lit(f"Top{top_k_vote}ConfidenceWeighted" if top_k_vote else "MajorityVote+TieBreak+NeutralFix")
        .alias("Aggregation_Method"))


def phrase_program(records: DataFrame, kpis: DataFrame, departments: DataFrame, synonyms: DataFrame, hints, *,
                   dim: int = 64, dedup_threshold: float = 0.4, max_k: int = 40, min_size: int = 3,
                   min_confidence: float = 0.5, seed: int = 42, algorithm: str = "auto") -> dict[str, DataFrame]:
    """Chain A, the main program, as one lineage: pruned keyphrase records (X8) -> vectors (V1)
    -> canonical phrases (V4) -> clusters (C1, C4, C5, C6, C7) -> rules (R1-R6) -> samples (M1-M5)
    -> classifier (M10, M13) -> fused decisions (M14, M15).

    ``records``: phrase, score, one row per selected record.  Returns ``assignments`` (one
    row per canonical phrase) and the one-row tables ``clusters``, ``quality``,
    ``classifier`` and ``decisions``.  Each stage that feeds several others is checkpointed."""
    ph = records.groupBy("phrase").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
    ph = global_rank(ph, F.col("phrase"), "vec_id").withColumn("vec_id", F.col("vec_id") - 1)
    ph = ph.withColumn("embedding", V.hashed_vector("phrase", dim)).checkpoint()
    nearest = V.nearest_within(ph, "vec_id", "embedding", dedup_threshold)
    canonical = V.canonical_ids(ph.select("vec_id"), nearest, "vec_id")
    merged = ph.join(canonical, "vec_id").groupBy(F.col("canonical").alias("vec_id")).agg(
        F.max("score").alias("score"), F.sum("n").alias("n"))
    points = merged.join(ph.select("vec_id", "phrase", "embedding"), "vec_id").checkpoint()

    labelled, _ = C.kmeans_sweep(points, "embedding", 2, max_k)
    labelled = C.select_labels(labelled.checkpoint(), "vec_id", "embedding", algorithm).drop("method")
    labelled = C.reassign(labelled, "embedding", "cluster", "vec_id", min_size)
    labelled = C.drop_small(labelled, "cluster", min_size).checkpoint()
    centroids = C.centroids(labelled, "embedding", "cluster").select(
        F.col("cluster").cast("int").alias("cluster"), "centroid").checkpoint()

    rules, weights = R.build_rules(kpis, departments, synonyms, hints)
    matches = R.match_rules(labelled, "phrase", rules, weights).checkpoint()
    annotated = R.annotate(labelled, "phrase", matches, min_confidence).where(F.col("cluster") >= 0)
    samples = M.union_dedup(M.seed_samples(rules), M.rule_samples(annotated, "vec_id", 0.7),
                            M.cluster_samples(annotated, centroids),
                            M.negative_samples(annotated, centroids, "vec_id", seed))
    samples = samples.join(centroids, "cluster", "left").join(
        labelled.select(F.col("vec_id").alias("seq"), F.col("embedding").alias("own")), "seq", "left")
    vector = (F.when(F.col("source_rank") == 0, V.hashed_vector("phrase", dim))
              .when(F.col("source_rank") == 2, F.col("centroid")).otherwise(F.col("own")))
    samples = samples.withColumn("vector", vector).withColumn(
        "features", M.concat_features("vector", F.coalesce("centroid", "vector")))
    model, labels, split = M.train_classifier(samples.drop("centroid", "own", "vector"), "features", "kpi", seed)
    tested = model.transform(split.where(F.coalesce("is_test", F.lit(True)))).select(
        F.col("label_index").alias("y_true"), F.col("prediction").cast("long").alias("y_pred"))

    rows = labelled.join(centroids, "cluster", "left").withColumn(
        "features", M.concat_features("embedding", F.coalesce("centroid", "embedding")))
    scored = M.class_probabilities(model, rows.drop("centroid"), "features", labels)
    scored = scored.join(matches.select("phrase", F.col("kpi").alias("rule_kpi"), F.col("department").alias("rule_dept"),
                                        F.col("confidence").alias("rule_conf")), "phrase", "left")
    classes = [r["kpi"] for r in labels.orderBy("label_index").collect()]  # one row per class
    fused = M.fuse(scored, "probs", classes, "rule_kpi", "rule_dept", "rule_conf", rules.select("kpi", "department"))
    fused = fused.select("vec_id", "phrase", "score", "n", "cluster", "kpi", "department", "probability",
                         "noise_probability", "rule_applied", "accepted").checkpoint()
    return {
        "assignments": fused,
        "clusters": C.sizes(labelled, "cluster").agg(F.max("cluster_count").alias("cluster_count"),
                                                     F.max("noise_ratio").alias("noise_ratio")),
        "quality": C.silhouette_sq(labelled, "vec_id", "embedding", "cluster").crossJoin(
            C.davies_bouldin(labelled, "embedding", "cluster")),
        "classifier": M.macro_metrics(tested),
        "decisions": fused.agg(F.count(F.lit(1)).alias("phrases"), F.count_if("accepted").alias("accepted"),
                               F.count_if("rule_applied").alias("by_rule")),
    }
