"""Domain rules from KPI names.

The rule table is a dimension (one row per KPI keyword, bounded by the KPI list);
which keywords lie inside which phrases comes from one pass of a multi-pattern
automaton (``functions.matching``), then equi-joins and one aggregation per phrase.
Work is linear in the phrases; keyword lists of any size are cut into shards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra import lexicons as L
from aspectra.functions.matching import contained


def kpi_tokens(kpis: DataFrame, kpi_col: str = "kpi") -> DataFrame:
    """Distinct trimmed KPI names with their letter tokens: (kpi, tokens, unique_tokens, kpi_rank).
    ``kpi_rank`` is the position in sorted KPI order (first rule wins ties)."""
    k = kpis.select(F.trim(F.col(kpi_col)).alias("kpi")).where(F.col("kpi") != "").distinct()
    toks = F.regexp_extract_all(F.lower("kpi"), F.lit("[a-zA-Z]+"), 0)
    k = k.select("kpi", toks.alias("tokens")).where(F.size("tokens") > 0)
    k = k.withColumn("unique_tokens", F.array_sort(F.array_distinct("tokens")))
    return k.withColumn("kpi_rank", F.dense_rank().over(_global_order("kpi")).cast("long"))


def _global_order(col: str):
    from pyspark.sql import Window
    # one row per KPI: the KPI list is a small dimension
    return Window.orderBy(col)


def token_idf(kt: DataFrame) -> DataFrame:
    """idf = ln((1+N)/(1+df)) + 1 over KPIs (not reviews); N = max(1, #KPIs)."""
    t = kt.select("kpi", F.explode("unique_tokens").alias("keyword"))
    dfc = t.groupBy("keyword").agg(F.count(F.lit(1)).alias("df"))
    n = kt.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("N"))
    return (t.join(dfc, "keyword").crossJoin(F.broadcast(n))  # one-row total
            .select("kpi", "keyword", (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1).alias("weight")))


def synonym_table(spark: SparkSession, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(tok, s.lower()) for tok, syns in synonyms.items() for s in syns]
    return spark.createDataFrame(rows, "token string, synonym string")


def keyword_weights(kt: DataFrame, synonyms: DataFrame, synonym_weight: float = 0.45) -> DataFrame:
    """R1 + R2: token idf weights plus synonyms of the KPI's tokens at ``synonym_weight``
    unless the synonym is already one of its keywords: (kpi, keyword, weight, source)."""
    idf = token_idf(kt).withColumn("source", F.lit("token"))
    t = kt.select("kpi", F.explode("unique_tokens").alias("token"))
    syn = (t.join(synonyms, "token").select("kpi", F.col("synonym").alias("keyword")).distinct()
           .join(idf.select("kpi", "keyword"), ["kpi", "keyword"], "left_anti")
           .withColumn("weight", F.lit(float(synonym_weight))).withColumn("source", F.lit("synonym")))
    return idf.unionByName(syn)


def infer_department(kt: DataFrame, hints: Sequence[tuple[str, str]], departments: DataFrame) -> DataFrame:
    """First hint (token-major over sorted unique tokens, then hint order) that is a
    substring of a token; else the first department whose letters-only lower-case name
    is inside a letters-only token (department-major); else the first department; else
    'General'.  ``departments``: (department, pos)."""
    spark = kt.sparkSession
    h = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(hints)], "hint_pos int, hint string, dept string")
    t = kt.select("kpi", F.posexplode("unique_tokens").alias("tok_pos", "token"))
    by_hint = (t.join(F.broadcast(h), F.col("token").contains(F.col("hint")))
               .groupBy("kpi").agg(F.min_by("dept", F.struct("tok_pos", "hint_pos")).alias("d1")))
    d = departments.select(F.col("department"), F.col("pos"),
                           F.regexp_replace(F.lower("department"), "[^a-z]", "").alias("norm")).where(F.col("norm") != "")
    letters = t.withColumn("text", F.regexp_replace("token", "[^a-z]", ""))
    inside = contained(letters, d.select(F.col("norm").alias("word"))).withColumnRenamed("word", "norm")
    by_name = (letters.join(inside, "text").join(d, "norm")
               .groupBy("kpi").agg(F.min_by("department", F.struct("pos", "tok_pos")).alias("d2")))
    first = departments.agg(F.min_by("department", "pos").alias("d3"))
    out = (kt.select("kpi").join(by_hint, "kpi", "left").join(by_name, "kpi", "left")
           .crossJoin(F.broadcast(first)))  # one-row default
    return out.select("kpi", F.coalesce("d1", "d2", "d3", F.lit("General")).alias("department"))


def rule_table(kt: DataFrame, weights: DataFrame, departments: DataFrame) -> DataFrame:
    """Kpi, department, sorted keywords, weight map, primary tokens / phrase and
    target weight = max(sum of primary-token weights, 1)."""
    agg = weights.groupBy("kpi").agg(
        F.array_sort(F.collect_list("keyword")).alias("keywords"),
        F.map_from_entries(F.collect_list(F.struct("keyword", "weight"))).alias("keyword_weights"),
        F.sum(F.when(F.col("source") == "token", F.col("weight")).otherwise(0.0)).alias("_tw"))
    return (kt.join(agg, "kpi").join(departments, "kpi")
            .select("kpi", "kpi_rank", "department", "keywords", "keyword_weights",
                    F.col("unique_tokens").alias("primary_tokens"),
                    F.array_join("tokens", " ").alias("primary_phrase"),
                    F.greatest(F.col("_tw"), F.lit(1.0)).alias("target_weight")))


def build_rules(kpis: DataFrame, departments: DataFrame, synonyms: DataFrame,
                hints: Sequence[tuple[str, str]] = L.DEPARTMENT_HINTS, synonym_weight: float = 0.45):
    """R1–R4 together: (rules, weights) — rules one row per KPI, weights one row per keyword.

    The rule dimension is small and used by many branches, so its pieces are
    checkpointed (reliably, to the shared checkpoint folder) to cut the lineage."""
    kt = kpi_tokens(kpis).checkpoint()
    w = keyword_weights(kt, synonyms, synonym_weight).checkpoint()
    dep = infer_department(kt, hints, departments)
    return rule_table(kt, w, dep).checkpoint(), w


def match_rules(phrases: DataFrame, phrase_col: str, rules: DataFrame, weights: DataFrame) -> DataFrame:
    """For each distinct phrase, the best rule: sum of weights of keywords that are
    SUBSTRINGS of the lower-cased phrase; confidence = min(1, sum/target); first rule in
    KPI order on ties; phrases without any keyword hit get no row.
    Returns (phrase, kpi, department, confidence)."""
    kw = weights.join(rules.select("kpi", "kpi_rank", "target_weight", "department"), "kpi").where(F.col("keyword") != "")
    p = phrases.select(F.col(phrase_col).alias("phrase"), F.lower(F.col(phrase_col)).alias("text")).distinct()
    found = contained(p, kw.select(F.col("keyword").alias("word"))).withColumnRenamed("word", "keyword")
    hits = p.join(found, "text").join(kw, "keyword")
    per_rule = hits.groupBy("phrase", "kpi", "kpi_rank", "department", "target_weight").agg(
        F.sum("weight").alias("matched"))
    per_rule = per_rule.where(F.col("matched") > 0).withColumn(
        "confidence", F.least(F.lit(1.0), F.col("matched") / F.greatest(F.col("target_weight"), F.lit(1e-6))))
    best = per_rule.groupBy("phrase").agg(
        F.max_by(F.struct("kpi", "department", "confidence"), F.struct("confidence", -F.col("kpi_rank"))).alias("b"))
    return best.select("phrase", F.col("b.kpi").alias("kpi"), F.col("b.department").alias("department"),
                       F.col("b.confidence").alias("confidence"))


def annotate(rows: DataFrame, phrase_col: str, matches: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Rows whose phrase matches a rule with confidence >= min_confidence, with
    domain_kpi / domain_department / domain_confidence added."""
    m = matches.select(F.col("phrase").alias(phrase_col), F.col("kpi").alias("domain_kpi"),
                       F.col("department").alias("domain_department"), F.col("confidence").alias("domain_confidence"))
    return rows.join(m, phrase_col).where(F.col("domain_confidence") >= min_confidence)


def retention(all_rows: DataFrame, annotated: DataFrame, phrase_col: str = "phrase",
              cluster_col: str = "cluster") -> DataFrame:
    """Matched rows and unique phrases among clusters >= 0, and rows filtered out."""
    kept = annotated.where(F.col(cluster_col) >= 0)
    a = kept.agg(F.count(F.lit(1)).alias("matched_rows"), F.countDistinct(phrase_col).alias("matched_unique_phrases"))
    t = all_rows.agg(F.count(F.lit(1)).alias("_n"))
    return a.crossJoin(t).select("matched_rows", "matched_unique_phrases",
                                 (F.col("_n") - F.col("matched_rows")).alias("filtered_out"))
