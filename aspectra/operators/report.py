"""Reports (G1–G4): cluster summaries, top keywords, run summary, processed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_top_keywords(assignments: DataFrame, k: int = 15, n_sentiments: int = 3) -> DataFrame:
    """Per cluster the k most probable accepted keywords (phrase asc on ties) with a
    RULE / MODEL flag and at most ``n_sentiments`` sentiments joined by ','."""
    from aspectra.functions.ops import topk
    t = topk(assignments, ["cluster"], [F.col("probability").desc(), F.col("phrase")], k)
    return t.select("cluster", "rank", "phrase", "kpi", "department", "probability",
                    F.when(F.col("rule_applied"), "RULE").otherwise("MODEL").alias("source"),
                    F.array_join(F.slice("sentiments", 1, n_sentiments), ",").alias("sentiments"))


def run_summary(metrics: dict[str, DataFrame]) -> DataFrame:
    """One row joining one-row metric tables (each a scalar broadcast)."""
    out = None
    for _name, df in metrics.items():
        out = df if out is None else out.crossJoin(F.broadcast(df))
    return out


def processed_counts(reviews: DataFrame, aspects: DataFrame, key: str) -> DataFrame:
    """Reviews in and aspect rows out."""
    r = reviews.agg(F.count(F.lit(1)).alias("reviews_in"))
    a = aspects.agg(F.count(F.lit(1)).alias("aspect_rows"), F.countDistinct(key).alias("reviews_with_aspects"))
    return r.crossJoin(a)


__all__ = ["Window", "cluster_top_keywords", "run_summary", "processed_counts"]
