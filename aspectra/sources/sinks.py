"""CSV and JSON sinks.

Writes go to a folder under the session's checkpoint directory (the shared
folder a cluster names in ``spark.checkpoint.dir``) unless a path is given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions.ops import global_rank
from aspectra.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/out-{name}-{uuid.uuid4().hex[:12]}"


def write_csv(df: DataFrame, path: str) -> str:
    """Header CSV, no index column; parallel part files (no single-task funnel)."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return r.schema(schema).csv(path) if schema else r.csv(path)


def cluster_records(assignments: DataFrame, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, keywords).  ``clusters``: cluster_id, label, generic_ratio,
    n_keywords; ``keywords``: one line per (cluster, phrase) with its rank by probability
    desc (phrase asc on ties).  The reference nests the keyword list inside each cluster;
    here the list is kept as ranked lines so no cluster's keywords are gathered into one
    in-memory array (a cluster may hold a large share of all phrases).

    Expects columns cluster, phrase, kpi, department, probability, rule_applied,
    sentiments, is_generic.
    """
    g = assignments.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_keywords"),
        (1.0 - F.sum(F.when(~F.col("is_generic"), 1).otherwise(0)) / F.greatest(F.count(F.lit(1)), F.lit(1)))
        .alias("generic_ratio"))
    g = g.withColumnRenamed("cluster", "cluster_id")
    if labels is not None:
        g = g.join(labels.select(F.col("cluster").alias("cluster_id"), "label"), "cluster_id", "left")
    else:
        g = g.withColumn("label", F.lit(None).cast("string"))
    g = g.withColumn("label", F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))))
    # rank inside the cluster from one global rank, so that a large cluster is not one task
    ranked = global_rank(assignments, F.struct(F.col("cluster"), (-F.col("probability")).alias("p"), F.col("phrase")), "_r")
    first = ranked.groupBy("cluster").agg(F.min("_r").alias("_first"))
    kws = ranked.join(first, "cluster").select(
        F.col("cluster").alias("cluster_id"), (F.col("_r") - F.col("_first") + 1).cast("long").alias("rank"), "phrase",
        "kpi", "department", "probability", "rule_applied", "sentiments")
    return g, kws


def write_json_report(summary: DataFrame, clusters: DataFrame, keywords: DataFrame, path: str) -> str:
    """Run summary, cluster records and keyword lines as JSON lines under one folder
    (``run_summary/``, ``clusters/``, ``keywords/``)."""
    summary.write.mode("overwrite").json(f"{path}/run_summary")
    clusters.write.mode("overwrite").json(f"{path}/clusters")
    keywords.write.mode("overwrite").json(f"{path}/keywords")
    return path
