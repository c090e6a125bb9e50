"""Training-set construction, classifier and rule–model fusion.

Sample builders are DataFrame unions with an explicit source rank; the hold-out
split and hard negatives use a seeded md5 order instead of a shared random
generator, so they are deterministic under retries and partitioning.  The
classifier is ``pyspark.ml`` multinomial logistic regression with class weights
(Spark's boosted trees are binary only), chosen by macro F1 over a small grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.functions.ops import global_rank

NOISE = "__noise__"


def _md5_order(*cols, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols], F.lit(str(seed))))


# ---------------------------------------------------------------------------
# M1–M5: samples
# ---------------------------------------------------------------------------

def seed_samples(rules: DataFrame) -> DataFrame:
    """M1: per rule the primary phrase and its first 3 sorted keywords (trimmed, non-empty),
    cluster -1: (phrase, kpi, department, cluster, seq)."""
    cand = F.concat(F.array("primary_phrase"), F.slice("keywords", 1, 3))
    x = rules.select("kpi", "kpi_rank", "department", F.posexplode(cand).alias("i", "phrase"))
    x = x.withColumn("phrase", F.trim("phrase")).where(F.col("phrase") != "")
    return x.select("phrase", "kpi", "department", F.lit(-1).alias("cluster"),
                    (F.col("kpi_rank") * 10 + F.col("i")).cast("long").alias("seq"))


def rule_samples(annotated: DataFrame, order_col: str, min_conf: float = 0.7) -> DataFrame:
    """M2: annotated rows with rule confidence >= min_conf."""
    return annotated.where(F.col("domain_confidence") >= min_conf).select(
        "phrase", F.col("domain_kpi").alias("kpi"), F.col("domain_department").alias("department"),
        F.col("cluster").cast("int").alias("cluster"), F.col(order_col).cast("long").alias("seq"))


def cluster_samples(annotated: DataFrame, centroid_ids: DataFrame) -> DataFrame:
    """M3: per cluster >= 0 with a centroid: majority KPI and majority department (each
    the smallest value on ties), phrase 'cluster_<id>_centroid'."""
    a = annotated.where(F.col("cluster") >= 0).join(F.broadcast(centroid_ids.select("cluster")), "cluster")
    g = a.groupBy("cluster").agg(F.mode("domain_kpi", True).alias("kpi"),
                                 F.mode("domain_department", True).alias("department"))
    return g.select(F.concat(F.lit("cluster_"), F.col("cluster").cast("string"), F.lit("_centroid")).alias("phrase"),
                    "kpi", "department", F.col("cluster").cast("int"), F.col("cluster").cast("long").alias("seq"))


def negative_samples(annotated: DataFrame, centroid_ids: DataFrame, order_col: str, seed: int = 42) -> DataFrame:
    """M4: every row of a cluster >= 0 paired with one OTHER cluster's centroid, chosen by a
    seeded md5 order; kpi '__noise__', department 'Unknown'.  None with <= 1 centroid.
    The partner is found in the row, from the sorted list of cluster ids; nothing is joined."""
    cids = centroid_ids.agg(F.array_sort(F.collect_set("cluster")).alias("_all"))  # one row of K numbers
    a = annotated.where(F.col("cluster") >= 0).select("phrase", "cluster", order_col).crossJoin(F.broadcast(cids))
    keyed = F.transform(F.filter("_all", lambda c: c != F.col("cluster")),
                        lambda c: F.struct(_md5_order(F.col("phrase"), c, seed=seed).alias("k"), c.alias("alt")))
    pick = a.select("phrase", "cluster", order_col, F.array_min(keyed)["alt"].alias("alt")).where(
        F.col("alt").isNotNull()).dropDuplicates(["phrase", "cluster", order_col])
    return pick.select(F.concat(F.col("phrase"), F.lit("__neg_"), F.col("alt").cast("string")).alias("phrase"),
                       F.lit(NOISE).alias("kpi"), F.lit("Unknown").alias("department"),
                       F.col("alt").cast("int").alias("cluster"), F.col(order_col).cast("long").alias("seq"))


def union_dedup(seed: DataFrame, rule: DataFrame, cluster: DataFrame, negative: DataFrame) -> DataFrame:
    """M5: seed, rule, cluster, negative in that order; the first row per (phrase, kpi, cluster)."""
    parts = [d.withColumn("source_rank", F.lit(i)) for i, d in enumerate([seed, rule, cluster, negative])]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy("phrase", "kpi", "cluster").orderBy("source_rank", "seq")
    return u.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


# ---------------------------------------------------------------------------
# M6–M9: features, labels, split, weights
# ---------------------------------------------------------------------------

def concat_features(embedding, centroid) -> Column:
    """M6: embedding ++ centroid; an empty centroid means the embedding; another length is
    cyclically repeated / cut to the embedding's length."""
    e = F.transform(F.col(embedding) if isinstance(embedding, str) else embedding, lambda x: x.cast("double"))
    c = F.transform(F.col(centroid) if isinstance(centroid, str) else centroid, lambda x: x.cast("double"))
    c = F.when(F.size(c) == 0, e).otherwise(c)
    n = F.size(e)
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    resized = F.transform(idx, lambda i: F.element_at(c, (i % F.size(c)) + 1))
    return F.concat(e, F.when(F.size(c) == n, c).otherwise(resized))


def label_index(samples: DataFrame, label_col: str = "kpi") -> DataFrame:
    """M7: sorted distinct labels -> 0..n-1 (one row per label)."""
    labels = samples.select(label_col).distinct()
    return labels.withColumn("label_index", (F.dense_rank().over(Window.orderBy(label_col)) - 1).cast("long"))


def split(samples: DataFrame, key_cols: Sequence[str], label_col: str = "kpi", seed: int = 42) -> DataFrame:
    """M8: hold-out flag ``is_test``: 25% when n >= 40 else 20%; stratified (per label,
    round half up) when every label has >= 2 rows, else one global md5 order; no split
    (every row both train and test -> is_test null) with <= 4 rows or a single label."""
    stats = samples.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label_col).alias("k")).collect()[0]
    n, k = stats["n"], stats["k"]
    if n <= 4 or k <= 1:
        return samples.withColumn("is_test", F.lit(None).cast("boolean"))
    f = 0.25 if n >= 40 else 0.2
    min_class = samples.groupBy(label_col).count().agg(F.min("count")).collect()[0][0]
    order = _md5_order(*key_cols, seed=seed)
    if min_class >= 2:
        # position inside the label from one global (label, md5) rank: no label is one task
        ranked = global_rank(samples, F.struct(F.col(label_col), order.alias("o")), "_r")
        own = ranked.groupBy(label_col).agg(F.min("_r").alias("_first"), F.count(F.lit(1)).alias("_n"))
        return ranked.join(own, label_col).withColumn(
            "is_test", F.col("_r") - F.col("_first") + 1 <= F.floor(F.col("_n") * f + 0.5)).drop("_r", "_first", "_n")
    # unstratified: one global md5 order, ranked without a single-partition window
    ranked = global_rank(samples, order, "_r")
    return ranked.withColumn("is_test", F.col("_r") <= int(n * f + 0.5)).drop("_r")


def class_weights(train: DataFrame, label_col: str = "kpi") -> DataFrame:
    """M9: balanced weights N_train / (classes * count)."""
    c = train.groupBy(label_col).agg(F.count(F.lit(1)).alias("cnt"))
    tot = Window.partitionBy(F.lit(1))  # one row per class
    return c.select(label_col, (F.sum("cnt").over(tot) / (F.count(F.lit(1)).over(tot) * F.col("cnt"))).alias("weight"))


# ---------------------------------------------------------------------------
# Classifier and metrics
# ---------------------------------------------------------------------------

def macro_metrics(pairs: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Accuracy and macro precision / recall / F1 over the union of true and
    predicted labels; 0 on zero division."""
    labels = pairs.select(F.col(y).alias("lab")).union(pairs.select(F.col(p).alias("lab"))).distinct()
    tp = pairs.where(F.col(y) == F.col(p)).groupBy(F.col(y).alias("lab")).agg(F.count(F.lit(1)).alias("tp"))
    pc = pairs.groupBy(F.col(p).alias("lab")).agg(F.count(F.lit(1)).alias("pc"))
    tc = pairs.groupBy(F.col(y).alias("lab")).agg(F.count(F.lit(1)).alias("tc"))
    j = labels.join(tp, "lab", "left").join(pc, "lab", "left").join(tc, "lab", "left").fillna(0, ["tp", "pc", "tc"])
    prec = F.when(F.col("pc") > 0, F.col("tp") / F.col("pc")).otherwise(0.0)
    rec = F.when(F.col("tc") > 0, F.col("tp") / F.col("tc")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    per = j.select(prec.alias("p"), rec.alias("r"), f1.alias("f"), "tp", "tc")
    return per.agg(
        (F.sum("tp") / F.sum("tc")).alias("accuracy"), F.avg("p").alias("precision"),
        F.avg("r").alias("recall"), F.avg("f").alias("f1"))


def confusion(pairs: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Counts for every (true, predicted) label pair of the label union, zeros included."""
    labels = pairs.select(F.col(y).alias("lab")).union(pairs.select(F.col(p).alias("lab"))).distinct()
    grid = labels.select(F.col("lab").alias(y)).crossJoin(labels.select(F.col("lab").alias(p)))  # classes x classes
    cnt = pairs.groupBy(y, p).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(cnt, [y, p], "left").fillna(0, ["n"])


def support(rows: DataFrame, y: str) -> DataFrame:
    """Class support."""
    return rows.groupBy(F.col(y).alias("label")).agg(F.count(F.lit(1)).alias("support"))


def train_classifier(samples: DataFrame, features_col: str, label_col: str = "kpi", seed: int = 42,
                     reg_params=(0.0, 0.01, 0.1)):
    """Weighted multinomial logistic regression; the grid point with the best macro F1
    on the hold-out is refit on the training rows.  Returns (model, labels, split rows)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    samples = samples.checkpoint()  # cut the sample lineage before the repeated fits
    idx = label_index(samples, label_col).checkpoint()
    s = samples.join(F.broadcast(idx), label_col)  # one row per class
    s = split(s, ["phrase", label_col, "cluster"], label_col, seed)
    s = s.withColumn("features", array_to_vector(F.col(features_col))).checkpoint()
    train = s.where(~F.coalesce(F.col("is_test"), F.lit(False)))
    test = s.where(F.coalesce(F.col("is_test"), F.lit(True)))
    w = class_weights(train, label_col)
    train = train.join(F.broadcast(w), label_col)
    best = None
    for rp in reg_params:
        lr = LogisticRegression(featuresCol="features", labelCol="label_index", weightCol="weight",
                                family="multinomial", regParam=rp, maxIter=100)
        m = lr.fit(train)
        pred = m.transform(test).select(F.col("label_index").alias("y_true"),
                                        F.col("prediction").cast("long").alias("y_pred"))
        f1 = macro_metrics(pred).collect()[0]["f1"]
        if best is None or f1 > best[0]:
            best = (f1, rp, m)
    return best[2], idx, s


def class_probabilities(model, rows: DataFrame, features_col: str, labels: DataFrame) -> DataFrame:
    """Probability per class for each row: (row columns, probs array, classes array)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    classes = [r[0] for r in labels.orderBy("label_index").collect()]  # one row per class
    out = model.transform(rows.withColumn("features", array_to_vector(F.col(features_col))))
    return out.withColumn("probs", vector_to_array("probability")).withColumn(
        "classes", F.array(*[F.lit(c) for c in classes])).drop("features", "rawPrediction", "probability", "prediction")


# ---------------------------------------------------------------------------
# fusion
# ---------------------------------------------------------------------------

def fuse(rows: DataFrame, probs_col: str, classes: Sequence[str], rule_kpi: str, rule_dept: str, rule_conf: str,
         kpi_departments: DataFrame, row_dept: str | None = None, kpi_threshold: float = 0.6,
         override: float = 0.7, filter_min: float = 0.5) -> DataFrame:
    """M14 + M15: noise probability excluded from the argmax; model probability times
    (1 - noise); rule / model precedence; '__noise__' caps the probability at 0;
    ``accepted`` = probability >= threshold, kpi != '__noise__', noise < 0.5."""
    classes = list(classes)
    p = F.col(probs_col)
    has_noise = NOISE in classes
    ni = classes.index(NOISE) if has_noise else -1
    noise = F.element_at(p, ni + 1) if has_noise else F.lit(0.0)
    adjusted = F.transform(p, lambda x, i: F.when(i == ni, F.lit(-1.0)).otherwise(x)) if has_noise else p
    best = F.array_position(adjusted, F.array_max(adjusted))  # 1-based, first maximum
    model_kpi = F.element_at(F.array(*[F.lit(c) for c in classes]), best.cast("int"))
    model_prob = F.element_at(p, best.cast("int")) * (F.greatest(F.lit(0.0), 1 - noise) if has_noise else F.lit(1.0))
    d = rows.withColumn("noise_probability", noise).withColumn("_mk", model_kpi).withColumn("_mp", model_prob)
    kd = kpi_departments.select(F.col("kpi").alias("_mk"), F.col("department").alias("_kd"))
    d = d.join(F.broadcast(kd), "_mk", "left")  # one row per KPI
    model_dept = F.coalesce(F.col("_kd"), F.col(row_dept) if row_dept else F.lit(None), F.lit("General"))
    r = F.col(rule_conf)
    has_rule = r.isNotNull()
    rule_stronger = (r >= override) & (r >= F.col("_mp"))
    model_stronger = (F.col("_mp") >= kpi_threshold) & (F.col("_mp") >= r)
    use_rule = has_rule & ((rule_stronger & (r >= filter_min)) | ~model_stronger)
    kpi = F.when(use_rule, F.col(rule_kpi)).otherwise(F.col("_mk"))
    dept = F.when(use_rule, F.col(rule_dept)).otherwise(model_dept)
    prob = F.when(has_rule, F.greatest(r, F.col("_mp"))).otherwise(F.col("_mp"))
    d = d.withColumn("kpi", kpi).withColumn("department", dept)
    d = d.withColumn("probability", F.when(F.col("kpi") == NOISE, F.least(prob, F.lit(0.0))).otherwise(prob))
    d = d.withColumn("rule_applied", use_rule & (F.col("kpi") != NOISE))
    d = d.withColumn("accepted", (F.col("probability") >= kpi_threshold) & (F.col("kpi") != NOISE)
                     & (F.col("noise_probability") < 0.5))
    return d.drop("_mk", "_mp", "_kd")
