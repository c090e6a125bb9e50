"""Vectors, similarity, de-duplication and keyword mapping (V1–V9).

* V1 built-in encoder: hashed character 3-grams -> dense L2-normed vector, a pure
  column expression (no shuffle).
* V3 exact top-k neighbours and V4's nearest one above a threshold by the triangle
  inequality over pivot cells (``metric``): a vector is sent only to cells that can hold
  something nearer than what it has; no pair row is ever emitted.
* V4 canonical phrases by pointer jumping: O(log chain) self-joins, each round
  saved in the shared checkpoint folder.
* V7/V8 nearest catalogue keyword: the catalogue is sent in pieces of bounded size, one
  pass each; aspects stream through ``mapInPandas``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.functions.ops import saved, topk
from aspectra.operators import metric


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# V1, V2
# ---------------------------------------------------------------------------

def char_grams(c, n: int = 3) -> Column:
    """Character n-grams in order (no padding); shorter texts give an empty array.
    One linear regex pass: a zero-width lookahead captures the next n characters at every
    position (positional ``substr`` on UTF-8 text would be quadratic on long texts)."""
    return F.regexp_extract_all(_c(c), F.lit("(?s)(?=(.{%d}))" % n), 1)


def gram_bucket(g: Column, dim: int) -> Column:
    """bucket = first 8 hex digits of md5(gram), as an integer, mod dim."""
    return F.pmod(F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long"), F.lit(dim))


def hashed_vector(c, dim: int = 64, n: int = 3) -> Column:
    """V1: hashed character n-gram term frequencies, L2-normalised (zero guard).
    One pass over the grams: each gram adds 1 to its bucket (O(grams x dim))."""
    buckets = F.transform(char_grams(c, n), lambda g: gram_bucket(g, dim))
    zeros = F.array_repeat(F.lit(0.0), dim)
    counts = F.aggregate(buckets, zeros, lambda acc, b: F.transform(
        acc, lambda x, i: x + F.when(i == b, F.lit(1.0)).otherwise(F.lit(0.0))))
    return l2_normalize(counts)


def per_element(arr: Column, scalar: Column, fn) -> Column:
    """fn(element, scalar) for every element, with the per-row scalar passed as an
    argument (evaluated once per row, never re-evaluated inside the lambda)."""
    return F.zip_with(arr, F.array_repeat(scalar, F.size(arr)), fn)


def l2_norm(v) -> Column:
    x = F.transform(_c(v), lambda e: e.cast("double"))
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, e: acc + e * e))


def l2_normalize(v) -> Column:
    """V2: x / ||x||, a zero vector is divided by 1."""
    x = F.transform(_c(v), lambda e: e.cast("double"))
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, e: acc + e * e))
    n = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return per_element(x, n, lambda e, d: e / d)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, e: acc + e)


def encode_distinct(df: DataFrame, text_col: str, dim: int = 64, out: str = "vector") -> DataFrame:
    """Each distinct text is encoded once (the planner cannot infer the distinct)."""
    return df.select(text_col).distinct().withColumn(out, hashed_vector(text_col, dim))


# ---------------------------------------------------------------------------
# V3: exact top-k self similarity
# ---------------------------------------------------------------------------

def _unit_matrix(vs) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vs]) if len(vs) else np.zeros((0, 0))
    if m.size:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        n[n == 0] = 1.0
        m = m / n
    return m


def knn_self(df: DataFrame, id_col: str, vec_col: str, k: int = 5, block_size: int = metric.SLICE_ROWS,
             within: float | None = None) -> DataFrame:
    """V3: exact top-k inner-product neighbours of unit vectors, self included.
    Returns (id, rank, nbr, sim); ties go to the lower neighbour id; ``within`` drops
    neighbours of a smaller similarity before they are searched for.

    Between unit vectors the order by similarity is the order by distance, so
    ``metric.nearest`` finds them cell by cell.  Zero vectors, which V2 leaves as they are,
    have similarity 0 to everything; rows without a vector have no neighbours."""
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("_v")).where(F.col("_v").isNotNull())
    zero = ~F.exists("_v", lambda x: x != 0)
    units = base.where(~zero).select("id", l2_normalize("_v").alias("v"))
    most = math.inf if within is None else math.sqrt(max(0.0, 2.0 - 2.0 * within)) + 1e-9
    near = metric.nearest(units, k, most, block_size).select("id", "nbr", (1.0 - F.col("dist") * F.col("dist") / 2.0).alias("sim"))
    zeros = base.where(zero).select("id")
    if (within is None or within <= 0) and zeros.limit(1).count():
        def few(rows):
            return F.broadcast(rows.orderBy("id").limit(k).select(F.col("id").alias("nbr"), F.lit(0.0).alias("sim")))  # k rows

        flat = units.select("id").crossJoin(few(zeros)).unionByName(zeros.crossJoin(few(base.select("id"))))
        near = near.unionByName(flat)
    if within is not None:
        near = near.where(F.col("sim") >= within)
    best = topk(near, ["id"], [F.col("sim").desc(), F.col("nbr")], k, "rank", salt_buckets=0)
    return best.select(F.col("id").alias(id_col), "rank", "nbr", "sim")


# ---------------------------------------------------------------------------
# V4, V5: canonical phrases and de-duplication
# ---------------------------------------------------------------------------

def nearest_other(knn: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """Nearest neighbour other than itself, kept only when sim >= threshold: (id, nn, nn_sim)."""
    o = knn.where(F.col("nbr") != F.col(id_col))
    first = topk(o, [id_col], ["rank"], 1, "_r", salt_buckets=0).drop("_r")
    return first.where(F.col("sim") >= threshold).select(id_col, F.col("nbr").alias("nn"), F.col("sim").alias("nn_sim"))


def nearest_within(df: DataFrame, id_col: str, vec_col: str, threshold: float) -> DataFrame:
    """The nearest other vector of similarity at least ``threshold``: (id, nn, nn_sim).  The threshold
    bounds the search itself: a vector visits only cells whose ball can hold one so near."""
    return nearest_other(knn_self(df, id_col, vec_col, 2, within=threshold), id_col, threshold)


def canonical_ids(ids: DataFrame, nn: DataFrame, id_col: str, max_rounds: int = 64) -> DataFrame:
    """V4: order-dependent canonical id.  c(i)=i without a qualifying neighbour,
    c(i)=nn(i) when nn(i) > i (not visited yet), else c(i)=c(nn(i)).  Pointer jumping:
    each round doubles the followed chain; rounds are saved tables."""
    base = ids.select(F.col(id_col).alias("i")).join(nn.select(F.col(id_col).alias("i"), "nn"), "i", "left")
    cur = base.select(
        "i",
        F.when(F.col("nn") < F.col("i"), F.col("nn")).alias("p"),
        F.when(F.col("nn") > F.col("i"), F.col("nn")).otherwise(F.col("i")).alias("v"))
    cur = saved(cur, "canonical")
    for _ in range(max_rounds):
        if cur.where(F.col("p").isNotNull()).limit(1).count() == 0:
            break
        a, b = cur.alias("a"), cur.alias("b")
        nxt = a.join(b, F.col("a.p") == F.col("b.i"), "left").select(
            F.col("a.i").alias("i"),
            F.when(F.col("a.p").isNull(), F.lit(None)).otherwise(F.col("b.p")).cast("long").alias("p"),
            F.when(F.col("a.p").isNull(), F.col("a.v")).otherwise(F.col("b.v")).alias("v"))
        cur = saved(nxt, "canonical")
    else:
        raise RuntimeError(f"chains longer than 2**{max_rounds}")
    return cur.select(F.col("i").alias(id_col), F.col("v").alias("canonical"))


def dedup_group(rows: DataFrame, source_col: str, phrase_col: str, score_col: str, sentiments_col: str) -> DataFrame:
    """V5: per (source, canonical phrase): max score and the sorted union of sentiments;
    rows with a null source are dropped.  Sentiments are exploded and de-duplicated
    first, so the final group holds at most one row per distinct sentiment word."""
    x = rows.where(F.col(source_col).isNotNull()).select(
        source_col, phrase_col, score_col, F.explode_outer(sentiments_col).alias("_s"))
    g1 = x.groupBy(source_col, phrase_col, "_s").agg(F.max(score_col).alias("_m"))
    return g1.groupBy(source_col, phrase_col).agg(
        F.max("_m").alias("score"), F.array_sort(F.collect_list("_s")).alias("sentiments"))


# ---------------------------------------------------------------------------
# V6: PCA
# ---------------------------------------------------------------------------

def pca_reduce(df: DataFrame, vec_col: str, target_dim: int = 50, out: str = "reduced") -> DataFrame:
    """V6: mean-centred PCA to n = min(target, dim, rows-1) components; unchanged when
    rows <= 1 or dim <= target."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    first = df.select(F.size(vec_col).alias("d")).limit(1).collect()
    n = df.count()
    dim = first[0]["d"] if first else 0
    if n <= 1 or dim <= target_dim:
        return df.withColumn(out, F.transform(vec_col, lambda e: e.cast("double")))
    k = min(target_dim, dim, n - 1)
    v = df.withColumn("_vec", array_to_vector(F.col(vec_col)))
    sc = StandardScaler(inputCol="_vec", outputCol="_cen", withMean=True, withStd=False).fit(v)
    c = sc.transform(v)
    model = PCA(k=k, inputCol="_cen", outputCol="_pca").fit(c)
    return model.transform(c).withColumn(out, vector_to_array("_pca")).drop("_vec", "_cen", "_pca")


# ---------------------------------------------------------------------------
# V7–V9: nearest catalogue keyword
# ---------------------------------------------------------------------------

#: Keywords compared at once in a task; bounds the similarity matrix of a batch.
KEYWORD_TILE = 4096


def nearest_keyword(aspects: DataFrame, aspect_vec: str, keywords: DataFrame, kw_pos: str, kw_vec: str,
                    piece_rows: int = 200_000, tie_decimals: int = 12) -> DataFrame:
    """V7: argmax cosine over the keyword catalogue (first keyword on ties; similarities
    equal to ``tie_decimals`` decimals are ties, so summation order cannot pick the
    winner); adds ``kw_index`` (the catalogue position) and ``cosine_similarity``.

    The catalogue is counted and sent to the executors in pieces of about ``piece_rows``
    rows; each piece is one pass over the aspects, in Arrow batches, that keeps the best
    keyword so far.  A usual catalogue is one piece; a larger one costs more passes, never
    more memory.  An empty catalogue gives a null index."""
    spark: SparkSession = aspects.sparkSession
    kw = keywords.select(F.col(kw_pos).cast("long").alias("p"), F.col(kw_vec).alias("v"))
    pieces = max(1, -(-kw.count() // piece_rows))
    out = aspects.withColumn("kw_index", F.lit(None).cast("long")).withColumn("cosine_similarity", F.lit(0.0))
    for i in range(pieces):
        part = kw.where(F.pmod(F.xxhash64("p"), F.lit(pieces)) == i) if pieces > 1 else kw
        rows = sorted(part.collect(), key=lambda r: r["p"])
        out = out.mapInPandas(_match(spark.sparkContext.broadcast((_unit_matrix([r["v"] for r in rows]), np.array(
            [r["p"] for r in rows], dtype=np.int64))), aspect_vec, tie_decimals), out.schema)
    return out


def _match(shared, aspect_vec: str, tie_decimals: int):
    def match(batches):
        m, pos = shared.value
        for pdf in batches:
            if len(pdf) and len(pos):
                a = _unit_matrix(list(pdf[aspect_vec]))
                best = pdf["kw_index"].astype("Int64").to_numpy(dtype="float64", na_value=np.inf)
                top = np.where(np.isinf(best), -np.inf, pdf["cosine_similarity"].to_numpy(dtype="float64"))
                place = np.where(np.isinf(best), -1, best).astype(np.int64)
                for t in range(0, len(pos), KEYWORD_TILE):
                    s = a @ m[t:t + KEYWORD_TILE].T
                    j = np.argmax(np.round(s, tie_decimals), axis=1)  # the first of a tile's equal maxima
                    sim, at = s[np.arange(len(j)), j], pos[t + j]
                    new, old = np.round(sim, tie_decimals), np.round(top, tie_decimals)
                    better = (new > old) | ((new == old) & (at < place))
                    top, place = np.where(better, sim, top), np.where(better, at, place)
                pdf["kw_index"], pdf["cosine_similarity"] = place, top
            yield pdf

    return match


def apply_threshold(mapped: DataFrame, phrase_col: str, keyword_col: str, threshold: float,
                    id_cols=("KPI_ID", "KPI_Name", "Department_ID", "Department_Name")) -> DataFrame:
    """V8: similarity below the threshold -> Unmapped; then the keyword becomes the aspect
    phrase and ids/names 'N/A'; the similarity is kept.  ``unmapped_before`` flags rows."""
    below = F.col("cosine_similarity") < threshold
    out = mapped.withColumn("unmapped_before", below)
    out = out.withColumn(keyword_col, F.when(below, F.col(phrase_col)).otherwise(F.col(keyword_col)))
    for c in id_cols:
        out = out.withColumn(c, F.when(below, F.lit("N/A")).otherwise(F.col(c).cast("string")))
    return out


def unmapped_counts(thresholded: DataFrame, keyword_col: str) -> DataFrame:
    """V9: unmapped rows before and after the replacement."""
    return thresholded.agg(
        F.count_if(F.col("unmapped_before")).alias("unmapped_before"),
        F.count_if(F.lower(F.col(keyword_col)) == "unmapped").alias("unmapped_after"))


def hashed_vectors_table(df: DataFrame, key: str, text_col: str, dim: int = 64, n: int = 3,
                         out: str = "vector") -> DataFrame:
    """V1 for long texts: (key, L2-normalised hashed n-gram vector).  Grams are exploded,
    bucketed in a code-generated projection and counted per (key, bucket) with map-side
    partial aggregation; at most ``dim`` rows per text reach the final assembly.  (The
    in-row ``hashed_vector`` suits short phrases.)"""
    g = df.select(key, F.explode(char_grams(text_col, n)).alias("_g"))
    c = g.select(key, gram_bucket(F.col("_g"), dim).alias("_b")).groupBy(key, "_b").agg(
        F.count(F.lit(1)).cast("double").alias("_n"))
    m = c.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_b", "_n"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                        lambda i: F.coalesce(F.element_at(F.col("_m"), i.cast("long")), F.lit(0.0)))
    return m.select(key, l2_normalize(dense).alias(out))
