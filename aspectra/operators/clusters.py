"""Clustering quality, relabelling and profiles.

Pairwise metrics (silhouette) use the same bounded block-pair groups as the
neighbour search: each group emits per-(point, cluster) distance sums, never pairs.
Centroids are decomposable averages (partial aggregation absorbs a hot cluster);
cluster-level tables have one row per cluster and are small.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.functions.graph import components
from aspectra.functions.ops import global_rank
from aspectra.operators import sweep
from aspectra.operators.density import hierarchy_labels
from aspectra.operators.vectors import _unit_matrix, l2_normalize, nearest_keyword


def _block_groups(df: DataFrame, id_col: str, nb: int) -> DataFrame:
    b = df.withColumn("_b", F.pmod(F.xxhash64(F.col(id_col)), F.lit(nb)))
    o = b.select("*", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("_o"))
    return o.withColumn("_lo", F.least("_b", "_o")).withColumn("_hi", F.greatest("_b", "_o")).drop("_o")


#: Points of a strip at most, rows of partial sums a pair of strips may return, and points of a strip compared at once.
STRIP, STRIP_SUMS, TILE = 32_768, 1 << 21, 1024


def _strips(n: int, clusters: int, parallelism: int) -> int:
    """How many strips ``n`` points are dealt to: few, since every point travels once, and is summed up once, per
    strip; enough to keep all cores busy; of fewer points where many clusters make the sums of a pair of strips long."""
    size = min(STRIP, max(2 * TILE, STRIP_SUMS // max(clusters, 1)))
    return max(1, math.ceil(n / size), min(math.ceil(n / (2 * TILE)), 2 * parallelism))


def distance_sums(points: DataFrame, id_col: str, vec_col: str, cluster_col: str) -> DataFrame:
    """Exact Euclidean distance sums from every point to every cluster:
    (id, own_cluster, cluster, dsum, n).  Pairs of strips of bounded size are compared tile by
    tile and return one row per (point, cluster) they see; a final aggregation adds the partial sums."""
    base = points.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v"),
                         F.col(cluster_col).cast("long").alias("_c"))
    n, k = base.agg(F.count(F.lit(1)), F.countDistinct("_c")).first()
    strips = _strips(n, k, points.sparkSession.sparkContext.defaultParallelism)
    g = _block_groups(base, "_id", strips)
    schema = "i long, ci long, c long, dsum double, n long"

    def strip(frame):
        """Rows in the order of their clusters, and where each cluster starts."""
        frame = frame.sort_values("_c", kind="stable")
        c = frame["_c"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, dtype=np.int64)
        x = np.array([np.asarray(v, dtype=np.float64) for v in frame["_v"]])
        return frame["_id"].to_numpy(), c, x, (x * x).sum(axis=1), starts

    def add(tile, at, sums, starts):
        """Adds a tile's distances to the clusters of its columns, which begin at position ``at`` of their strip."""
        first = np.searchsorted(starts, at, side="right") - 1
        last = np.searchsorted(starts, at + tile.shape[1], side="left")
        cuts = np.maximum(starts[first:last] - at, 0)
        sums[:, first:last] += np.add.reduceat(tile, cuts, axis=1)

    def rows_of(a, b, sums, same):
        ids, own, _, _, _ = a
        _, other, _, _, starts = b
        held = np.diff(np.append(starts, len(other)))
        c = np.tile(other[starts], len(ids))
        ci = np.repeat(own, len(starts))
        # a point has no distance to itself
        return pd.DataFrame({"i": np.repeat(ids, len(starts)), "ci": ci, "c": c, "dsum": sums.ravel(),
                             "n": np.tile(held, len(ids)) - ((ci == c) if same else 0)})

    def per_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0])
        same = lo == hi
        a = strip(pdf[pdf["_b"] == lo])
        b = a if same else strip(pdf[pdf["_b"] == hi])
        if not len(a[0]) or not len(b[0]):
            return pd.DataFrame({"i": [], "ci": [], "c": [], "dsum": [], "n": []})
        to_b = np.zeros((len(a[0]), len(b[4])))
        to_a = to_b if same else np.zeros((len(b[0]), len(a[4])))
        for p in range(0, len(a[0]), TILE):
            xa, na = a[2][p : p + TILE], a[3][p : p + TILE]
            for q in range(p if same else 0, len(b[0]), TILE):
                d = xa @ b[2][q : q + TILE].T
                d *= -2.0
                d += na[:, None]
                d += b[3][q : q + TILE]
                np.sqrt(np.clip(d, 0.0, None, out=d), out=d)
                if same and p == q:
                    np.fill_diagonal(d, 0.0)
                add(d, q, to_b[p : p + TILE], b[4])
                if not (same and p == q):
                    add(np.ascontiguousarray(d.T), p, to_a[q : q + TILE], a[4])
        parts = [rows_of(a, b, to_b, same)]
        if not same:
            parts.append(rows_of(b, a, to_a, False))
        return pd.concat(parts, ignore_index=True)

    parts = g.repartition(strips * (strips + 1) // 2, "_lo", "_hi").groupBy("_lo", "_hi").applyInPandas(per_pair, schema)
    return parts.groupBy("i", "ci", "c").agg(F.sum("dsum").alias("dsum"), F.sum("n").alias("n"))


def silhouette(points: DataFrame, id_col: str, vec_col: str, cluster_col: str) -> DataFrame:
    """Mean silhouette (Euclidean) of the non-noise points; 0 when there are fewer
    than 2 labels or 2 points.  One row: silhouette."""
    p = points.where(F.col(cluster_col) >= 0)
    sums = distance_sums(p, id_col, vec_col, cluster_col)
    # own and other clusters in one aggregation: two readers of the sums would compare all pairs twice
    mine, mean = F.col("c") == F.col("ci"), F.when(F.col("n") > 0, F.col("dsum") / F.col("n"))
    per = sums.groupBy("i").agg(F.collect_list(F.when(mine, F.struct(mean.alias("a"), "n"))).alias("own"), F.min(F.when(~mine, mean)).alias("b"))
    s = per.select(F.explode("own").alias("own"), F.when(F.col("i").isNotNull(), F.col("b")).alias("b")).select(
        F.when((F.col("own.n") == 0) | F.col("b").isNull(), F.lit(0.0))
        .otherwise((F.col("b") - F.col("own.a")) / F.greatest("own.a", "b")).alias("s"))
    stats = p.agg(F.countDistinct(cluster_col).alias("k"), F.count(F.lit(1)).alias("n"))
    return s.agg(F.avg("s").alias("s")).crossJoin(stats).select(
        F.when((F.col("k") <= 1) | (F.col("n") < 2), F.lit(0.0)).otherwise(F.coalesce("s", F.lit(0.0))).alias("silhouette"))


#: Clusters whose sums may be sent to all executors at once.
MAX_SENT_CLUSTERS = 10_000


def silhouette_sq(points: DataFrame, id_col: str, vec_col: str, cluster_col: str) -> DataFrame:
    """C2 on squared Euclidean distances, in one pass over the points: the mean squared
    distance to a cluster follows from its size, its mean vector and its mean squared norm.
    Cost grows with points x clusters, which are sent in pieces; ``silhouette`` keeps the
    pairwise Euclidean form."""
    p = points.where(F.col(cluster_col) >= 0).select(
        F.col(cluster_col).cast("long").alias("c"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    e = p.select("c", norm.alias("q"), F.posexplode("v").alias("dim", "x"))
    per_dim = e.groupBy("c", "dim").agg(F.avg("x").alias("x"), F.avg("q").alias("q"), F.count(F.lit(1)).alias("n"))
    per = per_dim.groupBy("c").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("m"),
        F.max("q").alias("q"), F.max("n").alias("n"))
    pieces = max(1, math.ceil(per.count() / MAX_SENT_CLUSTERS))
    part = F.pmod(F.xxhash64("c"), F.lit(pieces))

    def mean_distance(v, q, s):
        dot = F.aggregate(F.zip_with(v, s["m"], lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
        return F.greatest(q - 2 * dot + s["q"], F.lit(0.0))

    d = p.withColumns({"q": norm, "a": F.lit(None).cast("double"), "b": F.lit(None).cast("double")})
    for i in range(pieces):  # each piece is one row of about MAX_SENT_CLUSTERS entries
        sums = per.where(part == i).agg(F.collect_list(F.struct("c", "m", "q", "n")).alias("all"))
        own = F.get(F.filter("all", lambda s: s["c"] == F.col("c")), F.lit(0))
        a = F.when(own["n"] > 1, mean_distance(F.col("v"), F.col("q"), own) * own["n"] / (own["n"] - 1))
        others = F.transform(F.filter("all", lambda s: s["c"] != F.col("c")), lambda s: mean_distance(F.col("v"), F.col("q"), s))
        d = d.crossJoin(F.broadcast(sums)).select("c", "v", "q", F.coalesce("a", a).alias("a"), F.least("b", F.array_min(others)).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return d.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("silhouette_sq"))


def centroids(points: DataFrame, vec_col: str, cluster_col: str = "cluster") -> DataFrame:
    """Element-wise mean vector of every cluster >= 0: (cluster, centroid, size)."""
    p = points.where(F.col(cluster_col) >= 0)
    e = p.select(cluster_col, F.posexplode(vec_col).alias("dim", "x"))
    m = e.groupBy(cluster_col, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    return m.groupBy(cluster_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centroid"),
        F.max("n").alias("size"))


def davies_bouldin(points: DataFrame, vec_col: str, cluster_col: str = "cluster") -> DataFrame:
    """Davies–Bouldin index of the non-noise points (inf with < 2 labels or points)."""
    p = points.where(F.col(cluster_col) >= 0)
    c = centroids(p, vec_col, cluster_col)
    d = p.join(F.broadcast(c.select(cluster_col, "centroid")), cluster_col)  # one row per cluster
    dist = F.sqrt(F.aggregate(F.zip_with(vec_col, "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                              lambda acc, x: acc + x))
    scat = d.groupBy(cluster_col).agg(F.avg(dist).alias("s"))
    cs = c.join(scat, cluster_col)
    a, b = cs.alias("a"), cs.alias("b")
    pair = a.join(b, F.col(f"a.{cluster_col}") != F.col(f"b.{cluster_col}"))
    cd = F.sqrt(F.aggregate(F.zip_with("a.centroid", "b.centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                            lambda acc, x: acc + x))
    r = pair.select(F.col(f"a.{cluster_col}").alias("k"), ((F.col("a.s") + F.col("b.s")) / cd).alias("r"))
    mx = r.groupBy("k").agg(F.max("r").alias("r"))
    stats = p.agg(F.countDistinct(cluster_col).alias("nk"), F.count(F.lit(1)).alias("n"))
    return mx.agg(F.avg("r").alias("dbi")).crossJoin(stats).select(
        F.when((F.col("nk") <= 1) | (F.col("n") < 2), F.lit(float("inf"))).otherwise(F.col("dbi")).alias("davies_bouldin"))


def reassign(points: DataFrame, vec_col: str, cluster_col: str = "cluster", order_col: str | None = None,
             min_size: int = 3) -> DataFrame:
    """Clusters with size >= min_size (not -1) are valid; with none valid, the largest
    cluster (first appearing on ties) is, unless that is -1 — then nothing moves.  Every
    other row (noise included) moves to the nearest centroid (cosine of unit vectors,
    lower id on ties) among ALL non-noise clusters."""
    order_col = order_col or cluster_col
    stats = points.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"), F.min(order_col).alias("_first"))
    k_rows = stats.collect()  # one row per cluster
    valid = [r[cluster_col] for r in k_rows if r[cluster_col] != -1 and r["size"] >= min_size]
    if not valid and k_rows:
        top = min(k_rows, key=lambda r: (-r["size"], r["_first"]))
        valid = [] if top[cluster_col] == -1 else [top[cluster_col]]
    if not valid:
        return points
    key = list(points.columns)
    is_valid = F.col(cluster_col).isin(valid)
    movers = points.where(~is_valid)
    cen = centroids(points, vec_col, cluster_col)
    # nearest centroid: the K centroids are a size-checked broadcast matrix
    moved = nearest_keyword(movers, vec_col, cen, cluster_col, "centroid")
    moved = moved.withColumn(cluster_col, F.col("kw_index").cast("int")).select(*key)
    return points.where(is_valid).unionByName(moved)


def drop_small(points: DataFrame, cluster_col: str = "cluster", min_size: int = 3) -> DataFrame:
    """Clusters smaller than min_size become -1; if then everything is -1, all become 0."""
    sizes = points.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("_n"))
    p = points.join(F.broadcast(sizes), cluster_col)  # one row per cluster
    lab = F.when((F.col(cluster_col) != -1) & (F.col("_n") < min_size), F.lit(-1)).otherwise(F.col(cluster_col))
    p = p.withColumn(cluster_col, lab.cast("int")).drop("_n")
    allnoise = p.agg(F.max(F.col(cluster_col)).alias("_m"))
    return p.crossJoin(F.broadcast(allnoise)).withColumn(
        cluster_col, F.when(F.col("_m") == -1, F.lit(0)).otherwise(F.col(cluster_col))).drop("_m")


def profile(rows: DataFrame, cluster_col: str, generic: str, confidence: str, pass_threshold: float = 0.5) -> DataFrame:
    """Per cluster size, rule pass ratio (confidence >= threshold), noise ratio,
    generic ratio, min/max confidence (0 without a match); -1 is fixed at 0 / 1 / 1."""
    conf = F.coalesce(F.col(confidence), F.lit(0.0))
    g = rows.groupBy(cluster_col).agg(
        F.count(F.lit(1)).alias("size"),
        F.avg((conf >= pass_threshold).cast("double")).alias("pass_ratio"),
        F.avg(F.col(generic).cast("double")).alias("generic_ratio"),
        F.min(conf).alias("min_confidence"), F.max(conf).alias("max_confidence"))
    noise = F.col(cluster_col) == -1
    return g.select(
        cluster_col, "size",
        F.when(noise, 0.0).otherwise(F.col("pass_ratio")).alias("pass_ratio"),
        F.when(noise, 1.0).otherwise(1.0 - F.col("pass_ratio")).alias("noise_ratio"),
        F.when(noise, 1.0).otherwise(F.col("generic_ratio")).alias("generic_ratio"),
        F.when(noise, F.lit(None)).otherwise(F.col("min_confidence")).alias("min_confidence"),
        F.when(noise, F.lit(None)).otherwise(F.col("max_confidence")).alias("max_confidence"))


def merge_map(points: DataFrame, vec_col: str, prof: DataFrame, cluster_col: str = "cluster", min_size: int = 3,
              noise_threshold: float = 0.5, generic_limit: float = 0.85, merge_flagged: bool = False) -> DataFrame:
    """Denoise merge, reduced to one row per cluster on Spark (sum of unit vectors,
    size, centroid, ratios); the order-dependent visit runs over that K-row table only.
    Returns (cluster, merged_into) for every cluster >= 0."""
    p = points.where(F.col(cluster_col) >= 0)
    e = p.select(cluster_col, F.posexplode(l2_normalize(vec_col)).alias("dim", "x"))
    usum = e.groupBy(cluster_col, "dim").agg(F.sum("x").alias("x")).groupBy(cluster_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("usum"))
    cen = centroids(points, vec_col, cluster_col)
    k = (usum.join(cen, cluster_col).join(prof.select(cluster_col, "generic_ratio", "noise_ratio"), cluster_col)
         .orderBy(cluster_col).collect())  # K rows: one per cluster
    if not k:
        return points.sparkSession.createDataFrame([], f"{cluster_col} int, merged_into int")
    ids = [int(r[cluster_col]) for r in k]
    U = np.array([r["usum"] for r in k], dtype=np.float64)
    size = np.array([r["size"] for r in k], dtype=np.float64)
    C = _unit_matrix([r["centroid"] for r in k])
    valid = [i for i, r in enumerate(k) if r["generic_ratio"] < generic_limit]
    labels = {c: c for c in ids}
    if valid:
        # mean similarity of the members of cluster i to centroid j = usum_i . unit(c_j) / size_i
        msim = (U @ C.T) / size[:, None]
        for i, r in enumerate(k):
            cid = ids[i]
            members = [c for c in ids if labels[c] == cid]
            if not members:
                continue
            cand = [(msim[i, j], ids[j]) for j in valid if ids[j] != cid]
            best_sim, best_t = max(cand, key=lambda t: (t[0], -t[1])) if cand else (-1.0, None)
            gen, noisy = r["generic_ratio"], r["noise_ratio"]
            flagged = gen >= 1.0 or noisy >= noise_threshold
            small = size[i] < min_size
            if (not flagged and small) or (merge_flagged and flagged):
                tgt = best_t if best_t is not None and best_sim >= 0.45 else -1
                for c in members:
                    labels[c] = tgt
                continue
            if best_t is not None and size[i] < min_size * 2 and best_sim >= 0.55:
                for c in members:
                    labels[c] = best_t
    rows = [(c, int(labels[c])) for c in ids]
    return points.sparkSession.createDataFrame(rows, f"{cluster_col} int, merged_into int")


def label_clusters(rows: DataFrame, cluster_col: str, phrase_col: str, score_col: str, nouns_of) -> DataFrame:
    """C11: 'Noise' for -1; else the best phrase by (score, length) desc (phrase asc on
    ties); label = its distinct nouns in order (else the lower-cased phrase), title-cased."""
    best = rows.where(F.col(cluster_col) >= 0).groupBy(cluster_col).agg(
        F.min_by(phrase_col, F.struct(-F.col(score_col), -F.length(phrase_col), F.col(phrase_col))).alias("_p"))
    nouns = F.array_join(F.array_distinct(nouns_of(F.lower("_p"))), " ")
    lab = F.initcap(F.when(nouns != "", nouns).otherwise(F.lower("_p")))
    named = best.select(cluster_col, lab.alias("label"))
    noise = rows.where(F.col(cluster_col) == -1).select(cluster_col).distinct().withColumn("label", F.lit("Noise"))
    return named.unionByName(noise)


def highlights(rows: DataFrame, cluster_col: str, phrase_col: str, score_col: str, k: int = 5) -> DataFrame:
    """The k best phrases by score per cluster >= 0 (phrase asc on ties)."""
    from aspectra.functions.ops import topk
    return topk(rows.where(F.col(cluster_col) >= 0), [cluster_col], [F.col(score_col).desc(), F.col(phrase_col)], k)


def sizes(rows: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Size per cluster with its rank (size desc), noise share and cluster count."""
    s = rows.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"))
    w = Window.orderBy(F.col("size").desc(), F.col(cluster_col))  # one row per cluster
    tot = Window.partitionBy(F.lit(1))
    return s.select(cluster_col, "size", F.row_number().over(w).cast("long").alias("size_rank"),
                    (F.sum(F.when(F.col(cluster_col) == -1, F.col("size")).otherwise(0)).over(tot)
                     / F.sum("size").over(tot)).alias("noise_ratio"),
                    F.sum(F.when(F.col(cluster_col) != -1, 1).otherwise(0)).over(tot).cast("long").alias("cluster_count"))


def noisiest(prof: DataFrame, cluster_col: str = "cluster", k: int = 5) -> DataFrame:
    """C14: clusters >= 0 by noise ratio (rounded to 3) desc, the first k."""
    p = prof.where(F.col(cluster_col) >= 0).withColumn("noise_ratio", F.round("noise_ratio", 3))
    w = Window.orderBy(F.col("noise_ratio").desc(), F.col(cluster_col))  # one row per cluster
    return p.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select(
        cluster_col, "noise_ratio", "rank")


def kmeans_sweep(points: DataFrame, vec_col: str, min_k: int = 2, max_k: int = 40, seeds=tuple(range(42, 52)), max_iter: int = 300):
    """k = min_k .. min(max_k, max(min_k, int(2*sqrt(n)))), stopping at k >= n; per k the
    lowest-cost run over ``seeds``; the best k by silhouette on squared Euclidean distances (a
    different number from C2, named so).  All models advance together, one pass over the points a
    step (``sweep``).  Returns (labels, metrics)."""
    n = points.count()
    top = min(max_k, max(min_k, int(math.sqrt(n) * 2)), n - 1)
    return sweep.kmeans_sweep(points, vec_col, range(min_k, top + 1), seeds, max_iter)


def _pairs_within(points: DataFrame, eps: float, nb: int, per_group, schema: str) -> DataFrame:
    """``per_group(rows a, rows b, near)`` for every pair of blocks; ``near`` marks pairs at distance <= eps."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0])
        a, b = pdf[pdf["_b"] == lo], pdf[pdf["_b"] == hi]
        ma, mb = (np.stack([np.asarray(v, dtype=np.float64) for v in x["v"]]) if len(x) else np.zeros((0, 1)) for x in (a, b))
        if not len(a) or not len(b):
            return per_group(a, b, np.zeros((len(a), len(b)), dtype=bool))
        d2 = (ma * ma).sum(1)[:, None] + (mb * mb).sum(1)[None, :] - 2.0 * ma @ mb.T
        return per_group(a, b, np.sqrt(np.clip(d2, 0.0, None)) <= eps)

    return _block_groups(points, "i", nb).groupBy("_lo", "_hi").applyInPandas(one, schema)


def density_labels(points: DataFrame, id_col: str, vec_col: str, eps: float, min_points: int = 5, min_size: int = 3,
                   block_size: int = 2048) -> DataFrame:
    """C4 at a fixed cut: adds ``cluster``.  A core point has ``min_points`` points (itself
    included) within ``eps``; clusters are the connected core points at most ``eps`` apart, of
    at least ``min_size`` points, numbered by their smallest id; everything else is -1.

    Pairs are compared block by block and never emitted: a group returns neighbour counts,
    then one edge per core point to the smallest point of its component inside the group."""
    base = points.select(F.col(id_col).cast("long").alias("i"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    nb = max(1, math.ceil(base.count() / block_size))

    def counts(a, b, near):
        out = [pd.DataFrame({"i": a["i"], "n": near.sum(axis=1)})]
        if int(a["_b"].iloc[0] if len(a) else -1) != int(b["_b"].iloc[0] if len(b) else -1):
            out.append(pd.DataFrame({"i": b["i"], "n": near.sum(axis=0)}))
        return pd.concat(out).astype("int64")

    per = _pairs_within(base, eps, nb, counts, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    core = base.join(per.where(F.col("n") >= min_points).select("i"), "i").checkpoint()

    def links(a, b, near):
        # smallest id of each component inside the group, by repeated minima over near points
        la, lb = a["i"].to_numpy().copy(), b["i"].to_numpy().copy()
        far = np.iinfo(np.int64).max
        while len(la) and len(lb):
            na = np.minimum(la, np.where(near, lb[None, :], far).min(axis=1))
            new = np.minimum(lb, np.where(near, na[:, None], far).min(axis=0))
            if (na == la).all() and (new == lb).all():
                break
            la, lb = na, new
        return pd.DataFrame({"a": np.concatenate([a["i"], b["i"]]), "b": np.concatenate([la, lb])}, dtype="int64").drop_duplicates()

    edges = _pairs_within(core, eps, nb, links, "a long, b long")
    parts = components(edges)
    labelled = core.select("i").join(parts.withColumnRenamed("node", "i"), "i", "left").select(
        "i", F.coalesce("component", "i").alias("root"))
    big = labelled.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    order = global_rank(big.select("root"), F.col("root"), "_r").select("root", (F.col("_r") - 1).cast("int").alias("cluster"))
    out = labelled.join(order, "root").select(F.col("i").alias(id_col), "cluster")
    return points.join(out, id_col, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def select_method(kmeans: DataFrame, density: DataFrame, algorithm: str = "auto", switch_sil: float = 0.25,
                  switch_dbi: float = 1.0, fallback_sil: float = 0.2) -> DataFrame:
    """kmeans(silhouette, davies_bouldin) and density(silhouette, n_clusters) one-row
    metric tables -> method: switch when forced or (auto and (sil < 0.25 or dbi > 1.0));
    adopt density only with > 2 clusters and silhouette >= 0.2."""
    j = kmeans.select(F.col("silhouette").alias("ks"), F.col("davies_bouldin").alias("kd")).crossJoin(
        density.select(F.col("silhouette").alias("ds"), F.col("n_clusters").alias("dn")))
    switch = F.lit(algorithm == "hdbscan") | (F.lit(algorithm == "auto") & ((F.col("ks") < switch_sil) | (F.col("kd") > switch_dbi)))
    adopt = switch & (F.col("dn") > 2) & (F.col("ds") >= fallback_sil)
    return j.select(F.when(adopt, "density").otherwise("kmeans").alias("method"), switch.alias("switched"))


def quality(points: DataFrame, id_col: str, vec_col: str, cluster_col: str) -> DataFrame:
    """What C5 weighs, in one row: ``silhouette`` (C2), ``davies_bouldin`` (C3) and ``n_clusters`` without noise."""
    n = points.where(F.col(cluster_col) >= 0).agg(F.countDistinct(cluster_col).alias("n_clusters"))
    return silhouette(points, id_col, vec_col, cluster_col).crossJoin(davies_bouldin(points, vec_col, cluster_col)).crossJoin(n)


def select_labels(points: DataFrame, id_col: str, vec_col: str, algorithm: str = "auto", min_size: int = 5, **limits) -> DataFrame:
    """C5 on real labels: ``points`` carry the k-means labels in ``cluster``; where those are poor (or
    density is forced) the density hierarchy (C4) is run, and adopted if it is good enough.
    Adds ``method``; ``cluster`` holds the adopted labels."""
    kmeans = quality(points, id_col, vec_col, "cluster").checkpoint()
    rest = [c for c in points.columns if c != "cluster"]
    none = kmeans.select(F.lit(None).cast("double").alias("silhouette"), F.lit(0).alias("n_clusters"))
    if not select_method(kmeans, none, algorithm, **limits).first()["switched"]:
        return points.withColumn("method", F.lit("kmeans"))
    dense = hierarchy_labels(points.select(*rest), id_col, vec_col, min_size).checkpoint()
    method = select_method(kmeans, quality(dense, id_col, vec_col, "cluster"), algorithm, **limits).first()["method"]
    return (dense if method == "density" else points).withColumn("method", F.lit(method))
