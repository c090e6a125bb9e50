"""PCA against a dense solver, the merge map against a point-level walk, streaming counts against batch counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.operators import clusters as C
from aspectra.operators import ngrams as N
from aspectra.operators import vectors as V


def test_pca_spans_the_leading_directions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 12)) * 3 + 0.1 * rng.normal(size=(80, 12)) + 5
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    got = np.array([r.reduced for r in V.pca_reduce(rows, "v", 4).sort("id").collect()])
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    want = u[:, :4] * s[:4]
    assert got.shape == (80, 4) and np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    # few rows bound the dimensions, narrow vectors and single rows stay as they are
    assert {len(r.reduced) for r in V.pca_reduce(rows.where("id < 3"), "v", 4).collect()} == {2}
    assert V.pca_reduce(rows, "v", 12).first().reduced == V.pca_reduce(rows, "v", 12).first().v
    assert len(V.pca_reduce(rows.where("id = 0"), "v", 4).first().reduced) == 12


def walk(x, own, generic, noise, min_size=3, noise_threshold=0.5, generic_limit=0.85, merge_flagged=False):
    """Clusters in order, every point relabelled by hand; similarities are means over the points."""
    ids = sorted({c for c in own if c >= 0})
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = {c: x[own == c].mean(axis=0) for c in ids}
    at = {c: c for c in ids}
    targets = [c for c in ids if generic[c] < generic_limit]
    for c in ids if targets else []:
        members = [k for k in ids if at[k] == c]
        if not members:
            continue
        n = (own == c).sum()
        sims = {t: float((unit[own == c] @ centre[t]).mean() / np.linalg.norm(centre[t])) for t in targets if t != c}
        best = max(sims, key=lambda t: (sims[t], -t), default=None)
        flagged = generic[c] >= 1.0 or noise[c] >= noise_threshold
        if (n < min_size and not flagged) or (merge_flagged and flagged):
            to = best if best is not None and sims[best] >= 0.45 else -1
        elif best is not None and n < 2 * min_size and sims[best] >= 0.55:
            to = best
        else:
            continue
        for k in members:
            at[k] = to
    return at


@pytest.mark.parametrize(("seed", "merge_flagged"), [(1, False), (2, False), (3, True)])
def test_merge_map_matches_a_walk_over_points(spark, seed, merge_flagged):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 6))
    x, own = [], []
    for c in range(14):
        for _ in range(int(rng.integers(1, 9))):
            x.append(centres[c % 5] + 0.7 * rng.normal(size=6))
            own.append(c)
    x, own = np.array([*x, centres[0]]), np.array([*own, -1])
    generic = {c: float(rng.choice([0.0, 0.5, 0.9, 1.0])) for c in range(14)}
    noise = {c: float(rng.choice([0.0, 0.3, 0.7])) for c in range(14)}
    points = spark.createDataFrame([([float(a) for a in v], int(c)) for v, c in zip(x, own)], "v array<double>, cluster int")
    prof = spark.createDataFrame([(c, generic[c], noise[c]) for c in range(14)], "cluster int, generic_ratio double, noise_ratio double")
    got = {r.cluster: r.merged_into for r in C.merge_map(points, "v", prof, merge_flagged=merge_flagged).collect()}
    want = walk(x, own, generic, noise, merge_flagged=merge_flagged)
    assert got == want and any(a != b for a, b in want.items())


def test_streaming_counts_equal_batch_counts(spark, tmp_path):
    from aspectra import streaming

    rows = [(i, t) for i, t in enumerate(["clean room and friendly staff", "clean pool", "staff", None, "", "friendly staff clean room"])]
    lists = {"adjectives": ["clean", "friendly"], "nouns": ["room", "staff", "pool"], "stop": ["and"], "irrelevant": []}
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = streaming.keyword_counts_stream(spark, folder, "review_key long, text string", **lists)
    for part in (rows[:3], rows[3:]):  # files arrive one after the other
        spark.createDataFrame(part, "review_key long, text string").coalesce(1).write.mode("append").parquet(folder)
        query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    got = {(r.ngram_type, r.keyword): r.frequency for r in spark.table("counts").collect()}
    batch = N.ngram_occurrences(spark.createDataFrame(rows, "review_key long, text string"), "review_key", "text", *lists.values())
    want = {(r.ngram_type, r.keyword): r.n for r in batch.groupBy("ngram_type", "keyword").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want and want


@pytest.mark.parametrize("sent", [10_000, 3])
def test_linear_silhouette_in_pieces(spark, sent, monkeypatch):
    monkeypatch.setattr(C, "MAX_SENT_CLUSTERS", sent)
    rng = np.random.default_rng(4)
    own = rng.integers(-1, 9, 120)
    own[own == 8] = 7
    own[0] = 8  # a cluster of one
    x = rng.normal(size=(120, 4)) + own[:, None]
    rows = spark.createDataFrame([(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, own))], "id long, v array<double>, cluster int")
    x, own = x[own >= 0], own[own >= 0]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = []
    for i, c in enumerate(own):
        n = (own == c).sum()
        if n == 1:
            want.append(0.0)
            continue
        a = d[i, own == c].sum() / (n - 1)
        b = min(d[i, own == k].mean() for k in set(own.tolist()) - {c})
        want.append((b - a) / max(a, b))
    assert C.silhouette_sq(rows, "id", "v", "cluster").first()[0] == pytest.approx(np.mean(want))
