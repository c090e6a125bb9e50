"""The Euclidean silhouette against all pairs in one process, over several strips and tiles."""

import numpy as np
import pytest

from aspectra.operators import clusters as C


def pairwise(x, own):
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        if (own == own[i]).sum() < 2:
            out.append(0.0)
            continue
        a = d[i, own == own[i]].sum() / ((own == own[i]).sum() - 1)
        b = min(d[i, own == c].mean() for c in set(own.tolist()) if c != own[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


@pytest.mark.parametrize(("strip", "tile"), [(64, 16), (40, 7), (1000, 1000)])
def test_silhouette_over_strips(spark, monkeypatch, strip, tile):
    monkeypatch.setattr(C, "STRIP", strip)
    monkeypatch.setattr(C, "TILE", tile)
    rng = np.random.default_rng(strip)
    own = rng.integers(0, 6, 150)
    own[own == 5] = 2
    own[0] = 5  # one point alone
    x = rng.normal(size=(150, 5)) + own[:, None]
    rows = [(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, own, strict=True))] + [(999, [0.0] * 5, -1)]
    points = spark.createDataFrame(rows, "id long, v array<double>, cluster int")
    assert abs(C.silhouette(points, "id", "v", "cluster").first()[0] - pairwise(x, own)) < 1e-9
    sums = C.distance_sums(points.where("cluster >= 0"), "id", "v", "cluster").toPandas()
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    assert len(sums) == 150 * 6
    for r in sums.itertuples():
        assert r.ci == own[r.i] and abs(r.dsum - d[r.i, own == r.c].sum()) < 1e-6 and r.n == (own == r.c).sum() - (r.c == r.ci)


def test_pairs_are_compared_once(spark):
    points = spark.createDataFrame([(i, [float(i), 1.0], i % 3) for i in range(30)], "id long, v array<double>, cluster int")
    plan = C.silhouette(points, "id", "v", "cluster")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1


def test_strips_stay_few():
    assert C._strips(0, 0, 8) == 1 and C._strips(2000, 10, 8) == 1
    assert C._strips(600_000, 10, 12) == 24  # not 293: a point travels once for every strip
    assert C._strips(600_000, 200_000, 12) == 293
