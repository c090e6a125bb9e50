"""The k-means sweep against separate fits in one process."""

import numpy as np
from pyspark.sql import functions as F

from aspectra.operators import clusters as C
from aspectra.operators import sweep


def lloyd(x, start, tolerance):
    c = start
    for _ in range(300):
        own = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        still = ((new - c) ** 2).sum() <= tolerance
        c = new
        if still:
            break
    far = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    return far.min(axis=1).sum(), far.argmin(axis=1)


def silhouette(x, labels):
    d = ((x[:, None, :] - x[None]) ** 2).sum(axis=2)
    out = []
    for i in range(len(x)):
        same = labels == labels[i]
        if same.sum() < 2:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) if c != labels[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_sweep_equals_separate_fits(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.6, (40, 4)) + c for c in rng.uniform(-4, 4, (5, 4))])
    points = spark.createDataFrame([(i, [float(a) for a in v], "kept") for i, v in enumerate(x)], "id long, v array<double>, model string").repartition(4)
    labels, metrics = C.kmeans_sweep(points, "v", 2, 9, seeds=(1, 2, 3))
    order = points.select("v").orderBy(F.xxhash64("v", F.lit(1)), "v").toPandas()["v"]
    sample = np.array([np.asarray(v) for v in order])
    want = {}
    for k in range(2, 10):
        want[k] = min((lloyd(x, sweep.plus_plus(sample, k, s), sweep.REST * x.var(axis=0).mean()) for s in (1, 2, 3)), key=lambda r: r[0])
    got = {r.k: r for r in metrics.collect()}
    assert set(got) == set(want)
    for k, (cost, own) in want.items():
        assert abs(got[k].cost - cost) <= 1e-9 * cost and abs(got[k].silhouette_sq - silhouette(x, own)) < 1e-9
    best = max(want, key=lambda k: got[k].silhouette_sq)
    rows = sorted(labels.collect(), key=lambda r: r.id)
    assert [r.cluster for r in rows] == want[best][1].tolist() and {r.model for r in rows} == {"kept"}


def test_sweep_of_few_points(spark):
    def run(x):
        frame = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
        labels, metrics = C.kmeans_sweep(frame, "v")
        return [r.cluster for r in labels.sort("id").collect()], metrics.count()

    assert run([]) == ([], 0)
    assert run([[1, 2]]) == ([0], 0)
    assert run([[1, 2], [3, 4]]) == ([0, 0], 0)  # k stops below n
    assert run([[1, 1]] * 9) == ([0] * 9, 0)  # one value is one cluster
    own, n = run([[0, 0], [0, 1], [9, 9]])
    assert n == 1 and own[0] == own[1] != own[2]


def test_step_sums_rows_by_their_first_nearest_centroid():
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (700, 3)).astype(np.float64)  # whole numbers: many rows lie between two centroids
    models = {m: x[rng.integers(0, len(x), k)] for m, k in enumerate((2, 5, 5, 5, 9, 2))}
    step = sweep._Step(sweep._Models(models))
    for at in range(0, len(x), 256):
        step.add(x[at : at + 256])
    for m, (lo, hi) in enumerate(step.models.spans):
        far = ((x[:, None, :] - models[m][None]) ** 2).sum(axis=2)
        own = far.argmin(axis=1)
        want = np.array([[*x[own == c].sum(axis=0), (x[own == c] ** 2).sum(), (own == c).sum()] for c in range(hi - lo)])
        assert (step.sums[lo:hi] == want).all() and step.cost[m] == far.min(axis=1).sum()


def test_pass_adds_up_the_shares_of_all_tasks(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-9, 10, (200, 2)).astype(np.float64)
    points = spark.createDataFrame([([float(a) for a in v],) for v in x], "v array<double>").repartition(7)
    models = {m: x[:k] for m, k in zip(range(3, 90, 2), np.tile([2, 3, 7], 29), strict=False)}
    got = sweep._pass(points, models)
    assert set(got) == set(models)
    for m, c in models.items():
        own = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        n, sums, squares, _ = got[m]
        assert n.tolist() == np.bincount(own, minlength=len(c)).tolist()
        assert (sums == np.array([x[own == k].sum(axis=0) for k in range(len(c))])).all() and squares.sum() == (x * x).sum()


def test_held_points_need_no_pass_a_step(spark, monkeypatch):
    """All models come to rest inside the tasks: one pass for the costs, however many steps they take; over the limit a pass a step, with the same labels."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (400, 3))
    points = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    passes, one = [], sweep._pass
    monkeypatch.setattr(sweep, "_pass", lambda *a: passes.append(1) or one(*a))
    labels, metrics = C.kmeans_sweep(points, "v", 2, 5, seeds=(1, 2))
    held = [r.cluster for r in labels.sort("id").collect()], {r.k: r.cost for r in metrics.collect()}
    assert len(passes) == 1
    monkeypatch.setattr(sweep, "HELD_BYTES", 0)
    labels, metrics = C.kmeans_sweep(points, "v", 2, 5, seeds=(1, 2))
    assert len(passes) > 4 and [r.cluster for r in labels.sort("id").collect()] == held[0]
    assert all(abs(held[1][r.k] - r.cost) <= 1e-9 * r.cost for r in metrics.collect())


def test_fit_compares_again_only_what_may_have_moved():
    """The steps of a plain fit, from points that single precision holds exactly (with ties) and from others, in a small share of the comparisons."""
    rng = np.random.default_rng(7)
    spread = np.concatenate([rng.normal(0, 1, (500, 4)) + c for c in rng.uniform(-4, 4, (4, 4))])
    for x, exact in ((np.round(spread), True), (spread, False)):
        tolerance = 1e-9
        for k in (2, 7):
            start = sweep.plus_plus(x, k, 3)
            fit = sweep._Fit(x.astype(np.float32), None if exact else x, (x * x).sum(axis=1), start)
            seen, one = [], fit.compare
            fit.compare = lambda rows, first=False: seen.append(len(rows)) or one(rows, first)
            cost, own = lloyd(x, start, tolerance)
            c = fit.to_rest(tolerance, 300)
            far = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
            assert far.argmin(axis=1).tolist() == own.tolist() and abs(far.min(axis=1).sum() - cost) <= 1e-9 * cost
            assert sum(seen) < 0.7 * len(x) * len(fit.past)
