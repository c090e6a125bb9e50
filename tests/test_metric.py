"""Cell search, spanning tree and density hierarchy against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.operators import density, metric


def clumps(seed, n=300, dim=6):
    """Clumps of different density, a dense clump of a third of the rows, scattered points, equal vectors."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 0.02, (n // 3, dim)) + 3]
    for _ in range(5):
        parts.append(rng.normal(0, rng.uniform(0.05, 0.4), (n // 10, dim)) + rng.uniform(-3, 3, dim))
    x = np.concatenate([*parts, rng.uniform(-5, 5, (n - sum(map(len, parts)), dim))])
    x[10:17] = x[10]
    x[-1] = x[-2]
    return np.round(x, 6)[rng.permutation(len(x))]


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], "id long, v array<double>").repartition(5)


def distances(x):
    return np.array([np.sqrt(((x - a) ** 2).sum(axis=1)) for a in x])


@pytest.fixture(params=[(2048, 2048, 4096), (16, 10, 7)], ids=["one cell", "slices and chunks"])
def sizes(request, monkeypatch):
    cell_rows, slice_rows, chunk_rows = request.param
    monkeypatch.setattr(metric, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(metric, "CHUNK_ROWS", chunk_rows)
    return cell_rows


@pytest.mark.parametrize(("k", "within"), [(5, math.inf), (2, 0.3)])
def test_nearest_matches_brute_force(spark, sizes, k, within):
    x = clumps(1)
    d = distances(x)
    got = {}
    for r in metric.nearest(frame(spark, x), k, within, cell_rows=sizes).collect():
        got.setdefault(r.id, []).append((r.dist, r.nbr))
    want = {i: sorted((d[i, j], j) for j in range(len(x)) if d[i, j] <= within)[:k] for i in range(len(x))}
    assert {i: sorted(v) for i, v in got.items()} == {i: [(float(a), int(b)) for a, b in v] for i, v in want.items()}


def test_cells_keep_far_points_apart(spark, monkeypatch):
    """Well separated clumps: a point visits its own clump's cells, not all of them."""
    monkeypatch.setattr(metric, "SLICE_ROWS", 64)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.1, (100, 8)) + 20 * rng.normal(0, 1, 8) for _ in range(20)])
    seen = []
    blocks = metric._blocks

    def counted(visits, *rest):
        seen.append(visits.count())
        return blocks(visits, *rest)

    monkeypatch.setattr(metric, "_blocks", counted)
    metric.nearest(frame(spark, x), 5, cell_rows=50).count()
    assert seen[0] < 8 * len(x)


def test_points_travel_to_blocks_not_to_every_cell(spark, monkeypatch):
    """Scattered points, which no bound keeps apart: what a point is copied for does not grow with the cells."""
    monkeypatch.setattr(metric, "SLICE_ROWS", 10)
    monkeypatch.setattr(metric, "BLOCKS", 4, raising=False)
    x = np.random.default_rng(4).normal(0, 1, (500, 24))
    seen = []
    blocks = metric._blocks

    def counted(visits, *rest):
        seen.append(visits.count())
        return blocks(visits, *rest)

    monkeypatch.setattr(metric, "_blocks", counted)
    got = {}
    for r in metric.nearest(frame(spark, x), 3, cell_rows=10).collect():
        got.setdefault(r.id, []).append((r.dist, r.nbr))
    assert seen[0] <= 5 * len(x)  # there are over 20 cells
    d = distances(x)
    assert all(sorted(got[i]) == sorted((float(d[i, j]), j) for j in range(len(x)))[:3] for i in range(len(x)))


def mutual(x, min_samples):
    d = distances(x)
    core = np.sort(d, axis=1)[:, min(min_samples, len(x) - 1)]
    return np.maximum(d, np.maximum(core[:, None], core[None, :])), core


def kruskal(w):
    n = len(w)
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    out = []
    for weight, a, b in sorted((w[a, b], a, b) for a, b in itertools.combinations(range(n), 2)):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((float(weight), a, b))
    return out


def test_spanning_tree_matches_kruskal(spark, sizes):
    x = clumps(3, 150)
    w, core = mutual(x, 4)
    cores = spark.createDataFrame([(i, float(c)) for i, c in enumerate(core)], "id long, core double")
    got = sorted(tuple(r) for r in metric.spanning_tree(frame(spark, x), cores, cell_rows=sizes).collect())
    assert got == sorted(kruskal(w))


def brute_hierarchy(x, min_size, min_samples):
    """Top-down: remove the heaviest edges one by one; parts that are too small fall out."""
    w, _ = mutual(x, min_samples)
    edges = sorted(kruskal(w))
    inv = lambda a: 1.0 / max(a, density.LEAST_DISTANCE)
    clusters = []  # stability, members, children

    def part(nodes, level):
        left = [(a, b) for _, a, b in edges[:level] if a in nodes]
        seen, stack = set(), [next(iter(nodes))]
        near = {}
        for a, b in left:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        out = []
        rest = set(nodes)
        while rest:
            stack = [rest.pop()]
            one = set(stack)
            while stack:
                for y in near.get(stack.pop(), []):
                    if y in rest:
                        rest.discard(y)
                        one.add(y)
                        stack.append(y)
            out.append(one)
        del seen
        return out

    def grow(nodes, level, birth):
        """The cluster of ``nodes`` born at density ``birth``, whose edges are those below ``level``."""
        mine = len(clusters)
        clusters.append([0.0, set(nodes), []])
        while level:
            level -= 1
            weight, a, b = edges[level]
            if a not in nodes:
                continue
            big = [p for p in part(nodes, level) if len(p) >= min_size]
            if len(big) == 2:
                clusters[mine][0] += len(nodes) * (inv(weight) - birth)
                clusters[mine][2] = [grow(p, level, inv(weight)) for p in big]
                return mine
            kept = big[0] if big else set()
            clusters[mine][0] += (len(nodes) - len(kept)) * (inv(weight) - birth)
            nodes = kept
            if not nodes:
                return mine
        return mine

    grow(set(range(len(x))), len(edges), 0.0)

    def best(c):
        stability, _, children = clusters[c]
        found = [best(y) for y in children]
        below = sum(s for s, _ in found)
        if c and (not children or below <= stability):
            return stability, [c]
        return below, [y for _, ys in found for y in ys]

    labels = np.full(len(x), -1)
    if len(x) >= min_size:
        members = sorted((sorted(clusters[c][1]) for c in best(0)[1]), key=lambda m: m[0])
        for k, m in enumerate(members):
            labels[m] = k
    return labels.tolist()


@pytest.mark.parametrize(("seed", "n", "min_size", "min_samples"), [(4, 500, 5, 5), (5, 200, 2, 1), (6, 240, 9, 3)])
def test_hierarchy_matches_brute_force(spark, seed, n, min_size, min_samples):
    x = clumps(seed, n)
    want = brute_hierarchy(x, min_size, min_samples)
    rows = frame(spark, x).withColumn("node", F.lit("clash"))
    got = {r.id: r.cluster for r in density.hierarchy_labels(rows, "id", "v", min_size, min_samples, cell_rows=40).collect()}
    assert [got[i] for i in range(len(x))] == want and len(set(want)) > 3 and -1 in want


def test_hierarchy_edge_cases(spark):
    def labels(x, **kw):
        return [r.cluster for r in density.hierarchy_labels(frame(spark, x), "id", "v", **kw).sort("id").collect()]

    assert labels(np.zeros((0, 2))) == []
    assert labels(np.ones((1, 2))) == [-1]
    assert labels(np.arange(8.0).reshape(4, 2)) == [-1] * 4  # fewer than a cluster
    assert labels(np.ones((12, 2))) == [-1] * 12  # one clump is no cluster
    assert labels(np.array([[0.0, 0]] * 6 + [[9.0, 9]] * 6)) == [0] * 6 + [1] * 6
    some = spark.createDataFrame([(1, None), (2, [1.0])], "id long, v array<double>")
    assert {r.id: r.cluster for r in density.hierarchy_labels(some, "id", "v").collect()} == {1: -1, 2: -1}
    with pytest.raises(ValueError):
        density.hierarchy_labels(some, "id", "v", min_size=1)


def test_similarity_search_with_zero_vectors_and_thresholds(spark):
    """V3 and V4 on top of the cells: zero vectors are similar to nothing, missing ones have no neighbours."""
    from aspectra.operators import vectors as V

    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (40, 3))
    x[[4, 9]] = 0
    x[20:24] = 3 * x[20]
    unit = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    sims = np.round(unit @ unit.T, 9)
    rows = frame(spark, x).unionByName(spark.createDataFrame([(99, None)], "id long, v array<double>"))
    got = {}
    for r in V.knn_self(rows, "id", "v", 4, block_size=8).collect():
        got.setdefault(r.id, []).append((r.rank, r.nbr))
    assert got == {i: [(n + 1, j) for n, j in enumerate(sorted(range(40), key=lambda j: (-sims[i, j], j))[:4])] for i in range(40)}
    near = {r.id: r.nn for r in V.nearest_within(rows, "id", "v", 0.9).collect()}
    want = {i: min((j for j in range(40) if j != i and sims[i, j] >= 0.9), key=lambda j: (-sims[i, j], j), default=None) for i in range(40)}
    assert near == {i: j for i, j in want.items() if j is not None}


@pytest.mark.parametrize("algorithm", ["auto", "kmeans", "hdbscan"])
def test_method_selection_takes_density_labels(spark, algorithm):
    from aspectra.operators import clusters as C

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.05, (20, 3)) + c for c in np.eye(3) * 4] + [rng.normal(0, 0.05, (20, 3)) - 4])
    rows = frame(spark, x).withColumn("cluster", (F.col("id") % 4).cast("int"))  # poor labels
    got = C.select_labels(rows, "id", "v", algorithm).collect()
    if algorithm == "kmeans":
        assert {(r.method, r.cluster) for r in got if r.id < 2} == {("kmeans", 0), ("kmeans", 1)}
    else:
        assert {(r.id // 20, r.method, r.cluster) for r in got} == {(k, "density", k) for k in range(4)}
