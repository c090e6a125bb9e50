"""K-means over all (k, seed) at once.

Points that fit into a task (``HELD_BYTES``) travel to a few tasks, each of which fits its share of
the models to rest.  It knows a bound of how much nearer every point's centroid is than the others;
while that exceeds what the centroids have moved since, the point is not compared again.

Of more points every model moves one step per pass: a task compares its points with the centroids of
all models that still move, and returns sums per centroid; the few sums give the next centroids.  Such
a sweep is so many passes as its slowest model needs, not one job per model and step.  Costs and the
silhouette of every k come from two more passes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from aspectra.functions.ops import saved, small_batches

#: Rows the first centroids are drawn from, rows compared at once in a task, and the share of the variance below which a model rests.
SAMPLE_ROWS, TOGETHER, REST = 4096, 1024, 1e-4
#: Rows that a step of all models compares at once: the distances to the models of one k stay in the processor's cache.
STEP_ROWS = 512
#: Bytes of points that a task may hold, points that travel in one row, and rows of one model compared at once.
HELD_BYTES, PACKED, FIT_ROWS = 320 << 20, 1024, 4096
#: Costs that differ by a smaller share count as equal: seeds that end in the same clusters differ by rounding.
EQUAL_COST = 1e-12


def plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """First centroids: each next one is drawn with a chance in proportion to its squared distance from those there are."""
    rng = np.random.default_rng([seed, k])
    at = [int(rng.integers(len(x)))]
    far = ((x - x[at[0]]) ** 2).sum(axis=1)
    while len(at) < k:
        total = np.cumsum(far)
        at.append(int(np.searchsorted(total, rng.random() * total[-1], side="right").clip(0, len(x) - 1)) if total[-1] > 0 else int(rng.integers(len(x))))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
    return x[at]


def _far2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.clip((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (x @ c.T), 0.0, None)


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])


class _Models:
    """Centroids of several models, one below the other."""

    def __init__(self, models: dict[int, np.ndarray]):
        self.names = list(models)
        self.all = np.concatenate([models[m] for m in self.names])
        ends = np.cumsum([len(models[m]) for m in self.names])
        self.spans = list(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True))

    def nearest(self, x: np.ndarray):
        """Per model its span, and every row's centroid and squared distance."""
        far = _far2(x, self.all)
        for lo, hi in self.spans:
            own = far[:, lo:hi].argmin(axis=1)
            yield lo, hi, own, far[np.arange(len(x)), lo + own]

    def equal_sizes(self):
        """Runs of models with the same number of centroids: the first model's position, how many, centroids of each."""
        sizes = np.array([hi - lo for lo, hi in self.spans])
        starts = np.flatnonzero(np.concatenate([[True], sizes[1:] != sizes[:-1]]))
        return [(int(a), int(b - a), int(sizes[a])) for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True)]


class _Step:
    """Sums of the rows nearest to each centroid, over all batches given to ``add``: vector sums, summed squared norm and rows side by side."""

    def __init__(self, models: _Models):
        self.models, self.runs = models, models.equal_sizes()
        # one product with (x, 1) gives |c|^2 - 2 xc, which orders a row's centroids as the distance does
        self.low = np.hstack([-2.0 * models.all, (models.all * models.all).sum(axis=1)[:, None]])
        self.sums = np.zeros((len(models.all), models.all.shape[1] + 2))
        self.cost = np.zeros(len(models.names))

    def add(self, x: np.ndarray) -> None:
        one, norm = np.ones((len(x), 1)), (x * x).sum(axis=1)
        across, down = np.ascontiguousarray(np.hstack([x, one]).T), np.hstack([x, norm[:, None], one])
        for at, many, k in self.runs:
            lo = self.models.spans[at][0]
            rows = slice(lo, lo + many * k)
            far = (self.low[rows] @ across).reshape(many, k, len(x))
            least = far.min(axis=1)
            hot = far == least[:, None, :]
            if np.count_nonzero(hot) != many * len(x):  # ties: the first centroid; not a number equals nothing
                own = far.argmin(axis=1)
                least = np.take_along_axis(far, own[:, None, :], axis=1)[:, 0]
                hot = np.arange(k)[None, :, None] == own[:, None, :]
            self.sums[rows] += hot.reshape(many * k, len(x)).astype(np.float64) @ down
            self.cost[at : at + many] += np.clip(least + norm, 0.0, None).sum(axis=1)


SUMS = "share int, part int, sums binary, cost binary"


def _pass(vectors: DataFrame, models: dict[int, np.ndarray]) -> dict[int, tuple]:
    """Per model: rows, vector sums and summed squared norms of each centroid, and the cost.

    A task returns its sums in a few shares of neighbouring models, twice as many as there are cores, which are
    added up apart: no group holds more than its share of the centroids for every task."""
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(_Models(models))  # all centroids: bounded by the ks and seeds asked for
    shares = np.array_split(np.arange(len(models)), min(len(models), 2 * context.defaultParallelism))
    spans = _Models(models).spans

    def sums(frames):
        step = _Step(shared.value)
        for frame in frames:
            x = _matrix(frame["v"])
            for at in range(0, len(x), STEP_ROWS):
                step.add(x[at : at + STEP_ROWS])
        part = TaskContext.get().partitionId()
        yield pd.DataFrame(
            [(i, part, step.sums[spans[own[0]][0] : spans[own[-1]][1]].tobytes(), step.cost[own].tobytes()) for i, own in enumerate(shares)],
            columns=["share", "part", "sums", "cost"])

    def add(frame):
        frame = frame.sort_values("part")  # one order of summation
        joined = {c: sum(np.frombuffer(b) for b in frame[c]).tobytes() for c in ("sums", "cost")}
        return pd.DataFrame([{"share": frame["share"].iloc[0], "part": -1, **joined}])

    found = vectors.mapInPandas(sums, SUMS).groupBy("share").applyInPandas(add, SUMS).collect()  # the sums of all centroids, once
    out, names, width = {}, list(models), next(iter(models.values())).shape[1] + 2
    for r in found:
        own, cost = shares[r["share"]], np.frombuffer(r["cost"])
        held, first = np.frombuffer(r["sums"]).reshape(-1, width), spans[own[0]][0]
        for k, c in zip(own, cost, strict=True):
            lo, hi = spans[k]
            rows = held[lo - first : hi - first]
            out[names[k]] = rows[:, -1], rows[:, :-2], rows[:, -2], float(c)
    return out


def fit_all(vectors: DataFrame, start: dict[int, np.ndarray], tolerance: float, max_iter: int) -> dict[int, np.ndarray]:
    """All models at rest, or after ``max_iter`` steps; a centroid without rows stays where it is."""
    models, moving = dict(start), set(start)
    for _ in range(max_iter):
        if not moving:
            break
        for name, (n, sums, _, _) in _pass(vectors, {m: models[m] for m in sorted(moving)}).items():
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], models[name])
            if ((new - models[name]) ** 2).sum() <= tolerance:
                moving.discard(name)
            models[name] = new
    return models


class _Fit:
    """One model on all points: Lloyd's steps, in which only rows whose bounds have met are compared with the centroids again.

    ``short``: the points in single precision, by which rows are compared; what rounding could turn is compared
    again in double precision, and sums are taken in it.  ``whole``: the points themselves, None if ``short`` is exact."""

    def __init__(self, short: np.ndarray, whole: np.ndarray | None, norms: np.ndarray, start: np.ndarray):
        self.short, self.whole, self.norms, self.c = short, whole, norms, start.copy()
        self.own = np.zeros(len(short), dtype=np.int32)
        # by how much every other centroid was farther than the own one at least, when a row was last compared, and that step
        self.gap, self.at = np.zeros(len(short)), np.zeros(len(short), dtype=np.int32)
        self.past = [self.c]  # the centroids of every step
        self.sums, self.n = np.zeros_like(self.c), np.zeros(len(start), dtype=np.int64)
        self.most = math.sqrt(float(norms.max(initial=0.0)))

    def _exact(self, rows) -> np.ndarray:
        return self.short[rows].astype(np.float64) if self.whole is None else self.whole[rows]

    def _error(self, kind) -> float:
        """More than the rounding error of a value of ``_two``."""
        longest = math.sqrt(float((self.c * self.c).sum(axis=1).max()))
        return (self.c.shape[1] + 8) * float(np.finfo(kind).eps) * (2.0 * self.most * longest + longest * longest)

    def _two(self, x: np.ndarray):
        """Per row its first nearest centroid, and |c|^2 - 2 xc of that one and of the next: they order centroids as distances do."""
        c = self.c.astype(x.dtype)
        far = (-2.0 * c).astype(x.dtype) @ x.T
        far += (self.c * self.c).sum(axis=1).astype(x.dtype)[:, None]
        least = far.min(axis=0)
        hot = far == least
        if np.count_nonzero(hot) == len(x):
            own = (np.arange(len(far), dtype=x.dtype) @ hot.astype(x.dtype)).astype(np.int32)
            np.copyto(far, np.inf, where=hot)
        else:  # ties: the first centroid; not a number equals nothing
            own = far.argmin(axis=0).astype(np.int32)
            far[own, np.arange(len(x))] = np.inf
        return own, least.astype(np.float64), far.min(axis=0).astype(np.float64)

    def _add(self, own: np.ndarray, x: np.ndarray, sign: int) -> None:
        hot = np.arange(len(self.c))[:, None] == own[None, :]
        self.sums += sign * (hot.astype(np.float64) @ x)
        self.n += sign * np.count_nonzero(hot, axis=1)

    def compare(self, rows: np.ndarray, first: bool = False) -> None:
        own, least, second = self._two(self.short[rows])
        norms, error = self.norms[rows], self._error(np.float32)
        up, low = least + norms + error, second + norms - error
        near = np.flatnonzero(~(second - least > 2.0 * error))
        if len(near):
            own[near], least, second = self._two(self._exact(rows[near]))
            error = self._error(np.float64)
            up[near], low[near] = least + norms[near] + error, second + norms[near] - error
        self.gap[rows], self.at[rows] = np.sqrt(np.maximum(low, 0.0)) - np.sqrt(np.maximum(up, 0.0)), len(self.past) - 1
        if first:
            self._add(own, self._exact(rows), 1)
        else:
            old = self.own[rows]
            other = np.flatnonzero(own != old)
            if len(other):
                x = self._exact(rows[other])
                self._add(old[other], x, -1)
                self._add(own[other], x, 1)
        self.own[rows] = own

    def _drift(self) -> np.ndarray:
        """Per step and centroid by how much, since that step, it can have come off its rows beside all other centroids."""
        away = np.sqrt(((np.array(self.past) - self.c) ** 2).sum(axis=2))
        most = np.broadcast_to(away.max(axis=1)[:, None], away.shape).copy()  # of the other centroids
        if away.shape[1] > 1:
            most[np.arange(len(away)), away.argmax(axis=1)] = np.partition(away, -2, axis=1)[:, -2]
        return away + most + 1e-9 * (1.0 + self.most)

    def to_rest(self, tolerance: float, max_iter: int) -> np.ndarray:
        met = np.arange(len(self.short))
        for step in range(max_iter):
            for at in range(0, len(met), FIT_ROWS):
                self.compare(met[at : at + FIT_ROWS], first=step == 0)
            new = np.where(self.n[:, None] > 0, self.sums / np.maximum(self.n, 1)[:, None], self.c)
            moved = new - self.c
            self.c = new
            if (moved * moved).sum() <= tolerance:
                break
            self.past.append(new)
            met = np.flatnonzero(~(self.gap > self._drift()[self.at, self.own]))  # not a number is no bound
        return self.c


def _packed(vectors: DataFrame) -> DataFrame:
    """``rows, short, x``: up to ``PACKED`` points as the bytes of their numbers, in single precision where that is exact."""

    def batches(frames):
        for frame in frames:
            x = _matrix(frame["v"])
            for at in range(0, len(x), PACKED):
                part = x[at : at + PACKED]
                exact = bool((part.astype(np.float32) == part).all())
                yield pd.DataFrame({"rows": [len(part)], "short": [exact], "x": [(part.astype(np.float32) if exact else part).tobytes()]})

    return vectors.mapInPandas(batches, "rows int, short boolean, x binary")


def _fit_held(packed: DataFrame, n: int, short: bool, start: dict[int, np.ndarray], tolerance: float, max_iter: int) -> dict[int, np.ndarray]:
    """``fit_all`` for ``n`` points (of ``_packed``) that a task can hold: tasks get all points and each its share of the models."""
    context = packed.sparkSession.sparkContext
    dim = next(iter(start.values())).shape[1]
    shared = context.broadcast(start)
    tasks = min(len(start), 2 * context.defaultParallelism)
    names = sorted(start, key=lambda m: (-len(start[m]), m))  # every task has models of all sizes

    def rest(held, norms, task):
        own = names[task::tasks]
        lower, whole = held if not short else (held[0], None)
        return pd.DataFrame({"model": own, "c": [_Fit(lower, whole, norms, shared.value[m]).to_rest(tolerance, max_iter).tobytes() for m in own]})

    def fitted(frames):
        held = [np.zeros((n, dim), dtype=kind) for kind in ((np.float32,) if short else (np.float32, np.float64))]
        norms, at = np.zeros(n), 0
        for frame in frames:
            for task, rows, small, data in zip(frame["task"], frame["rows"], frame["short"], frame["x"], strict=True):
                x = np.frombuffer(data, dtype=np.float32 if small else np.float64).reshape(rows, dim)
                for to in held:
                    to[at : at + rows] = x
                norms[at : at + rows] = (x.astype(np.float64) ** 2).sum(axis=1)
                at += rows
                if at == n:  # a partition may have got several shares
                    yield rest(held, norms, task)
                    at = 0

    each = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")
    sent = packed.select("rows", "short", "x", F.xxhash64("x").alias("order"), each)
    laid = sent.repartitionById(tasks, "task").sortWithinPartitions("task", "order").drop("order")  # one order of summation
    with small_batches(packed.sparkSession):
        found = laid.mapInPandas(fitted, "model int, c binary").collect()  # all centroids: bounded by the ks and seeds asked for
    return {r["model"]: np.frombuffer(r["c"]).reshape(-1, dim) for r in found}


def silhouettes(vectors: DataFrame, models: dict[int, np.ndarray], stats: dict[int, tuple]) -> dict[int, float]:
    """Mean silhouette on squared distances per model, in one pass: the mean squared distance to a cluster follows from its sums."""
    means = {}
    for name, (n, sums, squares, _) in stats.items():
        held = np.maximum(n, 1)
        means[name] = (n, sums / held[:, None], squares / held)
    shared = vectors.sparkSession.sparkContext.broadcast((_Models(models), means))

    def batches(frames):
        m, means = shared.value
        for frame in frames:
            x_all = _matrix(frame["v"])
            for at in range(0, len(x_all), TOGETHER):
                x = x_all[at : at + TOGETHER]
                norms, rows = (x * x).sum(axis=1), np.arange(len(x))
                out = []
                for name, (_, _, own, _) in zip(m.names, m.nearest(x), strict=True):
                    n, mean, square = means[name]
                    d = np.clip(norms[:, None] - 2.0 * (x @ mean.T) + square[None, :], 0.0, None)
                    size = n[own]
                    a = d[rows, own] * size / np.maximum(size - 1, 1)
                    d[:, n == 0] = np.inf
                    d[rows, own] = np.inf
                    b = d.min(axis=1)
                    most = np.maximum(a, b)
                    s = np.where((size > 1) & (most > 0) & np.isfinite(b), (b - a) / np.where(most > 0, most, 1), 0.0)
                    out.append((name, float(s.sum()), len(x)))
                yield pd.DataFrame(out, columns=["model", "s", "n"])

    found = vectors.mapInPandas(batches, "model int, s double, n long").groupBy("model").agg((F.sum("s") / F.sum("n")).alias("s")).collect()  # one row a model
    return {r["model"]: r["s"] for r in found}


def kmeans_sweep(points: DataFrame, vec_col: str, ks: range, seeds, max_iter: int) -> tuple[DataFrame, DataFrame]:
    """(points with ``cluster``, ``k, silhouette_sq, cost``): per k the cheapest of the models of all seeds (the first on ties), and of these the best by silhouette (the first on ties)."""
    spark = points.sparkSession
    vectors = points.select(F.transform(vec_col, lambda e: e.cast("double")).alias("v"))
    vectors = saved(vectors.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("v")), "sweep-points")
    sample = _matrix(vectors.orderBy(F.xxhash64("v", F.lit(1)), "v").limit(SAMPLE_ROWS).toPandas()["v"])
    names = [(k, s) for k in ks for s in seeds]
    none = spark.createDataFrame([], "k int, silhouette_sq double, cost double")
    if not names or not len(sample):
        return points.withColumn("cluster", F.lit(0)), none
    start = {i: plus_plus(sample, k, s) for i, (k, s) in enumerate(names)}
    tolerance = REST * float(sample.var(axis=0).mean())
    packed = saved(_packed(vectors), "sweep-packed")
    n, short = packed.agg(F.sum("rows"), F.min("short")).first()
    if n * sample.shape[1] * (4 if short else 12) <= HELD_BYTES:
        models = _fit_held(packed, n, short, start, tolerance, max_iter)
    else:
        models = fit_all(vectors, start, tolerance, max_iter)
    stats = _pass(vectors, models)
    best: dict[int, int] = {}
    for i, (k, _) in enumerate(names):
        if k not in best or stats[i][3] < stats[best[k]][3] * (1 - EQUAL_COST):
            best[k] = i
    chosen = {i: models[i] for i in best.values() if (stats[i][0] > 0).sum() > 1}
    if not chosen:
        return points.withColumn("cluster", F.lit(0)), none
    score = silhouettes(vectors, chosen, {i: stats[i] for i in chosen})
    metrics = [(names[i][0], float(score[i]), float(stats[i][3])) for i in sorted(chosen)]
    top = max(sorted(chosen), key=lambda i: score[i])
    shared = spark.sparkContext.broadcast(_Models({top: models[top]}))

    def label(frames):
        for frame in frames:
            if len(frame):
                _, _, own, _ = next(shared.value.nearest(_matrix(frame[vec_col])))
                yield frame.assign(cluster=own.astype(np.int32))

    schema = StructType([*points.schema.fields, StructField("cluster", IntegerType())])
    return points.mapInPandas(label, schema), spark.createDataFrame(metrics, "k int, silhouette_sq double, cost double")
