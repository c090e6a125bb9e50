"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors are assigned to the nearest cell of a k-means fitted on a bounded sample
and covered, slice by slice, by balls a quarter as wide as the threshold's angle:
all vectors of a ball are linked, so a clump of near copies is a few balls.
Ball centres are placed in ``overlap`` cells each; every cell (cut into slices of
bounded size) builds a graph whose neighbour lists are robustly pruned, and a
centre's lists of all its cells are united.  Every centre is then searched for
among the members of its own cell and the neighbours the united lists name: a
greedy beam search starts at the medoid and holds a bounded frontier, and from
each node in range the search expands to its neighbours until none in range is
new.  Two balls near enough that all their vectors are linked are settled by
their centres; of other balls in reach the vectors are compared block by block
and their links counted there.  Every link is verified in double precision.
Recall is audited against brute force on stated queries, each linked one with
the same weight, and the search is repeated with more cells and a wider beam
while it is too low.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import components, saved

#: Rows the cells are fitted on at most for each cell, and cells that k-means rounds still improve.
SAMPLE_PER_CELL, REFINED_CELLS = 16, 1 << 10
#: Audit: queries of the first block, queries at most, linked queries that suffice, and the share of its true links a query must find on average.
AUDIT_QUERIES, AUDIT_MOST, AUDIT_LINKED, RECALL = 512, 1 << 14, 128, 0.95
#: Queries searched at once, (query, node) pairs expanded at once, and rows of a block that is pruned or compared; they bound what a task holds.
TOGETHER, PAIRS_TOGETHER, BLOCK = 128, 1 << 10, 512
#: Beyond what is asked for by so much, nodes still lead the search on.
SLACK = 0.05
#: Angle of a ball as a share of the threshold's; at most a half, so that the vectors of a ball are linked.
BALL = 0.25
#: Vectors of a ball compared in one block, and rows of one group of blocks, about.
CHUNK_ROWS, GROUP_ROWS = 1 << 10, 1 << 15


def _matrix(vectors, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype="<f8").reshape(-1, dim)


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, dim, unit`` (little-endian doubles) of the vectors that have a direction; ``rows`` are distinct ``vec_id, embedding``."""

    def batches(frames):
        for frame in frames:
            out = []
            for vec_id, raw in zip(frame["vec_id"], frame["embedding"], strict=True):
                v = np.asarray(raw, dtype=np.float64)
                v = v / np.abs(v).max()  # no overflow in the squares
                out.append((vec_id, len(v), (v / np.sqrt(v @ v)).tobytes()))
            yield pd.DataFrame(out, columns=["vec_id", "dim", "unit"])

    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & usable).mapInPandas(batches, "vec_id long, dim int, unit binary")


def fit_cells(reps: DataFrame, cells: int, dim: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means on the rows of the smallest id hash; many cells are centred on such rows as they are."""
    refine = cells <= REFINED_CELLS
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(cells * (SAMPLE_PER_CELL if refine else 1)).toPandas()
    x = _matrix(sample["unit"], dim)
    centroids = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(rounds if refine else 0):
        near = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def assign(reps: DataFrame, centroids: np.ndarray, overlap: int) -> DataFrame:
    """``rep, unit, cell, own``: each vector in its ``overlap`` nearest cells; ``own`` marks the nearest."""
    shared = reps.sparkSession.sparkContext.broadcast(centroids)  # twice the square root of the rows at most
    take = min(overlap, len(centroids))

    def batches(frames):
        c = shared.value
        for frame in frames:
            if not len(frame):
                continue
            near = np.argsort(-(_matrix(frame["unit"], c.shape[1]) @ c.T), axis=1, kind="stable")[:, :take]
            for k in range(take):
                yield pd.DataFrame({"rep": frame["rep"], "unit": frame["unit"], "cell": near[:, k].astype(np.int32), "own": k == 0})

    return reps.select("rep", "unit").mapInPandas(batches, "rep long, unit binary, cell int, own boolean")


def cover(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy balls: per row its centre (a row) and the similarity to it, at least ``least``."""
    centre, sim = np.full(len(x), -1), np.ones(len(x))
    open_ = np.arange(len(x))
    while len(open_):
        near = x[open_] @ x[open_[0]]
        near[0] = 1.0
        held = near >= least
        centre[open_[held]], sim[open_[held]] = open_[0], near[held]
        open_ = open_[~held]
    return centre, sim


def robust_prune(x: np.ndarray, degree: int, alpha: float, seed: int) -> list[np.ndarray]:
    """Neighbour lists of a slice: candidates are the nearest ones and some drawn ones; a chosen neighbour rules out candidates it is closer to by ``alpha``.

    Links are made both ways; of a node that many chose, its ``2 * degree`` nearest stay.
    """
    m = len(x)
    n = min(m - 1, 2 * degree)
    rng = np.random.default_rng(seed)
    ends: list[np.ndarray] = []
    for at in range(0, m if m > 1 else 0, BLOCK):
        rows = np.arange(at, min(at + BLOCK, m))
        far = 1 - x[rows] @ x.T
        far[np.arange(len(rows)), rows] = np.inf
        near = np.argpartition(far, n - 1, axis=1)[:, :n]
        candidates = np.concatenate([near, rng.integers(0, m, size=(len(rows), degree))], axis=1)
        distance = np.take_along_axis(far, candidates, 1)
        order = np.argsort(distance, axis=1, kind="stable")
        candidates, distance = np.take_along_axis(candidates, order, 1), np.take_along_axis(distance, order, 1)
        vectors = x[candidates]
        open_ = np.isfinite(distance)
        for _ in range(degree):
            has = np.flatnonzero(open_.any(axis=1))
            if not len(has):
                break
            chosen = candidates[has, np.argmax(open_[has], axis=1)]
            ends.append(np.stack([rows[has], chosen]))
            between = 1 - np.einsum("ij,ikj->ik", x[chosen], vectors[has])
            open_[has] &= (alpha * between > distance[has]) & (candidates[has] != chosen[:, None])
    if not ends:
        return [np.zeros(0, dtype=np.int64)] * m
    a, b = np.concatenate(ends, axis=1)
    pair = np.unique(np.concatenate([a * np.int64(m) + b, b * np.int64(m) + a]))
    a, b = pair // m, pair % m
    sim = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + (1 << 16)]], x[b[k : k + (1 << 16)]]) for k in range(0, len(a), 1 << 16)])
    order = np.lexsort((-sim, a))
    a, b = a[order], b[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < 2 * degree
    a, b = a[keep], b[keep]
    return np.split(b, np.searchsorted(a, np.arange(1, m)))


def build(members: DataFrame, dim: int, degree: int = 16, alpha: float = 1.2) -> DataFrame:
    """``rep, neighbours``: the united neighbour lists of all cells and slices a vector is in."""

    def one(key, frame):
        frame = frame.sort_values("rep")
        ids = frame["rep"].to_numpy()
        lists = robust_prune(_matrix(frame["unit"], dim), degree, alpha, int(key[0]) * 1009 + int(key[1]))
        return pd.DataFrame({"rep": ids, "neighbours": [ids[i].tolist() for i in lists]})

    lists = members.groupBy("cell", "slice").applyInPandas(one, "rep long, neighbours array<long>")
    return lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))  # one list a cell


def _fresh(table, seen, q, nodes):
    """Marks and returns the unseen neighbours of (query, node) pairs, each pair once."""
    to = table[nodes]
    q = np.repeat(q, to.shape[1])
    to = to.ravel()
    keep = to >= 0
    q, to = q[keep], to[keep]
    keep = ~seen[q, to]
    pair = np.unique(q[keep] * np.int64(seen.shape[1]) + to[keep])
    q, to = pair // seen.shape[1], pair % seen.shape[1]
    seen[q, to] = True
    return q, to


def _search(x, table, queries, asked, start: int, width: int):
    """Greedy beam search with a frontier of ``width`` nodes a query, then range expansion: (query, node, similarity) of at least ``asked - SLACK``."""
    nq, m = len(queries), len(x)
    rows = np.arange(nq)
    seen = np.zeros((nq, m), dtype=bool)
    seen[:, start] = True
    ids = np.full((nq, width), -1)
    sims = np.full((nq, width), -2.0)
    done = np.ones((nq, width), dtype=bool)
    ids[:, 0], sims[:, 0], done[:, 0] = start, queries @ x[start], False
    first = np.flatnonzero(sims[:, 0] >= asked - SLACK)
    hits = [(first, np.full(len(first), start), sims[first, 0])]
    live = rows
    while len(live):
        waiting = np.where(done[live], -3.0, sims[live])
        best = waiting.argmax(axis=1)
        go = waiting[np.arange(len(live)), best] > -3.0
        live, best = live[go], best[go]
        if not len(live):
            break
        done[live, best] = True
        q, to = _fresh(table, seen, live, ids[live, best])
        if not len(q):
            continue
        s = np.einsum("ij,ij->i", queries[q], x[to])
        near = s >= asked[q] - SLACK
        hits.append((q[near], to[near], s[near]))
        # newcomers, row by row beside the frontier, of which the best ``width`` stay
        at = np.arange(len(q)) - np.searchsorted(q, q)
        some = np.unique(q)
        place = np.searchsorted(some, q)
        new_ids, new_sims = np.full((len(some), at.max() + 1), -1), np.full((len(some), at.max() + 1), -2.0)
        new_ids[place, at], new_sims[place, at] = to, s
        all_ids = np.concatenate([ids[some], new_ids], axis=1)
        all_sims = np.concatenate([sims[some], new_sims], axis=1)
        all_done = np.concatenate([done[some], new_ids < 0], axis=1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[some], sims[some], done[some] = (np.take_along_axis(y, top, 1) for y in (all_ids, all_sims, all_done))
    border = tuple(np.concatenate(c) for c in zip(*hits, strict=True))
    found = [border]
    while len(border[0]):
        news = []
        for k in range(0, len(border[0]), PAIRS_TOGETHER):
            q, to = _fresh(table, seen, border[0][k : k + PAIRS_TOGETHER], border[1][k : k + PAIRS_TOGETHER])
            s = np.einsum("ij,ij->i", queries[q], x[to])
            near = s >= asked[q] - SLACK
            news.append((q[near], to[near], s[near]))
        border = tuple(np.concatenate(c) for c in zip(*news, strict=True))
        found.append(border)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def range_search(x, lists, queries, asked, width: int):
    """(query, node, similarity) of the nodes found that are at least ``asked`` (one bound a query) similar."""
    table = np.full((len(x), max(1, max(map(len, lists)))), -1, dtype=np.int64)
    for i, to in enumerate(lists):
        table[i, : len(to)] = to
    start = int(np.argmax(x @ x.mean(axis=0)))
    out = []
    for at in range(0, len(queries), TOGETHER):
        q, node, s = _search(x, table, queries[at : at + TOGETHER], asked[at : at + TOGETHER], start, width)
        keep = s >= asked[at + q]
        out.append((q[keep] + at, node[keep], s[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search(members: DataFrame, graph: DataFrame, balls: DataFrame, sizes: DataFrame, dim: int, threshold: float, width: int) -> DataFrame:
    """``a, b, sim`` (a < b): distinct pairs of ball centres that some search found near enough to hold a link.

    ``members``: ``cell, slice, rep, unit, radius, own``.
    """
    placed = members.join(graph, "rep")
    named = placed.select("cell", "slice", F.explode("neighbours").alias("rep")).distinct()
    beyond = named.join(members.select("cell", "slice", "rep"), ["cell", "slice", "rep"], "left_anti").join(balls.select("rep", "unit", "radius"), "rep").join(graph, "rep")
    columns = ["cell", "slice", "rep", "unit", "radius", "neighbours"]
    held = placed.select(columns).unionByName(beyond.select(columns))
    # each slice of a cell is searched by each slice of the cell's own vectors
    pieces = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    data = held.join(F.broadcast(sizes), "cell").select(*columns, pieces.alias("asked_by"))
    asking = members.where("own").join(F.broadcast(sizes), "cell").select("cell", pieces.alias("slice"), F.col("slice").alias("asked_by"), "rep", "unit", "radius")
    both = data.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    angle = math.acos(threshold)

    def one(frame):
        frame = frame.sort_values(["asks", "rep"])
        nodes, queries = frame[~frame["asks"]], frame[frame["asks"]]
        if not len(nodes) or not len(queries):
            return pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64"})
        ids, names = nodes["rep"].to_numpy(), queries["rep"].to_numpy()
        lists = []
        for to in nodes["neighbours"]:
            at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
            lists.append(at[ids[at] == to])
        radius, own = nodes["radius"].to_numpy(), queries["radius"].to_numpy()
        # a ball can hold a link if the centres' angle is at most the threshold's and both radii
        reach = own + radius.max()
        asked = np.where(reach > 0, np.cos(np.minimum(angle + reach, math.pi)) - 1e-12, threshold)
        q, node, sim = range_search(_matrix(nodes["unit"], dim), lists, _matrix(queries["unit"], dim), asked, width)
        both_radii = own[q] + radius[node]
        near = np.where(both_radii > 0, np.arccos(np.clip(sim, -1, 1)) <= angle + both_radii + 1e-9, sim >= threshold)
        a, b = names[q], ids[node]
        keep = near & (a != b)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "sim": sim[keep]})

    pairs = both.groupBy("cell", "slice", "asked_by").applyInPandas(one, "a long, b long, sim double")
    return pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))


def compared(pairs: DataFrame, covered: DataFrame, dim: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links between the vectors of two balls, for each of ``pairs`` (a, b): ``rep, others`` counted, and the pairs that hold a link.

    ``covered``: ``rep, ball, unit, copies``.  A block is a chunk of each ball; only counts leave it.
    """
    chunks = covered.groupBy("ball").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    cut = saved(covered.join(chunks, "ball").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")), "vector-chunks")
    sides = []
    for side, other in (("a", "b"), ("b", "a")):
        counts = chunks.select(F.col("ball").alias(other), F.col("chunks").alias("others"))
        mine = pairs.select("a", "b").join(cut.withColumnRenamed("ball", side), side).join(counts, other)
        across = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
        sides.append(mine.select("a", "b", F.lit(side).alias("side"), F.col("chunk").alias(f"chunk_{side}"), across.alias(f"chunk_{other}"), "rep", "unit", "copies"))
    rows = saved(sides[0].unionByName(sides[1]), "vector-blocks")
    groups = max(1, -(-rows.count() // GROUP_ROWS))
    block = ["a", "b", "chunk_a", "chunk_b"]

    def one(frame):
        out = []
        for (a, b, _, _), part in frame.groupby(block, sort=False):
            x, y = part[part["side"] == "a"], part[part["side"] == "b"]
            if not len(x) or not len(y):
                continue
            linked = _matrix(x["unit"], dim) @ _matrix(y["unit"], dim).T >= threshold
            if linked.any():
                out.append(pd.DataFrame({"a": a, "b": b, "rep": x["rep"], "others": linked @ y["copies"].to_numpy()}))
                out.append(pd.DataFrame({"a": a, "b": b, "rep": y["rep"], "others": x["copies"].to_numpy() @ linked}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("a", "b", "rep", "others")}, dtype="int64")

    found = rows.withColumn("g", F.pmod(F.xxhash64(*block), F.lit(groups))).groupBy("g").applyInPandas(one, "a long, b long, rep long, others long")
    found = saved(found.where("others > 0"), "vector-counts")
    return found.groupBy("rep").agg(F.sum("others").alias("others")), found.select("a", "b").distinct()


def audit(reps: DataFrame, links: DataFrame, dim: int, threshold: float) -> float | None:
    """Mean share of its true links that ``links`` holds, over the linked ones of stated queries; None if none of them has a link.

    ``reps``: ``rep, unit`` and, where vectors are in balls, ``ball``; ``links``
    are pairs (a < b) of balls whose vectors were compared, and a ball holds its
    own links.  Queries are taken from all rows in the order of an id hash, in
    blocks that double, until ``AUDIT_LINKED`` of them have a link or
    ``AUDIT_MOST`` are asked.  Each linked query weighs the same, whatever the
    size of its group.
    """
    spark = reps.sparkSession
    if "ball" not in reps.columns:
        reps = reps.withColumn("ball", F.col("rep"))
    asked = reps.orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(AUDIT_MOST).select("rep", "unit", "ball").toPandas()
    ids, x, home = asked["rep"].to_numpy(), _matrix(asked["unit"], dim), asked["ball"].to_numpy()
    shares, at, upto = [], 0, AUDIT_QUERIES
    while at < len(ids) and len(shares) < AUDIT_LINKED:
        block = spark.sparkContext.broadcast((ids[at:upto], x[at:upto], home[at:upto]))

        def batches(frames, block=block):
            names, queries, homes = block.value
            for frame in frames:
                nodes, vectors, balls = frame["rep"].to_numpy(), _matrix(frame["unit"], dim), frame["ball"].to_numpy()
                for k in range(0, len(queries) if len(nodes) else 0, AUDIT_QUERIES):
                    node, query = np.nonzero(vectors @ queries[k : k + AUDIT_QUERIES].T >= threshold)
                    q, n = names[k + query], nodes[node]
                    true = pd.DataFrame({"query": q, "a": homes[k + query], "b": balls[node]})[q != n]
                    yield true.groupby(["query", "a", "b"], as_index=False).size().rename(columns={"size": "n"})

        true = reps.select("rep", "unit", "ball").mapInPandas(batches, "query long, a long, b long, n long")
        true = true.groupBy("query", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n"))
        held = saved(true, "vector-audit").join(links.select("a", "b", F.lit(1).alias("held")), ["a", "b"], "left")
        got = F.sum(F.when(F.col("held").isNotNull() | (F.col("a") == F.col("b")), F.col("n")).otherwise(0))
        shares += [r[0] for r in held.groupBy("query").agg((got / F.sum("n")).alias("share")).select("share").collect()]
        at, upto = upto, 2 * upto
    return float(np.mean(shares)) if shares else None


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, cell_rows: int = 1024, slice_rows: int = 2048, overlap: int = 2, width: int = 32
) -> DataFrame:
    """``vec_id, n_links, component_id, kept, recall`` per row of ``vectors``.

    ``n_links`` counts the other vectors found with cosine at least
    ``threshold``, ``component_id`` is the smallest id reachable over links,
    ``kept`` marks the row that carries it, ``recall`` is the audited mean share
    of a linked vector's links found, null if no audited vector has a link.  Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, nor do vectors of different lengths or of a
    null id (whose component is null).  Equal vectors are indexed once and
    counted as many.  Repeated rows of one id and vector are one vector,
    reported once per row; an id with several vectors reports the most links and
    the smallest component of them.  Extra columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    units = saved(unit_vectors(rows.distinct()), "vector-units")
    classes = units.groupBy("dim", "unit").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = saved(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")  # numbered once; an id may hold several vectors
    judged = recall = None
    for (dim,) in classes.select("dim").distinct().sort("dim").collect():  # vectors of one length compare among themselves
        found, least = _links(classes.where(F.col("dim") == dim), dim, threshold, cell_rows, slice_rows, overlap, width)
        judged = found if judged is None else judged.unionByName(found)
        recall = min((r for r in (recall, least) if r is not None), default=None)
    if judged is None:
        judged = classes.select("rep", F.lit(0).cast("long").alias("n_links"), F.col("first").alias("component_id"))
    judged = classes.select("rep", "dim", "unit").join(judged, "rep").drop("rep")
    per_id = units.join(judged, ["dim", "unit"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(per_id, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"), F.lit(recall).cast("double").alias("recall"))


def _sliced(near: DataFrame, slice_rows: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``near`` with the slice of its cell, and ``cell, slices``, one row a cell."""
    sizes = saved(near.groupBy("cell").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("slices")), name)
    return near.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")).drop("slices"), sizes


def _covered(reps: DataFrame, centroids: np.ndarray, dim: int, least: float, slice_rows: int) -> DataFrame:
    """``rep, ball, sim``: the ball of every vector and the similarity to its centre."""

    def one(frame):
        frame = frame.sort_values("rep")
        centre, sim = cover(_matrix(frame["unit"], dim), least)
        return pd.DataFrame({"rep": frame["rep"], "ball": frame["rep"].to_numpy()[centre], "sim": sim})

    near, _ = _sliced(saved(assign(reps, centroids, 1), "vector-own"), slice_rows, "vector-own-slices")
    return near.groupBy("cell", "slice").applyInPandas(one, "rep long, ball long, sim double")


def _links(reps: DataFrame, dim: int, threshold: float, cell_rows: int, slice_rows: int, overlap: int, width: int) -> tuple[DataFrame, float | None]:
    """``rep, n_links, component_id`` of every distinct vector, and the audited recall."""
    n = reps.count()
    cells = max(1, math.ceil(min(n / cell_rows, 2 * math.sqrt(n))))
    centroids = fit_cells(reps, cells, dim)
    angle = math.acos(threshold)
    covered = saved(_covered(reps, centroids, dim, math.cos(BALL * angle), slice_rows).join(reps.select("rep", "unit", "copies", "first"), "rep"), "vector-balls")
    # rounding must not make a radius too small
    radius = F.when(F.col("least") >= 1, 0.0).otherwise(F.acos("least") + 1e-7)
    sums = covered.groupBy("ball").agg(F.count("*").alias("size"), F.sum("copies").alias("vectors"), F.min("sim").alias("least"))
    balls = sums.select(F.col("ball").alias("rep"), "size", "vectors", F.when(F.col("size") == 1, 0.0).otherwise(radius).alias("radius"))
    balls = saved(balls.join(reps.select("rep", "unit"), "rep"), "vector-centres")
    while True:
        near = saved(assign(balls, centroids, overlap).join(balls.select("rep", "radius"), "rep"), "vector-cells")
        members, sizes = _sliced(near, slice_rows, "vector-slices")
        graph = saved(build(members, dim), "vector-graph")
        pairs = saved(search(members, graph, balls, sizes, dim, threshold, width), "vector-pairs")
        recall = audit(covered, pairs, dim, threshold)
        if recall is None or recall >= RECALL or (overlap >= cells and width >= n):
            break
        overlap, width = overlap + 1, 2 * width
    about = balls.select("rep", "size", "vectors", "radius")
    for side in ("a", "b"):
        pairs = pairs.join(about.select(F.col("rep").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("size", "vectors", "radius")]), side)
    apart = F.col("radius_a") + F.col("radius_b")
    state = F.when(F.col("size_a") + F.col("size_b") == 2, "linked").when(F.acos(F.least("sim", F.lit(1.0))) + apart <= angle - 1e-7, "linked").otherwise("open")
    pairs = saved(pairs.withColumn("state", state), "vector-states")
    settled = pairs.where("state = 'linked'")
    ends = settled.select(F.col("a").alias("ball"), F.col("vectors_b").alias("n")).unionByName(settled.select(F.col("b").alias("ball"), F.col("vectors_a").alias("n")))
    whole = ends.groupBy("ball").agg(F.sum("n").alias("whole"))
    counted, joined = compared(pairs.where("state = 'open'"), covered.select("rep", "ball", "unit", "copies"), dim, threshold)
    roots = components(settled.select("a", "b").unionByName(joined)).withColumnRenamed("node", "ball")
    judged = covered.select("rep", "ball", "first").join(sums.select("ball", "vectors"), "ball").join(whole, "ball", "left").join(roots, "ball", "left").join(counted, "rep", "left")
    judged = judged.withColumn("root", F.coalesce("component", "ball"))
    smallest = judged.groupBy("root").agg(F.min("first").alias("component_id"))
    links = F.col("vectors") - 1 + F.coalesce("whole", F.lit(0)) + F.coalesce("others", F.lit(0))
    return saved(judged.join(smallest, "root").select("rep", links.alias("n_links"), "component_id"), "vector-judged"), recall
