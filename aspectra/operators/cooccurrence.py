"""Trained word and phrase vectors (V1): co-occurrence, positive pointwise mutual information, randomised eigenvectors.

Words that stand within a window of each other are counted by one aggregation, which tasks prepare
by counting pairs of frequent words as numbers.  The PPMI matrix stays a table of its entries.  Its
leading eigenvectors come from a randomised range finder: the matrix is multiplied by a random block
whose rows follow from a hash of the word, then some times by its own result.  For a product the
matrix is cut into square cells by hashes of both words; a row of the factor travels to the cells of
its word's column, a cell sends one partial sum per word.  Only square matrices as wide as the block
meet on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.functions import ops
from aspectra.functions.ops import saved, sent_if_small, small_batches
from aspectra.operators.vectors import l2_normalize

#: Columns of the random block beyond the wanted dimensions, and multiplications after the first.
SPARE, ROUNDS = 10, 3
ROWS = "word string, row array<double>"
#: Entries of a cell of the matrix on average, entries multiplied at once, pairs of words that a task counts together, and counts it returns at once.
CELL_ENTRIES, MULTIPLIED, PAIRS, RETURNED = 1 << 20, 1 << 14, 1 << 20, 1 << 16


def word_tokens(text):
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def cooccurrences(docs: DataFrame, text_col: str = "text", window: int = 4, min_count: int = 5) -> DataFrame:
    """``a, b, n`` (a <= b): how often two words stand at most ``window`` words apart in a text, both of
    them words of at least ``min_count`` occurrences.  A null text has no words."""
    toks = docs.select(F.coalesce(word_tokens(F.col(text_col)), F.array().cast("array<string>")).alias("w"))
    vocab = toks.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    vocab = saved(vocab.select("word"), "cooc-vocabulary")
    if vocab.limit(ops.BROADCAST_ROWS + 1).count() <= ops.BROADCAST_ROWS:
        return _counted(toks, vocab, window)
    # the later words of each window, whole arrays shifted against each other
    pairs = None
    for k in range(1, window + 1):
        shifted = F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - k, F.lit(0))).alias("a"), F.slice("w", F.lit(1 + k), F.size("w")).alias("b"))
        pairs = shifted if pairs is None else F.concat(pairs, shifted)
    each = toks.select(F.inline(pairs))
    counted = each.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return saved(counted.join(vocab.withColumnRenamed("word", "a"), "a").join(vocab.withColumnRenamed("word", "b"), "b").select("a", "b", "n"), "cooc-counts")


def _counted(toks: DataFrame, vocab: DataFrame, window: int) -> DataFrame:
    """The same by numbers: words get their place in the sorted vocabulary (at most ``BROADCAST_ROWS`` words), tasks count pairs of places."""
    words = vocab.orderBy("word").toPandas()["word"].tolist()
    shared = toks.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def batches(frames):
        place = shared.value
        keys, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        fresh, waiting = [], 0

        def merged():
            found, held = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (keys[:0], n[:0])
            both, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
            return both, np.bincount(at, weights=np.concatenate([n, held]), minlength=len(both)).astype(np.int64)

        def tables():
            for at in range(0, len(keys), RETURNED):
                key = keys[at : at + RETURNED]
                yield pd.DataFrame({"a": key // len(place), "b": key % len(place), "n": n[at : at + RETURNED]})

        for frame in frames:
            for text in frame["w"]:
                at = np.fromiter((place.get(w, -1) for w in text), dtype=np.int64, count=len(text))
                for k in range(1, min(window, len(at) - 1) + 1):
                    left, right = at[:-k], at[k:]
                    both = (left >= 0) & (right >= 0)
                    left, right = left[both], right[both]
                    fresh.append(np.minimum(left, right) * len(place) + np.maximum(left, right))
                    waiting += len(left)
                if waiting >= PAIRS:
                    keys, n = merged()
                    fresh, waiting = [], 0
                    if len(keys) >= PAIRS:
                        yield from tables()
                        keys, n = keys[:0], n[:0]
        keys, n = merged()
        yield from tables()

    found = toks.select("w").mapInPandas(batches, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    with small_batches(toks.sparkSession):  # texts come as lists of words
        found = saved(found, "cooc-counts")
    names = toks.sparkSession.createDataFrame(pd.DataFrame({"at": np.arange(len(words)), "word": np.array(words, dtype=object)}), "at long, word string")
    first, second = (names.select(F.col("at").alias(c), F.col("word").alias(f"word_{c}")) for c in "ab")
    found = found.join(F.broadcast(first), "a").join(F.broadcast(second), "b")  # BROADCAST_ROWS at most
    return found.select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), "n")


def ppmi(counts: DataFrame) -> DataFrame:
    """``a, b, v``: the positive entries of the symmetric matrix ln(n_ab N / (n_a n_b)), both ways round.

    A word's ``n_a`` sums its row, in which a word beside itself counts twice.  ``counts`` are read twice: ``cooccurrences`` has saved them."""
    other = counts.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    both = counts.select("a", "b", F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")).alias("n")).unionByName(other)
    words = saved(both.groupBy("a").agg(F.sum("n").alias("na")), "cooc-words")
    per = sent_if_small(words)
    of_b = sent_if_small(words.select(F.col("a").alias("b"), F.col("na").alias("nb")))
    total = words.agg(F.sum("na").alias("total"))  # one row
    v = F.log(F.col("n").cast("double") * F.col("total") / F.col("na") / F.col("nb"))
    entries = both.join(per, "a").join(of_b, "b").crossJoin(F.broadcast(total))
    return entries.select("a", "b", v.alias("v")).where("v > 0")


def _signs(words, width: int) -> np.ndarray:
    """A row of +1 and -1 per word that follows from its hash alone."""
    seeds = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    bits = [np.random.default_rng(int(s)).integers(0, 2, width) for s in seeds]
    return 2.0 * np.array(bits).reshape(len(words), width) - 1.0


def _summed(width: int):
    """mapInPandas body over partial sums that share a partition by ``word``: adds them per word."""

    def batches(frames):
        place, sums = {}, np.zeros((0, width))
        for frame in frames:
            code, words = pd.factorize(frame["word"])
            at = np.array([place.setdefault(w, len(place)) for w in words], dtype=np.int64)
            if len(place) > len(sums):
                sums = np.concatenate([sums, np.zeros((max(len(place) - len(sums), len(sums)), width))])
            if len(frame):
                np.add.at(sums, at[code], np.stack(frame["row"].to_numpy()))
        yield pd.DataFrame({"word": list(place), "row": list(sums[: len(place)])})

    return batches


def _cut(entries: DataFrame) -> DataFrame:
    """The matrix as cells (``across``, ``down``), saved: a cell's words (``a``, ``b``, sorted) and, by ``a`` then ``b``,
    its entries as bytes: the places of both words among them and the value.  Words are sorted once, not for every product."""
    side = math.ceil(math.sqrt(max(1, entries.count()) / CELL_ENTRIES))

    def packed(frame):
        a, names = pd.factorize(frame["a"], sort=True)
        b, words = pd.factorize(frame["b"], sort=True)
        order = np.lexsort((b, a))
        rows, columns, v = (x[order].astype(kind).tobytes() for x, kind in ((a, np.int32), (b, np.int32), (frame["v"].to_numpy(), np.float64)))
        return pd.DataFrame({"across": frame["across"].iloc[:1], "down": frame["down"].iloc[:1], "side": [side], "a": [list(names)], "b": [list(words)], "rows": [rows], "columns": [columns], "v": [v]})

    cells = entries.select("a", "b", "v", _cell("b", side).alias("across"), _cell("a", side).alias("down")).groupBy("across", "down")
    schema = "across int, down int, side int, a array<string>, b array<string>, rows binary, columns binary, v binary"
    return saved(cells.applyInPandas(packed, schema), "cooc-cells")


def _cell(word: str, side):
    return F.pmod(F.xxhash64(word), F.lit(side)).cast("int")


def _product(cell, known: np.ndarray | None, rows: np.ndarray, width: int) -> pd.DataFrame:
    """Sums of a cell's entries times the rows of their ``b``, per ``a``; ``known``: which ``b`` have a row (None: all)."""
    a, b, v = np.frombuffer(cell["rows"], dtype=np.int32), np.frombuffer(cell["columns"], dtype=np.int32), np.frombuffer(cell["v"])
    names = np.array(cell["a"], dtype=object)
    if known is not None and not known.all():
        held = known[b]
        a, b, v = a[held], b[held], v[held]
    sums = np.zeros((len(names), width))
    for k in range(0, len(a), MULTIPLIED):
        own = a[k : k + MULTIPLIED]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[starts]] += np.add.reduceat(v[k : k + MULTIPLIED, None] * rows[b[k : k + MULTIPLIED]], starts, axis=0)
    met = np.unique(a)
    return pd.DataFrame({"word": names[met], "part": np.full(len(met), cell["across"], dtype=np.int32), "row": list(sums[met])})


def _times(cells: DataFrame, rows: DataFrame | None, width: int) -> DataFrame:
    """The matrix (``cells`` of ``_cut``) times ``rows`` (``word, row``), or times the random block."""
    schema = "word string, part int, row array<double>"
    if rows is None:
        def drawn(frame):
            cell = frame.iloc[0]
            return _product(cell, None, _signs(cell["b"], width), width)

        parts = cells.groupBy("across", "down").applyInPandas(drawn, schema)
    else:
        def multiplied(frame, held):
            if not len(frame) or not len(held):
                return pd.DataFrame({"word": [], "part": [], "row": []}).astype({"word": object, "part": "int32", "row": object})
            cell = frame.iloc[0]
            at = pd.Index(held["word"]).get_indexer(pd.Index(cell["b"], dtype=object))
            return _product(cell, at >= 0, np.stack(held["row"].to_numpy())[np.maximum(at, 0)], width)

        first = cells.select("side").limit(1).collect()
        side = first[0]["side"] if first else 1
        down = F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("down")
        sent = rows.select("word", "row", _cell("word", side).alias("across"), down)
        parts = cells.groupBy("across", "down").cogroup(sent.groupBy("across", "down")).applyInPandas(multiplied, schema)
    return parts.repartition("word").sortWithinPartitions("word", "part").mapInPandas(_summed(width), ROWS)


def _gram(left: DataFrame, width: int) -> np.ndarray:
    """Sum of outer products of the columns ``x`` and ``y``: one square matrix a task, added in task order."""

    def batches(frames):
        total = np.zeros((width, width))
        for frame in frames:
            if len(frame):
                total += np.stack(frame["x"].to_numpy()).T @ np.stack(frame["y"].to_numpy())
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "m": [total.tobytes()]})

    parts = left.mapInPandas(batches, "part int, m binary").sort("part").toLocalIterator()
    return sum((np.frombuffer(r["m"]).reshape(width, width) for r in parts), np.zeros((width, width)))


def _turned(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    def batches(frames):
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"word": frame["word"], "row": list(np.stack(frame["row"].to_numpy()) @ matrix)})

    return rows.mapInPandas(batches, ROWS)


def _fixed_signs(u: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive: an eigenvector's sign is arbitrary."""
    return u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)


def _orthonormal(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    gram = _gram(rows.select(F.col("row").alias("x"), F.col("row").alias("y")), width)
    value, u = np.linalg.eigh(gram)
    keep = value > 1e-12 * max(float(value[-1]), 1e-300) if len(value) else value > 0
    turn = _fixed_signs(u[:, keep]) / np.sqrt(value[keep]) if keep.any() else np.zeros((width, 0))
    return saved(_turned(rows, turn), "cooc-basis"), int(keep.sum())


def train_vectors(docs: DataFrame, text_col: str = "text", dim: int = 64, window: int = 4, min_count: int = 5) -> DataFrame:
    """V1, trained: ``word, vector`` (``dim`` doubles, padded by zeros) of the words of at least
    ``min_count`` occurrences that have a positive entry; the same table gives the same vectors up to
    rounding, whatever its partitions.  The vector is the word's row of the leading eigenvectors, each
    weighted by the root of its eigenvalue's size."""
    entries = _cut(saved(ppmi(cooccurrences(docs, text_col, window, min_count)), "cooc-ppmi"))
    width = dim + SPARE
    basis, held = _orthonormal(saved(_times(entries, None, width), "cooc-range"), width)
    if not held:
        return entries.select(F.explode("a").alias("word"), F.array_repeat(F.lit(0.0), dim).alias("vector")).limit(0)
    for _ in range(ROUNDS):
        basis, held = _orthonormal(saved(_times(entries, basis, held), "cooc-range"), held)
    image = saved(_times(entries, basis, held), "cooc-image")
    small = _gram(basis.select("word", F.col("row").alias("x")).join(image.select("word", F.col("row").alias("y")), "word").select("x", "y"), held)
    value, u = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(value), kind="stable")[:dim]
    turn = _fixed_signs(u[:, order]) * np.sqrt(np.abs(value[order]))
    turn = np.concatenate([turn, np.zeros((held, dim - turn.shape[1]))], axis=1)
    return saved(_turned(basis, turn).withColumnRenamed("row", "vector"), "cooc-vectors")


def encode_phrases(phrases: DataFrame, phrase_col: str, vectors: DataFrame, out: str = "vector") -> DataFrame:
    """``phrase, out``: per distinct phrase the normalised sum of its words' unit vectors; null if none is known."""
    unit = vectors.select("word", l2_normalize("vector").alias("_u"))
    known = phrases.select(phrase_col).distinct()
    words = known.select(phrase_col, F.explode(word_tokens(F.col(phrase_col))).alias("word")).groupBy(phrase_col, "word").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    each = words.join(unit, "word").select(phrase_col, F.struct("word", "_n", "_u").alias("_w"))
    listed = each.groupBy(phrase_col).agg(F.array_sort(F.collect_list("_w")).alias("_all"))  # the words of one phrase
    first = F.transform(F.col("_all")[0]["_u"], lambda x: x * 0.0)
    total = F.aggregate("_all", first, lambda acc, w: F.zip_with(acc, F.transform(w["_u"], lambda x: x * w["_n"]), lambda a, b: a + b))
    return known.join(listed.select(phrase_col, l2_normalize(total).alias(out)), phrase_col, "left")
