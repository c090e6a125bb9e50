"""Trained vectors: counts against plain loops, eigenvectors against a dense solver, planted synonyms."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.operators import cooccurrence as W


def counts_of(texts, window, least):
    seen = Counter(w for t in texts for w in (t or "").lower().split())
    out = Counter()
    for t in texts:
        words = (t or "").lower().split()
        for i, a in enumerate(words):
            for b in words[i + 1 : i + 1 + window]:
                if seen[a] >= least and seen[b] >= least:
                    out[min(a, b), max(a, b)] += 1
    return out


def dense(counts):
    words = sorted({w for p in counts for w in p})
    m = np.zeros((len(words), len(words)))
    for (a, b), n in counts.items():
        i, j = words.index(a), words.index(b)
        m[i, j] += n
        m[j, i] += n
    row = m.sum(axis=1)
    with np.errstate(divide="ignore"):
        return words, np.maximum(np.log(m * m.sum() / row[:, None] / row[None, :]), 0)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    return [" ".join(f"w{chr(97 + k)}" for k in rng.integers(0, 12, rng.integers(0, 9))) for _ in range(60)] + [None, "", "Wa wA wa"]


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)


def test_counts_and_information(spark, texts):
    docs = frame(spark, texts)
    want = counts_of(texts, 3, 4)
    counts = W.cooccurrences(docs, "text", 3, 4)
    assert {(r.a, r.b): r.n for r in counts.collect()} == want
    words, m = dense(want)
    got = {(r.a, r.b): r.v for r in W.ppmi(counts).collect()}
    assert got == {(words[i], words[j]): pytest.approx(m[i, j]) for i, j in zip(*np.nonzero(m > 1e-12))}


def test_vectors_span_the_leading_eigenvectors(spark, texts):
    words, m = dense(counts_of(texts, 4, 5))
    got = {r.word: r.vector for r in W.train_vectors(frame(spark, texts), dim=6).collect()}
    x = np.array([got[w] for w in words])
    value, u = np.linalg.eigh(m)
    top = np.argsort(-np.abs(value))[:6]
    # the block is as wide as the matrix here, so the products agree but for rounding
    assert np.allclose(x @ x.T, (u[:, top] * np.abs(value[top])) @ u[:, top].T, atol=1e-6)
    again = {r.word: r.vector for r in W.train_vectors(frame(spark, texts, 5), dim=6).collect()}
    assert all(np.allclose(got[w], again[w], atol=1e-6) for w in words)


def test_products_send_rows_to_cells_not_to_entries(spark, texts, monkeypatch):
    """Few partial sums per word, however many entries it has; the same vectors from one cell and from many."""
    whole = {r.word: r.vector for r in W.train_vectors(frame(spark, texts), dim=6).collect()}
    monkeypatch.setattr(W, "CELL_ENTRIES", 12, raising=False)
    words, m = dense(counts_of(texts, 4, 5))
    cut = {r.word: r.vector for r in W.train_vectors(frame(spark, texts), dim=6).collect()}
    assert set(cut) == set(words) and all(np.allclose(whole[w], cut[w], atol=1e-6) for w in words)
    cells = W._cut(W.ppmi(W.cooccurrences(frame(spark, texts), "text", 4, 5)))
    rows = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate(words)], "word string, row array<double>")
    got = {r.word: r.row for r in W._times(cells, rows, 2).collect()}
    want = m @ np.array([[i, 1.0] for i in range(len(words))])
    assert cells.select("across", "down").distinct().count() > 4
    assert all(np.allclose(got[w], want[i]) for i, w in enumerate(words) if w in got) and len(got) == (m > 0).any(axis=1).sum()


@pytest.mark.parametrize("bounds", [(0, 4), (1 << 20, 3)])
def test_counts_of_large_vocabularies_and_of_many_pairs(spark, texts, monkeypatch, bounds):
    monkeypatch.setattr(W.ops, "BROADCAST_ROWS", bounds[0])
    monkeypatch.setattr(W, "PAIRS", bounds[1])
    got = {(r.a, r.b): r.n for r in W.cooccurrences(frame(spark, texts), "text", 3, 4).collect()}
    assert got == counts_of(texts, 3, 4)


def test_planted_synonyms_are_neighbours(spark):
    rng = np.random.default_rng(2)
    topics = [[f"t{chr(97 + i)}{chr(97 + k)}" for k in range(6)] for i in range(12)]
    rows = []
    for i, topic in enumerate(topics):
        name = chr(97 + i)
        for _ in range(40):
            rows.append(" ".join([*rng.choice(topic, 3), ("same" if rng.random() < 0.5 else "like") + name, *rng.choice(topic, 3), *rng.choice(["the", "of", "and"], 2)]))
    vectors = W.train_vectors(frame(spark, rows), dim=16)
    got = {r.word: np.array(r.vector) for r in vectors.collect()}
    unit = {w: v / np.linalg.norm(v) for w, v in got.items()}
    planted = [w for w in unit if w.startswith(("same", "like"))]
    right = 0
    for w in planted:
        other = max((p for p in planted if p != w), key=lambda p: unit[w] @ unit[p])
        right += other[4:] == w[4:]
    assert len(planted) == 24 and right >= 23
    phrases = spark.createDataFrame([("Same a",), ("samea",), ("likea",), ("unknownword",), (None,)], "phrase string")
    known = {r.phrase: r.vector for r in W.encode_phrases(phrases, "phrase", vectors).collect()}
    assert known["unknownword"] is None and known[None] is None
    assert np.allclose(np.linalg.norm(known["samea"]), 1) and np.dot(known["samea"], known["likea"]) > 0.8


def test_no_words(spark):
    for texts in ([], [None, "", "one"]):
        assert W.train_vectors(frame(spark, texts), dim=4).collect() == []


def test_a_task_returns_few_counts_at_once(spark, texts, monkeypatch):
    """What a task counted leaves in small frames, none of which holds a share of the table; the same counts."""
    monkeypatch.setattr(W, "RETURNED", 2)
    monkeypatch.setattr(W, "PAIRS", 3)
    seen, one = [], W.saved
    monkeypatch.setattr(W, "saved", lambda df, name: seen.append((name, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or one(df, name))
    got = {(r.a, r.b): r.n for r in W.cooccurrences(frame(spark, texts), "text", 3, 4).collect()}
    assert got == counts_of(texts, 3, 4) and ("cooc-counts", "500") in seen


def test_words_of_a_cell_are_sorted_once(spark, texts, monkeypatch):
    """A cell is one row of packed entries; products read no words per entry."""
    monkeypatch.setattr(W, "CELL_ENTRIES", 12)
    entries = W.ppmi(W.cooccurrences(frame(spark, texts), "text", 4, 5))
    cells = W._cut(entries).collect()
    assert len(cells) == len({(c.across, c.down) for c in cells})
    got = {(c.a[i], c.b[j]): v for c in cells for i, j, v in zip(np.frombuffer(c.rows, np.int32), np.frombuffer(c.columns, np.int32), np.frombuffer(c.v))}
    assert got == {(r.a, r.b): r.v for r in entries.collect()}
