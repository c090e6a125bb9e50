"""The trained scorer: accuracy on held-out texts, calibration, and logits against a plain model."""

import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from aspectra.operators import sentiment as E
from aspectra.operators import textmodel as TM

WORDS = ["awful dirty rude broken", "plain average usual fine", "lovely clean kind superb"]


def rows(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        y = int(rng.integers(3))
        own = [WORDS[y if rng.random() < 0.75 else int(rng.integers(3))].split()[rng.integers(4)] for _ in range(rng.integers(2, 8))]
        common = [f"w{k}" for k in rng.choice(list("abcdefgh"), 6)]
        out.append((" ".join(rng.permutation([*own, *common])), y))
    return out


def test_held_out_accuracy_and_calibration(spark):
    train, test = rows(900, 1), rows(400, 2)
    model = TM.train(spark.createDataFrame(train + [(None, 1), ("no class", None), ("out of range", 7)], "text string, y int"), "text", "y", 3)
    scored = E.score_texts(spark.createDataFrame(test, "text string, y int"), "text", TM.scorer(spark, model), 3)
    got = scored.select("y", E.softmax("logits").alias("p")).collect()
    p = np.array([r.p for r in got])
    right = p.argmax(axis=1) == np.array([r.y for r in got])
    assert right.mean() > 0.85
    # what it is sure of is right about so often
    assert abs(p.max(axis=1).mean() - right.mean()) < 0.08


def test_logits_match_a_plain_model(spark):
    train = rows(60, 3)
    model = TM.train(spark.createDataFrame(train, "text string, y int"), "text", "y", 3)

    def grams(text):
        w = text.lower().split()[: TM.MAX_WORDS]
        return [*w, *map(" ".join, zip(w, w[1:]))]

    def place(g):
        return int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % TM.BUCKETS

    learn = [(t, y) for t, y in train if int(hashlib.md5(t.encode()).hexdigest()[8:16], 16) % TM.HELD_OUT]
    counts = [Counter(place(g) for t, y in learn if y == k for g in grams(t)) for k in range(3)]
    prior = Counter(y for _, y in learn)
    text = train[0][0] + " unseen words"
    want = []
    for k in range(3):
        total = math.log(prior[k] / len(learn))
        total += sum(math.log((counts[k][place(g)] + 0.1) / (counts[k].total() + 0.1 * TM.BUCKETS)) for g in grams(text))
        want.append(total / model.temperature)
    assert np.allclose(TM.logits(model, [text])[0], want)
    long = " ".join(["awful"] * TM.MAX_WORDS)
    assert np.allclose(*TM.logits(model, [long, long + " lovely superb"]))
    assert np.allclose(TM.logits(model, [None, ""]), model.prior / model.temperature)


def test_training_without_rows(spark):
    model = TM.train(spark.createDataFrame([], "text string, y int"), "text", "y", 2)
    assert model.temperature == 1.0 and np.allclose(TM.logits(model, ["any"])[0], TM.logits(model, ["any"])[0][0])
