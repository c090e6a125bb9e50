"""A trained sentiment scorer (E1): hashed n-gram likelihoods per class, calibrated on held-out texts.

Words and word pairs fall into a fixed number of buckets, so the model is one small matrix whatever
the corpus.  Its counts are one aggregation over the training texts.  Likelihoods of long texts are
far too sure of themselves; a temperature, the one of a grid that makes held-out classes most
likely, turns them into class logits.  The matrix is sent once, and ``score_texts`` runs it in batches.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.operators.sentiment import score_texts

#: Buckets of the hashed n-grams; classes x buckets numbers make the model.
BUCKETS = 1 << 16
#: Words of a text that are read, as the scored model reads so many.
MAX_WORDS = 256
TEMPERATURES = tuple(float(2**k) for k in range(10))
#: One text in so many is held out of the counts and calibrates.
HELD_OUT = 5


class Model(NamedTuple):
    #: log likelihood of each bucket (rows) in each class, the class priors, and the temperature
    weights: np.ndarray
    prior: np.ndarray
    temperature: float


def words(text: Column) -> Column:
    return F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), 1, MAX_WORDS)


def grams(text: Column) -> Column:
    """Words, then pairs of neighbouring words."""
    w = words(text)
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(w, pairs)


def bucket(gram: Column) -> Column:
    return F.conv(F.substring(F.md5(gram.cast("binary")), 1, 8), 16, 10).cast("long") % BUCKETS


def held_out(text: Column) -> Column:
    """Equal texts lie on one side."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 9, 8), 16, 10).cast("long") % HELD_OUT == 0


def _log_likelihoods(counts: np.ndarray, smooth: float) -> np.ndarray:
    return np.log((counts + smooth) / (counts.sum(axis=0) + smooth * len(counts)))


def train(rows: DataFrame, text_col: str, class_col: str, n_classes: int, smooth: float = 0.1) -> Model:
    """``rows``: labelled texts, classes 0 to ``n_classes`` - 1; null texts and classes are left out.
    Classes without a training text get the smallest prior there is; without held-out texts the temperature is 1."""
    spark = rows.sparkSession
    known = rows.select(F.col(text_col).alias("text"), F.col(class_col).cast("int").alias("y")).dropna().where(F.col("y").between(0, n_classes - 1))
    learn = known.where(~held_out(F.col("text")))
    counted = learn.select("y", F.explode(grams(F.col("text"))).alias("g")).groupBy(bucket(F.col("g")).alias("bucket"), "y").agg(F.count(F.lit(1)).alias("n"))
    table = counted.toPandas()  # buckets x classes rows at most
    counts = np.zeros((BUCKETS, n_classes))
    counts[table["bucket"], table["y"]] = table["n"]
    per = learn.groupBy("y").count().toPandas()  # one row a class
    n = np.full(n_classes, 0.5)
    n[per["y"]] = per["count"]
    model = Model(_log_likelihoods(counts, smooth), np.log(n / n.sum()), 1.0)
    scored = score_texts(known.where(held_out(F.col("text"))), "text", scorer(spark, model), n_classes, "raw")

    def loss(t):
        x = F.transform("raw", lambda v: v / t)
        top = F.array_max(x)
        total = F.aggregate(F.zip_with(x, F.array_repeat(top, F.size(x)), lambda v, m: F.exp(v - m)), F.lit(0.0), lambda acc, v: acc + v)
        return F.sum(F.log(total) + top - F.get(x, F.col("y")))

    losses = scored.agg(*[loss(t) for t in TEMPERATURES]).first()
    if losses[0] is None:
        return model
    return model._replace(temperature=min(zip(losses, TEMPERATURES, strict=True))[1])




def scorer(spark, model: Model):
    """A function of ``score_texts``: texts to calibrated class logits; a null text has the priors."""
    shared = spark.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> np.ndarray:
        return logits(shared.value, texts)

    return score


def logits(model: Model, texts) -> np.ndarray:
    """Grams are looked up once a batch; the weights of all texts are summed together."""
    import regex

    runs = regex.compile(r"\p{L}+")
    word_at: dict[str, int] = {}
    pair_at: dict[tuple[str, str], int] = {}

    def place(gram: str) -> int:
        return int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % BUCKETS

    at, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        w = runs.findall((text or "").lower())[:MAX_WORDS]
        for a in w:
            b = word_at.get(a)
            if b is None:
                b = word_at[a] = place(a)
            at.append(b)
        for pair in zip(w, w[1:], strict=False):
            b = pair_at.get(pair)
            if b is None:
                b = pair_at[pair] = place(" ".join(pair))
            at.append(b)
        sizes[i] = 2 * len(w) - 1 if w else 0
    out = np.tile(model.prior, (len(texts), 1))
    some = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[some])
    step = 1 << 16  # texts' grams weighed at once
    first = 0
    while first < len(some):
        start = ends[first] - sizes[some[first]]
        last = max(first + 1, int(np.searchsorted(ends, start + step, side="right")))
        part = model.weights[at[start:ends[last - 1]]]
        out[some[first:last]] += np.add.reduceat(part, (ends - sizes[some])[first:last] - start, axis=0)
        first = last
    return out / model.temperature
