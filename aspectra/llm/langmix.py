"""Language identification by multilingual mixture inference.

Learning counts the character n-grams of every labelled training document per
language (one combined sum per language and hashed n-gram).  A document is then
a mixture: every word is drawn from one of its languages, with probability by
the words' n-grams, and expectation-maximisation estimates the proportions.
The set of languages grows one by one while the likelihood gains more than a
penalty per language; the prediction is the set's largest proportion.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.llm.common import saved

#: n-grams are hashed to so many buckets, which bounds the model whatever the texts hold.
BUCKETS = 1 << 16
#: n-gram lengths; a word is padded by one space at either end.
SIZES = (1, 2, 3)
#: Characters worked on at once; bounds the memory of a batch or a very long text.
CHUNK = 1 << 20
#: Model tables of more languages than this are refused: the model is sent to all executors.
MAX_LANGUAGES = 100


#: Letter tests by code point of the basic plane; others are asked one by one.
_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


def code_points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, other than letters as spaces, runs of spaces as one, padded by a space at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _LETTER[np.minimum(points, 0xFFFF)]
    beyond = np.flatnonzero(points > 0xFFFF)
    if len(beyond):
        letter = letter.copy()
        letter[beyond] = [chr(p).isalpha() for p in points[beyond]]
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    return points[keep]


def grams(points: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the ``size``-gram that starts at each position; those of several lengths share the buckets."""
    h = np.full(len(points) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = (h ^ points[i : len(points) - size + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(24)).astype(np.int64) & (BUCKETS - 1)


def count_grams(rows: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows of ``text, lang``."""

    def batches(frames):
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                counts = np.zeros(BUCKETS, dtype=np.int64)
                for text in texts:
                    points = code_points(text)
                    for size in SIZES:
                        if len(points) >= size:
                            # large texts count densely, small ones by their own grams
                            b = grams(points, size)
                            if len(b) > BUCKETS:
                                counts += np.bincount(b, minlength=BUCKETS)
                            else:
                                np.add.at(counts, b, 1)
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": counts[at]})

    return rows.mapInPandas(batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of buckets per language, smoothed by a constant."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp

    @staticmethod
    def of_counts(langs: list[str], counts: np.ndarray, smoothing: float = 0.1) -> "Model":
        p = counts + smoothing
        return Model(langs, np.ascontiguousarray(np.log(p / p.sum(axis=1, keepdims=True)).T.astype(np.float32)))

    def words(self, points: np.ndarray) -> np.ndarray:
        """Log likelihood of each word (row) under each language: the mean over n-gram lengths, so that lengths don't count twice."""
        at = np.flatnonzero(points == 32)  # a word is its leading space and its letters
        out = []
        first = 0
        while first < len(at) - 1:
            last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK)) - 1)
            ahead = max(SIZES) - 1  # n-grams of the last word reach into the next one
            part = points[at[first] : at[last] + 1 + ahead]
            total = np.zeros((len(part), len(self.langs)))
            for size in SIZES:
                if len(part) >= size:
                    total[: len(part) - size + 1] += self.logp[grams(part, size)]
            out.append(np.add.reduceat(total[: at[last] - at[first]], at[first:last] - at[first], axis=0) / len(SIZES))
            first = last
        return np.concatenate(out)


def mixture(loglik: np.ndarray, rounds: int = 30, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Proportions of the columns' languages over the rows' words, and the log likelihood."""
    top = loglik.max(axis=1, keepdims=True)
    like = np.exp(loglik - top)
    theta = np.full(loglik.shape[1], 1 / loglik.shape[1])
    for _ in range(rounds):
        joint = like * theta
        new = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        done = np.abs(new - theta).max() < tolerance
        theta = new
        if done:
            break
    return theta, float(np.log((like * theta).sum(axis=1)).sum() + top.sum())


def infer(loglik: np.ndarray, penalty: float = 3.0) -> dict[int, float]:
    """The chosen languages and their proportions: languages join while each adds more than ``penalty`` * log(words) to the likelihood."""
    n = len(loglik)
    single = loglik.sum(axis=0)
    chosen = [int(np.argmax(single))]
    theta, best = np.ones(1), float(single[chosen[0]])
    cost = penalty * np.log(n + 1)
    while len(chosen) < loglik.shape[1]:
        # the language that explains the words best which the chosen ones explain worst
        have = loglik[:, chosen].max(axis=1)
        gain = np.maximum(loglik - have[:, None], 0).sum(axis=0)
        gain[chosen] = -1
        candidate = int(np.argmax(gain))
        if gain[candidate] + have.sum() - best <= cost:  # an upper bound of what it can add
            break
        tried, likelihood = mixture(loglik[:, [*chosen, candidate]])
        if likelihood - best <= cost:
            break
        chosen.append(candidate)
        theta, best = tried, likelihood
    return dict(zip(chosen, theta.tolist(), strict=True))


def held_out(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is kept from learning, by the checksum of its id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Counts all rows with a language and a text; None if there is none."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = saved(count_grams(rows), "language-grams")
    langs = [r.lang for r in counted.select("lang").distinct().sort("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not langs:
        return None
    table = counted.toPandas()  # at most BUCKETS rows a language
    counts = np.zeros((len(langs), BUCKETS))
    counts[pd.Categorical(table["lang"], langs).codes, table["bucket"]] = table["n"]
    return Model.of_counts(langs, counts)


def mixture_of(spark: SparkSession, model: Model | None, unknown: str = "und"):
    """A column function of a text: a struct of ``lang_pred, score, languages``; see ``predict``."""
    shared = spark.sparkContext.broadcast(model and (model.langs, model.logp))  # languages * BUCKETS numbers

    @F.pandas_udf("lang_pred string, score double, languages map<string,double>")
    def infer_texts(texts: pd.Series) -> pd.DataFrame:
        m = shared.value and Model(*shared.value)
        pred, score, langs = [], [], []
        for text in texts:
            points = code_points(text or "")
            if m is None or (points == 32).all():
                pred.append(unknown), score.append(0.0), langs.append({})
                continue
            found = infer(m.words(points))
            best = max(found, key=lambda k: (found[k], -k))
            pred.append(m.langs[best]), score.append(min(1.0, found[best])), langs.append({m.langs[k]: v for k, v in found.items()})
        return pd.DataFrame({"lang_pred": pred, "score": score, "languages": langs})

    return infer_texts


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` per row of ``docs``.

    ``languages`` maps the chosen languages to their proportions, ``lang_pred``
    is the largest (ties: the first by name) and ``score`` its proportion.  A
    text that is null or without letters, or any text without a model, is
    ``und`` with score 0.  Null ids and repeated rows are judged like any other
    row; extra columns are ignored.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), mixture_of(docs.sparkSession, model)(F.col(text_col)).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.languages")


def recognised(docs: DataFrame, least_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (the columns of documents) whose largest language holds at least ``least_share`` of the words."""
    model = train(docs.where(~held_out("doc_id")))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = docs.select(whole, mixture_of(docs.sparkSession, model)(F.col("text")).alias("found"))
    kept = found.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= least_share))
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the documents that are not held out and predicts all; see ``predict``."""
    return predict(docs, train(docs.where(~held_out(id_col)), text_col, lang_col), id_col, text_col)
