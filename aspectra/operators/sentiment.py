"""Sentiment (E1–E9): class scores -> labels -> review verdicts.

Model inference is a pluggable column producer (``score_texts`` takes any
Arrow-batched scorer); everything after the logits is Catalyst expressions.
Review votes are decomposable aggregates (counts, integer sums), so a review
holding a third of all aspect rows is pre-aggregated per partition before the
shuffle; verdicts are joined back with AQE's skew-join split available.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.functions.ops import bound, half_up_div, topk

LABELS3 = ["Negative", "Neutral", "Positive"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Logits -> probabilities -> labels
# ---------------------------------------------------------------------------

def softmax(logits) -> Column:
    """Numerically stable softmax of an array column (double precision)."""
    def powers(x):
        return F.zip_with(x, F.array_repeat(F.array_max(x), F.size(x)), lambda v, m: F.exp(v - m))

    def shares(e):
        s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
        return F.zip_with(e, F.array_repeat(s, F.size(e)), lambda v, t: v / t)

    return bound(bound(F.transform(_c(logits), lambda v: v.cast("double")), powers), shares)


def argmax_index(probs) -> Column:
    """0-based index of the FIRST maximum."""
    return bound(_c(probs), lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("long"))


def stars5_label(stars) -> Column:
    """1–2 Negative, 3 Neutral, 4–5 Positive."""
    s = _c(stars)
    return F.when(s <= 2, "Negative").when(s == 3, "Neutral").otherwise("Positive")


def class3_label(idx) -> Column:
    """Class 0/1/2 -> Negative/Neutral/Positive (stars 1/2/3)."""
    i = _c(idx)
    return F.when(i == 0, "Negative").when(i == 1, "Neutral").otherwise("Positive")


def normalize_label(pred_idx, id2label: Mapping[int, str] | None = None,
                    defaults: Sequence[str] = LABELS3) -> tuple[Column, Column]:
    """E5: model label containing 'neg'/'neu'/'pos' (checked in that order) -> the triple
    label; otherwise the default label of the index; otherwise Neutral.  Stars follow
    the label (1/2/3)."""
    i = _c(pred_idx)
    id2label = id2label or {}
    raw = F.lit(None).cast("string")
    for k, v in id2label.items():
        raw = F.when(i == k, F.lit(v)).otherwise(raw)
    dflt = F.lit(None).cast("string")
    for k, v in enumerate(defaults):
        dflt = F.when(i == k, F.lit(v)).otherwise(dflt)
    raw = F.coalesce(raw, dflt, i.cast("string"))
    low = F.lower(F.trim(raw))
    lab = (F.when(low.contains("neg"), "Negative").when(low.contains("neu"), "Neutral")
           .when(low.contains("pos"), "Positive").otherwise(F.coalesce(dflt, F.lit("Neutral"))))
    stars = F.when(lab == "Negative", 1).when(lab == "Neutral", 2).otherwise(3).cast("long")
    return lab, stars


def score_texts(df: DataFrame, text_col: str, scorer: Callable[[pd.Series], pd.DataFrame],
                n_classes: int, out: str = "logits") -> DataFrame:
    """Model scoring hook.  ``scorer`` maps a pandas Series of texts to class logits;
    it runs in Arrow batches inside the executors (loaded once per Python worker by the
    caller's closure)."""
    schema = T.ArrayType(T.DoubleType())

    @F.pandas_udf(schema)
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(np.asarray(scorer(s), dtype="float64")), dtype=object)

    return df.withColumn(out, _score(F.col(text_col)))


# ---------------------------------------------------------------------------
# Review verdicts
# ---------------------------------------------------------------------------

def _milli(c: Column) -> Column:
    return F.round(c * 1000).cast("long")


def vote_majority(aspects: DataFrame, keys: Sequence[str], label_col: str = "label",
                  conf_col: str = "confidence") -> DataFrame:
    """Majority vote with the neutral correction.

    Neutral is ignored when pos+neg >= 0.6*total; a unique winner gets confidence 1.0;
    a Positive/Negative tie is decided by the higher average confidence (that average
    is the confidence; equal averages -> Neutral 0.5); any other tie -> Neutral 0.5.
    Confidences are 3-decimal values, so sums and the average comparison are exact
    integer arithmetic in thousandths.
    """
    lab = F.col(label_col)
    g = aspects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(lab == "Positive").alias("npos"),
        F.count_if(lab == "Negative").alias("nneg"),
        F.count_if(lab == "Neutral").alias("nneu"),
        F.sum(F.when(lab == "Positive", _milli(F.col(conf_col))).otherwise(0)).alias("spos"),
        F.sum(F.when(lab == "Negative", _milli(F.col(conf_col))).otherwise(0)).alias("sneg"),
    )
    npos, nneg, nneu = F.col("npos"), F.col("nneg"), F.col("nneu")
    polar = (npos + nneg) * 5 >= F.col("n") * 3          # pos+neg >= 0.6*total
    mx = F.when(polar, F.greatest(npos, nneg)).otherwise(F.greatest(npos, nneg, nneu))
    wpos, wneg = npos == mx, nneg == mx
    wneu = ~polar & (nneu == mx)
    n_win = wpos.cast("int") + wneg.cast("int") + wneu.cast("int")
    # average comparison spos/npos vs sneg/nneg without division
    lhs, rhs = F.col("spos") * nneg, F.col("sneg") * npos
    avg_pos = half_up_div(F.col("spos"), npos) / 1000.0
    avg_neg = half_up_div(F.col("sneg"), nneg) / 1000.0
    label = (F.when(n_win == 1, F.when(wpos, "Positive").when(wneg, "Negative").otherwise("Neutral"))
             .when(wpos & wneg & ~wneu, F.when(lhs > rhs, "Positive").when(rhs > lhs, "Negative").otherwise("Neutral"))
             .otherwise("Neutral"))
    conf = (F.when(n_win == 1, F.lit(1.0))
            .when(wpos & wneg & ~wneu, F.when(lhs > rhs, avg_pos).when(rhs > lhs, avg_neg).otherwise(0.5))
            .otherwise(0.5))
    return g.select(*keys, F.col("n").alias("n_aspects"), label.alias("review_sentiment"),
                    conf.cast("double").alias("review_confidence"))


def vote_topk(aspects: DataFrame, keys: Sequence[str], order_col: str, k: int = 5, label_col: str = "label",
              conf_col: str = "confidence") -> DataFrame:
    """The k most confident aspects (stable: ties by ``order_col``); the label with the
    largest confidence sum wins (ties: the label met first in that order); confidence is
    the winner's share of the total (0 when the total is 0)."""
    top = topk(aspects, keys, [F.col(conf_col).desc(), F.col(order_col)], k, "_rank", salt_on=[order_col])
    per = top.groupBy(*keys, label_col).agg(
        F.sum(_milli(F.col(conf_col))).alias("w"), F.min("_rank").alias("first"))
    tot = per.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(label_col), F.col("w")), F.struct(F.col("w"), -F.col("first"))).alias("win"),
        F.sum("w").alias("total"))
    conf = F.when(F.col("total") > 0, half_up_div(F.col("win.w") * 1000, F.col("total")) / 1000.0).otherwise(0.0)
    return tot.select(*keys, F.col(f"win.{label_col}").alias("review_sentiment"),
                      conf.cast("double").alias("review_confidence"))


def attach_verdict(aspects: DataFrame, verdicts: DataFrame, keys: Sequence[str], method: str) -> DataFrame:
    """Every aspect row gets its review's verdict (confidence rounded to 3) and the
    aggregation method name.  Null-safe keys: a missing review id groups by text."""
    cond = None
    v = verdicts
    for k in keys:
        v = v.withColumnRenamed(k, f"_v_{k}")
        c = aspects[k].eqNullSafe(v[f"_v_{k}"])
        cond = c if cond is None else cond & c
    j = aspects.join(v, cond, "left")
    return j.drop(*[f"_v_{k}" for k in keys]).withColumn(
        "review_confidence", F.round(F.col("review_confidence"), 3)).withColumn(
        "aggregation_method", F.lit(method))


# ---------------------------------------------------------------------------
# E1 built-in scorer, E6 whole-review sentiment, E10 aspect table
# ---------------------------------------------------------------------------

def lexicon_logits(text, positive, negative, n_classes: int = 5) -> Column:
    """E1 built-in scorer: net = #positive - #negative words (lower-case letter runs),
    clipped to the star range; class k (1-based) gets logit -|net - (k - centre)|, so the
    argmax star is centre + net.  Counting stays inside the row (hash-set lookups)."""
    from aspectra import lexicons as L
    toks = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"\p{L}+"), 0)
    pos = F.size(F.filter(toks, lambda t: L.in_words(t, list(positive))))
    neg = F.size(F.filter(toks, lambda t: L.in_words(t, list(negative))))
    half = (n_classes - 1) // 2
    net = F.least(F.lit(half), F.greatest(F.lit(-half), pos - neg))
    return F.array(*[(-F.abs(net - (k - half))).cast("double") for k in range(n_classes)])


def review_sentiment(df: DataFrame, text_col: str, logits_col: str) -> DataFrame:
    """Blank text -> ('EMPTY', 0.0); else 5-class stars -> NEGATIVE / NEUTRAL / POSITIVE
    with the max probability rounded to 4."""
    p = softmax(logits_col)
    stars = argmax_index(p) + 1
    lab = F.upper(stars5_label(stars))
    blank = F.trim(F.col(text_col)) == ""
    return (df.withColumn("sentiment", F.when(blank, F.lit("EMPTY")).otherwise(lab))
            .withColumn("confidence", F.when(blank, F.lit(0.0)).otherwise(F.round(F.array_max(p), 4))))


def score_aspects(aspects: DataFrame, snippet_col: str, logits_col: str, five_class: bool = True) -> DataFrame:
    """E2–E4 on aspect snippets: Aspect_Sentiment, Confidence_Sentiment (rounded 3), Stars."""
    # columns of their own, read several times, are computed once
    scored = aspects.withColumn("_p", softmax(logits_col)).withColumn("_idx", argmax_index("_p"))
    idx = F.col("_idx")
    lab = stars5_label(idx + 1) if five_class else class3_label(idx)
    return (scored.withColumn("Aspect_Sentiment", lab)
            .withColumn("Confidence_Sentiment", F.round(F.array_max("_p"), 3))
            .withColumn("Stars", (idx + 1).cast("long")).drop("_p", "_idx"))
