"""URL filter: fixed host and path rules, and a character language-model ratio for the rest.

Two variable-order Markov models, of the URLs that rules accept and of those
they reject, give every character its probability after the longest context
seen, blended down to shorter ones (Witten-Bell).  A URL's score is the
difference of their log likelihoods per character; it passes above a threshold
calibrated on rule-judged URLs the models have not seen.  Counts come from all
URLs; column expressions and joins only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import saved, sent_if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stand before and after a URL's characters.
BEGIN, END = "\x02", "\x03"
#: Probability of a character that no model has seen.
UNSEEN = 1 / 65536
#: Log ratios are summed as whole numbers of this size, so that no order of summing matters.
UNIT = 1e-6


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The fixed rules.
RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judged_by_rules(urls: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """Adds ``host, path, rule, by_rule`` to rows with ``url``; the longest fitting rule wins."""
    rows = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit(f".{r.host}"))) & F.startswith(F.col("path"), F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rows.withColumns({"rule": name, "by_rule": verdict})


def spelled(url: Column) -> Column:
    """What the models read: all after the scheme, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:.*?://)?(.*)$", 1), UPPER, LOWER)


def char_grams(rows: DataFrame, order: int) -> DataFrame:
    """One row per character of column ``chars`` and one for its end: ``gram`` is the character after ``order`` ones before it."""
    padded = rows.withColumn("padded", F.concat(F.lit(BEGIN * order), F.col("chars"), F.lit(END)))
    at = padded.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("padded") - order)))
    return at.withColumn("gram", F.substring(F.col("padded"), F.col("at"), F.lit(order + 1))).drop("padded", "at")


def gram_ratios(grams: DataFrame, learned: DataFrame, order: int) -> DataFrame:
    """``gram, ratio`` of every gram of ``grams``: log probability under the accepted model less that under the rejected one, in units.

    ``learned``: ``gram, accepted, rejected``, the grams' counts in either model.
    """
    sides = ("accepted", "rejected")
    out = grams.withColumns({f"p_{s}": F.lit(UNSEEN) for s in sides})
    for k in range(order + 1):
        tail, context = F.substring("gram", order + 1 - k, k + 1), F.substring("gram", order + 1 - k, k)
        counted = learned.groupBy(tail.alias("tail")).agg(*(F.sum(s).alias(s) for s in sides))
        after = counted.groupBy(F.substring("tail", 1, k).alias("context")).agg(
            *(F.sum(s).alias(f"all_{s}") for s in sides), *(F.count_if(F.col(s) > 0).alias(f"kinds_{s}") for s in sides)
        )
        out = out.withColumns({"tail": tail, "context": context}).join(counted, "tail", "left").join(after, "context", "left")
        blended = {}
        for s in sides:
            n, whole, kinds = (F.coalesce(F.col(c), F.lit(0)) for c in (s, f"all_{s}", f"kinds_{s}"))
            blended[f"p_{s}"] = F.when(whole > 0, (n + kinds * F.col(f"p_{s}")) / (whole + kinds)).otherwise(F.col(f"p_{s}"))
        out = out.select("gram", *(p.alias(c) for c, p in blended.items()))
    return out.select("gram", F.round(F.log(F.col("p_accepted") / F.col("p_rejected")) / UNIT).cast("long").alias("ratio"))


def judge(
    pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, order: int = 4, id_col: str = "page_id", url_col: str = "url", folds: int = 4, fold: int = 2
) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, score, threshold`` per row of ``pages``.

    A fitting rule decides; else the models do: ``allow`` if the score (mean log
    ratio per character) reaches the threshold.  Models learn from rule-judged
    rows outside the calibration fold (by checksum of the URL, repeats counted);
    in that fold the threshold lies between the classes' mean scores, divided as
    their spreads are, and is 0 if a class has no row there.  A null URL or one
    without ``://`` has an empty host and path and is read by the models as it
    is (null: empty).  Null ids and repeated rows are judged like any other row;
    extra columns are ignored.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = judged_by_rules(urls, rules).withColumn("chars", spelled(F.col("url")))
    kept_out = F.crc32(F.col("chars").cast("binary")) % folds == fold
    # a URL's rule verdict depends on the URL alone, so its rows can be counted together
    texts = saved(rows.groupBy("chars", "by_rule").agg(F.count("*").alias("n")).withColumn("kept_out", kept_out), "urls")

    learning = char_grams(texts.where("by_rule is not null and not kept_out"), order)
    learned = learning.groupBy("gram").agg(
        F.sum(F.when(F.col("by_rule") == "allow", F.col("n")).otherwise(0)).alias("accepted"), F.sum(F.when(F.col("by_rule") == "block", F.col("n")).otherwise(0)).alias("rejected")
    )
    learned = saved(learned, "url-grams")
    asked = saved(char_grams(texts.select("chars"), order).select("gram").distinct(), "url-grams")
    ratios = saved(gram_ratios(asked, learned, order), "url-ratios")
    summed = char_grams(texts.select("chars").distinct(), order).join(sent_if_small(ratios), "gram").groupBy("chars").agg(F.sum("ratio").alias("units"))
    scores = saved(summed.select("chars", F.round(F.col("units") / (F.length("chars") + 1)).cast("long").alias("units")), "url-scores")

    known = texts.where("by_rule is not null and kept_out").join(scores, "chars").groupBy("by_rule").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("units")).cast("double").alias("s"),
        F.sum((F.col("n") * F.col("units")).cast("decimal(38,0)") * F.col("units")).cast("double").alias("ss"),
    )
    spread = {r.by_rule: (r.s / r.n, max(1.0, r.ss / r.n - (r.s / r.n) ** 2) ** 0.5) for r in known.collect()}  # one row per verdict
    threshold = 0.0
    if {"allow", "block"} <= spread.keys():
        (a, sa), (b, sb) = spread["allow"], spread["block"]
        threshold = float(round((a * sb + b * sa) / (sa + sb)))
    out = rows.join(scores, "chars", "left")
    return out.select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("units") >= threshold, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"),
        (F.col("units") * UNIT).alias("score"), F.lit(threshold * UNIT).alias("threshold"),
    )
