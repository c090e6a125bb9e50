"""Benchmark decontamination by winnowing.

A window of ``window`` words holds ``window - gram + 1`` word grams; the
smallest hash among them is its fingerprint.  Equal windows have equal
fingerprints, so joining the documents' fingerprints with the benchmark's misses
no shared window.  A hit is extended: every window that holds the matched gram
is compared word for word.  Items shorter than a window are one window of their
own length; for each such length the documents' grams of that length are
fingerprints.  Column expressions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import let, saved, sent_if_small, text_or_empty

#: Runs of characters that stand between words (fixed value).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def _at(array: Column, start: Column, n: int) -> list[Column]:
    return [F.get(array, start + i) for i in range(n)]


def _positions(n: Column) -> Column:
    """0 to n - 1, empty if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def gram_hashes(found: Column, gram: int) -> Column:
    """Hash of each run of ``gram`` words of an array of words."""
    return let(F.transform(found, lambda w: F.xxhash64(w)), lambda h: F.transform(_positions(F.size(h) - (gram - 1)), lambda i: F.xxhash64(*_at(h, i, gram))))


def _picked(grams: Column, width: int) -> Column:
    """Position and hash of the grams that are the smallest of some run of ``width`` neighbours, ties included."""

    def choose(g, low):
        # a gram is picked if the largest of the minima of the runs around it is its own hash; null beyond either end
        marked = F.transform(g, lambda x, i: F.struct(i.alias("p"), F.when(x == F.greatest(*(F.get(low, i - k) for k in range(width))), x).alias("h")))
        return F.filter(marked, lambda x: x["h"].isNotNull())

    def of(g):
        return let(F.transform(_positions(F.size(g) - (width - 1)), lambda i: F.least(*_at(g, i, width))), lambda low: choose(g, low))

    return let(grams, of)


def fingerprints(found: Column, window: int, gram: int) -> Column:
    """``array<struct<p,h>>`` for windows of ``window`` words: their picked grams, or all of them if a window is one gram."""
    grams = gram_hashes(found, gram)
    if window == gram:
        return F.transform(grams, lambda g, i: F.struct(i.alias("p"), g.alias("h")))
    return _picked(grams, window - gram + 1)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 8, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``doc_id, text, n_words, n_hit, items, contaminated`` per row of ``docs``.

    A word is hit if it lies in an occurrence of a benchmark window; ``items``
    are the ids (as strings, sorted) of items with an occurring window; a
    document is contaminated if it has a hit and ``share`` times its hits reach
    its words.  Null and wordless texts have no words and no hits; null and
    wordless items have no window; an item without an id counts its hits but is
    not listed.  Null ids and repeated rows are judged like any other row; extra
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    items = saved(
        benchmark.select(F.col(item_col).cast("string").alias("item"), words(text_or_empty(item_text_col)).alias("words")).where(F.size("words") > 0), "benchmark-words"
    )
    # what is asked of the documents: windows of full length, and one length for each kind of short item
    lengths = [(window, gram)] + [(n, n) for (n,) in items.where(F.size("words") < window).select(F.size("words")).distinct().sort(F.size("words")).collect()]
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))

    probes = None
    for n, k in lengths:
        owners = items.where(F.size("words") >= window if n == window else F.size("words") == n)
        prints = owners.select(F.explode(fingerprints(F.col("words"), n, k)["h"]).alias("h")).distinct().withColumn("n", F.lit(n))
        probes = prints if probes is None else probes.unionByName(prints)
    probes = saved(probes, "benchmark-prints")

    def marks_of(found, n, k):
        return F.transform(fingerprints(found, n, k), lambda x: F.struct(F.lit(n).alias("n"), x["p"].alias("p"), x["h"].alias("h")))

    def marks(found):
        return F.concat(*(marks_of(found, n, k) for n, k in lengths))

    marked = keyed.select("key", F.explode(let(words(F.col("text")), marks)).alias("m")).select("key", "m.n", "m.p", "m.h")
    hits = marked.join(sent_if_small(probes), ["n", "h"]).groupBy("key").agg(F.collect_set(F.struct("n", "p")).alias("hits"))  # bounded by the document's own length
    hits = saved(hits, "benchmark-hits")

    # the windows that hold a matched gram, word for word
    def starts(hit, size):
        first = F.greatest(hit["p"] - F.when(hit["n"] == window, window - gram).otherwise(0), F.lit(0))
        return F.filter(F.sequence(first, hit["p"]), lambda s: s + hit["n"] <= size)

    def around(found):
        near = F.flatten(F.transform("hits", lambda x: F.transform(starts(x, F.size(found)), lambda s: F.struct(x["n"].alias("n"), s.alias("p")))))
        return F.transform(F.array_distinct(near), lambda w: F.struct(w["n"].alias("n"), w["p"].alias("p"), F.array_join(F.slice(found, w["p"] + 1, w["n"]), " ").alias("window")))

    suspects = keyed.join(hits, "key").select("doc_id", "key", F.explode(let(words(F.col("text")), around)).alias("w"))
    length = F.when(F.size("words") < window, F.size("words")).otherwise(F.lit(window))
    whole = let(F.col("words"), lambda w: F.transform(_positions(F.size(w) - length + 1), lambda i: F.array_join(F.slice(w, i + 1, length), " ")))
    asked = saved(items.select("item", length.alias("n"), F.explode(whole).alias("window")).distinct(), "benchmark-windows")
    occurring = suspects.select("doc_id", "key", "w.n", "w.p", "w.window").join(sent_if_small(asked), ["n", "window"])
    per_doc = occurring.groupBy("doc_id", "key").agg(F.collect_set(F.struct("p", "n")).alias("at"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["p"], x["p"] + x["n"] - 1)))))
    counted = per_doc.select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), covered.cast("long").alias("n_hit"), "items")

    sized = keyed.select("doc_id", "text", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = sized.join(counted, (F.col("key") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id", "text", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
