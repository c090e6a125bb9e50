"""Spelling variants by a dictionary of trie-node pairs.

Every word's forward trie path and its reversed word's trie path are numbered:
the words are range-partitioned in order, each partition numbers its own trie
nodes in one sorted pass, and the rows that describe the partitions' borders
turn these into the numbers of one trie.  A word with position ``i`` skipped is
then the integer pair (node of the prefix before ``i``, node of the suffix after
``i``); a word with a symbol to be inserted at ``i`` is the pair around that
gap.  Equal pairs mean equal letters, so what meets in a pair is exactly one
replacement, insertion or deletion apart.  All words that meet with a position
skipped differ in one symbol, so a pair holds at most one word a symbol and one
gap; members are counted and the largest taken, and no pairs of words are formed.
"""

from __future__ import annotations

import math
import os

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.common import saved

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(docs: DataFrame, least_length: int, typo_every: int, id_col: str, text_col: str) -> DataFrame:
    """``word``: one row per run of letters, with planted typing errors, of at least ``least_length`` letters.

    A run whose ``crc32("<id>:<run>")`` is divisible by ``typo_every`` loses its
    letter number ``crc32 mod length``; 0 plants none.
    """
    runs = F.regexp_extract_all(text_col, F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run"))
    run = run.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    if not typo_every:
        return run.select(F.col("run").alias("word"))
    marked = run.withColumn("h", F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % typo_every == 0, cut).otherwise(F.col("run"))
    return marked.select(word.alias("word")).where(F.char_length("word") >= least_length)


def dictionary(docs: DataFrame, least_length: int = 6, least_count: int = 5, typo_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the words of at least ``least_length`` letters and ``least_count`` occurrences in all texts.

    Words are maximal runs of ``[A-Za-zÀ-ÿ]``, of which only A-Z are lower-cased.
    A null text has none; a null id counts as empty; repeated rows count again.
    """
    counted = words_of(docs, least_length, typo_every, id_col, text_col).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def numbered(words: DataFrame, key: str, out: str) -> DataFrame:
    """``words`` with ``out``: the nodes on the path of column ``key`` (distinct, not empty) in one trie, the root 0 first.

    Nodes are numbered in preorder, so the last node of a path belongs to its
    text alone and grows with it in code-point order.
    """
    types = {f.name: f.dataType.simpleString() for f in words.schema}

    def paths(frames):
        part, before, path, used = TaskContext.get().partitionId(), "", [], 0
        for frame in frames:
            rows = []
            for text in frame[key]:
                same = len(os.path.commonprefix([before, text]))
                path = path[:same] + list(range(used, used + len(text) - same))
                used += len(text) - same
                rows.append(path)
                before = text
            yield frame.assign(part=part, local=rows)

    schema = ", ".join(f"{c} {t}" for c, t in types.items()) + ", part int, local array<long>"
    ordered = words.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    laid = saved(ordered.mapInPandas(paths, schema), f"variants-{out}")
    last = F.max(F.struct(F.col(key).alias("text"), F.col("local").alias("path"))).alias("last")
    borders, text, path, free = [], "", [], 1
    for r in laid.groupBy("part").agg(F.min(key).alias("first"), last).sort("part").collect():  # one row a partition
        # nodes that the partition's first text shares with the one before are that one's; the others follow all used so far
        same = len(os.path.commonprefix([text, r["first"]]))
        borders.append((r["part"], same, path[:same], free - same))
        path = [path[x] if x < same else free - same + x for x in r["last"]["path"]]
        text, free = r["last"]["text"], path[-1] + 1
    known = words.sparkSession.createDataFrame(borders, "part int, same long, carried array<long>, ahead long")
    node = F.transform("local", lambda x: F.when(x < F.col("same"), F.get("carried", x.cast("int"))).otherwise(F.col("ahead") + x))
    return laid.join(F.broadcast(known), "part").select(*types, F.concat(F.array(F.lit(0).cast("long")), node).alias(out))


def _spelled(words: DataFrame) -> DataFrame:
    """``word, n, back, ends``: the word backwards, and whether each letter differs from the next one."""

    def batches(frames):
        for frame in frames:
            yield pd.DataFrame(
                {
                    "word": frame["word"],
                    "n": frame["n"],
                    "back": [w[::-1] for w in frame["word"]],
                    "ends": [[a != b for a, b in zip(w, w[1:], strict=False)] + [True] for w in frame["word"]],
                }
            )

    return words.mapInPandas(batches, "word string, n long, back string, ends array<boolean>")


#: What a word holds of a pair: a gap between two letters, a skipped letter, a skipped letter that is the last of its run.
GAP, SKIP, RUN_END = 0, 1, 2


def node_pairs(words: DataFrame) -> DataFrame:
    """``id, word, n, prefix, suffix, kind``: the pairs of every word with a position skipped or opened.

    ``id`` is the word's last forward node.  A deletion inside a run of equal
    letters is one deletion, so only its last letter meets gaps.
    """
    paths = numbered(numbered(_spelled(words), "word", "forward"), "back", "backward")
    length = F.size("ends")
    skips = F.arrays_zip(
        F.slice("forward", F.lit(1), length).alias("prefix"),
        F.reverse(F.slice("backward", F.lit(1), length)).alias("suffix"),
        F.transform("ends", lambda e: F.when(e, RUN_END).otherwise(SKIP)).alias("kind"),
    )
    gaps = F.arrays_zip(
        F.col("forward").alias("prefix"), F.reverse("backward").alias("suffix"), F.array_repeat(F.lit(GAP), length + 1).alias("kind")
    )
    kind = "array<struct<prefix:long,suffix:long,kind:int>>"
    return paths.select(F.element_at("forward", -1).alias("id"), "word", "n", F.inline(F.concat(skips.cast(kind), gaps.cast(kind))))


def _size_order(n, node):
    """Orders words by falling count, then by code points."""
    return F.struct((-F.col(n)).alias("minus_n"), F.col(node).alias("id"))


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per row of ``words`` (``word, n``; distinct words, not empty).

    Near words differ by exactly one inserted, deleted or replaced code point;
    ``n_near`` counts them.  ``form`` is the near word of largest ``n`` (ties: the
    smallest in code-point order) if it has at least ``ratio`` (above 1) times
    the word's own ``n``, else null.  ``root`` is reached by following forms to
    the last one.  Extra columns are ignored; an empty table gives an empty result.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    known = saved(words.select("word", F.col("n").cast("long").alias("n")), "variants-words")
    held = saved(node_pairs(known), "variants-pairs")
    names = saved(held.where((F.col("kind") == GAP) & (F.col("prefix") == 0)).select("id", "word", "n"), "variants-names")
    group = Window.partitionBy("prefix", "suffix")  # one word a symbol, and one gap
    skipped, run_end, gap = F.col("kind") != GAP, F.col("kind") == RUN_END, F.col("kind") == GAP
    met = held.select("id", "n", "kind", "prefix", "suffix").withColumns(
        {
            "members": F.count("*").over(group),
            "n_skip": F.count(F.when(skipped, 1)).over(group),
            "n_end": F.count(F.when(run_end, 1)).over(group),
            "n_gap": F.count(F.when(gap, 1)).over(group),
            "top_skip": F.min(F.when(skipped, _size_order("n", "id"))).over(group),
            "top_end": F.min(F.when(run_end, _size_order("n", "id"))).over(group),
            "top_gap": F.min(F.when(gap, _size_order("n", "id"))).over(group),
        }
    )
    near = F.when(gap, F.col("n_end")).when(run_end, F.col("n_skip") - 1 + F.col("n_gap")).otherwise(F.col("n_skip") - 1)
    # where the word itself is the largest, no other is ``ratio`` times as large
    best = F.when(gap, F.col("top_end")).when(run_end, F.least("top_skip", "top_gap")).otherwise(F.col("top_skip"))
    one = met.where("members > 1").select("id", near.alias("near"), F.when(-best["minus_n"] >= ratio * F.col("n"), best).alias("best"))
    found = one.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    forms = saved(found.select("id", "n_near", F.col("best.id").alias("form_id"), (-F.col("best.minus_n")).alias("form_n")), "variants-forms")
    roots = _roots(forms.where("form_id is not null").select("id", F.col("form_id").alias("to")), names, ratio)
    judged = names.join(forms, "id", "left").join(roots, "id", "left")
    shape = names.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    last = names.select(F.col("id").alias("to"), F.col("word").alias("last"))
    return judged.join(shape, "form_id", "left").join(last, "to", "left").select(
        "word", "form", F.coalesce("last", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"
    )


def _roots(links: DataFrame, names: DataFrame, ratio: int) -> DataFrame:
    """``id, to``: the last word reached, by doubling; a chain grows ``ratio``-fold a step, which bounds the rounds."""
    least, most = names.agg(F.min("n"), F.max("n")).first()
    steps = 1 if not most else max(1, math.floor(math.log(most / max(1, least), ratio)) + 1)
    for _ in range(math.ceil(math.log2(steps))):
        on = links.select(F.col("id").alias("to"), F.col("to").alias("further"))
        links = saved(links.join(on, "to", "left").select("id", F.coalesce("further", "to").alias("to")), "variants-roots")
    return links
