"""Which of many words occur inside which texts: a multi-pattern automaton instead of a nested loop.

All words are matched in one pass over a text.  A word list within ``SHARD_WORDS`` is one automaton
that goes to the texts.  A longer one is cut into shards by the words' first characters, and a
text goes only to shards whose characters it holds; shards of one busy beginning are cut further,
and the texts of a shard into chunks, so a task holds a bounded automaton and a bounded block.
"""

from __future__ import annotations

import uuid
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.functions.ops import saved

#: Words of one automaton, and texts of one chunk, about.
SHARD_WORDS, CHUNK_TEXTS = 50_000, 50_000
#: First characters that choose a shard.
LEAD = 2


class Automaton:
    """Trie with failure links; ``found`` gives the words inside a text, each once."""

    def __init__(self, words):
        self.step: dict[tuple[int, str], int] = {}
        self.word: list[str | None] = [None]
        for word in words:
            node = 0
            for c in word:
                nxt = self.step.get((node, c))
                if nxt is None:
                    nxt = self.step[node, c] = len(self.word)
                    self.word.append(None)
                node = nxt
            self.word[node] = word
        below: list[list[tuple[str, int]]] = [[] for _ in self.word]
        for (node, c), to in self.step.items():
            below[node].append((c, to))
        self.fail = [0] * len(self.word)
        #: the nearest shorter match that ends at the same character
        self.shorter = [0] * len(self.word)
        queue = deque(to for _, to in below[0])
        while queue:
            node = queue.popleft()
            for c, to in below[node]:
                back = self.fail[node]
                while back and (back, c) not in self.step:
                    back = self.fail[back]
                self.fail[to] = self.step.get((back, c), 0)
                self.shorter[to] = self.fail[to] if self.word[self.fail[to]] is not None else self.shorter[self.fail[to]]
                queue.append(to)

    def found(self, text: str) -> set[str]:
        out, node, step, fail = set(), 0, self.step, self.fail
        for c in text:
            while node and (node, c) not in step:
                node = fail[node]
            node = step.get((node, c), 0)
            at = node if self.word[node] is not None else self.shorter[node]
            while at:
                out.add(self.word[at])
                at = self.shorter[at]
        return out


#: The automaton a Python worker built last.
_last: tuple[str, Automaton] | None = None


def _automaton(token: str, words) -> Automaton:
    global _last
    if _last is None or _last[0] != token:
        _last = token, Automaton(words)
    return _last[1]


def _pairs(texts, automaton: Automaton) -> pd.DataFrame:
    rows = [(t, w) for t in texts for w in automaton.found(t)]
    return pd.DataFrame(rows, columns=["text", "word"], dtype=object)


def contained(texts: DataFrame, words: DataFrame, shard_words: int = SHARD_WORDS, chunk_texts: int = CHUNK_TEXTS) -> DataFrame:
    """``text, word``: every word of ``words`` (column ``word``) that is a substring of a text of ``texts`` (column ``text``), each pair once.

    Texts and words are made distinct; nulls and empty words match nothing."""
    texts = texts.select("text").where(F.col("text").isNotNull()).distinct()
    words = saved(words.select("word").where(F.col("word") != "").distinct(), "match-words")
    n, spark = words.count(), words.sparkSession
    schema = "text string, word string"
    if n <= shard_words:
        shared = spark.sparkContext.broadcast([r["word"] for r in words.collect()])  # shard_words at most
        token = uuid.uuid4().hex

        def match(frames):
            automaton = _automaton(token, shared.value)
            for frame in frames:
                yield _pairs(frame["text"], automaton)

        return texts.mapInPandas(match, schema)

    shards = -(-n // shard_words)

    def shard(lead):
        return F.pmod(F.xxhash64(lead), F.lit(shards)).cast("int")

    led = words.withColumn("shard", shard(F.left("word", F.lit(LEAD))))
    cuts = saved(led.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_words).cast("int").alias("cuts")), "match-cuts")  # one row a shard
    # every beginning a word of the shard could have in the text
    at = F.sequence(F.lit(1), F.greatest(F.char_length("text"), F.lit(1)))
    leads = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(LEAD)), lambda k: F.substring(F.col("text"), i, k)))))
    asking = texts.select("text", F.explode(F.array_distinct(F.transform(leads, shard))).alias("shard")).join(F.broadcast(cuts), "shard")
    counted = saved(asking.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / chunk_texts).cast("int").alias("chunks")), "match-chunks")  # one row a shard
    asks = asking.join(F.broadcast(counted), "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.pmod(F.xxhash64("text"), F.col("chunks")).cast("int").alias("chunk"), "text")
    held = led.join(F.broadcast(cuts), "shard").join(F.broadcast(counted), "shard").select(
        "shard", F.pmod(F.xxhash64("word", F.lit(1)), F.col("cuts")).cast("int").alias("cut"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "word")
    key = ["shard", "cut", "chunk"]

    def group(asked, kept):
        return _pairs(asked["text"], Automaton(kept["word"])) if len(kept) else _pairs([], Automaton([]))

    return asks.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(group, schema)
