"""Substring matching by automaton against plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.functions.matching import Automaton, contained
from aspectra.operators import rules as R


def test_automaton_finds_overlapping_words():
    words = ["he", "she", "his", "hers", "e", "rs h", "\U0001f600e"]
    automaton = Automaton(words)
    for text in ["ushers his", "", "xyz", "sh\U0001f600ers h", "hhhe"]:
        assert automaton.found(text) == {w for w in words if w in text}


@pytest.mark.parametrize("settings", [{}, {"shard_words": 7, "chunk_texts": 11}], ids=["one automaton", "shards"])
def test_contained_matches_plain_search(spark, settings):
    rng = np.random.default_rng(1)

    def draw(n, top):
        return ["".join(rng.choice(list("ab é"), rng.integers(1, top))) for _ in range(n)]

    texts, words = [*draw(120, 15), None, "", "ab"], [*draw(60, 5), None, "", "ab"]
    got = contained(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(w,) for w in words], "word string"), **settings).collect()
    want = {(t, w) for t in texts for w in words if t is not None and w and w in t}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_rules_with_a_hundred_thousand_keywords(spark):
    """The plan has no nested loop, and every phrase finds the one keyword it holds among 100,000."""
    n = 100_000
    weights = spark.range(n).select(F.concat(F.lit("kpi"), F.col("id") % 50).alias("kpi"), F.format_string("w%06dz", "id").alias("keyword"), F.lit(1.0).alias("weight"))
    rules = spark.range(50).select(F.concat(F.lit("kpi"), F.col("id")).alias("kpi"), F.col("id").alias("kpi_rank"), F.lit(1.0).alias("target_weight"), F.lit("d").alias("department"))
    phrases = spark.range(0, n, 50).select((F.col("id") + 7).alias("id"), F.format_string("The W%06dZ of it", F.col("id") + 7).alias("phrase"))
    found = R.match_rules(phrases, "phrase", rules, weights)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    got = found.collect()
    assert len(got) == n // 50 and {(r.kpi, r.confidence) for r in got} == {("kpi7", 1.0)}


def test_rules_without_hits(spark):
    weights = spark.createDataFrame([("k", "absent", 1.0)], "kpi string, keyword string, weight double")
    rules = spark.createDataFrame([("k", 0, 1.0, "d")], "kpi string, kpi_rank long, target_weight double, department string")
    phrases = spark.createDataFrame([("nothing here",), (None,), ("",)], "phrase string")
    assert R.match_rules(phrases, "phrase", rules, weights).collect() == []
    assert R.match_rules(phrases, "phrase", rules, weights.limit(0)).collect() == []
