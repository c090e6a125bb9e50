"""Entities as token spans, and strict aspects that overlap them."""

from pyspark.sql import functions as F

from aspectra.operators import aspects as A
from aspectra.operators import entities as N


def test_pattern_kinds(spark):
    cases = {
        "two red plates": ["CARDINAL", None, None], "the 3rd gear": [None, "ORDINAL", None], "at 10am on monday": [None, "TIME", None, "DATE"],
        "1,200.50 bolts in 2019": ["CARDINAL", None, None, "DATE"], "5 km": ["CARDINAL", "QUANTITY"], "km": [None], "2020-01-05 at 10:30": ["DATE", None, "TIME"],
        "": [], "50% off": ["CARDINAL", None],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = rows.select("t", N.pattern_kinds(F.filter(F.split("t", " "), lambda x: x != "")).alias("k")).collect()
    assert {r.t: r.k for r in got} == cases


def test_names_are_matched_longest_first_from_the_left(spark):
    names = [["new", "york"], ["new", "york", "times"], ["york"], ["times", "square"]]
    cases = {
        "a new york times square": [False, True, True, True, False], "new york square": [True, True, False], "times square york": [True, True, True],
        "new": [False], "": [],
    }
    rows = spark.createDataFrame([(t, names) for t in cases], "t string, n array<array<string>>")
    tokens = F.filter(F.split("t", " "), lambda x: x != "")
    assert {r.t: r.m for r in rows.select("t", N.name_marks(tokens, F.col("n")).alias("m")).collect()} == cases
    assert rows.select(N.name_marks(tokens, F.lit(None).cast("array<array<string>>")).alias("m")).where(F.exists("m", lambda x: x)).count() == 0


def test_strict_aspects_drop_what_overlaps_an_entity(spark):
    rows = [(1, "The old red plate is fine. Two small gears broke"), (2, "red Hot Rod gear"), (3, "new ring; 5 old bolts"), (4, None), (5, "cold monday plate"), (6, "hot rod")]
    reviews = spark.createDataFrame(rows, "key long, text string")
    gazetteer = spark.createDataFrame([("hot  rod", "PERSON"), ("Hot Rod", "PERSON"), (None, "PERSON"), ("", "PERSON"), ("a name of many words", "PERSON"), ("old red plate", "PRODUCT")], "name string, kind string")
    adjectives, nouns = ["old", "red", "small", "new", "cold", "hot"], ["plate", "gears", "gear", "ring", "bolts", "rod"]

    def phrases(**kw):
        out = {}
        for r in A.extract_aspects(reviews, "key", "text", adjectives, nouns, strict=True, **kw).sort("key", "aspect_pos").collect():
            out.setdefault(r.key, []).append(r.aspect_phrase)
        return out

    assert phrases() == {1: ["the old red plate"], 2: ["red hot rod gear"], 3: ["new ring"], 5: ["general"], 6: ["hot rod"]}
    assert phrases(gazetteer=gazetteer) == {1: ["the old red plate"], 2: ["general"], 3: ["new ring"], 5: ["general"], 6: ["general"]}
    assert phrases(gazetteer=gazetteer.limit(0)) == phrases()
