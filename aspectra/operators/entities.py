"""Person, date, time and number entities as token spans (A2): names from a gazetteer, the rest by pattern.

A gazetteer is a table of names of any number of words.  Which of its names a text holds comes from
one equi-join of the text's word n-grams (only of lengths that names have); a text then marks its
own tokens by the few names it holds, longest match first from the left.  Patterns need no table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra import lexicons as L

# Words that name numbers, times and dates, and units of measure.
NUMBER_WORDS = tuple("zero one two three four five six seven eight nine ten eleven twelve twenty thirty fifty hundred thousand million dozen".split())
ORDINAL_WORDS = tuple("first second third fourth fifth sixth seventh eighth ninth tenth last".split())
TIME_WORDS = tuple("am pm noon midnight o'clock".split())
DATE_WORDS = tuple(
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december"
    " today yesterday tomorrow".split())
UNITS = tuple("percent km kilometers kilometres miles meters metres feet inches kg kilos pounds grams liters litres hours minutes days nights weeks months years".split())


def pattern_kinds(tokens: Column) -> Column:
    """Per lower-case token DATE, TIME, ORDINAL, CARDINAL, QUANTITY (a unit after a number), or null."""
    number = r"^[0-9]+([.,][0-9]+)*%?$"
    date = r"^((19|20)[0-9]{2}|[0-9]{1,4}[/-][0-9]{1,2}([/-][0-9]{1,4})?)$"
    before = F.slice(F.concat(F.array(F.lit("")), tokens), F.lit(1), F.size(tokens))

    def like(t, pattern):
        # every pattern begins with a digit; few tokens do
        return (t >= "0") & (t < ":") & t.rlike(pattern)

    def kind(t, b):
        counted = like(b, number) | L.in_words(b, NUMBER_WORDS)
        return (F.when(like(t, date) | L.in_words(t, DATE_WORDS), "DATE")
                .when(like(t, r"^[0-9]{1,2}(:[0-9]{2}(am|pm)?|am|pm)$") | L.in_words(t, TIME_WORDS), "TIME")
                .when(like(t, r"^[0-9]+(st|nd|rd|th)$") | L.in_words(t, ORDINAL_WORDS), "ORDINAL")
                .when(like(t, number) | L.in_words(t, NUMBER_WORDS), "CARDINAL")
                .when(L.in_words(t, UNITS) & counted, "QUANTITY"))

    return F.zip_with(tokens, before, kind)


def name_marks(tokens: Column, names: Column) -> Column:
    """Per token whether it lies in one of ``names`` (arrays of tokens): leftmost matches, the longest at each place."""
    def at(acc, i):
        here = F.filter(names, lambda n: (F.size(n) > 0) & (F.slice(tokens, i, F.greatest(F.size(n), F.lit(1))) == n))
        longest = F.coalesce(F.array_max(F.transform(here, lambda n: F.size(n))), F.lit(0))
        left = F.when(acc["left"] > 0, acc["left"]).otherwise(longest)
        return F.struct(F.greatest(left - 1, F.lit(0)).alias("left"), F.array_append(acc["marks"], left > 0).alias("marks"))

    start = F.struct(F.lit(0).alias("left"), F.expr("cast(array() as array<boolean>)").alias("marks"))
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens))).otherwise(F.expr("cast(array() as array<int>)"))
    marks = F.aggregate(places, start, at, lambda acc: acc["marks"])
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, marks).otherwise(F.transform(tokens, lambda t: F.lit(False)))


def names_in(df: DataFrame, key: str, tokens: Column, gazetteer: DataFrame, name_col: str = "name", out: str = "names") -> DataFrame:
    """``key, out``: the gazetteer names (arrays of lower-case tokens) among the word n-grams of each row that has any."""
    names = gazetteer.select(F.array_join(F.filter(F.split(F.lower(name_col), r"\s+"), lambda t: t != ""), " ").alias("gram")).where(F.col("gram") != "").distinct()
    lengths = [r["n"] for r in names.select(F.size(F.split("gram", " ")).alias("n")).distinct().sort("n").collect()]  # one entry a length
    rows = df.select(F.col(key).alias("_key"), tokens.alias("_t"))

    def of_length(n):
        starts = F.when(F.size("_t") >= n, F.sequence(F.lit(1), F.size("_t") - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.array_join(F.slice("_t", i, F.lit(n)), " "))

    grams = F.concat(F.expr("cast(array() as array<string>)"), *map(of_length, lengths))
    held = rows.select("_key", F.explode(F.array_distinct(grams)).alias("gram")).join(names, "gram")
    # a row's names are among its own n-grams
    return held.groupBy("_key").agg(F.collect_set(F.split("gram", " ")).alias(out)).withColumnRenamed("_key", key)
