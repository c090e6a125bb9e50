"""Spelling: keys of many words and corrections of many tokens."""

from itertools import combinations

from pyspark.sql import functions as F

from aspectra.functions import text as T
from aspectra.operators import lexical as LX


def test_delete_keys_are_all_choices(spark):
    words = ["ab", "abcde", "ééab", "a", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for k in (1, 2):
        rows = LX.delete_keys(df, "w", k).collect()
        for w in words:
            want = sorted("".join(c for i, c in enumerate(w) if i not in cut) for n in range(k + 1) for cut in combinations(range(len(w)), n))
            assert sorted(r.key for r in rows if r.w == w) == want


def test_keys_of_words_are_not_shuffled(spark):
    vocab = spark.createDataFrame([("hotel", 9), ("room", 8)], "term string, freq long")
    words = spark.createDataFrame([("hotl",), ("rom",), ("rooom",), ("zzz",), (None,)], "w string")
    got = LX.corrections(words, "w", vocab, 2)
    assert "hashpartitioning(key" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.word: r.correction for r in got.collect()} == {"hotl": "hotel", "rom": "room", "rooom": "room"}


def test_corrections_of_a_row_lie_in_small_maps(spark, monkeypatch):
    letters = "abcdefghijklmnop"
    terms = [f"{a}{b}{c}stem" for a in letters for b in letters for c in letters][:600]
    vocab = spark.createDataFrame([(t, 5) for t in terms], "term string, freq long")
    wrong = [f"{t}q" for t in terms]
    docs = spark.createDataFrame([(1, wrong + ["zzzzzzzz", None] + wrong), (1, ["aaastemq"]), (None, ["aaastemq"]), (2, None)], "k long, t array<string>")
    monkeypatch.setattr(LX, "HOT_TOKEN", 1)  # tokens of two rows and more are spread
    out = LX.correct_tokens(docs, "k", "t", vocab, 1)
    rows = sorted(((r.k is None, r.k or 0, len(r.corrected)), r.corrected) for r in out.collect())
    assert [c for _, c in rows] == [["aaastem"], terms + ["zzzzzzzz", None] + terms, [], ["aaastemq"]]
    assert "map_from_entries(transform(filter(" in LX._replaced(F.col("t"), F.col("f"))._jc.toString()


def test_light_text_keeps_letters_digits_and_marks(spark):
    rows = [("Tab\there,  two blanks\n\nÉté 9-9!? \x0b[x] ",), ("",), (None,), ("\t",)]
    df = spark.createDataFrame(rows, "t string")
    old = F.trim(F.regexp_replace(F.regexp_replace(F.lower("t"), r"[^a-z0-9\s.,!?]", " "), r"\s+", " "))
    assert [r[0] for r in df.select(T.normalize_light("t")).collect()] == [r[0] for r in df.select(old).collect()]
    assert r"a-z" not in T.NOT_LIGHT
    plan = df.select(F.explode(T.tokens(T.normalize_light("t"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2  # two steps, each once
