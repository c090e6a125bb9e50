"""Key phrases: a token is judged once, only candidates that reach the k-th score are sorted."""

from pyspark.sql import functions as F

from aspectra.operators import keyphrases as X


def test_tokens_are_looked_up_once(spark):
    df = spark.createDataFrame([("clean pool", 0.9, {"clean": X.ADJECTIVE, "pool": X.HAS_SENSE | X.CONCRETE}), ("clean pool", 0.9, {})],
                               "phrase string, score double, words map<string,int>")
    reason, sentiments = X.cascade(F.col("phrase"), F.col("score"), X.WordClasses(), 0.6, F.col("words"))
    for column in (reason, sentiments):
        plan = df.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("element_at(") == 1
    got = [tuple(r) for r in df.select(reason, sentiments).collect()]
    assert got == [(None, ["clean"]), ("wordnet", [])]


def test_top_candidates_keep_ties_of_the_last_score(spark):
    rows = [[(f"p{i:02d}", 0.5 if i % 3 else 0.75) for i in reversed(range(60))], [("b", 0.0), ("a", 0.0)], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s array<struct<phrase string, score double>>")
    top = X.top_candidates(F.col("s"), 30)
    got = {r.i: [(x.phrase, x.score) for x in r.t] for r in df.select("i", top.alias("t")).collect()}
    for i, r in enumerate(rows):
        assert got[i] == sorted(r, key=lambda x: (-x[1], x[0]))[:30]
    plan = df.select(top.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" in plan
