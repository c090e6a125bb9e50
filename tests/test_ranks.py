"""Global ranks over wide rows: one rank per row, none missing, whatever the columns and partitions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from aspectra.functions.ops import global_rank
from aspectra.operators.training import split


@pytest.mark.parametrize("partitions", [3, 8, 64])
def test_ranks_of_wide_rows(spark, partitions):
    n = 100_000
    key = F.md5(F.col("id").cast("string"))
    df = spark.range(n).select("id", key.alias("k"), F.repeat(key, 5).alias("pad"), F.array("id").alias("a"), F.rand(3).alias("r")).repartition(7)
    ranked = global_rank(df, F.col("k"), partitions=partitions)
    got = ranked.select("id", "_grank").toPandas()
    order = sorted(range(n), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    want = {i: at + 1 for at, i in enumerate(order)}
    assert len(got) == n and dict(zip(got["id"], got["_grank"], strict=True)) == want
    # a second read of the same result sees the same ranks
    assert ranked.agg(F.countDistinct("_grank"), F.max("_grank")).first() == (n, n)


def test_ranks_with_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(300)], "id long, k int")
    rows = sorted(global_rank(df, F.col("k"), "pos", 6).collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(1, 301)) and {r.id for r in rows} == set(range(300))
    assert [r.k is not None for r in rows] == sorted(r.k is not None for r in rows)
    known = [r.k for r in rows if r.k is not None]
    assert known == sorted(known)
    assert global_rank(df.limit(0), F.col("k")).collect() == []


def test_split_holds_out_the_same_share_of_every_label(spark):
    samples = spark.range(5000).select(F.concat(F.lit("kpi "), F.col("id") % 4).alias("kpi"), F.col("id").cast("string").alias("phrase"),
                                       F.array(F.col("id").cast("double")).alias("features"))
    held = split(samples, ["phrase"]).groupBy("kpi").agg(F.count_if("is_test").alias("n")).collect()
    assert {r.n for r in held} == {313}


def test_only_counted_small_tables_are_broadcast(spark, monkeypatch):
    from aspectra.functions import ops
    from aspectra.operators import lexical as LX

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tokens = spark.createDataFrame([("ring",), ("odd",), ("ring",)], "token string")
        lexicon = LX.lexicon_table(spark, [("ring", "NN", "ring", None), ("red", "JJ", "red", None)])
        plans, rows = [], []
        for most in (2, 1):
            monkeypatch.setattr(ops, "BROADCAST_ROWS", most)
            tagged = LX.tag_tokens(tokens, "token", lexicon)
            plans.append("BroadcastHashJoin" in tagged._jdf.queryExecution().toString())
            rows.append(sorted(map(str, tagged.collect())))
        assert plans == [True, False] and rows[0] == rows[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
