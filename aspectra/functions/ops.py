"""Generic skew-safe building blocks used by several operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aspectra.session import checkpoint_dir


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def topk(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int,
         rank_col: str = "rank", salt_buckets: int = 16, salt_on: Sequence[str] | None = None) -> DataFrame:
    """Top-k rows per group with a TOTAL order, in two window passes.

    Pass 1 ranks inside (keys, salt) so one hot group is spread over
    ``salt_buckets`` tasks; only k rows per salt survive, so pass 2 sees at most
    ``salt_buckets * k`` rows per group.  The top k of a union equals the top k of
    the per-part top k, so the result is exact.
    """
    keys = list(keys)
    order = _cols(order)
    if salt_buckets and salt_buckets > 1:
        salt_src = _cols(salt_on) if salt_on else [F.col(c) for c in df.columns if c not in keys][:3]
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_src), F.lit(salt_buckets)))
        w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w2).cast("long")).where(F.col(rank_col) <= k)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], rank_col: str = "_rk") -> DataFrame:
    """One row per group: the first in a total order (k=1 of ``topk``)."""
    return topk(df, keys, order, 1, rank_col).drop(rank_col)


def bound(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once: a lambda's body repeats what it names several times."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def half_up_div(num: Column, den: Column) -> Column:
    """round(num/den) half-up for non-negative integers, exactly (integer arithmetic)."""
    return F.floor((num * 2 + den) / (den * 2)).cast("long")


def round_half_up(c: Column, digits: int) -> Column:
    """Decimal half-up rounding of a double (through decimal, as the oracle does)."""
    return F.round(c.cast("decimal(38,18)"), digits).cast("double")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared checkpoint folder and read back: values that
    depend on the execution (partition numbers, row ids) are the same for every reader."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch whose rows are long lists.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs run inside send Python ``SMALL_BATCHES``: a list's texts take several times their bytes there."""
    before = {key: spark.conf.get(key, None) for key in SMALL_BATCHES}
    for key, value in SMALL_BATCHES.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: A table of at most so many counted rows may be sent to all executors.
BROADCAST_ROWS = 1 << 20


def sent_if_small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast join if its counted rows stay within ``BROADCAST_ROWS``; else the join is left to shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def global_rank(df: DataFrame, order: Column, out: str = "_grank", partitions: int | None = None) -> DataFrame:
    """Exact 1-based rank in a total ``order`` without a global window: range partitioning
    puts equal keys in one partition, each partition is sorted, and partition offsets
    (one row per partition) are added to the in-partition positions.

    The bounds of a range partitioning are sampled anew by every execution, so the laid-out
    rows are saved with their partition and position, and offsets and ranks both come from
    that one table."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    laid = (df.withColumn("_ok", order).repartitionByRange(n, "_ok").sortWithinPartitions("_ok").drop("_ok")
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_mid", F.monotonically_increasing_id()))
    d = saved(laid, "rank")
    # ids increase by 1 inside a partition: position = id - first id of the partition
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    offs = counts.select("_pid", "_m0", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (d.join(F.broadcast(offs), "_pid")  # one row per partition
            .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("long"))
            .drop("_pid", "_mid", "_m0", "_off"))


def spread(df: DataFrame, key: str, min_partitions: int | None = None) -> DataFrame:
    """Hash-repartition on ``key`` when the input has fewer partitions than the cluster's
    parallelism (a small file in one row group is one task); inputs that are already
    split are left alone, so large scans pay no extra shuffle."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key)
