"""Contiguous balanced shards from global byte-size prefix sums.

Documents are laid out in id order over range partitions.  Each partition sums
its sizes; the prefix sums of these few totals give every document the bytes
before it, and the global line is cut at equal targets.  Texts are measured
where they are read and never move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.common import saved


def _prefix(totals: DataFrame) -> DataFrame:
    """Bytes and rows before each partition; one row per partition, so a single ordered window is bounded by their number."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )


def balanced_shards(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, bytes_before`` per row of ``docs``.

    ``size`` is the text's UTF-8 bytes (null: none) plus ``overhead``.  A
    document goes to the shard in which the middle of its bytes falls when the
    total is cut into ``shards`` equal parts, so a shard misses its target by
    less than one document at either end.  ``slot`` counts from 0 within a
    shard.  Order: id (null first), then the text's checksum and size; rows that
    agree in all three are interchangeable.  A document longer than a target
    stays whole and may leave shards empty.  Extra columns are ignored; an empty
    table gives an empty result.
    """
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    laid = saved(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-layout")
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = laid.withColumns(
        {"in_part": F.coalesce(F.sum("size").over(within), F.lit(0)), "row_in_part": F.coalesce(F.count("*").over(within), F.lit(0))}
    )
    totals = saved(laid.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-totals")
    whole = totals.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    # one row per partition of the layout, and one row in all
    placed = local.join(F.broadcast(_prefix(totals)), "part").crossJoin(F.broadcast(whole))
    cut = placed.select(
        *order,
        (F.col("bytes_before") + F.col("in_part")).alias("bytes_before"),
        (F.col("rows_before") + F.col("row_in_part")).alias("row"),
        "total",
    ).withColumn(
        "shard",
        F.floor((F.col("bytes_before").cast("decimal(38,0)") * 2 + F.col("size")) * shards / (F.col("total").cast("decimal(38,0)") * 2)).cast("int"),
    )
    first = cut.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row per shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"), "bytes_before"
    )
