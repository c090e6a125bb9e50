"""Helpers the operators share: saved intermediate tables, connected components, text spans."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions import graph
from aspectra.session import checkpoint_dir

#: Spark drops a query's shuffle files when it ends instead of waiting for the driver's garbage collector.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextmanager
def tidy_shuffles(spark: SparkSession):
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a re-run of what
    came before.  The files stay until the checkpoint folder is cleared.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


#: A table of at most so many counted rows may be sent to all executors; callers keep rows below about 100 bytes.
BROADCAST_ROWS = 1 << 20


def sent_if_small(df: DataFrame) -> DataFrame:
    """``df``, a saved table, marked for a broadcast join if its counted rows stay within the bound; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list, ``node, component``; every round is a saved table."""
    return graph.components(edges, a, b, keep=lambda df: saved(df, "edges"))


def let(value, body):
    """``body(value)`` with ``value`` evaluated once: a column named inside a lambda would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Matches that are placed together; keeps the work linear in a text's matches.
BLOCK = 64


def spans(text, pattern: str):
    """``array<struct<start,end,hit>>`` of the leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between the matches and the matches themselves give the
    positions; both come from the same regular expression engine.
    """
    piece_lengths = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    paired = F.filter(F.zip_with(piece_lengths, hits, lambda n, hit: F.struct(n.alias("gap"), hit.alias("hit"))), lambda x: x["hit"].isNotNull())
    kind = "array<struct<start:int,end:int,hit:string>>"

    def place(acc, x):
        s = acc["at"] + x["gap"]
        one = F.array(F.struct(s.alias("start"), (s + F.length(x["hit"])).alias("end"), x["hit"].alias("hit")))
        return F.struct((s + F.length(x["hit"])).alias("at"), F.concat(acc["found"], one).alias("found"))

    def place_block(acc, block):
        placed = F.aggregate(block, F.struct(acc["at"].alias("at"), F.expr(f"cast(array() as {kind})").alias("found")), place)
        return let(placed, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["blocks"], F.array(p["found"])).alias("blocks")))

    def whole(all_hits):
        blocks = F.transform(F.sequence(F.lit(1), F.size(all_hits), F.lit(BLOCK)), lambda i: F.slice(all_hits, i, BLOCK))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("blocks"))
        placed = F.aggregate(blocks, start, place_block, lambda acc: F.flatten(acc["blocks"]))
        return F.when(F.size(all_hits) > 0, placed).otherwise(F.expr(f"cast(array() as {kind})"))

    return let(paired, whole)
