"""Structured Streaming entry points.

The reference processes files in batch only (no streaming, no state).  The same
DataFrame operators run unchanged on a streaming source; this module wires the
n-gram keyword counts (chain C) to ``readStream`` so a directory of arriving review
files keeps a running keyword table.  Counting is a plain streaming aggregation
(state = one row per keyword), checkpointed in the folder the caller names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra import lexicons as L
from aspectra.operators import ngrams as N


def keyword_counts_stream(spark: SparkSession, path: str, schema: str, key: str = "review_key",
                          text_col: str = "text", fmt: str = "parquet", **lexicons) -> DataFrame:
    """Streaming keyword occurrence counts: (ngram_type, keyword, frequency)."""
    src = spark.readStream.schema(schema).format(fmt).load(path)
    occ = N.ngram_occurrences(src, key, text_col,
                              lexicons.get("adjectives", L.HOTEL_ADJECTIVES), lexicons.get("nouns", L.HOTEL_NOUNS),
                              lexicons.get("stop", L.NGRAM_STOPWORDS), lexicons.get("irrelevant", L.IRRELEVANT_WORDS))
    return occ.groupBy("ngram_type", "keyword").agg(F.count(F.lit(1)).alias("frequency"))


def start_keyword_counts(stream: DataFrame, checkpoint: str, table: str):
    """Write the running counts to a table in complete mode; ``checkpoint`` must be a shared folder."""
    return (stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .toTable(table))
