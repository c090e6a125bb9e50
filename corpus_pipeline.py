"""The corpus pipeline: language, near-duplicates, benchmark passages, secrets, then packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  Stages work on all rows their
predecessor kept and pass nulls, repeated rows and extra columns on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from aspectra.llm import decontam, langmix, packing, secretscan, simhash
from aspectra.llm.common import read, saved, text_or_empty

#: A document whose largest language has a smaller share is in no one language.
LEAST_SHARE = 0.5


def language(spark, docs, sf_dir):
    """Keeps documents in which a language is recognised and holds at least half of the words."""
    return langmix.recognised(docs, LEAST_SHARE)


def near_duplicates(spark, docs, sf_dir):
    """Keeps one document of each group of near-duplicates, the one of the smallest id; documents without an id stay."""
    found = simhash.near_duplicates(docs)
    dropped = found.where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark, docs, sf_dir):
    """Drops documents that hold too many words of benchmark windows.

    Each row is judged by its own text: a contaminated row without an id goes, a
    clean row that shares its id with a contaminated one stays.
    """
    found = decontam.contaminated(docs, read(spark, sf_dir, "benchmark"))
    dropped = found.where("contaminated").select(F.col("doc_id").alias("dropped_id"), F.sha2("text", 256).alias("dropped_text")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("dropped_id")) & (F.sha2(text_or_empty(), 256) == F.col("dropped_text"))
    return docs.join(dropped, same, "left_anti").select(docs.columns)


def secrets(spark, docs, sf_dir):
    """Keeps every document, with each secret replaced by its kind in brackets and ``n_chars`` counted again."""
    return secretscan.redacted(docs)


def pack(spark, docs, sf_dir):
    """Pieces of documents in token windows."""
    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("pack", pack),
]

#: The stages learn, search and tokenize; SQL cannot express them.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on ``documents``, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
