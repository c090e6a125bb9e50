"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components.

A fingerprint is cut into ``blocks`` pieces.  Two fingerprints that differ in
at most ``max_bits`` bits agree on at least ``blocks - max_bits`` pieces, so
they share a key in one of the combinations of so many pieces: an equi-join on
these keys finds every close pair, and the Hamming distance verifies it.

A key that more than ``bucket`` distinct fingerprints share (one template with
thousands of edits) would emit all its pairs.  Its members take an exact other
way: each fingerprint names the values at most ``max_bits / 2`` flips away, and
two fingerprints name a common value exactly if they are close, so linking the
members of each value to its hub keeps every component.  No pair is dropped.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import components, saved

BITS = 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles whose bits are counted in one piece; bounds the memory of a very long text.
COUNTED = 1 << 14


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, repeats counted; 0 without words.

    A-Z are lower-cased, words are runs of other than ASCII white space, and a
    text of fewer words than a shingle is one shingle.
    """
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles, n = [b" ".join(words)], 1
    else:
        n = len(words) - shingle_words + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, COUNTED):
        part = hashes[i : i + COUNTED].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long); one row per row of ``docs``."""

    def batches(frames):
        for frame in frames:
            values = [fingerprint(t, shingle_words, seed) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": np.array(values, dtype="<u8").view("<i8")})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(batches, "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """The bits of each combination of ``blocks - max_bits`` blocks, as signed longs."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    piece = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [_signed(sum(piece[i] for i in kept)) for kept in combinations(range(blocks), blocks - max_bits)]


def close_links(fps: DataFrame, max_bits: int = 2, blocks: int = 5, bucket: int = 32) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that keep the components of "at most ``max_bits`` bits apart".

    Every returned pair is verified; pairs inside an oversized bucket may be
    replaced by a path of verified pairs.
    """
    keys = fps.select(
        "fp",
        F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(block_masks(max_bits, blocks))))).alias("k"),
    ).select("fp", "k.part", "k.key")
    sizes = keys.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = saved(keys.join(sizes, ["part", "key"]), "simhash-blocks")

    small = shared.where(F.col("n") <= bucket).drop("n")
    pairs = (
        small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), ["part", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
        .select("a", "b")
    )

    near, far = max_bits // 2, (max_bits + 1) // 2
    flips = [(n, _signed(sum(1 << i for i in at))) for n in range(far + 1) for at in combinations(range(BITS), n)]
    crowded = shared.where(F.col("n") > bucket).select("fp").distinct()
    named = crowded.select("fp", F.explode(F.array(*(F.struct(F.lit(n).alias("flips"), F.col("fp").bitwiseXOR(F.lit(m)).alias("value")) for n, m in flips))).alias("v"))
    # at most one fingerprint per flip pattern names a value, so a set here is bounded by the number of patterns
    stars = (
        named.groupBy("v.value")
        .agg(F.min(F.when(F.col("v.flips") <= near, F.col("fp"))).alias("a"), F.collect_set("fp").alias("members"))
        .where(F.col("a").isNotNull() & (F.size("members") > 1))
        .select("a", F.explode("members").alias("b")).where("a != b")
    )
    return pairs.unionByName(stars)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2, seed: int = 42, blocks: int = 5, bucket: int = 32
) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id, kept`` per row of ``docs``.

    ``component_id`` is the smallest id reachable over links, ``kept`` marks the
    row that carries it.  Null and wordless texts have fingerprint 0 and link
    like any other.  A row with a null id is fingerprinted, links to nothing and
    has a null component.  Repeated rows with one id stay as many rows of one
    component.  Extra columns are ignored; an empty table gives an empty result.
    """
    rows = saved(fingerprints(docs, id_col, text_col, shingle_words, seed), "simhash")
    reps = saved(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    links = close_links(reps.select("fp"), max_bits, blocks, bucket)
    by_fp = components(links).withColumnRenamed("node", "fp")
    rooted = reps.join(by_fp, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    out = rows.join(classes, "fp", "left")
    return out.select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        (F.col("doc_id") == F.col("component_id")).alias("kept"),
    )
