"""Quality verdicts from a log-likelihood ratio of hashed n-grams.

Words and word pairs of every text are hashed into buckets.  Two multinomials
are counted over the whole table: the raw corpus (all documents) and the
trusted target (documents named as trusted).  A document's score is the mean
over its n-grams of ``log p_target / p_raw``.  The threshold is the score that
all but a stated share of the trusted documents reach, each of them judged by a
target model without its own counts.  Log ratios and scores are fixed-point
integers, so sums, bins and verdicts never depend on the order of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import saved

#: White space that parts words.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Hash buckets (a power of two); 16 bytes each are broadcast, and a task sends one row for each it met.
BUCKETS = 1 << 18
#: Log ratios are whole multiples of 1 / SCALE, thresholds of 1 / BINS.
SCALE, BINS = 1 << 20, 1 << 10
#: Weight of the raw distribution in the target's, in n-grams.
PRIOR = 1 << 12
#: Characters of text that are taken apart together in a task (one document at least).
TOGETHER = 1 << 20

#: Bits of the filter of trusted names: so many per name, and so many at most (32 MB are broadcast).
NAME_BITS, MOST_BITS = 8, 1 << 28

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _chunks(frame: pd.DataFrame):
    """Pieces of a batch whose texts hold about ``TOGETHER`` characters."""
    ends = np.cumsum([len(t) for t in frame["text"]]) // TOGETHER
    for _, part in frame.groupby(ends, sort=True):
        yield part


def take_apart(texts) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Counts per text, and the hash and the text's number of every word and every pair of neighbouring words."""
    words = [t.encode().split() for t in texts]  # bytes: parts at ASCII white space only
    n = np.array([len(w) for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), n)
    flat = np.empty(len(owner), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    code, distinct = pd.factorize(flat)
    own_hash = pd.util.hash_array(distinct, categorize=False)[code] if len(flat) else np.zeros(0, dtype=np.uint64)
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    pair_hash = (own_hash[pairs] * np.uint64(0x9E3779B97F4A7C15)) ^ (own_hash[pairs + 1] + np.uint64(0x165667B19E3779F9))
    pair_hash *= np.uint64(0xC2B2AE3D27D4EB4F)

    repeats = np.zeros(len(flat), dtype=bool)
    windows = np.flatnonzero(owner[2:] == owner[:-2])
    if len(windows):
        size = np.int64(len(distinct))
        two = pd.factorize(code[windows] * size + code[windows + 1])[0]
        three = pd.factorize(two * size + code[windows + 2])[0]
        ours = pd.factorize(owner[windows] * np.int64(three.max() + 1) + three)[0]
        again = windows[np.bincount(ours)[ours] > 1]
        for k in range(3):
            repeats[again + k] = True
    lines = [[x for x in t.split("\n") if x.strip(SPACE)] for t in texts]
    counts = {
        "n_words": n,
        "word_chars": np.array([len(t) - sum(map(t.count, SPACE)) for t in texts], dtype=np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], dtype=np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": np.bincount(owner, weights=repeats, minlength=len(words)).astype(np.int64),
    }
    return counts, np.concatenate([own_hash, pair_hash]), np.concatenate([owner, owner[pairs]])


def buckets_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def base_failed(counts) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def count_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n``: n-grams of all texts."""

    def batches(frames):
        n = np.zeros(buckets, dtype=np.int64)
        for frame in frames:
            for part in _chunks(frame):
                _, hashes, _ = take_apart(part["text"].tolist())
                n += np.bincount(buckets_of(hashes, buckets), minlength=buckets)
        used = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": used.astype(np.int32), "n": n[used]})

    return docs.select("text").mapInPandas(batches, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _held(counts: DataFrame, buckets: int, name: str) -> np.ndarray:
    table = saved(counts, name).toPandas()  # a row a bucket at most
    held = np.zeros(buckets, dtype=np.int64)
    held[table["bucket"]] = table["n"]
    return held


def _likely(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``doc_id`` is not in ``names``: a bit is set for the hash of every name.

    No named row is lost; of the others at most about one in eight stays while the bits suffice for the names."""
    if rows.schema["doc_id"].dataType != names.schema["doc_id"].dataType:
        return rows  # the hash of a value depends on its type
    bits = 1 << 15
    while bits < min(NAME_BITS * names.count(), MOST_BITS):
        bits *= 2
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    bitmap = names.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bitmap), "_bucket")  # 4 KB for 2^15 bits
    return found.where(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1).select(*rows.columns)


def ratios(raw: np.ndarray, target: np.ndarray, raw_all: int, target_all: int) -> np.ndarray:
    """Fixed-point ``log p_target / p_raw`` of buckets; the target is smoothed by ``PRIOR`` n-grams drawn from the raw corpus."""
    p = np.maximum(raw, 1) / raw_all
    q = (target + PRIOR * p) / (target_all + PRIOR)
    return np.rint(np.log(q / p) * SCALE).astype(np.int64)


def _scores(at, owner, docs: int, raw, target, raw_all: int, target_all: int, leave_out: bool) -> np.ndarray:
    """Sums of log ratios per document; with ``leave_out`` each is judged by a target without its own n-grams."""
    if not leave_out:
        weight = ratios(raw, target, raw_all, target_all)[at]
        held = np.ones(len(at), dtype=np.int64)
    else:
        key, held = np.unique(owner * np.int64(len(raw)) + at, return_counts=True)
        owner, at = key // len(raw), key % len(raw)
        own = np.bincount(owner, weights=held, minlength=docs).astype(np.int64)
        weight = ratios(raw[at], target[at] - held, raw_all, target_all - own[owner])
    sums = np.zeros(docs, dtype=np.int64)
    np.add.at(sums, owner, weight * held)
    return sums


def judge(docs: DataFrame, trusted: DataFrame, lost_share: float = 0.005, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, threshold, kept`` per row of ``docs``.

    ``trusted`` names the target's documents in its column ``id_col`` (null and
    repeated ids count once or not at all).  Words are runs without ASCII white
    space; ``n_repeat_words`` counts words inside 3-word windows that the text
    holds at least twice.  ``base_failed``: under 50 words, or more than half of
    them repeated so.  ``score`` is the mean log ratio over words and pairs of
    neighbouring words, null without words.  A document is kept if it did not
    fail and its score reaches the threshold, which ``lost_share`` of the
    trusted documents that did not fail may miss at most.  Without such a
    document there is no threshold (null) and only the base rules decide.  A
    null text counts as empty; rows without an id, repeated rows and ties are
    judged each by its text; extra columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    names = saved(trusted.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id")).distinct(), "quality-names")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # every trusted document trains the target; only texts that pass the filter are shuffled, and the join is exact
    # (names are distinct, so an inner join keeps each row once; Spark would move a semi join below the filter)
    target_texts = saved(_likely(rows, names).join(names.hint("shuffle_hash"), "doc_id").select("text"), "quality-trusted")
    raw, target = _held(count_buckets(rows, buckets), buckets, "quality-raw"), _held(count_buckets(target_texts, buckets), buckets, "quality-target")
    raw_all, target_all = max(1, int(raw.sum())), int(target.sum())
    shared = spark.sparkContext.broadcast((raw, target))

    def bins(frames):
        """Bins of the trusted documents' scores."""
        raw, target = shared.value
        for frame in frames:
            for part in _chunks(frame):
                counts, hashes, owner = take_apart(part["text"].tolist())
                sums = _scores(buckets_of(hashes, buckets), owner, len(part), raw, target, raw_all, target_all, True)
                grams = np.bincount(owner, minlength=len(part))
                good = ~base_failed(counts)
                yield pd.DataFrame({"bin": np.floor_divide(sums[good], grams[good] * (SCALE // BINS))})

    least = None
    if target_all:
        spread = target_texts.mapInPandas(bins, "bin long").groupBy("bin").count().sort("bin").toPandas()  # log ratios are bounded, so bins are
        if len(spread):
            at = np.searchsorted(np.cumsum(spread["count"]), int(lost_share * spread["count"].sum()), side="right")
            least = int(spread["bin"].iloc[at])
    threshold = None if least is None else least / BINS

    def verdicts(frames):
        raw, target = shared.value
        for frame in frames:
            for part in _chunks(frame):
                counts, hashes, owner = take_apart(part["text"].tolist())
                sums = _scores(buckets_of(hashes, buckets), owner, len(part), raw, target, raw_all, max(target_all, 1), False)
                grams = np.bincount(owner, minlength=len(part))
                failed = base_failed(counts)
                enough = np.ones(len(part), dtype=bool) if least is None else sums >= least * (SCALE // BINS) * grams
                score = pd.Series(np.where(grams > 0, sums / (np.maximum(grams, 1) * SCALE), 0.0)).astype(object).where(grams > 0, None)
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"].to_numpy(), **{c: counts[c] for c in COUNTS}, "base_failed": failed, "score": score, "kept": ~failed & enough}
                )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    judged = rows.mapInPandas(verdicts, schema)
    return judged.select("doc_id", *COUNTS, "base_failed", "score", F.lit(threshold).cast("double").alias("threshold"), "kept")
