"""The registered queries of this subpackage: each applies one operator, with production settings, to its whole table."""

from __future__ import annotations

import hashlib

import pandas as pd
import public_tokenizers
from pyspark.sql import Column
from pyspark.sql import functions as F

from aspectra.llm import decontam, dialogue, langmix, oracles, packing, pii, quality, secretscan, sharding, simhash, suffixdedup, urlfilter, variants, vecgraph
from aspectra.llm.common import read


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _digest(found, base: tuple[str, ...]):
    def of(kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(listed(of(base)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id", "kept")


def op2_suffix_dedup(spark, sf_dir):
    found = suffixdedup.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_vector_dedup(spark, sf_dir):
    return vecgraph.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_decontamination(spark, sf_dir):
    found = decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op5_language_mixture(spark, sf_dir):
    return langmix.identify(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op6_sharding(spark, sf_dir):
    found = sharding.balanced_shards(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_packing(spark, sf_dir):
    found = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_pii(spark, sf_dir):
    return _digest(pii.find(read(spark, sf_dir, "documents")), pii.BASE)


def op9_url_filter(spark, sf_dir):
    found = urlfilter.judge(read(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def op10_secret_scan(spark, sf_dir):
    return _digest(secretscan.find(read(spark, sf_dir, "documents")), tuple(r.kind for r in secretscan.BASE))


def op11_spelling_variants(spark, sf_dir):
    return variants.group_variants(variants.dictionary(read(spark, sf_dir, "documents"), typo_every=199))


def _hashed_lines(frames):
    """SHA-256 of each conversation's lines, which come in order; a digest is sequential, but no conversation is held."""
    conv, digest = None, None
    for frame in frames:
        out = []
        for name, line in zip(frame["conv"], frame["line"], strict=True):
            if digest is None or name != conv:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = name, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
    if digest is not None:
        yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "repaired_sha256"])


def op12_conversation_repair(spark, sf_dir, segment_rows: int = dialogue.SEGMENT_ROWS):
    turns = read(spark, sf_dir, "conversations")
    found = dialogue.repair(dialogue.damaged(turns), segment_rows=segment_rows)
    lines = found.edits.where("edit != 'D'").select(F.col("conv_id").cast("string").alias("conv"), "part", "seg", "at", F.concat_ws(":", "role", "text").alias("line"))
    in_order = lines.repartition("conv").sortWithinPartitions("conv", "part", "seg", "at")
    hashed = in_order.select("conv", "line").mapInPandas(_hashed_lines, "conv string, repaired_sha256 string")
    all_ids = turns.select("conv_id").distinct()
    facts = found.conversations.withColumnRenamed("conv_id", "found_id")
    rows = all_ids.join(facts, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").join(hashed, F.col("conv_id").cast("string").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def op13_quality_rules(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return quality.judge(read(spark, sf_dir, "documents"), labels.where("quality = 1 and toxic = 0"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_language_mixture": op5_language_mixture,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_url_filter": op9_url_filter,
    "op10_secret_scan": op10_secret_scan,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_quality_rules": op13_quality_rules,
}

#: The others learn, search or tokenize, or need checksums that SQL lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op2_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op4_decontamination": oracles.DECONTAMINATION,
    "op8_pii": oracles.personal_data(),
    "op10_secret_scan": oracles.secret_scan(),
}
