"""Lexical retrieval packing: windows filled with a seed document and its nearest unused neighbours.

Texts become token ids once; the ids are the terms of the index.  Document
counts, inverse frequencies and the mean length are taken over all documents (a
table no longer than the vocabulary).  Each document gets a signature, the terms
that win a weighted min-wise hash under its BM25 weights, and documents are
range-partitioned by it, so that lexical neighbours of the whole corpus come to
stand side by side wherever they were read.  Along that order they are gathered
into index shards of ``shard_docs`` documents or ``shard_ids`` token ids,
whichever comes first.  A shard holds the BM25 inverted index of its documents.
The next unused document seeds a window; the index returns its best-scoring
unused neighbours, which fill the window in turn.  The one that no longer fits
is cut, and its rest stays in the shard, so every window but a shard's last is
full.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aspectra.llm.common import saved

#: How byte-level BPE vocabularies of this family split a text before merging (fixed value).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: The same without look-ahead or possessive repeats, for texts in which no two white-space characters meet; it splits in about three quarters of the time.
SIMPLE_PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""
#: BM25's usual saturation and length normalisation.
K1, B = 1.2, 0.75
#: Texts with a longer run without white space go to the tokenizer itself, whose merging stays fast on them.
LONG_RUN = 1000
LONG = re.compile(rf"\S{{{LONG_RUN + 1}}}")
HARD = re.compile(rf"\s\s|\S{{{LONG_RUN + 1}}}")
#: Terms of a signature, the strongest first.
SIGNATURE = 8
#: Token ids that one task lays side by side, and rows a task that bounds between tasks are drawn from.
IDS_PER_TASK, SAMPLED = 1 << 22, 64


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a text, as the tokenizer file at ``path`` gives them.

    A byte-level BPE vocabulary numbers its merges by rank, so its ids are made by
    the faster rank-based encoder; texts with the vocabulary's added tokens or
    with very long runs are encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte = byte_alphabet()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in self.added}
        self.fast = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.simple = tiktoken.Encoding("simple", pat_str=SIMPLE_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        if any(t in text for t in self.added):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        found = HARD.search(text)
        if found is None:
            return self.simple(text)
        if LONG.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def little_endian(numbers: array) -> bytes:
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def narrow(ids: list[int]) -> bytes:
    """Ids in little-endian unsigned 16-bit if all fit, else 32-bit; their count tells which."""
    try:
        return little_endian(array("H", ids))
    except OverflowError:
        return little_endian(array("I", ids))


def widen(packed: bytes, count: int) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u2" if len(packed) == 2 * count else "<u4")


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and how often each occurs."""
    ids = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, dtype=np.int64)
    return ids[first].astype(np.int64), np.diff(np.append(first, len(ids)))


class Corpus:
    """What BM25 knows of all documents: the inverse frequency of each term and the mean length."""

    def __init__(self, docs: int, length: int, found_in: dict[int, int]):
        self.mean = max(1.0, length / max(1, docs))
        n = np.zeros(max(found_in, default=0) + 1)
        n[list(found_in)] = list(found_in.values())
        # a term of one document points nowhere, one of most documents has no positive weight
        self.idf = np.where(n > 1, np.maximum(0.0, np.log((docs - n + 0.5) / (n + 0.5))), 0.0)
        # a number of (0, 1) for each term, the same in every task
        mixed = (np.arange(len(n), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        self.log_draw = np.log(((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)

    def weights(self, terms: np.ndarray, tf: np.ndarray, length) -> np.ndarray:
        """BM25 weight of terms that occur ``tf`` times in a document of ``length`` ids."""
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def signature(self, terms: np.ndarray, tf: np.ndarray) -> bytes:
        """The terms that win the weighted draw, the winner first, in bytes that sort as the terms do.

        Two documents share the winner with the chance that grows with the
        weight they have in common.
        """
        weight = self.weights(terms, tf, int(tf.sum()))
        some = np.flatnonzero(weight > 0)
        order = np.lexsort((terms[some], -self.log_draw[terms[some]] / weight[some]))[:SIGNATURE]
        return terms[some][order].astype(">u4").tobytes()


class Shard:
    """An inverted index of the BM25 weights of a few documents; the statistics are the whole corpus's."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], corpus: Corpus):
        self.docs = len(bags)
        owner = np.repeat(np.arange(self.docs), [len(terms) for terms, _ in bags])
        length = np.array([tf.sum() for _, tf in bags], dtype=np.int64)
        terms, tf = np.concatenate([t for t, _ in bags]), np.concatenate([n for _, n in bags])
        weight = corpus.weights(terms, tf, length[owner])
        # documents are in order, so a stable sort by term gives postings by term, then document
        order = np.flatnonzero(weight > 0)
        order = order[np.argsort(terms[order], kind="stable")]
        distinct, term = np.unique(terms[order], return_inverse=True)
        self.owner, self.weight = owner[order], weight[order]
        self.start = np.searchsorted(term, np.arange(len(distinct) + 1))
        by_doc = np.argsort(self.owner, kind="stable")
        self.queries = np.split(term[by_doc], np.cumsum(np.bincount(self.owner, minlength=self.docs))[:-1])

    def scores(self, doc: int) -> np.ndarray:
        """BM25 score of every document of the shard for all terms of ``doc``."""
        q = self.queries[doc]
        first, n = self.start[q], self.start[q + 1] - self.start[q]
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.bincount(self.owner[at], weights=self.weight[at], minlength=self.docs)


def pack_shard(lengths: list[int], index: Shard, window: int):
    """Yields windows: lists of ``(document, start, length)``; every position of every document lies in exactly one."""
    begun = np.zeros(len(lengths), dtype=np.int64)
    left = np.array(lengths, dtype=np.int64)
    for d in np.flatnonzero(left >= window):
        for _ in range(left[d] // window):
            yield [(int(d), int(begun[d]), window)]
            begun[d] += window
            left[d] -= window
    unused = left > 0
    for seed in range(len(lengths)):
        if not unused[seed]:
            continue
        filled, room, scores, member = [], window, None, seed
        while member is not None:
            take = int(min(room, left[member]))
            filled.append((int(member), int(begun[member]), take))
            begun[member] += take
            left[member] -= take
            room -= take
            unused[member] = left[member] > 0
            if not room:
                break
            if scores is None:
                scores = index.scores(seed)
            best = int(np.argmax(np.where(unused, scores, -1.0)))
            member = best if unused[best] else None
        yield filled


def tokenized(rows: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``doc_id, row, size, ids, terms, tf`` per document (``row`` is unique), and per task one row of ``seen`` and ``found_in``: in how many of its documents each term occurs."""

    def batches(frames):
        encode = encoder(tokenizer_path).encode
        row = TaskContext.get().partitionId() << 32
        found_in = np.zeros(0, dtype=np.int64)
        for frame in frames:
            out = []
            bags = []
            for text in frame["text"]:
                ids = encode(text or "")
                ids.append(end_id)
                packed = narrow(ids)
                terms, tf = counted(widen(packed, len(ids))[:-1])
                bags.append(terms)
                out.append((row, len(ids), packed, terms.astype("<u4").tobytes(), tf.astype("<u4").tobytes()))
                row += 1
            if out:
                here = np.bincount(np.concatenate(bags), minlength=len(found_in))
                here[: len(found_in)] += found_in
                found_in = here
                got = pd.DataFrame(out, columns=["row", "size", "ids", "terms", "tf"])
                yield got.assign(doc_id=frame["doc_id"].astype("Int64").to_numpy(), seen=None, found_in=None).astype({"doc_id": "Int64"})
        seen = np.flatnonzero(found_in)
        last = pd.DataFrame({"row": [-1], "size": [0], "ids": [b""], "terms": [b""], "tf": [b""], "seen": [seen.astype(np.int32)], "found_in": [found_in[seen]]})
        yield last.assign(doc_id=pd.array([pd.NA], dtype="Int64"))

    return rows.mapInPandas(batches, "doc_id long, row long, size long, ids binary, terms binary, tf binary, seen array<int>, found_in array<long>")


def statistics(tokens: DataFrame) -> tuple[Corpus, int]:
    """The corpus's BM25 statistics and its number of token ids; what comes to the driver is no longer than the vocabulary."""
    docs, ids = tokens.where("row >= 0").agg(F.count("row"), F.coalesce(F.sum("size"), F.lit(0))).first()
    counts = tokens.where("row < 0").select(F.explode(F.arrays_zip("seen", "found_in")).alias("x")).groupBy("x.seen").agg(F.sum("x.found_in").alias("n"))
    return Corpus(docs, ids - docs, {r["seen"]: r["n"] for r in counts.collect()}), ids


def bag(terms: bytes, tf: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(terms, dtype="<u4").astype(np.int64), np.frombuffer(tf, dtype="<u4").astype(np.int64)


def laid_out(tokens: DataFrame, corpus: Corpus, tasks: int) -> DataFrame:
    """The documents by signature, then row, in ``tasks`` ranges of that order; equal signatures are split between rows.

    The bounds come from about ``SAMPLED`` documents a task; they decide how even
    the tasks are and where shards begin.
    """
    docs = tokens.where("row >= 0").select("doc_id", "row", "size", "ids", "terms", "tf")

    def signatures(frames):
        for frame in frames:
            keys = [corpus.signature(*bag(terms, tf)) for terms, tf in zip(frame["terms"], frame["tf"], strict=True)]
            yield pd.DataFrame({"signature": keys, "row": frame["row"]})

    bounds = []
    if tasks > 1:
        share = min(1.0, SAMPLED * tasks / max(1, docs.count()))
        sample = docs.sample(share, seed=1).select("row", "terms", "tf").mapInPandas(signatures, "signature binary, row long").collect()
        keys = sorted((bytes(r["signature"]), r["row"]) for r in sample)
        bounds = [keys[len(keys) * i // tasks] for i in range(1, tasks)] if keys else []

    def dealt(frames):
        for frame in frames:
            keys = [corpus.signature(*bag(terms, tf)) for terms, tf in zip(frame["terms"], frame["tf"], strict=True)]
            tasks_of = [bisect_right(bounds, key) for key in zip(keys, frame["row"], strict=True)]
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"), signature=keys, task=tasks_of)

    rows = docs.mapInPandas(dealt, "doc_id long, row long, size long, ids binary, terms binary, tf binary, signature binary, task int")
    return rows.repartitionById(tasks, F.col("task")).sortWithinPartitions("signature", "row")


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, shard_docs: int = 512, shard_ids: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` per piece; ``ids`` are little-endian unsigned 32-bit.

    Each row of ``docs`` is one document of its token ids and ``end_id``; a null
    or empty text is that id alone.  Documents of a window or more fill windows
    of their own; their rests and the others are packed with their neighbours.
    Null ids and repeated rows are packed like any other row.  Equal scores go
    to the earlier row in the order of signatures, equal signatures stand in the
    order they were read in and are split over shards and tasks like others.  A
    window's number is unique in the result: the number of the task in the high
    bits, a counter in the low ones.  Extra columns are ignored; an empty table
    gives an empty result.
    """
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    tokens = saved(tokenized(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer_path, end_id), "pack-ids", compression="zstd")
    corpus, total = statistics(tokens)

    def pieces(ids, bags, doc_ids, number):
        sizes = [len(x) for x in ids]
        out = []
        for filled in pack_shard(sizes, Shard(bags, corpus), window):
            offset = 0
            for d, start, length in filled:
                out.append((doc_ids[d], start, length, sizes[d], number, offset, ids[d][start : start + length].astype("<u4").tobytes()))
                offset += length
            number += 1
            if len(out) >= 4000:
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"}), number
                out = []
        yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"}), number

    def batches(frames):
        number = TaskContext.get().partitionId() << 32
        ids, bags, doc_ids, held = [], [], [], 0
        for frame in frames:
            for doc_id, size, packed, terms, tf in zip(frame["doc_id"].astype("Int64"), frame["size"], frame["ids"], frame["terms"], frame["tf"], strict=True):
                ids.append(widen(packed, size))
                bags.append(bag(terms, tf))
                doc_ids.append(doc_id)
                held += size
                if len(ids) == shard_docs or held >= shard_ids:
                    for out, number in pieces(ids, bags, doc_ids, number):
                        yield out
                    ids, bags, doc_ids, held = [], [], [], 0
        if ids:
            for out, number in pieces(ids, bags, doc_ids, number):
                yield out

    laid = laid_out(tokens, corpus, total // IDS_PER_TASK + 1).select("doc_id", "size", "ids", "terms", "tf")
    return laid.mapInPandas(batches, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
