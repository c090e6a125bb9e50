"""Exact repeated byte windows by a depth-limited most-significant-digit radix sort of suffixes.

Two suffixes matter only through their first ``threshold`` bytes: equal groups
at that depth are exactly the repeated windows.  Sorting every suffix would
shuffle a row per byte, so the first digit is read at synchronising positions
only: in every window the smallest hash of its ``digit``-byte strings marks an
*anchor*.  Equal windows hold equal anchors at equal offsets, so all windows are
reached from anchors, about one per ``(threshold - digit + 2) / 2`` bytes.

An anchor at position ``p`` stands for the windows that start at ``p - d`` for
``lo <= d <= hi`` (a *node*).  Their common bytes are the node's *core* and all
their bytes its *hull*; the widest node's core is the anchor's digit itself.

* equal hulls: all but the earliest occurrence are repeated in whole (removed);
* a core that only one hull has left: nothing in the node repeats (dropped);
* else the next digit is needed.  A group of at most ``local`` rows is sorted to
  full depth inside a task; a larger one is split again, one pass for half of
  the remaining depth, until hull and window coincide.

The earliest occurrence of every hull always stays in the sort, so each window
meets its first occurrence.  Every pass is a combined minimum or count per key
and a join back; no group of equal digits is gathered beyond ``local`` rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import saved

#: Bytes hashed in one vector operation; bounds the memory of a batch or a very long text.
SEGMENT = 1 << 20
#: Odd base of the rolling hash, its inverse, and the odd factor that mixes it (fixed values).
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93

U64 = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each run of ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[: len(values) - step], values[step:])
        done += step
    return values


class Anchors:
    """Finds anchors in a buffer: positions whose ``digit``-byte hash is the smallest of some window."""

    def __init__(self, threshold: int, digit: int):
        self.digit, self.width = digit, threshold - digit + 1
        room = SEGMENT + 4 * threshold
        self.up, self.down = _powers(BASE, room), _powers(pow(BASE, -1, 1 << 64), room)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        h = (sums[self.digit :] - sums[: -self.digit]) * self.down[: len(data) - self.digit + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        return h ^ (h >> np.uint64(29))

    def find(self, buffer: bytes) -> np.ndarray:
        data = np.frombuffer(buffer, dtype=np.uint8)
        margin, found = self.width + self.digit, []
        for at in range(0, len(data), SEGMENT):
            first = max(0, at - margin)
            h = self._hashes(data[first : at + SEGMENT + margin]) if len(data) - first >= self.digit else np.zeros(0, np.uint64)
            if len(h) < self.width:
                continue
            low = _slide(h, self.width, np.minimum)
            # a position is an anchor if the largest of the minima of the windows around it is its own hash
            around = _slide(np.concatenate([np.zeros(self.width - 1, np.uint64), low, np.zeros(self.width - 1, np.uint64)]), self.width, np.maximum)
            p = np.flatnonzero(h == around) + first
            found.append(p[(p >= at) & (p < at + SEGMENT)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _hull(text: bytes, p: int, lo: int, hi: int, threshold: int) -> tuple[int, int]:
    return max(0, p - hi), min(len(text), p - lo + threshold)


def _keys(text, p: int, lo: int, hi: int, threshold: int) -> tuple[int, int, int, int, int]:
    """Core hash, two halves of the hull hash, and the hull's ends.  A hull cut by an end of the text differs from a whole one."""
    start, end = _hull(text, p, lo, hi, threshold)
    core = xxhash.xxh3_64_intdigest(text[p - lo : p - hi + threshold])
    whole = xxhash.xxh3_128_intdigest(text[start:end], (p - start) * 1_000_003 + (end - p))
    return _long(core), _long(whole >> 64), _long(whole & U64), start, end


NODE = "core long, h1 long, h2 long, doc_id long, p int, start int, end int"


def anchors(docs: DataFrame, threshold: int, digit: int, with_hull: bool) -> DataFrame:
    """The widest node of every anchor that some window of its document holds: ``core`` alone, or all of ``NODE``."""
    span = threshold - digit

    def batches(frames):
        finder = Anchors(threshold, digit)
        for frame in frames:
            texts = [t.encode() for t in frame["text"]]
            ids = frame["doc_id"].to_numpy()
            buffer = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts])
            at = finder.find(buffer)
            row = np.searchsorted(ends, at, side="right")
            size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            p = at - (ends - size)[row]
            n = size[row]
            keep = (n >= threshold) & (p + digit <= n) & (np.maximum(0, p + threshold - n) <= np.minimum(span, p))
            at, row, p, n = at[keep], row[keep], p[keep], n[keep]
            for i in range(0, len(p), SEGMENT // 8):
                part = slice(i, i + SEGMENT // 8)
                starts = at[part].tolist()
                core = np.array([xxhash.xxh3_64_intdigest(buffer[s : s + digit]) for s in starts], dtype=np.uint64)
                if not with_hull:
                    yield pd.DataFrame({"core": core.view(np.int64)})
                    continue
                start, end = np.maximum(0, p[part] - span), np.minimum(n[part], p[part] + threshold)
                left, right = p[part] - start, end - p[part]
                seeds = (left * 1_000_003 + right).tolist()
                whole = b"".join(xxhash.xxh3_128_digest(buffer[s - a : s + b], seed) for s, a, b, seed in zip(starts, left.tolist(), right.tolist(), seeds, strict=True))
                halves = np.frombuffer(whole, dtype=">i8").astype(np.int64).reshape(-1, 2)
                yield pd.DataFrame(
                    {"core": core.view(np.int64), "h1": halves[:, 0], "h2": halves[:, 1], "doc_id": ids[row[part]], "p": p[part].astype(np.int32), "start": start.astype(np.int32), "end": end.astype(np.int32)}
                )

    return docs.mapInPandas(batches, NODE if with_hull else "core long")


def _resolve(nodes: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Repeated hulls of ``nodes`` (doc_id, start, end), and the first occurrence of each hull that shares its core, with the group's size."""
    first = nodes.groupBy(*key, "h1", "h2").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "p")).alias("rep"))
    covered = (
        nodes.join(first.where("copies > 1").drop("copies"), [*key, "h1", "h2"])
        .where((F.col("doc_id") != F.col("rep.doc_id")) | (F.col("p") != F.col("rep.p")))
        .select("doc_id", "start", "end")
    )
    reps = first.select(*key, "h1", "h2", "rep.doc_id", "rep.p")
    groups = reps.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return covered, reps.join(groups, key)


def _with_context(reps: DataFrame, docs: DataFrame, threshold: int, digit: int) -> DataFrame:
    """Adds the bytes around each anchor and how many of them stand before it."""
    span = threshold - digit
    wanted = reps.groupBy("doc_id").agg(F.collect_list(F.struct("core", "p", "n")).alias("at"))  # bounded by the document's own length
    names = ["lo", "hi", "core", "doc_id", "p", "n", "left", "context"]

    def batches(frames):
        for frame in frames:
            out = []
            for doc_id, text, at in zip(frame["doc_id"], frame["text"], frame["at"], strict=True):
                raw = text.encode()
                for x in at:
                    p = x["p"]
                    start, end = _hull(raw, p, 0, span, threshold)
                    out.append((0, span, x["core"], doc_id, p, x["n"], p - start, raw[start:end]))
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return docs.join(wanted, "doc_id").mapInPandas(batches, "lo int, hi int, core long, doc_id long, p int, n long, left int, context binary")


def _merged(ranges) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _windows(left: int, size: int, lo: int, hi: int, threshold: int) -> range:
    """Offsets d of the node's windows that lie inside the text."""
    return range(max(lo, left + threshold - size), min(hi, left) + 1)


def _local_sort(groups: DataFrame, threshold: int) -> DataFrame:
    """Sorts small groups of one core to full depth in their task; returns the repeated windows, merged per anchor."""

    def solve(rows):
        first: dict = {}
        for (lo, hi, _), doc_id, p, left, context in rows:
            for d in _windows(left, len(context), lo, hi, threshold):
                key = (d, context[left - d : left - d + threshold])
                if key not in first or (doc_id, p) < first[key]:
                    first[key] = (doc_id, p)
        for (lo, hi, _), doc_id, p, left, context in rows:
            hit = [
                (p - d, p - d + threshold)
                for d in _windows(left, len(context), lo, hi, threshold)
                if first[d, context[left - d : left - d + threshold]] != (doc_id, p)
            ]
            for s, e in _merged(hit):
                yield doc_id, s, e

    def batches(frames):
        group: list = []
        for frame in frames:
            out = []
            keys = zip(frame["lo"], frame["hi"], frame["core"], strict=True)
            for x in zip(keys, frame["doc_id"], frame["p"], frame["left"], frame["context"], strict=True):
                if group and group[0][0] != x[0]:
                    out += solve(group)
                    group = []
                group.append(x)
            yield pd.DataFrame(out, columns=["doc_id", "start", "end"])
        yield pd.DataFrame(list(solve(group)), columns=["doc_id", "start", "end"])

    rows = groups.select("lo", "hi", "core", "doc_id", "p", "left", "context")
    rows = rows.repartition("lo", "hi", "core").sortWithinPartitions("lo", "hi", "core")
    return rows.mapInPandas(batches, "doc_id long, start int, end int")


def _split(nodes: DataFrame, threshold: int) -> DataFrame:
    """Both halves of each node, with their cores and hulls."""

    def batches(frames):
        for frame in frames:
            out = []
            for doc_id, p, left, context, lo, hi in zip(frame["doc_id"], frame["p"], frame["left"], frame["context"], frame["lo"], frame["hi"], strict=True):
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    if a <= b and len(_windows(left, len(context), a, b, threshold)):
                        core, h1, h2, start, end = _keys(context, left, a, b, threshold)
                        out.append((a, b, core, h1, h2, doc_id, p, p - left + start, p - left + end, left, context))
            yield pd.DataFrame(out, columns=["lo", "hi", "core", "h1", "h2", "doc_id", "p", "start", "end", "left", "context"])

    return nodes.select("doc_id", "p", "left", "context", "lo", "hi").mapInPandas(batches, f"lo int, hi int, {NODE}, left int, context binary")


def repeated_ranges(docs: DataFrame, threshold: int = 100, digit: int = 36, local: int = 256) -> DataFrame:
    """``doc_id, start, end``: byte ranges that consist of windows which also start earlier; they may overlap.

    ``docs`` has ``doc_id`` (unique, not null) and ``text`` (not null).
    """
    long_enough = docs.where(F.octet_length("text") >= threshold)
    repeated = saved(anchors(long_enough, threshold, digit, False).groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "suffix-digit")
    nodes = saved(anchors(long_enough, threshold, digit, True).join(repeated, "core"), "suffix-nodes")
    covered, reps = _resolve(nodes, ["core"])
    parts = [saved(covered, "suffix-covered")]
    around = saved(_with_context(reps, long_enough, threshold, digit), "suffix-context")
    while True:
        parts.append(saved(_local_sort(around.where(F.col("n") <= local), threshold), "suffix-covered"))
        wide = around.where((F.col("n") > local) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        nodes = saved(_split(wide, threshold), "suffix-nodes")
        covered, reps = _resolve(nodes, ["lo", "hi", "core"])
        parts.append(saved(covered, "suffix-covered"))
        place = ["lo", "hi", "doc_id", "p"]
        around = saved(nodes.select(*place, "core", "left", "context").join(reps.select(*place, "n"), place), "suffix-context")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 100, digit: int = 36, local: int = 256) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, removed`` per row of ``docs``.

    ``kept`` holds the remaining UTF-8 bytes, ``removed`` the maximal removed
    ranges.  A byte goes if a ``threshold``-byte string that covers it starts
    earlier too: in a document of smaller id, or in the same one further left.
    A null text is empty.  Rows with a null id have no place in the order: they
    are kept whole and remove nothing.  Repeated rows of one id are one document,
    reported once per row.  Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = repeated_ranges(rows.where("doc_id is not null").dropDuplicates(["doc_id"]) if _repeats(rows) else rows.where("doc_id is not null"), threshold, digit, local)
    per_doc = ranges.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))

    def batches(frames):
        for frame in frames:
            out = []
            for doc_id, text, ranges in zip(frame["doc_id"], frame["text"], frame["ranges"], strict=True):
                raw = text.encode()
                cut = _merged((x["start"], x["end"]) for x in ranges) if ranges is not None else []
                kept, at = [], 0
                for s, e in cut:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                out.append((doc_id, len(raw), sum(e - s for s, e in cut), len(cut), b"".join(kept), [{"start": s, "end": e} for s, e in cut]))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])
            yield frame.astype({"doc_id": "Int64"})

    joined = rows.join(per_doc, "doc_id", "left").select("doc_id", "text", "ranges")
    return joined.mapInPandas(batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start:int,end:int>>")


def _repeats(rows: DataFrame) -> bool:
    """Whether some id stands in several rows."""
    return not rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
