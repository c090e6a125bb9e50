"""Operators 11 to 13 against brute force, on edge cases and on a whole small table."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.llm import dialogue, quality, queries, variants, vecgraph

SF = "/root/testdata/sf0.001"


def quality_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    held = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if held[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 5000 else len(lines) - len(set(lines))
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed


def test_quality_base_counts(spark):
    got = queries.op13_quality_rules(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_base(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_quality_scores_match_plain_model(spark):
    """The ratio of two multinomials, their counts in plain dictionaries, and the threshold by leaving each trusted text out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    buckets = 1 << 16
    grams = {}
    for r in docs.collect():
        _, hashes, _ = quality.take_apart([r.text or ""])
        grams[r.doc_id] = Counter(int(h) >> 48 for h in hashes)
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in trusted:
            target.update(g)
    everything, trust = raw.total(), target.total()

    def score(g, out):
        p = {b: raw[b] / everything for b in g}
        own = out.total()
        total = sum(n * round(math.log((target[b] - out[b] + quality.PRIOR * p[b]) / (trust - own + quality.PRIOR) / p[b]) * quality.SCALE) for b, n in g.items())
        return total / quality.SCALE / g.total()

    good = sorted(score(grams[i], grams[i]) for i in trusted if i in grams and not quality_base(docs.where(F.col("doc_id") == i).first().text)[-1])
    got = quality.judge(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), lost_share=0.1, buckets=buckets).collect()
    for r in got:
        if grams[r.doc_id]:
            assert r.score == pytest.approx(score(grams[r.doc_id], Counter()), abs=1e-5)
        assert r.kept == (not r.base_failed and r.score >= r.threshold)
    assert good[int(0.1 * len(good))] - 2 / quality.BINS <= got[0].threshold <= good[int(0.1 * len(good))] + 1e-5


def test_quality_tells_the_target_from_the_rest(spark):
    rng = np.random.default_rng(3)

    def text(prefix):
        return " ".join(f"{prefix}{k}" for k in rng.integers(0, 400, 120))

    rows = [(i, text("good") if i % 2 else text("bad")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(1, 200, 2)], "doc_id long")
    got = {r.doc_id: r.kept for r in quality.judge(docs, trusted).collect()}
    held = [i for i in got if i >= 200]
    assert sum(got[i] for i in held if i % 2) >= 95 and not any(got[i] for i in held if i % 2 == 0)


def test_quality_trains_on_every_trusted_document(spark, monkeypatch):
    """No bound on the trusted documents: more names than any fixed number give the model of all of them."""
    monkeypatch.setattr(quality, "TRUSTED_ROWS", 5, raising=False)
    docs = spark.createDataFrame([(i, " ".join(f"word{(i * 7 + j) % (90 if i % 2 else 45)}" for j in range(60))) for i in range(60)], "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in [*range(0, 60, 2), 0, 2, None, 999]], "doc_id long")
    got = quality.judge(docs, trusted, buckets=1 << 8).collect()
    raw, target = np.zeros(1 << 8, dtype=np.int64), np.zeros(1 << 8, dtype=np.int64)
    for r in docs.collect():
        held = np.bincount(quality.buckets_of(quality.take_apart([r.text])[1], 1 << 8), minlength=1 << 8)
        raw += held
        target += held * (r.doc_id % 2 == 0)
    weight = quality.ratios(raw, target, int(raw.sum()), int(target.sum()))
    for r in got:
        text = " ".join(f"word{(r.doc_id * 7 + j) % (90 if r.doc_id % 2 else 45)}" for j in range(60))
        at = quality.buckets_of(quality.take_apart([text])[1], 1 << 8)
        assert r.score == weight[at].sum() / (len(at) * quality.SCALE)


def test_quality_edge_cases(spark, docs, empty, texts):
    trusted = spark.createDataFrame([(7,), (7,), (None,), (99,)], "doc_id long")
    got = quality.judge(docs, trusted).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars) for r in got) == Counter((i, *quality_base(t)[:2]) for i, t in texts)
    assert all(r.score is None and r.base_failed and not r.kept for r in got if r.n_words == 0)
    assert {r.doc_id for r in got if r.kept} <= {7, 8}
    none = quality.judge(docs, trusted.limit(0)).collect()
    assert all(r.threshold is None and r.kept == (not r.base_failed) for r in none)
    assert quality.judge(empty, trusted).collect() == []


def brute_words(rows, typo_every=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typo_every and h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    out, forms = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if abs(len(v) - len(w)) < 2 and one_apart(v, w)]
        top = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = top if top is not None and counts[top] >= ratio * n else None
        out[w] = (n, len(near))
    found = set()
    for w, (n, near) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        found.add((w, forms[w], root, n, near, counts[forms[w]] if forms[w] else None))
    return found


def variant_rows(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_variants(brute_words([(r.doc_id, r.text) for r in docs.collect()]))
    got = variant_rows(queries.op11_spelling_variants(spark, SF))
    assert got == want and any(form for _, form, *_ in want)


@pytest.mark.parametrize("parts", [1, 7])
def test_variants_of_dense_words(spark, parts):
    """Words over three letters: runs of equal letters, shared borders, ties, chains of forms, symbols beyond the first plane."""
    rng = np.random.default_rng(parts)
    words = {"".join(rng.choice(list("ab\u00e9"), rng.integers(1, 7))) for _ in range(500)} | {"a" * k for k in range(1, 30)} | {"\U0001f600x", "\U0001f600\U0001f600x", "\uffffx"}
    counts = {w: int(5 ** rng.integers(0, 5)) for w in words}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = variant_rows(variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n int")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == brute_variants(counts)


def test_variants_number_one_trie(spark):
    words = ["a", "ab", "abc", "abd", "b", "ba", "bab", "c" * 3000, "c" * 2999 + "d"]
    rows = spark.createDataFrame([(w,) for w in words], "word string").repartition(4)
    paths = {r.word: r.path for r in variants.numbered(rows, "word", "path").collect()}
    nodes = {}
    for w, path in paths.items():
        assert len(path) == len(w) + 1
        for d, node in enumerate(path):
            assert nodes.setdefault(node, w[:d]) == w[:d]
    assert len(nodes) == len({w[:d] for w in words for d in range(len(w) + 1)})
    assert [w for w, _ in sorted(paths.items(), key=lambda x: x[1][-1])] == sorted(words)


def test_variants_edge_cases(spark, docs, empty, texts):
    """Null, empty and long texts, a null id, repeated rows and clashing columns."""
    want = brute_variants(brute_words(texts, 3))
    assert variant_rows(variants.group_variants(variants.dictionary(docs, typo_every=3))) == want
    assert variants.group_variants(variants.dictionary(empty, typo_every=3)).collect() == []
    with pytest.raises(ValueError):
        variants.group_variants(variants.dictionary(docs), ratio=1)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest_edits(rows):
    """(cost, audit, lines): rows are (role, text, fault); a search over all states with whole strings."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    wants = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    at = {"": (0, "", ())}

    def better(new, state, path):
        if state not in new or path[:2] < new[state][:2]:
            new[state] = path

    def inserted(at):
        for _ in range(3):
            for state, (cost, audit, lines) in list(at.items()):
                better(at, legal[state, wants[state][0]], (cost + 3, audit + "I", (*lines, wants[state] + ":")))
        return at

    at = inserted(at)
    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, lines) in at.items():
            better(new, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if (state, role[:1]) in legal:
                better(new, legal[state, role[:1]], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            want = wants[state]
            better(new, legal[state, want[0]], (cost + more + 3, audit + "R", (*lines, f"{want}:{text}")))
        at = inserted(new)
    return min(at[s] for s in ("", "a") if s in at)


def brute_repair(rows, ids):
    out = {}
    for conv in ids:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        cost, audit, lines = cheapest_edits(faulty)
        counts = [sum(f == k for *_, f in faulty) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows, folder, **settings):
    """op12 on ``rows``; every registered column but the id."""
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, what string, part int, audit string, digest string")
    frame.write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, folder, **settings).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def clash(rows):
    return [(*r, "x", 1, "y", "z") for r in rows]


def test_repair_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute_repair(brute_damage(rows), {r[0] for r in rows})
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in queries.op12_conversation_repair(spark, SF).collect()}
    assert got == want and len({c for v in want.values() for c in v[6]}) == 4


@pytest.mark.parametrize("segment", [dialogue.SEGMENT_ROWS, 3, 1])
def test_repair_of_hard_conversations(spark, segment, tmp_path):
    """Nulls, ties, repeated turns and rows, other roles, one conversation with a third of all rows, joined from many segments."""
    rng = np.random.default_rng(5)

    def one(conv, turn):
        role = [None, "user", "user", "assistant", "assistant", "system", "tool", ""][rng.integers(8)]
        text = [None, "", " \t", "So it is.", "and then", "Why?", f"Word {rng.integers(9)}.", f"cut {rng.integers(9)} "][rng.integers(8)]
        return conv, turn, role, text

    rows = [one(int(c), None if rng.random() < 0.1 else int(rng.integers(-3, 8))) for c in rng.integers(0, 80, 400)]
    rows += [one(1000, int(t)) for t in rng.integers(0, 150, 200)] + [one(None, int(t)) for t in rng.integers(0, 30, 20)]
    # two answers in a row, over and over: keeping either is as cheap
    rows += [(2000, t, ("user", "assistant", "assistant")[t % 3], f"Turn {t}.") for t in range(60)]
    want = brute_repair(brute_damage(rows), {r[0] for r in rows})
    assert repaired(spark, clash(rows), str(tmp_path), segment_rows=segment) == want


def test_repair_edge_cases(spark, tmp_path):
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256().hexdigest()
    assert repaired(spark, clash([(gone, 0, "user", "Hello.")]), str(tmp_path / "a")) == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}
    assert repaired(spark, [], str(tmp_path / "b")) == {}


@pytest.mark.parametrize("start", dialogue.STATES)
def test_survivors_hold_only_the_unresolved(start):
    """Edits leave the tree as soon as all survivors share them, and freed nodes are let go."""
    survivors = dialogue.Survivors(start)
    live = 0
    for k in range(3000):
        survivors.step(dialogue.MOVES["ua"[k % 2], False, k % 7 == 0])
        survivors.insert()
        if k % 50 == 49:
            survivors.resolved()
        live = max([live] + [n.depth - survivors.root.depth for _, n in survivors.at.values()])
    assert live < 200


def test_vectors_of_a_clump_larger_than_a_slice(spark):
    """Balls that are wholly linked, balls that are compared, ties and an id with two vectors; counts are exact where all pairs are found."""
    rng = np.random.default_rng(11)
    middle = rng.normal(size=12)
    wide = middle + 0.16 * rng.normal(size=(260, 12))
    tight = rng.normal(size=12) + 0.002 * rng.normal(size=(200, 12))
    x = np.concatenate([wide, tight, rng.normal(size=(150, 12))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (0, x[300].tolist())]
    got = vecgraph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), cell_rows=150, slice_rows=40).collect()
    assert len(got) == len(rows)
    degree = (sims >= 0.9).sum(axis=1) - 1
    by_id = {r.vec_id: r for r in got}
    # the copies of vector 300 under id 0 is one more link to each of its neighbours
    more = (sims[300] >= 0.9).astype(int)
    found = np.array([by_id[i].n_links for i in range(len(x))])
    want = degree + more
    want[0] = max(degree[0], degree[300] + 1)
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    assert all(by_id[i].n_links == want[i] for i in range(260, 460))
    assert by_id[0].component_id == 0 and by_id[300].component_id == 0


def test_compared_balls_count_every_link(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=8) + 0.3 * rng.normal(size=(60, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ball = rng.integers(0, 3, 60)
    covered = spark.createDataFrame([(i, int(b), bytearray(v.tobytes()), int(i % 3 + 1)) for i, (b, v) in enumerate(zip(ball, u))], "rep long, ball long, unit binary, copies long")
    pairs = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5)], "a long, b long, sim double")
    linked = u @ u.T >= 0.9
    copies = np.arange(60) % 3 + 1
    for chunk in (vecgraph.CHUNK_ROWS, 4):
        before, vecgraph.CHUNK_ROWS = vecgraph.CHUNK_ROWS, chunk
        try:
            counts, joined = vecgraph.compared(pairs, covered, 8, 0.9)
            got = {r.rep: r.others for r in counts.collect()}
        finally:
            vecgraph.CHUNK_ROWS = before
        met = {(0, 1), (1, 0), (0, 2), (2, 0)}
        want = {i: int(sum(copies[j] for j in range(60) if linked[i, j] and (ball[i], ball[j]) in met)) for i in range(60)}
        assert got == {i: n for i, n in want.items() if n}
        assert {tuple(r) for r in joined.collect()} == {(a, b) for a, b in ((0, 1), (0, 2)) if linked[np.ix_(ball == a, ball == b)].any()}


def test_quality_shuffles_few_texts_without_trust(spark, monkeypatch):
    """Every named row passes the filter of names, few others do; a filter too small for the names still loses none."""
    docs = spark.createDataFrame([(None if i == 7 else i, f"text {i}") for i in range(4000)], "doc_id long, text string")
    names = spark.createDataFrame([(i * 5,) for i in range(900)], "doc_id long")
    named = {i for i in range(0, 4000, 5)}
    passed = {r.doc_id for r in quality._likely(docs, names).collect()}
    assert named <= passed and len(passed - named) < 3200 / 8
    monkeypatch.setattr(quality, "MOST_BITS", 1 << 15)
    many = spark.range(0, 600_000, 5).withColumnRenamed("id", "doc_id")
    assert named <= {r.doc_id for r in quality._likely(docs, many).collect()}
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert named <= {int(r.doc_id) for r in quality._likely(texts, names.select(F.col("doc_id").cast("string"))).collect()}
    assert quality._likely(docs.select(F.col("doc_id").cast("int"), "text"), names).count() == 4000
