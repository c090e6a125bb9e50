"""Vectors, URLs and the pipeline against brute force."""

import math
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

import corpus_pipeline
from aspectra.llm import common, queries, urlfilter, vecgraph

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def clumps(spark):
    """Near copies in clumps of different sizes, exact and scaled copies, and lone vectors."""
    rng = np.random.default_rng(5)
    lone = rng.normal(size=(700, 16))
    parts = [lone] + [lone[i] + 0.08 * rng.normal(size=(n, 16)) for i, n in ((0, 150), (1, 30), (2, 2))] + [lone[:5], 4.0 * lone[5:10]]
    x = np.concatenate(parts)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def true_links(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= threshold, 1))
    return set(zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("settings", [{}, {"cell_rows": 100, "slice_rows": 60}])
def test_vectors_reach_recall(clumps, settings):
    x, frame = clumps
    links = true_links(x)
    got = {r.vec_id: r for r in vecgraph.near_duplicates(frame, **settings).collect()}
    degree = Counter(i for pair in links for i in pair)
    assert sorted(got) == list(range(len(x)))
    assert all(r.n_links <= degree[i] for i, r in got.items())  # nothing below the threshold
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * len(links)
    want = brute.components(range(len(x)), links)
    assert np.mean([got[i].component_id == want[i] for i in got]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_audit_sees_small_groups_and_rare_links(spark):
    """All links of a large clump are held and those of lone pairs are not; then few pairs among many vectors; then no link."""
    rng = np.random.default_rng(7)
    lone = rng.normal(size=(3000, 32))
    clump = rng.normal(size=32) + 0.01 * rng.normal(size=(300, 32))

    def judged(x, held):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        reps = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(u)], "rep long, unit binary").repartition(3)
        return vecgraph.audit(reps, spark.createDataFrame(held, "a long, b long"), 32, 0.9)

    pairs = np.concatenate([clump, lone[:100], lone[:100] + 0.01 * rng.normal(size=(100, 32))])
    held = [(a, b) for a, b in true_links(pairs) if b < 300]
    assert judged(pairs, held) == pytest.approx(300 / 500, abs=0.15)
    rare = np.concatenate([lone, lone[:2] + 0.01 * rng.normal(size=(2, 32))])
    assert judged(rare, []) == 0.0 and judged(rare, list(true_links(rare))) == 1.0
    assert judged(lone, []) is None


def test_vectors_edge_cases(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
        (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [0.0, 1e300]), (12, [0.0, 1e-300]),
    ]
    frame = spark.createDataFrame([(*r, 0, b"x") for r in rows], "vec_id long, embedding array<double>, label int, unit binary")
    got = vecgraph.near_duplicates(frame).collect()
    assert Counter(r.vec_id for r in got) == Counter(r[0] for r in rows)
    found = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert found == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8), 9: (1, 9), 10: (1, 9), None: (0, None), 11: (1, 11), 12: (1, 11)}
    assert vecgraph.near_duplicates(frame.limit(0)).collect() == []


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (None, 3)]
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = brute.components([*range(201), *range(1000, 1100)], [e for e in edges if None not in e and e[0] != e[1]])
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def rule_of(url):
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", "", None, None
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = host.translate(brute.LOWER)
    fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def markov(counts, text, order):
    """Log likelihood by the definition of the blended model."""
    padded = urlfilter.BEGIN * order + text + urlfilter.END
    total = 0.0
    for i in range(order, len(padded)):
        p = urlfilter.UNSEEN
        for k in range(order + 1):
            after = counts.get(padded[i - k : i], {})
            if after:
                p = (after.get(padded[i], 0) + len(after) * p) / (sum(after.values()) + len(after))
        total += math.log(p)
    return total


def test_urls_match_brute_force(spark):
    order = 4
    odd = [(90001, None), (90002, "no scheme"), (90003, "http://EXAMPLE.com/en/?q"), (90004, "x://a://b.com/"), (90005, "https://com"), (90006, "ftp://b.net/es/é#f"), (90006, "ftp://b.net/es/é#f"), (None, "http://www.example.com/en/1")]
    urls = [(r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()] + odd
    got = urlfilter.judge(spark.createDataFrame([(*u, "x", 3) for u in urls], "page_id long, url string, chars string, n int")).collect()
    spelled = lambda u: (u or "").partition("://")[2].translate(brute.LOWER) if "://" in (u or "") else (u or "").translate(brute.LOWER)
    models = {"allow": {}, "block": {}}
    judged = [(spelled(u), rule_of(u)[3]) for _, u in urls]
    kept_out = lambda s: zlib.crc32(s.encode()) % 4 == 2
    for text, verdict in judged:
        if verdict and not kept_out(text):
            padded = urlfilter.BEGIN * order + text + urlfilter.END
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    after = models[verdict].setdefault(padded[i - k : i], Counter())
                    after[padded[i]] += 1
    score = {t: (markov(models["allow"], t, order) - markov(models["block"], t, order)) / (len(t) + 1) for t, _ in judged}
    known = {v: [score[t] for t, w in judged if w == v and kept_out(t)] for v in models}
    (a, sa), (b, sb) = ((np.mean(known[v]), np.std(known[v])) for v in ("allow", "block"))
    threshold = (a * sb + b * sa) / (sa + sb)
    assert len(got) == len(urls) and Counter(r.page_id for r in got) == Counter(i for i, _ in urls)
    for r in got:
        host, path, rule, verdict = rule_of(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        own = score[spelled(r.url)]
        assert r.score == pytest.approx(own, abs=1e-4) and r.threshold == pytest.approx(threshold, abs=1e-3)
        if verdict or abs(own - threshold) > 2e-3:
            assert r.verdict == (verdict or ("allow" if own >= threshold else "block"))
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_pipeline_stages(spark, docs, empty):
    """Stage by stage against the operators' brute-force versions, on the whole table and on edge cases."""
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in rows.collect()}
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns and out.schema == rows.schema
        rows = common.saved(out, f"test-{name}")
        after = {r.doc_id: r for r in rows.collect()}
        if name == "language":
            assert len(after) > 0.95 * len(before)
        if name == "decontamination":
            judged = brute.contaminated([(i, r.text) for i, r in before.items()], items)
            assert set(after) == {i for i in before if not judged[i][4]}
        if name == "secrets":
            assert set(after) == set(before)
            assert all(not brute.secrets_base(r.text) and r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)
            assert all(r == before[i] for i, r in after.items() if not brute.secrets_base(before[i].text))
        else:
            assert all(r == before[i] for i, r in after.items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()
    assert {r.doc_id for r in pieces} == set(after)
    for table in (docs, empty):
        for _, stage in corpus_pipeline.STAGES:
            table = common.saved(stage(spark, table, SF), "test-edge")


def test_decontamination_judges_each_row(spark):
    """Null ids and shared ids: every row goes or stays by its own text."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first().text
    rows = [(None, item), (None, "clean, without an id"), (None, None), (1, item), (1, "clean, with a shared id"), (1, None), (2, item), (2, item), (3, "clean"), (3, "clean")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    got = corpus_pipeline.decontamination(spark, frame, SF)
    assert got.columns == frame.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((i, t) for i, t in rows if t != item)


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
