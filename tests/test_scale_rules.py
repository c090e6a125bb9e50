"""Edge tables and exactness of the operators that were rebuilt for scale."""

import inspect

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from aspectra.operators import clusters as C
from aspectra.operators import keyphrases as X
from aspectra.operators import lexical as LX
from aspectra.operators import sentiment as E
from aspectra.operators import vectors as V
from aspectra.sources import reviews as S
from aspectra.sources import sinks as SK


def test_short_words_numbers_and_marks_stay(spark):
    words = "a i to of is in no we the was and with for it room staff".split()
    vocab = spark.createDataFrame([(w, 100 - i) for i, w in enumerate(words)], "term string, freq long")
    keep = ["a", "i", "to", "of", "is", "in", "no", "we", "12", "r2", "!", "x", "room"]
    docs = spark.createDataFrame([(1, keep), (2, ["rom", "stafff", "thee", "room", "rom", "zzzzzzzzzzz"]), (3, [])], "k long, toks array<string>")
    for distance in (1, 2):
        got = {r.k: r.corrected for r in LX.correct_tokens(docs, "k", "toks", vocab, distance).collect()}
        assert got[1] == keep and got[3] == []
    assert got[2] == ["room", "staff", "the", "room", "room", "zzzzzzzzzzz"]


def test_dictionary_is_a_share_not_a_count(spark):
    rows = [("the room is in a hotel " * 50 + "the rooom",)]
    small = {r.term for r in LX.spell_vocabulary(spark.createDataFrame(rows, "t string"), "t", 0.01).collect()}
    large = {r.term for r in LX.spell_vocabulary(spark.createDataFrame(rows * 60, "t string"), "t", 0.01).collect()}
    assert small == large == {"the", "room", "is", "in", "a", "hotel"}


def test_candidates_are_scored_once_and_attributes_join(spark):
    lexicon = spark.createDataFrame([("friendly", "JJ", "friendly"), ("very", "RB", "very")], "word string, tag string, lemma string")
    senses = spark.createDataFrame([("staff", 1, "noun.artifact"), ("staff", 2, "noun.artifact"), ("idea", 1, "noun.cognition")], "lemma string, sense int, domain string")
    bits = {r.word: r.bits for r in X.word_attributes(lexicon, senses).collect()}
    assert bits["friendly"] == X.ADJECTIVE and bits["very"] == X.OTHER_TAG
    assert bits["staff"] == X.HAS_SENSE | X.MULTI_SENSE | X.CONCRETE and bits["idea"] & X.HAS_SENSE
    docs = spark.createDataFrame([(1, "s", "friendly staff friendly staff"), (2, "s", ""), (3, "s", None)], "k long, src string, doc string")
    got = X.candidate_table(docs, "k", "src", "doc", X.WordClasses(), attributes=X.word_attributes(lexicon, senses), min_cosine=0.0)
    rows = got.collect()
    assert {r.k for r in rows} == {1} and any(r.phrase == "staff" for r in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan  # the scored table is read back, not scored again


def test_scorer_matches_the_definition(spark):
    import hashlib

    def vector(t):
        v = np.zeros(64)
        for i in range(len(t) - 2):
            v[int(hashlib.md5(t[i : i + 3].encode()).hexdigest()[:8], 16) % 64] += 1
        n = np.linalg.norm(v)
        return v / n if n else v

    rows = [(["room", "é漢字\U0001f600x", "ab", "clean room"], "The clean room é漢字\U0001f600x"), ([], "x"), (["abc"], "")]
    df = spark.createDataFrame(rows, "c array<string>, t string").coalesce(1)
    got = [r.s for r in df.select(X.candidate_scorer()("c", "t").alias("s")).collect()]
    for (cands, text), scores in zip(rows, got, strict=True):
        assert np.allclose(scores, [vector(c) @ vector(text) for c in cands])


def test_csv_rows_and_labels_keep_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('label,x\n"first, ""one""",1\n,2\n"two\nlines",3\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("label,x\nb0,1\nb1,\nb2,3\n", encoding="utf-8")
    table = S.read_table(spark, str(tmp_path), "csv")
    got = S.reviews(table, "label", None).collect()
    assert sorted((int(r.source_id), r.text) for r in got) == [(0, 'first, "one"'), (1, ""), (2, "two\nlines"), (3, "b0"), (4, "b1"), (5, "b2")]
    labels = sorted((r.pos, r.label) for r in S.label_list(table).collect())
    assert labels == [(0, 'first, "one"'), (1, "two\nlines"), (2, "b0"), (3, "b2")]


def test_csv_sink_round_trip(spark):
    rows = [(1, ' lead "q", and\nbreak\\ '), (2, "plain")]
    path = SK.write_csv(spark.createDataFrame(rows, "k int, t string"), SK.scratch_path(spark, "csv"))
    assert sorted((int(r.k), r.t) for r in SK.read_csv(spark, path).collect()) == rows


def test_model_hook_scores_in_batches(spark):
    texts = spark.createDataFrame([("good",), ("bad",), ("",)], "t string")
    scored = E.score_texts(texts, "t", lambda s: pd.DataFrame({"n": s.eq("bad") * 2.0, "p": s.eq("good") * 3.0}).to_numpy(), 2)
    assert {r.t: r.logits for r in scored.collect()} == {"good": [0.0, 3.0], "bad": [2.0, 0.0], "": [0.0, 0.0]}


def test_nearest_keyword_in_pieces_and_ties(spark):
    rng = np.random.default_rng(3)
    kw = rng.normal(size=(60, 8))
    kw[40] = kw[7]
    asp = np.concatenate([rng.normal(size=(50, 8)), kw[[7, 40]]])
    keywords = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(kw)], "pos long, kv array<double>")
    aspects = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asp)], "id long, v array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argmax(np.round(unit(asp) @ unit(kw).T, 12), axis=1).tolist()
    for piece in (200_000, 13):
        got = V.nearest_keyword(aspects, "v", keywords, "pos", "kv", piece_rows=piece).orderBy("id").collect()
        assert [r.kw_index for r in got] == want
    none = V.nearest_keyword(aspects, "v", keywords.limit(0), "pos", "kv").collect()
    assert {(r.kw_index, r.cosine_similarity) for r in none} == {(None, 0.0)}


def test_squared_silhouette_matches_pairs(spark):
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(80, 5)), rng.integers(-1, 4, size=80)
    c[c == 3] = 2
    c[0] = 3  # a cluster of one
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))]
    df = spark.createDataFrame(rows, "i long, v array<double>, cluster int")
    y, k = x[c >= 0], c[c >= 0]
    d = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    s = []
    for i in range(len(y)):
        own = (k == k[i]) & (np.arange(len(y)) != i)
        b = min(d[i][k == o].mean() for o in set(k) - {k[i]})
        s.append((b - d[i][own].mean()) / max(b, d[i][own].mean()) if own.any() else 0.0)
    assert np.isclose(C.silhouette_sq(df, "i", "v", "cluster").first()[0], np.mean(s))
    assert C.silhouette_sq(df.where("cluster = 1"), "i", "v", "cluster").first()[0] == 0.0
    assert C.silhouette_sq(df.limit(0), "i", "v", "cluster").first()[0] == 0.0


def test_merge_of_labels_from_no_rows(spark):
    empty = spark.createDataFrame([], "label string, x int")
    assert S.label_list(empty.withColumn("p", F.lit(0)), order_col="p").collect() == []


def test_density_labels_match_brute_force(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(60, 3)) * 0.3, rng.normal(size=(40, 3)) * 0.3 + 4, rng.uniform(-9, 9, size=(40, 3)), [[4.0, 4.0, 4.0]] * 3])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    eps, min_points, min_size = 0.5, 5, 4
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= min_points
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([min(root[j] for j in np.flatnonzero(near[i] & core)) if core[i] else i for i in range(len(x))])
    sizes = {r: (root[core] == r).sum() for r in set(root[core])}
    order = {r: k for k, r in enumerate(sorted(r for r, n in sizes.items() if n >= min_size))}
    want = [order.get(root[i], -1) if core[i] else -1 for i in range(len(x))]
    for block in (2048, 25):
        got = C.density_labels(df, "id", "v", eps, min_points, min_size, block_size=block).orderBy("id").collect()
        assert [r.cluster for r in got] == want


def test_sweep_takes_the_references_k_and_restarts(spark, monkeypatch):
    """The main program sweeps k to 40; nine topics need more than six clusters; ten seeds a k by default."""
    from aspectra.operators import sweep
    from aspectra.plans import chains as CH

    assert inspect.signature(CH.phrase_program).parameters["max_k"].default == 40
    assert inspect.signature(C.kmeans_sweep).parameters["max_k"].default == 40
    fitted = []

    plain = sweep.plus_plus

    def counted(x, k, seed):
        fitted.append((k, seed))
        return plain(x, k, seed)

    monkeypatch.setattr(sweep, "plus_plus", counted)
    rng = np.random.default_rng(3)
    x = np.repeat(10 * np.eye(9), 3, axis=0) + 0.01 * rng.normal(size=(27, 9))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    got = {r.vec_id: r.cluster for r in C.kmeans_sweep(frame, "embedding", 8)[0].collect()}
    assert len(set(got.values())) == 9 and all(got[i] == got[i - i % 3] for i in got)
    assert sorted(fitted) == [(k, s) for k in (8, 9, 10) for s in range(42, 52)]


def test_main_program_fits_together(spark):
    from aspectra.plans.registry import QUERIES

    rows = QUERIES["main_assignments"](spark, "/root/testdata/sf0.001").collect()
    assert rows and len({r.vec_id for r in rows}) == len(rows)
    assert all(0 <= r.probability <= 1 and r.cluster >= -1 and r.n >= 1 for r in rows)
    assert all(r.probability >= 0.6 and r.kpi != "__noise__" for r in rows if r.accepted)
    assert any(r.rule_applied for r in rows)
