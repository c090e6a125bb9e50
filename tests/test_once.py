"""Values that several tests of a row read are computed once; texts of a batch are scored together."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from aspectra.operators import aspects as A
from aspectra.operators import sentiment as E
from aspectra.operators import textmodel as TM


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clause_words_and_tokens_are_computed_once(spark):
    df = spark.createDataFrame([(1, "a red widget and two days; hot gear", ), (2, "nothing here")], "k long, t string")
    for strict in (False, True):
        rows = A.extract_aspects(df, "k", "t", ["red", "hot"], ["widget", "gear"], strict=strict)
        plan = plan_of(rows)
        assert plan.count(r"[^\p{L}\p{N}\s'-]") == 1  # the tokens
        assert plan.count("split(trim(") == 1  # the words of a snippet
        got = [(r.k, r.aspect_phrase, r.aspect_snippet) for r in rows.orderBy("k", "aspect_pos").collect()]
        assert got[-2:] == [(1, "hot gear", "hot gear"), (2, "general", "nothing here")]


def test_softmax_reads_its_logits_once(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0],), (None,)], "x array<double>")
    out = df.select(E.softmax(F.transform("x", lambda v: F.sqrt(v))).alias("p"))
    assert plan_of(out).count("SQRT(") == 1
    p = [r.p for r in out.collect()]
    want = np.exp(np.sqrt([1.0, 2.0, 2.0]))
    assert np.allclose(p[0], want / want.sum()) and p[1] is None


def test_texts_of_a_batch_are_weighed_together():
    class Weights(np.ndarray):
        reads = 0

        def __getitem__(self, at):
            Weights.reads += 1
            return np.asarray(super().__getitem__(at))

    rng = np.random.default_rng(3)
    model = TM.Model(rng.normal(size=(TM.BUCKETS, 3)).view(Weights), np.array([0.1, 0.2, 0.3]), 2.0)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts = [None, "", *(" ".join(rng.choice(words, size=n)) for n in rng.integers(1, 400, size=700)), "1 2"]
    together = TM.logits(model, pd.Series(texts))
    assert Weights.reads < 10
    assert np.allclose(together, [TM.logits(model, [t])[0] for t in texts], rtol=0, atol=1e-12)
