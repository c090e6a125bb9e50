"""Candidate lists reach Python in small batches, however many documents a task holds."""

import pandas as pd
from pyspark.sql import functions as F

from aspectra.operators import keyphrases as X


def test_candidate_lists_come_in_small_batches(spark, monkeypatch):
    def counting(dim):
        @F.pandas_udf("array<double>")
        def score(cands: pd.Series, docs: pd.Series) -> pd.Series:
            if len(cands) > 500:
                raise ValueError(f"{len(cands)} documents at once")
            return pd.Series([[0.5] * len(c) for c in cands])

        return score.asNondeterministic()

    monkeypatch.setattr(X, "candidate_scorer", counting)
    docs = spark.createDataFrame([(i, "s", f"room number{i % 7} clean") for i in range(1200)], "id long, source string, doc string").coalesce(1)
    settings = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(s) for s in settings]
    rows = X.candidate_table(docs, "id", "source", "doc", X.WordClasses())
    assert rows.select("id").distinct().count() == 1200
    assert [spark.conf.get(s) for s in settings] == before
