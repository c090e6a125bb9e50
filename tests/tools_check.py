"""Compare one registered query with its DuckDB oracle (used by the tests)."""

import duckdb

from aspectra.plans.fixtures import TABLES


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(round(x, 9) if isinstance(x, float) else x for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, name, entry, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    s = entry.queries()[name](spark, sf_dir).toPandas()
    o = con.execute(entry.oracle_sql()[name]).df()
    return _rows(s) == _rows(o)
