"""Comparison of a query with its DuckDB SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    said = lambda v: "" if v is None or pd.isna(v) else f"{v:.7g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(said, r)) for r in frame.itertuples(index=False))


def check(spark, run, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(sql).df()
    got = run(spark, sf_dir).toPandas()
    whole = [c for c in want.columns if str(want[c].dtype).startswith(('Int', 'int'))]
    got = got.astype({c: 'Int64' for c in whole if c in got.columns})
    want = want.astype({c: 'Int64' for c in whole})
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
