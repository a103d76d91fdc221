"""Spark results against SQL or rows, without regard to order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda v: "NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    x, y = normal(a), normal(b)
    assert len(x) == len(y)
    assert x.equals(y), next((dict(x.loc[i]), dict(y.loc[i])) for i in range(len(x)) if not x.loc[i].equals(y.loc[i]))
