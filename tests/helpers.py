"""Comparison of a query with its SQL, the way the driver does it: columns by name, rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v != v:
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str(round(v, 6)) if isinstance(v, float) else str(v)


def rows_of(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(_plain(v) for v in r) for r in frame[cols].itertuples(index=False))


def oracle(sf, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(sql).df()
