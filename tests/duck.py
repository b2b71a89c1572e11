"""Compares a query with its SQL as the driver does: columns by name, rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(text(r[c]) for c in cols) for r in df.collect())


def text(v):
    return "~" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v)


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = con.sql(sql)
    names = got.columns
    cols = sorted(names)
    return cols, sorted(tuple(text(dict(zip(names, r, strict=True))[c]) for c in cols) for r in got.fetchall())
