"""Both sides of a query, compared as bags of rows."""

import duckdb
from pathlib import Path


def rows_of(df):
    names = sorted(df.columns)
    return sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect())))


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return sorted(got.columns), sorted(map(repr, (tuple(r[i] for i in order) for r in got.fetchall())))
