"""Spark's result and DuckDB's, as sorted rows."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(0.0 + v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_sql(sql, sf=SF, tables=None):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = Path(sf) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    for name, frame in (tables or {}).items():
        con.execute(f"DROP VIEW IF EXISTS {name}")
        con.register(name, frame)
    r = con.execute(sql)
    return rows([d[0] for d in r.description], r.fetchall())
