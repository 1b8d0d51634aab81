"""Rows of a query and of its SQL, made comparable."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return [comparable(v) for v in value]
    return str(value)


def rows_of_sql(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.sql(sql)
    names = sorted(found.columns)
    quoted = ", ".join(f'"{c}"' for c in names)
    return names, sorted([comparable(v) for v in r] for r in con.sql(f"SELECT {quoted} FROM ({sql})").fetchall())


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted([comparable(v) for v in r] for r in df.select(*names).collect())
