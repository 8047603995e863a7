"""Compares a query with its SQL twin: same columns, same rows in any order."""

import math

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def twin(sql: str, data: str = DATA):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    found = c.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool | str):
        return value
    if isinstance(value, float) or hasattr(value, "as_tuple"):
        return round(float(value), 6)
    if hasattr(value, "tzinfo"):
        return str(value.replace(tzinfo=None))
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(v[i]) for i in order)) for v in values)


def same(df, sql: str, data: str = DATA) -> None:
    columns, values = twin(sql, data)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, values)
