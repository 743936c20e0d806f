"""Compare a Spark result with DuckDB's over the same tables: names, rows and values in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return int(v)
    return v


def duck(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r = con.execute(sql)
    return [c[0] for c in r.description], r.fetchall()


def compare(df, sql, sf_dir):
    names, rows = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    order = sorted(names)
    mine = sorted(repr([_value(r[c]) for c in order]) for r in df.collect())
    at = [names.index(c) for c in order]
    theirs = sorted(repr([_value(r[i]) for i in at]) for r in rows)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    assert mine == theirs, [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b][:3]
    return len(mine)
