"""Compare a registered query with its SQL: same columns, same rows in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return str(v) if v is not None and not isinstance(v, (int, bool, str)) else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """An empty string when both agree, else what differs."""
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = _rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if got == want:
        return ""
    from collections import Counter

    a, b = Counter(got), Counter(want)
    return f"rows {len(got)} vs {len(want)}; columns {sorted(df.columns)}; only here {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"
