"""Rows of a Spark query against those of its SQL."""

import math


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return float(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=_key)


def same(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    ours, theirs = rows(df.columns, df.collect()), rows(list(rel.columns), rel.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1.1e-5), (a, b)
