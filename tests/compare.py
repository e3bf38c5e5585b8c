"""Rows of Spark and of SQL in one form."""

import datetime
import decimal


def norm(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(norm, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def ordered(rows):
    return sorted((tuple(map(norm, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(df, rel):
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    return ordered([r[c] for c in cols] for r in df.collect()) == ordered([r[i] for i in at] for r in rel.fetchall())
