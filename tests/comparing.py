"""Results of both engines in one form."""

import decimal
import re


def plain(x):
    """A value as both engines give it."""
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    return x


def rows_of(df):
    names = sorted(df.columns)
    return sorted((repr([plain(r[n]) for n in names]) for r in df.select(*[f"`{n}`" for n in names]).collect()))


def rows_of_sql(con, sql):
    found = con.sql(sql)
    names = sorted(found.columns)
    order = [found.columns.index(n) for n in names]
    fix = lambda v: float(v) if isinstance(v, decimal.Decimal) else v
    return sorted(repr([plain(fix(r[i])) for i in order]) for r in found.fetchall())


def numbers(rows):
    """Whole and broken numbers alike: 1 and 1.0 are one value."""
    return [re.sub(r"(?<![\w.])(-?\d+)\.0(?![\d])", r"\1", r) for r in rows]
