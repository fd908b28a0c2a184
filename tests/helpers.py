"""Comparing query results."""


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(duck, text):
    found = duck.sql(text)
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    return columns, sorted((tuple(_plain(r[k]) for k in at) for r in found.fetchall()), key=repr)


def _plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value
