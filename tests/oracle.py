"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r),
    )


# DuckDB type -> Spark type
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz",
    "BOOLEAN": "boolean",
    "DATE": "date",
}


def compare(df, con, sql):
    """None when equal, else what differs."""
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in cur.description}
    expected = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if types != dict(df.dtypes):
        return f"types {sorted(df.dtypes)} != {sorted(types.items())}"
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    want = _rows(columns, expected)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"row {g} != {w}"
    return None
