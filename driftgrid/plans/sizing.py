"""How large is the smaller side of a join?  One aggregate over it decides the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIXED = (T.NumericType, T.BooleanType, T.DatetimeType, T.AnyTimeType, T.DayTimeIntervalType)


def row_bytes(df: DataFrame) -> Column:
    """Bytes a row takes in a hash table, measured for text and nested columns."""
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, _FIXED):
            parts.append(F.lit(8))
        elif isinstance(f.dataType, T.StringType | T.BinaryType):
            parts.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) + 16)
        else:
            as_text = F.to_json(F.struct(F.col(f.name)))
            parts.append(F.coalesce(F.octet_length(as_text), F.lit(0)) + 16)
    total = F.lit(16)
    for p in parts:
        total = total + p
    return total.cast("bigint")


def measure(df: DataFrame, copies: Column | None = None, **extra: Column) -> Row:
    """Rows, and bytes when every row is held ``copies`` times; plus ``extra`` aggregates."""
    size = row_bytes(df) * (F.lit(1) if copies is None else copies)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(size.cast("double")), F.lit(0.0)).alias("n_bytes"),
        *(c.alias(n) for n, c in extra.items()),
    ).first()


def broadcast_limit(df: DataFrame) -> int:
    """The session's own broadcast threshold in bytes, negative when it is off."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    units = {"k": 2**10, "m": 2**20, "g": 2**30}
    body = text.strip().lower().rstrip("b")
    return int(body[:-1]) * units[body[-1]] if body and body[-1] in units else int(body)


def fits_broadcast(df: DataFrame, n_bytes: float) -> bool:
    return n_bytes <= broadcast_limit(df)
