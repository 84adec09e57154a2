"""Text lines (``df[value]``) to typed columns, as projections without Python code.

A row whose required field is missing or malformed is dropped, except by
``decode_tweet_words``, which keeps it with id 0 at (0, 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.text import (
    fields,
    has_fields,
    is_all_digits,
    prefix_double,
    to_double,
    to_int,
    to_long,
)
from driftgrid.functions.timestamps import parse_ts


def _at(arr: Column, i: int) -> Column:
    return F.get(arr, F.lit(i))


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """``select`` whose columns are worked out once per row.

    A filter on the result of a plain ``select`` is moved below it and works out the
    columns it needs a second time; parsing text is too dear for that.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def _fields(df: DataFrame, sep: str) -> DataFrame:
    return _once(df, fields(F.col("value"), sep).alias("f"))


def _complete(df: DataFrame, *names: str) -> DataFrame:
    return df.dropna(subset=list(names))


def decode_points(df: DataFrame) -> DataFrame:
    """``id date time lat lng word…`` → id, ts, x (lat), y (lng)."""
    f = F.col("f")
    kept = _fields(df, " ").where(has_fields(f, 6) & is_all_digits(_at(f, 0)))
    out = _once(
        kept,
        to_long(_at(f, 0)).alias("id"),
        parse_ts(F.concat_ws(" ", _at(f, 1), _at(f, 2))).alias("ts"),
        prefix_double(_at(f, 3)).alias("x"),
        prefix_double(_at(f, 4)).alias("y"),
    )
    return _complete(out, "x", "y")


def decode_tweet_words(df: DataFrame) -> DataFrame:
    """``id date time lat lng word…`` → id, x, y, words, n_fields, n_words, t."""
    f = F.col("f")
    typed = _once(
        _fields(df, " "),
        f.alias("f"),
        # A whole number keeps all its digits; a double holds only some 16 of them.
        F.coalesce(to_long(_at(f, 0)), to_double(_at(f, 0)).cast("bigint")).alias("id"),
        to_double(_at(f, 3)).alias("x"),
        to_double(_at(f, 4)).alias("y"),
    )
    good = F.col("id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    words = F.slice(f, 6, F.greatest(F.size(f) - 5, F.lit(0)))
    return typed.select(
        F.when(good, F.col("id")).otherwise(F.lit(0).cast("bigint")).alias("id"),
        F.when(good, F.col("x")).otherwise(0.0).alias("x"),
        F.when(good, F.col("y")).otherwise(0.0).alias("y"),
        words.alias("words"),
        F.size(f).alias("n_fields"),
        F.greatest(F.size(f) - 5, F.lit(0)).alias("n_words"),
        _at(f, 2).alias("t"),
    )


def decode_tweet_csv(df: DataFrame) -> DataFrame:
    """``id,createdAt,lat,lng,text``; the text stops at the next comma."""
    f = F.col("f")
    out = _once(
        _fields(df, ","),
        to_long(_at(f, 0)).alias("id"),
        _at(f, 1).alias("created_at"),
        to_double(_at(f, 2)).alias("lat"),
        to_double(_at(f, 3)).alias("lng"),
        _at(f, 4).alias("text"),
    )
    return _complete(out, "id", "lat", "lng", "text")


def decode_tweet_record(df: DataFrame) -> DataFrame:
    """``id,createdAt,lat,lng,userId,text``; the text keeps its commas."""
    f = F.col("f")
    out = _once(
        _once(df, F.split(F.col("value"), ",", 6).alias("f")),
        to_long(_at(f, 0)).alias("id"),
        _at(f, 1).alias("created_at"),
        to_double(_at(f, 2)).alias("lat"),
        to_double(_at(f, 3)).alias("lng"),
        to_long(_at(f, 4)).alias("user_id"),
        _at(f, 5).alias("text"),
    )
    return _complete(out, "id", "lat", "lng", "user_id", "text")


def _trip_fields(df: DataFrame) -> DataFrame:
    f = F.col("f")
    return _once(
        _fields(df, ","),
        to_long(_at(f, 0)).alias("oid"),
        _at(f, 1).alias("tripid"),
        parse_ts(_at(f, 2)).alias("tstart"),
        parse_ts(_at(f, 3)).alias("tend"),
        to_double(_at(f, 4)).alias("xstart"),
        to_double(_at(f, 5)).alias("ystart"),
        to_double(_at(f, 6)).alias("xend"),
        to_double(_at(f, 7)).alias("yend"),
    )


def decode_trip_start(df: DataFrame) -> DataFrame:
    """Trip line → its start as a location update (oid, ts, x, y)."""
    t = _complete(_trip_fields(df), "oid", "tstart", "xstart", "ystart")
    return t.select(
        "oid", F.col("tstart").alias("ts"), F.col("xstart").alias("x"), F.col("ystart").alias("y")
    )


def decode_trip(df: DataFrame) -> DataFrame:
    """Trip line → its start and its end as two location updates (oid, ts, x, y)."""
    t = _complete(
        _trip_fields(df), "oid", "tstart", "tend", "xstart", "ystart", "xend", "yend"
    )

    def update(part: str) -> Column:
        return F.struct(
            F.col("t" + part).alias("ts"), F.col("x" + part).alias("x"), F.col("y" + part).alias("y")
        )

    return t.select("oid", F.inline(F.array(update("start"), update("end"))))


def decode_range_query(df: DataFrame, axes: str = "xy") -> DataFrame:
    """``qid,x:y,x:y,…`` → qid and its corners in line order.

    ``axes='yx'`` reads each corner as ``y:x`` (so ``lat:lng``).
    """
    first, second = ("x", "y") if axes == "xy" else ("y", "x")

    def corner(text: Column) -> Column:
        pair = F.split(text, ":")
        named = {first: to_double(_at(pair, 0)), second: to_double(_at(pair, 1))}
        return F.struct(named["x"].alias("x"), named["y"].alias("y"))

    f = F.col("f")
    corners = F.transform(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))), corner)
    out = _once(_fields(df, ","), _at(f, 0).alias("qid"), corners.alias("points"))
    return out.where(~F.exists("points", lambda p: p["x"].isNull() | p["y"].isNull()))


def as_boxes(queries: DataFrame) -> DataFrame:
    """Range queries of exactly two corners (north-east, south-west) with named bounds."""
    ne, sw = F.get(F.col("points"), F.lit(0)), F.get(F.col("points"), F.lit(1))
    return queries.where(F.size("points") == 2).select(
        "*",
        sw["x"].alias("x_min"),
        sw["y"].alias("y_min"),
        ne["x"].alias("x_max"),
        ne["y"].alias("y_max"),
    )


def parse_rect(text: str) -> tuple[float, float, float, float]:
    """``x1,y1,x2,y2`` → (x_min, y_min, x_max, y_max), corners in any order."""
    x1, y1, x2, y2 = (float(part) for part in text.split(",")[:4])
    return min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2)


def decode_rect(c: Column) -> Column:
    """Column form of ``parse_rect``; null when one of the four numbers is bad."""
    f = fields(c, ",")
    x1, y1, x2, y2 = (to_double(_at(f, i)) for i in range(4))
    bad = x1.isNull() | y1.isNull() | x2.isNull() | y2.isNull()
    return F.when(
        ~bad,
        F.struct(
            F.least(x1, x2).alias("x_min"),
            F.least(y1, y2).alias("y_min"),
            F.greatest(x1, x2).alias("x_max"),
            F.greatest(y1, y2).alias("y_max"),
        ),
    )


def decode_knn_query(df: DataFrame) -> DataFrame:
    """``id,x,y,k``, all integers."""
    names = ("qid", "fx", "fy", "k")
    typed = (to_int(_at(F.col("f"), i)).alias(n) for i, n in enumerate(names))
    out = _once(_fields(df, ","), *typed)
    return _complete(out, "qid", "fx", "fy", "k")


def decode_query_point(df: DataFrame) -> DataFrame:
    """``qid,x,y``: one corner of a query."""
    f = F.col("f")
    out = _once(
        _fields(df, ","),
        to_long(_at(f, 0)).alias("qid"),
        to_double(_at(f, 1)).alias("x"),
        to_double(_at(f, 2)).alias("y"),
    )
    return _complete(out, "qid", "x", "y")


def decode_entity(df: DataFrame) -> DataFrame:
    """Tab-separated entity line → eid (first field) and uri (third field)."""
    f = F.col("f")
    out = _once(_fields(df, "\t"), _at(f, 0).alias("eid"), _at(f, 2).alias("uri"))
    return _complete(out, "uri")


def decode_mbr_json(c: Column, strict: bool = True) -> Column:
    """Rectangle document ``{south,east,north,west}`` → struct of named bounds.

    A missing field is an error, or with ``strict=False`` a null.
    """
    d = F.from_json(c, "south double, east double, north double, west double")
    whole = (
        d["south"].isNotNull()
        & d["east"].isNotNull()
        & d["north"].isNotNull()
        & d["west"].isNotNull()
    )
    mbr = F.struct(
        F.least(d["south"], d["north"]).alias("lat_min"),
        F.greatest(d["south"], d["north"]).alias("lat_max"),
        F.least(d["east"], d["west"]).alias("lng_min"),
        F.greatest(d["east"], d["west"]).alias("lng_max"),
    )
    if not strict:
        return F.when(whole, mbr)
    problem = F.raise_error(F.concat(F.lit("MBR expected: "), F.coalesce(c, F.lit("null"))))
    return F.when(whole, mbr).otherwise(
        problem.cast("struct<lat_min:double,lat_max:double,lng_min:double,lng_max:double>")
    )


def bad_rows(df: DataFrame, decoder) -> DataFrame:
    """How many lines there are and how many a one-row-per-line decoder drops."""
    lines = df.agg(F.count("*").alias("n_lines"))
    good = decoder(df).agg(F.count("*").alias("n_good"))
    return lines.select("n_lines", (F.col("n_lines") - good.scalar()).alias("n_bad"))
