"""Aggregates over the points of a rectangle: per batch, per window, since a landmark.

Points carry x, y and, for windows, ``ts``.  The measure (``value``) is x unless told
otherwise; sums of a decimal measure are exact, those of doubles are not.  All operators
work on static frames; ``agg_batch`` and ``agg_window`` also on streams, and
``driftgrid.streaming.stateful.landmark_stream`` carries totals from window to window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.spatial import rect_filter
from driftgrid.functions.timestamps import epoch_micros, seconds, span
from driftgrid.plans import ordered

FUNCTIONS = ("count", "max", "min", "sum", "avg")
# Rows that have a measure: what running averages divide by.
MEASURED = "measured"
_NAMES = {
    "count": "n_points",
    "max": "max_value",
    "min": "min_value",
    "sum": "sum_value",
    "avg": "avg_value",
    MEASURED: "n_measured",
}


def _names(fn: str | Sequence[str]) -> list[str]:
    fns = [fn] if isinstance(fn, str) else list(fn)
    for f in fns:
        if f not in _NAMES:
            raise ValueError(f"unknown aggregate {f!r}; choose from {', '.join(FUNCTIONS)}")
    return fns


def aggregate_columns(fn: str | Sequence[str], value: str = "x") -> list[Column]:
    """The named aggregates of a column as n_points, max_value, min_value, …"""
    make = {
        "count": lambda c: F.count("*"),
        "max": F.max,
        "min": F.min,
        "sum": F.sum,
        # Rows without a measure take no part in an average.
        "avg": lambda c: F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0)),
        MEASURED: F.count,
    }
    return [make[f](F.col(value)).alias(_NAMES[f]) for f in _names(fn)]


def inside(points: DataFrame, rect: Sequence[float] | None, predicate: Column | None = None):
    """Points in the rectangle (all when there is none) that also meet ``predicate``."""
    if rect is not None:
        points = points.where(rect_filter(F.col("x"), F.col("y"), rect))
    return points if predicate is None else points.where(predicate)


def agg_batch(
    points: DataFrame,
    fn: str | Sequence[str] = "count",
    rect: Sequence[float] | None = None,
    value: str = "x",
    predicate: Column | None = None,
) -> DataFrame:
    """One row for the whole frame; the count of nothing is 0."""
    return inside(points, rect, predicate).agg(*aggregate_columns(fn, value))


def _window_seconds(size: float, fn: str | Sequence[str]) -> float:
    if size <= 0:
        raise ValueError(f"window size cannot be {size} for {', '.join(_names(fn))}")
    return float(size)


def _window(size: float, slide: float | None) -> Column:
    return F.window("ts", span(size), span(slide or size))


def agg_window(
    points: DataFrame,
    fn: str | Sequence[str],
    rect: Sequence[float] | None,
    size: float,
    slide: float | None = None,
    value: str = "x",
    predicate: Column | None = None,
    fill_empty: bool = False,
) -> DataFrame:
    """One row per window of ``size`` seconds that holds a point.

    ``fill_empty`` (static frames, tumbling windows) adds the empty windows between
    the first and the last one, with a count and an average of 0 and no extremes.
    """
    size = _window_seconds(size, fn)
    per_window = (
        inside(points, rect, predicate)
        .groupBy(_window(size, slide).alias("w"))
        .agg(*aggregate_columns(fn, value))
    )
    out = per_window.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *(_NAMES[f] for f in _names(fn)),
    )
    return _filled(out, fn, size) if fill_empty else out


# Numbers a row is made into at once when a range of them is written out.
SPREAD = 4096


def _numbers(df: DataFrame, last: str, name: str) -> DataFrame:
    """A row per whole number ``name`` from 0 to ``last``, however many those are.

    Ranges are cut in three steps, with rows dealt anew in between, so that neither a row nor
    a task holds a long one.
    """
    df = df.withColumns({"_low": F.lit(0).cast("bigint"), "_high": F.col(last).cast("bigint")})
    for width in (SPREAD**2, SPREAD, 1):
        cut = df.withColumn("_low", F.explode(F.sequence("_low", "_high", F.lit(width).cast("bigint"))))
        df = cut.withColumn("_high", F.least("_high", F.col("_low") + (width - 1)))
        if width > 1:
            df = df.repartition("_low", last)
    return df.withColumnRenamed("_low", name).drop("_high")


def _filled(windows: DataFrame, fn: str | Sequence[str], size: float) -> DataFrame:
    step = seconds(size)
    nxt = ordered.with_next(
        windows.select("window_start"), [], "window_start", size * ordered.CHUNK_ROWS, "_next"
    )
    apart = epoch_micros(nxt, "_next") - epoch_micros(nxt, "window_start")
    # Number of the last empty window behind a window, from 0.
    missing = nxt.withColumn("_last", F.round(apart / (size * 1_000_000)).cast("bigint") - 2)
    gaps = _numbers(missing.where("_last >= 0"), "_last", "_nth").select(
        (F.col("window_start") + seconds((F.col("_nth") + 1) * F.lit(size).cast("decimal(18,6)"))).alias(
            "window_start"
        )
    )
    kept = dict(windows.dtypes)
    zero = {"count": 0, "avg": 0.0}
    empty = gaps.select(
        "window_start",
        (F.col("window_start") + step).alias("window_end"),
        *(F.lit(zero.get(f)).cast(kept[_NAMES[f]]).alias(_NAMES[f]) for f in _names(fn)),
    )
    return windows.unionByName(empty)


def agg_landmark(
    points: DataFrame,
    fn: str | Sequence[str],
    rect: Sequence[float] | None,
    size: float = 0,
    value: str = "x",
    predicate: Column | None = None,
) -> DataFrame:
    """Totals since the first point.

    With ``size`` 0 one row for all points so far (counts only, as a batch has no
    extremes of its own); otherwise one row per window with the totals up to its end.
    The average is the running sum over the running count of rows with a measure.
    """
    fns = _names(fn)
    if size == 0 and fns == ["count"]:
        return agg_batch(points, fn, rect, value, predicate)
    size = _window_seconds(size, fn)
    windows = agg_window(points, landmark_parts(fn), rect, size, None, value, predicate)
    totals = ordered.running(windows, "window_start", size, landmark_folds(fn))
    return landmark_result(totals, fn)


def landmark_parts(fn: str | Sequence[str]) -> list[str]:
    """The aggregates of a single window that totals of ``fn`` are made of."""
    fns = _names(fn)
    return [f for f in (*FUNCTIONS[:4], MEASURED) if f in fns or ("avg" in fns and f in ("sum", MEASURED))]


def landmark_folds(fn: str | Sequence[str]) -> dict[str, str]:
    """Column of a window → how it is carried on (counts and sums add up)."""
    folds = {"count": "sum", "sum": "sum", "min": "min", "max": "max", MEASURED: "sum"}
    return {_NAMES[p]: folds[p] for p in landmark_parts(fn)}


def landmark_result(totals: DataFrame, fn: str | Sequence[str]) -> DataFrame:
    """The totals asked for; an average is null while no row has had a measure."""
    fns = _names(fn)
    if "avg" in fns:
        average = F.col("sum_value").cast("double") / F.nullif(F.col("n_measured"), F.lit(0))
        totals = totals.withColumn("avg_value", average)
    return totals.select("window_start", "window_end", *(_NAMES[f] for f in fns))


def latest_per_key(
    df: DataFrame, key: str | Sequence[str], ts: str = "ts", tiebreak: str | None = None
) -> DataFrame:
    """The last row of each key in time; among equal times the greatest ``tiebreak``.

    Without ``tiebreak`` the other columns, compared from left to right, break ties.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    order = [ts, tiebreak] if tiebreak else [ts]
    row = F.struct(*order, *(c for c in rest if c not in order))
    return (
        df.groupBy(*keys)
        .agg(F.max(row).alias("_last"))
        .select(*(F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns))
    )


def sum_by_key(df: DataFrame, n: int | None = None, key: str = "k", value: str = "v") -> DataFrame:
    """Sum per key; ``n`` spreads the (already summed) result over that many partitions."""
    sums = df.groupBy(key).agg(F.sum(value).alias("total"))
    return sums.repartition(n, key) if n else sums


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))

