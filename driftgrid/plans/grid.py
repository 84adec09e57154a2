"""Grid keys that turn containment joins into equi-joins.

A box is filed under every cell it overlaps, on the level whose cells are large
enough for it to overlap only a few; a point looks up one cell per level in use.
Cells grow FAN-fold from level to level, so the number of levels follows the
logarithm of the box sizes.  Time intervals are filed the same way on their own
levels.  Each point and box that belong together meet under exactly one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.timestamps import epoch_seconds
from driftgrid.plans import sizing, skew

FAN = 8
TOP_LEVEL = 12


def _scale(size: float, level: Column) -> Column:
    return F.lit(float(size)) * F.pow(F.lit(float(FAN)), level)


def cell_index(c: Column, size: float, level: Column) -> Column:
    return F.floor(c / _scale(size, level))


def level_for(extent: Column, size: float, top: int) -> Column:
    """Lowest level on which ``extent`` spans about FAN cells or fewer."""
    needed = F.ceil(F.log(float(FAN), extent / F.lit(size * FAN)))
    return F.least(F.greatest(F.coalesce(needed, F.lit(0)), F.lit(0)), F.lit(top)).cast("int")


def level_of(extent: float, size: float) -> int:
    """``level_for`` a known extent."""
    return next((k for k in range(TOP_LEVEL) if extent <= size * FAN ** (k + 1)), TOP_LEVEL)


def filed_bytes(boxes: DataFrame, cell: float) -> float:
    """What ``grid_join`` broadcasts of static boxes: each takes a row per cell it overlaps."""
    width = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))
    boxes = boxes.withColumn("_lv", level_for(width, cell, TOP_LEVEL))
    n_cells = F.lit(1.0)
    for axis in ("x", "y"):
        lo, hi = (cell_index(F.col(f"{axis}_{end}"), cell, F.col("_lv")) for end in ("min", "max"))
        n_cells = n_cells * (hi - lo + 1)
    return sizing.measure(boxes, n_cells)["n_bytes"]


def grid_join(
    points: DataFrame,
    boxes: DataFrame,
    cell: float,
    on: Sequence[str] = (),
    valid: tuple[str, str] | None = None,
    bucket: float | None = None,
    ts: str = "ts",
    salts: int = 1,
    levels: Sequence[tuple] | None = None,
    top: int = TOP_LEVEL,
) -> DataFrame:
    """Join points (x, y) to the closed boxes (x_min, y_min, x_max, y_max) holding them.

    ``on`` names further columns that must be equal.  ``valid`` names the box columns
    of a half-open time interval the point's ``ts`` must fall in, a null end meaning no
    end; ``bucket`` is the finest time cell in seconds.

    Static boxes are measured first: if they are small they are broadcast, otherwise
    both sides are shuffled by cell with crowded cells split.  Streaming boxes,
    which cannot be looked at beforehand, may lie on any level, or on the ``levels`` given;
    ``salts`` above 1 split every cell of theirs over that many parts.  Boxes too wide for the
    level ``top`` are filed there, under more cells.
    """
    measured = not boxes.isStreaming
    boxes = boxes.where(
        (F.col("x_min") <= F.col("x_max")) & (F.col("y_min") <= F.col("y_max"))
    )
    width = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))
    boxes = boxes.withColumn("_lv", level_for(width, cell, top))
    n_cells = F.lit(1.0)
    spans = {}
    for axis in ("x", "y"):
        lo = cell_index(F.col(f"{axis}_min"), cell, F.col("_lv"))
        hi = cell_index(F.col(f"{axis}_max"), cell, F.col("_lv"))
        spans[f"_c{axis}"] = (lo, hi)
        n_cells = n_cells * (hi - lo + 1)

    if valid:
        start, end = valid
        t0 = epoch_seconds(boxes, start)
        t1 = epoch_seconds(boxes, end)
        # Intervals without an end sit together on a level of their own (-1).
        length = (t1 - t0).cast("double")
        tlevel = F.when(F.col(end).isNull(), -1).otherwise(level_for(length, bucket, TOP_LEVEL))
        boxes = boxes.withColumn("_tl", tlevel.cast("int"))
        open_ended = F.col("_tl") < 0
        lo = F.when(open_ended, 0).otherwise(cell_index(t0, bucket, F.col("_tl")))
        hi = F.when(open_ended, 0).otherwise(cell_index(t1, bucket, F.col("_tl")))
        spans["_tb"] = (lo, hi)
        n_cells = n_cells * (hi - lo + 1)
        boxes = boxes.where(F.col(end).isNull() | (F.col(start) < F.col(end)))

    n_bytes = None
    if measured:
        kinds = F.struct("_lv", "_tl") if valid else F.struct("_lv")
        size = sizing.measure(boxes, n_cells, levels=F.collect_set(kinds))
        n_bytes = size["n_bytes"]
        levels = sorted(tuple(r) for r in size["levels"])
    elif levels is None:
        tlevels = [(t,) for t in range(-1, TOP_LEVEL + 1)] if valid else [()]
        levels = [(lv, *t) for lv in range(TOP_LEVEL + 1) for t in tlevels]

    filed = boxes
    for name, (lo, hi) in spans.items():
        filed = filed.withColumn(name, F.explode(F.sequence(lo, hi)))

    probes = _with_levels(points, levels, cell, bucket)
    found = {f"_c{axis}": F.floor(F.col(axis) / F.col("_size")) for axis in ("x", "y")}
    if valid:
        at = F.floor(epoch_seconds(points, ts) / F.col("_tsize"))
        found["_tb"] = F.when(F.col("_tl") < 0, 0).otherwise(at)
    probes = probes.withColumns(found).drop("_size", "_tsize")

    keys = [*on, "_lv", *(["_tl"] if valid else []), *spans]
    joined = skew.sized_join(probes, filed, keys, n_bytes=n_bytes, salts=salts)
    hit = (
        (F.col("x") >= F.col("x_min"))
        & (F.col("x") <= F.col("x_max"))
        & (F.col("y") >= F.col("y_min"))
        & (F.col("y") <= F.col("y_max"))
    )
    if valid:
        hit = hit & (F.col(ts) >= F.col(start)) & (F.col(end).isNull() | (F.col(ts) < F.col(end)))
    return joined.where(hit).drop("_lv", "_tl", *spans)


def _with_levels(
    points: DataFrame, levels: list[tuple], cell: float, bucket: float | None
) -> DataFrame:
    """Every point once per level, with the level's cell size."""

    def level(lv: int, tl: int | None = None) -> list[Column]:
        columns = [F.lit(lv).cast("int").alias("_lv"), F.lit(cell * float(FAN) ** lv).alias("_size")]
        if tl is not None:
            columns.append(F.lit(tl).cast("int").alias("_tl"))
            columns.append(F.lit(bucket * float(FAN) ** max(tl, 0)).alias("_tsize"))
        return columns

    if len(levels) == 1:
        return points.select("*", *level(*levels[0]))
    if not levels:  # no boxes at all
        return points.select("*", *level(0, 0 if bucket else None)).where(F.lit(False))
    return points.select("*", F.inline(F.array(*(F.struct(*level(*lv)) for lv in levels))))
