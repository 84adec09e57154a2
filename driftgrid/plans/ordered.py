"""Running totals and next values over long sequences, without one task for all rows.

Both work in two levels: rows are cut into time chunks that are ordered in parallel,
and a short second pass over one row per chunk carries values across the cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.functions.timestamps import epoch_seconds
from driftgrid.plans import skew
from driftgrid.session import cut_lineage

CHUNK_ROWS = 4096


def running(
    df: DataFrame, order: str, step_seconds: float, totals: dict[str, str]
) -> DataFrame:
    """Add running totals over rows that lie ``step_seconds`` or more apart in ``order``.

    ``totals`` maps a column to the function (``sum``, ``min`` or ``max``) that replaces
    it by its total since the first row.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    merge = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}

    chunked = df.withColumn(
        "_chunk", F.floor(epoch_seconds(df, order) / F.lit(step_seconds * CHUNK_ROWS))
    )
    inside = (
        Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        chunked.groupBy("_chunk")
        .agg(*(fold[f](c).alias(c) for c, f in totals.items()))
        .select("_chunk", *(fold[f](c).over(earlier).alias(f"_before_{c}") for c, f in totals.items()))
    )
    local = chunked.select(
        "_chunk",
        *(fold[totals[c]](c).over(inside).alias(c) if c in totals else F.col(c) for c in df.columns),
    )

    def total(c: str) -> Column:
        before = F.col(f"_before_{c}")
        return F.when(before.isNull(), F.col(c)).otherwise(merge[totals[c]](F.col(c), before))

    return local.join(carried, "_chunk").select(
        *(total(c).alias(c) if c in totals else F.col(c) for c in df.columns)
    )


def with_next(
    df: DataFrame, keys: Sequence[str], order: str, chunk_seconds: float, name: str
) -> DataFrame:
    """Add ``name``: the value of ``order`` in the next row of the same key, null at the end.

    Rows of one key that share an ``order`` value must have been reduced to one.  If no
    key has more rows than a task should get, one ordered pass per key will do.
    """
    if keys and not skew.hot_keys(df, keys):
        return df.withColumn(name, F.lead(order).over(Window.partitionBy(*keys).orderBy(order)))
    chunked = df.withColumn("_chunk", F.floor(epoch_seconds(df, order) / F.lit(chunk_seconds)))
    local = chunked.withColumn(
        name, F.lead(order).over(Window.partitionBy(*keys, "_chunk").orderBy(order))
    )
    first = chunked.groupBy(*keys, "_chunk").agg(F.min(order).alias("_first"))
    following = first.select(
        *keys,
        "_chunk",
        F.lead("_first").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_next"),
    )
    # Only the last row of each chunk still lacks its next value: one row per chunk
    # and key meets one row, so no key is heavy in this join.
    ends = local.where(F.col(name).isNull()).drop(name)
    closed = ends.join(following, [*keys, "_chunk"]).withColumnRenamed("_next", name)
    columns = [*df.columns, name]
    return local.where(F.col(name).isNotNull()).select(columns).unionByName(closed.select(columns))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the place of each row, from 0, among the rows of its key in ``order``.

    Rows are dealt by ranges of key and order, so that a key of any size is spread over many
    tasks; each is counted from the start of its range, and one row per key and range
    carries the counts before it.  ``order`` must tell the rows of a key apart.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id())
    dealt = cut_lineage(dealt, "ranges")
    local = Window.partitionBy(*keys, "_range").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        dealt.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"))
    )
    return (
        dealt.withColumn("_row", F.row_number().over(local) - 1)
        .join(ahead, [*keys, "_range"])
        .select(*df.columns, (F.col("_ahead") + F.col("_row")).alias(name))
    )
