"""Equi-joins in which one key may hold a large part of the bigger side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.plans import sizing
from driftgrid.session import cut_lineage

# What one task should get of a key at most: rows of either side, and pairs of rows.
# The bounds hold at any size of the data.
TASK_ROWS = 1_000_000
TASK_PAIRS = 100_000_000
# Broadcasts that a small side is dealt over at most, where it is too large for one.
SHARES = 24

_HASH = "_key_hash"


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*(F.col(k) for k in keys))


def hot_keys(df: DataFrame, keys: Sequence[str], task_rows: int | None = None) -> bool:
    """Whether a key of the frame has more rows than a task should get."""
    task_rows = TASK_ROWS if task_rows is None else task_rows
    counts = df.groupBy(_hash(keys).alias(_HASH)).agg(F.count("*").alias("n"))
    return bool(counts.where(F.col("n") > task_rows).take(1))


def parts(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    both: bool = True,
    task_rows: int | None = None,
    task_pairs: int | None = None,
) -> DataFrame:
    """How to split the hot keys of a join: their hash, ``_pb`` parts of ``big``, ``_ps`` of
    ``small``.

    Rows are counted per key hash on both sides.  Each side is cut into parts of
    ``task_rows`` at most, and the side with more rows in a part further, until two parts
    make no more than ``task_pairs`` pairs.  Without ``both`` only ``big`` is cut.  Two keys
    of the same hash are split alike, which does no harm.
    """
    rows = TASK_ROWS if task_rows is None else task_rows
    pairs = TASK_PAIRS if task_pairs is None else task_pairs

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(_hash(keys).alias(_HASH)).agg(F.count("*").alias(name))

    nb, ns, pb, ps = (F.col(c) for c in ("_nb", "_ns", "_pb", "_ps"))
    met = counted(big, "_nb").join(counted(small, "_ns"), _HASH)
    hot = met.where((nb > rows) | (ns > rows) | (nb * ns.cast("double") > pairs))
    cut = hot.withColumns(
        {"_pb": F.ceil(nb / rows), "_ps": F.ceil(ns / rows) if both else F.lit(1).cast("bigint")}
    )
    more = F.greatest(F.ceil((nb / pb) * (ns / ps) / pairs), F.lit(1))
    on_big = (nb / pb >= ns / ps) if both else F.lit(True)
    cut = cut.withColumns({"_more": more, "_on_big": on_big})
    return cut.select(
        _HASH,
        # Never more parts than rows.
        F.least(F.when(F.col("_on_big"), pb * F.col("_more")).otherwise(pb), nb).cast("int").alias("_pb"),
        F.least(F.when(F.col("_on_big"), ps).otherwise(ps * F.col("_more")), ns).cast("int").alias("_ps"),
    )


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    task_rows: int | None = None,
    task_pairs: int | None = None,
) -> DataFrame:
    """Shuffle join on ``keys`` with hot keys split over many tasks by the work they make.

    The rows of a hot key are dealt to the parts of their side by a hash of their content
    and repeated for each part of the other, so every pair still meets exactly once.
    ``how`` may be inner, left, left_semi or left_anti; all but inner split ``big`` only.
    """
    split = cut_lineage(parts(big, small, keys, how == "inner", task_rows, task_pairs), "hot")
    size = sizing.measure(split)
    if not size["n_rows"]:
        return big.join(small, list(keys), how)
    if sizing.fits_broadcast(split, size["n_bytes"]):
        split = F.broadcast(split)

    def dealt(df: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        spread = F.xxhash64(*(F.col(c) for c in df.columns))
        mine = F.coalesce(F.pmod(spread, F.col(own)).cast("int"), F.lit(0))
        each = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
        return (
            df.withColumn(_HASH, _hash(keys))
            .join(split, _HASH, "left")
            .select(*df.columns, mine.alias(names[0]), F.explode(each).alias(names[1]))
        )

    big = dealt(big, "_pb", "_ps", ("_sb", "_ss"))
    small = dealt(small, "_ps", "_pb", ("_ss", "_sb"))
    return big.join(small, [*keys, "_sb", "_ss"], how).drop("_sb", "_ss")


def sized_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    n_bytes: float | None = None,
    salts: int = 1,
) -> DataFrame:
    """Broadcast ``small`` when its measured size allows it, else a salted shuffle join.

    A stream cannot be counted beforehand: there ``salts`` above 1 split every key, which
    repeats the rows of ``small`` as often.
    """
    if not small.isStreaming:
        if n_bytes is None:
            n_bytes = sizing.measure(small)["n_bytes"]
        if sizing.fits_broadcast(small, n_bytes):
            return big.join(F.broadcast(small), list(keys), how)
    if not big.isStreaming and not small.isStreaming:
        return salted_join(big, small, keys, how)
    if salts == 1:
        return big.join(small, list(keys), how)
    spread = F.xxhash64(*(F.col(c) for c in big.columns))
    big = big.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.join(small, [*keys, "_salt"], how).drop("_salt")


def shared_join(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``sized_join`` for a ``big`` that should not be shuffled, as it is far larger than its sources.

    A ``small`` beyond the broadcast threshold is dealt by key over a few broadcasts, each
    measured to be within it; ``big`` is then worked out for the keys of each in turn.  Where that
    is not possible, both sides are shuffled.
    """
    if big.isStreaming or small.isStreaming:
        return sized_join(big, small, keys)
    n_bytes = sizing.measure(small)["n_bytes"]
    limit = sizing.broadcast_limit(small)
    # Half as many again as the bytes need, since keys are not dealt evenly.
    n = ceil(1.5 * n_bytes / limit) if limit > 0 else 0
    if n_bytes <= limit or not 1 < n <= SHARES:
        return sized_join(big, small, keys, n_bytes=n_bytes)
    share = F.pmod(_hash(keys), F.lit(n))
    held = small.groupBy(share).agg(F.sum(sizing.row_bytes(small)).alias("n_bytes"))
    if held.agg(F.max("n_bytes")).first()[0] > limit:
        return sized_join(big, small, keys, n_bytes=n_bytes)
    joined = [big.where(share == i).join(F.broadcast(small.where(share == i)), list(keys)) for i in range(n)]
    return reduce(DataFrame.union, joined)
