"""Queries that ask the same are answered once.

Of thousands of queries many may have the same box, or the same place and k.  Joins then work
on one row for each such shape, under a number, and the ids of all its queries are put to
the result at the end, where nothing is sorted or shuffled any more if they are few.  The
number follows from the shape alone, so that it may be kept between the batches of a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.plans import sizing, skew
from driftgrid.session import cut_lineage

# Ids of one shape are held in lists of about this length.
PAGE = 1000

# More partitions than any frame has.
_ANY = 1_000_000

_SHAPE = "_shape"
_IDS = "_ids"


@dataclass
class Shapes:
    """``rows``: a row per shape, with its number as ``number``; ``members``: the ids behind it.

    Without members the rows are the queries themselves.  ``ids`` are the columns that
    tell the rows of one shape apart; a single one has the name of the number.
    """

    rows: DataFrame
    members: DataFrame | None
    number: str = "qid"
    ids: Sequence[str] = ("qid",)
    # What numbers are counted in, besides themselves, such as the batches of a stream.
    within: Sequence[str] = ()

    def listed(self, result: DataFrame) -> DataFrame:
        """A result on the shapes with the lists of their ids, which ``spread`` writes out."""
        if self.members is None:
            return result
        numbered = result.withColumnRenamed(self.number, _SHAPE)
        lists = self.members.withColumnRenamed(_IDS, self._list)
        return skew.shared_join(numbered, lists, [*self.within, _SHAPE]).drop(_SHAPE)

    def spread(self, listed: DataFrame) -> DataFrame:
        """A row for every id of the lists."""
        if self.members is None:
            return listed
        others = [c for c in listed.columns if c != self._list]
        if len(self.ids) == 1:
            return listed.select(*others, F.explode(self._list).alias(self.number))
        return listed.select(*others, F.inline(self._list))

    def expand(self, result: DataFrame) -> DataFrame:
        """A result on the shapes as the result on all queries."""
        columns = [self.ids if c == self.number else [c] for c in result.columns]
        spread = self.spread(self.listed(result))
        return spread if self.members is None else spread.select(*(c for part in columns for c in part))

    def answer(self, work: Callable[[DataFrame], DataFrame], n_bytes: float) -> DataFrame:
        """``work`` on the shapes, as the result on all queries; each row of it belongs to one shape.

        ``n_bytes`` is what ``work`` broadcasts for all shapes.  If that or the lists of ids exceed
        the broadcast threshold, the shapes are dealt over shares within it.  Each is worked out
        and gets its ids by itself, so that results, which may be thousands of times their
        sources, are not shuffled.  Where that takes too many shares, they are.
        """
        parts = [] if self.members is None else self._shares(n_bytes)
        if not parts:
            return self.expand(work(self.rows))
        done = []
        for part in parts:
            found = work(part.rows)
            columns = [c for name in found.columns for c in (part.ids if name == part.number else [name])]
            lists = F.broadcast(part.members.withColumnRenamed(_IDS, part._list))
            listed = found.withColumnRenamed(part.number, _SHAPE).join(lists, _SHAPE).drop(_SHAPE)
            # Tasks of their own for each share: a union of frames dealt alike would put their
            # partitions, and the memory they take, into one.
            done.append(part.spread(listed).select(columns).coalesce(_ANY))
        return reduce(DataFrame.union, done)

    def _shares(self, n_bytes: float) -> list[Shapes]:
        """The shapes in shares whose lists, and whose part of ``n_bytes``, fit a broadcast."""
        limit = sizing.broadcast_limit(self.rows)
        held = sizing.measure(self.members)["n_bytes"]
        if limit <= 0 or max(held, n_bytes) > limit * skew.SHARES:
            return []
        # Half as many again as the bytes need, since shapes are not dealt evenly.
        n = ceil(1.5 * max(held, n_bytes) / limit) if max(held, n_bytes) > limit else 1
        if n == 1:
            return [self]
        if n > skew.SHARES:
            return []

        def share(name: str):
            return F.pmod(F.xxhash64(name), F.lit(n))

        lists = self.members.groupBy(share(_SHAPE)).agg(F.sum(sizing.row_bytes(self.members)).alias("n"))
        rows = self.rows.groupBy(share(self.number)).agg(F.count("*").alias("n"))
        all_rows = self.rows.count()
        if lists.agg(F.max("n")).first()[0] > limit or rows.agg(F.max("n")).first()[0] * n_bytes > limit * all_rows:
            return []
        return [
            replace(self, rows=self.rows.where(share(self.number) == i), members=self.members.where(share(_SHAPE) == i))
            for i in range(n)
        ]

    @property
    def _list(self) -> str:
        return f"{_IDS}_{self.number}"


def shapes(
    queries: DataFrame,
    columns: Sequence[str],
    ids: Sequence[str] = ("qid",),
    number: str = "qid",
    always: bool = False,
) -> Shapes:
    """One row for all queries that are equal in ``columns``, where those are half of them or more.

    ``always`` numbers them in any case.  A null among the columns equals another one.  A stream
    is taken as it is.
    """
    queries = queries.select(*ids, *columns)
    if queries.isStreaming:
        return Shapes(queries, None, number, ids)
    counted = queries.groupBy(*columns).agg(F.count("*").alias("_n")).withColumn(_SHAPE, F.xxhash64(*columns))
    n = counted.agg(
        F.count("*").alias("kinds"), F.sum("_n").alias("queries"), F.count_distinct(_SHAPE).alias("numbers")
    ).first()
    if n.numbers < n.kinds and always:
        raise ValueError("two shapes have the same number")
    if not always and (not n.kinds or n.queries < 2 * n.kinds or n.numbers < n.kinds):
        return Shapes(queries, None, number, ids)
    numbered = cut_lineage(counted, "shapes")
    page = F.pmod(F.xxhash64(*ids), F.ceil(F.col("_n") / PAGE))
    item = F.col(ids[0]) if len(ids) == 1 else F.struct(*ids)
    listed = (
        skew.sized_join(queries.select(*ids, F.xxhash64(*columns).alias(_SHAPE)), numbered.select(_SHAPE, "_n"), [_SHAPE])
        .groupBy(_SHAPE, page.alias("_page"))
        .agg(F.collect_list(item).alias(_IDS))
    )
    members = cut_lineage(listed.select(_SHAPE, _IDS), "members")
    return Shapes(numbered.select(F.col(_SHAPE).alias(number), *columns), members, number, ids)
