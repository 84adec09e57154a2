"""Joins of moving objects with range queries, and of messages with each other."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions import spatial
from driftgrid.functions.text import any_shared_word, distinct_words, shared_words
from driftgrid.functions.timestamps import epoch_micros, seconds, span
from driftgrid.operators.aggregates import latest_per_key
from driftgrid.plans import ordered, skew
from driftgrid.plans.grid import TOP_LEVEL, filed_bytes, grid_join, level_of
from driftgrid.plans.shapes import Shapes, shapes
from driftgrid.session import cut_lineage

BOUNDS = ("x_min", "y_min", "x_max", "y_max")
_SPOT = ["ts", "x", "y"]


def range_join(
    points: DataFrame, boxes: DataFrame, cell: float, on: Sequence[str] = ()
) -> DataFrame:
    """Every point with the id of every box that holds it.

    ``cell`` is the side of the finest grid cell, best near the side of a usual box.  Equal
    boxes are joined once.
    """
    kinds = box_shapes(boxes, on)

    def work(rows: DataFrame) -> DataFrame:
        return grid_join(points, rows, cell, on).drop(*BOUNDS)

    return kinds.expand(work(kinds.rows)) if points.isStreaming else answer(kinds, work, cell)


def answer(kinds: Shapes, work: Callable[[DataFrame], DataFrame], cell: float) -> DataFrame:
    """``work`` on distinct boxes, which joins them by cells, as the result on all boxes."""
    return kinds.answer(work, 0 if kinds.members is None else filed_bytes(kinds.rows, cell))


def together(points: DataFrame, kinds: Shapes, key: str = "oid") -> DataFrame | None:
    """The points dealt by ``key``, so that what is grouped by it and more is not shuffled again.

    A task gets so many points that their pairs with boxes are no more than it should get.  None
    if a single key is too much for one.
    """
    n_kinds = max(1, kinds.rows.count())
    counts = points.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    if (counts.most or 0) > min(skew.TASK_ROWS, skew.TASK_PAIRS // n_kinds):
        return None
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.repartition(max(tasks, ceil((counts.n or 0) * n_kinds / skew.TASK_PAIRS)), key)


def box_shapes(boxes: DataFrame, on: Sequence[str] = ()) -> Shapes:
    """The boxes that hold something, equal ones as one."""
    if not boxes.isStreaming:
        boxes = boxes.where((F.col("x_min") <= F.col("x_max")) & (F.col("y_min") <= F.col("y_max")))
        boxes = boxes.dropna(subset=list(on)) if on else boxes
    return shapes(boxes, [*on, *BOUNDS])


def range_join_ttl(
    points: DataFrame, queries: DataFrame, ttl: float, cell: float, widest: float | None = None
) -> DataFrame:
    """``range_join`` with queries that live ``ttl`` seconds from their own ``ts`` on.

    Streams of boxes cannot be measured, so their points are looked up on every level of cells.
    ``widest``, the side that few boxes exceed, spares the levels above; a wider box is filed under
    more cells, so the result does not depend on it.
    """
    live = queries.select(
        "qid", *BOUNDS, F.col("ts").alias("q_ts"), (F.col("ts") + seconds(ttl)).alias("_end")
    )
    # A lifetime is one time bucket long, so it always lies on the lowest time level.
    top = TOP_LEVEL if widest is None else level_of(widest, cell)
    levels = [(level, 0) for level in range(top + 1)]
    joined = grid_join(
        points, live, cell, valid=("q_ts", "_end"), bucket=ttl, levels=levels, top=top
    ).drop("_end", *BOUNDS)
    # Said once more on the watermarked columns: a stream may then forget old points.
    life = F.expr(f"interval '{ttl}' second")
    return joined.where(F.col("ts") < F.col("q_ts") + life)


def query_validity(versions: DataFrame, chunk_seconds: float = 86400.0) -> DataFrame:
    """Versions of queries with the time they hold, [valid_from, valid_to).

    A version ends when the next one of its qid arrives; of several with the same time
    the one with the greatest box counts.
    """
    one_each = latest_per_key(versions.select("qid", "ts", *BOUNDS), ["qid", "ts"], "x_min")
    return ordered.with_next(one_each, ["qid"], "ts", chunk_seconds, "valid_to").withColumnRenamed(
        "ts", "valid_from"
    )


def moving_range_join(
    points: DataFrame, versions: DataFrame, cell: float, bucket: float = 3600.0
) -> DataFrame:
    """``range_join`` in which a query is replaced when its id is seen again.

    A point meets, per query id, the version that was the latest at its own ``ts``.
    ``bucket`` (seconds) is best near the usual time between two versions.  Equal versions, and
    points of one time and place, are joined once.
    """
    return version_matches(points, versions, cell, bucket).rows()


@dataclass
class VersionMatches:
    """Points in versions of queries, ``found`` by numbers of equal versions (``qid``) and of
    equal times and places (``spot``), where those are many; ``rows`` has a row for each."""

    found: DataFrame
    live: Shapes
    spots: Shapes
    columns: list[str]

    def rows(self) -> DataFrame:
        # Both lists come to a match before either is written out: what is shuffled are matches.
        listed = self.spots.listed(self.live.listed(self.found))
        return self.live.spread(self.spots.spread(listed)).select(self.columns)


def stored_matches(
    found: DataFrame, members: dict[str, DataFrame], columns: Sequence[str], within: Sequence[str]
) -> VersionMatches:
    """``version_matches`` that were stored, numbered anew in every value of ``within``."""
    live = Shapes(found, members["qid"], within=within)
    spots = Shapes(found, members["spot"], "spot", [c for c in columns if c not in _SPOT], within)
    return VersionMatches(found, live, spots, [*columns, "qid", "valid_from"])


def version_matches(
    points: DataFrame, versions: DataFrame, cell: float, bucket: float, always: bool = False
) -> VersionMatches:
    """``moving_range_join``, equal versions joined once with the points of one time and place.

    A version is equal to another if both box and time are.  ``always`` numbers both in any case.
    """
    live = cut_lineage(query_validity(versions), "validity")
    kinds = shapes(live, ["valid_from", "valid_to", *BOUNDS], always=always)
    met = points.dropna(subset=_SPOT)
    spots = shapes(met, _SPOT, [c for c in points.columns if c not in _SPOT], "spot", always)
    joined = grid_join(
        spots.rows, kinds.rows, cell, valid=("valid_from", "valid_to"), bucket=bucket
    )
    return VersionMatches(
        joined.drop("valid_to", *BOUNDS), kinds, spots, [*points.columns, "qid", "valid_from"]
    )


def first_entries(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """The time each object first was in each box (``entered``), with the box.

    One row per (qid, oid) at most: what sticky containment needs to know, without its
    result, which has a row for every later point.
    """
    kinds, seen = box_shapes(boxes), points.select("oid", *_SPOT)
    if kinds.members is not None:
        # Points are fewer than the boxes they were in, so it is they that are shuffled.
        dealt = together(seen, kinds)
        seen = seen if dealt is None else dealt
    return answer(kinds, lambda rows: entries(seen, rows, cell), cell)


def entries(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """``first_entries`` of boxes taken as they are."""
    hits = grid_join(points.select("oid", "ts", "x", "y"), boxes.select("qid", *BOUNDS), cell)
    return hits.groupBy("qid", "oid", *BOUNDS).agg(F.min("ts").alias("entered"))


def ever_inside(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Sticky containment: from an object's first point inside a box on, all its points.

    One row per (qid, point), with ``inside_now`` telling if the point itself is inside.
    The first entry per (qid, oid) is a small aggregate; no object's history is sorted.  Equal
    boxes have the same entries, so their ids come to the result last.
    """
    kinds = box_shapes(boxes)
    dealt = together(points, kinds) if kinds.members is not None else None
    if dealt is not None:
        # The entries, many more than the points, stay where the points of their object are.
        def work(rows: DataFrame) -> DataFrame:
            return after_entry(dealt, entries(dealt, rows, cell), DataFrame.join)

        return answer(kinds, work, cell)
    entered = cut_lineage(entries(points, kinds.rows, cell), "entered")
    return kinds.expand(after_entry(points, entered))


def after_entry(
    points: DataFrame, entered: DataFrame, join: Callable[..., DataFrame] = skew.salted_join
) -> DataFrame:
    """The points of each object from its entry into a box on, and if they are inside."""
    sticky = join(points, entered, ["oid"]).where(F.col("ts") >= F.col("entered"))
    now = spatial.in_bounds_box(F.col("x"), F.col("y"), *(F.col(b) for b in BOUNDS))
    return sticky.withColumn("inside_now", now).drop("entered", *BOUNDS)


def segment_join(
    points: DataFrame, segments: DataFrame, cell: float, eps: float = spatial.LINE_TOLERANCE
) -> DataFrame:
    """Points on line segments, within their ends.

    A segment's bounding box, widened by the tolerance, finds the candidates.
    """
    ends = ("x1", "y1", "x2", "y2")
    reach = segments.select(
        "sid",
        *ends,
        F.least("x1", "x2").alias("x_min"),
        (F.least("y1", "y2") - eps).alias("y_min"),
        F.greatest("x1", "x2").alias("x_max"),
        (F.greatest("y1", "y2") + eps).alias("y_max"),
    )
    near = grid_join(points, reach, cell)
    on = spatial.on_line(F.col("x"), F.col("y"), *(F.col(e) for e in ends), eps=eps, bounded=True)
    return near.where(on).drop(*ends, *BOUNDS)


_PLACE = ("id", "ts", "x", "y")
_MESSAGE = (*_PLACE, "words")
# Cells are so many times as wide as the distance, and as long as the time, of a pair: only
# messages near an edge are copied over it.  Wide ones make fewer copies and more candidates.
_WIDTHS = 2
_LENGTHS = 4
# With words copies are what costs most.
_WIDTHS_WORDS = 4
# Cells around a cell, one of each opposite pair, plus the cell itself.
_HALF_NEIGHBOURS = ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))


def distance_self_join(
    df: DataFrame,
    r: float,
    size: float,
    slide: float | None = None,
    require_keywords: bool = False,
    distinct_pairs: bool = False,
    words: bool = True,
) -> DataFrame:
    """Pairs of messages (id, ts, x, y, words) of one window closer than ``r``.

    Each pair comes both ways round, with its distance and the sorted words both have.
    Messages with the same id make no pair.  A pair comes once per window holding both;
    with ``distinct_pairs`` once in all, if its times differ by less than ``size``.
    ``require_keywords`` keeps only pairs that share a word.  Without ``words`` the result lacks
    the words of both messages: they are then sorted once per message, not per pair, and each is
    shuffled once.

    Every unordered pair is tested once, in the cell of the first message, and turned round
    afterwards.  Messages are copied with their words to the cells within ``r``, some four times
    each; the pairs, which may be many more, are not shuffled.  Where windows overlap, pairs are
    found once by their times and only then put into the windows that hold both.
    """
    sliding = slide is not None and slide < size
    by_time = distinct_pairs or sliding
    message = df.select(*_MESSAGE)
    if not words:
        message = message.withColumn("words", F.sort_array(distinct_words(F.col("words"))))
    met = _met(message, r, size, by_time, ("words",))

    window = [] if distinct_pairs else ["window_start", "window_end"]
    if window:
        if sliding:
            later, earlier = F.greatest("ts1", "ts2"), F.least("ts1", "ts2")
            met = met.withColumn("_slot", _window(later, size, slide))
            met = met.where(F.col("_slot.start") <= earlier)
        met = met.withColumns({w: F.col(f"_slot.{w[7:]}") for w in window})
    # Pairs of no window are gone by now.
    w1, w2 = F.col("words1"), F.col("words2")
    if require_keywords:
        met = met.where(any_shared_word(w1, w2))
    # Of sorted words the common ones come in their order.
    met = met.withColumn("shared", shared_words(w1, w2) if words else F.array_intersect(w1, w2))
    turned = met.withColumn("_turned", F.explode(F.array(F.lit(False), F.lit(True))))

    return turned.select(*window, "distance", "shared", *_sides(_MESSAGE if words else _PLACE))


def close_pairs(df: DataFrame, r: float, size: float, digits: int | None = None) -> DataFrame:
    """Pairs of messages closer than ``r`` whose times differ by less than ``size``: the pairs of
    ``distance_self_join`` with ``distinct_pairs``, without their words.

    Columns: distance and id, ts, x, y of both; each pair comes both ways round.  Messages need
    no words, and the pairs are not shuffled.  ``digits`` rounds the distances, once per pair.
    """
    met = _met(df.select(*_PLACE), r, size, True, ())
    if digits is not None:
        met = met.withColumn("distance", F.round("distance", digits))
    turned = met.withColumn("_turned", F.explode(F.array(F.lit(False), F.lit(True))))
    return turned.select("distance", *_sides(_PLACE))


def _sides(columns: Sequence[str]) -> list[Column]:
    """Both messages of a pair, the other way round where it is ``_turned``."""

    def side(c: str, a: str, b: str) -> Column:
        return F.when(F.col("_turned"), F.col(f"{c}{b}")).otherwise(F.col(f"{c}{a}"))

    return [*(side(c, "1", "2").alias(f"{c}1") for c in columns), *(side(c, "2", "1").alias(f"{c}2") for c in columns)]


def _window(ts: Column, size: float, slide: float) -> Column:
    return F.window(ts, span(size), span(slide))


def _met(
    df: DataFrame, r: float, size: float, by_time: bool, carried: Sequence[str]
) -> DataFrame:
    """Pairs closer than ``r``, each once: of one window, or less than ``size`` apart in time.

    ``carried`` names the columns besides id, time and place.
    """
    columns, side = (*_PLACE, *carried), (_WIDTHS_WORDS if carried else _WIDTHS) * float(r)
    ahead = F.lit(True)
    if by_time:
        # Slots are whole microseconds long, so that a fraction of a second counts.
        step, micros = F.lit(_LENGTHS * round(size * 1_000_000)), epoch_micros(df, "ts")
        ahead = step - F.pmod(micros, step) <= round(size * 1_000_000)
        slot = ((micros - F.pmod(micros, step)) / step).cast("bigint")
        ts = F.col("ts").alias("ts1")
    else:
        slot = _window(F.col("ts"), size, size)
        # On a stream the window alone is to carry the watermark, so the time gives it up.
        ts = F.col("ts").alias("ts1", metadata={"comment": "message time"})
    rows = df.withColumn("_slot", slot).select(
        *(ts if c == "ts" else F.col(c).alias(f"{c}1") for c in columns),
        "_slot",
        F.floor(F.col("x") / side).alias("_cx"),
        F.floor(F.col("y") / side).alias("_cy"),
        ahead.alias("_ahead"),
    )
    steps = [(0, dx, dy) for dx, dy in _HALF_NEIGHBOURS]
    if by_time:
        # Times under ``size`` apart lie in the same or in adjoining slots; the cells of the
        # later slot are looked up from the earlier one.
        steps += [(1, dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    moves = F.array(
        *(
            F.struct(F.lit(t).alias("dt"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
            for t, dx, dy in steps
        )
    )

    def reached(c: str, cell: str) -> Column:
        """The steps along an axis to cells that begin within ``r``, with room for rounding."""
        at = F.col(f"{c}1")
        room = r * (1 + 1e-6) + F.abs(at) * 1e-12
        step = F.col(f"_move.d{c}")
        low = (F.col(cell) + step) * side
        return (step == 0) | ((step > 0) & (low - at <= room)) | ((step < 0) & (at - (low + side) <= room))

    moved = rows.withColumn("_move", F.explode(moves))
    near = reached("x", "_cx") & reached("y", "_cy") & ((F.col("_move.dt") == 0) | F.col("_ahead"))
    rows = rows.drop("_ahead")
    other = moved.where(near).select(
        *(F.col(f"{c}1").alias(f"{c}2") for c in columns), "_slot", "_cx", "_cy", "_move.*"
    )
    other = other.select(
        *(f"{c}2" for c in columns),
        (F.col("_slot") + F.col("dt") if by_time else F.col("_slot")).alias("_slot"),
        (F.col("_cx") + F.col("dx")).alias("_cx"),
        (F.col("_cy") + F.col("dy")).alias("_cy"),
        ((F.col("dt") == 0) & (F.col("dx") == 0) & (F.col("dy") == 0)).alias("_same"),
    )
    join = skew.sized_join if df.isStreaming else skew.salted_join
    met = join(rows, other, ["_slot", "_cx", "_cy"])
    # Within one cell each pair shows up both ways and the order of the ids picks one.
    ordered_ids, other_ids = F.col("id1") < F.col("id2"), F.col("id1") != F.col("id2")
    met = met.where(F.when(F.col("_same"), ordered_ids).otherwise(other_ids))
    if by_time:
        span = F.expr(f"interval '{size}' second")
        met = met.where(F.col("ts1") < F.col("ts2") + span)
        met = met.where(F.col("ts2") < F.col("ts1") + span)
    d = spatial.dist(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return met.withColumn("distance", d).where(spatial.within(F.col("distance"), r))
