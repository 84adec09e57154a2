"""k-nearest-neighbour queries over located objects, ranks and rank changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.functions import spatial
from driftgrid.operators.aggregates import latest_per_key
from driftgrid.plans import sizing, skew
from driftgrid.plans.grid import grid_join
from driftgrid.plans.shapes import shapes
from driftgrid.session import cut_lineage

# Levels of the density histogram and how cells grow; a last one takes in all objects.
_LEVELS = 7
_STEP = 4.0
_EVERYWHERE = 99
# Cells of one level that a far query is held against at most.
_FAR_CELLS = 1024


def knn_queries(df: DataFrame) -> DataFrame:
    """One row per query id; a query sent again replaces the earlier one by ``ts``.

    Without times the greatest (fx, fy, k) counts.
    """
    return latest_per_key(df, "qid", "ts" if "ts" in df.columns else "fx")


def _levels() -> Column:
    return F.array(*(F.lit(v) for v in [*range(_LEVELS), _EVERYWHERE]))


def _at_level(c: Column) -> Column:
    fan = F.pow(F.lit(_STEP), F.col("_lv"))
    return F.when(F.col("_lv") == _EVERYWHERE, 0).otherwise(F.floor(c / fan))


def _extent() -> tuple[Column, ...]:
    return (
        F.sum("_n").alias("_n"),
        F.min("_x0").alias("_x0"), F.max("_x1").alias("_x1"),
        F.min("_y0").alias("_y0"), F.max("_y1").alias("_y1"),
    )


def _reach() -> Column:
    """Distance from (fx, fy) to the far corner of an extent, rounded up."""
    dx = F.greatest(F.abs(F.col("fx") - F.col("_x0")), F.abs(F.col("fx") - F.col("_x1")))
    dy = F.greatest(F.abs(F.col("fy") - F.col("_y0")), F.abs(F.col("fy") - F.col("_y1")))
    return F.sqrt(dx * dx + dy * dy) * (1 + 1e-9)


def _density(objects: DataFrame, cell: float, by: Sequence[str]) -> DataFrame:
    """Number and extent of the objects in each cell of each level."""
    cells = objects.groupBy(
        *by, F.floor(F.col("x") / cell).alias("_bx"), F.floor(F.col("y") / cell).alias("_by")
    ).agg(
        F.count("*").alias("_n"),
        F.min("x").alias("_x0"), F.max("x").alias("_x1"),
        F.min("y").alias("_y0"), F.max("y").alias("_y1"),
    )
    return (
        cells.withColumn("_lv", F.explode(_levels()))
        .groupBy(*by, "_lv", _at_level(F.col("_bx")).alias("_cx"), _at_level(F.col("_by")).alias("_cy"))
        .agg(*_extent())
    )


def _search_boxes(
    objects: DataFrame, queries: DataFrame, n_queries: int, cell: float, by: Sequence[str]
) -> DataFrame:
    """For each query a box sure to hold its k nearest objects.

    Objects are counted per cell on levels of growing cells.  If the three by three cells
    around a query hold k objects, the far corner of their extent bounds the k-th distance.
    The smallest such bound over the levels is taken.  A query too far from the objects to
    find k that way is bounded by the nearest of some coarse cells.
    """
    density = _density(objects, cell, by)
    levels = _levels()
    near = F.when(F.col("_lv") == _EVERYWHERE, F.array(F.lit(0))).otherwise(
        F.array(F.lit(-1), F.lit(0), F.lit(1))
    )
    looked = (
        queries.select("qid", "fx", "fy", "k", F.explode(levels).alias("_lv"))
        .withColumn("_cx", F.explode(F.transform(near, lambda d: _at_level(F.floor(F.col("fx") / cell)) + d)))
        .withColumn("_cy", F.explode(F.transform(near, lambda d: _at_level(F.floor(F.col("fy") / cell)) + d)))
    )
    per_query = (9 * _LEVELS + 1) * 8 * (len(looked.columns) + 2)
    seen = (
        skew.sized_join(density, looked, ["_lv", "_cx", "_cy"], n_bytes=n_queries * per_query)
        .groupBy(*by, "qid", "fx", "fy", "k", "_lv")
        .agg(*_extent())
        .where((F.col("_n") >= F.col("k")) | (F.col("_lv") == _EVERYWHERE))
    )
    bound = seen.groupBy(*by, "qid", "fx", "fy", "k").agg(
        F.min(_reach()).alias("_r"), (F.min("_lv") == _EVERYWHERE).alias("_far")
    )
    bound = cut_lineage(bound, "bounds")
    if bound.where("_far").take(1):
        bound = _nearer(bound, density, by)
    return bound.select(
        *by, "qid", "fx", "fy", "k",
        (F.col("fx") - F.col("_r")).alias("x_min"), (F.col("fy") - F.col("_r")).alias("y_min"),
        (F.col("fx") + F.col("_r")).alias("x_max"), (F.col("fy") + F.col("_r")).alias("y_max"),
    )


def _nearer(bound: DataFrame, density: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bounds of far queries by the cells of the finest level that has few of them.

    Cells are taken in the order of their far corners until they hold k objects.
    """
    sizes = density.groupBy(*by, "_lv").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("_lv").agg(F.max("n").alias("n")).where(F.col("n") <= _FAR_CELLS)
    level = sizes.agg(F.min("_lv")).first()[0]
    cell = F.struct("_n", "_x0", "_x1", "_y0", "_y1")
    # One row per group of objects, with a bounded list.
    cells = density.where(F.col("_lv") == level).groupBy(*by).agg(F.collect_list(cell).alias("_cells"))
    far = bound.where("_far").withColumn("_one", F.col("_far").cast("int"))
    cells = cells.withColumn("_one", F.least(F.size("_cells"), F.lit(1)))
    spread = far.join(cells, [*by, "_one"]).select(*far.columns, F.inline("_cells"))
    spread = spread.withColumn("_reach", _reach())
    first = Window.partitionBy(*by, "qid").orderBy("_reach").rowsBetween(Window.unboundedPreceding, 0)
    enough = spread.withColumn("_sum", F.sum("_n").over(first)).where(F.col("_sum") >= F.col("k"))
    found = enough.groupBy(*by, "qid").agg(F.min("_reach").alias("_better"))
    both = bound.join(found, [*by, "qid"], "left")
    return both.withColumn("_r", F.least("_r", F.coalesce("_better", "_r"))).drop("_better")


def knn_join(
    objects: DataFrame, queries: DataFrame, cell: float, by: Sequence[str] = ()
) -> DataFrame:
    """The k nearest objects (oid, x, y) of every query (qid, fx, fy, k), with ranks.

    Objects must be one row each (``latest_per_key``).  Ties in distance go to the
    lesser oid.  ``by`` runs the queries separately on each group of objects.  Queries for the
    same k and place are answered once.
    Columns: by…, qid, oid, distance, rank.
    """
    kinds = shapes(knn_queries(queries).dropna(subset=["fx", "fy", "k"]), ["fx", "fy", "k"])
    queries = kinds.rows
    size = sizing.measure(queries.select("qid", "fx", "fy", "k"), top=F.max("k"))
    max_k = size["top"] or 0
    objects = _foremost(objects.select(*by, "oid", "x", "y"), max_k, by)
    boxes = _search_boxes(objects, queries, size["n_rows"], cell, by)
    candidates = grid_join(objects, boxes, cell, by)
    d = spatial.dist(F.col("x"), F.col("y"), F.col("fx"), F.col("fy"))
    nearest = Window.partitionBy(*by, "qid").orderBy("distance", "oid")
    return kinds.expand(
        candidates.select(*by, "qid", "k", "oid", d.alias("distance"))
        .withColumn("rank", F.row_number().over(nearest))
        # The literal bound lets every task drop all but its own best before the shuffle.
        .where((F.col("rank") <= max_k) & (F.col("rank") <= F.col("k")))
        .drop("k")
    )


def _foremost(objects: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """Of the objects in one spot the ``k`` of least oid: no list can hold another one."""
    spot = Window.partitionBy(*by, "x", "y").orderBy("oid")
    return objects.withColumn("_nth", F.row_number().over(spot)).where(F.col("_nth") <= k).drop("_nth")


def knn_current(ranked: DataFrame) -> DataFrame:
    """Ranks in force: (qid, oid, rank)."""
    return ranked.select("qid", "oid", "rank")


def kth_distance(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distance from each query to the farthest of its nearest objects."""
    return ranked.groupBy(*by, "qid").agg(
        F.max("distance").alias("kth_distance"), F.count("*").alias("n_found")
    )


def by_distance(ranked: DataFrame) -> DataFrame:
    """Members of each list from the nearest on, ties by oid."""
    return ranked.orderBy("qid", "distance", "oid")


def knn_changes(prev: DataFrame, cur: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What changed between two ranked lists: ``+`` entered, ``U`` new rank, ``-`` left.

    Columns: by…, qid, oid, change, rank (null on leaving).
    """
    keys = [*by, "qid", "oid"]
    before = prev.select(*keys, F.col("rank").alias("_old"))
    after = cur.select(*keys, F.col("rank").alias("rank"))
    change = (
        F.when(F.col("_old").isNull(), "+")
        .when(F.col("rank").isNull(), "-")
        .when(F.col("_old") != F.col("rank"), "U")
    )
    return (
        before.join(after, keys, "full_outer")
        .select(*keys, change.alias("change"), "rank")
        .where(F.col("change").isNotNull())
    )
