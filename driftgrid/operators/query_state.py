"""Sets of continuous queries as tables: boxes, corners, versions, members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.operators.aggregates import latest_per_key
from driftgrid.plans import ordered, skew

# Items of a list per row: every list comes in pages of this length, whatever its size.
PAGE = 10_000


def latest_query(df: DataFrame) -> DataFrame:
    """Latest version per query id; among equal times the one with the greatest box."""
    return latest_per_key(df, "qid", "ts", "x_min")


def minus_by_key(a: DataFrame, b: DataFrame, key: str = "qid") -> DataFrame:
    """Rows of ``a`` whose key ``b`` lacks."""
    return skew.sized_join(a, b.select(key).distinct(), [key], "left_anti")


def semi_by_key(a: DataFrame, b: DataFrame, key: str = "qid") -> DataFrame:
    """Rows of ``a`` whose key ``b`` has."""
    return skew.sized_join(a, b.select(key).distinct(), [key], "left_semi")


def append_queries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both query sets, duplicates kept."""
    return a.unionByName(b)


def upsert_queries(prev: DataFrame, new: DataFrame) -> DataFrame:
    """The query set after new versions replaced, or joined, the ones there were."""
    fresh = latest_query(new)
    return minus_by_key(prev, fresh).unionByName(fresh)


def query_mbr(corners: DataFrame) -> DataFrame:
    """Bounding box of each query's corner rows (qid, x, y)."""
    return corners.groupBy("qid").agg(
        F.min("x").alias("x_min"),
        F.min("y").alias("y_min"),
        F.max("x").alias("x_max"),
        F.max("y").alias("y_max"),
    )


def query_polygon(corners: DataFrame, page: int = PAGE) -> DataFrame:
    """Corner list of each query (qid, pos, x, y), ordered by ``pos`` counted from 0.

    The corners ``page`` * n to ``page`` * (n + 1) - 1 are in the row of part n.
    """
    return (
        corners.withColumn("part", F.floor(F.col("pos") / page).cast("int"))
        .groupBy("qid", "part")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("_corners"))
        .select(
            "qid",
            "part",
            F.transform(
                "_corners", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))
            ).alias("points"),
        )
    )


def inside_objects(
    matches: DataFrame, columns: tuple[str, ...] = ("oid",), page: int = PAGE
) -> DataFrame:
    """Ids of the objects each query matched, as sorted lists.

    With more ``columns`` than the id the lists hold structs of them.  A list comes in
    pages: part n holds its items ``page`` * n to ``page`` * (n + 1) - 1, so that no row or
    task holds an unbounded list.
    """
    pairs = matches.select("qid", *columns).distinct()
    placed = ordered.positions(pairs, ["qid"], list(columns), "_at")
    totals = placed.groupBy("qid").agg(F.count("*").alias("n_inside"))
    item = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
    pages = (
        placed.withColumn("part", F.floor(F.col("_at") / page).cast("int"))
        .groupBy("qid", "part")
        .agg(F.sort_array(F.collect_list(item)).alias("objects"))
    )
    return pages.join(totals, "qid").select("qid", "part", "n_inside", "objects")
