"""Nearest-object lists kept up to date over streams of objects and of queries.

After a batch only queries are ranked again whose list it can have changed: those with an
updated object in the circle of their k-th distance or among their members, those whose list
is short while new objects came, and those that are new themselves.  For a full list the
present distance of its farthest member bounds the search, so that no density of all objects
is needed.  If a batch moves most of the objects that bound says little, and the density is
taken.  Queries for the same place and k are ranked once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from driftgrid.functions import spatial
from driftgrid.operators import knn
from driftgrid.operators.aggregates import latest_per_key
from driftgrid.plans.grid import grid_join
from driftgrid.session import cut_lineage
from driftgrid.streaming.state_log import StateLog

_QUERY = ("qid", "ts", "fx", "fy", "k")
_SPOT = ("oid", "ts", "x", "y")
# What a list depends on, besides the objects.
_QUESTION = ("fx", "fy", "k")


class NearestLists:
    """The state: ``objects`` (oid, ts, x, y, fresh) and ``lists`` (a query with its members).

    ``members`` are structs (rank, oid, distance) in order of rank.  A query with ``k`` of 0
    or null has left; its row stays, so that an older version that comes late is not taken up.
    """

    def __init__(self, points: DataFrame, queries: DataFrame, cell: float, store: str):
        self.cell, self.live = cell, queries.isStreaming
        self.spots, self.store = points.select(*_SPOT), store
        if "ts" not in queries.columns:
            queries = queries.withColumn("ts", F.lit(None).cast(points.schema["ts"].dataType))
        self.queries = queries.select(*_QUERY)
        member = T.StructType(
            [
                T.StructField("rank", T.IntegerType()),
                T.StructField("oid", points.schema["oid"].dataType),
                T.StructField("distance", T.DoubleType()),
            ]
        )
        spot = T.StructType([*(points.schema[c] for c in _SPOT), T.StructField("fresh", T.BooleanType())])
        listed = T.StructType(
            [*(self.queries.schema[c] for c in _QUERY), T.StructField("members", T.ArrayType(member))]
        )
        self.objects = StateLog(store, "objects", spot, ["oid"])
        self.lists = StateLog(store, "lists", listed, ["qid"])

    def writer(self) -> DataStreamWriter:
        both = self.spots
        if self.live:
            both = both.unionByName(self.queries, allowMissingColumns=True)
        return both.writeStream.foreachBatch(self.step)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut_lineage(batch, "batch")
        spots = batch.where(F.col("oid").isNotNull()).select(*_SPOT)
        moved = self.objects.append(self._moved(spots, batch_id), batch_id)
        objects = self.objects.before(spark, batch_id + 1)
        known = self.lists.before(spark, batch_id)
        if self.live:
            new = batch.where(F.col("qid").isNotNull()).select(*_QUERY)
        else:
            new = self.queries if batch_id == 0 else self.queries.where(F.lit(False))
        arrived = cut_lineage(self._arrived(new, known), "arrived")
        hit = cut_lineage(self._hit(known, arrived, moved), "hit")
        ranked = self._ranked(hit, arrived, moved, objects)
        lists = ranked.groupBy(*_QUESTION).agg(
            F.sort_array(F.collect_list(F.struct("rank", "oid", "distance"))).alias("members")
        )
        asked = hit.select(*_QUERY).unionByName(arrived)
        none = F.array().cast(self.lists.schema["members"].dataType)
        rows = asked.join(lists, [*_QUESTION], "left").withColumn("members", F.coalesce("members", none))
        now = self.lists.append(rows, batch_id)
        touched = known.join(now.select("qid"), "qid", "left_semi")
        changes = knn.knn_changes(_exploded(touched), _exploded(now))
        changes.write.mode("overwrite").parquet(f"{self.store}/changes/batch_id={batch_id}")

    def _moved(self, spots: DataFrame, batch_id: int) -> DataFrame:
        """The latest rows of the objects that a batch updates; ``fresh`` if not seen before."""
        new = latest_per_key(spots, "oid").withColumn("fresh", F.lit(True))
        known = self.objects.before(spots.sparkSession, batch_id).withColumn("fresh", F.lit(False))
        old = known.join(new.select("oid"), "oid", "left_semi")
        row = F.struct("ts", "x", "y")
        return (
            old.unionByName(new)
            .groupBy("oid")
            .agg(F.max(row).alias("_row"), F.min("fresh").alias("fresh"))
            .select("oid", "_row.*", "fresh")
        )

    def _arrived(self, new: DataFrame, known: DataFrame) -> DataFrame:
        """Queries of a batch that are new, or later than the version in force."""
        fresh = latest_per_key(new, "qid")
        version = F.struct("ts", "fx", "fy", "k")
        before = known.select("qid", version.alias("_before"))
        both = fresh.join(before, "qid", "left")
        return both.where(F.col("_before").isNull() | (version > F.col("_before"))).select(*_QUERY)

    def _hit(self, known: DataFrame, arrived: DataFrame, moved: DataFrame) -> DataFrame:
        """Queries in force that the moved objects may concern, with the members so far."""
        kept = known.where("k > 0").join(arrived.select("qid"), "qid", "left_anti")
        asked = _questions(kept)
        size, r = F.size("members"), F.col("members")[F.size("members") - 1]["distance"] * (1 + 1e-9)
        full = asked.where(size >= F.col("k")).withColumn("_r", r)
        circles = _around(full.select("qid", *_QUESTION, "_r"))
        d = spatial.dist(F.col("x"), F.col("y"), F.col("fx"), F.col("fy"))
        entered = grid_join(moved.select("oid", "x", "y"), circles, self.cell).where(d <= F.col("_r"))
        members = asked.select(*_QUESTION, F.explode("members.oid").alias("oid"))
        left = members.join(moved.select("oid"), "oid", "left_semi")
        # A short list holds all objects there are: only new ones can come to it.
        some = moved.where("fresh").limit(1).select(F.lit(True).alias("_some"))
        short = asked.where(size < F.col("k")).withColumn("_some", F.lit(True)).join(some, "_some", "left_semi")
        concerned = entered.select(*_QUESTION).unionByName(left.select(*_QUESTION)).unionByName(short.select(*_QUESTION))
        return kept.join(concerned.distinct(), [*_QUESTION], "left_semi")

    def _ranked(self, hit: DataFrame, arrived: DataFrame, moved: DataFrame, objects: DataFrame) -> DataFrame:
        """The lists of all that is asked by these queries, with its place and k."""
        hit = cut_lineage(_questions(hit), "questions")
        new = arrived.where("k > 0").select(*_QUESTION).distinct()
        state = hit.agg(F.max("k").alias("most"), F.count_if(F.size("members") < F.col("k")).alias("short"))
        state = state.crossJoin(new.agg(F.count("*").alias("arrived"))).first()
        most, anew = state.most or 0, hit.where(F.size("members") < F.col("k"))
        many = 2 * moved.count() >= objects.count()
        if many:
            anew = hit
        anew = anew.select(*_QUESTION).unionByName(new).distinct().withColumn("qid", F.struct(*_QUESTION))
        found = None
        if most and many or state.short or state.arrived:
            found = knn.knn_join(objects, anew, self.cell)
        if many and found is not None:
            return found.select("qid.*", "oid", "distance", "rank")
        full = hit.where(F.size("members") >= F.col("k"))
        member = full.select("qid", *_QUESTION, F.explode("members.oid").alias("oid"))
        placed = member.join(objects.select("oid", "x", "y"), "oid")
        d = spatial.dist(F.col("x"), F.col("y"), F.col("fx"), F.col("fy"))
        bound = placed.groupBy("qid", *_QUESTION).agg((F.max(d) * (1 + 1e-9)).alias("_r"))
        boxes = cut_lineage(_around(bound).drop("_r"), "bounds")
        near = grid_join(objects.select("oid", "x", "y"), boxes, self.cell)
        order = Window.partitionBy("qid").orderBy("distance", "oid")
        ranked = (
            near.select("qid", "k", "oid", d.alias("distance"))
            .withColumn("rank", F.row_number().over(order))
            .where((F.col("rank") <= most) & (F.col("rank") <= F.col("k")))
            .select("qid", "oid", "distance", "rank")
        )
        if found is not None:
            ranked = ranked.unionByName(found.select("qid", "oid", "distance", "rank"))
        return ranked.select("qid.*", "oid", "distance", "rank")

    def current(self, spark, batch_id: int) -> DataFrame:
        """The lists after a batch, as ``knn.knn_join`` gives them."""
        return _exploded(self.lists.before(spark, batch_id + 1))


def _questions(queries: DataFrame) -> DataFrame:
    """What queries with lists ask, each once: equal questions have equal lists."""
    one = queries.select(*_QUESTION, "members").dropDuplicates([*_QUESTION])
    return one.withColumn("qid", F.struct(*_QUESTION))


def _around(circles: DataFrame) -> DataFrame:
    """The boxes around circles of radius ``_r``."""
    return circles.select(
        "*",
        (F.col("fx") - F.col("_r")).alias("x_min"), (F.col("fy") - F.col("_r")).alias("y_min"),
        (F.col("fx") + F.col("_r")).alias("x_max"), (F.col("fy") + F.col("_r")).alias("y_max"),
    )


def _exploded(lists: DataFrame) -> DataFrame:
    rows = lists.select("qid", F.inline("members"))
    return rows.select("qid", "oid", "distance", "rank")


def knn_stream(points: DataFrame, queries: DataFrame, cell: float, store: str) -> NearestLists:
    """k-nearest lists of ``queries`` among the latest places of the objects of a stream.

    ``points`` (oid, ts, x, y) stream; ``queries`` (qid, fx, fy, k and, on a stream, ts) are a
    table or a second stream, in which a query replaces the version of its id before it and
    leaves with a ``k`` of 0 or null.  Rows of both may come in any order: the latest by time
    counts.  Run ``writer()`` of the result; ``current`` gives the lists, ``store/changes`` what
    every batch changed in them.
    """
    return NearestLists(points, queries, cell, store)
