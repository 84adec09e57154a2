"""Moving objects, messages and queries as views on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TIME = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points_of(events: DataFrame) -> DataFrame:
    """Location updates (pid, oid, ts, x, y) from an events frame, static or streaming."""
    return events.select(
        F.col("event_id").alias("pid"),
        F.col("user_id").alias("oid"),
        "ts",
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").try_cast("double").alias("y"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_of(table(spark, sf_dir, "events"))


def tweets_of(points: DataFrame, documents: DataFrame) -> DataFrame:
    """Every document at the place and time of the event of its number.

    Both sides grow with the data, so static ones are shuffled, never broadcast.
    """
    text = documents.select(F.col("doc_id").alias("pid"), "text")
    if not points.isStreaming:
        text = text.hint("merge")
    return points.join(text, "pid").select(
        F.col("pid").alias("id"),
        "ts",
        F.col("x").alias("lat"),
        F.col("y").alias("lng"),
        F.col("oid").alias("user_id"),
        "text",
    )


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tweets_of(points(spark, sf_dir), table(spark, sf_dir, "documents"))


def boxes_of(supplier: DataFrame) -> DataFrame:
    """One range query per supplier, 40 by 15, with a time of arrival."""
    k = F.col("s_suppkey")
    x, y = (k * 37 % 300).cast("double"), (k * 13 % 80).cast("double")
    hours = F.make_dt_interval(hours=(k * 7 % 720).cast("int"))
    return supplier.select(
        k.alias("qid"),
        x.alias("x_min"),
        y.alias("y_min"),
        (x + 40).alias("x_max"),
        (y + 15).alias("y_max"),
        (F.lit(BASE_TIME).cast("timestamp_ntz") + hours).alias("ts"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes_of(table(spark, sf_dir, "supplier"))


def query_versions_of(points: DataFrame) -> DataFrame:
    """Moving queries: a box around each object, replaced at its every update."""
    return points.select(
        F.col("oid").alias("qid"),
        "ts",
        (F.col("x") - 5).alias("x_min"),
        (F.col("y") - 5).alias("y_min"),
        (F.col("x") + 5).alias("x_max"),
        (F.col("y") + 5).alias("y_max"),
    )


def query_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_versions_of(points(spark, sf_dir))


def knn_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One k-nearest query per supplier, k from 1 to 5."""
    return knn_queries_of(table(spark, sf_dir, "supplier"))


def knn_queries_of(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(
        k.cast("int").alias("qid"),
        (k * 17 % 200).cast("int").alias("fx"),
        (k * 11 % 100).cast("int").alias("fy"),
        (1 + k % 5).cast("int").alias("k"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line segment per supplier across its box; every fifth is vertical."""
    b = boxes(spark, sf_dir)
    return b.select(
        F.col("qid").alias("sid"),
        F.col("x_min").alias("x1"),
        F.col("y_min").alias("y1"),
        F.when(F.col("qid") % 5 == 0, F.col("x_min")).otherwise(F.col("x_max")).alias("x2"),
        F.col("y_max").alias("y2"),
    )


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four corners of every box, numbered from 0."""
    b = boxes(spark, sf_dir)

    def corner(pos: int, x: str, y: str) -> Column:
        return F.struct(F.lit(pos).alias("pos"), F.col(x).alias("x"), F.col(y).alias("y"))

    return b.select(
        "qid",
        F.inline(
            F.array(
                corner(0, "x_max", "y_max"),
                corner(1, "x_min", "y_min"),
                corner(2, "x_min", "y_max"),
                corner(3, "x_max", "y_min"),
            )
        ),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip of two hours per order; a pending order has no end yet."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("moid"),
        F.col("o_orderkey").alias("tripid"),
        F.col("o_orderdate").alias("tstart"),
        F.when(
            F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(2))
        ).alias("tend"),
        price.alias("xstart"),
        F.floor(price / 2).cast("double").alias("ystart"),
        (price * 2).alias("xend"),
        F.floor(price / 4).cast("double").alias("yend"),
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and types of the nations as triples (s, p, o, lang)."""
    n = table(spark, sf_dir, "nation")
    s = F.concat(F.lit("n/"), F.col("n_nationkey").cast("string"))
    kind = F.when(F.col("n_nationkey") % 2 == 0, "Settlement").otherwise("Region")
    labels = n.select(s.alias("s"), F.lit("label").alias("p"), F.col("n_name").alias("o"), F.lit("en").alias("lang"))
    types = n.select(s.alias("s"), F.lit("type").alias("p"), kind.alias("o"), F.lit(None).cast("string").alias("lang"))
    return labels.unionByName(types)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.concat(F.lit("n/"), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"), uri.alias("uri"))


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def seconds_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a time without zone, whatever the session's zone."""
    return F.substring(ts.cast("string"), 1, 19)


def millis_text(ts: Column) -> Column:
    millis = F.rpad(F.substring(ts.cast("string"), 21, 3), 3, "0")
    return F.concat_ws(".", seconds_text(ts), millis)


def lines_of(df: DataFrame, sep: str, *columns: Column) -> DataFrame:
    """Text lines made of columns, a null as an empty field."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat_ws(sep, *parts).alias("value"))


def tweet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space-separated tweets among plain lines of text that are none."""
    spaced = lines_of(
        tweets(spark, sf_dir),
        " ",
        F.col("id"),
        seconds_text(F.col("ts")),
        F.col("lat"),
        F.col("lng"),
        one_line(F.col("text")),
    )
    plain = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return spaced.unionByName(plain)


def tweet_csv_lines(spark: SparkSession, sf_dir: str, with_user: bool) -> DataFrame:
    user = [F.col("user_id")] if with_user else []
    return lines_of(
        tweets(spark, sf_dir),
        ",",
        F.col("id"),
        seconds_text(F.col("ts")),
        F.col("lat"),
        F.col("lng"),
        *user,
        one_line(F.col("text")),
    )


def trip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip lines, their times in four layouts in turn."""
    turn = F.col("tripid") % 4

    def stamp(c: str) -> Column:
        text = seconds_text(F.col(c))
        return (
            F.when(turn == 0, millis_text(F.col(c)))
            .when(turn == 1, text)
            .when(turn == 2, F.substring(text, 1, 16))
            .otherwise(F.substring(text, 1, 10))
        )

    return lines_of(
        trips(spark, sf_dir),
        ",",
        F.col("moid"),
        F.col("tripid"),
        stamp("tstart"),
        stamp("tend"),
        *(F.col(c) for c in ("xstart", "ystart", "xend", "yend")),
    )
