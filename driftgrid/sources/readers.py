"""Batch and streaming inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, fmt: str = "socket", **options) -> DataFrame:
    """Stream of text lines (``value``): format ``socket`` (host, port) or ``text`` (path)."""
    return spark.readStream.format(fmt).options(**options).load().select("value")


def decode_messages(df: DataFrame) -> DataFrame:
    """Broker messages with binary key and value as text."""
    return df.select(F.col("key").cast("string"), F.col("value").cast("string"))


def messages(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Stream of one broker topic; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return decode_messages(raw)


def scan_text(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """Lines of a text file; the codec follows from the suffix (``.bz2`` splits)."""
    df = spark.read.text(path)
    return df.repartition(min_partitions) if min_partitions else df


def tabulate(spark: SparkSession, n: int, slices: int) -> DataFrame:
    """The pairs (1, 0) … (1, n-1) in ``slices`` partitions."""
    return spark.range(0, n, 1, slices).select(F.lit(1).alias("k"), F.col("id").alias("v"))


def replay(
    spark: SparkSession,
    path: str,
    schema,
    files_per_batch: int = 1,
    name: str | None = None,
    spread: int | None = None,
) -> DataFrame:
    """Replay parquet files as a stream, ``files_per_batch`` at a time, oldest first.

    ``name`` picks one table out of a folder that holds several.  ``spread`` deals the rows of a
    batch over that many tasks, as a file of one row group is read by one.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if name:
        reader = reader.option("pathGlobFilter", name)
    rows = reader.parquet(path)
    return rows.repartition(spread) if spread else rows


def with_arrival(df: DataFrame, ts: Column | None = None) -> DataFrame:
    """Give query rows an arrival time: the given column, or the time of processing."""
    return df.withColumn("ts", F.current_timestamp() if ts is None else ts)
