"""Starting, feeding, finishing and reading back streaming queries."""

from __future__ import annotations

import ast
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from driftgrid.functions.timestamps import as_calendar, as_instant
from driftgrid.session import fresh_dir
from driftgrid.sources.paced import noted


def event_time(df: DataFrame, lateness: str, ts: str = "ts") -> DataFrame:
    """Give a stream a watermark on ``ts``; rows later than ``lateness`` may be dropped."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        df = df.withColumn(ts, as_instant(F.col(ts)))
    return df.withWatermark(ts, lateness)


def calendar_time(df: DataFrame) -> DataFrame:
    """Every instant of a result as a UTC calendar time, like the batch operators give."""
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: as_calendar(F.col(c)) for c in stamps})


def start(
    writer: DataStreamWriter, checkpoint: str, every: str | None = "1 second"
) -> StreamingQuery:
    """Start a query with a checkpoint folder of its own.

    ``every`` is the micro-batch interval; with None the query reads all there is, in as
    many batches as its source asks for, and ends.
    """
    writer = writer.option("checkpointLocation", checkpoint)
    timed = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return timed.start()


def stop(query: StreamingQuery) -> None:
    """Finish the batches of the data at hand, then stop."""
    query.processAllAvailable()
    query.stop()


def to_batches(df: DataFrame, path: str, mode: str) -> DataStreamWriter:
    """Write each micro-batch as parquet to ``path/batch_id=…``; a retry replaces it."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return df.writeStream.outputMode(mode).foreachBatch(store)


def drain(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Run a query over all that its source holds now."""
    start(writer, fresh_dir(spark, "checkpoint"), every=None).awaitTermination()


def last_batch(spark: SparkSession, path: str) -> int:
    """The greatest ``batch_id=…`` folder in ``path``."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(name)
    return max(int(f.getPath().getName().split("=")[1]) for f in files)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches a query wrote, with their ``batch_id``."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(with_batch).parquet(path)


def last_updates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows that update-mode batches gave for a key, the one of the last batch."""
    values = [c for c in df.columns if c not in keys and c != "batch_id"]
    return (
        df.groupBy(*keys)
        .agg(*(F.max_by(c, "batch_id").alias(c) for c in values))
        .select(*(c for c in df.columns if c != "batch_id"))
    )


def collected(
    spark: SparkSession, df: DataFrame, mode: str = "append", keys: Sequence[str] = ()
) -> DataFrame:
    """Run a streaming frame over all its data; its result as a static frame.

    ``keys`` names what identifies a row of an update-mode result.
    """
    path = fresh_dir(spark, "stream")
    drain(to_batches(df, path, mode), spark)
    out = stored(df.sparkSession, path, df.schema)
    if mode == "complete":
        last = out.agg(F.max("batch_id")).first()[0]
        return out.where(F.col("batch_id") == last).drop("batch_id")
    return last_updates(out, keys) if keys else out.drop("batch_id")


def drain_paced(writer: DataStreamWriter, checkpoint: str, progress: str, until: int) -> list[int]:
    """Run a query over the source ``paced`` at least to the place ``until``; rows of each batch."""
    sizes: dict[int, int] = {}
    end = offered = noted(progress)
    query = start(writer, checkpoint, "0 seconds")
    if offered >= until:
        query.processAllAvailable()
    while end < until and query.isActive:
        query.awaitTermination(0.1)
        for p in query.recentProgress:
            source = p.sources[0]
            if p.numInputRows:
                sizes[p.batchId] = p.numInputRows
            if source.endOffset:
                end = max(end, ast.literal_eval(source.endOffset)["place"])
    query.stop()
    if query.exception() is not None:
        raise query.exception()
    return [sizes[k] for k in sorted(sizes)]


def keep_state_on_disk(session: SparkSession) -> SparkSession:
    """State beyond the memory: RocksDB, whose checkpoints hold what a batch changed."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    session.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return session


def replay_session(spark: SparkSession) -> SparkSession:
    """A session whose state is split over as many partitions as there are cores."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return session
