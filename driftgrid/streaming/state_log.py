"""Keyed tables that a stream changes a little with every micro-batch.

A batch writes the rows it changed to a folder of its own; every ``every`` batches the table
is written whole.  So what a batch writes grows with the batch, not with the table.  Where the
table stands follows from the batch id alone: a batch that is run again reads what it read
the first time and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BATCH = "_batch"


class StateLog:
    """The table ``name`` in the folder ``store``: one row per value of ``keys``."""

    def __init__(self, store: str, name: str, schema: T.StructType, keys: Sequence[str], every: int = 8):
        self.path, self.schema, self.keys, self.every = f"{store}/{name}", schema, list(keys), every
        self.kept = T.StructType([*schema.fields, T.StructField(_BATCH, T.LongType())])

    def _delta(self, batch_id: int) -> str:
        return f"{self.path}/delta-{batch_id:09d}"

    def _whole(self, batch_id: int) -> str:
        return f"{self.path}/whole-{batch_id:09d}"

    def changed(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The rows that a batch wrote."""
        return spark.read.schema(self.kept).parquet(self._delta(batch_id)).drop(_BATCH)

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The table as it stood before a batch: of each key the row written last."""
        start = batch_id // self.every * self.every
        paths = [self._whole(start)] if start else []
        paths += [self._delta(b) for b in range(start, batch_id)]
        if not paths:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(self.kept).parquet(*paths)
        if len(paths) == 1:
            return rows.drop(_BATCH)
        values = [c for c in self.schema.names if c not in self.keys]
        last = F.max_by(F.struct(*values), _BATCH).alias("_row")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "_row.*").select(*self.schema.names)

    def append(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Write the rows that a batch changed, one per key; they are given back as written."""
        spark = rows.sparkSession
        marked = rows.select(*self.schema.names).withColumn(_BATCH, F.lit(batch_id).cast("long"))
        marked.write.mode("overwrite").parquet(self._delta(batch_id))
        after = batch_id + 1
        if after % self.every == 0:
            whole = self._merged(spark, after)
            whole.write.mode("overwrite").parquet(self._whole(after))
            # The last two spans stay, for a batch that is run again.
            for b in range(max(0, after - 3 * self.every), after - 2 * self.every):
                _delete(spark, self._delta(b))
            if after > 2 * self.every:
                _delete(spark, self._whole(after - 2 * self.every))
        return self.changed(spark, batch_id)

    def _merged(self, spark: SparkSession, after: int) -> DataFrame:
        start = after - self.every
        paths = [self._whole(start)] if start else []
        paths += [self._delta(b) for b in range(start, after)]
        rows = spark.read.schema(self.kept).parquet(*paths)
        values = [c for c in self.kept.names if c not in self.keys]
        last = F.max_by(F.struct(*values), _BATCH).alias("_row")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "_row.*").select(*self.kept.names)


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)
