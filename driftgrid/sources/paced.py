"""Replay of a table at a set rate: rows in the order of their times, so many a second.

``lay_out`` sorts a table into files once, as a Spark job, with a list of the files and their
rows.  The source ``paced`` then streams them: its offsets are places in that order, a batch
is a range of places, and each file that the range touches is read by a task of its own.
"""

from __future__ import annotations

import json
import time
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

PLACE = "place"


def lay_out(df: DataFrame, by: Sequence[str], path: str, rows_per_file: int = 1_000_000) -> None:
    """Write ``df`` to ``path`` as files in the order of the columns ``by``.

    Rows are dealt by ranges of ``by``; let it end with a key, so that a time which very many
    rows share is split like any other range.  Nulls come first, rows that are equal in
    ``by`` in any order.
    """
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by)
    sorted_.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    files = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(F.struct(*by)).alias("first"), F.count("*").alias("n")
    )
    # One row per file, not per row of the table.
    files.orderBy("first").select("file", "n").coalesce(1).write.parquet(f"{path}/files")


def paced(spark: SparkSession, path: str, schema: T.StructType, rate: float, step: float, progress: str) -> DataFrame:
    """Stream what ``lay_out`` wrote, ``rate`` rows a second, with column ``place``.

    Rows fall due by slots of ``step`` seconds: the first at once, each further one as the
    clock reaches it.  A batch is all that is due and not yet read, so a slow query gets
    several slots together and never falls behind the rate for good.  ``progress`` is a
    folder of this query, like its checkpoint; a query started again with both goes on
    where it was.
    """
    if PLACE in schema.fieldNames():
        raise ValueError(f"the table has a column {PLACE} of its own")
    spark.dataSource.register(PacedSource)
    out = T.StructType([*schema.fields, T.StructField(PLACE, T.LongType())])
    slot = max(1, round(rate * step))
    options = {"path": path, "slot": str(slot), "step": str(step), "progress": progress}
    return spark.readStream.format("paced").schema(out).options(**options).load()


def noted(progress: str) -> int:
    """The last place that a query with this progress folder was offered."""
    store, folder = pafs.FileSystem.from_uri(progress)
    if store.get_file_info(f"{folder}/place").type == pafs.FileType.NotFound:
        return 0
    with store.open_input_stream(f"{folder}/place") as f:
        return json.loads(f.read())


class Stretch(InputPartition):
    """Rows ``low`` to ``high`` of one file, whose first row has place ``start``."""

    def __init__(self, file: str, start: int, low: int, high: int):
        self.file, self.start, self.low, self.high = file, start, low, high


class PacedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paced"

    def streamReader(self, schema: T.StructType) -> PacedReader:
        return PacedReader(dict(self.options), schema)


class PacedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.schema = schema
        self.slot, self.step = int(options["slot"]), float(options["step"])
        self.progress = options["progress"]
        system, where = pafs.FileSystem.from_uri(f"{options['path']}/files")
        table = pq.read_table(where, filesystem=system)
        self.files = table["file"].to_pylist()
        self.starts = [0]
        for n in table["n"].to_pylist():
            self.starts.append(self.starts[-1] + n)
        self.begun: float | None = None
        self.base = self.given = 0

    def initialOffset(self) -> dict:
        return {"place": 0}

    def latestOffset(self) -> dict:
        """What is due now.  It is noted before Spark logs it, so that after a restart no
        offset lies before one that Spark knows."""
        if self.begun is None:
            self.begun, self.base = time.monotonic(), noted(self.progress)
            self.given = self.base
        slots = 1 + int((time.monotonic() - self.begun) / self.step)
        due = min(self.base + slots * self.slot, self.starts[-1])
        if due > self.given:
            self._write(due)
            self.given = due
        return {"place": self.given}

    def _write(self, place: int) -> None:
        store, folder = pafs.FileSystem.from_uri(self.progress)
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/place.new") as f:
            f.write(json.dumps(place).encode())
        store.move(f"{folder}/place.new", f"{folder}/place")

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = start["place"], end["place"]
        out, k = [], bisect_right(self.starts, low) - 1
        while k < len(self.files) and self.starts[k] < high:
            first = self.starts[k]
            last = min(high, self.starts[k + 1])
            out.append(Stretch(self.files[k], first, max(low, first) - first, last - first))
            k += 1
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        """The rows of a stretch; row groups before and after it are not read."""
        system, where = pafs.FileSystem.from_uri(partition.file)
        wanted = to_arrow_schema(self.schema)
        names = [n for n in self.schema.fieldNames() if n != PLACE]
        with system.open_input_file(where) as source:
            file, at = pq.ParquetFile(source), 0
            for g in range(file.num_row_groups):
                n = file.metadata.row_group(g).num_rows
                low, high = max(partition.low - at, 0), min(partition.high - at, n)
                if low < high:
                    seen = at
                    for batch in file.iter_batches(row_groups=[g], columns=names):
                        a, b = max(partition.low - seen, 0), min(partition.high - seen, len(batch))
                        if a < b:
                            rows = batch.slice(a, b - a)
                            first = partition.start + seen + a
                            place = pa.array(range(first, first + len(rows)), pa.int64())
                            columns = [rows[c].cast(wanted.field(c).type) for c in names]
                            yield pa.RecordBatch.from_arrays([*columns, place], schema=wanted)
                        seen += len(batch)
                at += n
