"""Small helpers on frames that several operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# White space of the contracts: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\f\r"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame less the columns of these names, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*(f"`{c}`" for c in df.columns if c.lower() not in taken))


def tasks(df: DataFrame) -> int:
    """Partitions for a shuffle that spreads rows by range or at random."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str) -> bytes:
    """UTF-8 of a text; what is no valid text (a lone surrogate) becomes a question mark."""
    return text.encode("utf-8", "replace")


def text_blocks(
    batches: Iterator[pd.DataFrame], text: str = "text", limit: int = 4 << 20
) -> Iterator[pd.DataFrame]:
    """Cut batches into runs of rows whose texts hold about ``limit`` characters at most.

    A longer text makes a run of its own.
    """
    for batch in batches:
        sizes = batch[text].str.len().fillna(0).to_numpy(np.int64)
        ends = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(ends)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if high > low:
                yield batch.iloc[low:high]


def row_runs(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows whose texts make about ``limit`` bytes together; a larger one stands alone."""
    if len(texts):
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit)) + 1).tolist()
        yield from zip([0, *cuts], [*cuts, len(sizes)], strict=True)
