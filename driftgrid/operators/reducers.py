"""Folds by a function of the user's own: per key, per window, in two levels.

A reducer says what the state of a single row is (Spark columns) and how two states become
one (a function of two frames of states, row by row alike, so that it works on whole columns
at a time).  The function must be associative and commutative, as rows meet in any order;
``lawful`` tries that on given states.

Tasks fold what they read first, so that a key's rows never travel one by one: what is
shuffled is a state per task and key.  States that meet behind the shuffle come sorted and
are folded as they pass; of a key with any number of states one is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from driftgrid.functions.timestamps import span
from driftgrid.operators.aggregates import inside

# A task's states are sent on when it holds so many keys.
HELD_KEYS = 200_000
# Rows that are folded at once, at least.
FOLD_ROWS = 50_000

Merge = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


@dataclass(frozen=True)
class Reducer:
    """``lift``: columns of a single row's state by name, as SQL or columns; ``merge``: two
    states to one.

    ``merge`` gets two frames of equal length with the columns of ``lift`` and Arrow's types
    (nulls are ``pd.NA``, decimals exact) and returns a third.
    """

    lift: Mapping[str, Column | str]
    merge: Merge

    def columns(self) -> list[Column]:
        return [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in self.lift.items()]


def _frame(table: pa.Table) -> pd.DataFrame:
    return table.to_pandas(types_mapper=pd.ArrowDtype)


def _table(frame: pd.DataFrame, schema: pa.Schema) -> pa.Table:
    columns = []
    for field in schema:
        got = pa.array(frame[field.name])
        if isinstance(got, pa.ChunkedArray):
            got = got.combine_chunks()
        columns.append(got.cast(field.type))
    return pa.Table.from_arrays(columns, schema=schema)


def _groups(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number per row, equal for equal keys; nulls equal each other."""
    out = np.zeros(table.num_rows, np.int64)
    for key in keys:
        codes = pc.dictionary_encode(table[key].combine_chunks(), null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        codes = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = out * (int(codes.max(initial=0)) + 1) + codes
        out = np.unique(out, return_inverse=True)[1].ravel()
    return out


def fold_rows(states: pd.DataFrame, groups: np.ndarray, merge: Merge) -> tuple[pd.DataFrame, np.ndarray]:
    """One state per group, and the row each group starts at.

    Neighbours of a group are merged pair by pair, all groups at once, until one state is
    left of each: as many calls of ``merge`` as the largest group's count has bits.
    """
    order = np.argsort(groups, kind="stable")
    states, g, first = states.iloc[order].reset_index(drop=True), groups[order], order
    while len(g) > 1:
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        if len(starts) == len(g):
            break
        place = np.arange(len(g)) - np.repeat(starts, np.diff([*starts, len(g)]))
        even = np.flatnonzero(place % 2 == 0)
        follows = np.minimum(even + 1, len(g) - 1)
        paired = (follows != even) & (g[follows] == g[even])
        left = states.iloc[even[paired]].reset_index(drop=True)
        right = states.iloc[even[paired] + 1].reset_index(drop=True)
        merged = merge(left, right)[list(states.columns)].astype(states.dtypes.to_dict())
        rest = states.iloc[even[~paired]]
        back = np.argsort(np.concatenate([np.flatnonzero(paired), np.flatnonzero(~paired)]))
        states = pd.concat([merged, rest], ignore_index=True).iloc[back].reset_index(drop=True)
        g, first = g[even], first[even]
    return states, first


def _folded(table: pa.Table, keys: Sequence[str], merge: Merge) -> pa.Table:
    names = [n for n in table.column_names if n not in keys]
    states, first = fold_rows(_frame(table.select(names)), _groups(table, keys), merge)
    folded = _table(states, pa.schema([table.schema.field(n) for n in names]))
    rows = table.select(list(keys)).take(pa.array(first)) if keys else None
    columns = [folded[n] if n in names else rows[n] for n in table.column_names]
    return pa.Table.from_arrays(columns, schema=table.schema)


def _partial(keys: Sequence[str], merge: Merge, held: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows wait until they are as many as the states held, so that a state is not folded
        # anew with every batch.
        waiting, n, states = [], 0, 0
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n - states >= max(FOLD_ROWS, states):
                kept = _folded(pa.concat_tables(waiting), keys, merge)
                waiting, n, states = [kept], kept.num_rows, kept.num_rows
                if states > held:
                    yield from kept.to_batches()
                    waiting, n, states = [], 0, 0
        if n:
            yield from _folded(pa.concat_tables(waiting), keys, merge).to_batches()

    return run


def _final(keys: Sequence[str], merge: Merge):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key: only the last key may go on in the next batch."""
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            if last is not None:
                table = pa.concat_tables([last, table])
            groups = _groups(table, keys)
            begin = np.flatnonzero(groups != groups[-1])
            begin = int(begin[-1]) + 1 if len(begin) else 0
            if begin:
                yield from _folded(table.slice(0, begin), keys, merge).to_batches()
            last = _folded(table.slice(begin), keys, merge)
        if last is not None:
            yield from last.to_batches()

    return run


def merge_states(states: DataFrame, keys: Sequence[str], merge: Merge, held: int = HELD_KEYS) -> DataFrame:
    """One row per key of a frame of ``keys`` and states."""
    schema = states.schema
    partial = states.mapInArrow(_partial(keys, merge, held), schema)
    dealt = partial.repartition(*keys) if keys else partial.repartition(1)
    dealt = dealt.sortWithinPartitions(*keys) if keys else dealt
    return dealt.mapInArrow(_final(keys, merge), schema)


def fold_by_key(df: DataFrame, keys: Sequence[str], reducer: Reducer, held: int = HELD_KEYS) -> DataFrame:
    """``keys`` and the columns of the reducer, one row per key; without keys one row.

    Null keys are one key.  A frame without rows gives none.
    """
    _distinct_names(keys, reducer)
    states = df.select(*keys, *reducer.columns())
    return merge_states(states, list(keys), reducer.merge, held)


def fold_windows(
    points: DataFrame,
    reducer: Reducer,
    size: float,
    slide: float | None = None,
    by: Sequence[str] = (),
    rect: Sequence[float] | None = None,
    predicate: Column | None = None,
    held: int = HELD_KEYS,
) -> DataFrame:
    """One row per window of ``size`` seconds and key ``by`` that holds a point.

    Rows are folded once per pane, the longest stretch of ``ts`` that every window holds whole
    or not at all; sliding windows are folded from the states of their panes.  Rows without
    ``ts`` are in no window.  Static frames.
    """
    if size <= 0 or slide is not None and slide <= 0:
        raise ValueError("size and slide of windows are above 0")
    _distinct_names([*by, "window_start", "window_end"], reducer)
    slide = slide or size
    width = gcd(round(size * 1_000_000), round(slide * 1_000_000)) if slide != size else round(size * 1_000_000)
    rows = inside(points, rect, predicate).where("ts is not null")
    lifted = rows.select(
        F.window("ts", f"{width} microseconds")["start"].alias("_pane"),
        *by,
        *reducer.columns(),
    )
    panes = merge_states(lifted, ["_pane", *by], reducer.merge, held)
    window = F.window("_pane", span(size), span(slide))
    states = panes.select(window.alias("_w"), *by, *reducer.lift).select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, *reducer.lift
    )
    if slide == size:
        return states
    return merge_states(states, ["window_start", "window_end", *by], reducer.merge, held)


def _distinct_names(keys: Sequence[str], reducer: Reducer) -> None:
    clash = set(keys) & set(reducer.lift)
    if clash:
        raise ValueError(f"keys and states share the names {', '.join(sorted(clash))}")


def lawful(df: DataFrame, reducer: Reducer, n: int = 60) -> bool:
    """Whether ``merge`` is associative and commutative on states of ``n`` rows of ``df``.

    States are compared as they are, so sums of doubles may fail where decimals do not.
    """
    states = df.select(*reducer.columns()).limit(n)
    schema = to_arrow_schema(states.schema)
    table = states.toArrow().cast(schema)
    k = table.num_rows // 3
    if k == 0:
        return True
    a, b, c = (_frame(table.slice(i * k, k)) for i in range(3))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _frame(_table(reducer.merge(left, right), schema))

    same = both(both(a, b), c).equals(both(a, both(b, c)))
    return bool(same and both(a, b).equals(both(b, a)))
