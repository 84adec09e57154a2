"""Reducers of one's own against loops."""

import datetime as dt
import random
from decimal import Decimal

import pyarrow as pa
import pytest

from driftgrid.operators import reducers
from driftgrid.operators.reducers import Reducer, fold_by_key, fold_windows, lawful

T0 = dt.datetime(2024, 1, 1)
SHAPE = "pid bigint, oid bigint, ts timestamp_ntz, x double, y double"


def best():
    # Made inside a function, so that it travels to the tasks with its code.
    def merge(a, b):
        """Count, decimal sum, and the greatest x with the least pid that has it."""
        out = a.copy()
        out["n"], out["total"] = a.n + b.n, a.total + b.total
        right = (b.x > a.x) | ((b.x == a.x) & (b.pid < a.pid))
        out["x"], out["pid"] = a.x.where(~right, b.x), a.pid.where(~right, b.pid)
        return out

    return merge


BEST = Reducer(
    {"n": "cast(1 as bigint)", "total": "cast(x as decimal(20,2))", "x": "x", "pid": "pid"},
    best(),
)


def some_rows(n=3000):
    rnd = random.Random(8)
    big = 2**60
    return [
        (big + i, rnd.choice([None, big, big + 1, 7]), T0 + dt.timedelta(seconds=rnd.randrange(4000)), float(rnd.randrange(9)), 0.0)
        for i in range(n)
    ]


def expected(groups):
    out = {}
    for key, rows in groups.items():
        best = min(rows, key=lambda r: (-r[3], r[0]))
        out[key] = (len(rows), sum((Decimal(r[3]) for r in rows), Decimal(0)), best[3], best[0])
    return out


def test_a_task_folds_many_batches(monkeypatch):
    monkeypatch.setattr(reducers, "FOLD_ROWS", 20)
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.randrange(100)) for _ in range(500)]
    table = pa.table({"k": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.int64())})
    for held in (0, 2, 100):
        total = {}
        run = reducers._partial(["k"], lambda a, b: a + b, held)
        for out in run(table.to_batches(max_chunksize=7)):
            for r in out.to_pylist():
                total[r["k"]] = total.get(r["k"], 0) + r["v"]
        assert total == {k: sum(v for k2, v in rows if k2 == k) for k in (None, 1, 2, 3)}


@pytest.mark.parametrize("held", [2, 200_000])
def test_by_key_with_nulls_and_large_ids(spark, held):
    rows = some_rows()
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    df = spark.createDataFrame(rows, SHAPE).repartition(7)
    got = fold_by_key(df, ["oid"], BEST, held).collect()
    assert len(got) == len(groups)
    assert {r.oid: (r.n, r.total, r.x, r.pid) for r in got} == expected(groups)


def test_without_keys_and_without_rows(spark):
    rows = some_rows(500)
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    (r,) = fold_by_key(df, [], BEST).collect()
    assert (r.n, r.total, r.x, r.pid) == expected({0: rows})[0]
    assert fold_by_key(df.where("false"), ["oid"], BEST).count() == 0
    assert fold_windows(df.where("false"), BEST, 60.0, 20.0).count() == 0


@pytest.mark.parametrize("slide", [None, 300.0, 250.0])
def test_windows(spark, slide):
    rows, size = some_rows(), 600.0
    groups = {}
    for r in rows:
        at, step = (r[2] - dt.datetime(1970, 1, 1)).total_seconds(), slide or size
        start = at // step * step
        while start + size > at:
            groups.setdefault((dt.datetime(1970, 1, 1) + dt.timedelta(seconds=start), r[1]), []).append(r)
            start -= step
    rows.append((1, 1, None, 100.0, 0.0))
    df = spark.createDataFrame(rows, SHAPE).repartition(6)
    got = fold_windows(df, BEST, size, slide, by=["oid"]).collect()
    assert {(r.window_start, r.oid): (r.n, r.total, r.x, r.pid) for r in got} == expected(groups)
    assert len(got) == len(groups)
    assert all(r.window_end - r.window_start == dt.timedelta(seconds=size) for r in got)


def test_laws(spark):
    df = spark.createDataFrame(some_rows(300), SHAPE)
    assert lawful(df, BEST)
    assert not lawful(df, Reducer({"x": "x"}, lambda a, b: a - b))
    assert not lawful(df, Reducer({"pid": "pid"}, lambda a, b: a))
    assert lawful(df.where("false"), BEST)


def test_clashing_names(spark):
    with pytest.raises(ValueError):
        fold_by_key(spark.createDataFrame(some_rows(3), SHAPE), ["pid"], BEST)


def test_plan_shuffles_states_only_and_copies_no_row(spark):
    df = spark.createDataFrame(some_rows(50), SHAPE)
    plan = fold_windows(df, BEST, 600.0, 60.0)._jdf.queryExecution().executedPlan().toString()
    # Bottom up: rows become states, are folded in their task, shuffled, and only then expanded.
    shuffle = plan.rindex("Exchange hashpartitioning")
    assert "Expand" not in plan[shuffle:] and plan[shuffle:].count("MapInArrow") == 1
