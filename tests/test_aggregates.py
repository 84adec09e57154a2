"""Windows, landmarks, latest rows, words, query sets, labels."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftgrid.operators import aggregates as agg
from driftgrid.operators import enrich, query_state, words
from driftgrid.plans import ordered

T0 = dt.datetime(2024, 1, 1)
SHAPE = "pid bigint, oid bigint, ts timestamp_ntz, x double, y double"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def some(n=300, seed=1, span=5000):
    rnd = random.Random(seed)
    return [
        (i, i % 7 if i % 3 else 0, at(rnd.randrange(span)), float(rnd.randrange(100)), float(rnd.randrange(100)))
        for i in range(n)
    ]


RECT = (60.0, 70.0, 20.0, 10.0)


def kept(rows):
    return [r for r in rows if 20 <= r[3] <= 60 and 10 <= r[4] <= 70]


def by_window(rows, size):
    out = {}
    for r in rows:
        out.setdefault(at((r[2] - T0).total_seconds() // size * size), []).append(r[3])
    return out


def test_windows(spark):
    rows = some()
    df = spark.createDataFrame(rows, SHAPE)
    got = agg.agg_window(df, agg.FUNCTIONS, RECT, 100.0).collect()
    expected = by_window(kept(rows), 100)
    assert {r.window_start for r in got} == set(expected)
    for r in got:
        xs = expected[r.window_start]
        assert (r.n_points, r.max_value, r.min_value, r.sum_value) == (len(xs), max(xs), min(xs), sum(xs))
        assert r.avg_value == sum(xs) / len(xs)
        assert r.window_end == r.window_start + dt.timedelta(seconds=100)


@pytest.mark.parametrize("spread", [3, 4096])
def test_empty_windows_on_request(spark, monkeypatch, spread):
    # Gaps longer than the spread are made in three steps.
    monkeypatch.setattr(agg, "SPREAD", spread)
    rows = some(40) if spread > 3 else [(0, 1, at(0), 30.0, 30.0), (1, 1, at(230), 30.0, 30.0), (2, 1, at(250), 30.0, 30.0)]
    df = spark.createDataFrame(rows, SHAPE)
    got = agg.agg_window(df, ["count", "max", "avg"], RECT, 10.0, fill_empty=True).collect()
    expected = by_window(kept(rows), 10)
    first, last = min(expected), max(expected)
    assert len(got) == (last - first).total_seconds() // 10 + 1
    for r in got:
        xs = expected.get(r.window_start, [])
        assert r.n_points == len(xs) and r.max_value == (max(xs) if xs else None)
        assert r.avg_value == (sum(xs) / len(xs) if xs else 0.0)


def test_long_gaps_and_fractional_windows(spark):
    rows = [(0, 1, at(0), 30.0, 30.0), (1, 1, at(50), 30.0, 30.0)]
    df = spark.createDataFrame(rows, SHAPE)
    filled = agg.agg_window(df, "count", RECT, 0.0025, fill_empty=True)
    got = filled.agg(F.count("*"), F.countDistinct("window_start"), F.sum("n_points"), F.max("window_end")).first()
    assert tuple(got) == (20_001, 20_001, 2, at(50.0025))


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_landmarks(spark, monkeypatch, chunk):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", chunk)
    rows = some()
    df = spark.createDataFrame(rows, SHAPE)
    got = {r.window_start: r for r in agg.agg_landmark(df, agg.FUNCTIONS, RECT, 100.0).collect()}
    seen = []
    expected = by_window(kept(rows), 100)
    assert set(got) == set(expected)
    for w in sorted(expected):
        seen += expected[w]
        r = got[w]
        assert (r.n_points, r.max_value, r.min_value) == (len(seen), max(seen), min(seen))
        assert r.sum_value == sum(seen) and r.avg_value == sum(seen) / len(seen)


def test_batch_of_nothing(spark):
    df = spark.createDataFrame([], SHAPE)
    r = agg.agg_batch(df, agg.FUNCTIONS, RECT).first()
    assert (r.n_points, r.max_value, r.avg_value) == (0, None, None)
    assert agg.agg_landmark(df, "count", RECT).first().n_points == 0


@pytest.mark.parametrize("fn", ["max", "min", "sum", "avg"])
def test_window_of_no_length(spark, fn):
    df = spark.createDataFrame(some(3), SHAPE)
    with pytest.raises(ValueError, match="window size cannot be 0"):
        agg.agg_window(df, fn, RECT, 0)
    with pytest.raises(ValueError, match="window size cannot be 0"):
        agg.agg_landmark(df, fn, RECT, 0)


def test_unknown_aggregate(spark):
    with pytest.raises(ValueError, match="unknown aggregate"):
        agg.agg_batch(spark.createDataFrame(some(3), SHAPE), "median")


def test_predicate_of_the_user(spark):
    df = spark.createDataFrame(some(), SHAPE)
    n = agg.agg_batch(df, "count", None, predicate=F.col("x") > F.col("y")).first().n_points
    assert n == sum(r[3] > r[4] for r in some())


def test_latest_per_key(spark):
    rows = [(1, 1, at(5), 1.0, 1.0), (3, 1, at(5), 2.0, 2.0), (2, 1, at(5), 9.0, 9.0), (9, 1, at(4), 5.0, 5.0)]
    df = spark.createDataFrame(rows, SHAPE)
    assert tuple(agg.latest_per_key(df, "oid", "ts", "pid").first()) == rows[1]
    assert agg.latest_per_key(df, "oid", "ts", "pid").columns == df.columns


def test_sum_by_key(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "k int, v bigint")
    sums = agg.sum_by_key(df, 3)
    assert sums.rdd.getNumPartitions() == 3
    assert {tuple(r) for r in sums.collect()} == {(1, 5), (2, 4)}
    assert agg.count_rows(df).first().n_rows == 3


def test_words(spark):
    df = spark.createDataFrame([("a b a",), ("b  c ",)], "value string")
    assert {tuple(r) for r in words.word_count(df).collect()} == {("a", 2), ("b", 2), ("c", 1), ("", 1)}
    stream = spark.createDataFrame([(at(1), "a,b,a"), (at(3), "a")], "ts timestamp_ntz, value string")
    got = {(r.window_start, r.word, r.n) for r in words.word_count_window(stream, 4, 2).collect()}
    assert got == {
        (at(-2), "a", 2), (at(-2), "b", 1), (at(0), "a", 3), (at(0), "b", 1), (at(2), "a", 1)
    }


BOXED = "qid bigint, ts timestamp_ntz, x_min double, y_min double, x_max double, y_max double"


def test_query_sets(spark):
    prev = spark.createDataFrame([(1, at(0), 0.0, 0.0, 1.0, 1.0), (2, at(0), 0.0, 0.0, 2.0, 2.0)], BOXED)
    sent = spark.createDataFrame(
        [
            (2, at(5), 5.0, 5.0, 6.0, 6.0),
            (2, at(5), 5.0, 5.0, 6.0, 7.0),  # the greater box of the same time
            (2, at(4), 9.0, 9.0, 9.5, 9.5),
            (3, at(1), 0.0, 0.0, 3.0, 3.0),
        ],
        BOXED,
    )
    now = {r.qid: (r.x_max, r.y_max) for r in query_state.upsert_queries(prev, sent).collect()}
    assert now == {1: (1.0, 1.0), 2: (6.0, 7.0), 3: (3.0, 3.0)}
    assert query_state.append_queries(prev, sent).count() == 6
    assert [r.qid for r in query_state.minus_by_key(prev, sent).collect()] == [1]
    assert [r.qid for r in query_state.semi_by_key(prev, sent).collect()] == [2]


def test_corners(spark):
    df = spark.createDataFrame(
        [(1, 1, 5.0, 2.0), (1, 0, 20.0, 10.0), (2, 0, 1.0, 1.0)], "qid bigint, pos int, x double, y double"
    )
    boxes = {r.qid: tuple(r)[1:] for r in query_state.query_mbr(df).collect()}
    assert boxes == {1: (5.0, 2.0, 20.0, 10.0), 2: (1.0, 1.0, 1.0, 1.0)}
    lists = {r.qid: [tuple(p) for p in r.points] for r in query_state.query_polygon(df).collect()}
    assert lists == {1: [(20.0, 10.0), (5.0, 2.0)], 2: [(1.0, 1.0)]}
    assert query_state.query_polygon(df, page=1).count() == 3


def test_labels(spark):
    t = [
        ("u1", enrich.LABEL, "Town", "en"), ("u1", enrich.LABEL, "Stadt", "de"),
        ("u1", enrich.LABEL, "Borough", "en"), ("u1", enrich.TYPE, enrich.SETTLEMENT, None),
        ("u2", enrich.LABEL, "River", "en"), ("u2", enrich.TYPE, "river", None),
        ("u3", enrich.LABEL, "", "en"), ("u3", enrich.TYPE, enrich.SETTLEMENT, None),
    ]
    triples = spark.createDataFrame(t, "s string, p string, o string, lang string")
    entities = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3"), (4, "u4"), (5, "u1")], "eid int, uri string")
    got = {(r.eid, r.label, r.lang) for r in enrich.enrich_labels(entities, triples).collect()}
    assert got == {(1, "Town", "en"), (5, "Town", "en")}
    assert enrich.match_pattern(triples).count() == 3


def test_sliding_counts_by_panes(spark):
    """Windows that are no whole number of slides, and rows that are counted before they are copied."""
    rnd = random.Random(8)
    rows = [(T0 + dt.timedelta(milliseconds=rnd.randrange(60_000)), rnd.choice(["a,b", "a", "", "c,c,a"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value string")
    for size, slide in ((10, 4), (30, 1), (4, 2), (0.0015, 0.001)):
        got = {(r.window_start, r.word): r.n for r in words.word_count_window(df, size, slide).collect()}
        want = {}
        step, width = dt.timedelta(seconds=slide), dt.timedelta(seconds=size)
        for ts, text in rows:
            start = ts - (ts - dt.datetime(1970, 1, 1)) % step
            while start + width > ts:
                for w in text.split(","):
                    want[(start, w)] = want.get((start, w), 0) + 1
                start -= step
        assert got == want
    plan = words.word_count_window(df, 30, 1)._jdf.queryExecution().optimizedPlan().toString()
    # Rows are copied into windows above the counts per pane.
    assert plan.index("Expand") < plan.rindex("Aggregate")


def test_windows_of_a_fraction_of_a_millisecond(spark):
    rows = [(i, 0, T0 + dt.timedelta(microseconds=m), 1.0, 1.0) for i, m in enumerate([0, 1400, 1500, 2999, 3000])]
    df = spark.createDataFrame(rows, "pid long, oid long, ts timestamp_ntz, x double, y double")
    got = agg.agg_window(df, "count", None, 0.0015).collect()
    assert sorted(((r.window_start - T0).microseconds, r.n_points) for r in got) == [(0, 2), (1500, 2), (3000, 1)]
