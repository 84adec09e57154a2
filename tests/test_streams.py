"""Streams replayed in several batches give what the batch operators give."""

import datetime as dt
import os
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from driftgrid.operators import aggregates as agg
from driftgrid.operators import joins, knn, words
from driftgrid.sources import paced, readers, sinks
from driftgrid.streaming import nearest, run, stateful
from driftgrid.streaming.state_log import StateLog

T0 = dt.datetime(2024, 1, 1)
SHAPE = "pid bigint, oid bigint, ts timestamp_ntz, x double, y double"
LATE = "1000 days"


def some_points(n=400, seed=1):
    rnd = random.Random(seed)
    return [
        (i, i % 13 if i % 3 else 0, T0 + dt.timedelta(seconds=10 * i), round(rnd.uniform(0, 60), 1), float(rnd.randrange(60)))
        for i in range(n)
    ]


def feed(spark, tmp_path, rows, schema, parts=4, name="feed"):
    """Files in the order of time, replayed one per micro-batch."""
    folder = tmp_path / name
    folder.mkdir()
    size = -(-len(rows) // parts)
    base = time.time() - 1000
    for i in range(parts):
        chunk = spark.createDataFrame(rows[i * size : (i + 1) * size], schema).toPandas()
        path = str(folder / f"{i:03d}.parquet")
        pq.write_table(pa.Table.from_pandas(chunk, preserve_index=False), path, coerce_timestamps="us")
        os.utime(path, (base + i, base + i))
    return readers.replay(spark, str(folder), spark.createDataFrame([], schema).schema)


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    left = sorted(map(str, a.select(columns).collect()))
    right = sorted(map(str, b.select(columns).collect()))
    assert left == right and left


def boxes(spark, n=20, seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w = rnd.uniform(0, 50), rnd.uniform(0, 50), rnd.choice([3.0, 10.0, 60.0])
        rows.append((i, x, y, x + w, y + w, T0 + dt.timedelta(seconds=rnd.randrange(4000))))
    return rows, "qid bigint, x_min double, y_min double, x_max double, y_max double, ts timestamp_ntz"


def test_windows_of_a_stream(spark, tmp_path):
    rows = some_points()
    points = run.event_time(feed(spark, tmp_path, rows, SHAPE), LATE)
    out = agg.agg_window(points, agg.FUNCTIONS, (5, 5, 50, 50), 300.0)
    got = run.collected(spark, out, "update", ["window_start", "window_end"])
    batch = spark.createDataFrame(rows, SHAPE)
    same(run.calendar_time(got).drop("avg_value", "sum_value"),
         agg.agg_window(batch, agg.FUNCTIONS, (5, 5, 50, 50), 300.0).drop("avg_value", "sum_value"))


def test_append_mode_drops_late_rows_and_holds_open_windows(spark, tmp_path):
    rows = [(i, 0, T0 + dt.timedelta(seconds=s), 1.0, 1.0) for i, s in enumerate([5, 15, 200, 211, 6, 300])]
    points = run.event_time(feed(spark, tmp_path, rows, SHAPE, parts=6), "20 seconds")
    out = agg.agg_window(points, "count", None, 10.0)
    got = run.calendar_time(run.collected(spark, out, "append"))
    counts = {(r.window_start - T0).seconds: r.n_points for r in got.collect()}
    assert counts == {0: 1, 10: 1, 200: 1, 210: 1}  # the row at 6 came too late, 300 is still open


def test_landmark_of_a_stream(spark, tmp_path):
    rows = some_points()
    points = feed(spark, tmp_path, rows, SHAPE)
    got = run.collected(spark, agg.agg_batch(points, ["count", "max"], None), "complete").first()
    assert (got.n_points, got.max_value) == (len(rows), max(r[3] for r in rows))


def test_landmark_per_window_of_a_stream(spark, tmp_path):
    rows = some_points()
    end = (9999, 0, T0 + dt.timedelta(days=9), 30.0, 30.0)  # closes all windows before it
    points = run.event_time(feed(spark, tmp_path, [*rows, end], SHAPE, 5), "5 minutes")
    store = str(tmp_path / "store")
    rect = (5, 5, 50, 50)
    writer = stateful.landmark_stream(points, agg.FUNCTIONS, rect, 300.0, store)
    run.drain(writer, spark)
    out = spark.read.parquet(f"{store}/landmark")
    assert out.select("batch_id").distinct().count() > 2
    got = run.calendar_time(out.drop("batch_id"))
    batch = agg.agg_landmark(spark.createDataFrame(rows, SHAPE), agg.FUNCTIONS, rect, 300.0)

    def rounded(df):
        return df.withColumns({c: F.round(c, 6) for c in ("sum_value", "avg_value")})

    same(rounded(got), rounded(batch))


def test_queries_take_their_time_of_arrival(spark, tmp_path):
    queries = feed(spark, tmp_path, [(1, "q"), (2, "r")], "qid bigint, name string", 1)
    out = run.collected(spark, readers.with_arrival(queries))
    assert out.where(F.col("ts").isNotNull()).count() == 2


def test_word_counts_of_a_stream(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=i), "a,b" if i % 2 else "a") for i in range(40)]
    shape = "ts timestamp_ntz, value string"
    counts = words.word_count_window(run.event_time(feed(spark, tmp_path, rows, shape), LATE), 4, 2)
    got = run.collected(spark, counts, "update", ["window_start", "window_end", "word"])
    same(run.calendar_time(got), words.word_count_window(spark.createDataFrame(rows, shape), 4, 2))


def test_range_join_of_a_stream(spark, tmp_path):
    rows = some_points()
    fixed = spark.createDataFrame(*boxes(spark))
    got = run.collected(spark, joins.range_join(feed(spark, tmp_path, rows, SHAPE), fixed, 8.0))
    same(got, joins.range_join(spark.createDataFrame(rows, SHAPE), fixed, 8.0))


def test_range_join_of_a_stream_with_many_boxes(shuffled, tmp_path):
    rows = some_points()
    fixed = shuffled.createDataFrame(*boxes(shuffled))
    got = run.collected(shuffled, joins.range_join(feed(shuffled, tmp_path, rows, SHAPE), fixed, 8.0))
    same(got, joins.range_join(shuffled.createDataFrame(rows, SHAPE), fixed, 8.0))


def test_ttl_join_of_two_streams(spark, tmp_path):
    rows = some_points()
    q_rows, q_shape = boxes(spark)
    points = run.event_time(feed(spark, tmp_path, rows, SHAPE), LATE)
    queries = run.event_time(feed(spark, tmp_path, q_rows, q_shape, 3, "queries"), LATE)
    got = run.calendar_time(run.collected(spark, joins.range_join_ttl(points, queries, 600, 8.0)))
    same(got, joins.range_join_ttl(spark.createDataFrame(rows, SHAPE), spark.createDataFrame(q_rows, q_shape), 600, 8.0))


def test_ttl_join_of_boxes_of_known_width(spark, tmp_path):
    """Points wait on one level only, and boxes wider than was said are found too."""
    rows = some_points()
    q_rows, q_shape = boxes(spark)
    points = run.event_time(feed(spark, tmp_path, rows, SHAPE, 2), LATE)
    queries = run.event_time(feed(spark, tmp_path, q_rows, q_shape, 2, "queries"), LATE)
    path = str(tmp_path / "out")
    joined = joins.range_join_ttl(points, queries, 600, 8.0, widest=10.0)
    q = run.start(run.to_batches(joined, path, "append"), str(tmp_path / "check"), every=None)
    q.awaitTermination()
    got = run.calendar_time(run.stored(spark, path, joined.schema).drop("batch_id"))
    same(got, joins.range_join_ttl(spark.createDataFrame(rows, SHAPE), spark.createDataFrame(q_rows, q_shape), 600, 8.0))
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) < 7 * len(rows)


def test_ttl_join_forgets(spark, tmp_path):
    """With a short lateness the join drops state that can match nothing any more."""
    rows = some_points()
    q_rows, q_shape = boxes(spark)
    q_rows = sorted(q_rows, key=lambda r: r[-1])
    points = run.event_time(feed(spark, tmp_path, rows, SHAPE, 8), "1 second")
    queries = run.event_time(feed(spark, tmp_path, q_rows, q_shape, 8, "queries"), "1 second")
    path = str(tmp_path / "out")
    writer = run.to_batches(joins.range_join_ttl(points, queries, 100, 8.0), path, "append")
    q = run.start(writer, str(tmp_path / "check"), every=None)
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert kept[-1] < max(kept)


def test_self_join_of_a_stream(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(r[0], r[2], r[3], r[4], [rnd.choice("abcdef") for _ in range(4)]) for r in some_points(150)]
    shape = "id bigint, ts timestamp_ntz, x double, y double, words array<string>"
    messages = run.event_time(feed(spark, tmp_path, rows, shape, 3), LATE)
    got = run.collected(spark, joins.distance_self_join(messages, 10.0, 300.0, 100.0))
    same(run.calendar_time(got), joins.distance_self_join(spark.createDataFrame(rows, shape), 10.0, 300.0, 100.0))


VERSION = "qid bigint, ts timestamp_ntz, x_min double, y_min double, x_max double, y_max double"


def some_versions():
    return [(p[1], p[2], p[3] - 4, p[4] - 4, p[3] + 4, p[4] + 4) for p in some_points(200, 5)]


def test_moving_queries_and_points_both_stream(spark, tmp_path):
    """Points come before versions they need, and versions out of the order of their times."""
    rows, sent = some_points(120), some_versions()
    mixed = [r for k in range(4) for r in rows[k::4]]
    late = [r for k in (2, 0, 3, 1) for r in sent[k::4]]
    store = str(tmp_path / "store")
    points = feed(spark, tmp_path, mixed, SHAPE, name="points")
    versions = feed(spark, tmp_path, late, VERSION, name="versions")
    run.drain(stateful.moving_range_stream(points, versions, 8.0, 300.0, store, 10_000.0), spark)
    assert spark.read.parquet(f"{store}/in_force/batch_id=3").count() <= 13
    fixed = spark.createDataFrame(rows, SHAPE), spark.createDataFrame(sent, VERSION)
    stateful.moving_range_flush(*fixed, 8.0, 300.0, store)
    got = spark.read.parquet(f"{store}/matches").drop("batch_id")
    same(got, joins.moving_range_join(*fixed, 8.0, 300.0))


def test_matches_of_moving_queries_are_stored_in_lists(spark, tmp_path):
    """Six queries move alike and points come three at a time: one row stands for 18 matches."""
    rows = [(3 * r[0] + k, *r[1:]) for r in some_points(40) for k in range(3)]
    sent = [(100 * k + v[0], *v[1:]) for v in some_versions()[:80] for k in range(6)]
    store = str(tmp_path / "store")
    points = feed(spark, tmp_path, rows, SHAPE, 2, "points")
    versions = feed(spark, tmp_path, sent, VERSION, 2, "versions")
    run.drain(stateful.moving_range_stream(points, versions, 8.0, 300.0, store, 10_000.0, listed=True), spark)
    fixed = spark.createDataFrame(rows, SHAPE), spark.createDataFrame(sent, VERSION)
    stateful.moving_range_flush(*fixed, 8.0, 300.0, store, listed=True)
    got = stateful.moving_range_matches(fixed[0], store)
    same(got, joins.moving_range_join(*fixed, 8.0, 300.0))
    assert spark.read.parquet(f"{store}/found").count() * 18 == got.count()
    assert not os.path.exists(f"{store}/matches")


def test_a_point_that_comes_before_the_entry_it_follows(spark, tmp_path):
    rows = [
        (1, 7, T0 + dt.timedelta(seconds=20), 90.0, 90.0),
        (2, 7, T0 + dt.timedelta(seconds=10), 5.0, 5.0),
    ]
    box = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0)], "qid bigint, x_min double, y_min double, x_max double, y_max double")
    store = str(tmp_path / "store")
    writer = stateful.sticky_stream(feed(spark, tmp_path, rows, SHAPE, parts=2), box, 8.0, store, 60.0)
    run.drain(writer, spark)
    stateful.sticky_flush(spark.createDataFrame([], SHAPE), box, 8.0, store)
    got = spark.read.parquet(f"{store}/matches").drop("batch_id")
    same(got, joins.ever_inside(spark.createDataFrame(rows, SHAPE), box, 8.0))
    assert got.count() == 2


def test_query_set_over_a_stream(spark, tmp_path):
    store = str(tmp_path / "store")
    session = run.keep_state_on_disk(run.replay_session(spark))
    changes = stateful.upsert_stream(feed(session, tmp_path, some_versions(), VERSION))
    query = run.start(run.to_batches(changes, store, "update"), str(tmp_path / "check"), None)
    query.awaitTermination()
    out = run.stored(session, store, changes.schema)
    same(
        run.last_updates(out, ["qid"]),
        agg.latest_per_key(spark.createDataFrame(some_versions(), VERSION), "qid", "ts"),
    )


def test_upserts_write_the_state_of_their_own_queries(spark, tmp_path):
    rows = [(q, T0, float(q), 0.0, 1.0, 1.0) for q in range(300)]
    rows += [(q, T0 + dt.timedelta(hours=1), float(q), 0.0, 2.0, 2.0) for q in (3, 4) for _ in range(150)]
    session = run.keep_state_on_disk(run.replay_session(spark))
    schema = "qid int, ts timestamp_ntz, x_min double, y_min double, x_max double, y_max double"
    changes = stateful.upsert_stream(feed(session, tmp_path, rows, schema, parts=2))
    store = str(tmp_path / "store")
    query = run.start(run.to_batches(changes, store, "update"), str(tmp_path / "check"), None)
    query.awaitTermination()
    updated = [p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.numInputRows]
    assert updated == [300, 2]
    assert run.stored(session, store, changes.schema).where("batch_id = 1").count() == 2


def paced_rows(spark, laid, schema, rate, step, tmp_path, until, out):
    progress = str(tmp_path / "progress")
    rows = paced.paced(spark, laid, schema, rate, step, progress)
    return run.drain_paced(run.to_batches(rows, out, "append"), str(tmp_path / "check"), progress, until)


def test_replay_at_a_rate(spark, tmp_path):
    """Batches are whole slots of the rate; a restart goes on; every row comes once, in order."""
    rows = some_points()
    random.Random(3).shuffle(rows)
    rows.append((400, None, None, None, 1.0))
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    laid, out = str(tmp_path / "laid"), str(tmp_path / "out")
    paced.lay_out(df, ["ts", "pid"], laid, rows_per_file=37)
    begun = time.monotonic()
    first = paced_rows(spark, laid, df.schema, 25, 1.0, tmp_path, 150, out)
    assert 150 <= sum(first) <= 25 * (time.monotonic() - begun) + 25
    assert all(n % 25 == 0 for n in first)
    second = paced_rows(spark, laid, df.schema, 25, 1.0, tmp_path, 401, out)
    assert all(n % 25 == 0 for n in second[:-1])
    assert paced_rows(spark, laid, df.schema, 25, 1.0, tmp_path, 401, out) == []
    got = spark.read.parquet(out).orderBy("place").collect()
    assert [r.place for r in got] == list(range(401))
    want = sorted(rows, key=lambda r: (r[2] is not None, r[2] or T0, r[0]))
    assert [tuple(r)[:5] for r in got] == want


def test_replay_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SHAPE)
    paced.lay_out(df, ["ts", "pid"], str(tmp_path / "laid"))
    out = str(tmp_path / "out")
    assert paced_rows(spark, str(tmp_path / "laid"), df.schema, 10, 0.5, tmp_path, 0, out) == []
    with pytest.raises(ValueError):
        paced.paced(spark, "x", df.withColumnRenamed("x", "place").schema, 1, 1, "y")


def test_sticky_over_a_stream(spark, tmp_path):
    rows = some_points()
    fixed = spark.createDataFrame(*boxes(spark))
    store = str(tmp_path / "store")
    writer = stateful.sticky_stream(feed(spark, tmp_path, rows, SHAPE), fixed, 8.0, store, 0.0)
    run.drain(writer, spark)
    stateful.sticky_flush(spark.createDataFrame([], SHAPE), fixed, 8.0, store)
    got = spark.read.parquet(f"{store}/matches").drop("batch_id")
    same(got, joins.ever_inside(spark.createDataFrame(rows, SHAPE), fixed, 8.0))


ASKED = "qid int, ts timestamp_ntz, fx double, fy double, k int"


def as_of(spark, lists, rows, queries, cell=4.0):
    """Lists of the objects' latest places and the queries' latest versions."""
    objects = agg.latest_per_key(spark.createDataFrame(rows, SHAPE), "oid")
    last = agg.latest_per_key(queries, "qid") if "ts" in queries.columns else queries
    return knn.knn_join(objects, last.where("k > 0"), cell)


def test_knn_over_a_stream(spark, tmp_path):
    rows = some_points()
    queries = spark.createDataFrame([(i, 7.0 * i, 50.0 - 5 * i, 1 + i % 4) for i in range(9)] + [(50, 5.0, 5.0, 40)], "qid int, fx double, fy double, k int")
    store = str(tmp_path / "store")
    lists = nearest.knn_stream(feed(spark, tmp_path, rows, SHAPE), queries, 4.0, store)
    run.drain(lists.writer(), spark)
    assert run.last_batch(spark, f"{store}/changes") == 3
    before = None
    for i in range(4):
        ranked = as_of(spark, lists, rows[: 100 * (i + 1)], queries)
        same(lists.current(spark, i), ranked)
        if before is not None:
            same(spark.read.parquet(f"{store}/changes/batch_id={i}"), knn.knn_changes(before, ranked))
        before = ranked


def test_knn_queries_that_arrive_move_and_leave(spark, tmp_path):
    """Batches hold objects and queries in no order; every list is exact after every batch."""
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(40), T0 + dt.timedelta(seconds=rnd.randrange(3000)), float(rnd.randrange(30)), float(rnd.randrange(30))) for i in range(80)]
    asked = [(rnd.randrange(12), T0 + dt.timedelta(seconds=rnd.randrange(3000)), rnd.uniform(-9, 40), rnd.uniform(0, 30), rnd.choice([0, 0, 1, 2, 5, 60])) for _ in range(20)]
    store = str(tmp_path / "store")
    points = feed(spark, tmp_path, rows, SHAPE, 4, "objects")
    lists = nearest.knn_stream(points, feed(spark, tmp_path, asked, ASKED, 4, "asked"), 4.0, store)
    lists.objects.every = lists.lists.every = 2  # tables written whole in between
    run.drain(lists.writer(), spark)
    for i in (1, 2, 3):
        queries = spark.createDataFrame(asked[: 5 * (i + 1)], ASKED)
        same(lists.current(spark, i), as_of(spark, lists, rows[: 20 * (i + 1)], queries))


def test_one_update_ranks_few_queries_and_writes_little(spark, tmp_path):
    rnd = random.Random(5)
    objects = [(i, i, T0, rnd.uniform(0, 500), rnd.uniform(0, 500)) for i in range(600)]
    moves = [(900, 17, T0 + dt.timedelta(seconds=9), 250.0, 250.0)]
    queries = [(i, rnd.uniform(0, 500), rnd.uniform(0, 500), 1 + i % 4) for i in range(300)]
    asked = spark.createDataFrame(queries, "qid int, fx double, fy double, k int")
    for name, rows in (("a", objects), ("b", moves)):
        feed(spark, tmp_path, rows, SHAPE, 1, name)
        os.makedirs(tmp_path / "all", exist_ok=True)
        os.rename(tmp_path / name / "000.parquet", tmp_path / "all" / f"{name}.parquet")
    lists = nearest.knn_stream(readers.replay(spark, str(tmp_path / "all"), spark.createDataFrame([], SHAPE).schema), asked, 8.0, str(tmp_path / "store"))
    run.drain(lists.writer(), spark)
    ranked = lists.lists.changed(spark, 1).count()
    assert 0 < ranked < 0.05 * len(queries)
    assert lists.objects.changed(spark, 1).count() == 1
    same(lists.current(spark, 1), as_of(spark, lists, objects + moves, asked))


def test_a_batch_run_again_leaves_one_copy(spark, tmp_path):
    """Same batch id, same folder: written twice, read once."""
    out = str(tmp_path / "out")
    points = feed(spark, tmp_path, some_points(40), SHAPE, 2)
    run.drain(run.to_batches(points, out, "append"), spark)
    again = feed(spark, tmp_path, some_points(40), SHAPE, 2, "again")
    run.drain(run.to_batches(again, out, "append"), spark)
    assert run.stored(spark, out, points.schema).count() == 40


def test_output_lines_of_a_stream(spark, tmp_path):
    out = str(tmp_path / "lines")
    points = feed(spark, tmp_path, some_points(40), SHAPE, 2)
    run.drain(sinks.write_output(points, F.concat(F.lit("p"), F.col("pid")), out), spark)
    assert sorted(r.value for r in spark.read.text(out).collect()) == sorted(f"p{i}" for i in range(40))


def test_user_state(spark, tmp_path):
    def fold(state, frame):
        return (state[0] + len(frame), max(state[1], float(frame["x"].max())))

    rows = some_points()
    points = feed(spark, tmp_path, rows, SHAPE).select("pid", "oid", "x")
    for salts in (1, 3):
        states = stateful.stateful_fold(points, "oid", fold, (0, 0.0), "n bigint, top double", salts)
        got = run.collected(spark, states, "update", ["oid", "salt"])
        total = got.groupBy("oid").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
        batch = spark.createDataFrame(rows, SHAPE).groupBy("oid")
        same(total, batch.agg(F.count("*").alias("n"), F.max("x").alias("top")))


def test_lines_console_and_stop(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    stream = readers.lines(spark, "text", path=str(tmp_path / "in"))
    assert stream.isStreaming and stream.columns == ["value"]
    q = run.start(sinks.to_console(stream, 10), str(tmp_path / "check"), every="1 second")
    run.stop(q)
    assert not q.isActive and q.lastProgress is not None


@pytest.mark.parametrize("zone", ["America/New_York"])
def test_stream_times_do_not_depend_on_the_session_zone(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        start = dt.datetime(2024, 3, 10, 1, 0)  # clocks change at 2
        rows = [(i, 0, start + dt.timedelta(minutes=10 * i), 1.0, 1.0) for i in range(20)]
        points = run.event_time(feed(spark, tmp_path, rows, SHAPE), LATE)
        out = agg.agg_window(points, "count", None, 3600.0)
        got = run.calendar_time(run.collected(spark, out, "update", ["window_start", "window_end"]))
        same(got, agg.agg_window(spark.createDataFrame(rows, SHAPE), "count", None, 3600.0))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_state_written_whole_now_and_then(spark, tmp_path):
    """Every batch writes what it changed; folders of spans long past go."""
    schema = spark.createDataFrame([], "k long, v long").schema
    log = StateLog(str(tmp_path), "log", schema, ["k"], every=2)
    want = {}
    for b in range(7):
        rows = [(b % 3, b), (10 + b, b)]
        want |= dict(rows)
        assert log.append(spark.createDataFrame(rows, schema), b).count() == 2
        assert dict(tuple(r) for r in log.before(spark, b + 1).collect()) == want
    log.append(spark.createDataFrame([(0, 99)], schema), 6)  # run again
    want = {k: v for k, v in want.items() if v != 6} | {0: 99}
    assert dict(tuple(r) for r in log.before(spark, 7).collect()) == want | {0: 99}
    assert not os.path.exists(tmp_path / "log" / "delta-000000000")


def test_word_counts_keep_their_state_on_disk(spark, monkeypatch):
    """Words by windows are as many as the texts bring: the state must not lie in the heap."""
    from driftgrid.catalog import streams

    kept, keep = [], run.keep_state_on_disk
    monkeypatch.setattr(streams.run, "keep_state_on_disk", lambda session: kept.append(session) or keep(session))
    assert streams.stream_word_count(spark, "/root/testdata/sf0.001").count() > 0
    assert len(kept) == 1


def test_fold_of_many_keys_in_few_slots(spark, tmp_path):
    """States are carried over batches, null keys apart from others, with fewer groups than keys."""
    big = 2**53 + 1
    rows = [(i, None if i % 17 == 0 else big + i % 29, float(i)) for i in range(600)]

    def fold(state, rows):
        n, top = state
        return n + len(rows), max(top, float(rows["x"].max()))

    fed = [(pid, 0 if oid is None else oid, x) for pid, oid, x in rows]
    df = feed(spark, tmp_path, fed, "pid bigint, oid bigint, x double", 3)
    df = df.withColumn("oid", F.expr("nullif(oid, 0)"))
    states = stateful.stateful_fold(df, "oid", fold, (0, 0.0), "n bigint, top double", salts=2, slots=4)
    assert states.columns == ["oid", "salt", "n", "top"]
    path = str(tmp_path / "out")
    q = run.start(run.to_batches(states, path, "update"), str(tmp_path / "check"), every=None)
    q.awaitTermination()
    out = run.last_updates(run.stored(spark, path, states.schema), ["oid", "salt"])
    got = {r.oid: (r.n, r.top) for r in out.groupBy("oid").agg(F.sum("n").alias("n"), F.max("top").alias("top")).collect()}
    expected = {k: [r[2] for r in rows if r[1] == k] for k in {r[1] for r in rows}}
    assert got == {k: (len(v), max(v)) for k, v in expected.items()}
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 5
    with pytest.raises(ValueError):
        stateful.stateful_fold(df, "oid", fold, (0, 0.0), "n bigint, top double", idle_ms=1, slots=4)
