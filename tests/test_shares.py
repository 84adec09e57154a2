"""Distinct boxes dealt over broadcasts: whole results, and matches that are not shuffled."""

import re

import brute
import pytest
from pyspark.sql import functions as F
from test_joins import BOX, POINT, frame, some_boxes, some_points

from driftgrid import catalog
from driftgrid.operators import joins
from driftgrid.plans import skew


@pytest.fixture
def small(spark):
    """A broadcast holds some of the boxes and some of their ids."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    yield spark
    spark.conf.set(key, before)


def many_boxes():
    """Forty boxes, each asked for by thirty queries."""
    return [dict(b, qid=100 * b["qid"] + k) for b in some_boxes(40, 2) for k in range(30)]


def shuffles(df):
    """What the rows of a frame are shuffled by, before their plan is changed as it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return {re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)}


def first_hits(points, boxes):
    first = {}
    for p in points:
        for b in boxes:
            if brute.inside(p, b):
                key = b["qid"], p["oid"]
                first[key] = min(first.get(key, p["ts"]), p["ts"])
    return first


def test_range_join_shuffles_nothing(small):
    points, boxes = some_points(200, 1), many_boxes()
    got = joins.range_join(frame(small, points, POINT), frame(small, boxes, BOX), 30.0)
    assert shuffles(got) == set()
    rows = [(r.qid, r.pid) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute.range_join(points, boxes)


def test_first_entries_shuffle_the_points(small):
    points, boxes = some_points(200, 3), many_boxes()
    got = joins.first_entries(frame(small, points, POINT), frame(small, boxes, BOX), 30.0)
    assert shuffles(got) == {"oid"}
    rows = [((r.qid, r.oid), r.entered) for r in got.collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == first_hits(points, boxes)


def test_ever_inside_shuffles_the_points(small):
    points, boxes = some_points(200, 3), many_boxes()
    got = joins.ever_inside(frame(small, points, POINT), frame(small, boxes, BOX), 30.0)
    assert shuffles(got) == {"oid"}
    first = first_hits(points, boxes)
    expected = {
        (b["qid"], p["pid"], brute.inside(p, b))
        for p in points
        for b in boxes
        if (b["qid"], p["oid"]) in first and p["ts"] >= first[b["qid"], p["oid"]]
    }
    rows = [(r.qid, r.pid, r.inside_now) for r in got.collect()]
    assert len(rows) == len(expected) and set(rows) == expected


@pytest.mark.parametrize("rows,pairs", [(20, 10**8), (10**6, 400)])
def test_objects_too_large_for_a_task(small, monkeypatch, rows, pairs):
    """An object's points are then not brought together; results stay whole."""
    monkeypatch.setattr(skew, "TASK_ROWS", rows)
    monkeypatch.setattr(skew, "TASK_PAIRS", pairs)
    points, boxes = some_points(400, 5), many_boxes()
    df, queries = frame(small, points, POINT), frame(small, boxes, BOX)
    assert joins.together(df, joins.box_shapes(queries)) is None
    got = joins.first_entries(df, queries, 30.0)
    assert {(r.qid, r.oid): r.entered for r in got.collect()} == first_hits(points, boxes)


def tables(spark, folder, copies):
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"{folder}/events.parquet")
    one = spark.read.parquet(f"{sf}/supplier.parquet")
    key = F.explode(F.array(*(F.col("s_suppkey") + 1200 * k for k in range(copies))))
    one.withColumn("s_suppkey", key).write.parquet(f"{folder}/supplier.parquet")


@pytest.mark.parametrize("name,by", [("range_join_corners", {"oid"}), ("format_match", {"page"})])
def test_queries_shuffle_the_points(spark, small, tmp_path, name, by):
    tables(spark, str(tmp_path), 40)
    got = catalog.QUERIES[name](spark, str(tmp_path))
    assert shuffles(got) - {"qid"} == by
    hits = catalog.QUERIES["range_join"](spark, str(tmp_path))
    if name == "format_match":
        line = F.concat(F.lit("QueryID = "), "qid", F.lit(", ObjectID = "), "oid")
        expected = hits.select(line.alias("line"))
    else:
        expected = hits.select("qid", "oid").distinct()
    want, found = sorted(map(tuple, expected.collect())), sorted(map(tuple, got.collect()))
    assert found == want and want


def test_matches_of_a_stream_are_stored_once_per_distinct_box(spark, tmp_path, monkeypatch):
    """Four queries to a box: what the streams store does not grow with them."""
    from driftgrid.streaming import run, stateful

    tables(spark, str(tmp_path), 4)
    stored = []
    keep, read = stateful._keep, run.stored

    def seen(df, store, name, batch_id):
        kept = keep(df, store, name, batch_id)
        if name in ("found", "matches"):
            stored.append(kept.count())
        return kept

    def seen_read(*args):
        out = read(*args)
        stored.append(out.count())
        return out

    monkeypatch.setattr(stateful, "_keep", seen)
    monkeypatch.setattr(run, "stored", seen_read)
    for name, batch in (("stream_sticky", "ever_inside"), ("stream_range_join", "range_join")):
        stored.clear()
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = catalog.QUERIES[batch](spark, str(tmp_path)).select(*got.columns)
        rows = sorted(map(tuple, got.collect()))
        assert rows == sorted(map(tuple, want.collect())) and rows
        assert sum(stored) * 4 == len(rows)


def test_pairs_without_words_share_the_same(spark):
    from test_joins import some_messages, words_frame

    df = words_frame(spark, some_messages(150, 10)).unionByName(
        spark.sql("select 999L id, timestamp_ntz'2024-01-01 00:00:01' ts, 0d x, 0d y, cast(null as array<string>) words")
    )
    for named in ({"slide": 10.0}, {}, {"distinct_pairs": True, "require_keywords": True}):
        full = joins.distance_self_join(df, 5.0, 20.0, **named).drop("words1", "words2")
        lean = joins.distance_self_join(df, 5.0, 20.0, words=False, **named)
        assert lean.columns == full.columns
        assert sorted(map(str, lean.collect())) == sorted(map(str, full.collect())) != []
