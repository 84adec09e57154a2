"""Decoders on good and bad lines, and the small column functions."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftgrid.functions import spatial, text, timestamps
from driftgrid.sources import decoders, readers, sinks


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


TS = dt.datetime(2013, 4, 1, 0, 0, 0)


def test_decode_points(spark):
    df = lines(
        spark,
        "17 2013-04-01 00:00:00 40.42591 -86.9081 hello",
        "18 2013-04-01 00:00:00 40.4259123456 -86.90812345 hello",  # cut to 8 characters
        "19 2013-04-01 00:00:00 40.5 -86.9",  # five fields
        "20 2013-04-01 00:00:00 40.5 -86.9  ",  # empty fields at the end do not count
        "2a 2013-04-01 00:00:00 40.5 -86.9 hello",
        " 2013-04-01 00:00:00 40.5 -86.9 hello",  # an empty id is all digits
        "21 2013-04-01 00:00:00 forty -86.9 hello",
        "22 noon 00:00:00 40.5 -86.9 hello",
        "",
    )
    got = rows(decoders.decode_points(df))
    assert got == [
        (17, TS, 40.42591, -86.9081),
        (18, TS, 40.42591, -86.9081),
        (None, TS, 40.5, -86.9),
        (22, None, 40.5, -86.9),
    ]
    assert rows(decoders.bad_rows(df, decoders.decode_points)) == [(9, 5)]


def test_decode_tweet_words(spark):
    df = lines(
        spark,
        "18 2013-04-01 00:00:05 40.5 -86.9 rain in town",
        "x 2013-04-01 00:00:05 40.5 -86.9 rain",
        "18 2013-04-01 00:00:05 forty -86.9",
        "too short",
    )
    assert rows(decoders.decode_tweet_words(df)) == [
        (18, 40.5, -86.9, ["rain", "in", "town"], 8, 3, "00:00:05"),
        (0, 0.0, 0.0, ["rain"], 6, 1, "00:00:05"),
        (0, 0.0, 0.0, [], 5, 0, "00:00:05"),
        (0, 0.0, 0.0, [], 2, 0, None),
    ]


def test_decode_tweet_csv(spark):
    df = lines(
        spark,
        "19,2013-04-01 00:00:07,40.5,-86.9,good morning, all",
        "19,2013-04-01 00:00:07,40.5,-86.9",
        "nineteen,2013-04-01 00:00:07,40.5,-86.9,hi",
    )
    assert rows(decoders.decode_tweet_csv(df)) == [
        (19, "2013-04-01 00:00:07", 40.5, -86.9, "good morning")
    ]


def test_decode_tweet_record(spark):
    df = lines(
        spark,
        "20,2013-04-01 00:00:09,40.5,-86.9,77,well, hello",
        "20,2013-04-01 00:00:09,40.5,-86.9,77,",
        "20,2013-04-01 00:00:09,40.5,-86.9,me,hello",
        "20,2013-04-01 00:00:09,40.5,-86.9,77",
    )
    assert [r[4:] for r in rows(decoders.decode_tweet_record(df))] == [(77, "well, hello"), (77, "")]


TRIP = "5,101,2007-05-28 08:41:15.434,2007-05-28 08:41,12.5,7.25,13.0,7.5"


def test_decode_trips(spark):
    start = dt.datetime(2007, 5, 28, 8, 41, 15, 434000)
    df = lines(
        spark,
        TRIP,
        TRIP.replace("2007-05-28 08:41,", ","),  # no end
        TRIP.replace("12.5", "twelve"),
        TRIP.replace("2007-05-28 08:41:15.434", "yesterday"),
    )
    assert rows(decoders.decode_trip_start(df)) == [(5, start, 12.5, 7.25)] * 2
    assert rows(decoders.decode_trip(df)) == [
        (5, start, 12.5, 7.25),
        (5, dt.datetime(2007, 5, 28, 8, 41), 13.0, 7.5),
    ]


@pytest.mark.parametrize(
    "stamp, expected",
    [
        ("2007-05-28 08:41:15.434", dt.datetime(2007, 5, 28, 8, 41, 15, 434000)),
        ("2007-05-28 08:41:15", dt.datetime(2007, 5, 28, 8, 41, 15)),
        ("2007-05-28 08:41", dt.datetime(2007, 5, 28, 8, 41)),
        ("2007-05-28", dt.datetime(2007, 5, 28)),
        ("2007-05", None),
        ("2007-13-28", None),
        ("2007-05-28T08:41:15", None),
        ("", None),
    ],
)
def test_parse_ts(spark, stamp, expected):
    assert one(spark, timestamps.parse_ts(F.lit(stamp))) == expected
    seconds_only = expected if len(stamp) == 19 and expected else None
    assert one(spark, timestamps.created_at_ts(F.lit(stamp))) == seconds_only


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(
            [(dt.datetime(2024, 3, 10, 2, 30, 1, 250001),), (dt.datetime(1969, 12, 31, 23, 59, 59),)],
            "ts timestamp_ntz",
        )
        instant = df.select(timestamps.as_instant(F.col("ts")).alias("i"), "ts")
        back = instant.select(
            timestamps.as_calendar(F.col("i")).alias("c"),
            "ts",
            F.unix_seconds("i").alias("s"),
            timestamps.epoch_seconds(df, "ts").alias("e"),
        ).collect()
        assert all(r.c == r.ts and r.s == r.e for r in back)
        assert [r.e for r in back] == [1710037801, -1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_decode_range_query(spark):
    df = lines(spark, "q1,20.0:10.0,5.0:2.0", "q2,1:2", "q3,1:2,3:4,5:6", "q4,1:2,3:x", "q5")
    got = {r.qid: [tuple(p) for p in r.points] for r in decoders.decode_range_query(df).collect()}
    assert got == {
        "q1": [(20.0, 10.0), (5.0, 2.0)],
        "q2": [(1.0, 2.0)],
        "q3": [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)],
        "q5": [],
    }
    turned = decoders.decode_range_query(df, axes="yx").where("qid = 'q1'").first()
    assert [tuple(p) for p in turned.points] == [(10.0, 20.0), (2.0, 5.0)]
    boxes = decoders.as_boxes(decoders.decode_range_query(df)).collect()
    assert [(r.qid, r.x_min, r.y_min, r.x_max, r.y_max) for r in boxes] == [("q1", 5.0, 2.0, 20.0, 10.0)]


def test_in_box_needs_two_corners(spark):
    df = decoders.decode_range_query(
        lines(spark, "two,20:10,5:2", "one,20:10", "three,20:10,5:2,0:0", "swapped,5:2,20:10")
    )
    inside = df.select("qid", spatial.in_box(F.lit(5.0), F.lit(10.0), F.col("points")).alias("i"))
    assert {r.qid for r in inside.where("i").collect()} == {"two"}


def test_rectangles(spark):
    assert decoders.parse_rect("60,70,20,10") == (20.0, 10.0, 60.0, 70.0)
    assert tuple(one(spark, decoders.decode_rect(F.lit("0,50,50,0")))) == (0.0, 0.0, 50.0, 50.0)
    assert one(spark, decoders.decode_rect(F.lit("0,50,50"))) is None
    assert one(spark, spatial.in_rect(F.lit(3.0), F.lit(4.0), 9.0, 0.0, 3.0, 4.0))
    assert not one(spark, spatial.in_rect(F.lit(2.9), F.lit(4.0), 9.0, 0.0, 3.0, 4.0))


def test_decode_queries_points_entities(spark):
    df = lines(spark, "3,40,-86,5", "3,40.5,-86,5", "3,40,-86")
    assert rows(decoders.decode_knn_query(df)) == [(3, 40, -86, 5)]
    assert rows(decoders.decode_query_point(lines(spark, "7,12.5,3.25", "7,x,1"))) == [(7, 12.5, 3.25)]
    df = lines(spark, "1\tx\thttp://example.org/r/1", "1\tx")
    assert rows(decoders.decode_entity(df)) == [("1", "http://example.org/r/1")]


def test_decode_mbr_json(spark):
    good = F.lit('{"south":1,"east":2,"north":3,"west":4}')
    assert tuple(one(spark, decoders.decode_mbr_json(good))) == (1.0, 3.0, 2.0, 4.0)
    bad = F.lit('{"south":1,"east":2,"north":3}')
    assert one(spark, decoders.decode_mbr_json(bad, strict=False)) is None
    with pytest.raises(PySparkException, match="MBR expected"):
        one(spark, decoders.decode_mbr_json(bad))


def test_numbers(spark):
    assert one(spark, text.to_double(F.lit("-1.5e3"))) == -1500.0
    for bad in ("", "1.2d", "NaN", "1_000", " 1", "0x10", "."):
        assert one(spark, text.to_double(F.lit(bad))) is None
    assert one(spark, text.to_long(F.lit("9223372036854775808"))) is None
    assert one(spark, text.is_all_digits(F.lit("")))
    assert one(spark, text.is_all_digits(F.lit("१२")))
    assert not one(spark, text.is_all_digits(F.lit("1 ")))
    assert one(spark, spatial.trunc_int(F.lit(-3.7))) == -3


def test_words(spark):
    a, b = F.array(F.lit("b"), F.lit("a"), F.lit("b"), F.lit("A")), F.array(F.lit("b"), F.lit("a"))
    assert one(spark, text.shared_words(a, b)) == ["a", "b"]
    assert one(spark, text.distinct_words(a)) == ["b", "a", "A"]
    assert not one(spark, text.any_shared_word(F.array(F.lit("A")), b))
    assert one(spark, text.fields(F.lit("a  b  "))) == ["a", "", "b"]
    assert not one(spark, text.non_empty(F.lit("")))


def test_lines(spark):
    def on(px, py, *ends, **kw):
        return one(spark, spatial.on_line(F.lit(px), F.lit(py), *(F.lit(e) for e in ends), **kw))

    assert on(1.0, 1.04, 0.0, 0.0, 2.0, 2.0)
    assert not on(1.0, 1.06, 0.0, 0.0, 2.0, 2.0)
    assert on(9.0, 9.0, 0.0, 0.0, 2.0, 2.0)  # past the end of a sloped segment
    assert not on(9.0, 9.0, 0.0, 0.0, 2.0, 2.0, bounded=True)
    assert on(1.0, 1.5, 1.0, 2.0, 1.0, 1.0) and not on(1.0, 2.5, 1.0, 2.0, 1.0, 1.0)
    assert not on(1.01, 1.5, 1.0, 2.0, 1.0, 1.0)
    assert one(spark, spatial.slope(*(F.lit(v) for v in (1.0, 0.0, 1.0, 5.0)))) is None


def test_planar_map_round_trip(spark):
    lat, lng = 52.5, 13.4
    x = spatial.PLANAR_X0 + spatial.PLANAR_X1 * lng + spatial.PLANAR_X2 * lat
    y = spatial.PLANAR_Y0 + spatial.PLANAR_Y1 * lng + spatial.PLANAR_Y2 * lat
    got = one(spark, spatial.planar_to_latlng(F.lit(x), F.lit(y)))
    assert got.lat == pytest.approx(lat) and got.lng == pytest.approx(lng)


def test_messages_and_scan(spark, tmp_path):
    raw = spark.createDataFrame([(b"k", b"v"), (None, b"w")], "key binary, value binary")
    assert rows(readers.decode_messages(raw)) == [("k", "v"), (None, "w")]
    sent = sinks.encode_messages(spark.range(2), F.lit("q"), F.col("id"))
    assert rows(sent) == [("q", "0"), ("q", "1")]
    import bz2

    (tmp_path / "t.csv.bz2").write_bytes(bz2.compress(b"a\nb\nc\n"))
    scan = readers.scan_text(spark, str(tmp_path / "t.csv.bz2"), 5)
    assert scan.count() == 3 and scan.rdd.getNumPartitions() == 5
    pairs = readers.tabulate(spark, 10, 3)
    assert pairs.rdd.getNumPartitions() == 3
    assert rows(pairs.groupBy("k").agg(F.sum("v"))) == [(1, 45)]
    sinks.write_output(spark.range(3), F.concat(F.lit("n"), F.col("id")), str(tmp_path / "out"))
    assert sorted(r[0] for r in rows(spark.read.text(str(tmp_path / "out")))) == ["n0", "n1", "n2"]
    assert sinks.to_console(spark.range(30)).count() == 10
