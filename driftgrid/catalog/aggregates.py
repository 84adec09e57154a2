"""Rectangle aggregates, latest updates, word counts, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgrid.catalog.registry import PLANAR_LAT, PLANAR_LNG, query
from driftgrid.functions import spatial
from driftgrid.operators import aggregates as agg
from driftgrid.operators import words
from driftgrid.operators.reducers import Reducer, fold_windows
from driftgrid.sources import decoders, tables

RECT = "60,70,20,10"
HOUR = 3600.0
INSIDE = "x between 20 and 60 and y between 10 and 70"
WINDOWS = f"""
    select time_bucket(interval '1 hour', ts) window_start, count(*) n, max(x) mx, min(x) mn, sum(cast(x as decimal(12,2))) s
    from points where {INSIDE} group by 1"""


@query("rect_filter", f"select pid, oid, ts, x, y from points where {INSIDE}")
def rect_filter(spark, sf_dir):
    return agg.inside(tables.points(spark, sf_dir), decoders.parse_rect(RECT))


@query("agg_batch_count", f"select count(*) n_points from points where {INSIDE}")
def agg_batch_count(spark, sf_dir):
    return agg.agg_batch(tables.points(spark, sf_dir), "count", decoders.parse_rect(RECT))


@query("agg_landmark_count_batch", f"select count(*) n_points from points where {INSIDE}")
def agg_landmark_count_batch(spark, sf_dir):
    return agg.agg_landmark(tables.points(spark, sf_dir), "count", decoders.parse_rect(RECT), 0)


def measured(points):
    """Points with x once more as a decimal, so that sums do not depend on their order."""
    return points.withColumn("m", F.col("x").cast("decimal(12,2)"))


def doubles(df):
    return df.withColumns({c: F.col(c).cast("double") for c, t in df.dtypes if "decimal" in t})


def _window_query(fn):
    def run(spark, sf_dir):
        points = measured(tables.points(spark, sf_dir))
        return doubles(agg.agg_window(points, fn, decoders.parse_rect(RECT), HOUR, value="m"))

    return run


def _landmark_query(fn):
    def run(spark, sf_dir):
        points = measured(tables.points(spark, sf_dir))
        return doubles(agg.agg_landmark(points, fn, decoders.parse_rect(RECT), HOUR, value="m"))

    return run


_PER_WINDOW = {
    "count": "n n_points",
    "max": "mx max_value",
    "min": "mn min_value",
    "sum": "cast(s as double) sum_value",
    "avg": "cast(s as double) / n avg_value",
}
_RUNNING = {
    "count": "cast(sum(n) over o as bigint) n_points",
    "max": "max(mx) over o max_value",
    "min": "min(mn) over o min_value",
    "sum": "cast(sum(s) over o as double) sum_value",
    "avg": "cast(sum(s) over o as double) / sum(n) over o avg_value",
}
for _fn in agg.FUNCTIONS:
    query(
        f"agg_window_{_fn}",
        f"""with w as ({WINDOWS}) select window_start, window_start + interval '1 hour' window_end,
        {_PER_WINDOW[_fn]} from w""",
    )(_window_query(_fn))
    query(
        f"agg_landmark_{_fn}",
        f"""with w as ({WINDOWS}) select window_start, window_start + interval '1 hour' window_end,
        {_RUNNING[_fn]} from w
        window o as (order by window_start rows unbounded preceding)""",
    )(_landmark_query(_fn))


@query(
    "agg_window_filled",
    """with w as (select time_bucket(interval '10 minutes', ts) window_start, count(*) n,
                      sum(cast(x as decimal(12,2))) s
               from points where x between 20 and 60 and y between 10 and 70 group by 1),
    c as (select unnest(generate_series(min(window_start), max(window_start),
                                        interval '10 minutes')) window_start from w)
    select c.window_start, c.window_start + interval '10 minutes' window_end,
           coalesce(w.n, 0) n_points, coalesce(cast(w.s as double) / w.n, 0.0) avg_value
    from c left join w using (window_start)""",
)
def agg_window_filled(spark, sf_dir):
    points = measured(tables.points(spark, sf_dir))
    rect = decoders.parse_rect(RECT)
    return agg.agg_window(points, ["count", "avg"], rect, 600.0, value="m", fill_empty=True)


@query(
    "agg_avg_nulls",
    f"""with w as (select time_bucket(interval '6 hours', ts) window_start, count(*) n,
                      sum(case when pid % 3 <> 0 then cast(x as decimal(12,2)) end) s,
                      count(*) filter (pid % 3 <> 0) m from points where {INSIDE} group by 1)
    select window_start, window_start + interval '6 hours' window_end, n n_points,
           cast(s as double) / nullif(m, 0) avg_value,
           cast(sum(s) over o as double) / nullif(cast(sum(m) over o as bigint), 0) avg_since
    from w window o as (order by window_start rows unbounded preceding)""",
)
def agg_avg_nulls(spark, sf_dir):
    """Averages per window and since the first point; every third point has no measure."""
    points = measured(tables.points(spark, sf_dir))
    points = points.withColumn("m", F.when(F.col("pid") % 3 != 0, F.col("m")))
    rect = decoders.parse_rect(RECT)
    windows = agg.agg_window(points, ["count", "avg"], rect, 6 * HOUR, value="m")
    since = agg.agg_landmark(points, "avg", rect, 6 * HOUR, value="m")
    since = since.select("window_start", F.col("avg_value").alias("avg_since"))
    return windows.join(since, "window_start").select(*windows.columns, "avg_since")


@query(
    "agg_window_predicate",
    f"""select time_bucket(interval '1 hour', ts) window_start,
           time_bucket(interval '1 hour', ts) + interval '1 hour' window_end, count(*) n_points,
           max(x) max_value
    from points where {INSIDE} and oid % 2 = 0 and y < 50 group by 1, 2""",
)
def agg_window_predicate(spark, sf_dir):
    """Windows over the points that a user's own condition keeps."""
    own = (F.col("oid") % 2 == 0) & (F.col("y") < 50)
    rect = decoders.parse_rect(RECT)
    return agg.agg_window(tables.points(spark, sf_dir), ["count", "max"], rect, HOUR, predicate=own)


@query(
    "latest_per_object",
    "select pid, oid, ts, x, y from latest",
)
def latest_per_object(spark, sf_dir):
    return agg.latest_per_key(tables.points(spark, sf_dir), "oid", "ts", "pid")


@query(
    "word_count",
    """select word, count(*) n
    from (select unnest(case when rtrim(text, ' ') = '' and text <> '' then []
                        else string_split(rtrim(text, ' '), ' ') end) word from documents) group by word""",
)
def word_count(spark, sf_dir):
    return words.word_count(tables.table(spark, sf_dir, "documents"), " ", "text")


@query(
    "word_count_blank",
    """with t as (select case doc_id % 4 when 0 then repeat(' ', cast(1 + doc_id % 7 as int))
                               when 1 then '' else left(text, 40) end s from documents)
    select word, count(*) n
    from (select unnest(case when rtrim(s, ' ') = '' and s <> '' then []
                        else string_split(rtrim(s, ' '), ' ') end) word from t) group by word""",
)
def word_count_blank(spark, sf_dir):
    """Lines of blanks only have no word, empty lines an empty one."""
    part = F.col("doc_id") % 4
    line = (
        F.when(part == 0, F.repeat(F.lit(" "), (1 + F.col("doc_id") % 7).cast("int")))
        .when(part == 1, F.lit(""))
        .otherwise(F.left("text", F.lit(40)))
    )
    docs = tables.table(spark, sf_dir, "documents").select(line.alias("value"))
    return words.word_count(docs)


@query(
    "word_count_window",
    """with w as (
        select time_bucket(interval '3 hours', ts) - g * interval '3 hours' window_start,
               unnest(case when rtrim(text, ',') = '' and text <> '' then []
                      else string_split(rtrim(text, ','), ',') end) word
        from tweets, (select unnest([0, 1]) g))
    select window_start, window_start + interval '6 hours' window_end, word, count(*) n
    from w group by all""",
)
def word_count_window(spark, sf_dir):
    return words.word_count_window(
        tables.tweets(spark, sf_dir), 6 * HOUR, 3 * HOUR, ",", "text"
    )


@query(
    "sum_by_key",
    """select l_suppkey k, cast(sum(l_partkey) as bigint) total from lineitem group by 1""",
)
def sum_by_key(spark, sf_dir):
    pairs = tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("v")
    )
    return agg.sum_by_key(pairs, 8)


@query("sum_by_constant_key", "select 1 k, cast(sum(l_partkey) as bigint) total from lineitem")
def sum_by_constant_key(spark, sf_dir):
    pairs = tables.table(spark, sf_dir, "lineitem").select(
        F.lit(1).alias("k"), F.col("l_partkey").alias("v")
    )
    return agg.sum_by_key(pairs)


@query("scan_count", "select count(*) n_rows from lineitem")
def scan_count(spark, sf_dir):
    return agg.count_rows(tables.table(spark, sf_dir, "lineitem"))


@query(
    "in_bounds",
    """select pid, x between 25.562265014427492 and 49.26780455063753
              and -y between -125.33203125 and -66.4453125 inside from points""",
)
def in_bounds(spark, sf_dir):
    inside = spatial.in_bounds(F.col("x"), -F.col("y"), spatial.US_BOUNDS)
    return tables.points(spark, sf_dir).select("pid", inside.alias("inside"))


@query("mbr_contains", "select pid, x, y from points where x >= 10 and x <= 30 and y >= 20 and y <= 40")
def mbr_contains(spark, sf_dir):
    kept = spatial.mbr_contains(F.col("x"), F.col("y"), 10.0, 30.0, 20.0, 40.0)
    return tables.points(spark, sf_dir).where(kept).select("pid", "x", "y")


@query(
    "planar_to_latlng",
    f"select moid, tripid, round({PLANAR_LAT}, 9) lat, round({PLANAR_LNG}, 9) lng from trips",
)
def planar_to_latlng(spark, sf_dir):
    p = spatial.planar_to_latlng(F.col("xstart"), F.col("ystart"))
    return tables.trips(spark, sf_dir).select(
        "moid", "tripid", F.round(p["lat"], 9).alias("lat"), F.round(p["lng"], 9).alias("lng")
    )


def _before(x, pid, x2, pid2):
    """Whether a point comes before another: the greater x, then the lesser id; absent ones last."""
    first = (x > x2) | ((x == x2) & (pid < pid2))
    return (first.fillna(False) | x2.isna()) & x.notna()


def _two_best(a, b):
    out = a.copy()
    out["n"] = a.n + b.n
    left = _before(a.x, a.pid, b.x, b.pid)
    low, low_pid = b.x.where(left, a.x), b.pid.where(left, a.pid)
    out["x"], out["pid"] = a.x.where(left, b.x), a.pid.where(left, b.pid)
    next_, next_pid = a.x2.where(left, b.x2), a.pid2.where(left, b.pid2)
    stays = _before(next_, next_pid, low, low_pid)
    out["x2"], out["pid2"] = next_.where(stays, low), next_pid.where(stays, low_pid)
    return out


@query(
    "agg_window_user",
    f"""with w as (select time_bucket(interval '2 hours', ts) - k * interval '2 hours' window_start, pid, x
        from points cross join (select unnest(range(3)) k) where {INSIDE}),
    r as (select *, row_number() over (partition by window_start order by x desc, pid) p from w)
    select window_start, window_start + interval '6 hours' window_end, count(*) n,
           max(case when p = 1 then x end) x, max(case when p = 1 then pid end) pid,
           max(case when p = 2 then x end) x2, max(case when p = 2 then pid end) pid2
    from r group by 1""",
)
def agg_window_user(spark, sf_dir):
    """The two points of greatest x in every sliding window, by a reducer of the user's own."""
    two_best = Reducer(
        {
            "n": "cast(1 as bigint)",
            "x": "x",
            "pid": "cast(pid as bigint)",
            "x2": "cast(null as double)",
            "pid2": "cast(null as bigint)",
        },
        _two_best,
    )
    rect = decoders.parse_rect(RECT)
    return fold_windows(tables.points(spark, sf_dir), two_best, 6 * HOUR, 2 * HOUR, rect=rect)
