"""Every named query against its SQL, on the smallest tables, and what the plans look like."""

import oracle
import pytest

import __spark_entry__ as entry
from driftgrid import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    assert oracle.compare(df, con, entry.oracle_sql()[name]) is None


def test_every_query_of_the_catalogue_is_registered():
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["window_start", "window_end", "n_points"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if not n.startswith("stream_")])
def test_no_cross_join_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for operator in ("CartesianProduct", "NestedLoopJoin"):
        assert operator not in text
    # A reducer of the user's own is Python by nature.
    for operator in ("Python", "Pandas", "MapInArrow"):
        assert operator not in text or name == "agg_window_user"


def test_rectangle_reaches_the_scan(spark):
    text = plan(entry.queries()["agg_window_count"](spark, SF))
    assert "GreaterThanOrEqual(value,20.0)" in text
    assert "LessThanOrEqual(value,60.0)" in text


def test_count_reads_no_text(spark):
    text = plan(entry.queries()["agg_window_count"](spark, SF))
    assert "event_type" not in text


def test_nearest_are_limited_before_the_shuffle(spark):
    text = plan(entry.queries()["knn_join"](spark, SF))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_sums_are_partial_before_the_shuffle(spark):
    text = plan(entry.queries()["sum_by_key"](spark, SF))
    assert "partial_sum" in text
