"""Where state and cut-off results are written."""

import pytest

from driftgrid import session
from driftgrid.operators import words


class Context:
    applicationId = "app"

    def __init__(self, master):
        self.master = master


class Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class Session:
    def __init__(self, master, **conf):
        self.sparkContext, self.conf = Context(master), Conf(conf)


def test_the_named_folder_is_used():
    named = Session("spark://host", **{"spark.checkpoint.dir": "hdfs://shared/c/"})
    assert session.shared_dir(named) == "hdfs://shared/c"
    assert session.fresh_dir(named, "x").startswith("hdfs://shared/c/x-")


def test_a_cluster_must_name_a_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session("yarn"))


def test_cut_lineage_keeps_rows_and_forgets_the_plan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    df = words.word_count(spark.createDataFrame([("a b a",)], "value string"))
    cut = session.cut_lineage(df)
    assert sorted(map(tuple, cut.collect())) == [("a", 2), ("b", 1)]
    assert len(list(tmp_path.iterdir())) == 1
    assert cut.inputFiles()
