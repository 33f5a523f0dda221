"""The shared folder comes from the session; a cluster without one is refused."""

import pytest

from procatlas import session


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Fake:
    def __init__(self, master, conf):
        self.conf = Conf(conf)
        self.sparkContext = type("Context", (), {"applicationId": "app-1", "master": master})()


def test_configured_folder_wins():
    spark = Fake("spark://host:7077", {"spark.checkpoint.dir": "hdfs://nn/ck/"})
    assert session.shared_root(spark) == "hdfs://nn/ck/procatlas/app-1"


def test_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError):
        session.shared_root(Fake("yarn", {}))


def test_levels_number_and_keep_every_level(spark):
    levels = session.Levels(spark, "levels")
    levels.add(spark.range(3))
    assert levels.add(spark.range(5, 7)).count() == 2
    assert sorted((r.id, r.level) for r in levels.all().collect()) == [(0, 0), (1, 0), (2, 0), (5, 1), (6, 1)]
