import os

import pytest

from lexispark import session


class Conf(dict):
    def get(self, name, default=None):
        return dict.get(self, name, default)


class Fake:
    def __init__(self, master, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})
        self.sparkContext = type("C", (), {"master": master, "getCheckpointDir": staticmethod(lambda: None)})


def test_shared_folder():
    assert session.shared_dir(Fake("spark://x:7077", spark_checkpoint_dir="hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        session.shared_dir(Fake("spark://x:7077"))
    conf = Fake("local[4]")
    conf.conf["spark.sql.warehouse.dir"] = "file:/w/"
    assert session.shared_dir(conf) == "file:/w/lexispark"


def test_materialized_tables_are_removed(spark):
    kept = session.materialize(spark.range(5), "five")
    assert kept.count() == 5 and kept.columns == ["id"]
    folder = f"{session.shared_dir(spark)}/lexispark-{spark.sparkContext.applicationId}"
    assert any(x.startswith("five-") for x in os.listdir(folder))
