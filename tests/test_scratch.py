"""The shared folder."""

from types import SimpleNamespace

import pytest

from rangeloom.sources import scratch


def test_shared_folder_must_be_named_on_a_cluster():
    none = SimpleNamespace(isDefined=lambda: False)
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context)
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.shared_dir(session)


def test_folders_are_dropped(spark):
    at = scratch.new_folder(spark, "x")
    spark.range(3).write.parquet(at)
    assert spark.read.parquet(at).count() == 3
    scratch.drop(spark, at)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(at)
