"""The shared folder."""

from types import SimpleNamespace

import pytest

from terrascope import session


def fake(master, named=None, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named), sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_root(fake(master))
        assert session.shared_root(fake(master, named="hdfs:///shared/")) == "hdfs:///shared"
        assert session.shared_root(fake(master, folder="hdfs:///checkpoints")) == "hdfs:///checkpoints"


def test_a_local_session_gets_its_own():
    assert session.shared_root(fake("local[4]")) == session.shared_root(fake("local"))


def test_folders_are_listed_and_removed(spark):
    path = session.fresh_path(spark, "listed")
    spark.range(1).write.parquet(f"{path}/a")
    assert session.folder_names(spark, path) == ["a"]
    assert session.remove_folder(spark, path) and session.folder_names(spark, path) == []
