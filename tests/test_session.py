from __future__ import annotations

from types import SimpleNamespace

import pytest

from stratusqc.session import scratch_dir, shuffles_removed


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=conf.get), sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(session(master), "x")
    named = session(master, **{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert scratch_dir(named, "x").startswith("hdfs:///shared/stratusqc-x-")


def test_a_local_session_gets_a_folder_of_its_own():
    assert scratch_dir(session("local[4]"), "x") != scratch_dir(session("local[4]"), "x")


def test_shuffles_are_removed_inside_only(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), shuffles_removed(spark):
        assert spark.conf.get(key) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(key) == before
