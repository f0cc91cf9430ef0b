from types import SimpleNamespace

import pytest

from textloom import config


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        session = SimpleNamespace(sparkContext=SimpleNamespace(applicationId=f"app-{master}", master=master), conf=SimpleNamespace(get=lambda name, default: default))
        with pytest.raises(ValueError, match="checkpoint.dir"):
            config.scratch_root(session)


def test_scope_removes_what_was_written_in_it(spark):
    before = config.materialized(spark.range(3), "before")
    with config.scratch_scope(spark):
        config.materialized(spark.range(5), "within")
        inside = config._MADE[spark.sparkContext.applicationId][-1]
    path = lambda p: spark._jvm.java.io.File(p.removeprefix("file://").removeprefix("file:"))
    assert not path(inside).exists() and before.count() == 3
