"""Intermediate tables, settings, and the entry point without the parts that can be removed."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from edgewise import session

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_scratch_tables_go_with_their_block(spark):
    with session.Scratch(spark) as scratch:
        table = scratch.store(spark.range(10).repartition(3))
        assert table.count() == 10
        folder = scratch.folder.removeprefix("file:")
        assert os.listdir(folder)
    assert not os.path.exists(folder)
    empty = session.stored(spark.range(0))
    assert empty.columns == ["id"] and empty.count() == 0


def test_settings_are_put_back(spark):
    key, unset = "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), session.settings(spark, {key: "7", unset: "5"}):
        assert (spark.conf.get(key), spark.conf.get(unset)) == ("7", "5")
        raise ZeroDivisionError
    assert (spark.conf.get(key), spark.conf.get(unset)) == (before, "10000")


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_every_graph_query_has_sql():
    code = "from edgewise.plans import registry as r; assert set(r.QUERIES) == set(r.SQL), set(r.QUERIES) ^ set(r.SQL)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
