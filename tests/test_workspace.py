"""Shared folder and written tables."""

import os

import pytest

from salesloom import workspace


def test_stage_fixes_values(spark):
    from pyspark.sql import functions as F

    df = spark.range(100).withColumn("r", F.rand())
    staged = workspace.stage(df, "random")
    assert staged.exceptAll(staged).count() == 0
    assert staged.schema == df.schema or staged.dtypes == df.dtypes


def test_shared_folder_of_the_session_wins(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = workspace.shared_dir(spark)
    assert folder == configured.rstrip("/") if configured else os.path.isdir(folder)
    assert workspace.new_path(spark, "x") != workspace.new_path(spark, "x")


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "local-cluster[2,1,1024]", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, default=None: None})()

    with pytest.raises(RuntimeError):
        workspace.shared_dir(Session())


def test_drop_staged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "shared_dir", lambda s: str(tmp_path))
    workspace.stage(spark.range(3), "gone")
    assert os.listdir(tmp_path / "salesloom")
    workspace.drop_staged(spark)
    assert os.listdir(tmp_path / "salesloom") == []
