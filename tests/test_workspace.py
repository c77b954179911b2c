import shutil
from pathlib import Path
from types import SimpleNamespace

from tamarack import workspace
from tamarack.sources.tables import listing


def test_settle_reads_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    again = workspace.settle(df)
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, None)] and again.schema == df.schema
    assert workspace.settle(df.limit(0)).count() == 0


def test_shared_folder_is_used(spark, tmp_path, monkeypatch):
    named = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: {"spark.checkpoint.dir": "hdfs://shared/folder/"}))
    assert workspace.root(named) == "hdfs://shared/folder"
    monkeypatch.setattr(workspace, "root", lambda _: f"file://{tmp_path}")
    workspace.settle(spark.range(3)).count()
    assert any(tmp_path.iterdir())


def test_no_local_folder_on_a_cluster():
    import pytest

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda *_: None), master=master, applicationId="x"))
        with pytest.raises(RuntimeError):
            workspace.root(cluster)


def test_clear(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "_written", {})
    monkeypatch.setattr(workspace, "root", lambda _: f"file://{tmp_path}")
    workspace.settle(spark.range(3))
    assert any(tmp_path.iterdir()) and workspace.clear(spark) == 1
    assert not any(tmp_path.iterdir()) and workspace.clear(spark) == 0


def test_listing(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "many.parquet"))
    part = next(Path(tmp_path / "many.parquet").glob("*.parquet"))
    shutil.copy(part, tmp_path / "one.parquet")
    found = listing(spark, str(tmp_path))
    assert [f[0] for f in found] == ["many", "one"] and found[1][2] == part.stat().st_size
    assert listing(spark, str(tmp_path / "none")) == []
