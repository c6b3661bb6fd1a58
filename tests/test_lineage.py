from types import SimpleNamespace

import pytest

from framelake.operators.lineage import cut, ensure_checkpoint_dir, place, shared_folder


def session(master, configured=None, folder=None):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else folder, setCheckpointDir=made.append, getConf=lambda: SimpleNamespace(get=lambda key: configured))
    return SimpleNamespace(sparkContext=context), made


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]", "local[4, 2]"])
def test_local_sessions_get_a_folder(master):
    spark, made = session(master)
    ensure_checkpoint_dir(spark)
    assert len(made) == 1


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"])
def test_clusters_must_name_one(master):
    spark, made = session(master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(spark)
    spark, made = session(master, "file:/shared")
    ensure_checkpoint_dir(spark)
    assert made == ["file:/shared"]


@pytest.mark.parametrize(("folder", "path"), [("file:///a/b", "/a/b"), ("file:/a/b", "/a/b"), ("/a/b", "/a/b"), ("hdfs://n/a", None), ("s3a://n/a", None)])
def test_only_mounted_folders_have_a_path(folder, path):
    spark, _ = session("yarn", folder=folder)
    assert shared_folder(spark) == path
    if path is None:
        with pytest.raises(ValueError, match="mounted"):
            place(spark, "x")
    else:
        assert place(spark, "x").startswith(f"{path}/x-")


def test_cut_tables_are_the_same(spark):
    df = spark.range(10).repartition(3)
    assert sorted(r.id for r in cut(df).collect()) == list(range(10))
