import types

import pytest

from simloom.sources import shared


def session(master, found=None):
    none = types.SimpleNamespace(isDefined=lambda: False)
    context = types.SimpleNamespace(master=master, _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: none)), setCheckpointDir=lambda path: None)
    return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda name, other: found))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://host"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session(master))


def test_discarded_tables_are_gone(spark):
    path = shared.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    shared.discard(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
