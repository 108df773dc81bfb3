from types import SimpleNamespace

import pytest

from tributary.plans import storage


def session(master, conf=None, known=None):
    """A stand-in for a session whose checkpoint folder is ``known``, or what is set later."""
    place = SimpleNamespace(folder=known)
    option = lambda: SimpleNamespace(isDefined=lambda: place.folder is not None, get=lambda: place.folder)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=option)), setCheckpointDir=lambda f: setattr(place, "folder", f))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: (conf or {}).get(k, d)))


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "k8s://h", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(session(master))
    assert storage.shared_folder(session(master, {"spark.checkpoint.dir": "hdfs:///shared"})) == "hdfs:///shared"
    assert storage.shared_folder(session(master, known="hdfs:///set")) == "hdfs:///set"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_machine_has_its_own(master):
    assert storage.shared_folder(session(master))


def test_cut_lineage_reads_back(spark):
    df = storage.cut_lineage(spark.range(5).selectExpr("id", "id * 2 as x"))
    assert sorted(map(tuple, df.collect())) == [(i, 2 * i) for i in range(5)]
    assert "RDD" in df._jdf.queryExecution().toString()
