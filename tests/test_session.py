import os
from types import SimpleNamespace

import pytest

from lamplight import session


def test_cut_free_and_scratch(spark):
    a = session.cut(spark.range(10))
    path = a._lamplight_path.removeprefix("file://")
    assert a.count() == 10 and os.path.isdir(path)
    session.free(a, spark.range(1))
    assert not os.path.exists(path)
    with session.scratch(spark):
        b = session.cut(spark.range(3))
        assert b.count() == 3
    assert not os.path.exists(b._lamplight_path.removeprefix("file://"))


@pytest.mark.parametrize("master,fine", [("local", True), ("local[4]", True), ("local[*]", True), ("local-cluster[3,2,1024]", False), ("spark://host:7077", False), ("yarn", False), ("k8s://https://h", False)])
def test_a_cluster_must_name_its_shared_folder(master, fine):
    conf = {}
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))
    if fine:
        assert session.shared_dir(fake) == conf["spark.checkpoint.dir"]
    else:
        with pytest.raises(session.NoSharedFolder):
            session.shared_dir(fake)
        conf["spark.checkpoint.dir"] = "hdfs://x/y"
        assert session.shared_dir(fake) == "hdfs://x/y"
