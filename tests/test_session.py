"""Where intermediate tables go."""
from types import SimpleNamespace

import pytest

from builders import make_nodes, make_pods
from mooring import session
from mooring.functions.features import derive
from mooring.operators.candidates import candidates


def fake(master, context_dir=None, setting=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: context_dir)
    conf = SimpleNamespace(get=lambda key, default=None: setting or default)
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_context_folder_comes_first():
    assert session.shared_dir(fake("yarn", "hdfs:/a", "hdfs:/b")) == "hdfs:/a"


def test_setting_comes_second():
    assert session.shared_dir(fake("yarn", None, "hdfs:/b")) == "hdfs:/b"


def test_temporary_folder_on_a_local_master_only():
    assert session.shared_dir(fake("local[4]"))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_cluster_without_folder_is_an_error(master):
    with pytest.raises(ValueError):
        session.shared_dir(fake(master))


def test_wide_columns_are_compiled_whatever_the_session_says(spark):
    own, key = spark.newSession(), session.METHOD_LIMIT_KEY
    own.conf.set(key, "65535")
    pods, nodes = make_pods(own, [(1, 0, 0, 100, 100)]), make_nodes(own, [(1, 900, 900, 0, 0, 1)])
    assert derive(candidates(pods, nodes)).count() == 1
    assert int(own.conf.get(key)) <= session.COMPILED_BYTES
    own.conf.set(key, "4000")
    derive(candidates(pods, nodes))
    assert own.conf.get(key) == "4000"
