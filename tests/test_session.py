"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from foliospark.plans.session import shared_folder


def fake(master, folder=None):
    chosen = []
    conf = SimpleNamespace(get=lambda key, default=None: folder)
    context = SimpleNamespace(
        master=master, getConf=lambda: conf, getCheckpointDir=lambda: chosen[-1] if chosen else None, setCheckpointDir=chosen.append
    )
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        shared_folder(fake("spark://host:7077"))
    assert shared_folder(fake("spark://host:7077", "s3://bucket/tmp")) == "s3://bucket/tmp"


def test_one_machine_makes_one():
    assert shared_folder(fake("local[2]")).startswith("/tmp/spark-")
