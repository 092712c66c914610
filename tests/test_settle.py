from types import SimpleNamespace

import pytest

from quirework.plans import settle


def test_shared_folder(spark):
    """The folder the session names, else one temporary folder for the run."""
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: f"/shared/{key}"))
    assert settle.shared_dir(named) == "/shared/spark.checkpoint.dir"
    assert settle.shared_dir(spark) == settle.shared_dir(spark)
    assert settle.settle(spark.range(3)).count() == 3
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError):
        settle.shared_dir(cluster)
