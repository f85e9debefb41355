import os

import pytest

from chronofold.llm import common


class Elsewhere:
    """A session of a cluster whose shared folder is not set."""

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"
        getConf = staticmethod(dict)

    class conf:  # noqa: N801
        get = staticmethod(lambda key, default=None: default)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Elsewhere)


def test_scratch_is_removed(spark):
    rows = common.stored(spark.range(5), "numbers")
    assert rows.count() == 5
    folder = common._own_folder(spark).removeprefix("file://")
    assert os.listdir(folder)
    common.clear_scratch(spark)
    assert not os.path.exists(folder)
    assert common.stored(spark.range(3), "numbers").count() == 3
