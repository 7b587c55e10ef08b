"""Tables in the shared folder, and how long they stay."""

import os

import pytest

from kinstats.storage import saved, scope, shared_dir


def tables(spark):
    folder = shared_dir(spark).removeprefix("file://")
    return {x for x in os.listdir(folder) if x.startswith("table-")} if os.path.isdir(folder) else set()


def test_tables_go_with_their_scope(spark):
    before = tables(spark)
    kept = saved(spark.range(5))
    with scope(spark):
        outer = saved(spark.range(7))
        with scope(spark):
            assert saved(spark.range(9)).count() == 9 and len(tables(spark) - before) == 3
        assert outer.count() == 7 and len(tables(spark) - before) == 2
    assert kept.count() == 5 and len(tables(spark) - before) == 1
    with pytest.raises(RuntimeError), scope(spark):
        saved(spark.range(3))
        raise RuntimeError
    assert len(tables(spark) - before) == 1
