"""Scratch tables."""

import pytest

from kerbflow.scratch import CLEANUP, Workspace


def test_written_tables_outlive_their_shuffles(spark):
    work, before = Workspace(spark, "test"), spark.conf.get(CLEANUP, "false")
    counts = spark.range(1000).groupBy("id").count()
    first = work.table(counts, "first")
    assert first.count() == 1000 and first.join(counts, "id").count() == 1000
    assert counts.count() == 1000 and work.table(counts, "second").count() == 1000
    with pytest.raises(Exception):
        work.table(spark.range(3).selectExpr("raise_error('no') x"), "third")
    assert spark.conf.get(CLEANUP, "false") == before


def test_two_writes_at_once_leave_the_setting_as_it_was(spark):
    from concurrent.futures import ThreadPoolExecutor

    from kerbflow.scratch import CLEANUP, Workspace

    before = spark.conf.get(CLEANUP, "false")
    work = Workspace(spark, "two")
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda k: work.table(spark.range(100 * k + 1).groupBy("id").count(), f"t{k}").count(), range(6)))
    assert counts == [100 * k + 1 for k in range(6)] and spark.conf.get(CLEANUP) == before


def test_old_workspaces_are_swept(spark):
    import os
    import time

    from kerbflow.scratch import Workspace, shared_root, sweep

    root = shared_root(spark).removeprefix("file:")
    old, new = Workspace(spark, "old"), Workspace(spark, "new")
    for w in (old, new):
        w.table(spark.range(1), "t")
    os.makedirs(f"{root}/kept-by-others", exist_ok=True)
    for path in (old.path.removeprefix("file:"), f"{root}/kept-by-others"):
        os.utime(path, (time.time() - 9e5, time.time() - 9e5))
    assert sweep(spark, 48) >= 1
    assert not os.path.exists(old.path.removeprefix("file:")) and os.path.exists(new.path.removeprefix("file:")) and os.path.exists(f"{root}/kept-by-others")
