"""Intermediate tables of a scope go when it ends."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest

from ledgerscope.session import land, scratch_path, scratch_scope, shared_dir


def test_scope_deletes_its_tables_only(spark):
    kept = land(spark.range(3), "kept")
    with scratch_scope(spark) as folder:
        table = land(spark.range(5), "inside")
        with scratch_scope(spark, "inner") as inner:
            land(spark.range(2), "deep")
            assert inner.startswith(folder)
        assert table.count() == 5
        files = list(Path(folder.removeprefix("file:")).rglob("*.parquet"))
        assert files
    assert not Path(folder.removeprefix("file:")).exists()
    assert kept.count() == 3 and "run-" not in scratch_path(spark, "x")


def test_a_cluster_needs_a_shared_folder():
    for master, fine in (("local", True), ("local[2]", True), ("local-cluster[2,1,1024]", False), ("yarn", False)):
        context = SimpleNamespace(master=master, applicationId=f"app-{master}")
        fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
        if fine:
            assert shared_dir(fake)
        else:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                shared_dir(fake)
