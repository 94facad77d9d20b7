"""Sweeping single rows out of an archive folder, through crashes."""

import pytest
from pyspark.sql import functions as F

from fleetlens.sources import sinks as K


@pytest.fixture
def archive(spark):
    path = K.scratch_path(spark, "sweep")
    for i in range(4):  # four files; only the first two hold rows below 6
        spark.range(3 * i, 3 * i + 3).coalesce(1).write.mode("append").parquet(f"{path}/{K.NO_DAY}")
    return path


def ids(spark, path):
    return sorted(r[0] for r in spark.read.parquet(f"{path}/{K.NO_DAY}").select("id").collect())


def files(spark, path):
    return {f for f in K.list_children(spark, f"{path}/{K.NO_DAY}") if f.startswith("part-")}


def test_only_touched_files_are_written_anew(spark, archive):
    before = files(spark, archive)
    assert K.sweep(spark, archive, K.NO_DAY, F.col("id") < 5) == 2
    assert ids(spark, archive) == list(range(5, 12)) and len(files(spark, archive) & before) == 2
    assert K.sweep(spark, archive, K.NO_DAY, F.col("id") < 5) == 0
    assert not [c for c in K.list_children(spark, archive) if c.startswith("_swept")]


def test_a_swap_that_was_decided_is_completed(spark, archive, monkeypatch):
    real = K.finish_sweeps
    calls = []
    monkeypatch.setattr(K, "finish_sweeps", lambda s, p: real(s, p) if not calls.append(1) and len(calls) == 1 else None)
    K.sweep(spark, archive, K.NO_DAY, F.col("id") < 5)  # dies before the swap
    assert ids(spark, archive) == list(range(12))
    monkeypatch.undo()
    K.finish_sweeps(spark, archive)
    assert ids(spark, archive) == list(range(5, 12))
    K.finish_sweeps(spark, archive)
    assert ids(spark, archive) == list(range(5, 12))


def test_a_swap_that_was_not_decided_leaves_nothing(spark, archive):
    spark.range(99).write.parquet(f"{archive}/_swept-x/rows")
    assert K.sweep(spark, archive, K.NO_DAY, F.col("id") < 0) == 0
    assert ids(spark, archive) == list(range(12)) and not K.exists(spark, f"{archive}/_swept-x")
