"""Staged tables: nothing stays behind, and ranges follow the bytes."""

import os

import pytest

import corpus_pipeline
from forgeframe.llm import queries, storage

ALL = {**queries.queries(), "pipeline": corpus_pipeline.run}


def left(spark):
    folder = os.path.dirname(storage.new_path(spark, "any")).removeprefix("file:")
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


@pytest.mark.parametrize("name", sorted(ALL))
def test_nothing_stays(spark, sf_dir, name, tmp_path):
    before = left(spark)
    with storage.scope(spark):
        ALL[name](spark, sf_dir).write.parquet(f"{tmp_path}/out")
    assert left(spark) == before and spark.read.parquet(f"{tmp_path}/out").count() > 0


def test_scopes_within_scopes(spark):
    before = left(spark)
    with storage.scope(spark):
        outer = storage.staged(spark.range(3), "outer")
        with pytest.raises(ValueError), storage.scope(spark):
            storage.staged(spark.range(2), "inner")
            raise ValueError
        assert outer.count() == 3 and len(left(spark)) == len(before) + 1
        storage.release(outer)
    assert left(spark) == before


def test_ranges_follow_bytes(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert storage.ranges(docs) == 4
    monkeypatch.setattr(storage, "RANGE_BYTES", 1 << 10)
    assert 20 < storage.ranges(docs) < 2000
    monkeypatch.setattr(storage, "MOST_RANGES", 9)
    assert storage.ranges(docs) == 9
