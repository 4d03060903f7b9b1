"""Whole texts through Arrow in batches whose bytes are bounded, so a worker's memory doesn't depend on the texts.

Spark closes a batch by rows and by bytes; its own limit of bytes is 64 MB, of which an executor holds
several copies for each task (both sides of the pipe, and what is made of it). Workers live on after a
task, more of them than there are cores, so each gives its free memory back when its task ends.
"""

from __future__ import annotations

import ctypes
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of a batch. One longer row is a batch alone.
BATCH_BYTES = 2 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Returns what Arrow and the C library hold free to the system, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _tidy(function: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def map_batches(df: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow(function, schema)``; lowers the session's limit of bytes a batch to BATCH_BYTES, if it is higher."""
    conf = df.sparkSession.conf
    now = int(conf.get(_SETTING).rstrip("b"))
    if now <= 0 or now > BATCH_BYTES:
        conf.set(_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(_tidy(function), schema)


def _by_cell(function: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], key: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in itertools.chain(batches, [None]):
            now = pa.concat_tables([*held, *([pa.table(batch)] if batch is not None else [])]) if held or batch is not None else None
            if now is None or not now.num_rows:
                continue
            values = [now.column(c).to_numpy() for c in key]
            begins = np.flatnonzero(np.r_[True, np.any([v[1:] != v[:-1] for v in values], axis=0)])
            end = now.num_rows if batch is None else int(begins[-1])
            if end:
                yield from function(now.slice(0, end).combine_chunks(), np.r_[begins[begins < end], end])
            held = [now.slice(end)] if end < now.num_rows else []

    return run


def map_cells(rows: DataFrame, function: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, key: tuple[str, ...] = ("cell", "dim")) -> DataFrame:
    """``rows`` through ``function(table, offsets)``: whole cells (equal whole numbers in ``key``) at a time, one after the other.

    A cell's rows meet in one task, which holds many small cells but never more than a batch and one
    cell's rows; so keep each cell small. Null keys aren't allowed.
    """
    return map_batches(rows.repartition(*key).sortWithinPartitions(*key), _by_cell(function, list(key)), schema)
