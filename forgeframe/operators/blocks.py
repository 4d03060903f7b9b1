"""All rows of one side compared with all of the other in blocks of bounded size, with a bounded answer a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one side that meet as many of the other in one task.
BLOCK = 4096
#: Tasks that pairs of packed blocks are dealt to, at most.
TASKS = 10_000


def numbered_blocks(rows: DataFrame, key: list[str], name: str, size: int, n: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with a block number by hash of ``key``, and how many blocks there are (about ``size`` rows each, of ``n`` rows if that is known)."""
    blocks = max(1, -(-(rows.count() if n is None else n) // size))
    return rows.withColumn(name, F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")), blocks


def _packed(rows: DataFrame, block: str) -> DataFrame:
    """A row a block, with the other columns of its rows as one Arrow stream."""

    def pack(table: pa.Table) -> pa.Table:
        kept, sink = table.drop_columns(["its block"]), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept.schema) as stream:
            stream.write_table(kept.combine_chunks())
        return pa.table({"its block": table.column("its block").slice(0, 1).cast(pa.int32()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    named = rows.withColumnRenamed(block, "its block")
    return named.groupBy("its block").applyInArrow(pack, "`its block` int, data binary").withColumnRenamed("its block", block)


def _met(function: Callable[[pa.Table, pa.Table], pa.Table]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[int, bytes]] = {}
        for batch in batches:
            for cell, side, data in zip(*(batch.column(name) for name in ("cell", "side", "data")), strict=True):
                other = waiting.pop(cell.as_py(), None)
                if other is None:
                    waiting[cell.as_py()] = (side.as_py(), data.as_py())
                    continue
                left, right = (pa.ipc.open_stream(d).read_all() for _, d in sorted([other, (side.as_py(), data.as_py())], key=lambda known: known[0]))
                yield from function(left, right).to_batches(max_chunksize=10_000)

    return run


def block_pairs(left: DataFrame, right: DataFrame, left_key: list[str], right_key: list[str], function: Callable[[pa.Table, pa.Table], pa.Table], schema: str, size: int | tuple[int, int] = BLOCK, rows: tuple[int | None, int | None] = (None, None), *, packed: bool = False) -> DataFrame:
    """``function(left block, right block)`` for each pair of blocks, dealt to tasks.

    A row travels once for each block of the other side; a task holds two blocks. Rows are dealt to blocks by
    hash of their key, so no order or hot value makes one large; rows of one key share a block. The function is to give back a bounded number of rows for
    each left row, as what it returns is all that is shuffled on. ``rows`` says how many rows the sides have, where that is known or cheaper to count elsewhere.
    ``packed``: large blocks travel as one row each, and each pair has a task of its own; pairs with an empty block are left out. ``size`` may name one for each side.
    """
    size = size if isinstance(size, tuple) else (size, size)
    left, n_left = numbered_blocks(left, left_key, "left\x00", size[0], rows[0])
    right, n_right = numbered_blocks(right, right_key, "right\x00", size[1], rows[1])
    left, right = (_packed(left, "left\x00"), _packed(right, "right\x00")) if packed else (left, right)
    left = left.withColumn("right\x00", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    right = right.withColumn("left\x00", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    if packed:
        number, tasks = F.col("left\x00").cast("long") * n_right + F.col("right\x00"), min(n_left * n_right, TASKS)
        sides = [side.select(number.alias("cell"), F.lit(k).alias("side"), "data") for k, side in enumerate((left, right))]
        return sides[0].union(sides[1]).repartitionById(tasks, (F.col("cell") % tasks).cast("int")).mapInArrow(_met(function), schema)
    cell = ["left\x00", "right\x00"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(function, schema)
