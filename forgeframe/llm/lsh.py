"""Clusters of near-duplicate items from banded sketches, with every link confirmed exactly.

Shared by the document operator (HyperMinHash registers) and the paragraph operator (MinHash values).
An item is a row (id, bands, sketch). Two items that agree in a band are candidates. No bucket is ever
expanded into all its pairs:

1. star: each bucket's members are paired with the bucket's smallest id; pairs whose sketches are
   plainly too different go, the rest are verified exactly; components are formed. Buckets that still
   hold several are paired once more, with a member chosen by hash, so that groups grow together;
2. rest: a bucket that still holds several components is compared inside tasks, in blocks of bounded
   size, and only pairs across components that the sketches leave possible come out, to be verified.

After step 2 every pair that shares a band is either in one component or was compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_batches
from .graph import components
from .storage import release, staged

#: Items of one bucket that one task compares with as many others.
BLOCK = 1024
#: Comparisons that a row of a block costs besides its own, comparisons of one task, and most tasks.
ROW_WORK, TASK_WORK, MOST_TASKS = 128, 1 << 20, 100_000
#: Bytes up to which a table is sent to the executors whole; beyond, the join is shuffled.
BROADCAST_BYTES = 16 << 20


def _bytes(column, kind: T.DataType):
    """(bytes of any value of ``kind``, bytes that this one has besides)."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16, F.octet_length(column)
    if isinstance(kind, T.StructType):
        parts = [_bytes(column[f.name], f.dataType) for f in kind]
        return 16 + sum(n for n, _ in parts), sum((x for _, x in parts if x is not None), F.lit(0))
    if isinstance(kind, T.ArrayType):
        n, more = _bytes(F.lit(None).cast(kind.elementType), kind.elementType)
        if not isinstance(kind.elementType, (T.NumericType, T.StructType)):
            raise TypeError(f"no bound of bytes for {kind.simpleString()}")
        return 16, F.size(column) * n
    return 8, None


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if its rows, measured, have at most ``limit`` bytes. Call on staged tables."""
    parts = [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    more = sum((F.coalesce(F.sum(x), F.lit(0)) for _, x in parts if x is not None), F.lit(0))
    rows, own = df.agg(F.count("*"), more).first()
    return F.broadcast(df) if rows * (32 + sum(n for n, _ in parts)) + own <= limit else df


@dataclass(frozen=True)
class Sketch:
    """What the stored sketches are: ``width`` values of ``dtype`` (0: nothing there).

    A pair may be similar if the share of equal values among those that either side has, with the
    expected share ``accident`` of equal values by chance taken off, is at least ``least``. Where each
    element of a set can change one value only, ``differing`` is the largest share of both sizes' sum in
    which a link may differ: more unequal values than that rule it out, whatever the estimate.
    """

    width: int
    dtype: str
    least: float
    accident: float = 0.0
    differing: float | None = None

    def rows(self, column) -> np.ndarray:
        return np.frombuffer(b"".join(column), self.dtype).reshape(-1, self.width)

    def possible(self, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For rows of sketches, and the sums of their sets' sizes."""
        used = ((x > 0) | (y > 0)).sum(1)
        equal = ((x == y) & (x > 0)).sum(1)
        raw = equal / np.maximum(used, 1)
        out = (raw - self.accident) / (1 - self.accident) >= self.least
        return out if self.differing is None else out & (used - equal <= self.differing * sizes + 1e-9)


def _estimated(kind: Sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, y = (kind.rows(part.column(c).to_pylist()) for c in ("sketch_a", "sketch_b"))
                yield part.select(["a", "b"]).filter(pa.array(kind.possible(x, y, part.column("sizes").to_numpy())))

    return run


def _compared(kind: Sketch):
    """Within one pair of blocks: the pairs of different labels that may be similar.

    Rows go by the number of values they have: for a possible pair the smaller number is at least
    ``least`` times the larger one. A quarter of the values is compared first. A pair that shares an
    earlier band comes out there, and not here.
    """

    def run(cell: pa.Table) -> pa.Table:
        sketch = kind.rows(cell.column("sketch").to_pylist())
        has = (sketch > 0).sum(1)
        order = np.argsort(has, kind="stable")
        sketch, has = sketch[order], has[order]
        ids, label, block, n = (cell.column(c).to_numpy()[order] for c in ("id", "label", "block", "n"))
        keys = cell.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        earlier = keys[order][:, : cell.column("band")[0].as_py()]
        alone = cell.column("low")[0] == cell.column("high")[0]
        quarter = max(1, kind.width // 4)
        found = [np.zeros((0, 2), np.int64)]
        for i in range(len(ids)):
            to = np.searchsorted(has, has[i] / kind.least, "right")
            other = np.arange(i + 1, to)
            other = other[(label[other] != label[i]) & (ids[other] != ids[i]) & (alone | (block[other] != block[i]))]
            if len(other) > 32:
                x, y = sketch[i, :quarter], sketch[other, :quarter]
                used = ((y > 0) | (x > 0)).sum(1)
                other = other[(used < 24) | (((y == x) & (x > 0)).sum(1) >= (kind.least - 0.3) * used)]
            if len(other):
                other = other[~((earlier[other] == earlier[i]) & (earlier[i] != 0)).any(1)]
            if len(other):
                other = other[kind.possible(sketch[i : i + 1], sketch[other], n[other] + n[i])]
                found.append(np.c_[np.full(len(other), ids[i]), ids[other]])
        pairs = np.sort(np.concatenate(found), axis=1)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _connected(percent: int):
    """Within one pair of blocks: links, checked on whole sets, that join labels; as many as join them all.

    One pass over the blocks' elements gives the intersections of one member with all others.
    """

    def run(cell: pa.Table) -> pa.Table:
        sets = cell.column("shingles").combine_chunks()
        of = sets.offsets.to_numpy().astype(np.int64)
        n = np.diff(of)
        ids, block = cell.column("id").to_numpy(), cell.column("block").to_numpy()
        _, label = np.unique(cell.column("label").to_numpy(), return_inverse=True)
        unique, element = np.unique(sets.values.to_numpy(), return_inverse=True)
        alone = cell.column("low")[0] == cell.column("high")[0]
        has, found = np.zeros(len(unique), np.int64), []
        for i in range(len(ids)):
            other = (label != label[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent) & (alone | (block != block[i]))
            if not other.any():
                continue
            own = element[of[i] : of[i + 1]]
            has[own] = 1
            common = np.add.reduceat(has[element], of[:-1])
            has[own] = 0
            for j in np.flatnonzero(other & (common * 100 >= (n + n[i] - common) * percent)):
                if label[j] != label[i]:
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    label[label == label[j]] = label[i]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those whose whole ``sets`` (id, shingles) have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).alias("n")).where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b")


def clusters(items: DataFrame, kind: Sketch, sets_of: Callable[[DataFrame], DataFrame], percent: int, whole_blocks: bool = False) -> tuple[DataFrame, DataFrame]:
    """((id, root) of every linked item, links (a, b)), both staged, of staged ``items`` (id, n, bands, sketch).

    ``n`` is the size of the item's set. ``bands`` holds one value a band, null where the band says
    nothing; ``sketch`` is as ``kind`` says. ``sets_of`` takes staged ids (id) and returns their whole sets
    (id, shingles); items link if these have 100 * intersection >= percent * union. With
    ``whole_blocks`` step 2 compares whole sets instead of sketches, which suits small sets: then only
    links come out, no more than join the components.
    """

    def verify(pairs: DataFrame) -> DataFrame:
        ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")
        sets = staged(sets_of(ids), "sets")
        out = staged(linked(pairs, sets, percent), "linked")
        release(ids, sets, pairs)
        return out

    def grown(links: DataFrame, more: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All links, and their components in place of ``found``."""
        both = staged(links.union(more), "links")
        release(links, more, found)
        return both, components(both)

    rows = items.select("id", F.posexplode("bands").alias("band", "key")).where("key is not null")
    buckets = staged(rows.groupBy("band", "key").agg(F.min("id").alias("pivot"), F.min(F.struct(F.xxhash64("id", "band", "key"), "id"))["id"].alias("other"), F.count("*").alias("m")).where("m > 1"), "buckets")
    shared = staged(rows.join(small(buckets), ["band", "key"]), "shared")
    sketches = items.select("id", "n", "sketch")

    def star(members: DataFrame, pivot: str) -> DataFrame:
        pairs = members.where(F.col("id") != F.col(pivot)).select(F.least("id", pivot).alias("a"), F.greatest("id", pivot).alias("b")).distinct()
        pairs = pairs.join(sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sketch_b")), "b")
        pairs = pairs.join(sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sketch_a")), "a")
        pairs = pairs.select("a", "b", (F.col("na") + F.col("nb")).alias("sizes"), "sketch_a", "sketch_b")
        return verify(staged(map_batches(pairs, _estimated(kind), "a long, b long"), "star"))

    def still_open(found: DataFrame) -> DataFrame:
        """Members, with their labels, of the buckets of three or more that hold several components."""
        several = shared.where("m > 2").join(small(found), "id", "left").withColumn("label", F.coalesce("root", "id"))
        mixed = several.groupBy("band", "key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("band", "key")
        mixed = staged(mixed, "mixed")  # so that the join below reads plain shuffles, which Spark splits where a key is hot
        out = staged(several.join(small(mixed), ["band", "key"], "left_semi").drop("root"), "open")
        release(mixed)
        return out

    links = star(shared, "pivot")
    found = components(links)
    rest = still_open(found)
    release(buckets)
    if rest.isEmpty():
        release(shared, rest)
        return found, links
    labels = rest.where("id = other").select("other", "band", "key", F.col("label").alias("its"))
    links, found = grown(links, star(rest.join(labels, ["band", "key", "other"]).where("label <> its"), "other"), found)
    release(rest)
    rest = still_open(found)
    release(shared)
    if rest.isEmpty():
        release(rest)
        return found, links
    opened, work = rest, rest.agg(F.sum(F.lit(ROW_WORK) + F.col("m") / 2)).first()[0]
    tasks = int(min(max(1, work // TASK_WORK), MOST_TASKS))
    cell = ["band", "key", "low", "high"]
    rest = rest.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("next", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.withColumns({"low": F.least("block", "next"), "high": F.greatest("block", "next")})
    if whole_blocks:
        sets = sets_of(staged(rest.select("id").distinct(), "wanted"))
        rest = rest.join(sets, "id").select(*cell, "block", "id", "label", "shingles").repartition(tasks, *cell)
        more = staged(rest.groupBy(*cell).applyInArrow(_connected(percent), "a long, b long"), "linked")
        links, found = grown(links, more, found)
        release(opened)
        return found, links
    keys = F.transform("bands", lambda k: F.coalesce(k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"), F.lit(0)))
    rest = rest.join(items.select("id", "n", "sketch", keys.alias("keys")), "id").select(*cell, "block", "id", "label", "n", "keys", "sketch")
    pairs = rest.repartition(tasks, *cell).groupBy(*cell).applyInArrow(_compared(kind), "a long, b long")
    links, found = grown(links, verify(staged(pairs, "pairs")), found)
    release(opened)
    return found, links
