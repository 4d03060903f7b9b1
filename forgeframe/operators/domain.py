"""Applicability domain: similarity of fingerprints, hull of principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import checkpointed
from .blocks import block_pairs
from .select import component_fit

#: Queries that are compared with a block of rows at once; bits that one pass holds.
AT_ONCE, PASS = 64, 1 << 24
#: Tasks whose corners one task merges.
MERGED = 16


def packed_bits(values: Column) -> Column:
    """Which components are above 0, as 64-bit words (array<long>)."""
    padded = F.transform(values, lambda v: F.when(v > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    n = F.floor((F.size(values) + 63) / 64)

    def word(k: Column) -> Column:
        part = F.slice(padded, (k * 64 + 1).cast("int"), F.lit(64))
        bits = F.transform(part, lambda b, i: F.call_function("shiftleft", b, i))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word)


def _best_of_block(key: str, k: int):
    """The ``k`` most similar rows of a block for each query.

    Rows go by their number of bits: no similarity exceeds the smaller number over the larger, so rows on either side of a query's
    number come in turn, widening, until none further can reach its k-th best.
    """

    def bits(words: pa.ChunkedArray) -> np.ndarray:
        lists = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        width = len(flat) // max(1, len(lists))
        return np.unpackbits(flat.reshape(len(lists), width).view(np.uint8), axis=1).astype(np.float32)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            a, b = bits(left.column("words")), bits(right.column("words"))
            n_a, n_b = a.sum(1), b.sum(1)
            rank = np.empty(right.num_rows, np.int64)  # ties go by key
            rank[np.argsort(right.column(key).to_numpy(zero_copy_only=False), kind="stable")] = np.arange(right.num_rows)
            order, by_count = np.argsort(n_b, kind="stable"), np.sort(n_b)
            for at in range(0, len(a), AT_ONCE):
                rows = np.arange(at, min(at + AT_ONCE, len(a)))
                rows = rows[np.argsort(n_a[rows], kind="stable")]
                low = int(np.searchsorted(by_count, n_a[rows[0]]))
                high = int(np.searchsorted(by_count, n_a[rows[-1]], "right"))
                step = max(4 * k, min(PASS // (AT_ONCE * max(1, a.shape[1])), len(b)))
                low, high = max(0, low - step), min(len(b), high + step)
                seen, similar = order[low:high], None
                similar = _tanimoto(a[rows], b[seen], n_a[rows], n_b[seen])
                while low > 0 or high < len(b):
                    kth = np.partition(similar, -k, axis=1)[:, -k] if similar.shape[1] >= k else np.full(len(rows), -1.0)
                    reach = [by_count[low - 1] / np.maximum(n_a[rows], 1) if low > 0 else None, n_a[rows] / np.maximum(by_count[high], 1) if high < len(b) else None]
                    more = [x is not None and bool((np.minimum(x, 1.0) >= kth).any()) for x in reach]
                    if not any(more):
                        break
                    begin, stop = (max(0, low - step) if more[0] else low), (min(len(b), high + step) if more[1] else high)
                    fresh = np.r_[order[begin:low], order[high:stop]]
                    similar = np.c_[similar, _tanimoto(a[rows], b[fresh], n_a[rows], n_b[fresh])]
                    seen, low, high = np.r_[seen, fresh], begin, stop
                best = np.lexsort((np.broadcast_to(rank[seen], similar.shape), -similar), axis=1)[:, :k]
                found.append((np.repeat(rows, best.shape[1]), seen[best].ravel(), np.take_along_axis(similar, best, axis=1).ravel()))
        who, row, value = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({key: left.column(key).take(pa.array(who)), f"train_{key}": right.column(key).take(pa.array(row)), "similarity": value})

    return run


def _tanimoto(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    shared = (a @ b.T).astype(np.float64)
    either = n_a[:, None].astype(np.float64) + n_b - shared
    return np.where(either > 0, shared / np.maximum(either, 1), 0.0)


def most_similar(queries: DataFrame, train: DataFrame, key: str, values: str, k: int = 5, packed: bool = False) -> DataFrame:
    """The ``k`` most similar training rows of each query, ties by key.

    Of rows with equal bits the ``k`` first by key can be among a query's, and queries with equal bits get the same rows, so copies aren't compared. Blocks of
    queries meet blocks of rows, packed into words (``packed``: they come so), and only the best of each block are shuffled on; within a block, rows whose
    numbers of bits rule them out aren't compared. Keys are unique; rows of null key or values aren't compared; all fingerprints have one width.
    """
    kind = queries.schema[key].dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError("keys must be plain values")
    words = F.col(values) if packed else packed_bits(F.col(values))
    q, t = (d.select(key, F.explode(F.array(words)).alias("words")).where(f"`{key}` is not null and words is not null") for d in (queries, train))
    q = checkpointed(q)
    first = F.row_number().over(Window.partitionBy("words").orderBy(key))
    t = checkpointed(t.withColumn("first\x00", first).where(F.col("first\x00") <= k).drop("first\x00"))
    unlike = q.groupBy("words").agg(F.min(key).alias(key))
    found = block_pairs(unlike.select(key, "words"), t, [key], [key], _best_of_block(key, k), f"`{key}` {kind.simpleString()}, `train_{key}` {train.schema[key].dataType.simpleString()}, similarity double", rows=(unlike.count(), t.count()))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("similarity").desc(), f"train_{key}"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed(key, "like\x00")
    of = q.join(unlike.withColumnRenamed(key, "like\x00").hint("merge"), "words").select(key, "like\x00")
    return of.join(best.hint("merge"), "like\x00").select(key, f"train_{key}", "similarity", "rank")


def in_domain(queries: DataFrame, train: DataFrame, key: str, values: str, threshold: float = 0.25) -> DataFrame:
    """Largest similarity of each query, and whether it reaches ``threshold``."""
    best = most_similar(queries, train, key, values, 1).select(key, F.col("similarity").alias("sim_max"))
    return best.withColumn("in_domain", F.col("sim_max") >= threshold)


def _corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The corners of a task's points; those of each batch are merged with those before."""
    held = np.zeros((0, 2))
    for batch in batches:
        both = np.unique(np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)]), axis=0)
        held = np.array(monotone_chain([tuple(p) for p in both.tolist()])).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], names=["x", "y"])


def hull(points: DataFrame, x: str, y: str) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise (D01); points with a missing or infinite coordinate are left out.

    A hull of hulls: each task keeps the corners of its points, then fewer tasks those of MERGED others, until one is left, so the driver
    gets the answer alone. Points on a line have no hull: no corners.
    """
    points = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    left = points.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    tasks = left.rdd.getNumPartitions()
    left = left.mapInArrow(_corners, "x double, y double")
    while tasks > 1:
        tasks = -(-tasks // MERGED)
        left = left.repartition(tasks).mapInArrow(_corners, "x double, y double")
    corners = monotone_chain(sorted({(r["x"], r["y"]) for r in left.collect()}))
    return corners if len(corners) >= 3 else []


def component_domain(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with PC1, PC2 and in_domain: whether they lie in the hull of the training rows in the plane of their first two components.

    Components, and what fills missing values, are those of the training rows. Without a hull (fewer than three rows, or all on a line) all are inside.
    """
    fit = component_fit(train, columns)
    corners = hull(fit.rows(train.select(*columns), 2), "PC1", "PC2")
    keys = [c for c in rows.columns if c not in columns]
    return fit.rows(rows, 2).withColumn("in_domain", inside(F.col("PC1"), F.col("PC2"), corners)).select(*keys, "PC1", "PC2", "in_domain")


def monotone_chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    if len(points) < 3:
        return points

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def inside(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a convex polygon or on its rim. No polygon: everything is inside."""
    if len(corners) < 3:
        return F.lit(True)
    sides = [(*a, b[0] - a[0], b[1] - a[1]) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    table = F.array(*(F.array(*(F.lit(float(v)) for v in side)) for side in sides))
    return F.forall(table, lambda s: (s[2] * (y - s[1]) - s[3] * (x - s[0])) >= -1e-12)
