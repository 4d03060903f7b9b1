"""Connected components of an edge table: blocks of edges in tasks, then repeated joins and minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches
from .storage import release, staged

#: Edges that one task contracts at once (a few MB).
BLOCK_EDGES = 1 << 18


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, root) of every id on the edges (a, b), root the smallest id that they connect it with."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[x], root[y])
        before = root.copy()
        for end in (x, y, root[x], root[y]):
            np.minimum.at(root, end, least)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return ids, ids[root]


def _contract(whole: bool):
    """Edges (hi, lo) as stars of their blocks; ``whole``: as (id, root) of one block that is all edges of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def block() -> pa.RecordBatch:
            ids, root = contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            kept = slice(None) if whole else ids != root
            return pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array(root[kept])], names=["id", "root"] if whole else ["hi", "lo"])

        for batch in batches:
            held.append((batch.column("hi").to_numpy(), batch.column("lo").to_numpy()))
            n += batch.num_rows
            if not whole and n >= BLOCK_EDGES:
                yield block()
                held, n = [], 0
        if held:
            yield block()

    return run


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for every id on an edge of ``edges`` (a, b), staged; root is the smallest id reachable.

    Each block of up to BLOCK_EDGES edges is contracted to stars by a task. One block is the result. Of more
    blocks the stars are joined by two star contractions in turn: every node hands its larger neighbours to
    its smallest neighbour, then its smaller neighbours too. Each round at least halves long chains; a node
    with very many neighbours costs one minimum (combined before the shuffle) and one join that Spark may
    split. Each round's edges are a table in the shared folder that the next one replaces, so no lineage
    grows and nothing is collected. Loops are ignored. An id without edges has no row. No edges: no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = staged(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")), "edges")
    if now.count() <= BLOCK_EDGES:
        out = staged(map_batches(now.coalesce(1), _contract(True), "id long, root long"), "components")
        release(now)
        return out
    old, now = now, staged(map_batches(now, _contract(False), "hi long, lo long").distinct(), "stars")
    release(old)
    before = _signature(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = staged(large, "large-star")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        old, now = now, staged(small.union(low.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        release(old, large)
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("id"), "root")
    out = staged(roots.union(roots.select(F.col("root").alias("id"), "root").distinct()), "components")
    release(now)
    return out
