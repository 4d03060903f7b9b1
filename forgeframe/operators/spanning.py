"""Minimum spanning trees of point clouds of any size: the lengths at which their parts merge (persistence in dimension 0).

Blocks of a cloud's points meet in pairs; each task keeps the spanning tree of its two blocks and nothing else, as an edge
that isn't in the tree of some of the points can't be in the tree of all. A cloud of one block is done then. Of larger ones the edges
left, as many for each block as it has points, go to one task if they are few; else through rounds in which every part takes its shortest
edge to another, until they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import checkpointed

#: Points of a block, and edges of a cloud that one task takes.
BLOCK, EDGES = 2048, 1 << 18


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, length) with u < v of the tree of rows; of edges of one length that with the smaller ends counts as shorter."""
    n = len(points)
    near, low, high = np.full(n, np.inf), np.full(n, n), np.full(n, n)
    left, now, out = np.ones(n, bool), 0, []
    for _ in range(n - 1):
        left[now] = False
        rest = np.flatnonzero(left)
        away = np.sqrt(((points[rest] - points[now]) ** 2).sum(1))
        a, b = np.minimum(rest, now), np.maximum(rest, now)
        closer = (away < near[rest]) | ((away == near[rest]) & ((a < low[rest]) | ((a == low[rest]) & (b < high[rest]))))
        at = rest[closer]
        near[at], low[at], high[at] = away[closer], a[closer], b[closer]
        least = rest[near[rest] == near[rest].min()]
        now = int(least[np.lexsort((high[least], low[least]))[0]])
        out.append((low[now], high[now], near[now]))
    u, v, length = zip(*out, strict=True) if out else ((), (), ())
    return np.array(u, np.int64), np.array(v, np.int64), np.array(length, float)


def _trees(cell: pa.Table) -> pa.Table:
    cell = cell.sort_by("id")
    ids = cell.column("id")
    points = cell.column("point").combine_chunks()
    u, v, length = spanning_tree(points.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
    return pa.table({"cloud": pa.array(np.full(len(u), cell.column("cloud")[0].as_py())) if len(u) else pa.array([], pa.int64()), "u": ids.take(pa.array(u)), "v": ids.take(pa.array(v)), "length": length})


def _left_tree(cell: pa.Table) -> pa.Table:
    """The tree's edges among those between a cloud's parts."""
    cell = cell.sort_by([("length", "ascending"), ("u", "ascending"), ("v", "ascending")])
    n = cell.num_rows
    parts = np.unique(np.concatenate([cell.column(c).to_numpy() for c in ("from", "to")]), return_inverse=True)[1].reshape(-1)
    above, kept = list(range(2 * n)), []

    def root(a: int) -> int:
        while above[a] != a:
            above[a] = a = above[above[a]]
        return a

    for k, (a, b) in enumerate(zip(parts[:n].tolist(), parts[n:].tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            above[max(a, b)] = min(a, b)
            kept.append(k)
    return cell.select(["cloud", "u", "v", "length"]).take(pa.array(kept, pa.int64()))


def _merged(edges: DataFrame, most: int) -> DataFrame:
    """The spanning forests' edges (cloud, u, v, length) of a table of edges, by rounds of shortest edges.

    Edges are in one order (length, then ends), so no round closes a circle. Parts hook to the part that their edge leads to; of two that chose
    each other the smaller stays. Each round at least halves the parts of a cloud. A cloud of ``most`` edges goes to one task, so rounds have only those few clouds
    that are larger; their joins are shuffled, as tables sent whole would pile up on the driver over the rounds.
    """
    left, out = edges.select("cloud", "u", "v", "length", F.col("u").alias("from"), F.col("v").alias("to")), None
    while True:
        left = checkpointed(left)
        large = [r["cloud"] for r in left.groupBy("cloud").agg(F.count("*").alias("n")).where(F.col("n") > most).select("cloud").collect()]
        small = left.where(~F.col("cloud").isin(large)).groupBy("cloud").applyInArrow(_left_tree, "cloud long, u long, v long, length double")
        out = checkpointed(small if out is None else out.union(small))
        if not large:
            return out
        left = left.where(F.col("cloud").isin(large))
        both = left.union(left.select("cloud", "u", "v", "length", "to", "from"))
        pick = checkpointed(both.groupBy("cloud", "from").agg(F.min(F.struct("length", "u", "v", "to")).alias("e")).select("cloud", "from", "e.*"))
        out = out.union(pick.select("cloud", "u", "v", "length").distinct())
        back = pick.select("cloud", F.col("from").alias("to"), F.col("to").alias("back"))
        roots = pick.hint("merge").join(back, ["cloud", "to"]).select("cloud", "from", F.when((F.col("back") == F.col("from")) & (F.col("from") < F.col("to")), F.col("from")).otherwise(F.col("to")).alias("root"))
        roots = checkpointed(roots)
        while True:
            above = roots.select("cloud", F.col("from").alias("root"), F.col("root").alias("further"))
            nearer = checkpointed(roots.hint("merge").join(above, ["cloud", "root"]).select("cloud", "from", "root", "further"))
            done = nearer.where("root <> further").isEmpty()
            roots = nearer.select("cloud", "from", F.col("further").alias("root"))
            if done:
                break
        ends = {side: roots.select("cloud", F.col("from").alias(side), F.col("root").alias(f"{side} root")) for side in ("from", "to")}
        left = left.hint("merge").join(ends["from"], ["cloud", "from"]).hint("merge").join(ends["to"], ["cloud", "to"]).where("`from root` <> `to root`")
        left = left.select("cloud", "u", "v", "length", F.col("from root").alias("from"), F.col("to root").alias("to"))


def merge_lifetimes(points: DataFrame, key: str, x: list[str], block: int = BLOCK, most: int = EDGES) -> DataFrame:
    """(key, lifetime, n): the edge lengths of each point cloud's minimum spanning tree, and how many have that length (F11, dimension 0).

    Equal points are one point whose copies merge at 0. Rows of null key, or with a missing or infinite coordinate, are left out;
    a cloud of one point has no rows. Points of one cloud are compared with each other, in blocks of ``block``: the products of their numbers remain.
    """
    fine = points.where(F.col(key).isNotNull())
    for c in x:
        fine = fine.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")))
    point = F.array(*(F.col(c).cast("double") + 0.0 for c in x))
    distinct = fine.select(F.col(key).alias("key"), point.alias("point")).groupBy("key", "point").agg(F.count("*").alias("copies"))
    distinct = checkpointed(distinct.withColumns({"cloud": F.xxhash64("key"), "id": F.monotonically_increasing_id()}))
    clouds = distinct.groupBy("key", "cloud").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = distinct.join(clouds, ["key", "cloud"]).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 or own <> other")
    met = met.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    edges = met.select("cloud", "low", "high", "blocks", "id", "point").groupBy("cloud", "low", "high").applyInArrow(_trees, "cloud long, u long, v long, length double")
    edges = checkpointed(edges.join(clouds, "cloud").select("key", "cloud", "u", "v", "length", (F.col("blocks") > 1).alias("more")))
    names = clouds.select("key", "cloud")
    large = _merged(edges.where("more").select("cloud", "u", "v", "length").distinct(), most).join(names, "cloud")
    zeros = distinct.where("copies > 1").groupBy("key").agg(F.sum(F.col("copies") - 1).alias("n")).select("key", F.lit(0.0).alias("lifetime"), "n")
    lengths = edges.where("not more").select("key", F.col("length").alias("lifetime")).union(large.select("key", "length"))
    counted = lengths.groupBy("key", "lifetime").agg(F.count("*").alias("n")).union(zeros)
    return counted.groupBy("key", "lifetime").agg(F.sum("n").alias("n")).select(F.col("key").alias(key), "lifetime", "n")


def merge_statistics(points: DataFrame, key: str, x: list[str], block: int = BLOCK, most: int = EDGES) -> DataFrame:
    """(key, count, max, mean, sum, std, entropy) of each cloud's lifetimes; a cloud of one point counts as one lifetime of 0."""
    found = points.where(F.col(key).isNotNull()).select(key).distinct().join(merge_lifetimes(points, key, x, block, most), key, "left")
    found = found.select(key, F.coalesce("lifetime", F.lit(0.0)).alias("l"), F.coalesce("n", F.lit(1)).alias("n"))
    total = found.groupBy(key).agg(F.sum(F.col("l") * F.col("n")).alias("sum"), F.sum("n").cast("double").alias("count"))
    both = found.join(total, key).withColumn("mean", F.col("sum") / F.col("count")).withColumn("share", F.try_divide("l", "sum"))
    square = F.sum(F.col("n") * (F.col("l") - F.col("mean")) * (F.col("l") - F.col("mean")))
    entropy = -F.sum(F.col("n") * F.col("share") * F.log(F.col("share") + 1e-10))
    out = both.groupBy(key, "sum", "count", "mean").agg(F.max("l").alias("max"), F.sqrt(square / F.col("count")).alias("std"), F.coalesce(entropy, F.lit(0.0)).alias("entropy"))
    return out.select(key, "count", "max", "mean", "sum", "std", "entropy")
