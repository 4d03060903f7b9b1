"""Nearest vectors by inner product: a vantage-point tree for each shard, searched by blocks of queries.

The largest inner products are the smallest Euclidean distances once each vector x has one more
component sqrt(M**2 - |x|**2), M the largest norm, and each query a 0 there: then
distance**2 = |q|**2 + M**2 - 2 q.x. That distance obeys the triangle inequality, so a subtree whose
distances to its vantage point all lie in [low, high] can hold nothing nearer to the query than
max(low - d, d - high), d being the query's own distance to the vantage point.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import staged

NEAREST = 20
#: A factor that gives up little: recall of 0.9 or more wherever it was measured (README).
RELAXED = 1.05
#: Vectors of one shard (one tree, one task at a time), queries of one block, vectors of one leaf.
SHARD, BLOCK, LEAF = 4096, 8192, 128
#: Products that one pass of exact scoring holds.
PASS = 1 << 17


@dataclass
class Node:
    start: int
    end: int
    vantage: int = -1
    radius: float = 0.0
    inner: Node | None = None
    outer: Node | None = None
    inner_range: tuple[float, float] = (0.0, 0.0)
    outer_range: tuple[float, float] = (0.0, 0.0)


class Tree:
    """A vantage-point tree over rows of ``points``; ``order`` lists rows so that a node is a slice of it."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.root = Node(0, len(points))
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.end - node.start <= LEAF:
                continue
            rows = self.order[node.start : node.end]
            around = points[rows]
            # The vantage point is the row furthest from the first one: near the rim it divides best.
            node.vantage = int(rows[np.linalg.norm(around - around[0], axis=1).argmax()])
            away = np.linalg.norm(around - points[node.vantage], axis=1)
            node.radius = float(np.median(away))
            inside = away <= node.radius
            if inside.all():
                inside = away < node.radius
            if not inside.any() or inside.all():
                node.vantage = -1  # all as far: a leaf
                continue
            self.order[node.start : node.end] = np.r_[rows[inside], rows[~inside]]
            middle = node.start + int(inside.sum())
            node.inner, node.outer = Node(node.start, middle), Node(middle, node.end)
            node.inner_range = (float(away[inside].min()), float(away[inside].max()))
            node.outer_range = (float(away[~inside].min()), float(away[~inside].max()))
            todo += [node.inner, node.outer]


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in order of the components, in double precision."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


def search(tree: Tree, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, bound: float, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(query row, point row) pairs that hold each query's ``k`` nearest of the tree, and a few more.

    ``bound`` is M. Distances carry rounding errors, so pairs within a small slack of the k-th are kept.
    A subtree goes if its least distance times ``factor`` exceeds the k-th found so far: 1 loses nothing,
    more gives up some of the nearest for speed.
    """
    points = tree.points
    squares = (queries**2).sum(1)
    slack = 1e-9 * (1 + squares + bound**2)
    best = np.full((len(queries), k), np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def squared(active: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.maximum(squares[active, None] + bound**2 - 2 * queries[active] @ points[rows, :-1].T, 0)

    def visit(node: Node, active: np.ndarray) -> None:
        if not len(active):
            return
        if node.vantage < 0:
            rows = tree.order[node.start : node.end]
            away = squared(active, rows)
            away[ids[rows][None, :] == query_ids[active][:, None]] = np.inf
            near = away <= (best[active].max(1) + slack[active])[:, None]
            q, p = np.nonzero(near & np.isfinite(away))
            found.append((active[q], rows[p], away[q, p]))
            both = np.c_[best[active], away]
            best[active] = np.partition(both, k - 1, axis=1)[:, :k]
            return
        d = np.sqrt(squared(active, np.array([node.vantage]))[:, 0])
        first_inner = d <= node.radius
        sides = ((node.inner, node.inner_range), (node.outer, node.outer_range))
        for group, order in ((first_inner, (0, 1)), (~first_inner, (1, 0))):
            who, dist = active[group], d[group]
            for side in order:
                child, (low, high) = sides[side]
                least = np.maximum(np.maximum(low - dist, dist - high), 0) * factor
                may = least**2 <= best[who].max(1) + slack[who]
                visit(child, who[may])

    visit(tree.root, np.arange(len(queries)))
    q, p, away = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    near = away <= best[q].max(1) + slack[q]
    return q[near], p[near]


def _shard_results(k: int, factor: float, bound: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        x, q = (np.stack(side["vector"].to_numpy()).astype(np.float64) for side in (left, right))
        ids, query_ids = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        rim = np.sqrt(np.maximum(bound**2 - (x**2).sum(1), 0))
        who, row = search(Tree(np.c_[x, rim]), q, query_ids, ids, bound, k, factor)
        score = np.empty(len(who))
        for at in range(0, len(who), PASS):
            score[at : at + PASS] = exact_scores(q[who[at : at + PASS]], x[row[at : at + PASS]])
        order = np.lexsort((ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        start = np.searchsorted(who, who)
        kept = np.arange(len(who)) - start < k
        return pd.DataFrame({"query_id": query_ids[who[kept]], "vec_id": ids[row[kept]], "score": score[kept]})

    return run


def nearest(vectors: DataFrame, is_query: str, k: int = NEAREST, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors of largest inner product for each query.

    ``vectors``: (vec_id, embedding array<float>); rows for which the SQL condition ``is_query`` holds are
    the queries, all rows are indexed, and a query's own vec_id is no candidate of it. Ties go to the
    smaller vec_id; ranks start at 1; fewer candidates than ``k`` give fewer rows. ``score`` adds the
    products in component order, in double precision. ``factor`` 1 is exact; larger prunes more.

    Vectors that are null, empty, all zero, or hold a null or non-finite component take no part, nor do
    rows of null vec_id. Vectors of different lengths never meet. Rows that repeat a vec_id are separate
    candidates; as a query the smallest of their vectors counts. Empty table: no rows.

    Rows are dealt to shards of about SHARD by hash of their place, so many copies of a vector spread.
    Queries go to every shard in blocks; a task holds one shard and one block.
    """
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda c: c != 0)
    kept = vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.expr(is_query).alias("query"), F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("nth"))
    kept = staged(kept, "vectors")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c))
    facts = kept.agg(F.count("*").alias("n"), F.count_if("query").alias("queries"), F.max(norm).alias("norm")).first()
    shards, blocks = max(1, -(-facts["n"] // SHARD)), max(1, -(-facts["queries"] // BLOCK))
    bound = (facts["norm"] or 0.0) * (1 + 1e-12)
    index = kept.select("vec_id", "vector", "dim", F.pmod(F.xxhash64("nth"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = kept.where("query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("dim", "vector")).alias("q")).select("query_id", "q.vector", "q.dim")
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    key = ["dim", "shard", "block"]
    found = index.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(_shard_results(k, factor, bound), "query_id long, vec_id long, score double")
    rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
