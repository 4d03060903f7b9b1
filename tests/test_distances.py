"""Sums of distances by cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgeframe.operators import blocks, cluster, distances

RNG = np.random.default_rng(5)
SHAPES = {
    "lines": np.c_[RNG.random(6000), RNG.integers(0, 25, 6000) / 24],
    "far point": np.r_[RNG.random((5999, 2)) * 1e-6, [[1.0, 1.0]]],
    "heavy tails": RNG.normal(size=(6000, 2)) ** 5,
    "few values": RNG.integers(0, 9, (6000, 2)).astype(float),
    "one place": np.full((6000, 2), 0.3),
    "one number": RNG.random((6000, 1)),
    "three numbers": RNG.random((6000, 3)),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_sums_of_all_pairs(shape):
    points = SHAPES[shape]
    shares = (RNG.integers(0, 3, 6000)[:, None] == np.arange(4)) * RNG.integers(1, 5, 6000)[:, None].astype(float)
    got, want = distances.distance_sums(points[:2000], points, shares), distances.direct_sums(points[:2000], points, shares)
    assert got == pytest.approx(want, rel=1e-10, abs=1e-12)
    assert (got[:, 3] == 0).all()


def test_few_pairs_are_compared(monkeypatch):
    pairs, real = [], distances.direct_sums
    monkeypatch.setattr(distances, "direct_sums", lambda x, y, shares: pairs.append(len(x) * len(y)) or real(x, y, shares))
    seen = []
    for n in (10_000, 40_000):
        points = np.c_[RNG.random(n), RNG.integers(0, 25, n) / 24]
        distances.distance_sums(points, points, np.ones((n, 1)))
        seen.append(sum(pairs))
        pairs.clear()
    assert seen[1] < 40_000**2 / 20 and seen[1] < 8 * seen[0]


def test_silhouettes_of_many_distinct_points(spark, monkeypatch):
    """One block on the right of points of two numbers, and the same values as from small blocks."""
    points = spark.range(9000).select(F.array((F.col("id") * 37 % 9001) / 9001.0, (F.col("id") % 25) / 24.0).alias("v"), F.array((F.col("id") * 37 % 9001 > 4000).cast("int"), (F.col("id") % 3).cast("int")).alias("labels"))
    sides, real = [], cluster.block_pairs
    monkeypatch.setattr(cluster, "block_pairs", lambda *args, **named: sides.append(args[6]) or real(*args, **named))
    whole, cut = cluster.silhouettes(points, [2, 3]), cluster.silhouettes(points, [2, 3], 2500)
    assert whole == pytest.approx(cut, rel=1e-9) and whole[0] > whole[1]
    assert sides[0][1] >= 9000


def test_packed_blocks_give_the_same(spark):
    """Pairs of packed blocks are those of rows, with names, nulls and lists kept."""
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 1.5).alias("x"), F.array("id").alias("l"))

    def function(left, right):
        return left.select(["id", "x"]).append_column("n", [[right.num_rows] * left.num_rows])

    found = [sorted(map(tuple, blocks.block_pairs(rows, rows, ["id"], ["id"], function, "id long, x double, n long", size, packed=packed).groupBy("id", "x").agg(F.sum("n")).collect())) for size in (40, (40, 300)) for packed in (False, True)]
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 300 and {r[2] for r in found[0]} == {300}
