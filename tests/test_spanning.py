"""Merge lengths of point clouds against a plain program that sorts all edges."""

import itertools
import math

import numpy as np
import pytest

from forgeframe.operators import spanning


def plain(points):
    parent, out = list(range(len(points))), []

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for d, i, j in sorted((math.dist(p, q), i, j) for (i, p), (j, q) in itertools.combinations(enumerate(points), 2)):
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            out.append(d)
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 12, 3])
def test_merge_lifetimes(spark, block):
    rng = np.random.default_rng(block)
    clouds = {"random": rng.normal(size=(50, 3)), "grid": np.array(list(itertools.product(range(4), range(4), range(2))), float), "one": np.zeros((1, 3)), "same": np.ones((7, 3)), "line": np.array([[i * i, 0, -0.0] for i in range(30)], float)}
    rows = [(name, *map(float, p)) for name, points in clouds.items() for p in points]
    bad = [(None, 0.0, 0.0, 0.0), ("random", None, 0.0, 0.0), ("random", float("nan"), 0.0, 0.0), ("one", float("inf"), 0.0, 0.0)]
    df = spark.createDataFrame(rows + bad, "cloud string, x double, y double, z double").repartition(3).selectExpr("cloud", "x", "y", "z", "'mine' AS id", "'mine' AS key")
    got = {}
    for r in spanning.merge_lifetimes(df.drop("key"), "cloud", ["x", "y", "z"], block).collect():
        got[r.cloud] = sorted([*got.get(r.cloud, []), *[r.lifetime] * r.n])
    for name, points in clouds.items():
        assert got.get(name, []) == pytest.approx(plain(points.tolist()), abs=1e-12), name
    stats = {r.cloud: r for r in spanning.merge_statistics(df, "cloud", ["x", "y", "z"], block).collect()}
    assert stats.keys() == clouds.keys() and stats["one"]["count"] == 1 and stats["one"]["sum"] == stats["same"]["entropy"] == 0
    want = np.array(plain(clouds["random"].tolist()))
    share = want / want.sum()
    assert [stats["random"][c] for c in ("count", "max", "mean", "sum", "std", "entropy")] == pytest.approx([49, want.max(), want.mean(), want.sum(), want.std(), -(share * np.log(share + 1e-10)).sum()])
    assert spanning.merge_lifetimes(df.limit(0), "cloud", ["x"]).collect() == []


@pytest.mark.parametrize("most", [0, 40, 1 << 18])
def test_edges_of_many_blocks(spark, most):
    """A cloud's edges go to one task only if they are few; rounds and task give one tree, and send no table whole."""
    rng = np.random.default_rng(5)
    clouds = {"random": rng.normal(size=(60, 3)), "grid": np.array(list(itertools.product(range(4), range(4), range(2))), float), "small": rng.normal(size=(7, 3))}
    df = spark.createDataFrame([(name, *map(float, p)) for name, points in clouds.items() for p in points], "cloud string, x double, y double, z double").repartition(3)
    sent = []

    def joined(left, right, *rest, **named):
        out = plain_join(left, right, *rest, **named)
        sent.append("BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString())
        return out

    got, plain_join = {}, type(df).join
    with pytest.MonkeyPatch.context() as m:
        edges = spark.createDataFrame([(1, i, j, math.dist(p, q)) for (i, p), (j, q) in itertools.combinations(enumerate(clouds["random"]), 2)], "cloud long, u long, v long, length double")
        m.setattr(type(df), "join", joined)
        assert sorted(r.length for r in spanning._merged(edges, most).collect()) == pytest.approx(plain(clouds["random"].tolist()))
    assert not any(sent) and bool(sent) == (most < len(clouds["random"]) * 59 // 2)
    for r in spanning.merge_lifetimes(df, "cloud", ["x", "y", "z"], 5, most).collect():
        got[r.cloud] = sorted([*got.get(r.cloud, []), *[r.lifetime] * r.n])
    for name, points in clouds.items():
        assert got[name] == pytest.approx(plain(points.tolist()), abs=1e-12), name
