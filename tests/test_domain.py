"""Similar rows against all pairs."""

import numpy as np
import pytest

from forgeframe.operators import blocks, domain, select


def plain(queries, train, k):
    out = []
    for q, a in queries:
        if q is None or a is None:
            continue
        found = []
        for t, b in train:
            if t is not None and b is not None:
                x, y = {i for i, v in enumerate(a) if v > 0}, {i for i, v in enumerate(b) if v > 0}
                found.append((len(x & y) / len(x | y) if x | y else 0.0, t))
        found.sort(key=lambda f: (-f[0], f[1]))
        out += [(q, t, s, n) for n, (s, t) in enumerate(found[:k], 1)]
    return out


@pytest.mark.parametrize("size", [4096, 20])
def test_most_similar(spark, monkeypatch, size):
    monkeypatch.setattr(blocks.block_pairs, "__defaults__", (size, (None, None)))
    monkeypatch.setattr(domain, "PASS", 1 << 24 if size > 20 else 1)
    monkeypatch.setattr(domain, "AT_ONCE", 64 if size > 20 else 3)
    rng = np.random.default_rng(size)
    rows = [(k, [int(v) for v in rng.random(100) < rng.random() ** 2]) for k in range(150)]
    rows += [(200 + k, rows[k][1]) for k in range(20)] + [(300, [0] * 100), (301, [1] * 100), (302, None), (None, [1] * 100)]
    df = spark.createDataFrame(rows, "k int, v array<int>").selectExpr("*", "'mine' AS words", "'mine' AS similarity")
    queries, train = df.where("k % 5 = 0 or k is null"), df.where("k % 5 <> 0 or k is null")
    given = [(q, v) for q, v in rows if q is None or q % 5 == 0], [(t, v) for t, v in rows if t is None or t % 5]
    for k in (1, 4, 500):
        got = [(r.k, r.train_k, r.similarity, r["rank"]) for r in domain.most_similar(queries, train, "k", "v", k).collect()]
        assert sorted(got) == sorted(plain(*given, k))
    best = {r.k: (r.sim_max, r.in_domain) for r in domain.in_domain(queries, train, "k", "v", 0.5).collect()}
    assert best == {q: (s, s >= 0.5) for q, _, s, _ in plain(*given, 1)}
    assert domain.most_similar(queries.limit(0), train, "k", "v").collect() == [] and domain.most_similar(queries, train.limit(0), "k", "v").collect() == []


def test_no_cross_join(spark, capsys):
    df = spark.createDataFrame([(1, [1, 0]), (2, [1, 1])], "k int, v array<int>")
    domain.in_domain(df, df, "k", "v").explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def plain_hull(points):
    """Corners by trying every pair of points: one is an edge if all others lie on its left."""
    points = sorted(set(points))
    turn = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    out = set()
    for a in points:
        for b in points:
            if a != b and all(turn(a, b, p) > 0 or (turn(a, b, p) == 0 and min(a, b) <= p <= max(a, b)) for p in points):
                out |= {a, b}
    return out


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_hull_of_hulls(spark, tasks):
    rng = np.random.default_rng(tasks)
    points = [(float(a), float(b)) for a, b in rng.integers(-9, 10, (80, 2))]
    df = spark.createDataFrame([*points, *points[:9], (None, 1.0), (float("nan"), 99.0), (float("inf"), 0.0)], "x double, y double").repartition(tasks)
    corners = domain.hull(df, "x", "y")
    assert set(corners) == plain_hull(points) and len(corners) == len(set(corners))
    assert domain.hull(df.where("x = 1"), "x", "y") == [] and domain.hull(df.limit(0), "x", "y") == []


@pytest.mark.parametrize("few", [16, 2])
def test_component_domain(spark, monkeypatch, few):
    monkeypatch.setattr(select, "FEW_COLUMNS", few)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 5
    new = np.concatenate([x[:20] * 0.9, x[20:40] + 9])
    frame = lambda a: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], ["id", "a", "b", "c", "d"])
    got = {r.id: r for r in domain.component_domain(frame(x), frame(new), ["a", "b", "c", "d"]).collect()}
    z, w = (x - x.mean(0)) / x.std(0), (new - x.mean(0)) / x.std(0)
    _, _, axes = np.linalg.svd(z - z.mean(0), full_matrices=False)
    plane, asked = z @ axes[:2].T, w @ axes[:2].T
    corners = sorted(plain_hull([tuple(p) for p in plane.tolist()]), key=lambda p: np.arctan2(p[1], p[0]))
    for i, p in enumerate(asked):
        want = all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for a, b in zip(corners, corners[1:] + corners[:1], strict=True))
        assert got[i].in_domain == want and abs(got[i].PC1) == pytest.approx(abs(p[0])) and abs(got[i].PC2) == pytest.approx(abs(p[1]))
    assert {r.in_domain for r in got.values()} == {True, False}
    assert domain.component_domain(frame(x[:2]), frame(new), ["a", "b", "c", "d"]).where("not in_domain").count() == 0
