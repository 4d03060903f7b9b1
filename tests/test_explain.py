"""Contributions to tree predictions against the enumeration of all subsets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgeframe.operators import explain, models
from forgeframe.operators.select import assembled

COLUMNS = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)).round(2)
    x[:, 5] = rng.integers(0, 3, 400)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, x[:, 2], -2) * x[:, 5] + rng.normal(size=400) * 0.1
    return assembled(spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], ["id", *COLUMNS, "y"]), COLUMNS).cache()


def expected(node, x, known):
    """A tree's mean prediction if only the ``known`` features are: the others go both ways, by the rows that did in training."""
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    left, right, split = node.leftChild(), node.rightChild(), node.split()
    if split.featureIndex() in known:
        return expected(left if x[split.featureIndex()] <= split.threshold() else right, x, known)
    a, b = left.impurityStats().count(), right.impurityStats().count()
    return (a * expected(left, x, known) + b * expected(right, x, known)) / (a + b)


def by_subsets(trees, x):
    n, out = len(x), []
    value = {s: sum(w * expected(t._java_obj.rootNode(), x, set(s)) for t, w in trees) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    for i in range(n):
        out.append(sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (value[tuple(sorted((*s, i)))] - v) for s, v in value.items() if i not in s))
    return out, value[()]


@pytest.mark.parametrize(("name", "params"), [("decision_tree", {"maxDepth": 5}), ("random_forest", {"numTrees": 4, "maxDepth": 4}), ("gbdt", {"maxIter": 4, "maxDepth": 3}), ("decision_tree", {"maxDepth": 0})])
def test_tree_contributions(spark, data, name, params):
    model = models.make(name, data, "y", **params).fit(data)
    trees = [(t, w / (len(model.trees) if name == "random_forest" else 1)) for t, w in zip(model.trees, model.treeWeights, strict=True)] if hasattr(model, "trees") else [(model, 1.0)]
    rows = explain.tree_contributions(data, model, COLUMNS, ["id", "prediction"], "prediction").collect()
    assert len(rows) == 400 and all(abs(sum(r[c] for c in COLUMNS) + r.base - r.prediction) < 1e-9 for r in rows)
    given = {r.id: [r[c] for c in COLUMNS] for r in data.where("id < 5").collect()}
    for r in rows:
        if r.id in given:
            want, base = by_subsets(trees, given[r.id])
            assert [r[c] for c in COLUMNS] == pytest.approx(want, abs=1e-9) and r.base == pytest.approx(base)


def test_path_table(spark, data):
    model = models.make("random_forest", data, "y", numTrees=3, maxDepth=3).fit(data)
    table = explain.path_table(spark, model, COLUMNS)
    leaves = table.groupBy("tree", "leaf").agg(F.product("share").alias("share"), F.first("value").alias("value"))
    assert all(abs(r.share - 1) < 1e-9 for r in leaves.groupBy("tree").agg(F.sum("share").alias("share")).collect())
    assert table.where("not (low < high) or share <= 0 or share > 1").count() == 0


def test_missing_values_go_as_in_the_trees(spark, data):
    model = models.make("decision_tree", data, "y", maxDepth=4).fit(data)
    holes = assembled(spark.createDataFrame([(1, *[float("nan")] * 6), (2, 0.0, float("nan"), 1.0, 0.5, 0.1, 2.0)], ["id", *COLUMNS]), COLUMNS)
    for r in explain.tree_contributions(holes, model, COLUMNS, ["id", "prediction"], "prediction").collect():
        assert sum(r[c] for c in COLUMNS) + r.base == pytest.approx(r.prediction)
    assert explain.tree_contributions(holes.limit(0), model, COLUMNS, ["id"]).collect() == []


def test_rows_of_one_cell_are_worked_out_once():
    rng = np.random.default_rng(4)
    paths = [explain.Path(k % 2, float(v), {0: (low, low + 1.0, 0.4), 2: (-np.inf, high, 0.7)}) for k, (v, low, high) in enumerate(rng.normal(size=(12, 3)).round(1))]
    x = rng.normal(size=(5000, 3)).round(1)
    x[::50, 0], x[1::50, 2], x[2::50, 0] = np.nan, np.inf, -np.inf
    first, cell = explain.cells(x, paths)
    assert len(first) < 1000
    assert np.allclose(explain.path_contributions(x[first], paths)[cell], explain.path_contributions(x, paths), rtol=0, atol=1e-12)
    assert np.allclose(explain.batch_contributions(x, paths), explain.path_contributions(x, paths), rtol=0, atol=1e-12)
