"""Validation, elimination, clusters, importances and ensembles against numpy programs."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgeframe.operators import clean, cluster, explain, models, select, splits
from forgeframe.operators.metrics import scores
from forgeframe.operators.select import assembled

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(180, 4))
    y = 4 * x[:, 0] - 2 * x[:, 1] + 0.02 * x[:, 3] + rng.normal(size=180)
    return x, y


@pytest.fixture(scope="module")
def data(spark, rows):
    x, y = rows
    return spark.createDataFrame([(i, f"g{i % 17}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], ["id", "group", *COLUMNS, "y"]).cache()


def fold_of(n, k, seed=42):
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    return {i: r % k for r, i in enumerate(order)}


def line(x, y, at):
    m, s = x.mean(0), x.std(0)
    a = np.c_[(x - m) / s, np.ones(len(x))]
    w = np.linalg.lstsq(a, y, rcond=None)[0]
    return np.c_[(at - m) / s, np.ones(len(at))] @ w, w[:-1]


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def plain_elimination(x, y, names, fold, k):
    tried = {}
    for f in range(k):
        out, left = np.array([fold[i] == f for i in range(len(y))]), list(range(len(names)))
        while left:
            p, w = line(x[~out][:, left], y[~out], x[out][:, left])
            tried.setdefault(len(left), []).append(r2(y[out], p))
            del left[min(range(len(left)), key=lambda i: (abs(w[i]), names[left[i]]))]
    means = {n: np.mean(s) for n, s in tried.items()}
    best, left, ranking = max(means, key=lambda n: (means[n], -n)), list(range(len(names))), {}
    while len(left) > best:
        _, w = line(x[:, left], y, x[:, left])
        i = min(range(len(left)), key=lambda i: (abs(w[i]), names[left[i]]))
        ranking[names[left[i]]] = len(left) - best + 1
        del left[i]
    return {**ranking, **{names[i]: 1 for i in left}}, means


def test_elimination_inside_folds(spark, data, rows):
    ranking, score = models.eliminate_validated(data, COLUMNS, "y", "id", "linear", k=4)
    want, means = plain_elimination(*rows, COLUMNS, fold_of(180, 4), 4)
    assert {r["column"]: r["ranking"] for r in ranking.collect()} == want
    assert {r.n_features: r.score for r in score.collect()} == pytest.approx(means)


@pytest.mark.parametrize("how", [{"repeats": 3}, {"group": "group"}, {"group": "group", "repeats": 2}])
def test_validation(spark, data, rows, how):
    x, y = rows
    seen, by_fold = models.cross_validate(data, COLUMNS, "y", "id", "linear", 4, **how)
    got, names = seen.collect(), data.select("id", "group").toPandas().set_index("id")["group"]
    repeats = how.get("repeats", 1)
    assert len(got) == 180 * repeats
    for repeat in range(repeats):
        own = {r.id: (r.fold, r.prediction) for r in got if repeats == 1 or r.repeat == repeat}
        if "group" in how:  # whole groups; sizes of folds differ by one group at most
            assert all(len({own[i][0] for i in own if names[i] == g}) == 1 for g in set(names))
            sizes = [sum(f == k for f, _ in own.values()) for k in range(4)]
            assert max(sizes) - min(sizes) <= max(names.value_counts())
        else:
            assert {i: f for i, (f, _) in own.items()} == fold_of(180, 4, 42 + repeat)
        for f in range(4):
            out = np.array([own[i][0] == f for i in range(180)])
            p, _ = line(x[~out], y[~out], x[out])
            assert [own[i][1] for i in np.flatnonzero(out)] == pytest.approx(p.tolist())
            score = next(r for r in by_fold.collect() if r.fold == f and (repeats == 1 or r.repeat == repeat))
            assert score.r2 == pytest.approx(r2(y[out], p))
    mean = splits.out_of_fold(seen, "id", "prediction", "y").collect()
    assert len(mean) == 180


def test_silhouettes(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.4, (40, 2)) for c in ((0, 0), (4, 0), (2, 3))] + [np.zeros((5, 2))])
    labels = np.stack([np.repeat([0, 1, 2, 0], [40, 40, 40, 5]), np.repeat([0, 0, 1, 0], [40, 40, 40, 5]), np.r_[3, rng.integers(0, 3, 124)]], axis=1)
    df = spark.createDataFrame([(p.tolist(), row.tolist()) for p, row in zip(points, labels, strict=True)], "v array<double>, labels array<int>")
    away = np.sqrt(((points[:, None] - points) ** 2).sum(2))
    want = {}
    for c, k in enumerate((3, 2, 4)):
        each = []
        for i in range(len(points)):
            own = labels[:, c] == labels[i, c]
            if own.sum() == 1:
                each.append(0.0)
                continue
            a = away[i][own].sum() / (own.sum() - 1)
            b = min(away[i][labels[:, c] == o].mean() for o in range(k) if o != labels[i, c] and (labels[:, c] == o).any())
            each.append((b - a) / max(a, b))
        want[c] = np.mean(each)
    for block in (4096, 17):
        assert cluster.silhouettes(df, [3, 2, 4], block) == pytest.approx(want)
    table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)] + [(900, None, 1.0)], "id int, x double, y double")
    for judge in ("euclidean", "squared"):
        out, k = cluster.cluster(table, ["x", "y"], most=6, judge=judge)
        found = {r.id: r.Cluster_Label for r in out.collect()}
        assert k == 3 and found[900] == -1 and len({(labels[i, 0], found[i]) for i in range(125)}) == 3


def test_permutation_importance(spark, data, rows):
    x, y = rows
    predict = lambda d: d.withColumn("prediction", 4 * F.col("a") - 2 * F.col("b"))
    got = {r["column"]: (r["mean"], r["std"]) for r in explain.permutation_importance(data, ["a", "b", "c"], "y", "id", predict, repeats=3).collect()}
    base = r2(y, 4 * x[:, 0] - 2 * x[:, 1])
    for j, c in enumerate("abc"):
        losses = []
        for r in range(3):
            here, there = (sorted(range(180), key=lambda i, s=s: (hashlib.md5(f"{s}:{i}".encode()).hexdigest(), i)) for s in (42 + 2 * r, 43 + 2 * r))
            z = x.copy()
            z[here, j] = x[there, j]
            losses.append(base - r2(y, 4 * z[:, 0] - 2 * z[:, 1]))
        assert got[c] == pytest.approx((np.mean(losses), np.std(losses)), abs=1e-9)


def test_training_by_one_split(spark, data, rows):
    x, y = rows
    fitted, test, both = models.train(data, COLUMNS, "y", "id", "ridge", alpha=2.0)
    order = sorted(range(180), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    out = np.isin(np.arange(180), order[: math.ceil(180 * 0.2)])
    m, s = x[~out].mean(0), x[~out].std(0)
    z, w = (x[~out] - m) / s, (x[out] - m) / s
    centered = z - z.mean(0)
    beta = np.linalg.solve(centered.T @ centered + 2.0 * np.eye(4), centered.T @ (y[~out] - y[~out].mean()))
    p = w @ beta + y[~out].mean()
    assert {r.id: r.prediction for r in test.collect()} == pytest.approx(dict(zip(np.flatnonzero(out).tolist(), p.tolist(), strict=True)), rel=1e-6)
    assert {r.side: r.r2 for r in both.collect()} == pytest.approx({"train": r2(y[~out], z @ beta + y[~out].mean()), "test": r2(y[out], p)}, rel=1e-6)


def walk(node, x):
    while node.getClass().getSimpleName() == "InternalNode":
        node = node.leftChild() if x[node.split().featureIndex()] <= node.split().threshold() else node.rightChild()
    return node.prediction()


@pytest.mark.parametrize("name", ["random_forest", "extra_trees", "gbdt", "adaboost"])
def test_ensembles_by_their_trees(spark, data, rows, name):
    x, y = rows
    z = assembled(data, COLUMNS)
    params = {"random_forest": {"numTrees": 5}, "extra_trees": {"numTrees": 5}, "gbdt": {"maxIter": 4}, "adaboost": {"rounds": 5}}[name]
    m = models.make(name, z, "y", **params).fit(z)
    got = {r.id: r.prediction for r in m.transform(z).collect()}
    weights = m.powers if name == "adaboost" else list(m.treeWeights) if name == "gbdt" else [1 / len(m.trees)] * len(m.trees)
    for i in range(0, 180, 9):
        each = [walk(t._java_obj.rootNode(), x[i]) for t in m.trees]
        if name == "adaboost":  # the weighted median
            total, want = 0.0, None
            for v, w in sorted(zip(each, weights, strict=True)):
                total += w
                if want is None and total >= sum(weights) / 2:
                    want = v
        else:
            want = sum(v * w for v, w in zip(each, weights, strict=True))
        assert got[i] == pytest.approx(want)
    assert scores(m.transform(z), "y", "prediction").first().r2 > 0.8


def test_kernel_regression_near_ridge(spark):
    """Random waves against a fit by the kernel itself, on a smooth curve."""
    rng = np.random.default_rng(0)
    x = np.sort(rng.uniform(-3, 3, 150))
    y = np.sin(x) * 3
    z = assembled(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double"), ["x"])
    m = models.make("svr", z, "y", features=200, gamma=0.5).fit(z)
    k = np.exp(-0.5 * (x[:, None] - x) ** 2)
    exact = k @ np.linalg.solve(k + 1e-2 * np.eye(150), y)
    got = np.array([r.prediction for r in m.transform(z).orderBy("x").collect()])
    assert np.sqrt(((got - exact) ** 2).mean()) < 0.2


def test_importance_table(spark, data):
    assert [tuple(r) for r in select.importance_table(data, ["a", "b"], [-2.0, 1.0]).collect()] == [("a", 1.0), ("b", 0.5)]
    assert [tuple(r) for r in select.importance_table(data, ["a"], [0.0]).collect()] == [("a", 0.0)]


@pytest.mark.parametrize("together", [1000, 1])
def test_standards_of_all_parts_come_from_one_set_of_passes(spark, monkeypatch, together):
    from forgeframe.operators import metrics

    monkeypatch.setattr(metrics, "TOGETHER", together)
    rows = [(i, float(i * i % 17) if i % 5 else None, 3.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, flat double")
    calls, plain = [], metrics.quantiles
    monkeypatch.setattr(metrics, "quantiles", lambda *a: calls.append(1) or plain(*a))
    parts = [F.col("id") % 3 != k for k in range(3)]
    found = metrics.standards(df, ["a", "flat"], parts)
    assert len(calls) == (1 if together > 1 else 3)
    for k, facts in enumerate(found):
        a = np.array([np.nan if r[1] is None else r[1] for r in rows if r[0] % 3 != k])
        filled = np.where(np.isnan(a), np.nanmedian(a), a)
        assert facts["a"] == pytest.approx((np.nanmedian(a), filled.mean(), filled.std())) and facts["flat"] == (3.0, 3.0, 0.0)
        want, got = (metrics.standardise(df.where(parts[k]), ["a", "flat"], df).orderBy("id").collect(), metrics.standardised(df, facts).orderBy("id").collect())
        assert [r.a for r in got] == pytest.approx([r.a for r in want]) and {r.flat for r in got} == {0.0}


def test_kernel_regression_predicts_without_a_table_of_waves(spark, data, rows):
    x, _ = rows
    z = assembled(data, COLUMNS)
    m = models.make("svr", z, "y", features=30, gamma=0.2).fit(z)
    rng = np.random.default_rng(42)
    w, b = rng.normal(0, np.sqrt(0.4), (len(COLUMNS), 30)), rng.uniform(0, 2 * np.pi, 30)
    seen = m.transform(z)
    assert [r.prediction for r in seen.orderBy("id").collect()] == pytest.approx(list(np.cos(x @ w + b) @ m.coefficients + m.intercept))
    assert "waves" not in seen._jdf.queryExecution().toString()
    parts = [m.transform(z.where("id < 0").repartition(3)).collect(), m.transform(z.repartition(7)).count()]
    assert parts == [[], len(x)]


@pytest.mark.parametrize("most", [50_000, 5, 0])
def test_a_split_leaves_rows_where_they_are(spark, monkeypatch, most):
    """The bound of the hashes is found by counts; ranks are only for rows of one key on both sides."""
    monkeypatch.setattr(clean, "RANGE_ROWS", most)
    df = spark.createDataFrame([(i,) for i in range(997)], "id long")
    ranked = sorted(range(997), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    for share in (0.2, 0.0, 0.001, 1.0):
        got = splits.random_split(df, "id", share)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r.id for r in got.where("is_test").collect()} == set(ranked[: -int(-997 * share // 1)])
    assert splits.random_split(df.where("id < 0"), "id").collect() == []
    even = splits.random_split(df.coalesce(1), "id", even=True)
    assert even.rdd.getNumPartitions() == 1 and even.where("is_test").count() == 200


def test_a_split_of_repeated_keys_has_its_exact_size(spark):
    df = spark.createDataFrame([(i % 3 if i % 3 else None, i) for i in range(100)], "k long, id long")
    for share in (0.01, 0.2, 0.5, 0.77):
        got = splits.random_split(df, "k", share)
        assert got.where("is_test").count() == -int(-100 * share // 1) and got.select("id").distinct().count() == 100
