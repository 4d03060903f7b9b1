"""Explanations: linear and tree contributions, sampled Shapley values, permutation importance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clean import with_row_of
from .metrics import scores
from .select import assembled
from .splits import hash_ranked

#: Numbers (rows by paths by features) that one pass over a batch holds.
PASS = 1 << 20


def linear_contributions(df: DataFrame, columns: list[str], weights: list[float], key: list[str]) -> DataFrame:
    """Exact Shapley values of a linear model: weight * (value - mean)."""
    means = df.agg(*(F.avg(c).alias(f"{c}\x00") for c in columns))
    return with_row_of(df, means).select(*key, *[(F.lit(float(w)) * (F.col(c) - F.col(f"{c}\x00"))).alias(c) for c, w in zip(columns, weights, strict=True)])


@dataclass
class Path:
    """A leaf of a tree: its weighted value, and for each feature on the way to it the interval (low, high] and the share of rows that went along."""

    tree: int
    value: float
    features: dict[int, tuple[float, float, float]]


def tree_paths(model) -> list[Path]:
    """All paths from the root to a leaf, of a fitted tree, forest or boosted trees (E01). Splits must be of numbers.

    Splits of one feature on a path become one interval, with the product of the shares of the training rows that
    went the path's way at each of them.
    """
    trees = model.trees if hasattr(model, "trees") else [model]
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    if "Forest" in type(model).__name__:
        weights = [w / sum(weights) for w in weights]
    out = []
    for k, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        todo = [(tree._java_obj.rootNode(), {})]
        while todo:
            node, on = todo.pop()
            if node.getClass().getSimpleName() == "LeafNode":
                out.append(Path(k, weight * node.prediction(), on))
                continue
            split = node.split()
            if split.getClass().getSimpleName() != "ContinuousSplit":
                raise ValueError("contributions need splits of numbers, not of categories")
            low, high, share = on.get(split.featureIndex(), (-np.inf, np.inf, 1.0))
            rows, at = node.impurityStats().count(), split.threshold()
            for child, interval in ((node.leftChild(), (low, min(high, at))), (node.rightChild(), (max(low, at), high))):
                todo.append((child, on | {split.featureIndex(): (*interval, share * child.impurityStats().count() / rows)}))
    return out


def path_table(spark: SparkSession, model, columns: list[str]) -> DataFrame:
    """(tree, leaf, value, column, low, high, share): the paths of ``tree_paths`` as rows, a feature each."""
    rows = [(p.tree, leaf, p.value, columns[f], low, high, share) for leaf, p in enumerate(tree_paths(model)) for f, (low, high, share) in p.features.items()]
    return spark.createDataFrame(rows, "tree int, leaf int, value double, column string, low double, high double, share double")


def path_contributions(x: np.ndarray, paths: list[Path]) -> np.ndarray:
    """Shapley values of the rows of ``x``, where a feature that isn't known goes all ways of its splits by the shares of rows.

    A leaf counts with the product over its features of 1 or 0 (known: whether the value goes its way) or of the share. Such
    a product's Shapley value for a feature is the integral, over t from 0 to 1, of the others' t * known + (1 - t) * share,
    times the difference that the feature makes; a Gauss-Legendre rule is exact for these polynomials.
    """
    out, x = np.zeros(x.shape), np.where(np.isnan(x), np.inf, x)
    by_size: dict[int, list[Path]] = {}
    for p in paths:
        by_size.setdefault(len(p.features), []).append(p)
    for m, group in by_size.items():
        if not m:
            continue
        at, weight = np.polynomial.legendre.leggauss(m // 2 + 1)
        at, weight = (at + 1) / 2, weight / 2
        feature = np.array([list(p.features) for p in group])
        low, high, share = np.array([list(p.features.values()) for p in group]).transpose(2, 0, 1)
        value = np.array([p.value for p in group])
        step = max(1, PASS // feature.size)
        for a in range(0, len(x), step):
            seen = x[a : a + step][:, feature]
            known = ((seen > low) & (seen <= high)).astype(float)
            others = np.zeros(known.shape)
            for t, w in zip(at, weight, strict=True):
                each = t * known + (1 - t) * share
                before = np.cumprod(np.concatenate([np.ones((*each.shape[:2], 1)), each[:, :, :-1]], axis=2), axis=2)
                after = np.cumprod(np.concatenate([np.ones((*each.shape[:2], 1)), each[:, :, :0:-1]], axis=2), axis=2)[:, :, ::-1]
                others += w * before * after
            gains = (known - share) * others * value[:, None]
            for f in np.unique(feature):
                out[a : a + step, f] += (gains * (feature == f)).sum((1, 2))
    return out


def cells(x: np.ndarray, paths: list[Path]) -> tuple[np.ndarray, np.ndarray]:
    """(rows that stand for a cell each, the cell of each row): rows whose values lie between the same ends of the paths' intervals have the same contributions."""
    x, number = np.where(np.isnan(x), np.inf, x), np.zeros(len(x), np.int64)
    for f in range(x.shape[1]):
        ends = np.unique([v for p in paths if f in p.features for v in p.features[f][:2]])
        both = np.c_[number, np.searchsorted(ends, x[:, f], "left")]
        # Numbered anew with each feature, so no product of many of them overflows.
        number = np.unique(both[:, 0] * (len(ends) + 1) + both[:, 1], return_inverse=True)[1].reshape(-1)
    return np.unique(number, return_index=True)[1], number


def batch_contributions(x: np.ndarray, paths: list[Path]) -> np.ndarray:
    """As ``path_contributions``; of the rows that a tree's splits don't tell apart one is worked out."""
    out = np.zeros(x.shape)
    for tree in sorted({p.tree for p in paths}):
        own = [p for p in paths if p.tree == tree]
        first, cell = cells(x, own)
        out += path_contributions(x[first], own)[cell]
    return out


def tree_contributions(df: DataFrame, model, columns: list[str], key: list[str], prediction: str | None = None) -> DataFrame:
    """(key, a value for each column, base): exact path-dependent Shapley values of a tree model.

    ``model`` is a fitted tree, forest or boosted trees over ``columns``; values and base add up to its prediction, which comes along under
    the name ``prediction``, where that is one of ``key``. A missing value counts as larger than any, as in the trees. The paths, as many as the model has leaves,
    go to the tasks with the code; rows stay where they are, and of those of a batch that a tree's splits don't tell apart one is worked out.
    """
    paths = tree_paths(model)
    base = sum(p.value * float(np.prod([share for _, _, share in p.features.values()])) for p in paths)

    @F.pandas_udf("array<double>")
    def values(v: pd.Series) -> pd.Series:
        return pd.Series(list(batch_contributions(np.stack(v.to_numpy()), paths))) if len(v) else pd.Series([], dtype=object)

    data = df if "features" in df.columns else assembled(df, columns)
    if prediction:
        data = model.transform(data)
    data = data.withColumn("values\x00", values(vector_to_array("features")))
    return data.select(*key, *[F.get("values\x00", F.lit(i)).alias(c) for i, c in enumerate(columns)], F.lit(float(base)).alias("base"))


def shuffled(df: DataFrame, column: str, key: str, seed: int = 42) -> DataFrame:
    """``df`` with the values of one column dealt to other rows: rank by key hash against rank by another hash."""
    here = hash_ranked(df, key, seed, "rank\x00")
    there = hash_ranked(df.select(key, F.col(column).alias("other\x00")), key, seed + 1, "rank\x00").drop(key)
    return here.join(there, "rank\x00").withColumn(column, F.col("other\x00")).select(*df.columns)


def permutation_importance(df: DataFrame, columns: list[str], target: str, key: str, predict, repeats: int = 5, metric: str = "r2", seed: int = 42) -> DataFrame:
    """(column, mean, std) of the loss of score when a column is shuffled (E02). ``predict``: df -> df with prediction."""

    def score(d: DataFrame) -> DataFrame:
        s = scores(predict(d), target, "prediction")
        return s.select((F.col("r2") if metric == "r2" else -F.col("rmse")).alias("score"))

    base, out = score(df).withColumnRenamed("score", "base"), None
    for c in columns:
        for r in range(repeats):
            row = score(shuffled(df, c, key, seed + 2 * r)).withColumn("column", F.lit(c))
            out = row if out is None else out.unionByName(row)
    return out.crossJoin(base).groupBy("column").agg(F.avg(F.col("base") - F.col("score")).alias("mean"), F.stddev_pop(F.col("base") - F.col("score")).alias("std"))


def top_importances(table: DataFrame, k: int = 15) -> DataFrame:
    return table.orderBy(F.col("importance").desc(), "column").limit(k)


def sampled_shapley(df: DataFrame, columns: list[str], key: str, predict, orders: int = 8, seed: int = 42) -> DataFrame:
    """(key, column, value): Shapley values from random column orders against the column means.

    Every row is explained; each order puts the row's values in place of the means one by one, and all
    those variants, a row each, are predicted in one pass.
    """
    rng = np.random.default_rng(seed)
    means = df.agg(*(F.avg(c).alias(f"{c}\x00") for c in columns))
    places = [rng.permutation(len(columns)).tolist() for _ in range(orders)]
    both = with_row_of(df.select(key, *columns), means).withColumn("order", F.explode(F.array(*map(F.lit, range(orders)))))
    many = both.withColumn("step", F.explode(F.array(*map(F.lit, range(len(columns) + 1)))))
    # The step at which each column's own value comes, by order.
    at = {c: F.get(F.array(*(F.lit(order.index(i) + 1) for order in places)), F.col("order")) for i, c in enumerate(columns)}
    names = F.array(*(F.array(*(F.lit(columns[i]) for i in order)) for order in places))
    many = many.select(key, "order", "step", F.when(F.col("step") > 0, F.get(F.get(names, F.col("order")), F.col("step") - 1)).alias("column"), *(F.when(at[c] <= F.col("step"), F.col(c)).otherwise(F.col(f"{c}\x00")).cast("double").alias(c) for c in columns))
    before = F.expr(f"lag(prediction) OVER (PARTITION BY `{key}`, `order` ORDER BY step)")
    gains = predict(many).withColumn("gain", F.col("prediction") - before).where("step > 0")
    return gains.groupBy(key, "column").agg(F.avg("gain").alias("value"))
