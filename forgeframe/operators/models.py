"""Regression models by name, trained by Spark on assembled vectors.

Linear models are exact; trees are Spark's; networks, kernel models and others that Spark lacks are made
of its parts: gradients summed over partitions, random Fourier features, weighted trees. Boosting
libraries that aren't installed say so instead of standing in for one another.
"""

from __future__ import annotations

import functools
import importlib.util
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.physics import glass_transition
from ..staging import checkpointed
from .metrics import scores, standardised, standards
from .select import assembled, eliminate
from .splits import folds, group_folds, nested_prefixes, random_split

FEATURES, PREDICTION = "features", "prediction"

#: Model, how it is made here, package that it needs.
CATALOGUE = [
    ("linear", "ml", None), ("ridge", "ml", None), ("lasso", "ml", None), ("elastic_net", "ml", None), ("decision_tree", "ml", None),
    ("random_forest", "ml", None), ("extra_trees", "random forest with one random candidate set a split (approximation)", None), ("gbdt", "ml", None),
    ("adaboost", "weighted trees", None), ("svr", "random Fourier features, Huber loss (approximation)", None), ("mlp", "network", None), ("ann", "network", None),
    ("tf_sequential", "network", None), ("pinn", "network with a physical head", None), ("xgboost", "package", "xgboost"), ("lightgbm", "package", "lightgbm"),
    ("catboost", "package", "catboost"), ("tabpfn", "package", "tabpfn"), ("autogluon", "package", "autogluon"),
]


def available_models() -> list[tuple[str, bool, str]]:
    """(model, available, how it is made or why it isn't there)."""
    out = []
    for name, how, needs in CATALOGUE:
        there = needs is None or importlib.util.find_spec(needs) is not None
        out.append((name, there, how if there else f"the package {needs} is not installed"))
    return out


def ridge(df: DataFrame, target: str, alpha: float = 1.0, l1: float = 0.0, spread: tuple[float, int] | None = None, **extra) -> LinearRegression:
    """Spark's linear regression with the penalty of the usual definition.

    Spark scales the label by its deviation, so the quadratic part of a penalty needs that factor. Ridge:
    ``alpha`` on the sum of squares; with ``l1`` the penalty alpha * (l1 * |w| + (1 - l1) / 2 * w**2).
    ``spread``: the label's deviation and count, where they are known.
    """
    s, n = spread or df.agg(F.stddev_pop(target), F.count(target)).first()
    s, n = s or 1.0, n or 1
    if l1 == 0:
        return LinearRegression(featuresCol=FEATURES, labelCol=target, regParam=alpha * s / n, elasticNetParam=0.0, standardization=False, solver="normal", **extra)
    first, second = alpha * l1, alpha * (1 - l1) * s
    return LinearRegression(featuresCol=FEATURES, labelCol=target, regParam=first + second, elasticNetParam=first / (first + second), standardization=False, tol=1e-10, maxIter=500, **extra)


def make(name: str, df: DataFrame, target: str, **params):
    """An estimator of the catalogue; ``df`` is what it will be fitted on."""
    common = {"featuresCol": FEATURES, "labelCol": target}
    seed, spread = params.pop("seed", 42), params.pop("spread", None)
    if name == "linear":
        return LinearRegression(**common, solver="normal", **params)
    if name == "ridge":
        return ridge(df, target, params.get("alpha", 1.0), spread=spread)
    if name == "lasso":
        return ridge(df, target, params.get("alpha", 1.0), 1.0, spread=spread)
    if name == "elastic_net":
        return ridge(df, target, params.get("alpha", 1.0), params.get("l1_ratio", 0.5), spread=spread)
    if name == "decision_tree":
        return DecisionTreeRegressor(**common, seed=seed, **params)
    if name == "random_forest":
        return RandomForestRegressor(**common, seed=seed, **params)
    if name == "extra_trees":
        return RandomForestRegressor(**common, seed=seed, featureSubsetStrategy="onethird", bootstrap=False, **params)
    if name == "gbdt":
        return GBTRegressor(**common, seed=seed, **params)
    if name == "adaboost":
        return AdaBoost(target, seed=seed, **params)
    if name == "svr":
        return FourierRegression(target, seed=seed, **params)
    if name in ("mlp", "ann", "tf_sequential", "pinn"):
        return Network(target, seed=seed, physical=name == "pinn", **params)
    raise ValueError({m: why for m, _, why in available_models()}.get(name, f"no model named {name}"))


@dataclass
class AdaBoost:
    """AdaBoost.R2 with linear loss over weighted trees; the prediction is their weighted median.

    A round's weights are written and read again, so no plan grows by its trees.
    """

    target: str
    rounds: int = 10
    depth: int = 3
    seed: int = 42

    def fit(self, df: DataFrame) -> AdaBoostModel:
        df = df.withColumn("weight\x00", F.lit(1.0))
        trees, powers = [], []
        for r in range(self.rounds):
            tree = DecisionTreeRegressor(featuresCol=FEATURES, labelCol=self.target, weightCol="weight\x00", maxDepth=self.depth, seed=self.seed + r).fit(df)
            seen = checkpointed(tree.transform(df).withColumn("loss\x00", F.abs(F.col(PREDICTION) - F.col(self.target))).drop(PREDICTION))
            most, total, lost = seen.agg(F.max("loss\x00"), F.sum("weight\x00"), F.sum(F.col("weight\x00") * F.col("loss\x00"))).first()
            mean = lost / total / most if most else 0.0
            trees.append(tree)
            if mean <= 0:
                powers.append(1.0)
                break
            if mean >= 0.5:
                powers.append(1e-3)
                break
            beta = mean / (1 - mean)
            powers.append(math.log(1 / beta))
            df = seen.withColumn("weight\x00", F.col("weight\x00") * F.pow(F.lit(beta), 1 - F.col("loss\x00") / most)).drop("loss\x00")
        return AdaBoostModel(trees, powers)


@dataclass
class AdaBoostModel:
    trees: list
    powers: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for k, tree in enumerate(self.trees):
            out = tree.transform(out).withColumnRenamed(PREDICTION, f"tree\x00{k}")
        names = [f"tree\x00{k}" for k in range(len(self.trees))]
        votes = F.array_sort(F.array(*[F.struct(F.col(n).alias("p"), F.lit(w).alias("w")) for n, w in zip(names, self.powers, strict=True)]))
        half = sum(self.powers) / 2
        start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("p"))
        median = F.aggregate(votes, start, lambda a, v: F.struct((a["w"] + v["w"]).alias("w"), F.when(a["p"].isNull() & (a["w"] + v["w"] >= half), v["p"]).otherwise(a["p"]).alias("p")))
        return out.withColumn(PREDICTION, median["p"]).drop(*names)


@dataclass
class FourierRegression:
    """Kernel regression with a Gaussian kernel, by random Fourier features and a Huber loss (A10)."""

    target: str
    features: int = 100
    gamma: float = 0.1
    alpha: float = 1e-3
    seed: int = 42

    def _waves(self, width: int):
        """The waves of an Arrow array of feature arrays, as a matrix."""
        rng = np.random.default_rng(self.seed)
        w, b = rng.normal(0, math.sqrt(2 * self.gamma), (width, self.features)), rng.uniform(0, 2 * math.pi, self.features)
        return lambda x: np.cos(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) @ w + b)

    def fit(self, df: DataFrame):
        width = df.schema[FEATURES].metadata.get("ml_attr", {}).get("num_attrs") or len(df.select(vector_to_array(FEATURES).alias("v")).first()["v"])
        waves, each = self._waves(width), self.features

        @F.arrow_udf("array<double>")
        def mapped(x: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(np.arange(0, (len(x) + 1) * each, each, dtype=np.int32), waves(x).ravel())

        # Only what the fit reads: it passes over its rows several times.
        rows = df.select(self.target, array_to_vector(mapped(vector_to_array(FEATURES))).alias("waves\x00"))
        inner = LinearRegression(featuresCol="waves\x00", labelCol=self.target, loss="huber", regParam=self.alpha).fit(rows)
        return FourierModel(self, inner.coefficients.toArray(), inner.intercept, width)


@dataclass
class FourierModel:
    outer: FourierRegression
    coefficients: np.ndarray
    intercept: float
    width: int

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with predictions; waves stay inside the worker, which gives one number a row."""
        waves, coefficients, intercept = self.outer._waves(self.width), self.coefficients, self.intercept

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            return pa.array(waves(x) @ coefficients + intercept)

        return df.withColumn(PREDICTION, predicted(vector_to_array(FEATURES)))


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> list[np.ndarray]:
    out = [x]
    for k, w in enumerate(layers):
        z = out[-1] @ w[:-1] + w[-1]
        out.append(np.tanh(z) if k < len(layers) - 1 else z)
    return out


def _physical(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Glass transition from the head's four outputs (start, rise, shape, conversion), and its derivatives."""
    tg0, rise, lam, a = raw[:, 0] * 100 + 300, np.logaddexp(0, raw[:, 1]) * 100, 1 / (1 + np.exp(-raw[:, 2])), 1 / (1 + np.exp(-raw[:, 3]))
    d = np.maximum(1 - (1 - lam) * a, 1e-8)
    part = lam * a / d
    slope = np.c_[np.full(len(raw), 100.0), part * 100 / (1 + np.exp(-raw[:, 1])), rise * a * (1 - a) / d**2 * lam * (1 - lam), rise * lam / d**2 * a * (1 - a)]
    return tg0 + rise * part, slope


@dataclass
class Network:
    """A small tanh network fitted by Adam; each step sums the gradient over all partitions.

    With ``physical`` the last layer gives the parameters of a glass-transition curve instead of a value.
    Features and target are standardised by the caller or here. ``history`` holds the loss of each epoch.
    """

    target: str
    hidden: tuple[int, ...] = (16,)
    epochs: int = 40
    rate: float = 0.05
    seed: int = 42
    physical: bool = False
    patience: int = 10
    history: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame) -> NetworkModel:
        data = df.select(vector_to_array(FEATURES).alias("x"), F.col(self.target).cast("double").alias("y")).cache()
        facts = data.agg(F.avg("y"), F.stddev_pop("y"), F.count("*"), F.max(F.size("x"))).first()
        mean, std, n, width = (0.0, 1.0, *facts[2:]) if self.physical else (facts[0], facts[1] or 1.0, *facts[2:])
        sizes = [width, *self.hidden, 4 if self.physical else 1]
        rng = np.random.default_rng(self.seed)
        layers = [np.vstack([rng.normal(0, 1 / math.sqrt(a), (a, b)), np.zeros((1, b))]) for a, b in zip(sizes, sizes[1:], strict=False)]
        first, second = ([np.zeros_like(w) for w in layers] for _ in range(2))
        best, since, physical = math.inf, 0, self.physical
        for epoch in range(1, self.epochs + 1):
            now = layers

            def gradient(batches, now=now):
                total, loss = [np.zeros_like(w) for w in now], 0.0
                for pdf in batches:
                    x, y = np.stack(pdf["x"].to_numpy()), (pdf["y"].to_numpy() - mean) / std
                    out = _forward(x, now)
                    if physical:
                        value, slope = _physical(out[-1])
                        off = value - y
                        delta = off[:, None] * slope
                    else:
                        off = out[-1][:, 0] - y
                        delta = off[:, None]
                    loss += float((off**2).sum())
                    for k in range(len(now) - 1, -1, -1):
                        total[k] += np.vstack([out[k].T @ delta, delta.sum(0)])
                        delta = (delta @ now[k][:-1].T) * (1 - out[k] ** 2)
                yield pd.DataFrame({"place": range(sum(w.size for w in now) + 1), "g": np.r_[loss, *[t.ravel() for t in total]]})

            g = data.mapInPandas(gradient, "place int, g double").groupBy("place").agg(F.sum("g").alias("g")).orderBy("place").toPandas()["g"].to_numpy()
            self.history.append(g[0] / n)
            at = 1
            for k, w in enumerate(layers):
                d = g[at : at + w.size].reshape(w.shape) / n
                at += w.size
                first[k], second[k] = 0.9 * first[k] + 0.1 * d, 0.999 * second[k] + 0.001 * d * d
                layers[k] = w - self.rate * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
            since = 0 if self.history[-1] < best - 1e-6 else since + 1
            best = min(best, self.history[-1])
            if since >= self.patience:
                break
        data.unpersist()
        return NetworkModel(layers, mean, std, physical, self.history)


@dataclass
class NetworkModel:
    layers: list[np.ndarray]
    mean: float
    std: float
    physical: bool
    history: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        layers, mean, std, physical = self.layers, self.mean, self.std, self.physical

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            raw = _forward(np.stack(x.to_numpy()), layers)[-1]
            return pd.Series(_physical(raw)[0] if physical else raw[:, 0] * std + mean)

        return df.withColumn(PREDICTION, predict(vector_to_array(FEATURES)))


def physical_curve(tg0: Column, tg_inf: Column, lam: Column, ratio: Column, weight: Column, conversion: Column) -> Column:
    """The curve with the conversion held under what the stoichiometry allows, as far as the ratio is trusted."""
    from ..functions.physics import largest_conversion

    bound = weight * largest_conversion(ratio) + (F.lit(1.0) - weight)
    return glass_transition(tg0, tg_inf, lam, F.least(conversion, bound))


def train(df: DataFrame, columns: list[str], target: str, key: str, model: str = "ridge", test_size: float = 0.2, seed: int = 42, **params):
    """(fitted model, test rows with predictions, scores of both sides) of one split."""
    parts = random_split(df.where(F.col(target).isNotNull()), key, test_size, seed, even=True).cache()
    train_rows, test_rows = parts.where("not is_test"), parts.where("is_test")
    (facts,) = standards(parts, columns, [~F.col("is_test")])
    sides = [assembled(standardised(s, facts), columns) for s in (train_rows, test_rows)]
    fitted = make(model, sides[0], target, seed=seed, **params).fit(sides[0])
    seen = [fitted.transform(s) for s in sides]
    both = scores(seen[0].withColumn("side", F.lit("train")).unionByName(seen[1].withColumn("side", F.lit("test"))), target, PREDICTION, ["side"])
    return fitted, seen[1], both


def _all(parts) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def cross_validate(df: DataFrame, columns: list[str], target: str, key: str, model: str = "ridge", k: int = 5, seed: int = 42, stratum: str | None = None, group: str | None = None, fold: str | None = None, repeats: int = 1, **params) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold predictions, scores by fold).

    Folds go by hash of ``key``, within each ``stratum`` where one is named; by whole groups of ``group``;
    or they are given in the column ``fold``. With ``repeats`` folds are dealt anew each time, with the next seed: predictions and scores have a column
    ``repeat`` beside ``fold``, and a row's predictions may be averaged by ``splits.out_of_fold``.
    """
    rows, places = df.where(F.col(target).isNotNull()), ["repeat", "fold"] if repeats > 1 else ["fold"]
    if fold is not None:
        rows = rows.withColumn("fold", F.col(fold).cast("int"))
        rows = _all((rows.withColumn("repeat", F.lit(r)) for r in range(repeats))) if repeats > 1 else rows
    else:
        dealt = [group_folds(rows, group, k, seed + r) if group else folds(rows, key, k, seed + r, stratum) for r in range(repeats)]
        rows = _all((d.withColumn("repeat", F.lit(r)) for r, d in enumerate(dealt))) if repeats > 1 else dealt[0]
    sides = validation_sides(rows.cache(), columns, places, target)
    seen = validated(sides, target, key, places, model, seed, **params)
    return seen, scores(seen, target, PREDICTION, places)


@dataclass
class Side:
    """Rows to fit on and rows held out of one fold, standardised by the former and assembled; the target's deviation and count in the former."""

    inner: DataFrame
    outer: DataFrame
    spread: tuple[float, int]


def validation_sides(rows: DataFrame, columns: list[str], places: list[str], target: str) -> list[Side]:
    """The sides of each fold of ``rows`` (``places``: fold, or repeat and fold). All folds are measured together; what depends on rows only is done once here, for any number of fits."""
    out, inside = [], []
    numbers = sorted(tuple(r) for r in rows.select(*places).distinct().collect())
    for number in numbers:
        here = F.col("repeat") == number[0] if len(places) > 1 else F.lit(True)
        inside.append((here & (F.col("fold") != number[-1]), here & (F.col("fold") == number[-1])))
    spreads = rows.agg(*(f(F.when(i, F.col(target))).alias(f"s{j}{k}") for k, (i, _) in enumerate(inside) for j, f in enumerate((F.stddev_pop, F.count)))).first() if inside else []
    for k, (facts, (i, o)) in enumerate(zip(standards(rows, columns, [i for i, _ in inside]) if inside else [], inside, strict=True)):
        a, b = (assembled(standardised(rows.where(side), facts), columns) for side in (i, o))
        out.append(Side(a, b, (spreads[2 * k], spreads[2 * k + 1])))
    return out


def validated(sides: list[Side], target: str, key: str, places: list[str], model: str, seed: int, **params) -> DataFrame:
    """(key, *places, target, prediction): out-of-fold predictions of a model of given parameters."""
    return _all([make(model, s.inner, target, seed=seed, spread=s.spread, **params).fit(s.inner).transform(s.outer).select(key, *places, target, PREDICTION) for s in sides])


def eliminate_validated(df: DataFrame, columns: list[str], target: str, key: str, model: str = "linear", k: int = 5, least: int = 1, metric: str = "r2", seed: int = 42, **params) -> tuple[DataFrame, DataFrame]:
    """Recursive elimination with the number of features by cross-validation.

    ((column, ranking): kept ones have 1; (n_features, score): mean over folds for each number of features). Each fold eliminates for itself, on the rows outside it, and scores
    every number of features on its own rows; the best mean counts, of equal ones the fewer features. The features kept are then those of an elimination on all rows.
    The lightest feature of a fit on standardised columns goes each time.
    """

    def fitted(d: DataFrame, left: list[str], y: str):
        z = assembled(d, left)
        return make(model, z, y, seed=seed, **params).fit(z)

    def whole(d: DataFrame, left: list[str], y: str) -> np.ndarray:
        if not known:
            known.extend(standards(d, columns, [F.lit(True)]))
        return weights_of(fitted(standardised(d, known[0]), left, y))

    def weights_of(m) -> np.ndarray:
        return np.abs((m.coefficients if hasattr(m, "coefficients") else m.featureImportances).toArray())

    rows = folds(df.where(F.col(target).isNotNull()), key, k, seed).cache()
    tried: dict[int, list[float]] = {}
    known: list[dict] = []
    facts = standards(rows, columns, [F.col("fold") != number for number in range(k)])
    for number in range(k):
        inner, outer = (standardised(rows.where(side), facts[number]) for side in (F.col("fold") != number, F.col("fold") == number))
        left = list(columns)
        while True:
            m = fitted(inner, left, target)
            score = scores(m.transform(assembled(outer, left)), target, PREDICTION).first()[metric]
            tried.setdefault(len(left), []).append(-math.inf if score is None else score if metric == "r2" else -score)
            if len(left) <= max(1, least):
                break
            weights = weights_of(m)
            del left[min(range(len(left)), key=lambda i: (weights[i], left[i]))]
    rows.unpersist()
    means = {n: float(np.mean(s)) for n, s in tried.items()}
    best = max(means, key=lambda n: (means[n], -n))
    ranking = eliminate(df, columns, target, whole, keep=best)
    return ranking, df.sparkSession.createDataFrame(sorted(means.items()), "n_features int, score double")


def learning_curve(df: DataFrame, test: DataFrame, columns: list[str], target: str, key: str, sizes: list[int], model: str = "ridge", **params) -> DataFrame:
    """Test scores by size of nested training sets."""
    nested, out = nested_prefixes(df, key, sizes).cache(), None
    for size, facts in zip(sizes, standards(nested, columns, [F.col("size") == size for size in sizes]), strict=True):
        part = nested.where(F.col("size") == size).drop("size")
        a, b = (assembled(standardised(s, facts), columns) for s in (part, test))
        row = scores(make(model, a, target, **params).fit(a).transform(b), target, PREDICTION).withColumn("train_size", F.lit(size))
        out = row if out is None else out.unionByName(row)
    return out


def predict(model, df: DataFrame, columns: list[str], pad: bool = False) -> DataFrame:
    """Predictions for new rows (R01). Missing columns are an error, or with ``pad`` fingerprint columns 0 and others null."""
    gone = [c for c in columns if c not in df.columns]
    if gone and not pad:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    df = df.withColumns({c: F.lit(0.0) if "fp" in c.lower() else F.lit(None).cast("double") for c in gone})
    return model.transform(assembled(df, columns))
