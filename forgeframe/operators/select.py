"""Choosing features: by variance, correlation, importance, elimination; principal components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import repair_infinite, with_row_of
from .profile import by_column, feature_validity, numeric_columns, target_correlations
from .quantiles import quantiles


def by_name(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Given columns, all of them, or none for an empty list."""
    return df if names is None else df.select(*names)


def variances(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, variance): population variance with missing values as 0."""
    return by_column(df, columns or numeric_columns(df), {"variance": lambda c: F.var_pop(F.coalesce(c.cast("double"), F.lit(0.0)))})


def over_variance(df: DataFrame, threshold: float = 0.0, columns: list[str] | None = None) -> list[str]:
    return [r["column"] for r in variances(df, columns).where(F.col("variance") > threshold).collect()]


def most_correlated(df: DataFrame, target: str, k: int, columns: list[str] | None = None) -> list[str]:
    return [r["column"] for r in target_correlations(df, target, columns, k).collect()]


def recommended(df: DataFrame, target: str, columns: list[str] | None = None) -> list[str]:
    return [r["column"] for r in feature_validity(df, target, columns).where("recommended").collect()]


def importance_table(df: DataFrame, columns: list[str], weights) -> DataFrame:
    """(column, importance) with the largest made 1."""
    top = max(map(abs, weights), default=0.0) or 1.0
    return df.sparkSession.createDataFrame([(c, float(abs(w) / top)) for c, w in zip(columns, weights, strict=True)], "column string, importance double")


def eliminate(df: DataFrame, columns: list[str], target: str, fit, keep: int, step: int = 1) -> DataFrame:
    """Recursive elimination (X04): refits with ``fit(df, columns, target)`` -> weights, dropping the ``step`` lightest.

    (column, ranking): kept ones have 1. The assembled columns are read from cache over the rounds.
    """
    df = repair_infinite(df.select(*columns, target), columns).cache()
    ranking, left, dropped = {}, list(columns), []
    while len(left) > keep:
        weights = np.abs(np.asarray(fit(df, left, target), float))
        worst = sorted(range(len(left)), key=lambda i: (weights[i], left[i]))[: min(step, len(left) - keep)]
        dropped.append([left[i] for i in worst])
        left = [c for i, c in enumerate(left) if i not in worst]
    for place, names in enumerate(reversed(dropped), 2):
        ranking.update(dict.fromkeys(names, place))
    ranking.update(dict.fromkeys(left, 1))
    df.unpersist()
    return df.sparkSession.createDataFrame([(c, ranking[c]) for c in columns], "column string, ranking int")


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, covariance) of standardised columns, population (X05): one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    facts = [(F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b))).alias(f"v{k}") for k, (a, b) in enumerate(pairs)]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"v{k}").alias("covariance")) for k, (a, b) in enumerate(pairs)])
    return df.agg(*facts).select(F.inline(rows))


#: Columns whose products one aggregation of expressions sums.
FEW_COLUMNS = 16


@dataclass
class Components:
    """Principal components fitted on a table: what fills a column, its center and spread, and a column of loadings for each component."""

    columns: list[str]
    fill: list[float]
    center: list[float]
    spread: list[float]
    loadings: np.ndarray
    variances: np.ndarray

    def standardised(self, df: DataFrame) -> DataFrame:
        """``df`` with missing values of the columns filled and all standardised, as in the fit."""
        facts = zip(self.columns, self.fill, self.center, self.spread, strict=True)
        return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(f).cast("double")) - F.lit(m)) / F.lit(s) for c, f, m, s in facts})

    def rows(self, df: DataFrame, n: int) -> DataFrame:
        """``df`` with PC1 to PCn in place of the columns."""
        parts = {f"PC{k + 1}": sum((F.col(c) * float(self.loadings[i, k]) for i, c in enumerate(self.columns)), F.lit(0.0)) for k in range(min(n, len(self.columns)))}
        return self.standardised(df).withColumns(parts).drop(*self.columns)


def _summed(rows: DataFrame, near: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(means, population covariances) of all columns of ``rows``, which have no nulls, from sums of products of the distances to ``near``."""
    n = len(near)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n + 1, n + 1))
        for batch in batches:
            x = np.column_stack([*(c.to_numpy() - m for c, m in zip(batch.columns, near, strict=True)), np.ones(batch.num_rows)])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "v"])

    sums = rows.mapInArrow(products, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((n + 1) ** 2)
    total[sums.column("place").to_numpy()] = sums.column("v").to_numpy()
    total = total.reshape(n + 1, n + 1) / max(1.0, total[-1])
    mean = total[-1, :n]
    return mean + np.array(near), total[:n, :n] - np.outer(mean, mean)


def component_fit(df: DataFrame, columns: list[str]) -> Components:
    """Components of the standardised ``columns``, missing values mean-filled; each one's largest loading is positive.

    Only sums over the columns and their products come to the driver, in two aggregations. Of more than FEW_COLUMNS each task sums the products of its
    rows by matrices, which are added up as rows of numbers.
    """
    numbers = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    fill = [0.0 if x is None else float(x) for x in numbers.agg(*(F.avg(c) for c in columns)).first()]
    filled = numbers.select(*(F.coalesce(c, F.lit(f)).alias(c) for c, f in zip(columns, fill, strict=True)))
    n = len(columns)
    if n > FEW_COLUMNS:
        center, products = _summed(filled, fill)
        spread = np.sqrt(np.diag(products))
    else:
        pairs = [(i, j) for i in range(n) for j in range(i, n)]
        facts = [x or 0.0 for x in filled.agg(*(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns), *(F.covar_pop(columns[i], columns[j]) for i, j in pairs)).first()]
        center, spread, products = np.array(facts[:n]), np.array(facts[n : 2 * n]), np.zeros((n, n))
        for (i, j), v in zip(pairs, facts[2 * n :], strict=True):
            products[i, j] = products[j, i] = v
    spread = np.where(spread > 0, spread, 1.0)
    matrix = products / spread[:, None] / spread
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(n)])
    return Components(columns, fill, center.tolist(), spread.tolist(), vectors, values)


def principal_components(df: DataFrame, columns: list[str], keep: int | float) -> tuple[DataFrame, DataFrame]:
    """(rows with PC1.. in place of ``columns``, scree table).

    Missing values are mean-filled, columns standardised. ``keep``: a number of components, or below 1 the
    share of variance that they must exceed. Each component's largest loading is positive. Only the
    covariances of the columns are solved on the driver.
    """
    fit = component_fit(df, columns)
    ratio = fit.variances / fit.variances.sum()
    n = int(keep) if keep >= 1 else int(np.searchsorted(np.cumsum(ratio), keep, "right")) + 1
    scree = df.sparkSession.createDataFrame([(f"PC{k + 1}", float(v), float(r), float(s)) for k, (v, r, s) in enumerate(zip(fit.variances, ratio, np.cumsum(ratio), strict=True))], "component string, variance double, ratio double, cumulative double")
    return fit.rows(df, n), scree


def feature_table(df: DataFrame, key: str) -> DataFrame:
    """A table of computed features made fit for use (F00): numeric columns only, without all-null and
    constant ones, missing values by the median."""
    columns = [c for c in numeric_columns(df) if c != key]
    facts = by_column(df, columns, {"n": F.count, "v": F.var_samp}).collect()
    varied = [r["column"] for r in facts if r["n"] and (r["v"] or 0.0) > 0]
    medians = quantiles(df, varied, [0.5]) if varied else {}
    kept = {c: medians[(c,)][0] for c in varied}
    return df.select(key, *[F.coalesce(c, F.lit(m)).alias(c) for c, m in kept.items()])


def merge_features(base: DataFrame, features: DataFrame, key: str, prefix: str, keep_all: bool = True) -> DataFrame:
    """Features beside their rows by ``key`` (F14): prefixed, replacing columns of that name; rows without any stay if ``keep_all``."""
    named = features.select(key, *[F.col(c).alias(f"{prefix}{c}") for c in features.columns if c != key])
    return base.drop(*[c for c in named.columns if c != key]).join(named, key, "left" if keep_all else "inner")


def assembled(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    """``df`` with a vector column of ``columns``."""
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="keep").transform(df)


def as_vector(df: DataFrame, array: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(array))
