"""Choosing the next experiments: uncertain predictions over a pool, ranked by acquisition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.physics import acquisition

def pool(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(labelled rows, rows still without a target)."""
    return df.where(F.col(target).isNotNull()), df.where(F.col(target).isNull())


def forest_spread(model, df: DataFrame) -> DataFrame:
    """``df`` with mean and population deviation of the trees' predictions."""
    out, names = df, []
    for k, tree in enumerate(model.trees):
        names.append(f"tree\x00{k}")
        out = tree.setPredictionCol(names[-1]).transform(out)
    each = F.array(*names)
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / len(names)
    return out.withColumn("al_mu", mean).withColumn("al_sigma", F.sqrt(F.aggregate(each, F.lit(0.0), lambda a, x: a + (x - F.col("al_mu")) ** 2) / len(names))).drop(*names)


#: Lengths of the kernel that are tried, in units of the usual distance of two rows, and shares of signal to noise.
LENGTHS = [2.0**k for k in range(-6, 4)]
RATIOS = np.logspace(-4, 8, 97)


def evidence(products: np.ndarray, target: np.ndarray, square: float, n: int) -> tuple[float, float, float]:
    """(log marginal likelihood, scale, noise) of the best scale of the kernel and noise, from a fit's sums.

    ``products``: sums of products of the waves; ``target``: of waves and target; ``square``: of squared targets; ``n`` rows. In the eigenvectors of ``products``
    the likelihood is a sum over the waves; for each ratio of scale to noise the best noise is known, so a row of ratios is enough.
    """
    values, vectors = np.linalg.eigh(products)
    values, along = np.maximum(values, 0), (vectors.T @ target) ** 2
    shrunk = 1 + np.outer(RATIOS, values)
    noise = np.maximum((square - (RATIOS[:, None] * along / shrunk).sum(1)) / n, 1e-9 * max(square / n, 1e-300))
    likelihood = -0.5 * (n * np.log(noise) + np.log(shrunk).sum(1) + n * (1 + np.log(2 * np.pi)))
    best = int(likelihood.argmax())
    return float(likelihood[best]), float(RATIOS[best] * noise[best]), float(noise[best])


def gaussian_process(labelled: DataFrame, candidates: DataFrame, target: str, features: str = "features", length: float | None = None, noise: float | None = None, waves: int = 128, seed: int = 42) -> DataFrame:
    """``candidates`` with al_mu and al_sigma of a Gaussian process with a Gaussian kernel.

    The kernel is approximated by ``waves`` random Fourier features, so the fit is a Bayesian linear
    regression on them: each task sums the products of its rows, the sums (``waves`` squared numbers, for
    any number of rows) are added up, and all tasks score candidates. Needs 3 labelled rows. What isn't given of the kernel's
    length and of the noise (as a share of the target's variance; the kernel's scale is then 1) is chosen by marginal likelihood, with the scale: LENGTHS, in units of the root of
    twice the features' summed variances, are all summed up in the same pass over the rows, and scale and noise follow from a length's sums.
    """
    data = labelled.select(vector_to_array(features).alias("x"), F.col(target).cast("double").alias("y")).where("y is not null")
    facts = data.agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.max(F.size("x")).alias("width")).first()
    if facts["n"] < 3:
        raise ValueError("a Gaussian process needs 3 labelled rows")
    mean, std, width = facts["mean"], facts["std"] or 1.0, facts["width"]
    spread = data.agg(*(F.var_pop(F.get("x", F.lit(i))) for i in range(width))).first()
    usual = float(np.sqrt(2 * sum(spread))) or 1.0
    lengths = [length] if length else [usual * u for u in LENGTHS]
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 1, (width, waves)), rng.uniform(0, 2 * np.pi, waves)

    def waved(x: pd.Series, scale: float) -> np.ndarray:
        return np.sqrt(2 / waves) * np.cos(np.stack(x.to_numpy()) @ w / scale + b)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(lengths), waves, waves + 1))
        for pdf in batches:
            y = (pdf["y"].to_numpy() - mean) / std
            for k, scale in enumerate(lengths):
                p = waved(pdf["x"], scale)
                total[k] += p.T @ np.c_[p, y]
        yield pd.DataFrame({"place": np.arange(total.size), "v": total.ravel()})

    sums = data.mapInPandas(products, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(len(lengths) * waves * (waves + 1))
    total[sums["place"].to_numpy()] = sums["v"].to_numpy()
    total, n = total.reshape(len(lengths), waves, waves + 1), facts["n"]
    square = float(n) if facts["std"] else 0.0
    found = [evidence(t[:, :waves], t[:, waves], square, n) for t in total]
    best = max(range(len(lengths)), key=lambda k: found[k][0])
    _, strength, own = found[best]
    if noise is not None:
        strength, own = 1.0, noise
    scale, total = lengths[best], total[best]
    chol = np.linalg.cholesky(total[:, :waves] + own / strength * np.eye(waves))
    weights = np.linalg.solve(chol.T, np.linalg.solve(chol, total[:, waves]))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            p = waved(v, scale)
            u = np.linalg.solve(chol, p.T)
            yield pd.DataFrame({"mu": p @ weights * std + mean, "sigma": np.sqrt(own * (1 + (u**2).sum(0))) * std})

    scored = candidates.withColumn("gp\x00", F.pandas_udf(score, "mu double, sigma double")(vector_to_array(features)))
    return scored.withColumns({"al_mu": F.col("gp\x00.mu"), "al_sigma": F.col("gp\x00.sigma")}).drop("gp\x00")


def recommend(candidates: DataFrame, key: str, kind: str = "ei", best: float | None = None, k: int = 10, maximise: bool = True, kappa: float = 2.0, xi: float = 0.01) -> DataFrame:
    """The ``k`` candidates (with al_mu, al_sigma) of highest acquisition, ties by key."""
    score = acquisition(kind, F.col("al_mu"), F.col("al_sigma"), best, kappa, xi, maximise)
    return candidates.withColumn("al_acq", score).orderBy(F.col("al_acq").desc(), key).limit(k)
