"""Choosing a model's parameters: Parzen densities of good and other trials, or at random."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import scores
from .models import PREDICTION, validated, validation_sides
from .splits import folds

#: Random trials before densities are used, candidates of a step, and the share of trials that count as good.
STARTUP, CANDIDATES, GOOD = 10, 24, 0.15


@dataclass(frozen=True)
class Real:
    """A number between ``low`` and ``high``, on a logarithmic scale if ``log``."""

    low: float
    high: float
    log: bool = False

    def scaled(self, x):
        return np.log(x) if self.log else np.asarray(x, float)

    def value(self, y: float):
        return float(min(max(math.exp(y) if self.log else y, self.low), self.high))

    @property
    def ends(self) -> tuple[float, float]:
        return float(self.scaled(self.low)), float(self.scaled(self.high))


@dataclass(frozen=True)
class Whole(Real):
    """A whole number from ``low`` to ``high`` in steps of ``step``."""

    step: int = 1

    def value(self, y: float):
        x = math.exp(y) if self.log else y
        return int(min(max(self.low + self.step * round((x - self.low) / self.step), self.low), self.low + (self.high - self.low) // self.step * self.step))

    @property
    def ends(self) -> tuple[float, float]:
        return float(self.scaled(max(self.low - self.step / 2, 1e-9 if self.log else -math.inf))), float(self.scaled(self.high + self.step / 2))


@dataclass(frozen=True)
class Choice:
    """One of ``options``."""

    options: tuple


def _below(x: np.ndarray) -> np.ndarray:
    """The normal distribution function."""
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


class Density:
    """A mixture of normal densities, cut to [low, high]: one at each point, as wide as to its further neighbour, and a wide one over all."""

    def __init__(self, points: np.ndarray, low: float, high: float):
        wide = max(high - low, 1e-12)
        self.low, self.high = low, high
        order = np.sort(np.r_[points, (low + high) / 2])
        gaps = np.diff(np.r_[low, order, high])
        widths = np.clip(np.maximum(gaps[:-1], gaps[1:]), wide / min(100, len(order) + 1), wide)
        middle = np.searchsorted(order, (low + high) / 2)
        widths[middle] = wide
        self.at, self.width = order, widths
        self.mass = np.maximum(_below((high - order) / widths) - _below((low - order) / widths), 1e-12)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        which = rng.integers(len(self.at), size=n)
        out = rng.normal(self.at[which], self.width[which])
        while len(outside := np.flatnonzero((out < self.low) | (out > self.high))):
            out[outside] = rng.normal(self.at[which[outside]], self.width[which[outside]])
        return out

    def log(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.at) / self.width
        return np.log(np.maximum((np.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * self.width * self.mass)).mean(1), 1e-300))


@dataclass
class Parzen:
    """Suggests parameters from what trials have scored, larger being better; repeatable by ``seed``.

    The first STARTUP trials are random. Then, for each parameter by itself, CANDIDATES are drawn from the density of the good trials and the one
    whose density there is largest against that of the other trials is taken. Failed trials (null scores) come last, so they are never among the good ones while any succeeded.
    """

    space: dict[str, Real | Whole | Choice]
    seed: int = 42
    startup: int = STARTUP
    seen: list[tuple[dict, float]] = field(default_factory=list)

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)

    def random(self) -> dict:
        return {n: s.options[int(self.rng.integers(len(s.options)))] if isinstance(s, Choice) else s.value(self.rng.uniform(*s.ends)) for n, s in self.space.items()}

    def suggest(self) -> dict:
        succeeded = sum(score > -math.inf for _, score in self.seen)
        if len(self.seen) < self.startup or not succeeded:
            return self.random()
        ranked = sorted(self.seen, key=lambda t: -t[1])
        n = min(max(1, math.ceil(GOOD * len(ranked))), succeeded)
        good, rest = ranked[:n], ranked[n:]
        return {name: self._best(space, [p[name] for p, _ in good], [p[name] for p, _ in rest]) for name, space in self.space.items()}

    def _best(self, space, good: list, rest: list):
        if isinstance(space, Choice):
            share = [np.array([side.count(o) + 1 / len(space.options) for o in space.options]) for side in (good, rest)]
            share = [s / s.sum() for s in share]
            drawn = self.rng.choice(len(space.options), CANDIDATES, p=share[0])
            return space.options[int(max(drawn, key=lambda k: share[0][k] / share[1][k]))]
        one, other = (Density(space.scaled(np.array(side, float)), *space.ends) for side in (good, rest))
        drawn = one.draw(self.rng, CANDIDATES)
        return space.value(float(drawn[(one.log(drawn) - other.log(drawn)).argmax()]))

    def tell(self, params: dict, score: float | None) -> None:
        self.seen.append((params, -math.inf if score is None or math.isnan(score) else float(score)))


# Ranges of the parameters of models that are searched by default.
SPACES = {
    "ridge": {"alpha": Real(1e-4, 100.0, log=True)},
    "lasso": {"alpha": Real(1e-4, 100.0, log=True)},
    "elastic_net": {"alpha": Real(1e-4, 100.0, log=True), "l1_ratio": Real(0.1, 0.9)},
    "gbdt": {"maxIter": Whole(50, 300), "maxDepth": Whole(3, 10), "stepSize": Real(0.01, 0.3, log=True), "subsamplingRate": Real(0.6, 1.0)},
}


def search(df: DataFrame, columns: list[str], target: str, key: str, model: str, space: dict | None = None, trials: int = 10, k: int = 3, seed: int = 42, method: str = "parzen") -> DataFrame:
    """(trial, params, r2) by mean score of ``k`` folds, best first, failed trials (null) last.

    ``space`` names a Real, Whole or Choice for each parameter (a list counts as a choice); by default that of SPACES. ``method``: ``parzen`` or ``random``. Trials
    come one after the other, as each learns from those before; a trial's fits are Spark's. Rows are dealt to folds and standardised once for all trials.
    """
    space = {n: Choice(tuple(s)) if isinstance(s, (list, tuple)) else s for n, s in (space or SPACES[model]).items()}
    chooser, rows = Parzen(space, seed), []
    dealt = folds(df.where(F.col(target).isNotNull()), key, k, seed).cache()
    sides = validation_sides(dealt, columns, ["fold"], target)
    for trial in range(trials):
        params = chooser.random() if method == "random" else chooser.suggest()
        try:
            by_fold = scores(validated(sides, target, key, ["fold"], model, seed, **params), target, PREDICTION, ["fold"])
            score = by_fold.agg(F.avg("r2")).first()[0]
        except (ArithmeticError, ValueError, np.linalg.LinAlgError, PySparkException, Py4JJavaError):
            score = None
        chooser.tell(params, score)
        rows.append((trial, json.dumps(params, sort_keys=True), score))
    dealt.unpersist()
    return df.sparkSession.createDataFrame(rows, "trial int, params string, r2 double").orderBy(F.col("r2").desc_nulls_last(), "trial")
