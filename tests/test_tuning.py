"""The search for parameters, and the fitted kernel, against known functions and exact programs."""

import math

import numpy as np
import pytest

from forgeframe.operators import active, tuning
from forgeframe.operators.select import assembled
from forgeframe.operators.tuning import Choice, Parzen, Real, Whole

SPACE = {"x": Real(-2, 2), "y": Real(1e-5, 10, log=True), "n": Whole(2, 30, step=2), "c": Choice(("a", "b", "c"))}


def score(p):
    return -((p["x"] - 0.3) ** 2) - (math.log10(p["y"]) + 2) ** 2 / 4 - ((p["n"] - 8) / 10) ** 2 - (p["c"] != "b")


def best(seed, method, trials=40):
    chooser = Parzen(SPACE, seed)
    for _ in range(trials):
        p = chooser.random() if method == "random" else chooser.suggest()
        assert -2 <= p["x"] <= 2 and 1e-5 <= p["y"] <= 10 and p["n"] in range(2, 31, 2) and p["c"] in "abc"
        chooser.tell(p, score(p))
    return max(s for _, s in chooser.seen)


def test_better_than_random():
    pairs = [(best(s, "parzen"), best(s, "random")) for s in range(20)]
    assert np.mean([a for a, _ in pairs]) > np.mean([b for _, b in pairs]) and sum(a > b for a, b in pairs) >= 15


def test_failures_and_seeds():
    def run(seed):
        chooser = Parzen(SPACE, seed)
        for _ in range(30):
            p = chooser.suggest()
            chooser.tell(p, None if p["c"] == "a" else float("nan") if p["x"] > 1.5 else score(p))
        return chooser.seen

    assert run(1) == run(1) != run(2)
    assert sum(p["c"] == "a" for p, _ in run(1)[20:]) <= 3
    only = Parzen(SPACE, 3)
    for _ in range(15):
        only.tell(only.suggest(), None)
    assert len(only.seen) == 15


def test_density():
    d = tuning.Density(np.array([0.2, 0.25, 0.9]), 0, 1)
    grid = np.linspace(0, 1, 4001)
    assert np.trapezoid(np.exp(d.log(grid)), grid) == pytest.approx(1, abs=1e-3)
    drawn = d.draw(np.random.default_rng(0), 4000)
    assert drawn.min() >= 0 and drawn.max() <= 1 and abs((drawn < 0.5).mean() - np.trapezoid(np.exp(d.log(grid[:2001])), grid[:2001])) < 0.03


def test_search_in_spark(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(2 * a - b + e)) for i, ((a, b), e) in enumerate(zip(x, rng.normal(size=120) * 0.1, strict=True))], "id long, a double, b double, y double")
    rows = tuning.search(df, ["a", "b"], "y", "id", "decision_tree", {"maxDepth": [0, 2, 4], "minInstancesPerNode": Whole(0, 8, step=8)}, trials=6, k=2).collect()
    assert len(rows) == 6 and [r.r2 for r in rows if r.r2 is not None] == sorted((r.r2 for r in rows if r.r2 is not None), reverse=True)
    assert all(r.r2 is None for r in rows if '"minInstancesPerNode": 0' in r.params) and any(r.r2 is None for r in rows) and rows[-1].r2 is None


def exact(x, y, at, length, scale, noise):
    k = lambda a, b: scale * np.exp(-((a[:, None] - b) ** 2).sum(2) / (2 * length**2))
    inner = np.linalg.inv(k(x, x) + noise * np.eye(len(x)))
    return k(at, x) @ inner @ y, np.sqrt(np.maximum(scale + noise - np.einsum("ij,jk,ik->i", k(at, x), inner, k(at, x)), 0))


def test_fitted_kernel_near_an_exact_process(spark):
    """Without a given length: near the process whose length, scale and noise are the best of a fine grid by its own likelihood."""
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, (200, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + rng.normal(size=200) * 0.1
    z = (y - y.mean()) / y.std()
    best = None
    for length in np.geomspace(0.2, 8, 25):
        gram = np.exp(-((x[:, None] - x) ** 2).sum(2) / (2 * length**2))
        values, vectors = np.linalg.eigh(gram)
        along = (vectors.T @ z) ** 2
        for ratio in np.geomspace(1, 1e5, 26):
            spread = 1 + ratio * np.maximum(values, 0)
            noise = (along / spread).mean()
            likelihood = -0.5 * (200 * np.log(noise) + np.log(spread).sum())
            if best is None or likelihood > best[0]:
                best = (likelihood, length, ratio * noise, noise)
    at = rng.uniform(-1.8, 1.8, (60, 2))
    mu, sigma = exact(x, z, at, *best[1:])
    labelled = assembled(spark.createDataFrame([(*map(float, p), float(v)) for p, v in zip(x, y, strict=True)], "a double, b double, y double"), ["a", "b"])
    asked = assembled(spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)], "k int, a double, b double"), ["a", "b"])
    rows = active.gaussian_process(labelled, asked, "y", waves=256).orderBy("k").collect()
    got_mu, got_sigma = ((np.array([r[c] for r in rows]) - m) / y.std() for c, m in (("al_mu", y.mean()), ("al_sigma", 0)))
    assert np.abs(got_mu - mu).max() < 0.15 and np.sqrt(((got_mu - mu) ** 2).mean()) < 0.05
    assert np.abs(got_sigma / sigma - 1).mean() < 0.25
    far = assembled(spark.createDataFrame([(9.0, -9.0), (0.0, 0.0)], "a double, b double"), ["a", "b"])
    out = active.gaussian_process(labelled, far, "y").orderBy("a").collect()
    assert out[1].al_sigma > 3 * out[0].al_sigma


def test_evidence_finds_the_noise():
    rng = np.random.default_rng(0)
    phi = rng.normal(size=(2000, 20)) / np.sqrt(20)
    y = phi @ rng.normal(size=20) * 2 + rng.normal(size=2000) * 0.3
    _, scale, noise = active.evidence(phi.T @ phi, phi.T @ y, float(y @ y), 2000)
    assert noise == pytest.approx(0.09, rel=0.1) and 1.5 < scale < 8


def test_search_deals_its_folds_once(spark, monkeypatch):
    df = spark.range(60).selectExpr("id", "cast(id * 7 % 11 AS double) AS a", "id * 7 % 11 + sin(id) AS y")
    dealt, plain = [], tuning.folds
    monkeypatch.setattr(tuning, "folds", lambda *a: dealt.append(1) or plain(*a))
    found = tuning.search(df, ["a"], "y", "id", "elastic_net", trials=2).collect()
    assert len(dealt) == 1 and len(found) == 2 and all(r.r2 is not None for r in found)
