"""The variational autoencoder: its gradient, its training against a plain program, and what its rows keep."""

import numpy as np
import pytest

from forgeframe.operators import cluster, generative

RNG = np.random.default_rng(7)


def rows_of_parity(n):
    """Two random bits and whether they differ, each in four columns: no two of the three are correlated."""
    a, b = RNG.integers(0, 2, n), RNG.integers(0, 2, n)
    return np.repeat(np.c_[a, b, a ^ b], 4, axis=1) * 10.0 + 5


def kept(rows):
    bits = np.array([list(r) for r in rows])
    assert bits.min() >= 5 and bits.max() <= 15
    bits = bits.reshape(len(bits), 3, 4).mean(2) > 10
    assert 0.25 < bits[:, 0].mean() < 0.75 and 0.25 < bits[:, 1].mean() < 0.75
    return (bits[:, 0] ^ bits[:, 1] == bits[:, 2]).mean()


def test_gradient():
    sizes = generative.shapes(3, 2, 8)
    flat = generative.initial(sizes, 1)["weights"].astype(float)
    x, noise = RNG.random((5, 3)), RNG.normal(size=(5, 2))
    slope, waste = np.zeros_like(flat), np.zeros_like(flat)
    generative.gradient(x, noise, generative.layers(flat, sizes), generative.layers(slope, sizes))

    def loss(weights):
        net = generative.layers(weights, sizes)
        h = np.maximum(np.maximum(x @ net[0][0] + net[0][1], 0) @ net[1][0] + net[1][1], 0)
        mu, log = np.split(h @ net[2][0] + net[2][1], 2, axis=1)
        y = generative.decoded(mu + noise * np.exp(log / 2), net)[-1]
        return ((y - x) ** 2).sum() - 0.5 * (1 + log - mu**2 - np.exp(log)).sum()

    assert generative.gradient(x, noise, generative.layers(flat, sizes), generative.layers(waste, sizes)) == pytest.approx(loss(flat))
    for i in range(0, len(flat), 3):
        step = np.eye(1, len(flat), i)[0] * 1e-6
        assert slope[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-6)


def test_one_shard_is_a_plain_loop():
    """Adam as published, batch after batch, the last one short."""
    sizes, x = generative.shapes(3, 2, 8), RNG.random((37, 3)).astype(np.float32)
    state = generative.initial(sizes, 3)
    got, _, steps = generative.trained(x, state, sizes, 2, range(4), 10, 0.01, 5, 0, 0)
    w, m, v, t = state["weights"].astype(float), 0.0, 0.0, 0
    for epoch in range(4):
        rng = np.random.default_rng([5, epoch, 0])
        order, noise = rng.permutation(37), rng.standard_normal((37, 2), dtype=np.float32)
        for at in range(0, 37, 10):
            g = np.zeros_like(w)
            generative.gradient(x[order][at : at + 10].astype(float), noise[at : at + 10].astype(float), generative.layers(w, sizes), generative.layers(g, sizes))
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert steps == t == 16 and got["weights"] == pytest.approx(w, abs=1e-4)


@pytest.mark.parametrize("shard", [1 << 14, 700])
def test_rows_keep_what_no_correlation_shows(spark, monkeypatch, shard):
    monkeypatch.setattr(generative, "SHARD", shard)
    data, names = rows_of_parity(2000), [f"c{j}" for j in range(12)]
    df = spark.createDataFrame([*map(tuple, data.tolist()), (None, *[1e9] * 11), (float("nan"), *[1e9] * 11)], ", ".join(f"{c} double" for c in names))
    history = []
    rows = cluster.augment(df, names, 400, epochs=60, rate=3e-3, history=history).collect()
    assert len(rows) == 400 and kept(rows) > 0.85
    assert len(history) == (1 if shard > 2000 else 60) and history[-1] < 3


def test_shards_take_all_rows_whatever_the_files(spark, monkeypatch):
    monkeypatch.setattr(generative, "SHARD", 100)
    monkeypatch.setattr(generative, "NEAR", 2)
    values = [(float(i % 7), 2.5) for i in range(900)] + [(float(i), -1.0) for i in range(100)] + [(None, 0.0)]
    low, span = np.array([0.0, -1.0]), np.array([99.0, 3.5])
    found = []
    for parts in (1, 5):
        df = spark.createDataFrame(values, "a double, b double").repartition(parts)
        packed, shards, tasks = generative._shards(df.dropna(), ["a", "b"], 1000, low, span)
        assert (shards, tasks) == (10, 2)
        found.append({r.shard: np.frombuffer(bytes(r.data), np.float32).reshape(-1, 2) for r in packed.collect()})
    assert found[0].keys() == found[1].keys() and all((found[0][k] == found[1][k]).all() for k in found[0])
    rows = np.concatenate([*found[0].values()]) * span + low
    assert sorted(map(tuple, rows.round(3).tolist())) == sorted(v for v in values if v[0] is not None)
    assert all(70 < len(x) < 130 for x in found[0].values())
    first, again = ([tuple(r) for r in cluster.augment(spark.createDataFrame(values, "a double, b double").repartition(parts), ["a", "b"], 5000, epochs=2).collect()] for parts in (1, 5))
    assert first == again and len(first) == 5000


def test_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 2.0)], "a double, b double")
    assert all(1 <= r.a <= 2 and 3 <= r.b <= 4 for r in cluster.augment(df, ["a", "b"], 3, epochs=2).collect())
    for bad in ([(None, 1.0)], [(float("inf"), 1.0), (1.0, 1.0)]):
        with pytest.raises(ValueError):
            cluster.augment(spark.createDataFrame(bad, "a double, b double"), ["a", "b"], 3)
