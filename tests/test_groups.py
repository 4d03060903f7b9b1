"""Quantiles of groups, medians of hot keys, columns for values, against plain programs."""

import math
import statistics

import numpy as np
import pytest

from forgeframe.operators import clean, profile, quantiles


def quantile(values, p):
    v = sorted(values)
    place = (len(v) - 1) * p
    a, b = v[math.floor(place)], v[math.ceil(place)]
    return a if a == b else a + (b - a) * (place - math.floor(place))


@pytest.mark.parametrize("size", [50_000, 40, 3])
def test_group_quantiles(spark, monkeypatch, size):
    monkeypatch.setattr(quantiles, "RANGE_VALUES", size)
    rng = np.random.default_rng(0)
    rows = [("hot", 1, float(v)) for v in rng.normal(size=400)] + [("same", 1, 5.0)] * 150 + [(None, 2, float(v)) for v in rng.integers(0, 9, 100)] + [(f"g{i}", None, float(i)) for i in range(60)]
    rows += [("none", 1, None), ("none", 1, float("nan")), ("inf", 1, float("-inf")), ("inf", 1, 1.0), ("inf", 1, 2.0), ("hot", 1, None)]
    df = spark.createDataFrame(rows, "a string, b int, v double").repartition(4)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.a, r.b): list(r)[2:] for r in quantiles.group_quantiles(df, "v", shares, ["a", "b"]).collect()}
    groups = {}
    for a, b, v in rows:
        groups.setdefault((a, b), []).extend([v] if v is not None and not math.isnan(v) else [])
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        assert got[key] == ([None] * 5 if not values else pytest.approx([quantile(values, p) for p in shares], nan_ok=True)), key


@pytest.mark.parametrize("small", [0, 8 << 20])
def test_small_tables_give_the_same(spark, monkeypatch, tmp_path, small):
    monkeypatch.setattr(quantiles, "SMALL_BYTES", small)
    rng = np.random.default_rng(4)
    rows = [(str(i % 3) if i % 7 else None, float(v), None if i % 5 == 0 else int(v * 10), float("nan") if i % 2 else None) for i, v in enumerate(rng.normal(size=200))]
    spark.createDataFrame(rows, "g string, v double, n int, none double").write.parquet(str(tmp_path / "t"))
    df, shares = spark.read.parquet(str(tmp_path / "t")), [0.0, 0.1, 0.5, 0.77, 1.0]
    want = {("v",): [quantile([r[1] for r in rows], p) for p in shares], ("n",): [quantile([r[2] for r in rows if r[2] is not None], p) for p in shares], ("none",): [None] * 5}
    assert quantiles.quantiles(df, ["v", "n", "none"], shares) == {k: pytest.approx(v) for k, v in want.items()}
    groups = {r.g: list(r)[1:] for r in quantiles.group_quantiles(df, "v", shares, ["g"]).collect()}
    assert groups == {g: pytest.approx([quantile([r[1] for r in rows if r[0] == g], p) for p in shares]) for g in ("0", "1", "2", None)}
    endless = df.withColumn("v", quantiles.F.when(quantiles.F.col("v") > 1, float("inf")).otherwise(quantiles.F.col("v")))
    assert quantiles.quantiles(endless, ["v"], [1.0, 0.0]) == {("v",): [float("inf"), min(r[1] for r in rows)]}


def test_box_statistics_of_many_groups(spark, capsys):
    df = spark.createDataFrame([(i % 50, float((i * 37) % 101)) for i in range(2000)], "g int, v double")
    out = profile.box_statistics(df, "v", ["g"])
    for r in out.where("g < 5").collect():
        values = [float((i * 37) % 101) for i in range(2000) if i % 50 == r.g]
        assert [r.q25, r.q50, r.q75] == [quantile(values, p) for p in (0.25, 0.5, 0.75)]


@pytest.mark.parametrize("held", [100_000, 20, 0])
def test_medians_of_hot_keys(spark, monkeypatch, held):
    monkeypatch.setattr(clean, "HELD", held)
    rng = np.random.default_rng(1)
    rows = [(k, x, i, float(v) if v % 5 else None, "n" if i % 3 else None) for i, (k, x, v) in enumerate(zip(rng.choice(["a", "b", "c", None], 200, p=[0.7, 0.1, 0.1, 0.1]), rng.integers(0, 2, 200).tolist(), rng.integers(0, 50, 200).tolist(), strict=True))]
    rows = [(None if k is None else str(k), x, i, v, o) for k, x, i, v, o in rows]
    df = spark.createDataFrame(rows, "k string, x int, i int, y double, o string")
    groups = {}
    for k, x, i, v, o in rows:
        groups.setdefault((k, x), []).append((i, v, o))
    for drop in (True, False):
        got = {(r.k, r.x): (r.y, r.y_rep_n, r.i, r.o) for r in clean.aggregate_by_keys(df, ["k", "x"], "y", "i", drop_null=drop).collect()}
        want = {key: (statistics.median([v for _, v, _ in g if v is not None]), sum(v is not None for _, v, _ in g), g[0][0], next((o for _, _, o in g if o is not None), None)) for key, g in groups.items() if any(v is not None for _, v, _ in g)}
        assert {x: v for x, v in got.items() if x in want} == want and (not drop or got.keys() == want.keys())


def test_columns_for_values(spark):
    df = spark.createDataFrame([(i, f"v{i % 30:02}" if i % 7 else None) for i in range(100)], "i int, c string")
    assert clean.one_hot(df, "c", most=30).columns == ["i", *(f"c_v{k:02}" for k in range(30))]
    with pytest.raises(ValueError, match="one_hot_index"):
        clean.one_hot(df, "c", most=29)
    given = clean.one_hot(df, "c", most=1, values=["v03", "zz"], as_int=True, with_null=True)
    assert given.columns == ["i", "c_v03", "c_zz", "c_nan"] and sum(r.c_v03 for r in given.collect()) == sum(i % 30 == 3 and i % 7 > 0 for i in range(100))
    assert clean.one_hot(df, "c", values=[f"x{k}" for k in range(1500)]).columns[-1] == "c_x1499"
    assert {r.i: r["index"] for r in clean.one_hot_index(df, "c").collect()} == {i: i % 30 if i % 7 else None for i in range(100)}


def test_many_shares_take_one_search_a_value(spark, monkeypatch):
    """A value finds its range by search, not by a comparison with each; all ranges of a pass share a bounded number of parts."""
    import numpy as np

    monkeypatch.setattr(quantiles, "SMALL_BYTES", 0)
    monkeypatch.setattr(quantiles, "FEW", 6)
    rng = np.random.default_rng(3)
    v, w = np.r_[rng.normal(size=1500), -1e9, 3e12, np.zeros(200)], rng.integers(0, 40, 1702).astype(float)
    rows = [(*pair,) for pair in zip(v.tolist(), w.tolist(), strict=True)] + [(None, float("nan")), (float("nan"), None)]
    df = spark.createDataFrame(rows, "v double, w double").repartition(3)
    passes, plain = [], quantiles._tallies

    def tallies(ranges, bins):
        passes.append((len(ranges), bins))
        return plain(ranges, bins)

    monkeypatch.setattr(quantiles, "_tallies", tallies)
    shares = [k / 100 for k in range(101)]
    got = quantiles.quantiles(df, ["v", "w"], shares)
    assert got[("v",)] == pytest.approx(np.quantile(v, shares).tolist()) and got[("w",)] == pytest.approx(np.quantile(w, shares).tolist())
    assert len(passes) > 2 and all(n * bins <= max(2 * quantiles.ALL_RANGES, n * quantiles.LEAST_RANGES) for n, bins in passes)
