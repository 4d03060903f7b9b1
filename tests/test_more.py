"""Sources, streams, quantiles and ranks."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from forgeframe.functions import physics, predictions
from forgeframe.operators import active, clean, metrics, models, profile, splits, structures
from forgeframe.operators.quantiles import quantiles
from forgeframe.operators.select import assembled, by_name
from forgeframe.sources import files, runs
from forgeframe.streaming.scoring import scored_stream


def linear(values, share):
    values = sorted(v for v in values if v is not None and v == v)
    if not values:
        return None
    place = (len(values) - 1) * share
    a, b = values[int(np.floor(place))], values[int(np.ceil(place))]
    return a if a == b else a + (b - a) * (place - np.floor(place))


@pytest.mark.parametrize("seed", range(4))
def test_quantiles(spark, seed, monkeypatch):
    from forgeframe.operators import quantiles as Q

    monkeypatch.setattr(Q, "RANGES", 4)
    monkeypatch.setattr(Q, "FEW", 5)
    rng = np.random.default_rng(seed)
    x = [None if rng.random() < 0.1 else float(v) for v in rng.normal(size=300) * 10.0 ** rng.integers(-5, 30, 300)]
    y = [float(v) for v in rng.integers(0, 3, 300)]
    y[:6] = [float("inf"), float("inf"), float("-inf"), float("nan"), 1.0, 1.0]
    g = [None if i % 7 == 0 else "ab"[i % 2] for i in range(300)]
    df = spark.createDataFrame(list(zip(g, x, y, strict=True)), "g string, x double, y double")
    shares = [0.0, 0.005, 0.25, 0.5, 0.9, 0.999, 1.0]
    whole = quantiles(df, ["x", "y"], shares)
    for c, values in (("x", x), ("y", y)):
        assert whole[(c,)] == [pytest.approx(linear(values, p), nan_ok=True) for p in shares]
    parts = quantiles(df, ["x"], shares, ["g"])
    for k in (None, "a", "b"):
        assert parts[("x", k)] == [pytest.approx(linear([v for v, h in zip(x, g, strict=True) if h == k], p)) for p in shares]
    assert quantiles(df.where("x > 1e300"), ["x"], [0.5]) == {("x",): [None]}


def test_ranks_in_categories(spark, monkeypatch):
    monkeypatch.setattr(clean, "RANGE_ROWS", 1)
    df = spark.range(700).select("id", F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("g"))
    rows = clean.hash_ranked(df, "id", by="g").join(df.withColumn("h", clean.hash_order("id")).select("id", "h"), "id").collect()
    for g in (None, 0, 1, 2):
        own = sorted((r for r in rows if r.g == g), key=lambda r: r.h)
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and own


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=8), st.integers(1, 6))
def test_groups_are_dealt_as_one_by_one(sizes, k):
    load, dealt = [0] * k, [0] * k
    for size in sorted(sizes, reverse=True):
        for _ in range(sizes[size]):
            fold = min(range(k), key=lambda i: (load[i], i))
            load[fold] += size
    for size, first, end, fold in splits.dealt(sizes, k):
        dealt[fold] += size * (end - first)
    assert max(dealt) - min(dealt) <= max(max(load) - min(load), max(sizes)) and sum(dealt) == sum(load)
    for size, n in sizes.items():
        ranks = sorted((a, b) for s, a, b, _ in splits.dealt(sizes, k) if s == size)
        assert ranks[0][0] == 0 and ranks[-1][1] == n and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:], strict=False))


def test_json_and_images(spark, tmp_path):
    files.write_json(spark.createDataFrame([(1, "структура")], "k int, s string"), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first().s == "структура"
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.png").write_bytes(b"abc")
    (tmp_path / "i" / "b.txt").write_bytes(b"abc")
    (row,) = files.images(spark, f"{tmp_path}/i", "*.png").collect()
    assert row.length == 3 and bytes(row.content) == b"abc"


def test_models_are_kept(spark, tmp_path):
    df = spark.range(20).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("y"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")]).fit(df)
    runs.save_model(spark, model, f"{tmp_path}/m", ["x"], "y", {"r2": 1.0})
    again, facts = runs.load_model(spark, f"{tmp_path}/m")
    assert facts["feature_cols"] == ["x"] and again.transform(df).where("abs(prediction - y) > 1e-6").count() == 0
    files_ = spark.createDataFrame([("b", b"1"), ("a", b"1"), ("c", b"2")], "path string, content binary")
    assert sorted(r.path for r in runs.content_ids(files_).collect()) == ["a", "c"]
    df.write.parquet(f"{tmp_path}/in")
    scored_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), again, f"{tmp_path}/out", f"{tmp_path}/check", once=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where("abs(prediction - y) < 1e-6").count() == 20
    assert models.FEATURES == "features" and metrics.model_history(again.stages[-1]) is not None


def test_metadata_files(spark, tmp_path):
    for name, text in (("20250101_a", json.dumps({"model_name": "A", "r2": 0.5})), ("20250102_b", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(text)
    (row,) = runs.read_metadata(spark, f"{tmp_path}/*/metadata.json").collect()
    assert (row.run_id, row.model_name, row.r2) == ("20250101_a", "A", 0.5)


def test_steps(spark):
    t = runs.Tracker()
    t.log("drop", before=spark.range(1), after=spark.range(1).withColumn("b", F.lit(1)))
    assert t.last()["features_added"] == ["b"] and json.loads(runs.steps_json(t.table(spark)).first().json)["operation"] == "drop"
    t.clear()
    assert t.last() is None
    compile(runs.training_script("ridge", ["a"], "y", {"alpha": 1.0}, "t.csv"), "script", "exec")


def test_history(spark):
    df = assembled(spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 3.0).alias("y")), ["x"])
    assert len(metrics.model_history(models.Network("y", epochs=3).fit(df))) == 3
    assert metrics.model_history(object()) == []


def test_small_rules(spark):
    assert profile.missing_strategy("XGBoost") == "model_native" and profile.missing_strategy("ridge") == "median"
    df = spark.createDataFrame([("1.5", float("inf")), ("x", 2.0), (None, float("nan"))], "a string, b double")
    assert [tuple(r) for r in clean.finite_numbers(df, ["a", "b"]).collect()] == [(1.5, None), (None, 2.0), (None, None)]
    assert by_name(df, ["b"]).columns == ["b"] and by_name(df).columns == ["a", "b"]
    v = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    assert v.select(structures.mean_pooled(F.col("t"), F.col("m"))).first()[0] == [2.0, 3.0]
    n = spark.createDataFrame([(0.5,), (2.0,), (-1.0,), (None,), (float("nan"),)], "r double")
    assert [r[0] for r in n.select(physics.largest_conversion(F.col("r"))).collect()] == [0.5, 0.5, 1.0, 1.0, 1.0]
    assert [r[0] for r in n.select(physics.finite_or_zero(F.col("r"))).collect()] == [0.5, 2.0, -1.0, 0.0, 0.0]


def test_key_names(spark):
    df = spark.createDataFrame([("1",), (" 166 ",), ("0",), ("-3",), ("1.5",), (None,), ("x",)], "k string")
    assert [r[0] for r in df.select(predictions.key_description(F.col("k"))).collect()] == ["ISOTOPE", "Fragments", "Unknown Fragment", "Unknown Fragment", "Invalid Key", "Invalid Key", "Invalid Key"]


def test_gaussian_process(spark):
    """Near the exact process on a smooth curve, and surer among measured rows than far from them."""
    data = assembled(spark.range(200).select((F.col("id") / 50 - 2).alias("x")).withColumn("y", F.sin(F.col("x") * 2)), ["x"])
    far = assembled(spark.createDataFrame([(0.01, 0.02), (6.0, 0.0)], "x double, y double"), ["x"])
    out = active.gaussian_process(data, far, "y", length=1.0, noise=1e-3).orderBy("x").collect()
    assert out[0].al_mu == pytest.approx(0.02, abs=0.02) and out[1].al_sigma > 5 * out[0].al_sigma


def test_history_of_boosted_trees(spark):
    data = assembled(spark.range(80).select((F.col("id") % 9).cast("double").alias("x")).withColumn("y", F.col("x") * F.col("x")), ["x"])
    fitted = models.make("gbdt", data, "y", maxIter=4, maxDepth=2).fit(data)
    found, total = metrics.model_history(fitted, data), 0.0
    for k, (tree, weight) in enumerate(zip(fitted.trees, fitted.treeWeights, strict=True)):
        data = tree.setPredictionCol(f"p{k}").transform(data)
        total = total + F.col(f"p{k}") * weight
        assert found[k] == pytest.approx(data.agg(F.avg((F.col("y") - total) ** 2)).first()[0])
    assert len(found) == 4 and metrics.model_history(fitted) == []


def test_training_script_runs(spark, tmp_path, capsys):
    spark.range(60).selectExpr("id AS a", "id % 7 AS b", "3 * id - id % 7 AS y").coalesce(1).write.option("header", True).csv(str(tmp_path / "data.csv"))
    exec(compile(runs.training_script("linear", ["a", "b"], "y", {}, str(tmp_path / "data.csv")), "script", "exec"), {})
    assert "r2" in capsys.readouterr().out


@pytest.mark.parametrize("by", [None, "g"])
def test_ranking_sends_no_rows_to_the_driver(spark, by):
    """Rows of a table that seems small meet the counts of their ranges without being broadcast."""
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    ranked = clean.hash_ranked(df, "id", by=by)
    plan = ranked._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan
    counts = {}
    for r in ranked.collect():
        counts.setdefault(r.g if by else None, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in counts.values()) and sum(map(len, counts.values())) == 500
