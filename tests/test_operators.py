"""Edge cases and invariants of operators."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from forgeframe.operators import clean as C
from forgeframe.operators import domain, models, splits
from forgeframe.operators import profile as P
from forgeframe.operators.select import assembled, principal_components
from forgeframe.sources import files, runs, synthetic


def test_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None), (1.0, 5.0)], "x double, y double")
    assert P.correlations(df).first().r is None
    assert P.describe(df.where("x > 5")).where("column = 'x'").first().n == 0
    assert C.fill_missing(df, "median").agg(F.sum("y")).first()[0] == 10.5
    assert C.treat_outliers(df, ["y"], "clip").where("y is null").count() == 1


def test_mode_ties(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (1.0,), (2.0,), (None,)], "v double")
    assert sorted(r.v for r in C.fill_missing(df, "mode").collect()) == [1, 1, 1, 2, 2]


def test_null_category(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "k int, c string")
    assert C.balance_categories(df, "c", "k", 1).count() == 2
    assert C.balance_categories(df, "c", "k", 1, keep_null=True).count() == 3


def test_first_present_value(spark):
    df = spark.createDataFrame([(1, 1, None, 1.0), (1, 2, 5, 3.0), (None, 3, 7, 2.0)], "k int, r int, v int, tg_c double")
    rows = {r.k: r for r in C.aggregate_by_keys(df, ["k"], "tg_c", "r").collect()}
    assert rows[1].v == 5 and rows[1].tg_c == 2.0 and rows[1].tg_rep_n == 2 and rows[None].v == 7


def test_bins(spark):
    def bins(values, q):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, y double")
        return [r.bin for r in splits.quantile_bins(df, "y", q).orderBy("i").collect()]

    assert bins([1, 2, 3, 4], 2) == [0, 0, 1, 1]
    assert bins([1, 1, 1, 2], 4) == [0, 0, 0, 1]


def test_splits_are_whole(spark):
    df = spark.range(103).withColumnRenamed("id", "k").withColumn("g", F.col("k") % 7)
    assert splits.random_split(df, "k").where("is_test").count() == 21
    sizes = [r["count"] for r in splits.folds(df, "k", 5).groupBy("fold").count().collect()]
    assert sum(sizes) == 103 and max(sizes) - min(sizes) <= 1
    assert splits.group_split(df, "g").groupBy("g").agg(F.countDistinct("is_test").alias("n")).where("n > 1").count() == 0
    assert splits.group_folds(df, "g", 3).groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert splits.curve_sizes(170) == [34, 53, 73, 92, 112, 131, 151, 170]


def test_ridge_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, [1, 5, 0.2], (200, 3))
    y = x @ [1.0, -2.0, 3.0] + rng.normal(0, 1, 200)
    df = assembled(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double"), ["a", "b", "c"])
    got = models.make("ridge", df, "y", alpha=10.0).fit(df).coefficients.toArray()
    z = x - x.mean(0)
    assert got == pytest.approx(np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean())), abs=1e-6)


def test_network_learns(spark):
    df = assembled(spark.range(200).select((F.col("id") / 100 - 1).alias("x")).withColumn("y", F.col("x") * 3 + 1), ["x"])
    model = models.Network("y", epochs=60).fit(df)
    assert model.history[-1] < 0.1 * model.history[0]
    assert model.transform(df).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.5


def test_hull(spark):
    rng = np.random.default_rng(1)
    p = [(float(a), float(b)) for a, b in rng.normal(0, 1, (300, 2))]
    assert sorted(domain.hull(spark.createDataFrame(p, "x double, y double"), "x", "y")) == sorted(domain.monotone_chain(sorted(p)))


def test_principal_components(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("a"), (F.col("id") * 2.0 + 1).alias("b"), F.rand(1).alias("c"))
    rows, scree = principal_components(df, ["a", "b", "c"], 2)
    assert rows.columns == ["k", "PC1", "PC2"] and scree.first().ratio > 0.6
    assert rows.agg(F.var_pop("PC1")).first()[0] == pytest.approx(scree.first().variance)


def test_known_truth(spark):
    t = synthetic.numeric(spark, 3000).dropna()
    x = ["fiber_volume_ratio", "cure_temperature_C", "cure_pressure_MPa", "porosity_percent"]
    others = ["fiber_orientation_deg", "resin_viscosity_Pa_s", "cure_time_min"]
    data = assembled(t, x + others)
    got = models.make("linear", data, "tensile_strength_MPa").fit(data).coefficients.toArray()
    assert got == pytest.approx([2500, 5, 200, -150, -2, 10, 0.5], rel=0.1)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    files.write_csv(df, str(tmp_path / "t.csv"))
    assert files.load(spark, str(tmp_path / "t.csv")).count() == 2
    two = df.toDF("k", "k2").select(F.col("k"), F.col("k2").alias("k"))
    assert files.unique_names(two).columns == ["k"]
    assert files.record_shards(spark.range(300), "id", 128).groupBy("shard").count().count() == 2


def test_runs(spark, tmp_path):
    name = runs.save_run(spark, str(tmp_path), {"model_name": "Ridge (a)", "r2": 0.5, "created_at": "2025-01-02 03:04:05", "params": {"alpha": 1}}, spark.createDataFrame([(1, 0.5)], "step int, mse double"))
    assert name == "20250102_030405_Ridge__a_"
    assert runs.list_runs(spark.read.parquet(f"{tmp_path}/runs")).first().params == {"alpha": "1"}
    assert "train(" in runs.training_script("ridge", ["a"], "y", {}, "t.csv")


def test_image_parts(spark):
    image = [[255, 255, 255, 255], [255, 10, 255, 255], [255, 255, 20, 255]]
    df = spark.createDataFrame([(image,)], "p array<array<int>>")
    assert df.select(files.crop(F.col("p"), files.gray_bounds(F.col("p")))).first()[0] == [[10, 255], [255, 20]]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="missing columns: b"):
        models.predict(None, spark.createDataFrame([(1.0,)], "a double"), ["a", "b"])
    with pytest.raises(ValueError):
        models.make("no such model", None, "y")
