"""Example tables whose truth is known, made by Spark from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The structures of the example resins.
RESINS = [
    "C1=CC=C(C=C1)C(C2=CC=C(C=C2)O)C",
    "C1=CC=C(C=C1)C(C)(C)C2=CC=C(C=C2)O",
    "C1C(O1)CO.C1=CC(=CC=C1C(C2=CC=C(C=C2)O)C3=CC=C(C=C3)O)O",
    "C(C(F)(F)F)OC1=CC=C(C=C1)C=C",
    "C1=CC=C2C(=C1)C(=O)NC2=O",
]


def _uniform(low: float, high: float, seed: int) -> Column:
    return F.rand(seed) * (high - low) + low


def hybrid(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """Process variables, a resin and its strength (S04); a twentieth of two variables is missing."""
    t = spark.range(n).select(
        F.col("id").alias("__rid"),
        _uniform(0.5, 0.7, seed).alias("fiber_volume_ratio"), _uniform(120, 180, seed + 1).alias("cure_temperature_C"), _uniform(0.5, 1.5, seed + 2).alias("cure_pressure_MPa"),
        _uniform(0.1, 3.0, seed + 3).alias("porosity_percent"), F.floor(F.rand(seed + 4) * len(RESINS)).cast("int").alias("resin"), F.randn(seed + 5).alias("noise"),
    )
    y = 2500 * F.col("fiber_volume_ratio") + 5 * F.col("cure_temperature_C") + 200 * F.col("cure_pressure_MPa") - 150 * F.col("porosity_percent") + 100 * (F.col("resin") + 1) + 80 * F.col("noise")
    t = t.withColumns({"tensile_strength_MPa": y, "resin_smiles": F.get(F.array(*map(F.lit, RESINS)), F.col("resin"))})
    return _with_holes(t.drop("resin", "noise"), 20)


def numeric(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """Seven variables and two targets (S05); some three percent of two variables are missing."""
    ranges = {"fiber_volume_ratio": (0.5, 0.7), "cure_temperature_C": (120, 180), "cure_pressure_MPa": (0.5, 1.5), "porosity_percent": (0.1, 3.0), "fiber_orientation_deg": (0, 90), "resin_viscosity_Pa_s": (0.1, 10), "cure_time_min": (30, 180)}
    t = spark.range(n).select(F.col("id").alias("__rid"), *[_uniform(a, b, seed + i).alias(c) for i, (c, (a, b)) in enumerate(ranges.items())], F.randn(seed + 8).alias("e1"), F.randn(seed + 9).alias("e2"))
    weights = {"fiber_volume_ratio": 2500, "cure_temperature_C": 5, "cure_pressure_MPa": 200, "porosity_percent": -150, "fiber_orientation_deg": -2, "resin_viscosity_Pa_s": 10, "cure_time_min": 0.5}
    strength = sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0)) + 50 * F.col("e1")
    modulus = 150 * F.col("fiber_volume_ratio") + 0.1 * F.col("cure_temperature_C") - 5 * F.col("porosity_percent") + 5 * F.col("e2")
    return _with_holes(t.withColumns({"tensile_strength_MPa": strength, "elastic_modulus_GPa": modulus}).drop("e1", "e2"), 33)


def _with_holes(t: DataFrame, one_in: int) -> DataFrame:
    def hole(c: str, salt: int) -> Column:
        return F.when(F.pmod(F.xxhash64("__rid", F.lit(salt)), F.lit(one_in)) != 0, F.col(c))

    return t.withColumns({"cure_temperature_C": hole("cure_temperature_C", 1), "porosity_percent": hole("porosity_percent", 2)})
