"""Golden cases of string and numeric expressions."""

import pytest
from pyspark.sql import functions as F

from forgeframe.functions import physics as N
from forgeframe.functions import text as X
from forgeframe.operators.structures import graph_features


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.select(column(F.col("v")).alias("x"), "i").orderBy("i").collect()]


def test_numbers(spark):
    assert values(spark, X.first_number, ["80 wt%", "25°C", "1.2e3 MPa", "—", "x-80 wt%", None, ""]) == [80, 25, 1200, None, -80, None, None]
    assert values(spark, X.fraction, ["80 wt%", "0.2", "1"]) == [0.8, 0.2, 1.0]
    assert values(spark, X.plain_number, ["12", " 1.5e2 ", "1d", "inf", None]) == [12, 150, None, None, None]


def test_components(spark):
    assert values(spark, X.split_fragments, ["A;B | C + D.E", None, "  "]) == [["A", "B", "C", "D", "E"], [], []]
    assert values(spark, X.clean_raw, [" 'CCO' ", "N/A", "nan", "", None, "'", '"a"']) == ["CCO", None, None, None, None, None, "a"]
    assert values(spark, X.composition_key, [["b", "a", "b"], []], "array<string>") == ["a.b", None]
    assert values(spark, lambda c: X.formulation_key(c, c), [None]) == ["nan||nan"]
    assert values(spark, X.confidence_weight, ["high", "medium", "low", "0.45", "7", None]) == [1.0, 0.6, 0.3, 0.45, 0.6, 0.6]
    assert [tuple(v) for v in values(spark, X.filler_properties, ["Nano-Silica", "unknownium"])] == [(70.0, 2.2), (200.0, 2.5)]
    assert values(spark, X.decode_tokens, ["C!=CC$"]) == ["C1=CC2"]
    assert values(spark, X.encode_tokens, ["R21Cl2"]) == ["R $ ! Cl 2"]


def test_physics(spark):
    assert values(spark, N.largest_conversion, [1.0, 0.5, 2.0, -1.0, None, float("nan")], "double") == [1, 0.5, 0.5, 1, 1, 1]
    assert values(spark, lambda a: N.glass_transition(250, 450, 0.4, a), [0.0, 1.0], "double") == [250, 450]
    assert values(spark, lambda v: N.composite_modulus(3, 70, 2, v), [0.0], "double") == [3]
    assert values(spark, lambda v: N.stoichiometry(v * 2, 2, 120, 4, F.lit(4.0), "r/h"), [170.0], "double")[0].theoretical_phr == pytest.approx(17.647059)
    assert values(spark, N.clamp, [None, -1.0, 2.0], "double") == [None, 0, 1]


def test_structures(spark):
    texts = ["C1OC1", "CCO", "NCCN", "c1ccccc1", "C1CC", "C(", "", None, "C)", "Xx"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    facts = {r.s: r for r in graph_features(df, "s").collect()}
    assert (facts["C1OC1"].n_atoms, facts["C1OC1"].n_bonds, facts["C1OC1"].n_rings, facts["C1OC1"].n_epoxides) == (3, 3, 1, 1)
    assert facts["CCO"].weight == pytest.approx(46.07, abs=0.01)
    assert facts["NCCN"].n_active_hydrogens == 4
    assert facts["c1ccccc1"].weight == pytest.approx(78.11, abs=0.02)
    assert all(facts[t].n_atoms is None for t in texts[4:])
    assert graph_features(df, "s", keep_all=False).count() == 4
