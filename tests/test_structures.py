"""Structures read by column expressions against a reader in plain Python."""

import random

from pyspark.sql import functions as F

from forgeframe.operators import structures
from forgeframe.sources.synthetic import RESINS
from forgeframe.operators.perception import perceived
from tests.plain_structures import perceive, read_structure, structure_facts

GIVEN = [
    *RESINS, "", None, "C", "CCO", "C1CC1", "C1CO1", "c1ccccc1", "C1CC(", "C)C", "1CC1", "C=C", "C#N", "CC(=O)O", "C(C)(C)N", "[NH4+]", "[Na+].[Cl-]", "C1.C1", "C%12CC%12", "C/C=C/C", "[13CH3][C@H](N)O",
    "[Xx]", "C[", "C1CC2", "N(CC1CO1)CC1CO1", "OC(=O)c1ccc(N)cc1", "C=1CCCCC1", "C1CCCC=1", "[Si](C)(C)O", "B(O)O", "S(=O)(=O)(N)C", "CBr", "ClC(Cl)Cl", "x", "C C",
]


def made(rng):
    parts = ["C", "N", "O", "c", "(", ")", "=", "1", "2", "[NH2]", "[O-]", "Cl", ".", "%10", "#"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))


def test_graphs(spark):
    rng = random.Random(5)
    texts = GIVEN + [made(rng) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    got = {r.k: r.g for r in df.select("k", structures.molecular_graph(F.col("s")).alias("g")).collect()}
    facts = {r.k: r.asDict() for r in structures.graph_features(df, "s").collect()}
    readable = 0
    for k, text in enumerate(texts):
        want = read_structure(text)
        assert (got[k] is None) == (want is None), text
        if want is not None:
            readable += 1
            assert [tuple(a) for a in got[k].atoms] == want[0] and [tuple(b) for b in got[k].bonds] == want[1], text
            for name, value in structure_facts(text).items():
                assert abs(facts[k][name] - value) < 1e-9, (text, name)
        else:
            assert facts[k]["n_atoms"] is None
    assert readable > 60


def test_atom_and_bond_rows(spark):
    df = spark.createDataFrame([(1, "c1ccccc1O"), (2, "C#N"), (3, "C("), (4, "[Na+]")], "k int, s string")
    atoms = {(r.k, r.atom): r for r in structures.atom_rows(df, "k", "s").collect()}
    assert len(atoms) == 7 + 2 + 1 and all(len(r.features) == 22 for r in atoms.values())
    assert atoms[1, 6].features[2] == 1 and atoms[1, 6].features[17:] == [0.08, 0.1, 0, 0.2, 0.25]
    assert atoms[4, 0].features[16] == 1 and atoms[2, 0].features[21] == 0.5
    bonds = {(r.k, r.i, r.j): r.features for r in structures.bond_rows(df, "k", "s").collect()}
    assert bonds[2, 0, 1] == [0, 0, 1, 0, 0, 0] and bonds[1, 5, 6] == [1, 0, 0, 0, 0, 1] and bonds[1, 0, 1] == [0, 0, 0, 1, 1, 1] and len(bonds) == 8


#: One structure in two spellings, its aromatic atoms.
SPELLINGS = [
    ("C1=CC=CC=C1", "c1ccccc1", 6), ("C1=CC=C2C(=C1)C=CC=C2", "c1ccc2ccccc2c1", 10), ("C1=CNC=C1", "c1c[nH]cc1", 5), ("C1=CSC=C1", "c1ccsc1", 5), ("O1C=CC=C1", "o1cccc1", 5),
    ("C1=CC=NC=C1", "c1ccncc1", 6), ("CN1C=CC=C1", "Cn1cccc1", 5), ("O=C1C=CC=CN1", "O=c1cccc[nH]1", 6), ("C1=CC2=CC=CC=CC2=C1", "c1cc2cccccc2c1", 10), ("C1=CC=CC=C1C2=CC=CC=C2", "c1ccccc1-c1ccccc1", 12),
    ("[CH-]1C=CC=C1", "[cH-]1cccc1", 5), ("[CH+]1C=CC=CC=C1", "[cH+]1cccccc1", 7), ("C[N+]1=CC=CC=C1", "C[n+]1ccccc1", 6), ("C1=CC=C2C(=C1)NC=C2", "c1ccc2[nH]ccc2c1", 9),
]
NOT_AROMATIC = ["C1=CC=CC=CC=C1", "C1=CC=C1", "O=C1C=CC(=O)C=C1", "C1CCCCC1", "C1=CCC=C1", "C=C1C=CC(=C)C=C1", "O=C1C=CC(=O)O1", "C1CO1", "S1(=O)(=O)C=CC=C1"]


def test_spellings_have_equal_facts(spark):
    rows = [(k, side, text) for k, pair in enumerate(SPELLINGS) for side, text in enumerate(pair[:2])] + [(100 + k, 0, t) for k, t in enumerate(NOT_AROMATIC)]
    df = spark.createDataFrame(rows, "k int, side int, s string")
    facts = {(r.k, r.side): r.asDict() for r in structures.graph_features(df, "s").drop("s").collect()}
    for k, (_, _, n) in enumerate(SPELLINGS):
        first, second = ({c: v for c, v in facts[k, side].items() if c != "side"} for side in (0, 1))
        assert first["n_aromatic"] == n and first.keys() == second.keys(), SPELLINGS[k]
        assert all(abs(first[c] - second[c]) < 1e-9 for c in first), SPELLINGS[k]
    assert all(facts[100 + k, 0]["n_aromatic"] == 0 for k in range(len(NOT_AROMATIC)))


def test_spellings_have_equal_atoms(spark):
    df = spark.createDataFrame([(k, side, text) for k, pair in enumerate(SPELLINGS) for side, text in enumerate(pair[:2])], "k int, side int, s string")
    for hydrogens in (False, True):
        atoms, rows = structures.atom_rows(df.selectExpr("2 * k + side AS k", "s"), "k", "s", hydrogens).collect(), {}
        for a in atoms:
            rows.setdefault(a.k, []).append([round(x, 9) for x in a.features])
        assert all(sorted(rows[2 * k]) == sorted(rows[2 * k + 1]) for k in range(len(SPELLINGS)))


def test_perception_against_plain_program(spark):
    rng = random.Random(8)
    pieces = ["C1=CC=CC=C1", "c1ccccc1", "C1CO1", "C(=O)", "N", "c1ccc2ccccc2c1", "C1CC2CC1CC2", "C#N", "C12C3C4C1C5C2C3C45", "c1ccncc1", "C1=CNC=C1", "N1C(=O)NC(=O)NC1=O", "C=C", "O", "S(=O)(=O)", "C1=CC2=CC=CC=CC2=C1"]
    texts = [*GIVEN, *pieces, *(t for pair in SPELLINGS for t in pair[:2]), *NOT_AROMATIC, *("".join(rng.choice(pieces) for _ in range(rng.randint(2, 4))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string").repartition(4)
    n = 0
    for r in df.select("k", perceived(structures.molecular_graph(F.col("s"))).alias("g")).collect():
        read = read_structure(texts[r.k])
        assert (r.g is None) == (read is None)
        if read is not None:
            marked, flags, rings = perceive(*read)
            assert [a.aromatic for a in r.g.atoms] == marked and [b.aromatic for b in r.g.bonds] == flags and {tuple(x) for x in r.g.rings} == rings, texts[r.k]
            n += any(marked)
    assert n > 40


def test_hydrogens_as_rows_and_conjugation(spark):
    df = spark.createDataFrame([(1, "C=CC=C"), (2, "CC(=O)N"), (3, "C=CCC=C"), (4, "C[NH3+]")], "k int, s string")
    atoms = structures.atom_rows(df, "k", "s", hydrogens=True).collect()
    assert [sum(a.k == k and a.element == "H" for a in atoms) for k in (1, 2, 3, 4)] == [6, 5, 8, 6]
    assert {round(a.features[21] * 8) for a in atoms if a.element == "C"} == {4} and all(a.features[20] == 0 for a in atoms)
    bonds = structures.bond_rows(df, "k", "s").collect()
    assert [sum(b.features[5] for b in bonds if b.k == k) for k in (1, 2, 3, 4)] == [3, 2, 0, 0]
    assert structures.bond_rows(df, "k", "s", hydrogens=True).count() == len(bonds) + 25
