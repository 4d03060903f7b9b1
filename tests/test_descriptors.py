"""Polar surfaces and charges against a plain program and published values."""

import pytest
from pyspark.sql import functions as F

from forgeframe.operators import descriptors
from forgeframe.operators.perception import perceived
from forgeframe.operators.structures import molecular_graph
from tests.plain_structures import perceive, read_structure
from tests.test_structures import NOT_AROMATIC, SPELLINGS

#: Published surfaces of well-known structures.
SURFACES = {"O": 31.5, "CO": 20.23, "COC": 9.23, "CC(=O)C": 17.07, "CC(=O)O": 37.30, "CC(=O)Oc1ccccc1C(=O)O": 63.60, "CC(=O)Nc1ccc(O)cc1": 49.33, "c1ccncc1": 12.89, "c1cc[nH]c1": 15.79, "NC(=O)N": 69.11, "C1CO1": 12.53, "C1CN1": 21.94, "CN(C)C": 3.24, "CC#N": 23.79, "Nc1ccccc1": 26.02, "CCCC": 0.0, "CSC": 0.0, "Cn1cnc2c1c(=O)n(C)c(=O)n2C": 61.82, "C[N+](C)(C)C": 0.0, "CC(=O)[O-]": 40.13, "o1cccc1": 13.14}
TEXTS = [*SURFACES, *(t for pair in SPELLINGS for t in pair[:2]), *NOT_AROMATIC, "C", "[NH4+]", "C#C", "C=C=C", "FC(F)(F)C(Cl)(Br)I", "CS(=O)(=O)C", "C#[N+]C"]


def plain_charges(text, rounds=12):
    atoms, bonds = read_structure(text)
    _, flags, _ = perceive(atoms, bonds)
    atoms, kinds = [list(a) for a in atoms], [(i, j, o, flags[e]) for e, (i, j, o) in enumerate(bonds)]
    for k in range(len(atoms)):
        for _ in range(atoms[k][2]):
            kinds.append((k, len(atoms), 1, False))
            atoms.append(["H", False, 0, 0, 0])
    near = [[(j if i == k else i, o, a) for i, j, o, a in kinds if k in (i, j)] for k in range(len(atoms))]
    constants = []
    for k, a in enumerate(atoms):
        doubles = sum(o == 2 for _, o, _ in near[k])
        state = "1" if any(o > 2 for _, o, _ in near[k]) or (doubles > 1 and a[0] in "CN") else "2" if any(o > 1 or r for _, o, r in near[k]) else "3"
        constants.append(descriptors.NEGATIVITY.get(a[0] + state))
    if None in constants:
        return None
    q, share = [float(a[3]) for a in atoms], 0.5
    for _ in range(rounds):
        x = [a + b * v + c * v * v for v, (a, b, c) in zip(q, constants, strict=True)]
        positive = [20.02 if atoms[k][0] == "H" else sum(constants[k]) for k in range(len(atoms))]
        change = [0.0] * len(q)
        for i, j, _, _ in kinds:
            low, high = (i, j) if x[i] < x[j] else (j, i)
            moved = (x[high] - x[low]) / positive[low] * share
            change[low] += moved
            change[high] -= moved
        q, share = [a + b for a, b in zip(q, change, strict=True)], share / 2
    return q


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, s string").withColumn("g", perceived(molecular_graph(F.col("s"))))
    return {r.s: r for r in df.select("s", descriptors.polar_surface(F.col("g")).alias("surface"), descriptors.partial_charges(F.col("g")).alias("charges")).collect()}


def test_published_surfaces(found):
    for text, surface in SURFACES.items():
        assert found[text].surface == pytest.approx(surface, abs=0.011), text
    for a, b, _ in SPELLINGS:
        assert found[a].surface == pytest.approx(found[b].surface)


def test_charges(found):
    for text in TEXTS:
        want = plain_charges(text)
        assert (found[text].charges is None) == (want is None), text
        if want is not None:
            assert found[text].charges == pytest.approx(want, abs=1e-9)
            assert sum(found[text].charges) == pytest.approx(sum(a[3] for a in read_structure(text)[0]), abs=1e-9)
    assert found["C"].charges == pytest.approx([-0.0776, 0.0194, 0.0194, 0.0194, 0.0194], abs=2e-3)  # as published for methane
    assert [found[t].charges is None for t in ("CSC", "C#C")] == [False, False]


def test_domain_features(spark):
    df = spark.createDataFrame([(1, "C1CO1", "NCCN", 20.0), (2, "C1CO1", "C(", 1.0), (3, "CC", "CC", None), (4, None, "NCCN", 2.0)], "k int, r string, h string, used double")
    out = {r.k: r for r in descriptors.domain_features(df, "r", "h", "used").collect()}
    names = ["EEW", "AHEW", "Resin_Functionality", "Hardener_Functionality", "Theoretical_PHR", "Actual_PHR", "Stoich_Ratio", "Stoich_Delta", "Resin_Max_Pos_Charge", "Resin_Max_Neg_Charge", "Resin_TPSA", "Hardener_Max_Pos_Charge", "Hardener_TPSA"]
    assert [c for c in out[1].asDict() if c not in ("k", "r", "h", "used")] == names or set(names) <= set(out[1].asDict())
    assert out[1].EEW == pytest.approx(44.053) and out[1].AHEW == pytest.approx(60.1 / 4, abs=1e-2) and out[1].Actual_PHR == 20 and out[1].Resin_TPSA == 12.53 and out[1].Hardener_TPSA == pytest.approx(52.04)
    assert all(out[k][n] is None for k in (2, 4) for n in names) and out[3].Stoich_Ratio == 1.0
    assert descriptors.domain_features(df, "r", "h", keep_all=False).count() == 2
