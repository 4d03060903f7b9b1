"""Queries over structures. Each part of the table has one, put together from a frame and two side groups by its numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canonical, descriptors, domain, fingerprints, structures
from .registry import query, rounded, table

#: Frames with two places, A and B: text, atoms, rings, aromatic atoms, place of its class among the substrates (10: none), esters of it count as such, of its group (11: none).
FRAMES = [
    ("C1=CC(A)=CC=C1B", 6, 1, 6, 9, False, 11), ("c1cc(A)ccc1B", 6, 1, 6, 9, False, 11), ("C1CC(A)CCC1B", 6, 1, 0, 6, True, 11), ("C(A)CCCB", 4, 0, 0, 8, True, 11),
    ("C1=CC(A)=CC=C1C(C)(C)C2=CC=C(B)C=C2", 15, 2, 12, 2, False, 11), ("C1=CC(A)=CC=C1CC2=CC=C(B)C=C2", 13, 2, 12, 3, False, 11), ("c1cc(A)ccc1C(=O)c2ccc(B)cc2", 14, 2, 12, 1, False, 11),
    ("C1=CC2=CC(A)=CC=C2C=C1B", 10, 2, 10, 9, False, 11), ("C1=C(A)NC(B)=C1", 5, 1, 5, 10, False, 11), ("N(A)CCNB", 4, 0, 0, 10, False, 8), ("C1=C(A)SC(B)=C1", 5, 1, 5, 10, False, 11), ("O=C1C=C(A)C(=O)C=C1B", 8, 1, 0, 8, True, 10),
]
#: Side groups: text, atoms, rings, aromatic atoms, place of its class among the substrates, whether it is an ester on a carbon outside rings of benzene's kind, place among the groups.
SIDES = [
    ("O", 1, 0, 0, 10, False, 9), ("N", 1, 0, 0, 10, False, 7), ("OCC8CO8", 5, 1, 0, 10, False, 1), ("C(=O)OC(=O)C", 6, 0, 0, 5, False, 2), ("OC(=O)C=C", 5, 0, 0, 10, True, 6), ("OC(=O)C(C)=C", 6, 0, 0, 10, True, 5), ("S", 1, 0, 0, 10, False, 4),
    ("NC", 2, 0, 0, 10, False, 8), ("C(=O)NN", 4, 0, 0, 10, False, 3), ("C=C", 2, 0, 0, 10, False, 10), ("C", 1, 0, 0, 10, False, 11), ("c9ccccc9", 6, 1, 6, 9, False, 11), ("C9=CC=CC=C9", 6, 1, 6, 9, False, 11), ("Cl", 1, 0, 0, 10, False, 11),
]


def _rows(values: list[tuple]) -> str:
    return ", ".join("(" + ", ".join([str(k), f"'{v[0]}'", *(str(x) for x in v[1:])]) + ")" for k, v in enumerate(values))


COLUMNS = "k, text, atoms, rings, aromatic, substrate, ester, grp"
MADE = (
    f"f({COLUMNS}) AS (VALUES {_rows(FRAMES)}), s({COLUMNS}) AS (VALUES {_rows(SIDES)}), m AS (SELECT p_partkey, replace(replace(f.text, 'A', a.text), 'B', b.text) AS structure, f.k AS frame, a.k AS one, b.k AS two, "
    "f.atoms + a.atoms + b.atoms AS atoms, f.rings + a.rings + b.rings AS rings, f.aromatic + a.aromatic + b.aromatic AS aromatic, "
    "least(f.substrate, a.substrate, b.substrate, CASE WHEN f.ester AND (a.ester OR b.ester) THEN 5 ELSE 10 END) AS substrate, least(f.grp, a.grp, b.grp) AS grp "
    f"FROM part JOIN f ON f.k = p_partkey % {len(FRAMES)} JOIN s a ON a.k = p_size % {len(SIDES)} JOIN s b ON b.k = (p_partkey // {len(FRAMES)}) % {len(SIDES)})"
)


def made(spark, sf_dir):
    """(p_partkey, structure) of all parts."""
    pick = lambda values, k: F.get(F.array(*(F.lit(v[0]) for v in values)), k.cast("int"))
    frame = pick(FRAMES, F.col("p_partkey") % len(FRAMES))
    one, two = pick(SIDES, F.col("p_size") % len(SIDES)), pick(SIDES, F.expr(f"p_partkey div {len(FRAMES)}") % len(SIDES))
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(F.replace(frame, F.lit("A"), one), F.lit("B"), two).alias("structure"))


@query(f"WITH {MADE} SELECT p_partkey, atoms::INTEGER AS n_atoms, (atoms + rings - 1)::INTEGER AS n_bonds, rings::INTEGER AS n_rings, aromatic::INTEGER AS n_aromatic FROM m")
def f03_graph_counts(spark, sf_dir):
    """Counts of frames and side groups, known by hand, add up; a connected structure has a bond less than atoms and rings."""
    return structures.graph_features(made(spark, sf_dir), "structure").select("p_partkey", "n_atoms", "n_bonds", "n_rings", "n_aromatic")


@query()
def f03_graph_features(spark, sf_dir):
    return rounded(structures.graph_features(made(spark, sf_dir), "structure"))


@query(f"WITH {MADE}, n AS (SELECT p_partkey, structure, regexp_extract_all(structure, '\\[[^\\]]+\\]|Br|Cl|[BCNOPSFIbcnops]') AS a FROM m) SELECT p_partkey, (i - 1)::INTEGER AS atom, CASE WHEN length(a[i]) > 1 THEN a[i] ELSE upper(a[i]) END AS element FROM n, unnest(range(1, len(a) + 1)) AS t(i)")
def f12_atoms(spark, sf_dir):
    return structures.atom_rows(made(spark, sf_dir), "p_partkey", "structure").select("p_partkey", "atom", "element")


@query(f"WITH {MADE} SELECT p_partkey, (atoms + rings - 1)::DOUBLE AS bonds, aromatic::DOUBLE AS aromatic_atoms FROM m")
def f12_bonds(spark, sf_dir):
    """Bonds, and the atoms that aromatic ones touch."""
    bonds = structures.bond_rows(made(spark, sf_dir), "p_partkey", "structure")
    ends = bonds.select("p_partkey", F.col("features")[3].alias("aromatic"), F.explode(F.array("i", "j")).alias("atom"))
    return ends.groupBy("p_partkey").agg((F.count("*") / 2).alias("bonds"), F.countDistinct(F.when(F.col("aromatic") == 1, F.col("atom"))).cast("double").alias("aromatic_atoms"))


@query()
def f12_hydrogen_bonds(spark, sf_dir):
    """Bonds with their six features, those of hydrogens too."""
    return structures.bond_rows(made(spark, sf_dir), "p_partkey", "structure", hydrogens=True)


#: Polar surfaces of the frames' and side groups' own atoms, in their order.
SURFACES = [0, 0, 0, 0, 0, 0, 17.07, 0, 15.79, 24.06, 0, 34.14], [20.23, 26.02, 21.76, 43.37, 26.30, 26.30, 0, 12.03, 55.12, 0, 0, 0, 0, 0]


@query(f"WITH {MADE} SELECT p_partkey, round({SURFACES[0]}[frame + 1] + {SURFACES[1]}[one + 1] + {SURFACES[1]}[two + 1], 4)::DOUBLE AS surface FROM m")
def f08_polar_surface(spark, sf_dir):
    """Surfaces of frames and side groups, added up by hand."""
    return rounded(descriptors.with_surface(made(spark, sf_dir), "structure", "surface").select("p_partkey", "surface"), 4)


@query()
def f08_domain_features(spark, sf_dir):
    """Each part's structure as a resin, with an amine as its hardener."""
    amines = F.array(*map(F.lit, ["NCCN", "NCCNCCN", "NC1=CC=C(C=C1)CC2=CC=C(N)C=C2", "NCC1CCCC(CN)C1"]))
    both = made(spark, sf_dir).withColumn("hardener", F.get(amines, (F.col("p_partkey") % 4).cast("int"))).withColumn("used", (F.col("p_partkey") % 50).cast("double"))
    return rounded(descriptors.domain_features(both, "structure", "hardener", "used").drop("used"))


@query()
def f09_circular_fingerprint(spark, sf_dir):
    """The bits that are set of 2,048."""
    return fingerprints.circular_places(made(spark, sf_dir), "structure", "bits").select("p_partkey", "bits")


@query()
def d02_similar_structures(spark, sf_dir):
    """For each fiftieth part the five most similar structures of all others, by circular fingerprints."""
    bits = fingerprints.circular_words(made(spark, sf_dir), "structure", bits=1024).select("p_partkey", "words")
    return rounded(domain.most_similar(bits.where("p_partkey % 50 = 0"), bits.where("p_partkey % 50 <> 0"), "p_partkey", "words", 5, packed=True))


def _names(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(f"WITH {MADE} SELECT p_partkey, ({_names([*fingerprints.SUBSTRATES, fingerprints.OTHER_SUBSTRATE])})[substrate] AS \"FGD_Substrate\", ({_names([*fingerprints.GROUPS, fingerprints.OTHER_GROUP])})[grp] AS \"FGD_Group\" FROM m")
def f10_structure_classes(spark, sf_dir):
    """The first substrate and group pattern that each structure holds; SQL knows the class of each frame and side group, and that the first in order counts."""
    return fingerprints.structure_classes(made(spark, sf_dir), "structure").drop("structure")


@query()
def t05_canonical_structure(spark, sf_dir):
    """One text for all spellings of a structure."""
    return canonical.canonical_structure(made(spark, sf_dir), "structure")


@query(f"WITH {MADE} SELECT p_partkey FROM m WHERE structure LIKE '%c9ccccc9%'")
def t05_equal_spellings(spark, sf_dir):
    """Structures with a ring in lower case that get the text that they get with its double bonds written out."""
    both = made(spark, sf_dir).where(F.col("structure").contains("c9ccccc9")).withColumn("other", F.regexp_replace("structure", "c9ccccc9", "C9=CC=CC=C9"))
    both = canonical.canonical_structure(canonical.canonical_structure(both, "structure", "one"), "other", "two")
    return both.where("one = two").select("p_partkey")
