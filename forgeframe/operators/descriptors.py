"""Polar surface, partial charges and the features of a resin with its hardener, as expressions on perceived structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.physics import stoichiometry
from .perception import let
from .structures import _facts, _map, _with_hydrogens, with_each

# Published contributions to the polar surface, in square angstroms, by element, charge, hydrogens,
# single, double, triple and aromatic bonds to other atoms, and whether the atom lies in a ring of three.
POLAR = {
    ("N", 0, 0, 3, 0, 0, 0, False): 3.24, ("N", 0, 0, 3, 0, 0, 0, True): 3.01, ("N", 0, 0, 1, 1, 0, 0, False): 12.36, ("N", 0, 0, 0, 0, 1, 0, False): 23.79, ("N", 0, 0, 1, 2, 0, 0, False): 11.68,
    ("N", 0, 0, 0, 1, 1, 0, False): 13.60, ("N", 0, 1, 2, 0, 0, 0, False): 12.03, ("N", 0, 1, 2, 0, 0, 0, True): 21.94, ("N", 0, 1, 0, 1, 0, 0, False): 23.85, ("N", 0, 2, 1, 0, 0, 0, False): 26.02,
    ("N", 1, 0, 4, 0, 0, 0, False): 0.00, ("N", 1, 0, 2, 1, 0, 0, False): 3.01, ("N", 1, 0, 1, 0, 1, 0, False): 4.36, ("N", 1, 1, 3, 0, 0, 0, False): 4.44, ("N", 1, 1, 1, 1, 0, 0, False): 13.97,
    ("N", 1, 2, 2, 0, 0, 0, False): 16.61, ("N", 1, 2, 0, 1, 0, 0, False): 25.59, ("N", 1, 3, 1, 0, 0, 0, False): 27.64, ("N", 0, 0, 0, 0, 0, 2, False): 12.89, ("N", 0, 0, 0, 0, 0, 3, False): 4.41,
    ("N", 0, 0, 1, 0, 0, 2, False): 4.93, ("N", 0, 0, 0, 1, 0, 2, False): 8.39, ("N", 0, 1, 0, 0, 0, 2, False): 15.79, ("N", 1, 0, 0, 0, 0, 3, False): 4.10, ("N", 1, 0, 1, 0, 0, 2, False): 3.88,
    ("N", 1, 1, 0, 0, 0, 2, False): 14.14, ("O", 0, 0, 2, 0, 0, 0, False): 9.23, ("O", 0, 0, 2, 0, 0, 0, True): 12.53, ("O", 0, 0, 0, 1, 0, 0, False): 17.07, ("O", 0, 1, 1, 0, 0, 0, False): 20.23,
    ("O", -1, 0, 1, 0, 0, 0, False): 23.06, ("O", 0, 0, 0, 0, 0, 2, False): 13.14,
}
# For other bondings, a value less so much a neighbour and more so much a hydrogen.
POLAR_OTHERS = {"N": (30.5, 8.2, 1.5), "O": (28.5, 8.6, 1.5)}
# Published electronegativity a + b * charge + c * charge**2 by element and bonding (3: single bonds, 2: a double or aromatic one, 1: a triple or two double ones).
NEGATIVITY = {
    "H3": (7.17, 6.24, -0.56), "C3": (7.98, 9.18, 1.88), "C2": (8.79, 9.32, 1.51), "C1": (10.39, 9.45, 0.73), "N3": (11.54, 10.82, 1.36), "N2": (12.87, 11.15, 0.85), "N1": (15.68, 11.70, -0.27),
    "O3": (14.18, 12.92, 1.39), "O2": (17.07, 13.79, 0.47), "F3": (14.66, 13.85, 2.31), "Cl3": (11.00, 9.69, 1.35), "Br3": (10.08, 8.47, 1.16), "I3": (9.90, 7.96, 0.96), "S3": (10.14, 9.13, 1.38), "S2": (10.14, 9.13, 1.38),
}
#: What a hydrogen's electronegativity counts as when it is positive; rounds of charges moving, each half as strong as the one before.
HYDROGEN, ROUNDS = 20.02, 12


def polar_surface(graph: Column) -> Column:
    """The topological polar surface of a perceived structure, of its N and O; null for null."""

    def of(g: Column) -> Column:
        def part(a: Column, k: Column) -> Column:
            own = F.get(g["near"], k)
            kind = lambda x: F.get(g["bonds"], x["bond"])
            n = [F.size(F.filter(own, _of_order(kind, order))) for order in (1, 2, 3)]
            aromatic = F.size(F.filter(own, lambda x: kind(x)["aromatic"]))
            three = F.exists(g["rings"], lambda r: (F.size(r) == 3) & F.array_contains(r, k))
            key = F.concat_ws("|", a["element"], *(v.cast("string") for v in (a["charge"], a["hydrogens"], *n, aromatic)), (three & (aromatic == 0)).cast("string"))
            plain = F.concat_ws("|", a["element"], *(v.cast("string") for v in (a["charge"], a["hydrogens"], *n, aromatic)), F.lit("false"))
            table = _map({"|".join([k[0], *map(str, k[1:7]), str(k[7]).lower()]): v for k, v in POLAR.items()})
            others = F.lit(0.0)
            for element, (base, each, hydrogen) in POLAR_OTHERS.items():
                others = F.when(a["element"] == element, F.greatest(F.lit(base) - F.size(own) * each + a["hydrogens"] * hydrogen, F.lit(0.0))).otherwise(others)
            return F.coalesce(F.try_element_at(table, key), F.try_element_at(table, plain), others)

        return F.aggregate(F.transform(g["atoms"], part), F.lit(0.0), lambda x, y: x + y)

    return F.when(graph.isNotNull(), let(graph, of))


def _of_order(kind, order: int):
    return lambda x: (kind(x)["order"] == order) & ~kind(x)["aromatic"]


def partial_charges(graph: Column) -> Column:
    """Charges of the atoms of a perceived structure, array<double>, hydrogens after the others, by equalising electronegativity in ROUNDS rounds.

    In each round a bond moves charge towards its more electronegative atom: the difference, over the other's electronegativity as a cation, halved each time.
    Null where an element's constants aren't published (B, Si, P and metals), or for null.
    """

    def of(g: Column) -> Column:
        ends = F.flatten(F.transform(g["bonds"], lambda b: F.array(F.struct(b["i"].alias("at"), b["j"].alias("to"), b["order"].alias("order"), b["aromatic"].alias("aromatic")), F.struct(b["j"].alias("at"), b["i"].alias("to"), b["order"].alias("order"), b["aromatic"].alias("aromatic")))))

        def with_ends(ends: Column) -> Column:
            near = F.transform(g["atoms"], lambda _, k: F.filter(ends, lambda e: e["at"] == k))
            return let(near, lambda near: with_near(near))

        def with_near(near: Column) -> Column:
            def constants(a: Column, k: Column) -> Column:
                own = F.get(near, k)
                doubles = F.size(F.filter(own, lambda e: e["order"] == 2))
                state = F.when(F.exists(own, lambda e: e["order"] > 2) | (doubles > 1) & a["element"].isin("C", "N"), "1").when(F.exists(own, lambda e: (e["order"] > 1) | e["aromatic"]), "2").otherwise("3")
                table = _map({name: F.array(*map(F.lit, v)) for name, v in NEGATIVITY.items()})
                return F.try_element_at(table, F.concat(a["element"], state))

            return let(F.transform(g["atoms"], constants), lambda c: F.when(F.forall(c, lambda x: x.isNotNull()), equalised(near, c)))

        def equalised(near: Column, c: Column) -> Column:
            cation = F.transform(c, lambda x, k: F.when(F.get(g["atoms"], k)["element"] == "H", F.lit(HYDROGEN)).otherwise(x[0] + x[1] + x[2]))

            def rounds(cation: Column) -> Column:
                start = F.struct(F.transform(g["atoms"], lambda a: a["charge"].cast("double")).alias("q"), F.lit(0.5).cast("double").alias("share"))

                def step(s: Column, _: Column) -> Column:
                    negativity = F.zip_with(s["q"], c, lambda q, x: x[0] + x[1] * q + x[2] * q * q)

                    def moved(x: Column) -> Column:
                        def change(q: Column, k: Column) -> Column:
                            def along(e: Column) -> Column:
                                here, there = F.get(x, k), F.get(x, e["to"])
                                return (there - here) / F.when(there > here, F.get(cation, k)).otherwise(F.get(cation, e["to"]))

                            return q + F.aggregate(F.transform(F.get(near, k), along), F.lit(0.0), lambda a, b: a + b) * s["share"]

                        return F.struct(F.transform(s["q"], change).alias("q"), (s["share"] / 2).alias("share"))

                    return let(negativity, moved)

                return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["q"])

            return let(cation, rounds)

        return let(ends, with_ends)

    return F.when(graph.isNotNull(), let(_with_hydrogens(graph), of))


def _electronic(graph: Column) -> list[Column]:
    """The charges' extremes and the polar surface of a perceived structure, as fields pos, neg and surface."""
    charges = F.slice(partial_charges(graph), F.lit(1), F.greatest(F.size(graph["atoms"]), F.lit(0)))
    extremes = let(charges, lambda q: F.struct(F.array_max(q).alias("pos"), F.array_min(q).alias("neg")))
    return [extremes.alias("q"), polar_surface(graph).alias("surface")]


def with_surface(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``name``: the polar surface of the structure in ``column``; null where it can't be read."""
    out = with_each(df, column, "made\x00", polar_surface)
    return out.select(*(c for c in df.columns if c != name), F.col("made\x00").alias(name))


def electronic(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """``df`` with ``<prefix>_Max_Pos_Charge``, ``<prefix>_Max_Neg_Charge`` (largest and smallest of the atoms other than hydrogen) and ``<prefix>_TPSA``; null where the structure, or an element's constants, isn't known."""
    out = with_each(df, column, "e\x00", lambda g: F.struct(*_electronic(g)))
    return out.withColumns({f"{prefix}_Max_Pos_Charge": F.col("e\x00.q.pos"), f"{prefix}_Max_Neg_Charge": F.col("e\x00.q.neg"), f"{prefix}_TPSA": F.col("e\x00.surface")}).drop("e\x00")


def domain_features(df: DataFrame, resin: str, hardener: str, given: str | None = None, given_as: str = "phr", keep_all: bool = True) -> DataFrame:
    """``df`` with the thirteen features of a resin and its hardener.

    Equivalent weights by epoxide rings and active hydrogens, functionalities, theoretical and actual parts per hundred, their ratio and difference, charges and polar surfaces. Null where
    either structure can't be read, or, without ``keep_all``, no row. ``given`` names a column with the actual proportion, as ``functions.physics.stoichiometry`` takes it.
    """
    def part(g: Column) -> Column:
        facts = _facts(g["atoms"], g["bonds"])
        return F.when(g.isNotNull(), F.struct(facts["weight"].alias("weight"), facts["n_epoxides"].alias("epoxides"), facts["n_active_hydrogens"].alias("hydrogens"), *_electronic(g)))

    out = df
    for column, name in ((resin, "r\x00"), (hardener, "h\x00")):
        out = with_each(out, column, name, part)
    both = F.col("r\x00").isNotNull() & F.col("h\x00").isNotNull()
    parts = stoichiometry(F.col("r\x00.weight"), F.col("r\x00.epoxides"), F.col("h\x00.weight"), F.col("h\x00.hydrogens"), F.col(given) if given else None, given_as)
    out = out.withColumn("s\x00", parts)
    names = {"EEW": "eew", "AHEW": "ahew", "Theoretical_PHR": "theoretical_phr", "Actual_PHR": "actual_phr", "Stoich_Ratio": "stoich_ratio", "Stoich_Delta": "stoich_delta"}
    made = {n: F.col(f"s\x00.{c}") for n, c in names.items()} | {"Resin_Functionality": F.col("r\x00.epoxides"), "Hardener_Functionality": F.col("h\x00.hydrogens")}
    made |= {"Resin_Max_Pos_Charge": F.col("r\x00.q.pos"), "Resin_Max_Neg_Charge": F.col("r\x00.q.neg"), "Resin_TPSA": F.col("r\x00.surface"), "Hardener_Max_Pos_Charge": F.col("h\x00.q.pos"), "Hardener_TPSA": F.col("h\x00.surface")}
    out = out.withColumns({n: F.when(both, c) for n, c in made.items()})
    out = out if keep_all else out.where(both)
    return out.drop("r\x00", "h\x00", "s\x00")
