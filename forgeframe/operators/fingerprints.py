"""Circular fingerprints and substructure patterns, as expressions on perceived structures.

A structure's atoms and bonds stay in its row: a round of a fingerprint hashes every atom with its neighbours, a step of a
match puts one more pattern atom beside those that are placed. No shuffles, no Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .domain import packed_bits
from .perception import indices, let
from .structures import NUMBERS, with_each

# Classes by substructure, each list in the order in which its patterns are tried.
SUBSTRATES = {
    "Benzophenone": "c1ccc(cc1)C(=O)c2ccc(cc2)",
    "DGEBA": "c1ccc(cc1)C(C)(C)c2ccc(cc2)",
    "DGEBF": "c1ccc(cc1)Cc2ccc(cc2)",
    "Novolac": "c1ccc(O)c(c1)Cc2ccccc2",
    "TDE-85 (Ester)": "C(=O)OC",
    "Cycloaliphatic": "C1CCCCC1",
    "Isocyanurate": "N1C(=O)NC(=O)NC1=O",
    "Aliphatic Chain": "[CX4,CX3]~[CX4,CX3]~[CX4,CX3]~[CX4,CX3]",
    "Benzene Ring": "c1ccccc1",
}
GROUPS = {
    "Epoxide": "C1OC1",
    "Anhydride": "C(=O)OC(=O)",
    "Hydrazide": "[NX3][NX3]C(=O)",
    "Thiol": "[#16X2H]",
    "Methacrylate": "CC(=C)C(=O)O",
    "Acrylate": "C=CC(=O)O",
    "Amine (Primary)": "[NX3;H2]",
    "Amine (Secondary)": "[NX3;H1]",
    "Hydroxyl": "[OX2H]",
    "Vinyl": "C=C",
}
OTHER_SUBSTRATE, OTHER_GROUP = "Other_Substrate", "Other_Group"


def bond_kind(bond: Column) -> Column:
    """1 to 3 by order, 4 if aromatic."""
    return F.when(bond["aromatic"], F.lit(4)).otherwise(bond["order"])


def circular_codes(graph: Column, radius: int = 2) -> Column:
    """The codes (array<long>, distinct) of all circular environments of a perceived structure, up to ``radius`` bonds wide.

    An atom's first code is of its element, neighbours, hydrogens, charge, isotope and whether it is in a ring. Each round hashes it
    with the sorted kinds and codes around it, so codes don't depend on the order of atoms; of several atoms with one environment (the same set of bonds), in this or an earlier
    round, one counts. Chirality isn't read. Codes and bits are this engine's own, not those of a chemistry library.
    """

    def rounds(g: Column) -> Column:
        atoms, bonds, near = g["atoms"], g["bonds"], g["near"]
        ring = lambda k: F.exists(F.get(near, k), lambda x: F.get(bonds, x["bond"])["in_ring"])
        first = F.transform(atoms, lambda a, k: F.xxhash64(a["element"], F.size(F.get(near, k)), a["hydrogens"], a["charge"], a["isotope"], ring(k)))
        nothing = F.transform(atoms, lambda _: F.array().cast("array<int>"))
        start = let(first, lambda c: F.struct(c.alias("codes"), nothing.alias("around"), F.filter(nothing, lambda _: F.lit(False)).alias("seen"), c.alias("out")))

        def step(s: Column, r: Column) -> Column:
            codes = F.transform(s["codes"], lambda c, k: F.xxhash64(r, c, F.array_sort(F.transform(F.get(near, k), lambda x: F.struct(bond_kind(F.get(bonds, x["bond"])).alias("kind"), F.get(s["codes"], x["to"]).alias("code"))))))
            around = F.transform(near, lambda own, k: F.array_sort(F.array_distinct(F.flatten(F.concat(F.array(F.get(s["around"], k), F.transform(own, lambda x: x["bond"])), F.transform(own, lambda x: F.get(s["around"], x["to"])))))))

            def kept(now: Column) -> Column:
                entries = F.array_sort(F.zip_with(now["around"], now["codes"], lambda a, c: F.struct(a.alias("around"), c.alias("code"))))
                new = let(entries, lambda es: F.filter(es, lambda e, i: (F.size(e["around"]) > 0) & ~F.array_contains(s["seen"], e["around"]) & ((i == 0) | (F.get(es, i - 1)["around"] != e["around"]))))
                return let(new, lambda n: F.struct(now["codes"].alias("codes"), now["around"].alias("around"), F.concat(s["seen"], F.transform(n, lambda e: e["around"])).alias("seen"), F.concat(s["out"], F.transform(n, lambda e: e["code"])).alias("out")))

            return let(F.struct(codes.alias("codes"), around.alias("around")), kept)

        return F.aggregate(F.slice(F.array(*map(F.lit, range(1, radius + 2))), 1, radius), start, step, lambda s: F.array_distinct(s["out"]))

    return F.when(graph.isNotNull(), let(graph, rounds))


def folded(codes: Column, bits: int = 2048) -> Column:
    """``codes`` as an array of ``bits`` zeros and ones."""
    on = F.transform(codes, lambda c: F.pmod(c, F.lit(bits)).cast("int"))
    return F.when(codes.isNotNull(), let(on, lambda places: F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.array_contains(places, b).cast("int"))))


def circular_fingerprint(df: DataFrame, column: str, name: str = "fingerprint", radius: int = 2, bits: int = 2048) -> DataFrame:
    """``df`` with the circular fingerprint of the structure in ``column``; null where it can't be read."""
    out = with_each(df, column, "made\x00", lambda g: folded(circular_codes(g, radius), bits))
    return out.select(*(c for c in df.columns if c != name), F.col("made\x00").alias(name))


def circular_places(df: DataFrame, column: str, name: str = "places", radius: int = 2, bits: int = 2048) -> DataFrame:
    """``df`` with the places, ascending, of the bits that the circular fingerprint of the structure in ``column`` sets; null where it can't be read."""

    def places(codes: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(codes, lambda c: F.pmod(c, F.lit(bits)).cast("int"))))

    out = with_each(df, column, "made\x00", lambda g: circular_codes(g, radius), places)
    return out.select(*(c for c in df.columns if c != name), F.col("made\x00").alias(name))


def circular_words(df: DataFrame, column: str, name: str = "words", radius: int = 2, bits: int = 2048) -> DataFrame:
    """``df`` with the circular fingerprint of the structure in ``column`` as 64-bit words (see ``domain.packed_bits``); null where it can't be read."""
    out = with_each(df, column, "made\x00", lambda g: circular_codes(g, radius), lambda codes: folded(codes, bits), packed_bits)
    return out.select(*(c for c in df.columns if c != name), F.col("made\x00").alias(name))


@dataclass
class Pattern:
    """Atoms as alternatives of conditions, bonds as (i, j, symbol)."""

    atoms: list[list[dict]] = field(default_factory=list)
    bonds: list[tuple[int, int, str]] = field(default_factory=list)


_TOKEN = re.compile(r"\[([^\]]+)\]|(Br|Cl|[BCNOPSFIbcnops])|(\d)|([-=#:~])|([()])")
_CONDITION = re.compile(r"#(\d+)|X(\d+)|H(\d*)|(Br|Cl|[BCNOPSFIbcnops])")


def _conditions(text: str) -> dict:
    out: dict = {}
    for number, links, hydrogens, symbol in _CONDITION.findall(text):
        if number:
            out["element"] = next(e for e, n in NUMBERS.items() if n == int(number))
        elif links:
            out["links"] = int(links)
        elif symbol:
            out |= {"element": symbol.capitalize(), "aromatic": symbol.islower()}
        else:
            out["hydrogens"] = int(hydrogens or 1)
    return out


def read_pattern(text: str) -> Pattern:
    """A pattern in the notation of SUBSTRATES: symbols (lower case: aromatic), rings, branches, ``~`` for any bond.

    In brackets: symbol or #number, X links with hydrogens, H hydrogens; a comma divides alternatives, a semicolon conditions.
    A bond without a sign is single or aromatic.
    """
    out, stack, rings, last, sign = Pattern(), [], {}, None, ""
    for bracket, symbol, ring, bond, branch in _TOKEN.findall(text):
        if bracket or symbol:
            out.atoms.append([_conditions(part) for part in (bracket or symbol).split(",")])
            if last is not None:
                out.bonds.append((last, len(out.atoms) - 1, sign))
            last, sign = len(out.atoms) - 1, ""
        elif ring:
            if ring in rings:
                out.bonds.append((rings.pop(ring), last, sign))
            else:
                rings[ring] = last
            sign = ""
        elif bond:
            sign = bond
        elif branch == "(":
            stack.append(last)
        else:
            last = stack.pop()
    return out


def _rarity(atom: list[dict]) -> tuple:
    """Rare atoms first: other elements than carbon, further conditions, carbon outside aromatic rings."""
    one = atom[0]
    return (one.get("element") == "C", "links" not in one and "hydrogens" not in one, one.get("aromatic", False))


def matching_order(pattern: Pattern) -> list[int]:
    """From the rarest atom on, always the rarest one beside those before."""
    order = [min(range(len(pattern.atoms)), key=lambda k: (*_rarity(pattern.atoms[k]), k))]
    while len(order) < len(pattern.atoms):
        beside = {x for i, j, _ in pattern.bonds for x in (i, j) if (i in order) != (j in order) and x not in order}
        order.append(min(beside, key=lambda k: (*_rarity(pattern.atoms[k]), k)))
    return order


def has_substructure(graph: Column, text: str) -> Column:
    """Whether a perceived structure holds the pattern; null for null."""
    pattern = read_pattern(text)

    def fits(g: Column, k: Column, atom: list[dict]) -> Column:
        a = F.get(g["atoms"], k)
        out = F.lit(False)
        for one in atom:
            yes = F.lit(True)
            if "element" in one:
                yes = yes & (a["element"] == one["element"])
            if "aromatic" in one:
                yes = yes & (a["aromatic"] if one["aromatic"] else ~a["aromatic"])
            if "links" in one:
                yes = yes & (F.size(F.get(g["near"], k)) + a["hydrogens"] == one["links"])
            if "hydrogens" in one:
                yes = yes & (a["hydrogens"] == one["hydrogens"])
            out = out | yes
        return out

    def bonded(bond: Column, sign: str) -> Column:
        kind = bond_kind(bond)
        return F.lit(True) if sign == "~" else kind.isin(1, 4) if sign == "" else kind == {"-": 1, "=": 2, "#": 3, ":": 4}[sign]

    def beside(g: Column, matches: Column, atom: int, ties: list[tuple[int, str]]) -> Column:
        """Matches with one more pattern atom, which is bound to those at the places in ``ties``."""

        def closed(x: Column, m: Column, other: int, sign: str) -> Column:
            return F.exists(F.get(g["near"], F.get(m, F.lit(other))), lambda y: (y["to"] == x["to"]) & bonded(F.get(g["bonds"], y["bond"]), sign))

        def put(m: Column) -> Column:
            def allowed(x: Column) -> Column:
                yes = ~F.array_contains(m, x["to"]) & bonded(F.get(g["bonds"], x["bond"]), ties[0][1]) & fits(g, x["to"], pattern.atoms[atom])
                for other, sign in ties[1:]:
                    yes = yes & closed(x, m, other, sign)
                return yes

            return F.transform(F.filter(F.get(g["near"], F.get(m, F.lit(ties[0][0]))), allowed), lambda x: F.concat(m, F.array(x["to"])))

        return F.flatten(F.transform(matches, put))

    def found(g: Column) -> Column:
        order = matching_order(pattern)
        matches = F.transform(F.filter(indices(g["atoms"]), lambda k: fits(g, k, pattern.atoms[order[0]])), lambda k: F.array(k))
        for n, atom in enumerate(order[1:], 1):
            ties = [(order.index(i if j == atom else j), sign) for i, j, sign in pattern.bonds if atom in (i, j) and (i if j == atom else j) in order[:n]]
            matches = beside(g, matches, atom, ties)
        return F.size(matches) > 0

    return F.when(graph.isNotNull(), let(graph, found))


def structure_classes(df: DataFrame, column: str, keep_all: bool = True) -> DataFrame:
    """``df`` with FGD_Substrate and FGD_Group: the first pattern of each list that the structure holds.

    Mixtures may be divided by semicolons (also full-width ones). Null where the text can't be read, or, without ``keep_all``, no row.
    """

    def first_of(graph: Column, patterns: dict[str, str], other: str) -> Column:
        first = F
        for label, pattern in patterns.items():
            first = first.when(has_substructure(graph, pattern), F.lit(label))
        return F.when(graph.isNotNull(), first.otherwise(F.lit(other)))

    def classes(graph: Column) -> Column:
        return F.struct(first_of(graph, SUBSTRATES, OTHER_SUBSTRATE).alias("FGD_Substrate"), first_of(graph, GROUPS, OTHER_GROUP).alias("FGD_Group"))

    out = with_each(df, column, "classes\x00", classes, text=lambda t: F.trim(F.regexp_replace(t, r"\s*[;；]\s*", ".")))
    out = out.select(*(c for c in df.columns if c not in ("FGD_Substrate", "FGD_Group")), "classes\x00.*")
    return out if keep_all else out.where("FGD_Group is not null")
