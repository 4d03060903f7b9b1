"""Rings, aromaticity and conjugation of structures, as expressions on their arrays of atoms and bonds.

A structure stays in its row, so nothing here shuffles: rings are found by walks from one end of a
bond to the other, and whether a ring is aromatic by counting its electrons.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Atoms of the largest ring that may be aromatic by itself.
LARGEST = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often and wherever the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(values: Column) -> Column:
    return F.transform(values, lambda _, k: k)


def neighbours(atoms: Column, bonds: Column) -> Column:
    """For each atom its neighbours, array<array<(to, bond)>> with the places of atom and bond."""
    ends = F.transform(bonds, lambda b, k: F.struct(b["i"].alias("i"), b["j"].alias("j"), k.alias("bond")))
    return let(ends, lambda ends: F.transform(atoms, lambda _, a: F.transform(F.filter(ends, lambda e: (e["i"] == a) | (e["j"] == a)), lambda e: F.struct(F.when(e["i"] == a, e["j"]).otherwise(e["i"]).alias("to"), e["bond"].alias("bond")))))


def ring_bonds(atoms: Column, bonds: Column) -> Column:
    """Whether each bond lies in a ring of any size. Bonds come as a text gives them.

    The first bond that leads to an atom from an earlier one is its tree bond; every other bond closes a ring, which takes the tree bonds of those
    atoms that are above one of its ends and not above the other.
    """

    def tree(bonds: Column) -> Column:
        def first(k: Column) -> Column:
            return F.get(F.filter(indices(bonds), lambda e: (F.get(bonds, e)["j"] == k) & (F.get(bonds, e)["i"] < k)), F.lit(0))

        return F.transform(indices(atoms), first)

    def marked(by: Column) -> Column:
        nothing = F.filter(F.array(F.array(F.lit(0))), lambda _: F.lit(False))

        def under(seen: Column, k: Column) -> Column:
            parent = F.get(bonds, F.get(by, k))["i"]
            return F.concat(seen, F.array(F.concat(F.coalesce(F.get(seen, parent), F.array().cast("array<int>")), F.array(k))))

        def rings(above: Column) -> Column:
            extra = lambda b, e: F.coalesce(F.get(by, b["j"]), F.lit(-1)) != e
            ends = F.transform(bonds, lambda b, e: F.when(extra(b, e), F.concat(F.array_except(F.get(above, b["i"]), F.get(above, b["j"])), F.array_except(F.get(above, b["j"]), F.get(above, b["i"])))).otherwise(F.array().cast("array<int>")))
            return let(F.array_distinct(F.flatten(ends)), lambda on: F.transform(bonds, lambda b, e: extra(b, e) | F.array_contains(on, b["j"])))

        return let(F.aggregate(indices(atoms), nothing, under), rings)

    return let(tree(bonds), marked)


def small_rings(near: Column, bonds: Column, in_ring: Column, largest: int = LARGEST) -> Column:
    """The smallest rings through each bond, up to ``largest`` atoms: array<array<int>> of their atoms in ascending order, each ring once.

    All walks from a bond's one end that avoid the bond are made longer, step by step, until some reach its other end.
    """

    def through(bond: Column, place: Column) -> Column:
        start = F.struct(F.array(F.array(bond["i"])).alias("walks"), F.filter(F.array(F.array(bond["i"])), lambda _: F.lit(False)).alias("found"))

        def longer(s: Column, _: Column) -> Column:
            def on(walk: Column) -> Column:
                steps = F.filter(F.get(near, F.element_at(walk, -1)), lambda x: (x["bond"] != place) & F.get(in_ring, x["bond"]) & ~F.array_contains(walk, x["to"]))
                return F.transform(steps, lambda x: F.concat(walk, F.array(x["to"])))

            walks = F.flatten(F.transform(s["walks"], on))
            more = let(walks, lambda w: F.struct(F.filter(w, lambda p: F.element_at(p, -1) != bond["j"]).alias("walks"), F.filter(w, lambda p: F.element_at(p, -1) == bond["j"]).alias("found")))
            return F.when(F.size(s["found"]) > 0, s).otherwise(more)

        return F.when(F.get(in_ring, place), F.aggregate(F.sequence(F.lit(2), F.lit(largest)), start, longer, lambda s: F.transform(s["found"], lambda p: F.array_sort(p)))).otherwise(F.array().cast("array<array<int>>"))

    return F.array_distinct(F.flatten(F.transform(bonds, through)))


def _within(rings: Column, i: Column, j: Column) -> Column:
    return F.exists(rings, lambda r: F.array_contains(r, i) & F.array_contains(r, j))


def electrons(atoms: Column, bonds: Column, near: Column, rings: Column) -> Column:
    """What each atom gives to a ring's pi electrons; null where it can't be part of an aromatic ring.

    One for an atom with a double bond inside a ring; none for a carbon with a double bond to an N, O or S outside;
    two for N, O, S or P with a lone pair, and for a carbanion; none for a carbocation or B. Atoms written in lower case give one, or two with a lone pair.
    """

    def of(a: Column, k: Column) -> Column:
        own = F.get(near, k)
        doubles = F.filter(own, lambda x: F.get(bonds, x["bond"])["order"] == 2)
        triple = F.exists(own, lambda x: F.get(bonds, x["bond"])["order"] > 2)
        inside = F.size(F.filter(doubles, lambda x: _within(rings, k, x["to"])))
        outside = F.filter(doubles, lambda x: ~_within(rings, k, x["to"]))
        to_hetero = F.forall(outside, lambda x: F.get(atoms, x["to"])["element"].isin("N", "O", "S"))
        element, degree = a["element"], F.size(own) + a["hydrogens"]
        lone = (element.isin("N", "P") & (a["charge"] == 0) & (degree == 3)) | (element.isin("O", "S") & (a["charge"] == 0) & (degree == 2)) | (element.isin("N", "P") & (a["charge"] == -1) & (degree == 2))
        carbon = (element == "C") & F.when(a["aromatic"], F.lit(True)).otherwise(degree == 3)
        bare = F.when(lone, F.lit(2)).when(carbon & (a["charge"] == -1), F.lit(2)).when(carbon & (a["charge"] == 1), F.lit(0)).when((element == "B") & (degree <= 3), F.lit(0))
        written = F.when((F.size(outside) > 0) & to_hetero, F.lit(0)).otherwise(F.coalesce(bare, F.lit(1)))
        return F.when(triple | (inside > 1), F.lit(None).cast("int")).when(a["aromatic"], written).when((inside == 1) & (F.size(outside) == 0), F.lit(1)).when(inside == 1, F.lit(None).cast("int")).when((F.size(outside) == 1) & (element == "C") & to_hetero, F.lit(0)).when(F.size(outside) > 0, F.lit(None).cast("int")).otherwise(bare)

    return F.transform(atoms, of)


def aromatic_rings(rings: Column, given: Column) -> Column:
    """Those of ``rings``, and of two rings fused at a bond together, whose electrons number 4n + 2."""

    def fits(ring: Column) -> Column:
        counts = F.transform(ring, lambda k: F.get(given, k))
        return F.forall(counts, lambda c: c.isNotNull()) & (F.aggregate(counts, F.lit(0), lambda a, c: a + F.coalesce(c, F.lit(0))) % 4 == 2)

    def fused(alone: Column) -> Column:
        pairs = F.flatten(F.transform(alone, lambda a, i: F.transform(F.filter(alone, lambda b, j: (j > i) & (F.size(F.array_intersect(a, b)) == 2)), lambda b: F.array_sort(F.array_union(a, b)))))
        return F.filter(pairs, fits)

    return F.concat(F.filter(rings, fits), fused(F.filter(rings, lambda r: ~fits(r))))


def conjugated(atoms: Column, bonds: Column, near: Column) -> Column:
    """Which of perceived ``bonds`` are conjugated.

    A bond between two atoms, each of which has a multiple or aromatic bond to a third atom, or of which one has that and the
    other a lone pair (N, O, S); the multiple bond of such an atom counts too.
    """

    def multiple(k: Column, but: Column) -> Column:
        return F.exists(F.get(near, k), lambda x: (x["bond"] != but) & ((F.get(bonds, x["bond"])["order"] > 1) | F.get(bonds, x["bond"])["aromatic"]))

    def lone(k: Column) -> Column:
        return F.get(atoms, k)["element"].isin("N", "O", "S") & (F.get(atoms, k)["charge"] <= 0)

    def bridge(b: Column, k: Column) -> Column:
        x, y = multiple(b["i"], k), multiple(b["j"], k)
        return (b["order"] == 1) & ~b["aromatic"] & ((x & y) | (x & lone(b["j"])) | (y & lone(b["i"])))

    def beside(bridges: Column) -> Column:
        return F.transform(bonds, lambda b, k: F.get(bridges, k) | b["aromatic"] | ((b["order"] > 1) & (F.exists(F.get(near, b["i"]), lambda x: F.get(bridges, x["bond"])) | F.exists(F.get(near, b["j"]), lambda x: F.get(bridges, x["bond"])))))

    return let(F.transform(bonds, bridge), beside)


def perceived(graph: Column) -> Column:
    """A read structure (``molecular_graph``) with what follows from it; null for null.

    atoms array<(element, aromatic, hydrogens, charge, isotope)>, bonds array<(i, j, order, aromatic, in_ring,
    conjugated)>, near as ``neighbours``, rings as ``small_rings``. An atom is aromatic if it is written so (lower case) or lies in an
    aromatic ring of up to LARGEST atoms, or two such rings fused at a bond (azulene); larger systems that are aromatic only as a whole
    aren't found. A bond is aromatic inside such a ring, or between two atoms written so that lie in one ring.
    """

    def with_rings(atoms: Column, bonds: Column, near: Column, in_ring: Column, rings: Column) -> Column:
        return let(aromatic_rings(rings, electrons(atoms, bonds, near, rings)), lambda found: _finished(atoms, bonds, near, in_ring, rings, found))

    def of(g: Column) -> Column:
        return let(neighbours(g["atoms"], g["bonds"]), lambda near: let(ring_bonds(g["atoms"], g["bonds"]), lambda cyclic: let(small_rings(near, g["bonds"], cyclic), lambda rings: with_rings(g["atoms"], g["bonds"], near, cyclic, rings))))

    return F.when(graph.isNotNull(), let(graph, of))


def _finished(atoms: Column, bonds: Column, near: Column, in_ring: Column, rings: Column, found: Column) -> Column:
    def written(b: Column) -> Column:
        return F.get(atoms, b["i"])["aromatic"] & F.get(atoms, b["j"])["aromatic"]

    new_atoms = F.transform(atoms, lambda a, k: a.withField("aromatic", a["aromatic"] | F.exists(found, lambda r: F.array_contains(r, k))))
    new_bonds = F.transform(
        bonds,
        lambda b, k: F.struct(b["i"].alias("i"), b["j"].alias("j"), b["order"].alias("order"), (F.get(in_ring, k) & (_within(found, b["i"], b["j"]) | (written(b) & (b["order"] == 1) & _within(rings, b["i"], b["j"])))).alias("aromatic"), F.get(in_ring, k).alias("in_ring")),
    )

    def whole(s: Column) -> Column:
        marks = conjugated(s["atoms"], s["bonds"], near)
        return F.struct(s["atoms"].alias("atoms"), F.zip_with(s["bonds"], marks, lambda b, c: b.withField("conjugated", c)).alias("bonds"), near.alias("near"), rings.alias("rings"))

    return let(F.struct(new_atoms.alias("atoms"), new_bonds.alias("bonds")), whole)
