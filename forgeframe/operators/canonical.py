"""One text for all spellings of a structure: colour refinement, ties broken with proof, then a walk in canonical order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_raw
from .fingerprints import bond_kind
from .structures import VALENCES, _map, once_each, read_each

#: What is written for a bond by its kind (aromatic and most single bonds: nothing).
SIGNS = {2: "=", 3: "#"}


def _refined(colours: list[int], near: list[list[tuple[int, int]]]) -> list[int]:
    """Colours, as ranks, divided by the kinds and colours around until nothing divides further."""
    n = -1
    while len(set(colours)) != n:
        n = len(set(colours))
        signs = [(c, sorted((kind, colours[to]) for to, kind in near[k])) for k, c in enumerate(colours)]
        rank = {repr(s): r for r, s in enumerate(sorted(signs))}
        colours = [rank[repr(s)] for s in signs]
    return colours


def _tied(colours: list[int]) -> list[int]:
    """The atoms of the first colour that several have."""
    of: dict[int, list[int]] = {}
    for k, c in enumerate(colours):
        of.setdefault(c, []).append(k)
    return next((ks for c, ks in sorted(of.items()) if len(ks) > 1), [])


def canonical_order(tokens: list[str], near: list[list[tuple[int, int]]]) -> list[int]:
    """A rank for each atom that doesn't depend on the order in which they are given.

    Where refinement leaves ties, each tied atom is put first in turn and the least result counts; one that, ties broken by
    place, gives the same structure as another is its mirror image and isn't followed further.
    """
    rank = {t: r for r, t in enumerate(sorted(set(tokens)))}

    def apart(colours: list[int], k: int) -> list[int]:
        return _refined([2 * c + (i != k) for i, c in enumerate(colours)], near)

    def result(colours: list[int]) -> tuple:
        place = {c: r for r, c in enumerate(sorted(colours))}
        order = [place[c] for c in colours]
        bonds = sorted((order[i], order[j], kind) for i, own in enumerate(near) for j, kind in own if order[i] < order[j])
        return [tokens[k] for k in sorted(range(len(tokens)), key=order.__getitem__)], bonds, order

    def by_place(colours: list[int]) -> tuple:
        while tied := _tied(colours):
            colours = apart(colours, tied[0])
        return result(colours)[:2]

    def least(colours: list[int]) -> tuple:
        tied = _tied(colours)
        if not tied:
            return result(colours)
        seen, best = [], None
        for k in tied:
            now = apart(colours, k)
            image = by_place(now)
            if image not in seen:
                seen.append(image)
                found = least(now)
                best = found if best is None or found[:2] < best[:2] else best
        return best

    return least(_refined([rank[t] for t in tokens], near))[2]


def _written(tokens: list[str], near: list[list[tuple[int, int]]], order: list[int]) -> str:
    """The text of a connected structure, from the least atom on, branches before the last neighbour, in order."""
    start = order.index(0)
    parent: dict[int, int | None] = {start: None}
    place: dict[int, int] = {}
    children: dict[int, list[int]] = {}
    rings: dict[int, list[int]] = {}
    todo = [start]
    while todo:  # a walk in depth; what it meets again is a ring
        k = todo.pop()
        if k in place:
            continue
        place[k] = len(place)
        children[k] = []
        if parent[k] is not None:
            children[parent[k]].append(k)
        for to, _ in sorted(near[k], key=lambda x: -order[x[0]]):
            if to not in place:
                parent[to] = k
                todo.append(to)
    kinds = {(i, j): kind for i, own in enumerate(near) for j, kind in own}
    for i, own in enumerate(near):
        rings[i] = sorted((to for to, _ in own if parent[to] != i and parent[i] != to), key=lambda to: place[to])

    def sign(i: int, j: int) -> str:
        aromatic = tokens[i].strip("[0123456789")[0].islower() and tokens[j].strip("[0123456789")[0].islower()
        return SIGNS.get(kinds[i, j], "-" if kinds[i, j] == 1 and aromatic else "")

    out, number, free, work = [], {}, list(range(99, 0, -1)), [("atom", start)]
    while work:
        what, k = work.pop()
        if what == "text":
            out.append(k)
            continue
        out.append(("" if parent[k] is None else sign(parent[k], k)) + tokens[k])
        closing = [to for to in rings[k] if place[to] < place[k]]
        for to in closing:
            n = number.pop((to, k))
            out.append(str(n) if n < 10 else f"%{n}")
        opening = [to for to in rings[k] if place[to] > place[k]]
        for to in opening:
            n = number[k, to] = free.pop()
            out.append(sign(k, to) + (str(n) if n < 10 else f"%{n}"))
        free = sorted({*free, *(n for n in range(1, 100) if n not in number.values())}, reverse=True)
        for nth, child in reversed(list(enumerate(children[k]))):
            branch = nth < len(children[k]) - 1
            work += [("text", ")")] * branch + [("atom", child)] + [("text", "(")] * branch
    return "".join(out)


def canonical_text(tokens: list[str], bonds: list[tuple[int, int, int]]) -> str | None:
    """The text of atoms given by their tokens and of bonds (i, j, kind); unconnected parts in order of their texts. Null if over 99 rings are open at once."""
    near: list[list[tuple[int, int]]] = [[] for _ in tokens]
    for i, j, kind in bonds:
        near[i].append((j, kind))
        near[j].append((i, kind))
    left, parts = set(range(len(tokens))), []
    while left:
        todo, part = [min(left)], []
        while todo:
            k = todo.pop()
            if k in left:
                left.discard(k)
                part.append(k)
                todo += [to for to, _ in near[k]]
        at = {k: n for n, k in enumerate(part)}
        own, around = [tokens[k] for k in part], [[(at[to], kind) for to, kind in near[k]] for k in part]
        try:
            parts.append(_written(own, around, canonical_order(own, around)))
        except IndexError:
            return None
    return ".".join(sorted(parts))


def atom_tokens(graph: Column) -> Column:
    """How each atom of a perceived structure is written: without brackets where the reader would fill up the same hydrogens."""

    def token(a: Column, k: Column) -> Column:
        symbol = F.when(a["aromatic"], F.lower(a["element"])).otherwise(a["element"])
        used = F.aggregate(F.get(graph["near"], k), a["aromatic"].cast("int"), lambda n, x: n + F.when(F.get(graph["bonds"], x["bond"])["aromatic"], F.lit(1)).otherwise(F.get(graph["bonds"], x["bond"])["order"]))
        known = F.try_element_at(_map({e: F.array(*map(F.lit, v)) for e, v in VALENCES.items()}), a["element"])
        usual = F.get(F.filter(F.when(a["aromatic"], F.slice(known, 1, 1)).otherwise(known), lambda v: v >= used), F.lit(0))
        plain = known.isNotNull() & (a["charge"] == 0) & (a["isotope"] == 0) & (a["hydrogens"] == F.coalesce(usual - used, F.lit(0)))
        count = F.when(a["hydrogens"] == 0, "").when(a["hydrogens"] == 1, "H").otherwise(F.concat(F.lit("H"), a["hydrogens"].cast("string")))
        size = F.when(F.abs(a["charge"]) == 1, "").otherwise(F.abs(a["charge"]).cast("string"))
        charge = F.when(a["charge"] == 0, "").when(a["charge"] > 0, F.concat(F.lit("+"), size)).otherwise(F.concat(F.lit("-"), size))
        isotope = F.when(a["isotope"] == 0, "").otherwise(a["isotope"].cast("string"))
        return F.when(plain, symbol).otherwise(F.concat(F.lit("["), isotope, symbol, count, charge, F.lit("]")))

    return F.transform(graph["atoms"], token)


def canonical_structure(df: DataFrame, column: str, name: str = "canonical") -> DataFrame:
    """``df`` with one text for all spellings of the structure in ``column``; null where it can't be read.

    The texts are this engine's own, not a chemistry library's. Texts are cleaned first. Aromatic atoms are written in lower case
    (see ``perception.perceived``), hydrogens and charges are kept, chirality and directions of bonds are not. Written again it stays the same.
    """

    @F.pandas_udf("string")
    def texts(tokens: pd.Series, bonds: pd.Series) -> pd.Series:
        def one(t: str | None, b: str | None) -> str | None:
            return None if t is None else canonical_text(t.split(" "), [tuple(map(int, x.split(","))) for x in b.split(" ") if x])

        return pd.Series([one(t, b) for t, b in zip(tokens, bonds, strict=True)], dtype=object)

    g, parts = F.col("graph\x00"), F.col("parts\x00")
    bonds = F.transform(g["bonds"], lambda b: F.concat_ws(",", b["i"].cast("string"), b["j"].cast("string"), bond_kind(b).cast("string")))
    written = F.struct(F.when(g.isNotNull(), F.array_join(atom_tokens(g), " ")).alias("tokens"), F.array_join(bonds, " ").alias("bonds"))

    def made(each: DataFrame) -> DataFrame:
        # An exploded array of one keeps these expressions out of the call of Python, where they can't be computed.
        graph = read_each(each, clean_raw(F.col("text\x00")))
        return graph.select("text\x00", F.explode(F.array(written)).alias("parts\x00")).select("text\x00", texts(parts["tokens"], parts["bonds"]).alias("made\x00"))

    out = once_each(df, column, made)
    return out.select(*(c for c in df.columns if c != name), F.col("made\x00").alias(name))
