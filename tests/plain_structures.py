"""A structure reader in plain Python, to compare the column expressions with."""

import re

from forgeframe.operators.structures import VALENCES, WEIGHTS

TOKEN = re.compile(r"\[[^\]]+\]|Br|Cl|[BCNOPSFIbcnops]|%\d\d|\d|[-=#:/\\().]")
BRACKET = re.compile(r"\[(\d*)([A-Za-z][a-z]?)(@*)(H\d*)?([+-]\d*|\++|-+)?(?::\d+)?\]")
ORDERS = {"-": 1, "=": 2, "#": 3, ":": 1, "/": 1, "\\": 1}


def read_structure(text: str | None):
    """(atoms as (element, aromatic, hydrogens, charge, isotope), bonds as (i, j, order)) of a structure text; None if it can't be read."""
    if not text:
        return None
    atoms, bonds, stack, rings = [], [], [], {}
    last, order, at = None, None, 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            return None
        t, at = m.group(0), m.end()
        if t in ORDERS:
            order = ORDERS[t]
        elif t == "(":
            stack.append(last)
        elif t == ")":
            if not stack:
                return None
            last = stack.pop()
        elif t == ".":
            last, order = None, None
        elif t[0] == "%" or t.isdigit():
            if last is None:
                return None
            if t in rings:
                other, o = rings.pop(t)
                bonds.append((other, last, order or o or 1))
            else:
                rings[t] = (last, order)
            order = None
        else:
            hydrogens, charge, isotope = None, 0, 0
            if t[0] == "[":
                b = BRACKET.fullmatch(t)
                if not b:
                    return None
                symbol, hydrogens = b.group(2), int((b.group(4) or "H0")[1:] or 1) if b.group(4) else 0
                sign, isotope = b.group(5) or "", int(b.group(1) or 0)
                charge = (int(sign[1:]) if sign[1:].isdigit() else len(sign)) * (-1 if sign.startswith("-") else 1)
            else:
                symbol = t
            element = symbol[0].upper() + symbol[1:]
            if element not in WEIGHTS:
                return None
            atoms.append([element, symbol[0].islower(), hydrogens, charge, isotope])
            if last is not None:
                bonds.append((last, len(atoms) - 1, order or 1))
            last, order = len(atoms) - 1, None
    if stack or rings or not atoms:
        return None
    used = [0.0] * len(atoms)
    for i, j, o in bonds:
        used[i] += o
        used[j] += o
    for k, a in enumerate(atoms):
        if a[2] is None:
            need = used[k] + (1 if a[1] else 0)
            a[2] = int(next((v - need for v in (VALENCES[a[0]][:1] if a[1] else VALENCES[a[0]]) if v >= need), 0))
    return [tuple(a) for a in atoms], bonds


def smallest_cycles(n, edges, largest=8):
    """The atoms of all smallest cycles through each edge, by trying every simple path."""
    near = {k: [] for k in range(n)}
    for e, (i, j) in enumerate(edges):
        near[i].append((j, e))
        near[j].append((i, e))
    cycles = set()
    for e, (i, j) in enumerate(edges):
        paths, hits = [(i,)], []
        while paths and not hits and len(paths[0]) < largest:
            paths = [(*p, x) for p in paths for x, by in near[p[-1]] if by != e and x not in p]
            hits = [p for p in paths if p[-1] == j]
        cycles |= {tuple(sorted(p)) for p in hits}
    return cycles


def perceive(atoms, bonds):
    """(aromatic atoms, aromatic bonds, rings) of a read structure."""
    n = len(atoms)
    edges = [(i, j) for i, j, _ in bonds]
    rings = smallest_cycles(n, edges)
    together = lambda i, j, among: any(i in r and j in r for r in among)
    pi = []
    for k, (element, lower, hydrogens, charge, _) in enumerate(atoms):
        own = [(j if i == k else i, o) for i, j, o in bonds if k in (i, j)]
        degree = len(own) + hydrogens
        inner = [x for x, o in own if o == 2 and together(k, x, rings)]
        outer = [x for x, o in own if o == 2 and not together(k, x, rings)]
        hetero = all(atoms[x][0] in "NOS" for x in outer)
        bare = None
        if (element, charge, degree) in {("N", 0, 3), ("P", 0, 3), ("O", 0, 2), ("S", 0, 2), ("N", -1, 2), ("P", -1, 2)}:
            bare = 2
        elif element == "C" and (lower or degree == 3) and charge in (1, -1):
            bare = 1 - charge
        elif element == "B" and degree <= 3:
            bare = 0
        if any(o > 2 for _, o in own) or len(inner) > 1:
            pi.append(None)
        elif lower:
            pi.append(0 if outer and hetero else 1 if bare is None else bare)
        elif inner:
            pi.append(None if outer else 1)
        elif outer:
            pi.append(0 if len(outer) == 1 and element == "C" and hetero else None)
        else:
            pi.append(bare)
    fits = lambda r: all(pi[k] is not None for k in r) and sum(pi[k] for k in r) % 4 == 2
    good = [r for r in rings if fits(r)]
    rest = sorted(rings - set(good))
    good += [u for a in rest for b in rest if a < b and len(set(a) & set(b)) == 2 for u in [tuple(sorted(set(a) | set(b)))] if fits(u)]
    marked = [a[1] or any(k in r for r in good) for k, a in enumerate(atoms)]
    cyclic = []
    for e, (i, j) in enumerate(edges):
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b if a == x else a for f, (a, b) in enumerate(edges) if f != e and x in (a, b)]
        cyclic.append(j in seen)
    flags = [cyclic[e] and (together(i, j, good) or (atoms[i][1] and atoms[j][1] and o == 1 and together(i, j, rings))) for e, (i, j, o) in enumerate(bonds)]
    return marked, flags, rings


def structure_facts(text: str | None) -> dict | None:
    """Graph counts, weight, epoxide rings and hydrogens on nitrogen of a structure."""
    read = read_structure(text)
    if read is None:
        return None
    atoms, bonds = read
    n, e = len(atoms), len(bonds)
    near: list[set[int]] = [set() for _ in atoms]
    for i, j, _ in bonds:
        near[i].add(j)
        near[j].add(i)
    seen, parts = set(), 0
    for start in range(n):
        if start not in seen:
            parts += 1
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x] - seen
    epoxides = sum(1 for k, a in enumerate(atoms) if a[0] == "O" for i in near[k] for j in near[k] if i < j and j in near[i] and atoms[i][0] == atoms[j][0] == "C")
    return {
        "n_atoms": n, "n_bonds": e, "avg_degree": 2 * e / n, "density": 2 * e / (n * (n - 1)) if n > 1 else 0.0, "n_rings": e - n + parts, "n_aromatic": sum(perceive(atoms, bonds)[0]),
        "weight": sum(WEIGHTS[a[0]] + a[2] * WEIGHTS["H"] for a in atoms), "n_epoxides": epoxides, "n_active_hydrogens": sum(a[2] for a in atoms if a[0] == "N"),
    }
