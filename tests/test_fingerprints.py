"""Fingerprints, patterns and canonical texts of structures against plain programs and random renumberings."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from forgeframe.operators import canonical, domain, fingerprints
from forgeframe.operators.perception import perceived
from forgeframe.operators.structures import molecular_graph
from tests.plain_structures import perceive, read_structure
from tests.test_structures import NOT_AROMATIC, SPELLINGS

TEXTS = [
    *(t for pair in SPELLINGS for t in pair[:2]), *NOT_AROMATIC, "C1CO1", "CC(=C)C(=O)OCC", "C=CC(=O)OC", "SCCS", "NCCNCC", "NNC(=O)C", "OCCO", "CC(=O)OC(=O)C", "C1CCCCC1", "CCCC", "C", "[Na+].[Cl-]", "[13CH3]C",
    "C1=CC=C(C=C1)C(C)(C)C2=CC=C(C=C2)O", "C1=CC=C(C=C1)C(=O)C2=CC=C(C=C2)O", "C1=CC=C(C=C1)CC2=CC=C(C=C2)O", "Oc1ccccc1Cc1ccccc1", "O=C1NC(=O)NC(=O)N1", "C12C3C4C1C5C2C3C45", "C1CC2CCC1CC2", "CC(C)(C)c1cc(C(C)(C)C)cc(C(C)(C)C)c1",
    "C(c1ccccc1)(c1ccccc1)(c1ccccc1)c1ccccc1", "C1CC1C1CC1", "C=C=C", "N#CC#N", "C[N+](C)(C)C.[Br-]", "OCC1OC(O)C(O)C(O)C1O", "FC(F)(F)c1nnn[nH]1", "C1CC12CC2", "CCCCCCCCCCCC(=O)O", "c1ccc2c(c1)ccc1ccccc12",
]


def respelt(text, rng):
    """The same structure written from another atom on, its neighbours in random order, every atom in brackets or as it was."""
    atoms, bonds = read_structure(text)
    near = {k: [] for k in range(len(atoms))}
    for e, (i, j, o) in enumerate(bonds):
        near[i].append((j, o, e))
        near[j].append((i, o, e))
    out, seen, used, marks = [], set(), set(), itertools.count(10)

    def token(k):
        element, lower, hydrogens, charge, isotope = atoms[k]
        sign = "" if not charge else ("+" if charge > 0 else "-") + (str(abs(charge)) if abs(charge) > 1 else "")
        return f"[{isotope or ''}{element.lower() if lower else element}{'H' * (hydrogens > 0)}{hydrogens if hydrogens > 1 else ''}{sign}]"

    def write(k):
        seen.add(k)
        own = near[k][:]
        rng.shuffle(own)
        text, open_marks = token(k), []
        branches = []
        for to, o, e in own:
            if e in used:
                continue
            if to in seen or (to, e) in open_marks:
                continue
            branches.append((to, o, e))
        return text, branches

    closures = {}

    def walk(k, by):
        seen.add(k)
        parts = [token(k)]
        closures.setdefault(k, [])
        own = [x for x in near[k] if x[2] != by]
        rng.shuffle(own)
        children = []
        for to, o, e in own:
            if e in used:
                continue
            if to in seen:
                used.add(e)
                n = next(marks)
                closures[to].append(("", n))
                closures[k].append(("-=#"[o - 1], n))
            else:
                used.add(e)
                children.append(("-=#"[o - 1], walk(to, e)))
        return k, children

    def show(node):
        k, children = node
        text = token(k) + "".join(f"{sign}%{n}" for sign, n in closures[k])
        for n, (sign, child) in enumerate(children):
            inner = sign + show(child)
            text += inner if n == len(children) - 1 else f"({inner})"
        return text

    starts = list(range(len(atoms)))
    rng.shuffle(starts)
    for k in starts:
        if k not in seen:
            out.append(show(walk(k, None)))
    return ".".join(out)


@pytest.fixture(scope="module")
def graphs(spark):
    """(k, nth, text): each structure as given and in six random spellings."""
    rng = random.Random(3)
    rows = [(k, n, t if n == 0 else respelt(t, rng)) for k, t in enumerate(TEXTS) for n in range(7)]
    return spark.createDataFrame(rows, "k int, nth int, s string").repartition(4).cache()


def test_respelling_reads_back():
    rng = random.Random(1)
    for text in TEXTS:
        a, b = read_structure(text), read_structure(respelt(text, rng))
        assert sorted(a[0]) == sorted(b[0]) and sorted(o for *_, o in a[1]) == sorted(o for *_, o in b[1])


def test_canonical_texts(spark, graphs):
    rows = canonical.canonical_structure(graphs, "s").collect()
    of = {}
    for r in rows:
        of.setdefault(r.k, set()).add(r.canonical)
    assert all(len(x) == 1 and None not in x for x in of.values()), {TEXTS[k]: x for k, x in of.items() if len(x) > 1}
    one = {k: next(iter(x)) for k, x in of.items()}
    for k in range(len(SPELLINGS)):
        assert one[2 * k] == one[2 * k + 1], SPELLINGS[k]
    again = canonical.canonical_structure(spark.createDataFrame(list(one.items()), "k int, s string"), "s").collect()
    assert all(r.canonical == r.s for r in again)
    different = {k: t for k, t in one.items() if k >= 2 * len(SPELLINGS)}
    assert len(set(different.values())) == len({t for t in different.values()}) and one[TEXTS.index("CCCC")] == "CCCC"
    assert all(r.canonical is None for r in canonical.canonical_structure(spark.createDataFrame([(None,), ("",), ("C1CC(",), ("x",)], "s string"), "s").collect())
    assert [r.canonical for r in canonical.canonical_structure(spark.createDataFrame([("C.O",), ("O.C",)], "s string"), "s").collect()] == ["C.O"] * 2


def test_canonical_order_of_regular_graphs():
    """Graphs whose atoms refinement can't tell apart: two triangles against six in a ring, and two different ones of degree three."""
    def near(edges, n):
        return [[(b if a == k else a, 1) for a, b in edges if k in (a, b)] for k in range(n)]

    prism = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)]
    bipartite = [(a, b) for a in (0, 1, 2) for b in (3, 4, 5)]
    rng, texts = random.Random(2), []
    for edges in (prism, bipartite):
        found = set()
        for _ in range(20):
            p = rng.sample(range(6), 6)
            found.add(canonical.canonical_text(["C"] * 6, [(p[a], p[b], 1) for a, b in rng.sample(edges, len(edges))]))
        assert len(found) == 1
        texts.append(found.pop())
    assert texts[0] != texts[1] and near(prism, 6)


def plain_codes(text, radius):
    """The environments of a structure as nested tuples, one for each new set of bonds a round."""
    atoms, bonds = read_structure(text)
    marked, flags, _ = perceive(atoms, bonds)
    near = [[(j if i == k else i, 4 if flags[e] else o, e) for e, (i, j, o) in enumerate(bonds) if k in (i, j)] for k in range(len(atoms))]

    def cyclic(e):
        i, j, _ = bonds[e]
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [to for to, _, by in near[x] if by != e]
        return j in seen

    codes = [(a[0], len(near[k]), a[2], a[3], a[4], any(cyclic(e) for _, _, e in near[k])) for k, a in enumerate(atoms)]
    around, seen, out = [frozenset()] * len(atoms), set(), set(codes)
    for r in range(1, radius + 1):
        codes, around = [(r, codes[k], tuple(sorted((kind, codes[to]) for to, kind, _ in near[k]))) for k in range(len(atoms))], [around[k] | {e for _, _, e in near[k]} | frozenset().union(*(around[to] for to, _, _ in near[k])) for k in range(len(atoms))]
        new = {}
        for a, c in zip(around, codes, strict=True):
            if a and a not in seen:
                new.setdefault(a, set()).add(c)
        seen |= set(new)
        out |= {("one of", frozenset(cs)) if len(cs) > 1 else next(iter(cs)) for cs in new.values()}
    return out


def test_circular_codes(spark, graphs):
    for radius in (0, 2, 3):
        found = graphs.withColumn("g", perceived(molecular_graph(F.col("s")))).select("k", "nth", fingerprints.circular_codes(F.col("g"), radius).alias("c")).collect()
        codes = {}
        for r in found:
            assert codes.setdefault(r.k, set(r.c)) == set(r.c), TEXTS[r.k]  # any order of atoms
        want = {k: plain_codes(t, radius) for k, t in enumerate(TEXTS)}
        assert all(len(codes[k]) == len(want[k]) for k in want)
        for a, b in itertools.combinations(want, 2):
            plain = want[a] & want[b]
            if not any(c[0] == "one of" for c in want[a] | want[b]):
                assert len(codes[a] & codes[b]) == len(plain), (TEXTS[a], TEXTS[b])


def test_fingerprints_in_a_domain(spark, graphs):
    bits = fingerprints.circular_fingerprint(graphs.where("nth < 2"), "s", bits=1024)
    rows = {(r.k, r.nth): r.fingerprint for r in bits.collect()}
    assert all(rows[k, 0] == rows[k, 1] and len(rows[k, 0]) == 1024 and 0 < sum(rows[k, 0]) for k, _ in rows)
    near = domain.most_similar(bits.where("nth = 1"), bits.where("nth = 0"), "k", "fingerprint", 1).collect()
    assert all(r.similarity == 1.0 for r in near)
    assert fingerprints.circular_fingerprint(spark.createDataFrame([(None,), ("C(",)], "s string"), "s").where("fingerprint is not null").count() == 0


def plain_match(text, pattern):
    """A backtracking search."""
    atoms, bonds = read_structure(text)
    marked, flags, _ = perceive(atoms, bonds)
    near = [{(j if i == k else i): 4 if flags[e] else o for e, (i, j, o) in enumerate(bonds) if k in (i, j)} for k in range(len(atoms))]
    want = fingerprints.read_pattern(pattern)

    def fits(k, options):
        seen = {"element": atoms[k][0], "aromatic": marked[k], "links": len(near[k]) + atoms[k][2], "hydrogens": atoms[k][2]}
        return any(all(seen[c] == v for c, v in one.items()) for one in options)

    def bonded(kind, sign):
        return kind is not None and (sign == "~" or kind in {"": (1, 4), "-": (1,), "=": (2,), "#": (3,), ":": (4,)}[sign])

    def search(placed):
        n = len(placed)
        if n == len(want.atoms):
            return True
        ties = [(i if j == n else j, s) for i, j, s in want.bonds if n in (i, j) and (i if j == n else j) < n]
        return any(k not in placed and fits(k, want.atoms[n]) and all(bonded(near[placed[o]].get(k), s) for o, s in ties) and search([*placed, k]) for k in range(len(atoms)))

    return search([])


def test_patterns_against_backtracking(spark, graphs):
    patterns = {**fingerprints.SUBSTRATES, **fingerprints.GROUPS, "x1": "C1CC1", "x2": "[NX3;H0]", "x3": "C#N", "x4": "cO", "x5": "C(C)(C)(C)C", "x6": "[CX4]-[OX2]", "x7": "n:c"}
    g = perceived(molecular_graph(F.col("s")))
    rows = graphs.withColumn("g", g).select("k", "nth", "s", *[fingerprints.has_substructure(F.col("g"), p).alias(f"`{n}`" if False else f"p{i}") for i, (n, p) in enumerate(patterns.items())]).collect()
    hits = 0
    for r in rows:
        for i, p in enumerate(patterns.values()):
            assert r[f"p{i}"] == plain_match(r.s, p), (r.s, p)
            hits += r[f"p{i}"]
    assert hits > 300


def test_first_classes(spark):
    rows = [("C1=CC=C(C=C1)C(=O)C2=CC=C(C=C2)OCC1CO1", "Benzophenone", "Epoxide"), ("CC(C)(c1ccc(O)cc1)c1ccc(O)cc1", "DGEBA", "Hydroxyl"), ("NC1=CC=C(C=C1)CC2=CC=C(N)C=C2", "DGEBF", "Amine (Primary)"),
            ("C1CCCCC1NNC(=O)C", "Cycloaliphatic", "Hydrazide"), ("SCCCCS", "Aliphatic Chain", "Thiol"), ("CC1=CC=CC=C1; CC(=C)C(=O)OC", "TDE-85 (Ester)", "Methacrylate"), ("CO", "Other_Substrate", "Hydroxyl"), ("CF", "Other_Substrate", "Other_Group"), ("C(", None, None), (None, None, None)]
    got = fingerprints.structure_classes(spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, s string"), "s")
    assert [(r.s, r.FGD_Substrate, r.FGD_Group) for r in got.orderBy("k").collect()] == rows
    assert fingerprints.structure_classes(got.select("s"), "s", keep_all=False).count() == 8
