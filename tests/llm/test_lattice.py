"""Lattice hashing of vectors against all pairs."""

import itertools

import numpy as np
import pytest

from forgeframe.llm import graph, lattice, queries
from forgeframe.llm.sql import ORACLES
from tests.compare import connect, same
from tests.llm.test_brute_force import roots

SCHEMA = "vec_id long, embedding array<double>, label int"


def all_pairs(rows, least):
    """{vec_id: (n_links, component)} of rows of distinct ids."""
    fine = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    pairs = []
    for (i, x, a), (j, y, b) in itertools.combinations(fine, 2):
        if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
            pairs.append((i, j))
    count, of = {}, roots(pairs)
    for i, j in pairs:
        count[i], count[j] = count.get(i, 0) + 1, count.get(j, 0) + 1
    return {i: (count.get(i, 0), of.get(i, i)) for i, _, _ in rows}


def at_cosine(rng, x, cosine):
    x = x / np.linalg.norm(x)
    y = rng.normal(size=len(x))
    y -= (x @ y) * x
    return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def found(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_nearest_points():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    near = lattice.decoded(x)
    doubled = (2 * near).astype(int)
    assert (np.ptp(doubled & 1, axis=1) == 0).all() and (near.sum(1) % 2 == 0).all()
    away = ((x - near) ** 2).sum(1)
    for step in lattice.roots():  # the cell's walls are those towards the 240 neighbours
        assert (((x - near - step) ** 2).sum(1) >= away - 1e-9).all()
    assert (away <= 1 + 1e-9).all()
    grid = lattice.Lattice(64, 0.93, 3, 2, 2)
    unit = rng.normal(size=(50, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    homes, probes = grid.cells(unit)
    assert homes.shape == (50, 3) and probes.shape == (50, 6)
    assert all(len({homes[i, t], *probes[i, 2 * t : 2 * t + 2]}) == 3 for i in range(50) for t in range(3))


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = np.array([at_cosine(rng, x, 0.93) for x in a])
    grid = lattice.Lattice(64, 0.93, lattice.TABLES, lattice.POINTS, lattice.PROBES)
    (ha, pa), (hb, pb) = grid.cells(a), grid.cells(b)
    near = lambda h, p: (p.reshape(len(p), lattice.TABLES, -1) == h[:, :, None]).any((1, 2))
    assert ((ha == hb).any(1) | near(ha, pb) | near(hb, pa)).mean() >= 0.998


@pytest.mark.parametrize("block", [1024, 7])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    monkeypatch.setattr(graph, "BLOCK_EDGES", 1 << 18 if block > 7 else 50)
    rng = np.random.default_rng(2)
    rows = []

    def add(v, label):
        rows.append((len(rows) * 3 % 1009, [float(c) for c in v], label))

    tight, loose, copied = rng.normal(size=(3, 64))
    for _ in range(60):
        add(at_cosine(rng, tight, 0.995) * rng.uniform(0.1, 10), 1)
        add(at_cosine(rng, loose, 0.9695), 1)  # pairs lie around the threshold
        add(copied, 1)
    for _ in range(10):
        add(copied, 2)
        add(at_cosine(rng, at_cosine(rng, tight, 0.995), 0.95), 1)  # links to some of the tight ones
    for k in range(40):
        x = rng.normal(size=64)
        for c in (0.9999, 0.96, 0.932, 0.928, 0.5):
            add(x, 3 + k % 2)
            add(at_cosine(rng, x, c), 3 + k % 2)
    chain = rng.normal(size=64)
    for _ in range(12):
        add(chain, 6)
        chain = at_cosine(rng, chain, 0.94)
    odd = [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 64, 1), (2003, [float("nan")] + [1.0] * 63, 1), (2004, [None] + [1.0] * 63, 1), (2005, [float("inf")] * 64, 1), (2006, list(map(float, copied)), None), (2007, [1.0, 0.0], 1), (2008, [2.0, 0.1], 1), (2009, [1e300, 1e300], 1), (2010, [1e-300, 1e-300], 1)]
    want = all_pairs([r for r in rows + odd if r[0] not in (2009, 2010)], 0.93) | {2009: (1, 2009), 2010: (1, 2009)}
    assert max(n for n, _ in want.values()) >= 60 and len(rows) == len({r[0] for r in rows})
    assert found(lattice.near_duplicate_vectors(spark.createDataFrame(rows + odd, SCHEMA).repartition(5), 0.93)) == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0, 3.0], 1), (5, [1.0, 2.0, 3.1], 1), (5, [1.0, 2.0, 3.0], 1), (3, [1.0, 2.0, 3.0], 1), (None, [1.0, 2.0, 3.0], 1), (9, [-1.0, 0.0, 0.0], 1)], SCHEMA)
    df = df.selectExpr("*", "'mine' AS row", "'mine' AS id", "'mine' AS kept", "'mine' AS doc_id")
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in lattice.near_duplicate_vectors(df, 0.93).collect())
    assert got == [(-1, 0, None, True), (3, 3, 3, True), (5, 3, 3, False), (5, 3, 3, False), (5, 3, 3, False), (9, 0, 9, True)]
    assert lattice.near_duplicate_vectors(df.limit(0)).collect() == []
    assert found(lattice.near_duplicate_vectors(df.where("vec_id = 9"))) == {9: (0, 9)}
    assert [r.n_links for r in lattice.near_duplicate_vectors(df.where("vec_id = 3 or vec_id = 9").drop("doc_id"), 1.0).collect()] == [0, 0]


def test_query_with_planted_copies(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    near = table.where("vec_id % 7 = 0").selectExpr("vec_id + 100000 AS vec_id", "transform(embedding, (x, i) -> cast(x * (1 + 0.1 * ((i + vec_id) % 5)) AS float)) AS embedding", "label")
    table.union(near).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = connect(sf_dir)
    c.execute(f"create or replace view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    df = queries.op11_lattice_near_dedup(spark, str(tmp_path))
    assert df.where("n_links > 0").count() > 20
    same(df, c, ORACLES["op11_lattice_near_dedup"])
