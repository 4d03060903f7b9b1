"""Structures that come again in many rows are read once each."""

import time

from pyspark.sql import functions as F

from forgeframe.operators import canonical, descriptors, domain, fingerprints, structures

TEXTS = ["C1=CC(O)=CC=C1OCC8CO8", "NCC1CCCC(CN)C1", "C(", None]


def test_a_structure_is_read_once(spark):
    """Reading each row's text would take minutes here: some 8 ms a row, in one task."""
    rows = spark.range(60_000, numPartitions=1).withColumn("s", F.get(F.array(*map(F.lit, TEXTS)), (F.col("id") % 4).cast("int")))
    began = time.perf_counter()
    counts = {(r.n_atoms, r.n) for r in structures.graph_features(rows, "s").groupBy("n_atoms").agg(F.count("*").alias("n")).collect()}
    assert counts == {(12, 15_000), (10, 15_000), (None, 30_000)}
    assert structures.bond_rows(rows, "id", "s").count() == 15_000 * (13 + 10)
    texts = {r.canonical: r.n for r in canonical.canonical_structure(rows, "s").groupBy("canonical").agg(F.count("*").alias("n")).collect()}
    assert sorted(texts.values()) == [15_000, 15_000, 30_000] and texts[None] == 30_000
    surfaces = {(r.p, r.n) for r in descriptors.with_surface(rows, "s", "p").groupBy(F.round("p", 2).alias("p")).agg(F.count("*").alias("n")).collect()}
    assert surfaces == {(41.99, 15_000), (52.04, 15_000), (None, 30_000)}
    classes = fingerprints.structure_classes(rows, "s").groupBy("FGD_Group").count().collect()
    assert {(r[0], r[1]) for r in classes} == {("Epoxide", 15_000), ("Amine (Primary)", 15_000), (None, 30_000)}
    assert time.perf_counter() - began < 150


def test_words_and_places_of_fingerprints(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, s string")
    whole = {r.k: r.fingerprint for r in fingerprints.circular_fingerprint(df, "s", bits=256).collect()}
    places = {r.k: r.places for r in fingerprints.circular_places(df, "s", bits=256).collect()}
    words = {r.k: r.words for r in fingerprints.circular_words(df, "s", bits=256).collect()}
    for k in range(4):
        on = whole[k] and [i for i, b in enumerate(whole[k]) if b]
        assert places[k] == on
        assert words[k] is None if on is None else [i for i in range(256) if words[k][i // 64] >> i % 64 & 1] == on


def test_copies_of_fingerprints_by_key(spark):
    """Of more equal rows than are wanted the first by key count, for each of several equal queries."""
    rows = spark.range(400).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, [1, 1, 0]))).otherwise(F.array(*map(F.lit, [1, 0, 0]))).alias("v"))
    got = domain.most_similar(rows.where("k < 4"), rows.where("k >= 4"), "k", "v", 3).collect()
    want = {(k, t, 1.0, n) for k in range(4) for n, t in enumerate(range(4 + k % 2, 10, 2), 1)}
    assert {(r.k, r.train_k, r.similarity, r["rank"]) for r in got} == want
