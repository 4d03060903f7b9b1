"""How many rows the compared blocks take and give."""

from pyspark.sql import functions as F

from forgeframe.operators import clean, cluster


def watched(monkeypatch, module):
    seen, real = [], module.block_pairs

    def run(left, right, *args, **named):
        out = real(left, right, *args, **named)
        seen.append((left.count(), right.count(), out.count()))
        return out

    monkeypatch.setattr(module, "block_pairs", run)
    return seen


def test_equal_rows_are_compared_once(spark, monkeypatch):
    seen = watched(monkeypatch, clean)
    rows = spark.range(600).select(F.col("id").alias("k"), (F.col("id") % 3).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, (F.col("id") % 4).cast("double")).alias("b"))
    got = {r.k: r.b for r in clean.knn_impute(rows, "k", ["a", "b"], 2).collect()}
    first = {a: [k % 4 for k in range(600) if k % 2 == 0 and k % 3 == a][:2] for a in range(3)}
    assert got == {k: k % 4 if k % 2 == 0 else sum(first[k % 3]) / 2 for k in range(600)}
    assert seen[0][0] == 3 and seen[0][1] == 2 * 6 + 2 * 3


def test_a_point_gives_a_row_a_block(spark, monkeypatch):
    seen = watched(monkeypatch, cluster)
    monkeypatch.setattr(cluster, "BLOCK", 4)
    monkeypatch.setattr(cluster, "ACROSS", 4)
    points = spark.range(400).select(F.array(F.col("id").cast("double")).alias("v"), F.array((F.col("id") >= 200).cast("int"), (F.col("id") % 2).cast("int")).alias("labels"))
    found = cluster.silhouettes(points, [2, 2])
    assert found[0] > 0.5 > found[1]
    assert seen[0][2] <= 400 * 4
