"""K-means with the number of clusters chosen by silhouette; new rows from a trained network."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from .blocks import BLOCK, block_pairs
from .clean import with_row_of
from .distances import distance_sums
from .generative import autoencoder
from .select import assembled

#: Blocks that many points make at least, so that all tasks have some; numbers that a block holds at most.
ACROSS, LARGEST = 8, 1 << 22
#: Rows of a partition of points; numbers of clusters that are fitted at once.
ROWS, FITS = 1 << 16, 4


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1]; flat ones become 0."""
    facts = df.agg(*(F.min(c).alias(f"{c}\x00a") for c in columns), *(F.max(c).alias(f"{c}\x00b") for c in columns))
    return with_row_of(df, facts).withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}\x00a"), F.col(f"{c}\x00b") - F.col(f"{c}\x00a")), F.lit(0.0)) for c in columns}).select(*df.columns)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows of numbers."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _distance_sums(counts: list[int]):
    """Of two blocks: for each left point the summed distances to the right points of each label of each labelling."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = (_numbers(t.column("v")).astype(float) for t in (left, right))
        totals = np.zeros((0, sum(counts)))
        if len(x) and len(y):
            labels, weight = _numbers(right.column("labels")), right.column("n").to_numpy().astype(float)
            shares = np.hstack([np.where(labels[:, c][:, None] == np.arange(k), weight[:, None], 0.0) for c, k in enumerate(counts)])
            totals = distance_sums(x, y, shares)
        return pa.table({"v": left.column("v").slice(0, len(totals)).cast(pa.list_(pa.float64())), **{f"t{i}": totals[:, i] for i in range(sum(counts))}})

    return run


def parts(rows: int) -> int:
    """Partitions for so many rows, on any cluster."""
    return max(1, -(-rows // ROWS))


def silhouettes(points: DataFrame, counts: list[int], block: int | None = None) -> dict[int, float]:
    """The mean Euclidean silhouette of each labelling of ``points`` (v array<double>, labels array<int>, a label from 0 to counts[c] - 1 each).

    Of a point: (b - a) / max(a, b), a its mean distance to the others of its label, b the least mean distance to another label's; 0 if it is alone. All pairs of
    points count, so blocks of points meet each other once, for all labellings; equal points are one with a weight. A point travels, and gives a row of sums, once
    a block, so blocks grow with the points until a task can't hold more (LARGEST numbers): what is shuffled is the points, a few times. In a task, points of one or two
    numbers are summed by cells (``distances``), so there two blocks cost their points instead of their pairs; of more numbers they cost their pairs.
    """
    distinct = points.repartition(parts(points.count()), "v").groupBy("v", "labels").agg(F.count("*").alias("n")).cache()
    n, width = distinct.agg(F.count("*"), F.max(F.size("v"))).first()
    most = LARGEST // ((width or 1) + sum(counts))
    size = block or max(BLOCK, min(-(-n // ACROSS), most))
    wide = block or max(size, min(n, most) if (width or 1) <= 2 else 0)
    schema = ", ".join(["v array<double>", *(f"t{i} double" for i in range(sum(counts)))])
    sums = block_pairs(distinct.select(F.col("v").alias("v")).distinct(), distinct, ["v"], ["v"], _distance_sums(counts), schema, (size, wide), (n, n), packed=True)
    sums = sums.groupBy("v").agg(*(F.sum(f"t{i}").alias(f"t{i}") for i in range(sum(counts))))
    rows = distinct.select("n", F.posexplode("labels").alias("choice", "label")).groupBy("choice", "label").agg(F.sum("n").alias("n")).collect()
    sizes = {(r["choice"], r["label"]): r["n"] for r in rows}
    values = []
    for c, k in enumerate(counts):
        mine, at = F.get("labels", F.lit(c)), sum(counts[:c])
        there = [(label, F.col(f"t{at + label}"), sizes[c, label]) for label in range(k) if (c, label) in sizes]
        a = F.coalesce(*(F.when(mine == label, F.try_divide(t, F.lit(s - 1))) for label, t, s in there), F.lit(None).cast("double"))
        b = F.array_min(F.array(*(F.when(mine != label, t / s) for label, t, s in there)))
        values.append(F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))))
    found = distinct.join(sums, "v").agg(*((F.sum(value * F.col("n")) / F.sum("n")).alias(f"s{c}") for c, value in enumerate(values))).first()
    distinct.unpersist()
    return dict(enumerate(found))


def cluster(df: DataFrame, columns: list[str], k: int | None = None, most: int = 15, seed: int = 42, name: str = "Cluster_Label", judge: str = "euclidean") -> tuple[DataFrame, int]:
    """(``df`` with a label, k): rows with a missing feature get -1 (C15). Without ``k`` the best silhouette of 2 to ``most`` clusters decides.

    ``judge``: ``euclidean`` compares all pairs of rows, in blocks, once for all numbers of clusters; ``squared`` takes Spark's silhouette of squared distances, which needs
    one pass over the rows a number and suits large tables.
    """
    there = " and ".join(f"`{c}` is not null" for c in columns)
    full = df.where(there)
    scaled = min_max(full.withColumns({f"x\x00{c}": F.col(c).cast("double") for c in columns}), [f"x\x00{c}" for c in columns])
    n, xs = full.count(), [f"x\x00{c}" for c in columns]
    # Dealt by values and in order: passes have tasks however the files are cut, and models draw the same rows.
    data = assembled(scaled.repartition(parts(n), *xs).sortWithinPartitions(*xs), xs, "v\x00").cache()
    data.count()
    tried = [max(2, min(k, n - 1))] if k else list(range(2, max(3, min(most + 1, n))))

    def fit(c: int):
        return KMeans(k=c, seed=seed, featuresCol="v\x00", predictionCol=f"label\x00{c}").fit(data)

    # A fit is many short passes, so several go on at once.
    with ThreadPool(min(FITS, len(tried))) as pool:
        models = dict(zip(tried, pool.map(inheritable_thread_target(df.sparkSession)(fit), tried), strict=True))
    best = next(iter(models))
    if len(models) > 1 and judge == "euclidean":
        labelled = data.select("v\x00")
        for m in models.values():
            labelled = m.transform(labelled)
        labels = F.array(*(F.col(f"label\x00{c}") for c in models))
        found = silhouettes(labelled.select(vector_to_array("v\x00").alias("v"), labels.alias("labels")), [m.getK() for m in models.values()])
        best = max(models, key=lambda c: (found[list(models).index(c)], -c))
    elif len(models) > 1:
        tried = {c: ClusteringEvaluator(featuresCol="v\x00", predictionCol=f"label\x00{c}").evaluate(m.transform(data)) for c, m in models.items()}
        best = max(tried, key=lambda c: (tried[c], -c))
    labelled = models[best].transform(data).select(*df.columns, F.col(f"label\x00{best}").alias(name))
    return labelled.unionByName(df.where(f"not coalesce({there}, false)").withColumn(name, F.lit(-1))), best


def augment(df: DataFrame, columns: list[str], n: int, seed: int = 42, **params) -> DataFrame:
    """``n`` new rows from a variational autoencoder trained on the complete rows (C18); ``params`` are those of ``generative.autoencoder``."""
    return autoencoder(df, columns, n, seed, **params)
