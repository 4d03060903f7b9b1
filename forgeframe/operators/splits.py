"""Splits and folds of exact size that any run repeats: rows are ranked by a hash of their key.

Ranks over a whole table come from counts of hash ranges and ranks within them, so no task sorts all
rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import clean
from .clean import hash_order, hash_ranked
from .quantiles import quantiles

#: Rows of one part of a table dealt evenly: fewest, up to PARTS parts, and most beyond them.
LEAST_ROWS, MOST_ROWS, PARTS = 50_000, 800_000, 24
#: Hex digits of a hash by which one pass narrows the range that holds a rank; digits of a whole hash.
NARROWED, HASH_DIGITS = 3, 32


def _least_hashes(df: DataFrame, key: str, share: float, seed: int) -> tuple[int, int, Column | None]:
    """(rows, ceil(rows * share), condition of so many rows of the smallest hashes), or no condition where rows of one hash lie on both sides of that bound.

    The bound is found by counts of ever narrower hash ranges, each pass giving 4,096 or RANGE_ROWS of them at most: two passes as a rule. No row is shuffled or ranked.
    """
    h = hash_order(key, seed=seed)
    hashed, prefix, inside, n, wanted, below = df.select(h.alias("h")), "", math.inf, 0, 0, 0
    while len(prefix) < HASH_DIGITS:
        digits = HASH_DIGITS if inside <= clean.RANGE_ROWS else min(HASH_DIGITS, len(prefix) + NARROWED)
        ranges = hashed.where(F.col("h").startswith(prefix)).groupBy(F.substring("h", 1, digits).alias("range")).agg(F.count("*").alias("n"))
        found = sorted(map(tuple, ranges.collect()))
        if not prefix:
            n = sum(many for _, many in found)
            wanted = math.ceil(n * share)
            if wanted <= 0 or wanted >= n:
                return n, wanted, F.lit(wanted > 0)
        for prefix, inside in found:
            if below + inside >= wanted:
                break
            below += inside
    return n, wanted, h <= prefix if below + inside == wanted else None


def random_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, even: bool = False) -> DataFrame:
    """``df`` with ``is_test`` for the ceil(n * test_size) rows of the smallest hashes.

    Rows stay where they are, unless those of one key come to lie on both sides. ``even`` deals them by key to as many parts as they need, for a table that is to be cached.
    """
    n, n_test, least = _least_hashes(df, key, test_size, seed)
    if least is None:
        return hash_ranked(df, key, seed, "rank\x00").withColumn("is_test", F.col("rank\x00") <= n_test).select(*df.columns, "is_test")
    split = df.withColumn("is_test", least)
    if not even:
        return split
    # By rows and keys only, and in order: models that draw rows by their place draw the same ones on any cluster.
    parts = max(1, -(-n // MOST_ROWS), min(PARTS, -(-n // LEAST_ROWS)))
    return split.repartition(parts, key).sortWithinPartitions(key)


def quantile_bins(df: DataFrame, target: str, bins: int) -> DataFrame:
    """``df`` with ``bin`` from 0: quantile bins closed on the right, equal edges made one."""
    found = quantiles(df, [target], [i / bins for i in range(bins + 1)])[(target,)]
    edges = F.array(*[F.lit(e).cast("double") for e in dict.fromkeys(found)])
    above = F.size(F.filter(edges, lambda e: e < F.col(target))) - 1
    return df.withColumn("bin", F.greatest(above, F.lit(0)))


def stratified_split(df: DataFrame, stratum: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """As ``random_split``, within each stratum (M04): round(size * test_size) test rows of each."""
    sizes = df.groupBy(F.col(stratum).alias("of\x00")).agg(F.count("*").alias("n\x00"))
    ranked = hash_ranked(df, key, seed, "rank\x00", by=stratum)
    both = ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("of\x00")))
    return both.withColumn("is_test", F.col("rank\x00") <= F.floor(F.col("n\x00") * test_size + 0.5)).select(*df.columns, "is_test")


def group_split(df: DataFrame, group: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole groups to either side: ceil(groups * test_size) of them are test."""
    sides = random_split(df.select(group).distinct(), group, test_size, seed)
    return df.join(sides, group)


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """``df`` with ``fold`` 0..k-1 of sizes at most one apart, over the table or within each stratum."""
    ranked = hash_ranked(df, key, seed, "rank\x00", by=stratum)
    return ranked.withColumn("fold", F.pmod(F.col("rank\x00") - 1, F.lit(k)).cast("int")).drop("rank\x00")


def repeated_folds(df: DataFrame, key: str, k: int = 5, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Folds for each of several repeats: (rows of df, repeat, fold)."""
    out = folds(df, key, k, seed).withColumn("repeat", F.lit(0))
    for r in range(1, repeats):
        out = out.unionByName(folds(df, key, k, seed + r).withColumn("repeat", F.lit(r)))
    return out


def dealt(sizes: dict[int, int], k: int) -> list[tuple[int, int, int, int]]:
    """(size, first rank, end rank, fold): groups by size, largest first, each to the lightest fold.

    ``sizes`` counts the groups of each size. Groups of a size are alike, so as many as all folds can take
    in turn are dealt at once.
    """
    load, out = [0] * k, []
    for size in sorted(sizes, reverse=True):
        rank, left = 0, sizes[size]
        while left:
            order = sorted(range(k), key=lambda i: (load[i], i))
            turns = left // k if load[order[-1]] - load[order[0]] <= size else 0
            if turns:
                for fold in order:
                    out.append((size, rank, rank + turns, fold))
                    load[fold] += turns * size
                    rank += turns
                left -= turns * k
                continue
            fold = order[0]
            n = min(left, max(1, (load[order[1]] - load[fold]) // size)) if k > 1 else left
            out.append((size, rank, rank + n, fold))
            load[fold] += n * size
            rank, left = rank + n, left - n
    return out


def group_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds of whole groups, balanced: largest group first, each to the lightest fold.

    Only the histogram of group sizes comes to the driver; groups of a size are told apart by rank of
    their hash. ``group`` is an integer or text; rows without a group are dropped.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("of\x00")).agg(F.count("*").alias("n\x00"))
    histogram = {r["n\x00"]: r["many"] for r in sizes.groupBy("n\x00").agg(F.count("*").alias("many")).collect()}
    places = df.sparkSession.createDataFrame(dealt(histogram, k), "`size\x00` long, `first\x00` long, `end\x00` long, fold int")
    ranked = hash_ranked(sizes, "of\x00", seed, "rank\x00", by="n\x00")
    on = (F.col("n\x00") == F.col("size\x00")) & (F.col("rank\x00") > F.col("first\x00")) & (F.col("rank\x00") <= F.col("end\x00"))
    folded = ranked.join(places, on).select("of\x00", "fold")
    return df.join(folded, F.col(group) == F.col("of\x00")).select(*df.columns, "fold")


def curve_sizes(n: int) -> list[int]:
    """Training sizes of a learning curve: 8 to 20 points from a fifth of the rows to all."""
    points = min(20, max(8, round(n / 80)))
    return [round(n * (0.2 + 0.8 * i / (points - 1))) for i in range(points)]


def nested_prefixes(df: DataFrame, key: str, sizes: list[int], seed: int = 42) -> DataFrame:
    """Rows with ``size`` for each training size that includes them; smaller sets lie within larger ones."""
    ranked = hash_ranked(df, key, seed, "rank\x00")
    fitting = F.filter(F.array(*map(F.lit, sizes)), lambda s: F.col("rank\x00") <= s)
    return ranked.withColumn("size", F.explode(fitting)).drop("rank\x00")


def out_of_fold(predictions: DataFrame, key: str, prediction: str, truth: str) -> DataFrame:
    """One row a key: the mean of its predictions over repeats."""
    return predictions.groupBy(key).agg(F.first(truth).alias(truth), F.avg(prediction).alias(prediction))


