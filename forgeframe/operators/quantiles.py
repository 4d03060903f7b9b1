"""Exact quantiles of whole tables, by counts of ever narrower ranges: no task or driver holds the values."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values that a global range of ``group_quantiles`` holds on average, and most ranges.
RANGE_VALUES, MOST_RANGES = 50_000, 10_000
#: Bytes of a table, as its plan estimates them, whose values one aggregation may count at once.
SMALL_BYTES = 8 << 20
#: Ranges that one pass counts within each range that still holds a wanted rank: most and least of one, about as many in all; rows from which on it counts values instead.
RANGES, LEAST_RANGES, ALL_RANGES, FEW = 1024, 64, 1 << 16, 4096
#: Columns whose extremes one aggregation finds side by side.
SIDE_BY_SIDE = 16


def _inside(df: DataFrame, values: DataFrame, names: list[str], ranges: list[tuple]) -> DataFrame:
    """(*names, c, k, v, low, high, few): each value once for every range ((c, *group), k, low, high, few) of its column and group that holds it."""
    kinds = [T.StructField(f"{n} of range", values.schema[n].dataType) for n in names]
    schema = T.StructType([T.StructField("c of range", T.IntegerType()), *kinds, T.StructField("k", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("few", T.BooleanType())])
    table = df.sparkSession.createDataFrame([(*key, k, low, high, few) for key, k, low, high, few in ranges], schema)
    on = (F.col("c") == F.col("c of range")) & F.col("v").between(F.col("low"), F.col("high"))
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n} of range"))
    return values.join(F.broadcast(table), on)


def _tallies(ranges: list[tuple], bins: int):
    """Of batches of columns: a row (c, k, bin, one, n, low, high) for each part of a range ((c,), k, low, high, few) with values, or each value of one of few. Ranges don't overlap."""
    sides = []
    for c in sorted({key[0] for key, *_ in ranges}):
        own = sorted((low, high, k, few) for (at,), k, low, high, few in ranges if at == c)
        low, high, k, few = (np.array(x) for x in zip(*own, strict=True))
        sides.append((c, low, high, k, few))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(k) * bins, np.int64) for *_, k, _ in sides]
        least, most = ([np.full(len(x), end) for x in n] for end in (np.inf, -np.inf))
        single = [[(np.zeros(0, int), np.zeros(0), np.zeros(0, int))] for _ in sides]
        for batch in batches:
            for s, (c, low, high, _, few) in enumerate(sides):
                v = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
                v = v[v >= low[0]]
                at = np.searchsorted(low, v, "right") - 1
                there = v <= high[at]
                v, at = v[there], at[there]
                alone = few[at]
                if alone.any():
                    x, times = np.unique(v[alone], return_counts=True)
                    single[s].append((np.searchsorted(low, x, "right") - 1, x, times))
                    v, at = v[~alone], at[~alone]
                place = np.floor((v * 0.5 - low[at] * 0.5) / (high[at] * 0.5 - low[at] * 0.5) * bins).astype(np.int64)
                place = np.minimum(place, bins - 1) + at * bins
                np.add.at(n[s], place, 1)
                np.minimum.at(least[s], place, v)
                np.maximum.at(most[s], place, v)
            # Values of few come again with each batch; they are made one before they pile up.
            single = [[_summed(x)] if len(x) > 64 else x for x in single]
        for s, (c, _, _, k, _) in enumerate(sides):
            full = np.flatnonzero(n[s])
            at, one, times = _summed(single[s])
            nothing = pa.nulls(len(full), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in (np.full(len(full), c), k[full // bins], full % bins, nothing, n[s][full], least[s][full], most[s][full])], names=NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in (np.full(len(at), c), k[at], pa.nulls(len(at), pa.int64()), one, times, one, one)], names=NAMES)

    return run


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(range, value, times) of several such, each value once."""
    at, v, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    one, first, back = np.unique(v, return_index=True, return_inverse=True)
    return at[first], one, np.bincount(back.reshape(-1), times, len(one)).astype(np.int64)


NAMES = ["c", "k", "bin", "one", "n", "low", "high"]


def _is_small(df: DataFrame) -> bool:
    """Whether the plan of ``df`` reads and makes so little that its values fit into one aggregation; unknown sizes count as large."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES


def _finite(column: str):
    v = F.col(column).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _endless(column: str):
    v = F.col(column).cast("double")
    return F.count_if(~F.isnan(v) & (F.abs(v) == float("inf")))


def quantiles(df: DataFrame, columns: list[str], shares: list[float], by: list[str] | None = None) -> dict[tuple, list[float | None]]:
    """(column, *group values): the quantiles at ``shares``, by linear interpolation between ranks; nulls and NaN are left out.

    One pass finds counts and extremes. Each further one counts RANGES equal ranges between the extremes
    of every range that holds a wanted rank, until the range is one value: two to four passes as a rule.
    Tasks combine their counts before the shuffle, so what moves is bounded by ranges, columns and groups,
    whatever the number of rows; there must be few groups. Without groups a value finds its range by binary search, so many shares cost
    little more than one. A column without values, or a group's, has nulls.
    A table of SMALL_BYTES at most, without infinite values, takes one aggregation of all values instead.
    """
    by = list(by or [])
    if not by and shares and _is_small(df.select(*columns)):
        row = df.agg(*(F.percentile(_finite(c), F.array(*map(F.lit, map(float, shares)))) for c in columns), *(_endless(c) for c in columns)).first()
        if not any(row[len(columns) :]):
            return {(c,): [None] * len(shares) if row[k] is None else list(row[k]) for k, c in enumerate(columns)}
    inf = float("inf")
    cell = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)]))
    names = [f"g{k}" for k in range(len(by))]
    values = df.select(*[F.col(g).alias(n) for g, n in zip(by, names, strict=True)], cell.alias("x")).select(*names, "x.c", "x.v")
    values = values.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    inside = F.when(F.abs("v") != inf, F.col("v"))
    facts = []
    if not by and len(columns) <= SIDE_BY_SIDE:
        found = []
        for c in columns:
            v = F.col(c).cast("double")
            found += [F.count(F.when(~F.isnan(v), v)), F.count_if(v == -inf), F.count(_finite(c)), F.min(_finite(c)), F.max(_finite(c))]
        row = df.agg(*(x.alias(f"x{i}") for i, x in enumerate(found))).first()
        facts = [dict(zip(("c", "n", "under", "finite", "low", "high"), (k, *row[5 * k : 5 * k + 5]), strict=True)) for k in range(len(columns))]
    else:
        facts = values.groupBy(*names, "c").agg(F.count("v").alias("n"), F.count_if(F.col("v") == -inf).alias("under"), F.count(inside).alias("finite"), F.min(inside).alias("low"), F.max(inside).alias("high")).collect()
    wanted: dict[tuple, dict[int, float | None]] = {}
    todo: dict[tuple, list[tuple[float, float, int, int]]] = {}
    for row in facts:
        key, n = (row["c"], *(row[g] for g in names)), row["n"]
        ranks = {r for p in shares for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))} if n else set()
        wanted[key] = {r: -inf if r < row["under"] else inf for r in ranks}
        if row["low"] is not None:
            todo[key] = [(row["low"], row["high"], row["under"], row["finite"])]
    size = {(row["c"], *(row[g] for g in names)): row["n"] for row in facts}
    while todo:
        open_ranges = []
        for key, ranges in todo.items():
            for k, (low, high, before, n) in enumerate(ranges):
                if low == high:
                    for r in wanted[key]:
                        if before <= r < before + n:
                            wanted[key][r] = low
                else:
                    open_ranges.append((key, k, low, high, n <= FEW))
        if not open_ranges:
            break
        parts = max(LEAST_RANGES, min(RANGES, ALL_RANGES // len(open_ranges)))
        if by:
            found = _inside(df, values, names, open_ranges)
            place = F.floor((F.col("v") * 0.5 - F.col("low") * 0.5) / (F.col("high") * 0.5 - F.col("low") * 0.5) * parts)
            bins = found.select(*names, "c", "k", "v", F.when(F.col("few"), F.lit(None)).otherwise(F.least(place, F.lit(parts - 1))).alias("bin"), F.when(F.col("few"), F.col("v")).alias("one"))
            rows = bins.groupBy(*names, "c", "k", "bin", "one").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        else:
            counted = df.select(*(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns))).mapInArrow(_tallies(open_ranges, parts), "c long, k long, bin long, one double, n long, low double, high double")
            rows = counted.groupBy("c", "k", "bin", "one").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow().to_pylist()
        held: dict[tuple, dict[int, list]] = {}
        for row in rows:
            held.setdefault((row["c"], *(row[g] for g in names)), {}).setdefault(row["k"], []).append((row["low"], row["high"], row["n"]))
        following: dict[tuple, list[tuple[float, float, int, int]]] = {}
        for key, ks in held.items():
            ranks = sorted(wanted[key])
            for k, bins in ks.items():
                before = todo[key][k][2]
                for low, high, n in sorted(bins):
                    if bisect.bisect_left(ranks, before) < bisect.bisect_left(ranks, before + n):
                        following.setdefault(key, []).append((low, high, before, n))
                    before += n
        todo = following
    out: dict[tuple, list[float | None]] = {}
    for key, ranks in wanted.items():
        n, at = size[key], []
        for p in shares:
            if not n:
                at.append(None)
                continue
            place = (n - 1) * p
            a, b = ranks[math.floor(place)], ranks[math.ceil(place)]
            at.append(a if a == b else a + (b - a) * (place - math.floor(place)))
        out[(columns[key[0]], *key[1:])] = at
    for c in columns:
        if not by:
            out.setdefault((c,), [None] * len(shares))
    return out


def group_quantiles(df: DataFrame, column: str, shares: list[float], by: list[str]) -> DataFrame:
    """(*by, q0, q1, ...): the quantiles at ``shares`` of each group, as ``quantiles`` gives them, for any number of groups of any size.

    Null keys are a group; one without values has nulls. Values are counted by group before anything else, so equal ones are one row. The table's own
    quantiles, roughly, divide all values into ranges of about RANGE_VALUES: a group's wanted ranks are found by the counts of its ranges, then by ranks within the ranges
    that hold them, which no group can make large. Only the ranges' ends come to the driver. A table of SMALL_BYTES at most, without infinite values, takes one aggregation instead.
    """
    if shares and _is_small(df.select(*by, column)) and not df.agg(_endless(column)).first()[0]:
        found = df.groupBy(*by).agg(F.percentile(_finite(column), F.array(*map(F.lit, map(float, shares)))).alias("q\x00"))
        return found.select(*by, *(F.get("q\x00", F.lit(k)).alias(f"q{k}") for k in range(len(shares))))
    names = [f"g{k}\x00" for k in range(len(by))]
    v = F.col(column).cast("double")
    values = df.select(*[F.col(g).alias(n) for g, n in zip(by, names, strict=True)], F.when(~F.isnan(v), v).alias("v"))
    n = values.agg(F.count("v")).first()[0]
    ranges = min(MOST_RANGES, max(1, n // RANGE_VALUES))
    ends = values.agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else []
    above = F.size(F.filter(F.array(*map(F.lit, dict.fromkeys(ends))), lambda e: e < F.col("v"))) if ends else F.lit(0)
    counted = values.where("v is not null").groupBy(*names, "v").agg(F.count("*").alias("n")).withColumn("range", above)
    by_range = counted.groupBy(*names, "range").agg(F.sum("n").alias("here"))
    order = Window.partitionBy(*names)
    by_range = by_range.withColumns({"before": F.sum("here").over(order.orderBy("range")) - F.col("here"), "all": F.sum("here").over(order)})
    ranks = [f(F.lit(p) * (F.col("all") - 1)).cast("long") for p in shares for f in (F.floor, F.ceil)]
    by_range = by_range.withColumn("ranks", F.filter(F.array_distinct(F.array(*ranks)), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("here")))).where(F.size("ranks") > 0)
    renamed = by_range.select(*(F.col(c).alias(f"{c}of") for c in names), F.col("range").alias("range of"), "before", "all", "ranks")
    on = F.col("range") == F.col("range of")
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}of"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*names, "range").orderBy("v"))
    found = counted.join(renamed, on).withColumn("upto", upto)
    at = found.withColumn("rank", F.explode(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))).select(*names, "all", "rank", "v")

    def value(p: float, f):
        return F.max(F.when(F.col("rank") == f(F.lit(p) * (F.col("all") - 1)).cast("long"), F.col("v")))

    def between(p: float):
        a, b, place = value(p, F.floor), value(p, F.ceil), F.lit(p) * (F.max("all") - 1)
        return F.when(a == b, a).otherwise(a + (b - a) * (place - F.floor(place)))

    out = at.groupBy(*names).agg(*(between(p).alias(f"q{k}") for k, p in enumerate(shares)))
    keys = values.select(*names).distinct().select(*(F.col(c).alias(f"{c}of") for c in names))
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}of"))
    return keys.join(out, on, "left").select(*(F.col(f"{c}of").alias(g) for c, g in zip(names, by, strict=True)), *(f"q{k}" for k in range(len(shares))))
