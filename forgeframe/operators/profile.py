"""Profiles of tables: one pass over the data for all columns, then one row a column."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import group_quantiles, quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def one_of(column: str, values: dict[str, float | None]) -> Column:
    """The number that goes with the name in ``column``."""
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(F.col(column) == name, F.lit(value).cast("double")).otherwise(out)
    return out


def by_column(df: DataFrame, columns: list[str], facts: dict) -> DataFrame:
    """One row a column with ``facts`` (name: function of a column giving an aggregate), from one aggregation."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}\x00{n}").alias(n) for n in facts]) for c in columns])
    aggregates = [f(F.col(c)).alias(f"{c}\x00{n}") for c in columns for n, f in facts.items()]
    return df.agg(*aggregates).select(F.inline(rows))


def is_missing(c: Column, kind: T.DataType) -> Column:
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null, in all floating columns."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def summary(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric and other columns, missing cells."""
    missing = sum((F.count_if(is_missing(F.col(f.name), f.dataType)) for f in df.schema), F.lit(0).cast("long"))
    numbers = len(numeric_columns(df))
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.lit(numbers).alias("n_numeric"), F.lit(len(df.columns) - numbers).alias("n_other"), missing.alias("n_missing"))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of each numeric column."""
    columns = columns or numeric_columns(df)
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75])
    out = by_column(df, columns, {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")})
    for k, name in enumerate(("q25", "q50", "q75")):
        out = out.withColumn(name, one_of("column", {c: quartiles[(c,)][k] for c in columns}))
    return out.select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def missing_table(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Missing cells of each column and their share in percent."""
    kinds = {f.name: f.dataType for f in df.schema}
    aggregates = [F.count_if(is_missing(F.col(c), k)).alias(c) for c, k in kinds.items()]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in kinds])
    out = df.agg(*aggregates, F.count("*").alias("\x00n")).select(F.inline(rows), "\x00n")
    out = out.select("column", "n_missing", F.coalesce(F.try_divide(F.col("n_missing") * 100.0, F.col("\x00n")), F.lit(0.0)).alias("missing_percent"))
    return out.where("n_missing > 0") if only_missing else out


def non_null_ratio(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of present values of each column."""
    return by_column(df, columns or numeric_columns(df), {"ratio": lambda c: F.avg(c.isNotNull().cast("double"))})


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows that have both; null for a constant side."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, r) for each pair of columns in order."""
    pairs = list(combinations(columns or numeric_columns(df), 2))
    aggregates = [correlation(F.col(a), F.col(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return df.agg(*aggregates).select(F.inline(rows))


def high_correlations(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Pairs of at least ``threshold``, strongest first."""
    return correlations(df, columns).where(F.abs("r") >= threshold).orderBy(F.abs("r").desc(), "a", "b")


def target_correlations(df: DataFrame, target: str, columns: list[str] | None = None, k: int | None = None) -> DataFrame:
    """(column, r) with the target, strongest first, the ``k`` first (P06, X03). Undefined ones come last."""
    columns = [c for c in columns or numeric_columns(df) if c != target]
    out = by_column(df, columns, {"r": lambda c: correlation(c, F.col(target))}).orderBy(F.abs("r").desc_nulls_last(), "column")
    return out.limit(k) if k else out


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """(bin, n) over equal bins of [low, high]; the last one is closed, values outside fall into the end bins."""
    place = F.floor((F.col(column) - low) / ((high - low) / bins)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def box_statistics(df: DataFrame, column: str, by: list[str], reach: float = 1.5) -> DataFrame:
    """Quartiles by group, and whiskers: the outermost values within ``reach`` quartile ranges (P08). Rows of null keys are left out."""
    names = {"q0": "q25", "q1": "q50", "q2": "q75"}
    if by:
        joined = df.join(group_quantiles(df, column, [0.25, 0.5, 0.75], by).withColumnsRenamed(names), by)
    else:
        joined = df.crossJoin(df.sparkSession.createDataFrame([tuple(quantiles(df, [column], [0.25, 0.5, 0.75])[(column,)])], "q25 double, q50 double, q75 double"))
    span = (F.col("q75") - F.col("q25")) * reach
    inside = F.col(column).between(F.col("q25") - span, F.col("q75") + span)
    return joined.groupBy(*by, "q25", "q50", "q75").agg(F.min(F.when(inside, F.col(column))).alias("low"), F.max(F.when(inside, F.col(column))).alias("high"), F.count_if(~inside).alias("n_outside"))


def target_analysis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values present of each possible target, as count and as text in percent (P10)."""
    out = by_column(df, columns or numeric_columns(df), {"n_valid": F.count, "n_null": lambda c: F.count_if(c.isNull())})
    share = F.coalesce(F.try_divide(F.col("n_valid") * 100.0, F.col("n_valid") + F.col("n_null")), F.lit(0.0))
    return out.select("column", "n_valid", F.format_string("%.1f%%", share).alias("valid_ratio"), "n_null").orderBy(F.col("n_valid").desc(), "column")


def feature_validity(df: DataFrame, target: str, columns: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """How many rows that have the target have each feature; recommended from a share of ``least`` on."""
    columns = [c for c in columns or numeric_columns(df) if c != target]
    out = by_column(df.where(F.col(target).isNotNull()), columns, {"n_valid": F.count, "n": lambda c: F.count(F.lit(1))})
    share = F.try_divide(F.col("n_valid"), F.col("n"))
    return out.select("column", "n_valid", "n", F.coalesce(share >= least, F.lit(False)).alias("recommended"))


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells, missing cells and their rate, rows with any, columns missing in over 30 percent."""
    gone = [F.col(c).isNull() for c in columns]
    n = [F.count_if(g) for g in gone]
    total, anywhere = n[0], gone[0]
    for x, g in zip(n[1:], gone[1:], strict=True):
        total, anywhere = total + x, anywhere | g
    many = sum((F.when(F.try_divide(x, F.count("*")) > 0.3, 1).otherwise(0) for x in n), F.lit(0))
    cells = F.count("*") * len(columns)
    return df.agg(cells.alias("n_cells"), total.alias("n_missing"), F.coalesce(F.try_divide(total, cells), F.lit(0.0)).alias("rate"), F.count_if(anywhere).alias("rows_with_missing"), many.alias("columns_over_30_percent"))


def missing_strategy(model: str) -> str:
    """How to treat missing values for a model: trees that take them need nothing."""
    return "model_native" if model.lower() in {"xgboost", "lightgbm", "catboost"} else "median"


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one."""
    return df.groupBy(*df.columns).agg((F.count("*") - 1).alias("again")).agg(F.coalesce(F.sum("again"), F.lit(0)).alias("n_duplicates"))


def key_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys and the rows that merging by key would save."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_mergeable"))


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """(value, n), nulls too, most frequent first."""
    out = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return out.limit(k) if k else out


def count_statistics(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, largest and median count."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("n_unique"), F.max("n").alias("largest"), F.lit(quantiles(counts, ["n"], [0.5])[("n",)][0]).cast("double").alias("median"))


def infinite_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Infinite values of each column."""
    return by_column(df, columns or numeric_columns(df), {"n_infinite": lambda c: F.count_if(F.abs(c) == float("inf"))})


def parse_success(df: DataFrame, column: str, valid, order_by: str, k: int = 200) -> DataFrame:
    """Of the first ``k`` texts present, how many ``valid`` accepts, and examples that it doesn't."""
    first = df.where(F.trim(column) != "").orderBy(order_by).limit(k).withColumn("ok", valid(F.col(column)))
    return first.agg(F.count("*").alias("n_checked"), F.count_if("ok").alias("n_valid"), F.slice(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col(column)))), 1, 5).alias("bad_examples"))
