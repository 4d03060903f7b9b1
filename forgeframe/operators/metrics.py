"""Scores of predictions, residuals, histories, standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import union_all, with_row_of
from .quantiles import quantiles


def r2(y: Column, p: Column) -> Column:
    """1 - residual sum of squares / total sum of squares, in one pass; null where the truth is constant."""
    return F.lit(1.0) - F.try_divide(F.sum((y - p) * (y - p)), F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0)))


def scores(df: DataFrame, truth: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """R2, RMSE and MAE, over all rows or by group."""
    y, p = F.col(truth), F.col(prediction)
    return df.groupBy(*(by or [])).agg(r2(y, p).alias("r2"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"))


def score_spread(fold_scores: DataFrame) -> DataFrame:
    """Mean and sample deviation of fold scores."""
    return fold_scores.agg(*(f(s).alias(f"{s}_{n}") for s in ("r2", "rmse", "mae") for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def residuals(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """True_Value, Predicted_Value, Residual."""
    return df.select(F.col(truth).alias("True_Value"), F.col(prediction).alias("Predicted_Value"), (F.col(truth) - F.col(prediction)).alias("Residual"))


def parity(train: DataFrame, test: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Residuals of both sides with the side's name in ``Set``."""
    return union_all(residuals(train, truth, prediction).withColumn("Set", F.lit("train")), residuals(test, truth, prediction).withColumn("Set", F.lit("test")))


def standardise(train: DataFrame, columns: list[str], also: DataFrame | None = None) -> DataFrame:
    """Median-filled, then scaled to mean 0 and population deviation 1, all learned on ``train`` (M07). Flat columns become 0."""
    medians = quantiles(train, columns, [0.5])
    fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[(c,)][0])) for c in columns}
    facts = train.withColumns(fill).agg(*(F.avg(c).alias(f"{c}\x00m") for c in columns), *(F.stddev_pop(c).alias(f"{c}\x00s") for c in columns))
    df = also if also is not None else train
    both = with_row_of(df.withColumns(fill), facts)
    return both.withColumns({c: (F.col(c) - F.col(f"{c}\x00m")) / F.coalesce(F.nullif(F.col(f"{c}\x00s"), F.lit(0.0)), F.lit(1.0)) for c in columns}).select(*df.columns)


#: Columns by parts that one aggregation of ``standards`` measures.
TOGETHER = 64


def standards(df: DataFrame, columns: list[str], parts: list[Column]) -> list[dict[str, tuple[float | None, float | None, float | None]]]:
    """For each part of the rows, a condition: (median, mean, population deviation) by column, the latter two with missing values as the median.

    The parts (training rows of all folds, of all sizes) are measured together, in as many passes as one takes.
    """
    if len(parts) > 1 and len(parts) * len(columns) > TOGETHER:
        return [standards(df, columns, [p])[0] for p in parts]
    wide = df.select(*(F.when(p, F.col(c).cast("double")).alias(f"{i}\x00{c}") for i, p in enumerate(parts) for c in columns), *(p.alias(f"{i}\x00") for i, p in enumerate(parts)))
    medians = quantiles(wide, [f"{i}\x00{c}" for i in range(len(parts)) for c in columns], [0.5])
    middle = {(i, c): medians[(f"{i}\x00{c}",)][0] for i in range(len(parts)) for c in columns}
    filled = {k: F.when(F.col(f"{k[0]}\x00"), F.coalesce(F.col(f"{k[0]}\x00{k[1]}"), F.lit(m).cast("double"))) for k, m in middle.items()}
    found = wide.agg(*(f(x).alias(f"x{j}{n}") for n, x in enumerate(filled.values()) for j, f in enumerate((F.avg, F.stddev_pop)))).first()
    facts = {k: (m, found[2 * n], found[2 * n + 1]) for n, (k, m) in enumerate(middle.items())}
    return [{c: facts[i, c] for c in columns} for i in range(len(parts))]


def standardised(df: DataFrame, facts: dict[str, tuple[float | None, float | None, float | None]]) -> DataFrame:
    """``df`` with the columns of ``facts`` filled and scaled by them, as ``standardise`` does."""
    lit = {c: [F.lit(x).cast("double") for x in three] for c, three in facts.items()}
    return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), m) - a) / F.coalesce(F.nullif(s, F.lit(0.0)), F.lit(1.0)) for c, (m, a, s) in lit.items()})


def history_table(history: DataFrame) -> DataFrame:
    """(step, name, value) rows from (name, values array); an rmse also gives its square as mse."""
    rows = history.select("name", F.posexplode("values").alias("step", "value"))
    squares = rows.where(F.col("name").endswith("rmse")).select(F.regexp_replace("name", "rmse$", "mse").alias("name"), "step", (F.col("value") * F.col("value")).alias("value"))
    return rows.unionByName(squares).select((F.col("step") + 1).alias("step"), "name", "value")


def model_history(model, data: DataFrame | None = None) -> list[float]:
    """The recorded curve of a fitted model, by what it has (M12): its own history, its summary's objective, or its losses.

    Boosted trees keep none; with ``data`` (features and target) their mean squared error after each tree is measured on it in one pass.
    """
    summary = model.summary if getattr(model, "hasSummary", False) else None
    for holder in (model, summary):
        for name in ("history", "objectiveHistory", "losses"):
            values = getattr(holder, name, None)
            if values is not None and not callable(values):
                return list(map(float, values))
    return [float(v) for v in model.evaluateEachIteration(data, "squared")] if data is not None and hasattr(model, "evaluateEachIteration") else []
