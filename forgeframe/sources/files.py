"""Reading and writing tables: CSV, Excel, JSON, shards; images as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.profile import nan_to_null, numeric_columns, text_columns
from .excel import read_excel

#: Rows of one written shard of records, and of one written chunk of captions.
RECORDS, CHUNK = 128, 26_800


def load(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or an Excel file for any other ending, with types inferred (S01); NaN is null, names are unique."""
    if path.lower().endswith(".csv"):
        df = spark.read.option("header", True).option("inferSchema", True).option("nanValue", "nan").csv(path)
        return nan_to_null(df)
    return nan_to_null(read_excel(spark, path))


def unique_names(df: DataFrame) -> DataFrame:
    """Of columns with one name, the first."""
    positions = {}
    for i, c in enumerate(df.columns):
        positions.setdefault(c, i)
    return df.toDF(*[str(i) for i in range(len(df.columns))]).select(*[F.col(str(i)).alias(c) for c, i in positions.items()])


def columns_by_kind(df: DataFrame) -> dict[str, list[str]]:
    """Numeric and text columns."""
    return {"numeric": numeric_columns(df), "text": text_columns(df)}


def with_row_id(df: DataFrame, name: str = "__rid") -> DataFrame:
    """Rows numbered by place: unique, ascending in the table's order, with gaps between partitions."""
    return df.withColumn(name, F.monotonically_increasing_id())


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header (K01). A byte-order mark needs a single file of a size for one task: the header's first name carries it."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]).coalesce(1)
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record a line, other scripts kept as they are."""
    df.write.json(path)


def captions(spark: SparkSession, path: str, folder: str = "") -> DataFrame:
    """(path, caption) of lines ``id,structure`` (S08). A malformed line has a null caption, not its neighbour's."""
    parts = F.split("value", ",", 2)
    text = F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit(""))
    return spark.read.text(path).where(F.trim("value") != "").select(F.concat(F.lit(folder), F.trim(F.get(parts, F.lit(0))), F.lit(".png")).alias("path"), F.concat(F.lit("<start> "), text, F.lit(" <end>")).alias("caption"))


def natural_order(path: Column) -> Column:
    """The first number of a file name, to sort shards by."""
    return F.regexp_extract(path, r"(\d+)", 1).try_cast("long")


def record_shards(df: DataFrame, order_by: str, size: int = RECORDS, keep_rest: bool = False) -> DataFrame:
    """``df`` with its ``shard`` of consecutive rows (K08): n // size shards of equal size, the rest goes unless kept.

    Ranks come from range partitions and their totals, so no task numbers all rows.
    """
    n = df.count()
    shards = max(1, n // size)
    each = n // shards
    ranked = _ranked(df, order_by)
    out = ranked.withColumn("shard", F.floor(F.col("rank\x00") / each).cast("int")).drop("rank\x00")
    return out.withColumn("shard", F.least("shard", F.lit(shards - 1))) if keep_rest else out.where(F.col("shard") < shards)


def caption_chunks(df: DataFrame, order_by: str, size: int = CHUNK) -> DataFrame:
    """``df`` with its ``chunk``; a trailing part of a chunk goes."""
    whole = df.count() // size
    return _ranked(df, order_by).withColumn("chunk", F.floor(F.col("rank\x00") / size).cast("int")).drop("rank\x00").where(F.col("chunk") < whole)


def _ranked(df: DataFrame, order_by: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, order_by).withColumn("part\x00", F.spark_partition_id())
    totals = ordered.groupBy("part\x00").agg(F.count("*").alias("n\x00"))
    before = totals.select("part\x00", (F.sum("n\x00").over(Window.orderBy("part\x00")) - F.col("n\x00")).alias("before\x00"))
    within = F.row_number().over(Window.partitionBy("part\x00").orderBy(order_by)) - 1
    return ordered.withColumn("w\x00", within).join(F.broadcast(before), "part\x00").select(*df.columns, (F.col("w\x00") + F.col("before\x00")).alias("rank\x00"))


def images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of image files (S07); pages of PDF files need a library that isn't here."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def gray_bounds(pixels: Column, empty: int = 255) -> Column:
    """Rows and columns of a gray image (array of arrays) that hold anything but ``empty``."""
    rows = F.filter(F.transform(pixels, lambda r, i: F.when(F.exists(r, lambda p: p != empty), i)), lambda i: i.isNotNull())
    used = F.flatten(F.transform(pixels, lambda r: F.filter(F.transform(r, lambda p, j: F.when(p != empty, j)), lambda j: j.isNotNull())))
    return F.struct(F.array_min(rows).alias("top"), F.array_max(rows).alias("bottom"), F.array_min(used).alias("left"), F.array_max(used).alias("right"))


def crop(pixels: Column, bounds: Column) -> Column:
    """The part of a gray image within bounds."""
    rows = F.slice(pixels, bounds["top"] + 1, bounds["bottom"] - bounds["top"] + 1)
    return F.transform(rows, lambda r: F.slice(r, bounds["left"] + 1, bounds["right"] - bounds["left"] + 1))


def contrast(pixels: Column, factor: float = 1.8) -> Column:
    """Gray values moved away from the image's mean."""
    flat = F.flatten(pixels)
    mean = F.round(F.aggregate(flat, F.lit(0.0), lambda a, p: a + p) / F.size(flat))
    return F.transform(pixels, lambda r: F.transform(r, lambda p: F.least(F.greatest(F.round(mean + (p - mean) * factor), F.lit(0.0)), F.lit(255.0)).cast("int")))
