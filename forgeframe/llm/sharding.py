"""Contiguous shards of near equal size, from prefix sums of byte sizes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import ranges, staged

SHARDS = 16


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs`` (doc_id, text).

    Rows are ordered by doc_id and cut into ``shards`` contiguous runs at equal byte targets: a row
    belongs to the shard in which the middle of its bytes falls, so a shard misses its share by a row
    at most. ``size`` is the text's UTF-8 bytes plus 1, ``slot`` the row's place in its shard.

    Null text: no bytes, crc of nothing. Null doc_ids come first. Rows that repeat a doc_id follow the
    table's order; however many rows share one, they spread over tasks and shards. A single text larger
    than a share leaves shards empty. Empty table: no rows. Other columns are ignored.

    Texts are read once and never shuffled. Only partition totals are gathered, one row a partition.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    slim = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.monotonically_increasing_id().alias("nth"))
    slim = staged(slim, "sizes")
    ordered = staged(slim.repartitionByRange(ranges(slim), "doc_id", "nth").withColumn("part", F.spark_partition_id()), "ordered")
    within = Window.partitionBy("part").orderBy("doc_id", "nth")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(everything).alias("total"))
    placed = ordered.withColumns({"upto": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)), "nth_in_part": F.row_number().over(within)})
    placed = placed.join(F.broadcast(totals), "part")
    middle = (F.col("bytes_before") + F.col("upto")) * 2 - F.col("size")
    shard = F.expr(f"least({shards - 1}, (middle * {shards}) div (total * 2))").cast("int")
    placed = placed.withColumn("middle", middle).select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("nth_in_part") - 1).alias("row"))
    placed = staged(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
