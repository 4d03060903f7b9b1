"""Words to ids and back: a vocabulary of the most frequent words, padded id rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD, UNKNOWN = 0, 1


def vocabulary(df: DataFrame, text: str, k: int = 500) -> DataFrame:
    """(word, n, word_id) of the ``k`` most frequent words, ties by word; ids follow those of padding and unknown."""
    words = df.select(F.explode(F.split(F.lower(text), r"\s+")).alias("word")).where("word <> ''")
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(k)
    return top.withColumn("word_id", F.expr("row_number() OVER (ORDER BY n DESC, word)").cast("int") + UNKNOWN)


def encode(df: DataFrame, text: str, words: DataFrame, length: int, name: str = "ids") -> DataFrame:
    """``df`` with ids of its words, unknown ones 1, cut or padded with 0 at the end to ``length`` (T20). ``words`` has at most k rows."""
    known = {r["word"]: r["word_id"] for r in words.select("word", "word_id").collect()}
    table = F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*map(F.lit, known.values()))) if known else F.create_map().cast("map<string,int>")
    parts = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    ids = F.transform(parts, lambda w: F.coalesce(F.try_element_at(table, w), F.lit(UNKNOWN)))
    padded = F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(PAD), F.greatest(F.lit(0), F.lit(length) - F.size(ids))))
    return df.withColumn(name, padded)


def train_validation(df: DataFrame, order_by: str, n_train: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n_train`` rows by ``order_by``, and the others."""
    from ..sources.files import _ranked

    ranked = _ranked(df, order_by)
    return ranked.where(F.col("rank\x00") < n_train).drop("rank\x00"), ranked.where(F.col("rank\x00") >= n_train).drop("rank\x00")
