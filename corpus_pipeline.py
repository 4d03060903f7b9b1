"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents. Written as Parquet after each stage and read again.

In every stage each row is a document of its own, also where doc_ids are null or repeat, and columns of
``docs`` beside doc_id, text and lang may have any names: they come back as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeframe.llm.decontam import remove_contamination
from forgeframe.llm.langid import UNKNOWN, detect, fit
from forgeframe.llm.neardup import keep_first
from forgeframe.llm.packing import packed, pieces
from forgeframe.llm.storage import release, staged
from forgeframe.llm.substring import remove_repeats

#: No stage can be said in SQL as a whole (models, tokenizers); tests compare each with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language: those without any letter, and null texts, go. Labels are learned from all of ``docs``.

    Null labels are no labels. Rows that repeat are judged one by one. Without any label all go. Empty
    table: no rows.
    """
    model = fit(docs)
    apart = docs.toDF(*("text" if c == "text" else f"own {k}" for k, c in enumerate(docs.columns)))
    return detect(apart, model).where(F.col("lang_pred") != UNKNOWN).select(*apart.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates (Jaccard 0.8 on 5-word shingles).

    Of equal rows one stays; different texts under one doc_id are judged each; null doc_ids come last in a
    group. Null and wordless texts all stay. Empty table: no rows.
    """
    return keep_first(docs, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the parts that repeat earlier ones; a document of which nothing is left goes.

    Earlier is by doc_id, nulls last, then by place; the rows of one doc_id are documents of their own.
    Null and empty texts stay as they are. Empty table: no rows.
    """
    return _measured(remove_repeats(docs, percent=80, keep_emptied=False), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that benchmark windows occur in; a document of which nothing is left goes.

    Null and empty texts stay as they are. Empty tables: no rows, or nothing is cut.
    """
    left = remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_emptied=False)
    return _measured(left, docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, with their places in sequences of 2048.

    Null text: the end id alone. Rows that repeat are all packed. Columns beside doc_id and text are left
    out. Empty table: no rows.
    """
    cut_up = pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed(staged(cut_up.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces"))


def _measured(docs: DataFrame, names: list[str]) -> DataFrame:
    """``n_chars``, where there is one, as the text now has; null for a null text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*names) if "n_chars" in names else docs.select(*names)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each written and read again; a stage's table goes when the next has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        release(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    release(docs)
    return out
