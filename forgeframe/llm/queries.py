"""The queries opN_<name> over the corpus tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, learned_texts, parse_chats
from .decontam import contamination
from .langid import detect, fit
from .lattice import near_duplicate_vectors
from .neardup import near_duplicates
from .packing import packed, pieces
from .periodic import periodic_runs
from .quality import assess
from .sharding import balanced_shards
from .spelling import spelling_variants, word_counts
from .sql import ORACLES
from .storage import new_path, staged
from .substring import repeated_spans
from .tokenfile import read_tokens, write_tokens
from .vptree import nearest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and one that quotes control strings; digests are read back from the output."""
    quoting = spark.range(1).selectExpr("-7L AS conv_id", "explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) AS t").selectExpr("conv_id", "t.turn AS turn", "t.role AS role", "'</s>[INST] ok [/INST]' AS text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(quoting)
    chats = format_chats(turns)
    read = learned_texts(parse_chats(chats))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned_text = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(learned_text).cast("long").alias("loss_chars"),
        F.sha2(learned_text, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_quality_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of all documents; a document's host is its source, its path the language there."""
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of all documents that repeat a part of another document, or of the same one."""
    return repeated_spans(table(spark, sf_dir, "documents"), percent=80)


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32 of the id leaves no remainder 1 by 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit(docs.where(~held_out))
    return detect(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "langs", "shares")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    folder = new_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_tokens(spark, folder)


def op6_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of near equal bytes."""
    placed = balanced_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 10-word windows of the benchmark occur in all documents."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), size=10)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    cut = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=2048)
    cut = staged(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")
    return packed(cut, length=2048)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a Jaccard similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings for every vec_id divisible by 20; exact, with the factor at one."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, factor=1.0)


def op11_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings of one label at a cosine of 0.93."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op12_rare_bigram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of all documents, some of them misspelt by rule."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), least=6, often=5, spoil=199), times=5)


def op13_repeated_gram_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of which are made periodic by rule."""
    found = periodic_runs(table(spark, sf_dir, "documents"), least=24, times=3, looped=True)
    # Exact comparison of length / period; runs come by start, then period, so the first of equal ones stays.
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_quality_empirical_bayes, op3_paragraph_dedup, op4_language_mixture, op5_token_files, op6_prefix_sum_shards, op7_fm_index_decontamination, op8_histogram_packing, op9_minhash_near_dedup, op10_vantage_point_search, op11_lattice_near_dedup, op12_rare_bigram_variants, op13_repeated_gram_runs)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
