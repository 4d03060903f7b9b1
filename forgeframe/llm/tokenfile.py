"""Token ids in compressed files: one zstandard frame a document, all with one trained dictionary.

A file set is two tables in one folder:

* ``dictionary``: (hash, content), one row;
* ``blocks``: (part, block, before, first_id, last_id, doc_ids, n_tokens, ends, dictionary, payload), ordered
  by part, then block. ``payload`` holds the frames of some consecutive documents, ``ends`` where each frame
  ends, ``before`` the ids of the part's earlier blocks, ``first_id`` and ``last_id`` the block's least and
  largest doc_id. Each frame holds one document's ids, little-endian, two bytes each if the vocabulary
  allows, else four, and names its width in its first byte.

All columns but ``payload`` are the index; as columns are stored apart, reading it reads no payload.
``read_document`` looks a document up there: files whose ids don't span it are skipped by their
statistics, and one frame is cut out of one block and decompressed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import map_batches
from .storage import ranges, staged
from .textops import runs
from .tokenize import RUN_BYTES, encoder

END_ID = 0
#: The dictionary is trained on this many documents at most, those of the smallest hash of doc_id, of
#: texts of at most so many bytes each. It changes sizes only, never what is read back.
SAMPLE_DOCS, SAMPLE_BYTES = 512, 32 << 10
DICTIONARY_BYTES = 64 << 10
#: A block is closed at so many documents, or bytes of frames.
BLOCK_DOCS, BLOCK_BYTES = 1024, 256 << 10
LEVEL = 3
BLOCKS = "part int, block int, before long, first_id long, last_id long, doc_ids array<long>, n_tokens array<long>, ends array<long>, dictionary string, payload binary"


def serialized(ids: np.ndarray, width: int) -> bytes:
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def deserialized(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype("<u4")


def train(samples: list[bytes]) -> bytes:
    """A trained dictionary; from samples too few to train on, their own bytes serve."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[-DICTIONARY_BYTES:] + bytes(64))[: max(64, DICTIONARY_BYTES)]


def _sample(docs: DataFrame, path: str, width: int) -> list[bytes]:
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    texts = docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").where(F.octet_length("text") <= SAMPLE_BYTES).limit(2 * SAMPLE_DOCS).toArrow()
    out = []
    for run in runs(texts.column("text").combine_chunks()) if len(texts) else []:
        tokens, of = encoder(path).encode_with_end(run, END_ID)
        out += [serialized(tokens[a:b], width) for a, b in zip(of[:-1], of[1:], strict=True)]
    return out


def _written(path: str, content: bytes, name: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content))
        held: list[tuple] = []
        held_bytes = 0

        def closed() -> pa.RecordBatch:
            ids, counts, frames = zip(*held, strict=True)
            known = [i for i in ids if i is not None]
            made = [[part], [block], [before], [min(known, default=None)], [max(known, default=None)], [ids], [counts], [np.cumsum([len(f) for f in frames]).tolist()], [name], [b"".join(frames)]]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 3, pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for texts in runs(batch.column("text"), RUN_BYTES):
                tokens, of = encoder(path).encode_with_end(texts, END_ID)
                doc_ids = batch.column("doc_id").slice(texts.first, len(texts)).to_pylist()
                for doc_id, a, b in zip(doc_ids, of[:-1].tolist(), of[1:].tolist(), strict=True):
                    frame = press.compress(serialized(tokens[a:b], width))
                    held.append((doc_id, b - a, frame))
                    held_bytes += len(frame)
                    if len(held) >= BLOCK_DOCS or held_bytes >= BLOCK_BYTES:
                        yield closed()
                        block, before = block + 1, before + sum(x[1] for x in held)
                        held, held_bytes = [], 0
        if held:
            yield closed()

    return run


def write_tokens(docs: DataFrame, path: str, folder: str) -> None:
    """Encodes every text of ``docs`` (doc_id, text) and writes a file set into ``folder``, in doc_id order.

    Null text: empty. Null doc_ids come first. Rows that repeat a doc_id are all written, in the
    table's order. Empty table: no blocks. Other columns are ignored. ``path``: the tokenizer file.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    width = 2 if encoder(path).vocabulary <= 1 << 16 else 4
    content = train(_sample(docs, path, width))
    name = hashlib.sha256(content).hexdigest()
    spark.createDataFrame(pa.table({"hash": [name], "content": pa.array([content], pa.binary())})).write.parquet(f"{folder}/dictionary")
    ordered = docs.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(ranges(docs), "doc_id", "nth").sortWithinPartitions("doc_id", "nth")
    map_batches(ordered.select("doc_id", "text"), _written(path, content, name, width), BLOCKS).write.parquet(f"{folder}/blocks")


def _dictionaries(spark: SparkSession, folder: str) -> dict[str, bytes]:
    return {r["hash"]: bytes(r["content"]) for r in spark.read.parquet(f"{folder}/dictionary").collect()}


def _part_totals(blocks: DataFrame) -> DataFrame:
    """(part, ids): one row for each of the parts that the writer's tasks made."""
    return blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("ids"))


def _read(contents: dict[str, bytes], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {k: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(v)) for k, v in contents.items()}
        for batch in batches:
            for row in range(batch.num_rows):
                block = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                start, at, out = block["before"], 0, []
                for doc_id, n, end in zip(block["doc_ids"], block["n_tokens"], block["ends"], strict=True):
                    ids = deserialized(opened[block["dictionary"]].decompress(block["payload"][at:end]))
                    if len(ids) != n:
                        raise ValueError(f"document {doc_id}: {len(ids)} ids, the index has {n}")
                    raw = ids.tobytes()
                    out.append((doc_id, start, n, zlib.crc32(raw), *([raw] if with_ids else [])))
                    start, at = start + n, end
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) for every document of a file set, read from its frames.

    ``start`` counts the ids of all documents before it, ``ids`` are little-endian 32-bit integers.
    Part totals are the only thing gathered over the whole set.
    """
    contents = _dictionaries(spark, folder)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    totals = staged(_part_totals(blocks), "part-totals")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before"))
    placed = blocks.join(F.broadcast(starts), "part").withColumn("before", F.col("before") + F.col("ids_before"))
    columns = ["before", "doc_ids", "n_tokens", "ends", "dictionary", "payload"]
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return map_batches(placed.select(columns), _read(contents, with_ids), out)


def read_document(spark: SparkSession, folder: str, doc_id: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of that id in a file set, one row each; none: no rows.

    The index columns of the blocks whose ids span ``doc_id`` say where its frames lie; only those bytes
    of the payload are handed on and decompressed.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    at = F.filter(F.sequence(F.lit(1), F.size("doc_ids")), lambda i: F.element_at("doc_ids", i) == doc_id)
    found = blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).withColumn("i", F.explode(at))
    begin = F.coalesce(F.get("ends", F.col("i") - 2), F.lit(0))
    inside = F.aggregate(F.slice("n_tokens", F.lit(1), F.col("i") - 1), F.lit(0).cast("long"), lambda a, n: a + n)
    frame = F.substring("payload", (begin + 1).cast("int"), (F.element_at("ends", F.col("i")) - begin).cast("int"))
    found = found.select("part", (F.col("before") + inside).alias("before"), F.array(F.lit(doc_id).cast("long")).alias("doc_ids"), F.array(F.element_at("n_tokens", F.col("i"))).alias("n_tokens"), F.array(F.length(frame).cast("long")).alias("ends"), "dictionary", frame.alias("payload"))
    totals = _part_totals(blocks).withColumnRenamed("part", "other")
    earlier = found.select("part").distinct().join(F.broadcast(totals), F.col("other") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("ids"), F.lit(0)).alias("ids_before"))
    placed = found.join(F.broadcast(earlier), "part").withColumn("before", F.col("before") + F.col("ids_before"))
    columns = ["before", "doc_ids", "n_tokens", "ends", "dictionary", "payload"]
    read = map_batches(placed.select(columns), _read(_dictionaries(spark, folder), True), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return read.select("doc_id", "start", "n_tokens", "ids")
