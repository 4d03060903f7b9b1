"""Packing of documents into token sequences, planned on the histogram of piece lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import map_batches
from .lsh import small
from .storage import ranges, staged
from .textops import runs
from .tokenize import RUN_BYTES, encoder

LENGTH = 2048
END_ID = 1
PIECES = "start long, length long, doc_tokens long, ids binary"


def _cut(path: str, length: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in runs(batch.column("text"), RUN_BYTES):
                tokens, of = encoder(path).encode_with_end(texts, END_ID)
                sizes = np.diff(of)
                n = -(-sizes // length)
                text = np.repeat(np.arange(len(sizes)), n)
                start = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * length
                size = np.minimum(length, sizes[text] - start)
                raw, first = tokens.astype("<u4").tobytes(), (of[text] + start) * 4
                ids = pa.array([raw[a : a + 4 * k] for a, k in zip(first.tolist(), size.tolist(), strict=True)], pa.binary())
                part = batch.select(names).slice(texts.first, len(texts)).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(start), pa.array(size), pa.array(sizes[text]), ids], names=[*names, "start", "length", "doc_tokens", "ids"])

    return run


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids) of every document: its ids and an end id, cut every ``length``.

    Null text: empty, the end id alone. ``ids`` are little-endian 32-bit integers. Other columns are
    ignored. ``path``: the tokenizer file.
    """
    return map_batches(docs.select("doc_id", "text"), _cut(path, length, ["doc_id"]), "doc_id long, " + PIECES)


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """(count, piece lengths) of each packing pattern, by shortest-pack-first.

    Lengths go longest first. All pieces of a length are put at once: onto the packs with the most room
    left, as many as there are, then into new packs. The work depends on the number of lengths and
    patterns, not of pieces.
    """
    room: dict[int, list[list]] = {}
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        put: list[tuple[int, int, tuple[int, ...]]] = []
        for space in sorted((s for s in room if s >= size), reverse=True):
            stack = room[space]
            while left and stack:
                count, pattern = stack[-1]
                n = min(left, count)
                put.append((space - size, n, (*pattern, size)))
                left -= n
                if n == count:
                    stack.pop()
                else:
                    stack[-1][0] = count - n
            if not stack:
                del room[space]
            if not left:
                break
        if left:
            put.append((length - size, left, (size,)))
        for space, n, pattern in put:
            room.setdefault(space, []).append([n, pattern])
    return [(n, pattern) for space in sorted(room) for n, pattern in room[space]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): which ranks of a length go where."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for size in pattern:
            rank = used.get(size, 0)
            out.append((size, rank, rank + count, sequence, offset))
            used[size] = rank + count
            offset += size
        sequence += count
    return out


def widths(places: list[tuple[int, int, int, int, int]]) -> dict[int, int]:
    """Ranks in a tile of each length: its pieces by its ranges, so all tiles together are twice the ranges at most."""
    pieces: dict[int, int] = {}
    ranges: dict[int, int] = {}
    for size, _, end, _, _ in places:
        pieces[size], ranges[size] = max(pieces.get(size, 0), end), ranges.get(size, 0) + 1
    return {size: -(-n // ranges[size]) for size, n in pieces.items()}


def _table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A table of integers from the driver, handed over by Arrow."""
    columns = np.array(rows, np.int64).reshape(-1, len(names)).T
    return spark.createDataFrame(pa.table(dict(zip(names, map(pa.array, columns), strict=True))))


def packed(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """``cut`` (doc_id, start, length, ...) with sequence_id and offset: every piece in one sequence.

    ``cut`` must be staged: it is read twice. Pieces of a length are ranked by doc_id and start within
    salted groups, so a length that very many pieces have is ranked by many tasks; only the histogram of
    lengths (at most ``length`` rows) comes to the driver. The plan goes back as ranges of ranks, sent
    whole up to a checked size and shuffled beyond; ranges are cut into tiles of ranks, so a piece meets
    a few of its length's ranges, not all. Pieces that repeat (doc_id, start) are packed like any others.
    Other columns stay; own columns sequence_id and offset are replaced. Empty table: no rows.
    """
    spark: SparkSession = cut.sparkSession
    salts = ranges(cut)
    names = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    salted = cut.select("length", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).alias("salt"), F.struct(*names).alias("piece"))
    counts = staged(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "length-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = slots(plan(histogram, length))
    wide = widths(places)
    tiles = [(*place, tile) for place in places for tile in range(place[1] // wide[place[0]], (place[2] - 1) // wide[place[0]] + 1)]
    places = small(staged(_table(spark, ["length", "first", "end", "sequence", "offset", "tile"], tiles), "places"))
    before = F.expr("coalesce(sum(n) OVER (PARTITION BY length ORDER BY salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    bases = counts.select("length", "salt", before.alias("base"))
    bases = bases.join(F.broadcast(_table(spark, ["length", "width"], sorted(wide.items()))), "length")
    ranked = salted.join(bases, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.expr("row_number() OVER (PARTITION BY length, salt ORDER BY piece.doc_id, piece.start)") - 1)
    ranked = ranked.withColumn("tile", F.expr("rank div width"))
    found = ranked.join(places, ["length", "tile"]).where("rank >= first AND rank < end")
    return found.select("piece.*", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
