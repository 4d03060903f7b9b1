"""MinHash near-dedup with HyperMinHash sketches.

A document's set of distinct 5-word shingles is hashed once. The hash's first bits choose one of 256
buckets; the bucket keeps its smallest value as a leading-zero count and the mantissa bits after it.
Bands of registers (7 at a similarity of 0.85) find candidates, registers estimate the Jaccard similarity with the expected
share of accidental agreements taken off, and exact set intersections confirm each link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches
from .lsh import Sketch, clusters, small
from .storage import free_names, release, staged, with_row_ids
from .textops import SPACED, U64, distinct_sorted, list_array, mix, runs, set_digests, windows, words

SHINGLE = 5
BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
#: Mantissa bits of the registers that bands are made of. A short document leaves most buckets empty,
#: so a band of it holds one or two values only, which must tell apart millions of short documents.
MANTISSA = 24
#: Mantissa bits that the stored sketch keeps of them, for estimates: 16 bits a register.
STORED = 10
#: Two different minima agree in leading zeros and stored mantissa with probability
#: sum_z 2**-2(z+1) * 2**-STORED: a third of 2**-STORED.
ACCIDENT = 2.0**-STORED / 3
#: A pair just at the threshold shares no band with at most this probability, for long documents.
MISSED = 5e-6
#: A pair is dropped before verification only if its estimate is so far below the threshold: six
#: standard errors for long documents. For short ones each differing shingle spoils one register at
#: most, which gives a bound that no link can break: a union is at most (|A| + |B|) / (1 + percent/100),
#: so at most (1 - p) / (1 + p) of |A| + |B| differs.
SLACK = 0.14


def shingles(texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a run, and their offsets."""
    found = words(texts, SPACED)
    rolled, of = windows(found.hashes(), found.of, size)
    return distinct_sorted(rolled, of)


def registers(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of each text as uint32: 0 if empty, else count << MANTISSA | mantissa, plus 1."""
    out = np.zeros((len(of) - 1, BUCKETS), np.uint32)
    if not len(values):
        return out
    bucket = (values >> U64(64 - BUCKET_BITS)).astype(np.int64)
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    cell = text * BUCKETS + bucket
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    rest = values[first] << U64(BUCKET_BITS)
    _, exponent = np.frexp((rest >> U64(11)).astype(np.float64))
    zeros = (53 - exponent).astype(U64)
    mantissa = (rest << zeros << U64(1)) >> U64(64 - MANTISSA)
    out.reshape(-1)[cell[first]] = ((zeros << U64(MANTISSA)) | mantissa).astype(np.uint32) + np.uint32(1)
    return out


def stored(table: np.ndarray) -> np.ndarray:
    """Registers with STORED mantissa bits, as uint16."""
    return np.where(table > 0, ((table - np.uint32(1) * (table > 0)) >> np.uint32(MANTISSA - STORED)) + 1, 0).astype("<u2")


def tuned_rows(percent: int) -> int:
    """The most registers a band can have: 7 at a similarity of 85 percent, 6 at 80."""
    return max(r for r in range(1, BUCKETS) if r == 1 or (1 - (percent / 100) ** r) ** (BUCKETS // r) <= MISSED)


def bands(table: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each band of ``rows`` registers, and whether the band holds anything."""
    n = BUCKETS // rows
    cut = table[:, : n * rows].reshape(len(table), n, rows)
    out = np.zeros(cut.shape[:2], U64)
    for j in range(rows):
        out = mix(out * U64(0x9E3779B97F4A7C15) + cut[:, :, j].astype(U64) + U64(j + 1))
    return out, (cut > 0).any(2)


def _sketched(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in runs(batch.column("text")):
                values, of = shingles(texts)
                table = registers(values, of)
                keys, filled = bands(table, rows)
                flat = pa.array(keys.reshape(-1).view(np.int64), mask=~filled.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * keys.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(texts.first, len(texts)), pa.array(np.diff(of)), set_digests(values, of), lists, pa.array([r.tobytes() for r in stored(table)], pa.binary())],
                    names=["doc_id", "n_shingles", "whole", "bands", "sketch"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in runs(batch.column("text")):
            values, of = shingles(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(texts.first, len(texts)), list_array(values, of)], names=["id", "shingles"])


def keep_first(docs: DataFrame, percent: int) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row, that of the smallest doc_id, of each group of near duplicates.

    Groups are as in ``near_duplicates``, with each row as a document of its own: of equal rows one stays, of
    different texts under one doc_id each is judged by itself, and null doc_ids come last in a group. Rows
    without words all stay. Other columns may have any names.
    """
    row = free_names(docs, "row")[0]
    numbered = with_row_ids(docs, row)
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), percent)
    gone = staged(found.where("not kept").select(F.col("doc_id").alias(row)), "gone")
    release(found)
    return numbered.join(small(gone), row, "left_anti").select(*docs.columns)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents link if 100 * |A & B| >= percent * |A | B| on their whole shingle sets; component_id is
    the smallest doc_id reachable, and only it is kept. Words are runs of anything but white space,
    A-Z lower-cased. A text of one to four words is one shingle. Null or wordless text: an empty set,
    linked with nothing, kept. A null doc_id keeps its row, a null component and kept = true. Rows that
    repeat a doc_id share a component. Other columns of ``docs`` are ignored.

    Documents of equal sets (by a cryptographic hash over the whole sorted set, so none is taken for a
    copy that isn't) form a class; only one of a class is banded, so a group of copies of any size costs
    a minimum. The result is a staged table; those it is made from are deleted.
    """
    docs = docs.select("doc_id", "text")
    table = staged(map_batches(docs, _sketched(tuned_rows(percent)), "doc_id long, n_shingles long, whole binary, bands array<long>, sketch binary"), "sketches")
    key = ["whole", "n_shingles"]
    slim = table.select("doc_id", *key)
    classes = slim.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = staged(classes.where("copies > 1").drop("copies"), "classes")
    copies = small(classes)
    items = table.where("n_shingles > 0 and doc_id is not null").join(copies, key, "left").where("rep is null or rep = doc_id")
    items = staged(items.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "sketch"), "items")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = docs.join(small(ids.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi")
        return map_batches(wanted.select("doc_id", "text"), _sets, "id long, shingles array<long>")

    found, links = clusters(items, Sketch(BUCKETS, "<u2", percent / 100 - SLACK, ACCIDENT, (100 - percent) / (100 + percent)), sets_of, percent)
    out = slim.join(copies, key, "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(small(found.withColumnRenamed("id", "rep")), "rep", "left")
    component = F.coalesce("root", "rep")
    out = staged(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "documents")
    release(table, classes, items, found, links)
    return out
