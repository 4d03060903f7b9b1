"""Substring dedup: paragraphs that nearly repeat, and passages that repeat word for word anywhere.

A paragraph is a line of at least 20 words, or a run of shorter lines (hard-wrapped text, say) between
blank or long ones that has 20 words or more. Its MinHash values are banded, colliding paragraphs are
joined and verified by exact Jaccard similarity, and of each connected component all but the first
paragraph go. In what is left, every window of 30 words that also lies at an earlier place goes,
wherever it begins and whatever lines or sentences it crosses. Each window is marked by the least hash
of its 16-word grams, which its own words decide; only windows whose mark occurs twice are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches
from .decontam import cut
from .lsh import Sketch, clusters, small
from .neardup import SHINGLE
from .storage import free_names, release, staged, with_row_ids
from .textops import SPACED, U64, Texts, distinct_sorted, list_array, mix, ragged, runs, set_digests, windows, words

#: Words of the least paragraph, of a window, and of the grams that mark windows.
PARAGRAPH, RUN, GRAM = 20, 30, 16
ROWS = 3
RECALL = 0.999
#: Estimates from so few values are rough: a pair goes unverified only this far below the threshold.
SLACK = 0.3


def tuned_bands(percent: int, rows: int = ROWS, recall: float = RECALL) -> int:
    """The least number of bands of ``rows`` values that finds pairs at the threshold with ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


def _paragraph_words(texts: Texts):
    """Words, offsets of each paragraph's words, text of each paragraph; paragraphs of any size."""
    found = words(texts, SPACED)
    edges = np.union1d(np.flatnonzero(texts.data == 0x0A) + 1, texts.offsets)
    of = np.searchsorted(found.starts, edges)
    text, n = np.searchsorted(texts.offsets, edges[:-1], "right") - 1, np.diff(of)
    short = (n > 0) & (n < PARAGRAPH)
    goes_on = np.zeros(len(n), bool)
    goes_on[1:] = short[1:] & short[:-1] & (text[1:] == text[:-1])
    first = np.flatnonzero((n > 0) & ~goes_on)
    return found, np.r_[of[first], len(found.starts)], text[first]


def minhashes(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values (uint32, at least 1) of each non-empty set of hashes."""
    out = np.zeros((len(of) - 1, n), "<u4")
    if len(values):
        factors = mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
        for j in range(n):
            out[:, j] = np.minimum.reduceat((values * factors[j]) >> U64(32), of[:-1])
    return np.maximum(out, 1)


def _units(n_hashes: int):
    names = ["doc_id", "start", "end", "words", "n", "whole", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in runs(batch.column("text")):
                found, of, text = _paragraph_words(texts)
                long = np.flatnonzero(np.diff(of) >= PARAGRAPH)
                if not len(long):
                    continue
                hashes = found.hashes()
                size = np.diff(of)[long]
                picked = np.repeat(of[long], size) + ragged(size)
                values, sets = distinct_sorted(*windows(hashes[picked], np.r_[0, np.cumsum(size)], SHINGLE))
                sketch = pa.array([r.tobytes() for r in minhashes(values, sets, n_hashes)], pa.binary())
                first, last, which = of[long], of[long + 1], text[long]
                base = texts.offsets[which]
                made = [found.starts[first] - base, found.ends[last - 1] - base, size, np.diff(sets)]
                ids = batch.column("doc_id").slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), *map(pa.array, made), set_digests(values, sets), sketch], names=names)

    return run


def _paragraph_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in runs(batch.column("text")):
            found, of, text = _paragraph_words(texts)
            values, sets = distinct_sorted(*windows(found.hashes(), of, SHINGLE))
            long = np.flatnonzero(np.diff(of) >= PARAGRAPH)
            start = found.starts[of[long]] - texts.offsets[text[long]] if len(long) else np.zeros(0, np.int64)
            ids = batch.column("doc_id").slice(texts.first, len(texts)).take(pa.array(text[long]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int64()), list_array(values, sets).take(pa.array(long))], names=["doc_id", "start", "shingles"])


def _paragraphs(docs: DataFrame, units: DataFrame, percent: int, bands: int) -> DataFrame:
    """(doc_id, start, end, words, kept_doc_id) of each paragraph that goes."""
    key = ["whole", "n"]
    paragraphs = units
    classes = paragraphs.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    classes = staged(classes.drop("copies"), "classes")
    copies = small(classes)
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.xxhash64(F.substring(F.col("sketch"), j * 4 * ROWS + 1, F.lit(4 * ROWS))))
    items = paragraphs.join(copies, key, "left").where("rep is null or rep = id").select("id", "n", band.alias("bands"), "sketch")
    items = staged(items, "paragraphs")
    places = paragraphs.select("id", "doc_id", "start")

    wanted: list[DataFrame] = []

    def sets_of(ids: DataFrame) -> DataFrame:
        there = staged(places.join(small(ids), "id", "left_semi"), "wanted-places")
        of = staged(there.select("doc_id").distinct(), "wanted-docs")
        wanted.extend((there, of))
        sets = map_batches(docs.join(small(of), "doc_id", "left_semi").select("doc_id", "text"), _paragraph_sets, "doc_id long, start long, shingles array<long>")
        return sets.join(small(there), ["doc_id", "start"]).select("id", "shingles")

    found, links = clusters(items, Sketch(ROWS * bands, "<u4", percent / 100 - SLACK), sets_of, percent, whole_blocks=True)
    placed = paragraphs.select("id", "doc_id", "start", "end", "words", *key).join(copies, key, "left").withColumn("rep", F.coalesce("rep", "id"))
    placed = placed.join(small(found.select(F.col("id").alias("rep"), "root")), "rep", "left")
    placed = placed.withColumn("root", F.coalesce("root", "rep"))
    keepers = placed.groupBy("root").agg(F.min(F.struct("doc_id", "start")).alias("kept"), F.count("*").alias("m")).where("m > 1").select("root", "kept")
    keepers = staged(keepers, "keepers")
    gone = placed.join(small(keepers), "root").where(F.struct("doc_id", "start") != F.col("kept"))
    out = staged(gone.select("doc_id", "start", "end", F.col("words").cast("long").alias("words"), F.col("kept.doc_id").alias("kept_doc_id")), "paragraphs-gone")
    release(classes, items, found, links, keepers, *wanted)
    return out


def marks(hashes: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, mark) of each run of windows of one mark.

    A window is RUN words of one ``piece`` (negative: none); its mark is the first of the least hashes of its grams.
    """
    n = len(hashes) - RUN + 1
    whole = np.flatnonzero((piece[: max(n, 0)] == piece[RUN - 1 :]) & (piece[: max(n, 0)] >= 0))
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    grams, _ = windows(hashes, np.array([0, len(hashes)]), GRAM, whole_if_short=False)
    at = np.lib.stride_tricks.sliding_window_view(grams, RUN - GRAM + 1).argmin(1)[whole] + whole
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(whole) > 1)])
    return whole[first], np.diff(np.r_[first, len(whole)]), grams[at[first]]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in runs(batch.column("text")):
            found = words(texts, SPACED)
            n = len(found.starts)
            if not n:
                continue
            gone, edge = np.zeros(n, bool), np.zeros(n + 1, bool)
            edge[found.of] = True
            for base, spans in zip(texts.offsets.tolist(), batch.column("gone").slice(texts.first, len(texts)).to_pylist(), strict=False):
                for s in spans or ():
                    a, b = np.searchsorted(found.starts, (base + s["start"], base + s["end"]))
                    gone[a:b] = edge[a] = edge[b] = True
            piece = np.where(gone, -1, np.cumsum(edge[:-1]))
            first, count, mark = marks(found.hashes(), piece)
            which = np.searchsorted(found.of, first, "right") - 1
            ids = batch.column("doc_id").slice(texts.first, len(texts)).take(pa.array(which))
            yield pa.RecordBatch.from_arrays([ids, pa.array(first - found.of[which]), pa.array(count), pa.array(mark.view(np.int64))], names=["doc_id", "word", "n", "mark"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that ``marks`` of a text name, with 128 bits over their words."""
    for batch in batches:
        for texts in runs(batch.column("text")):
            found = words(texts, SPACED)
            named = batch.column("marks").slice(texts.first, len(texts))
            word, n = (x.to_numpy(zero_copy_only=False) for x in named.flatten().flatten())
            which = np.repeat(np.arange(len(texts)), pc.list_value_length(named).to_numpy(zero_copy_only=False))
            which, word = np.repeat(which, n), np.repeat(word, n) + ragged(n)
            at = found.of[which] + word
            inside = at + RUN <= found.of[which + 1]  # marks of another text under the same doc_id
            which, word, at = which[inside], word[inside], at[inside]
            hashes = found.hashes()
            keys = []
            for factors in (mix(np.arange(RUN, dtype=U64) + U64(k << 32)) | U64(1) for k in (1, 2)):
                key = np.zeros(len(at), U64)
                for j in range(RUN):
                    key += hashes[at + j] * factors[j]
                keys.append(mix(key).view(np.int64))
            base = texts.offsets[which]
            ids = batch.column("doc_id").slice(texts.first, len(texts)).take(pa.array(which))
            made = [word, found.starts[at] - base, found.ends[at + RUN - 1] - base, *keys]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, made)], names=["doc_id", "word", "start", "end", "k1", "k2"])


def _passages(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, start, end, words, kept_doc_id) of each passage that goes, besides the spans ``gone`` of ``docs``.

    A window goes if the same words lie at an earlier place; in the same document, at one that doesn't
    overlap it. Windows with one kept document that touch or overlap make one row, so a row has no word
    that isn't in a repeated window.
    """
    tables = [gone := staged(gone.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("gone")), "gone")]
    found = map_batches(docs.join(small(gone), "doc_id", "left").select("doc_id", "text", "gone"), _marks, "doc_id long, word long, n long, mark long")
    tables += [found := staged(found, "marks")]
    tables += [twice := staged(found.groupBy("mark").agg(F.count("*").alias("m")).where("m > 1").select("mark"), "twice")]
    named = found.join(small(twice), "mark", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("word", "n")).alias("marks"))
    named = staged(named, "named")
    release(*tables)
    tables, named = [named], docs.join(small(named), "doc_id").select("doc_id", "text", "marks")
    tables += [spans := staged(map_batches(named, _windows, "doc_id long, word long, start long, end long, k1 long, k2 long"), "windows")]
    place = F.struct("doc_id", "word")
    repeated = spans.groupBy("k1", "k2").agg(F.min(place).alias("kept"), F.max(place).alias("last")).where("kept <> last").drop("last")
    tables += [repeated := staged(repeated, "repeated")]
    again = spans.join(small(repeated), ["k1", "k2"])
    again = again.where((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("word") - F.col("kept.word") >= RUN)).withColumn("kept_doc_id", F.col("kept.doc_id"))
    before = F.expr("lag(word) OVER (PARTITION BY doc_id, kept_doc_id ORDER BY word)")
    again = again.withColumn("begins", F.when(F.col("word") - before <= RUN, 0).otherwise(1))
    again = again.withColumn("run", F.expr("sum(begins) OVER (PARTITION BY doc_id, kept_doc_id ORDER BY word ROWS UNBOUNDED PRECEDING)"))
    made = again.groupBy("doc_id", "kept_doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("word") - F.min("word") + RUN).alias("words"))
    out = staged(made.select("doc_id", "start", "end", "words", "kept_doc_id"), "passages")
    release(*tables)
    return out


def repeated_spans(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, start, end, words, kind, kept_doc_id): the parts of ``docs`` (doc_id, text) that repeat others.

    ``start`` and ``end`` are UTF-8 byte places; kind is ``paragraph`` or ``passage``. The first of
    repeating parts, by doc_id and place, has no row; ``kept_doc_id`` names its document. Paragraphs
    repeat at a Jaccard similarity of ``percent`` or more of their 5-word shingles, A-Z lower-cased, or
    by way of others that do. Passages are made of windows of RUN words that repeat word for word (A-Z
    lower-cased, any white space between words) outside the paragraphs that go. Repeats within a
    document count too.

    Null or wordless texts and texts of few words without long repeated passages have no rows; nor have
    rows of null doc_id, which are left alone. Rows that repeat a doc_id count as one document, and a span
    lies in any of them (``remove_repeats`` tells rows apart). Empty table: no rows. Other columns are
    ignored. The result reads staged tables; those they were made from are deleted.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    bands = tuned_bands(percent)
    schema = "doc_id long, start long, end long, words long, n long, whole binary, sketch binary"
    units = map_batches(docs, _units(ROWS * bands), schema).withColumn("id", F.monotonically_increasing_id())
    units = staged(units, "units")
    paragraphs = _paragraphs(docs, units, percent, bands).withColumn("kind", F.lit("paragraph"))
    release(units)
    passages = _passages(docs, paragraphs).withColumn("kind", F.lit("passage"))
    return paragraphs.unionByName(passages).select("doc_id", "start", "end", "words", "kind", "kept_doc_id")


def _without(names: list[str], spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [cut(t, merged(s)) for t, s in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    return run


def merged(spans: list[dict] | None) -> list[dict]:
    """Spans in order, overlapping ones made one."""
    out: list[dict] = []
    for s in sorted(spans or [], key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def remove_repeats(docs: DataFrame, percent: int = 80, keep_emptied: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the parts that repeat cut out of ``text``; all columns stay.

    What repeats is as in ``repeated_spans``, with each row as a document of its own: rows of null or
    repeated doc_ids are told apart, and the first of repeating parts by doc_id (nulls last) and place
    stays. Null text stays null. A row of which nothing is left stays too, with an empty text, unless
    ``keep_emptied`` is false. Other columns may have any names.
    """
    row, spans = free_names(docs, "row", "spans")
    numbered = with_row_ids(docs, row)
    found = repeated_spans(numbered.select(F.col(row).alias("doc_id"), "text"), percent)
    found = staged(found.groupBy(F.col("doc_id").alias(row)).agg(F.collect_list(F.struct("start", "end")).alias(spans)), "spans")
    whole = numbered.join(small(found), row, "left").select(*docs.columns, spans)
    changed = map_batches(whole.where(F.col(spans).isNotNull()), _without(docs.columns, spans), docs.schema)
    changed = changed if keep_emptied else changed.where("text <> ''")
    return whole.where(F.col(spans).isNull()).select(*docs.columns).unionByName(changed)
