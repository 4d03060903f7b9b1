"""Benchmark decontamination: every shard of texts is indexed, benchmark phrases are searched in the index."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_batches
from .fmindex import FMIndex
from .storage import free_names, release, staged
from .textops import ALNUM, Texts, Words, runs, windows, words

WINDOW = 10
#: Bytes of benchmark text in one block of phrases (some 20 MB of windows), up to twice that; more text makes more blocks.
BLOCK_BYTES = 1 << 20
#: Words of an item that stay together; longer items are cut into pieces that overlap by a window.
PIECE_WORDS = 1 << 14
#: Bytes of texts in one index.
SHARD_BYTES = 2 << 20
HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


@dataclass
class Phrases:
    """Windows of a block of items: rows of word ids, and the items that hold each."""

    vocabulary: np.ndarray
    rows: np.ndarray
    lengths: np.ndarray
    item_of: np.ndarray
    item_offsets: np.ndarray
    item_ids: list[str]


def phrases(items: list[tuple[str, str]], size: int) -> Phrases:
    """The distinct windows of ``items`` (item_id, text)."""
    (texts,) = runs(pa.array([t for _, t in items], pa.large_string()), 1 << 62)
    found = words(texts, ALNUM)
    hashes = found.hashes()
    vocabulary, ids = np.unique(hashes, return_inverse=True)
    rolled, of = windows(hashes, found.of, size)
    n_windows, counts = np.diff(of), found.counts
    start = np.repeat(found.of[:-1], n_windows) + np.arange(len(rolled)) - np.repeat(of[:-1], n_windows)
    length = np.repeat(np.minimum(counts, size), n_windows)
    _, first, same = np.unique(rolled, return_index=True, return_inverse=True)
    rows = np.zeros((len(first), size), np.int32)
    for j in range(size):
        inside = length[first] > j
        rows[inside, j] = ids[start[first][inside] + j] + 1
    pairs = np.unique(np.c_[same, np.repeat(np.arange(len(items)), n_windows)], axis=0)
    return Phrases(vocabulary, rows, length[first], pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), [i for i, _ in items])


def _pieces(size: int):
    """Items in pieces of at most PIECE_WORDS words and ``size`` - 1 more, which begin the next piece again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in runs(batch.column("text")):
                found = words(texts, ALNUM)
                item, text = [], []
                ids = batch.column("item_id").slice(texts.first, len(texts)).to_pylist()
                for name, a, b in zip(ids, found.of[:-1].tolist(), found.of[1:].tolist(), strict=True):
                    for at in range(a, b, PIECE_WORDS):
                        to = min(b, at + PIECE_WORDS + size - 1)
                        if at == a or to - at >= size:
                            item.append(name)
                            text.append(found.lower[found.starts[at] : found.ends[to - 1]].tobytes().decode())
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(text, pa.string())], names=["item_id", "text"])

    return run


def _blocked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(phrases(held, size))], pa.binary())], names=["block"])

        held, n = [], 0
        for batch in batches:
            for item in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if held and n + len(item[1]) > 2 * BLOCK_BYTES:
                    yield block(held)
                    held, n = [], 0
                held.append(item)
                n += len(item[1])
        if held:
            yield block(held)

    return run


def phrase_blocks(benchmark: DataFrame, size: int) -> DataFrame:
    """(block): the windows of ``benchmark`` (item_id, text), made by tasks, in staged blocks of a bounded size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    cut_up = staged(map_batches(items, _pieces(size), "item_id string, text string"), "benchmark")
    n_bytes = cut_up.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    out = staged(map_batches(cut_up.repartition(max(1, -(-n_bytes // BLOCK_BYTES))), _blocked(size), "block binary"), "phrases")
    release(cut_up)
    return out


def search(found, block: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, word) of all occurrences of the block's phrases within the texts of ``found`` (Words)."""
    if not len(block.rows) or not len(found.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = found.hashes()
    at = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
    ids = np.where(block.vocabulary[at] == hashes, at + 1, 0)
    # A zero ends each text. Runs of known words too short for any phrase, and repeated zeros, are left out.
    symbols = np.insert(ids, found.of[1:], 0)
    word = np.insert(np.arange(len(ids)), found.of[1:], -1)
    zero = symbols == 0
    edges = np.flatnonzero(np.diff(np.r_[True, zero, True].astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= block.lengths.min()
    inside = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(inside, begin[long], 1)
    np.add.at(inside, np.minimum(end[long] + 1, len(symbols)), -1)
    kept = np.cumsum(inside[:-1]) > 0
    symbols, word = symbols[kept], word[kept]
    if not len(symbols):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    phrase, place = FMIndex(symbols).occurrences(block.rows, block.lengths)
    return phrase, word[place]


@dataclass
class Found:
    """What is known of a run of texts: their words, +1 and -1 where hits begin and end, the items of each text."""

    words: Words
    change: np.ndarray
    items: list[list[str]]


def _of_block(shared) -> Callable[[Texts, pa.RecordBatch], Found]:
    """Found by search for the phrases of one broadcast block; none: nothing is found."""
    opened: list[Phrases] = []

    def found(texts: Texts, part: pa.RecordBatch) -> Found:
        if shared is not None and not opened:
            opened.append(pickle.loads(shared.value))
        own = words(texts, ALNUM)
        change, items = np.zeros(len(own.starts) + 1, np.int64), [[] for _ in range(len(texts))]
        for block in opened:
            phrase, word = search(own, block)
            np.add.at(change, word, 1)
            np.add.at(change, word + block.lengths[phrase], -1)
            text = np.searchsorted(own.of, word, "right") - 1
            pairs = np.unique(np.c_[text, phrase], axis=0)
            for t, p in pairs.tolist():
                items[t].extend(block.item_ids[i] for i in block.item_of[block.item_offsets[p] : block.item_offsets[p + 1]])
        return Found(own, change, items)

    return found


def _of_columns(runs_name: str, items_name: str) -> Callable[[Texts, pa.RecordBatch], Found]:
    """Found earlier, block by block, and joined to the rows."""

    def found(texts: Texts, part: pa.RecordBatch) -> Found:
        own = words(texts, ALNUM)
        change = np.zeros(len(own.starts) + 1, np.int64)
        for base, hit in zip(own.of.tolist(), part.column(runs_name).to_pylist(), strict=False):
            for r in hit or ():
                change[base + r["first"]] += 1
                change[base + r["last"]] -= 1
        return Found(own, change, [x or [] for x in part.column(items_name).to_pylist()])

    return found


def _hit_runs(found: Found) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hit words of each text; text, first and last word of each maximal run of hits within a text)."""
    own, n = found.words, len(found.words.starts)
    hit = np.cumsum(found.change[:-1]) > 0
    upto = np.r_[0, np.cumsum(hit)]
    edge = np.r_[True, ~hit[:-1]] & hit if n else hit
    first_words = own.of[:-1][own.of[:-1] < n]
    edge[first_words] |= hit[first_words]
    begin = np.flatnonzero(edge)
    length = np.diff(upto[np.r_[begin, n]]) if len(begin) else np.zeros(0, np.int64)
    return np.diff(upto[own.of]), np.searchsorted(own.of, begin, "right") - 1, begin, begin + length


def _byte_spans(texts: Texts, found: Found) -> tuple[np.ndarray, list[list[dict]]]:
    n_hit, text, begin, end = _hit_runs(found)
    base = texts.offsets[text]
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    for t, a, b in zip(text.tolist(), (found.words.starts[begin] - base).tolist(), (found.words.ends[end - 1] - base).tolist(), strict=True):
        spans[t].append({"start": a, "end": b})
    return n_hit, spans


def _facts(names: list[str]):
    def made(part: pa.RecordBatch, texts: Texts, found: Found) -> pa.RecordBatch:
        n_hit, spans = _byte_spans(texts, found)
        columns = [pa.array(found.words.counts), pa.array(n_hit), pa.array([sorted(set(x)) for x in found.items], pa.list_(pa.string())), pa.array(spans, _SPANS)]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], names=[*names, "n_words", "n_hit", "items", "spans"])

    return made


def _cut_texts(names: list[str], keep_emptied: bool):
    def made(part: pa.RecordBatch, texts: Texts, found: Found) -> pa.RecordBatch:
        _, spans = _byte_spans(texts, found)
        text = pa.array([cut(t, s) for t, s in zip(part.column("text").to_pylist(), spans, strict=True)], pa.string())
        out = pa.RecordBatch.from_arrays([text if c == "text" else part.column(c) for c in names], names=names)
        return out if keep_emptied else out.filter(pa.array([not s or t != "" for t, s in zip(text.to_pylist(), spans, strict=True)], pa.bool_()))

    return made


def _only_hits(row: str):
    """Rows with hits: their number, items, runs of hit words."""

    def made(part: pa.RecordBatch, texts: Texts, found: Found) -> pa.RecordBatch:
        _, text, begin, end = _hit_runs(found)
        hits: list[list[dict]] = [[] for _ in range(len(texts))]
        for t, a, b in zip(text.tolist(), (begin - found.words.of[text]).tolist(), (end - found.words.of[text]).tolist(), strict=True):
            hits[t].append({"first": a, "last": b})
        any_hit = np.flatnonzero([bool(h) for h in hits])
        columns = [part.column(row).take(pa.array(any_hit)), pa.array([sorted(set(found.items[t])) for t in any_hit], pa.list_(pa.string())), pa.array([hits[t] for t in any_hit], _RUNS)]
        return pa.RecordBatch.from_arrays(columns, names=["row", "items", "runs"])

    return made


def _searched(found_by: Callable, made: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in runs(batch.column("text"), SHARD_BYTES):
                part = batch.slice(texts.first, len(texts))
                yield made(part, texts, found_by(texts, part))

    return run


def _over_blocks(docs: DataFrame, benchmark: DataFrame, size: int, made: Callable, schema: T.StructType) -> DataFrame:
    """``made`` of every row of ``docs`` and what was found in it.

    One block (a benchmark of up to a megabyte or two) is sent to the executors and searched in the pass
    that makes the result. Of several, each is sent and searched in a pass of its own and dropped again,
    so neither the driver nor a worker ever holds two; hits are joined to the rows by number.
    """
    sc = docs.sparkSession.sparkContext
    blocks = phrase_blocks(benchmark, size)
    several = blocks.count() > 1
    if not several:
        only = blocks.first()
        release(blocks)
        return map_batches(docs, _searched(_of_block(sc.broadcast(bytes(only["block"])) if only else None), made), schema)
    row, items, hit = free_names(docs, "row", "items found", "runs found")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hits = []
    for block in blocks.toLocalIterator():
        shared = sc.broadcast(bytes(block["block"]))
        hits.append(staged(map_batches(numbered.select(row, "text"), _searched(_of_block(shared), _only_hits(row)), "row long, items array<string>, runs array<struct<first:long,last:long>>"), "hits"))
        shared.destroy()
    every = hits[0]
    for more in hits[1:]:
        every = every.union(more)
    merged = every.groupBy(F.col("row").alias(row)).agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias(items), F.flatten(F.collect_list("runs")).alias(hit))
    release(blocks)
    return map_batches(numbered.join(merged, row, "left"), _searched(_of_columns(hit, items), made), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, items, spans: where the windows of ``benchmark`` occur in its texts.

    Words are runs of 0-9, a-z, A-Z (lower-cased) and non-ASCII characters. A window is ``size``
    consecutive words of an item, or all words of a shorter item. ``n_hit`` counts the text's words
    inside any occurrence, ``items`` are the item_ids (as strings, sorted) with an occurring window,
    ``spans`` the merged occurrences as UTF-8 byte ranges.

    Null or wordless text: no words, no hits. Items without words, null items and items of null id are
    skipped; rows that repeat an item_id count as one item. Columns of ``docs`` named like a result are
    replaced. Rows of null or repeated doc_ids are searched like others. Empty tables: no rows, or no hits.

    Each task indexes its texts in shards of SHARD_BYTES; no text is shuffled, unless the benchmark has
    several blocks of windows.
    """
    made = T.StructType.fromDDL(HITS)
    docs = docs.drop(*made.names)
    return _over_blocks(docs, benchmark, size, _facts(docs.columns), T.StructType([*docs.schema.fields, *made.fields]))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, keep_emptied: bool = True) -> DataFrame:
    """``docs`` (text, ...) with the spans that ``contamination`` finds cut out of ``text``; all columns stay, whatever their names.

    Null text stays null. A row of which nothing is left stays, with an empty text, unless ``keep_emptied`` is false.
    """
    return _over_blocks(docs, benchmark, size, _cut_texts(docs.columns, keep_emptied), docs.schema)


def cut(text: str | None, spans: list | None) -> str | None:
    """``text`` without byte ranges ``spans``; one space is left where two words would meet."""
    if text is None or not spans:
        return text
    raw, at, kept = text.encode(), 0, []
    for s in spans:
        kept.append(raw[at : s["start"]])
        at = s["end"]
    kept.append(raw[at:])
    return b" ".join(x.strip() for x in kept if x.strip()).decode()
