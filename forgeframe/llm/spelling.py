"""Spelling variants of the words of a corpus: words one edit apart, found by a rare-first bigram prefix filter.

One inserted, deleted or replaced code point spoils two bigrams of a word at most. So of any three bigrams
of a word one is left in each word near it, at the same place or one further. All bigrams are put into one
order, rarest first: two near words then share one of their three rarest bigrams each, which are the only
ones that are joined, at the places that one edit allows. Whoever meets is compared code point by code point.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, map_cells
from .lsh import small
from .storage import release, staged
from .textops import LOWER, ragged, runs, span_hashes, spans

#: Least code points and occurrences of a word; a form is so many times as frequent as its variant.
LEAST, OFTEN, TIMES = 6, 5, 5
#: Bigrams joined: one more than an edit can spoil.
PREFIX = 3
#: Words that one task compares with as many others, code points of such a block, pairs and code points of one pass.
BLOCK, BLOCK_POINTS, PAIRS, PASS = 2048, 1 << 20, 1 << 17, 1 << 21

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of data[start:end], each continuing the crc32 in ``before``."""
    state, sizes = before ^ np.uint32(0xFFFFFFFF), ends - starts
    for j in range(min(64, int(sizes.max(initial=0)))):
        at = np.flatnonzero(sizes > j)
        state[at] = _CRC[(state[at] ^ data[starts[at] + j]) & np.uint32(255)] ^ (state[at] >> np.uint32(8))
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > 64).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]], int(before[i]))
    return out


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    of = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(of), pa.py_buffer(data[np.repeat(starts, sizes) + ragged(sizes)]))


def _counted(least: int, spoil: int | None):
    """(word, n) of each run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for texts in runs(batch.column("text"), 4 << 20):
                data = LOWER[texts.data]
                lead = data == 0xC3
                inside = _LETTER[data]
                inside[1:] |= lead[:-1]
                starts, ends = spans(inside, texts.offsets)
                two = np.r_[0, np.cumsum(lead)]
                points = ends - starts - (two[ends] - two[starts])
                long = points >= least
                starts, ends, points = starts[long], ends[long], points[long]
                more: Counter[str] = Counter()
                if spoil and len(starts):
                    named = ids[texts.first : texts.first + len(texts)]
                    before = np.array([zlib.crc32(b"%d:" % i) if i is not None else 0 for i in named], np.uint32)
                    text = np.searchsorted(texts.offsets, starts, "right") - 1
                    h = crcs(data, starts, ends, before[text])
                    hit = (h % np.uint32(spoil) == 0) & np.array([i is not None for i in named])[text]
                    for i in np.flatnonzero(hit & (points > least)).tolist():
                        word, k = data[starts[i] : ends[i]].tobytes().decode(), int(h[i] % points[i])
                        more[word[:k] + word[k + 1 :]] += 1
                    starts, ends = starts[~hit], ends[~hit]
                keys, checks = (span_hashes(data, starts, ends, kind) for kind in (0, 1))
                order = np.lexsort((checks, keys))
                first = np.flatnonzero(np.r_[True, (np.diff(keys[order]) != 0) | (np.diff(checks[order]) != 0)]) if len(order) else order
                which = order[first]
                yield pa.RecordBatch.from_arrays([_strings(data, starts[which], ends[which]), pa.array(np.diff(np.r_[first, len(order)]))], names=["word", "n"])
                if more:
                    yield pa.RecordBatch.from_arrays([pa.array(list(more)), pa.array(list(more.values()), pa.int64())], names=["word", "n"])

    return run


def word_counts(docs: DataFrame, least: int = LEAST, often: int = OFTEN, spoil: int | None = None) -> DataFrame:
    """(word, n): the words of whole ``docs`` (doc_id, text) with their occurrences, ``often`` or more of them.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased, with ``least``
    code points or more. Null text: none. With ``spoil``, misspellings are made for tests: where spoil divides the
    crc32 h of ``<doc_id>:<word>``, the word's code point h % length is left out and ``least`` holds for what is
    left; a null doc_id spoils nothing. Rows that repeat count each. Each task counts the words of a few
    megabytes of text before anything is shuffled, so a very frequent word is a row a block of text.
    """
    found = map_batches(docs.select("doc_id", "text").where("text is not null"), _counted(least, spoil), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, and each one's offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    words = column.to_pylist()
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.r_[0, np.cumsum([len(w) for w in words], dtype=np.int64)]


def _bigrams(points: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bigram, its word, its place) of all words."""
    n = np.maximum(np.diff(of) - 1, 0)
    word, place = np.repeat(np.arange(len(n)), n), ragged(n)
    at = of[word] + place
    return points[at].astype(np.int64) << 21 | points[at + 1], word, place


def _bigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams, n = np.unique(_bigrams(*_points(batch.column("word")))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams, word, place = _bigrams(*_points(batch.column("word")))
        for at in range(0, len(grams), PASS // 16):
            part = slice(at, at + PASS // 16)
            picked = pa.array(word[part])
            yield pa.RecordBatch.from_arrays([batch.column("word").take(picked), batch.column("n").take(picked), pa.array(grams[part]), pa.array(place[part].astype(np.int32))], names=["word", "n", "gram", "place"])


def one_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of code points differ by one replaced point, or, if those of x are longer by one, by one inserted point."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(1) == 1
    yes = np.ones((len(x), 1), bool)
    begins = np.hstack([yes, np.logical_and.accumulate(x[:, :-1] == y, axis=1)])
    ends = np.hstack([np.logical_and.accumulate((x[:, 1:] == y)[:, ::-1], axis=1)[:, ::-1], yes])
    return (begins & ends).any(1)


def _ends(points: np.ndarray, of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and of the last ``n`` code points of each word; equal points have equal hashes."""
    weights = np.multiply.accumulate(np.full(max(1, int(n.max(initial=1))), 0x9E3779B97F4A7C15, np.uint64))
    nth, word = ragged(n), np.repeat(np.arange(len(n)), n)
    out = []
    for at in (of[:-1][word] + nth, of[1:][word] - 1 - nth):
        sums = np.r_[np.uint64(0), np.cumsum(points[at].astype(np.uint64) * weights[nth], dtype=np.uint64)]
        to = np.cumsum(n)
        out.append(sums[to] - sums[to - n])
    return out[0], out[1]


def _near_words(rows: pa.Table, of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of near words of a cell, as (a, n_a, b, n_b): of its words of full length with each other, and with those shorter by one.

    One edit leaves the first or the last half of the shorter word as it is, so only words of a cell that agree in one of them are compared, point by point.
    A pair that agrees in both comes twice.
    """
    points, word_of = _points(rows.column("word"))
    size, block, low, high, dim = np.diff(word_of), *(rows.column(c).to_numpy() for c in ("block", "low", "high", "dim"))
    full, alone, cell = size == dim, low == high, np.repeat(np.arange(len(of) - 1), np.diff(of))
    found: list[np.ndarray] = []
    for half in _ends(points, word_of, (dim - 1).astype(np.int64) // 2):
        order = np.lexsort((half, cell))
        begins = np.flatnonzero(np.r_[True, (np.diff(cell[order]) != 0) | (np.diff(half[order]) != 0)])
        sizes = np.diff(np.r_[begins, len(order)])
        partners = np.repeat(begins + sizes, sizes) - np.arange(len(order)) - 1
        upto = np.r_[0, np.cumsum(partners)]
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
            i = np.repeat(np.arange(at, to), partners[at:to])
            i, j = order[i], order[i + 1 + ragged(partners[at:to])]
            met = np.flatnonzero((full[i] | full[j]) & (alone[i] | (block[i] != block[j])))
            i, j = i[met], j[met]
            i, j = np.where(size[i] >= size[j], i, j), np.where(size[i] >= size[j], j, i)
            kinds = 2 * size[i] + (size[i] > size[j])
            for kind in np.unique(kinds).tolist():
                m, n, these = kind // 2, kind // 2 - kind % 2, np.flatnonzero(kinds == kind)
                for part in range(0, len(these), max(1, PASS // m)):
                    x, y = (side[these[part : part + max(1, PASS // m)]] for side in (i, j))
                    near = one_apart(points[word_of[x][:, None] + np.arange(m)], points[word_of[y][:, None] + np.arange(n)])
                    found.append(np.stack([x[near], y[near]]))
            at = to
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    if pairs.shape[1]:
        columns = [rows.column(c).take(pa.array(side)) for side in pairs for c in ("word", "n")]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["a", "n_a", "b", "n_b"])


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of ``words`` (word, n) that one inserted, deleted or replaced code point parts, once, staged.

    ``words`` is staged and distinct, with four code points or more each (three bigrams). The order of bigrams (their numbers over all
    words, then their code points) is joined to the words' bigrams; it is sent whole if it is small, as it is for
    any alphabet. A cell is a bigram at a place of words of one length, with the words shorter by one
    that have it there or one place earlier. A cell's words are compared inside tasks, in blocks of BLOCK words or BLOCK_POINTS
    code points, and only near pairs come out. A word has as many near words as its length and the alphabet allow.
    """
    order = staged(map_batches(words.select("word"), _bigram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("often")), "bigrams")
    placed = map_batches(words, _placed, "word string, n long, gram long, place int").join(small(order), "gram")
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("often", "gram", "place"))), 1, PREFIX)
    prefix = placed.groupBy("word", "n").agg(rarest.alias("grams")).select("word", "n", F.char_length("word").alias("size"), F.explode("grams").alias("g"))
    prefix = staged(prefix.select("word", "n", "size", "g.gram", "g.place"), "prefixes")
    # One that is shorter may have its bigram where the longer one has it, or one place before.
    longer = F.array(*(F.struct(F.lit(more).alias("more"), F.lit(on).alias("on")) for more, on in ((0, 0), (1, 0), (1, 1))))
    entries = prefix.withColumn("x", F.explode(longer)).select("word", "n", "gram", (F.col("place") + F.col("x.on")).alias("place"), (F.col("size") + F.col("x.more")).alias("dim"), (F.col("x.more") == 0).alias("full"))
    key = ["gram", "place", "dim"]
    cells = staged(entries.groupBy(*key).agg(F.count("*").alias("m"), F.max("full").alias("any")).where("m > 1 and any").drop("any"), "meeting")
    blocks = F.ceil(F.col("m") / F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_POINTS) / F.col("dim"))))).cast("int")
    met = entries.join(small(cells), key).withColumn("block", F.pmod(F.xxhash64("word"), blocks).cast("int")).withColumn("next", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.withColumns({"low": F.least("block", "next"), "high": F.greatest("block", "next")}).withColumn("cell", F.xxhash64("gram", "place", "low", "high"))
    met = met.select("cell", "dim", "word", "n", "block", "low", "high")
    pairs = map_cells(met, _near_words, "a string, n_a long, b string, n_b long")
    swapped = F.col("a") > F.col("b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.when(swapped, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.greatest("a", "b").alias("b"), F.when(swapped, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"))
    out = staged(pairs.distinct(), "near-words")
    release(order, prefix, cells)
    return out


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n), all distinct, of four code points or more.

    A word's form is the most frequent of the words near it (see ``near_words``; of equal ones the smallest in code-point
    order) if that is at least ``times`` (2 or more) times as frequent; else null. ``root`` follows forms to the last
    (the word itself if it has none); numbers grow along the way, so it ends, after some twenty steps at most for any corpus, which
    five rounds of doubling cover. ``n_near`` counts near words, 0 if none. Empty table: no rows. The result is staged.
    """
    words = staged(words.select("word", "n"), "words")
    near = near_words(words)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).union(near.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("n_other"), "other"))["other"].alias("best"), F.max("n_other").alias("n_best"))
    formed = words.join(best, "word", "left").withColumn("is_form", F.coalesce(F.col("n_best") >= times * F.col("n"), F.lit(False)))
    formed = staged(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("if(is_form, best, null)").alias("form"), F.expr("if(is_form, n_best, null)").alias("form_n")), "forms")
    release(words, near)
    upward = staged(formed.where("form is not null").select("word", F.col("form").alias("root")), "upward")
    while True:
        above = upward.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if upward.join(above, "root", "left_semi").isEmpty():
            break
        old, upward = upward, staged(upward.join(above, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "upward")
        release(old)
    out = formed.join(upward, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = staged(out, "variants")
    release(formed, upward)
    return out
