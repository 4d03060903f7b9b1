"""Runs of periodic words inside documents: repeated k-grams mask what can't be in one, Main-Lorentz finds the rest.

A run of period q and length m repeats itself at a distance of q over m - q words. With runs of ``least``
words and ``times`` periods or more, that overlap has k = min over q of max(least, times * q) - q words at
least, so each word of a run lies in a k-gram that occurs twice in its document. All other words are left
out; what survives, in stretches, goes through the divide and conquer of Main and Lorentz: for a stretch
cut in its middle and each period, the words that go on repeating before and after the cut are measured.
All stretches of a run of texts are cut in step, level by level, so the cost a text is a few numpy calls.
How far two places agree comes from names of all blocks of 2**j words (equal names are equal words).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import map_batches
from .textops import SPACED, U64, mix, ragged, runs, span_hashes, spans, windows

#: Words and periods of a run, at least.
LEAST, TIMES = 24, 3
#: Bytes of the texts that are worked on at once; candidates (cut, period) of one pass.
RUN_BYTES, PASS = 1 << 20, 1 << 19


def overlap(least: int, times: int) -> int:
    """The words over which any run repeats itself, at least; 16 for 24 words and three periods."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repeated(hashes: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that occurs twice or more in their own text."""
    grams, at = windows(hashes, of, k, whole_if_short=False)
    inside = np.zeros(len(hashes) + 1, np.int64)
    if len(grams):
        n = np.diff(at)
        word = np.repeat(of[:-1], n) + ragged(n)
        grams = mix(grams + np.repeat(np.arange(len(n)), n).astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        again = np.zeros(len(grams), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        np.add.at(inside, word[again], 1)
        np.add.at(inside, word[again] + k, -1)
    return np.cumsum(inside[:-1]) > 0


class Blocks:
    """Names of all blocks of 2**j words: equal if and only if the words are."""

    def __init__(self, words: np.ndarray, longest: int):
        self.names, size = [np.unique(words, return_inverse=True)[1]], 1
        while 2 * size <= longest:
            last = self.names[-1]
            pairs = last[: len(last) - size] * (int(last.max()) + 1) + last[size:]
            now = np.full(len(last), -1)
            now[: len(pairs)] = np.unique(pairs, return_inverse=True)[1]
            self.names.append(now)
            size *= 2

    def after(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; i < j, before ``end``."""
        n = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            fits = np.flatnonzero(j + n + (1 << level) <= end)
            x = n[fits]
            fits = fits[self.names[level][i[fits] + x] == self.names[level][j[fits] + x]]
            n[fits] += 1 << level
        return n

    def before(self, i: np.ndarray, j: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How many words that end before i equal those that end before j; i < j, from ``start`` on."""
        n = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            fits = np.flatnonzero(i - n - (1 << level) >= start)
            x = n[fits] + (1 << level)
            fits = fits[self.names[level][i[fits] - x] == self.names[level][j[fits] - x]]
            n[fits] += 1 << level
        return n


def main_lorentz(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of all runs within the stretches [start, end) of ``words``, by start, then period.

    A run crosses the middle of the smallest part of the stretch that holds it; there it has a whole
    period on one side at least, so the middle and the place a period before or after it agree.
    """
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none
    blocks = Blocks(words, int((ends - starts).max()))
    half = blocks.names[(-(-overlap(least, times) // 2)).bit_length() - 1]
    wide = 1 << ((-(-overlap(least, times) // 2)).bit_length() - 1)
    found = []
    low, high, first, last = starts, ends, starts, ends
    while len(low):
        middle = (low + high) // 2
        periods = (high - low) // times
        upto = np.r_[0, np.cumsum(periods)]
        at = 0
        while at < len(low):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + PASS, "right")) - 1)
            part = np.repeat(np.arange(at, to), periods[at:to])
            period = ragged(periods[at:to]) + 1
            for i in (middle[part], middle[part] - period):
                j, start, end = i + period, first[part], last[part]
                inside = (i >= start) & (j <= end)
                # Of the least overlap, half lies before or after this place.
                ahead = inside & (j + wide <= end)
                ahead[ahead] = half[i[ahead]] == half[j[ahead]]
                behind = inside & ~ahead & (i - wide >= start)
                behind[behind] = half[i[behind] - wide] == half[j[behind] - wide]
                both = np.flatnonzero(ahead | behind)
                i, j, start, end = i[both], j[both], start[both], end[both]
                back, p = blocks.before(i, j, start), period[both]
                length = blocks.after(i, j, end) + back + p
                good = length >= np.maximum(least, times * p)
                found.append(np.stack([i - back, length, p])[:, good])
            at = to
        # Parts that can still hold a run.
        more = [(low, middle), (middle, high)]
        kept = [np.flatnonzero(b - a >= least) for a, b in more]
        first, last = (np.concatenate([x[k] for k in kept]) for x in (first, last))
        low, high = (np.concatenate([pair[side][k] for pair, k in zip(more, kept, strict=True)]) for side in (0, 1))
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    smallest = np.r_[True, (np.diff(start) != 0) | (np.diff(length) != 0)][: len(start)]  # multiples of a period have the same run
    start, length, period = start[smallest], length[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> pa.Array:
    """Words joined by one space, for each text; ``of`` are the texts' offsets in the words."""
    sizes = ends - starts + 1
    upto = np.r_[0, np.cumsum(sizes)]
    out = np.r_[data, np.uint8(0x20)][np.repeat(starts, sizes) + ragged(sizes)]
    out[upto[1:] - 1] = 0x20
    begin, stop = upto[of[:-1]], upto[of[1:]]
    some = stop > begin
    gone = np.ones(len(out), bool)
    gone[stop[some] - 1] = False  # no space after a text's last word
    offsets = np.r_[0, np.cumsum(stop - begin - some)]
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out[gone])))


def _looped(doc_ids: list, of: np.ndarray) -> np.ndarray:
    """The number of the word that each word becomes: in each tenth document, by its id's crc32, the last part is made periodic."""
    source = np.arange(of[-1])
    for k, doc_id in enumerate(doc_ids):
        n = int(of[k + 1] - of[k])
        h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[of[k] + a : of[k + 1]] = of[k] + a + np.arange(n - a) % p
    return source


def _runs(least: int, times: int, looped: bool):
    k = overlap(least, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for texts in runs(batch.column("text"), RUN_BYTES):
                named = ids.slice(texts.first, len(texts))
                starts, ends = spans(SPACED[texts.data], texts.offsets)
                of = np.searchsorted(starts, texts.offsets)
                hashes = span_hashes(texts.data, starts, ends)
                if looped:
                    source = _looped(named.to_pylist(), of)
                    starts, ends, hashes = starts[source], ends[source], hashes[source]
                again = repeated(hashes, of, k)
                first, last = spans(again, of)
                inner = np.flatnonzero(again)
                checks = span_hashes(texts.data, starts[inner], ends[inner], 1)
                order = np.lexsort((checks, hashes[inner]))
                new = np.r_[0, np.cumsum((np.diff(hashes[inner][order]) != 0) | (np.diff(checks[order]) != 0))][: len(order)]
                names = np.empty(len(order), np.int64)
                names[order] = new
                place = np.r_[0, np.cumsum(last - first)]
                start, length, period = main_lorentz(names, place[:-1], place[1:], least, times)
                start = inner[start] if len(start) else start
                text = np.searchsorted(of, start, "right") - 1
                n_runs = np.r_[0, np.cumsum(np.bincount(text, minlength=len(texts)))]
                drop = np.zeros(len(starts) + 1, np.int64)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, start + length, -1)
                kept = np.cumsum(drop[:-1]) == 0
                kept_of = np.r_[0, np.cumsum(kept)][of]
                fields = [pa.array(x) for x in (start - of[text], length, period)]
                found = pa.ListArray.from_arrays(pa.array(n_runs, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                collapsed = _joined(texts.data, starts[kept], ends[kept], kept_of).cast(pa.string())
                yield pa.RecordBatch.from_arrays([named, pa.array(np.diff(of)), found, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, looped: bool = False) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) for every row of ``docs`` (doc_id, text).

    Words are runs of anything but white space, as they are written, numbered from 0. A run is a stretch of words with
    smallest period q, of ``least`` words and ``times`` (2 or more) periods at least, that no neighbouring
    word extends; all are listed, by start, then period. ``collapsed`` is the text's words, joined by one space,
    without those that a run holds after its first q words. Null text: no words, empty ``collapsed``. Rows that
    repeat, and null doc_ids, are handled each by itself; other columns are ignored. Empty table: no rows.
    ``looped`` makes runs for tests: in documents whose id's crc32 is divisible by ten the last part becomes periodic.

    Nothing is shuffled: a task holds a run of texts (RUN_BYTES, or one longer text) and some numbers for each word.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), _runs(least, times, looped), f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
