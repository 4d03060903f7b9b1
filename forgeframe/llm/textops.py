"""Words, word hashes and shingle hashes of whole batches of texts, vectorised over their UTF-8 bytes.

An Arrow string column is one run of bytes with offsets; everything here works on such runs, so the
cost per text is a few numpy calls shared by thousands of texts. Two alphabets are used:

* ``SPACED``: a word is a run of anything but space and \\x09-\\x0D;
* ``ALNUM``: a word is a run of 0-9, a-z, A-Z and non-ASCII characters.

A-Z are lower-cased in either; nothing else is changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

U64 = np.uint64
_ODD = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)]
#: Bytes up to which a span is hashed block by block.
CHAINED = 64
#: Masks of the first 0 to 8 bytes of a block.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@dataclass
class Texts:
    """A run of texts: ``data`` holds their bytes, text i lies at ``offsets[i]:offsets[i + 1]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def runs(column: pa.Array, max_bytes: int = 512 << 10) -> Iterator[Texts]:
    """The texts of an Arrow string column (null: empty) in runs of about ``max_bytes``; one longer text is a run alone."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, where, bytes_ = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bytes_, np.uint8) if bytes_ is not None and bytes_.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        to = min(n, max(to, at + 1))
        yield Texts(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Words of a run of texts in order: byte spans, and ``of[i]:of[i + 1]`` the words of text i."""

    lower: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def hashes(self, kind: int = 0) -> np.ndarray:
        return span_hashes(self.lower, self.starts, self.ends, kind)


def spans(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that cross no edge (``edges``: positions where something new begins)."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = edges[(edges > 0) & (edges < len(inside))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def words(texts: Texts, alphabet: np.ndarray) -> Words:
    starts, ends = spans(alphabet[texts.data], texts.offsets)
    return Words(LOWER[texts.data], starts, ends, np.searchsorted(starts, texts.offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for each span. The two kinds are independent.

    Spans are read in blocks of 8 bytes, each scrambled into the state, which begins with the length: one
    block has a hash of its own among spans of its length. Spans beyond CHAINED bytes get a cryptographic
    hash, so no periodic or otherwise regular bytes of any length meet.
    """
    lengths = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    loads = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix(lengths.astype(U64) * _ODD[kind] + _ODD[1 - kind])
    rest, at, left = None, starts, lengths
    for _ in range(CHAINED // 8):
        block = loads[at]
        block &= _FIRST[np.minimum(left, 8)]
        if rest is None:
            out = mix(out ^ block)
        else:
            out[rest] = mix(out[rest] * _ODD[kind] ^ block)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        rest = more if rest is None else rest[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lengths > CHAINED).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, person=b"kind%d" % kind).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def windows(hashes: np.ndarray, of: np.ndarray, n: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` consecutive words, and the offsets of each text's windows.

    A text of fewer words, but not none, has its whole sequence as one window where ``whole_if_short``.
    """
    counts = np.diff(of)
    coefficients = mix(np.arange(1, n + 1, dtype=U64) * _ODD[1]) | U64(1)
    total = len(hashes)
    rolled = np.zeros(max(0, total - n + 1), U64)
    for j in range(n if len(rolled) else 0):
        rolled += hashes[j : total - n + 1 + j] * coefficients[j]
    n_windows = np.maximum(counts - n + 1, 0)
    at = np.repeat(of[:-1], n_windows) + ragged(n_windows)
    rolled = mix(rolled[at]) if len(at) else np.zeros(0, U64)
    if whole_if_short and len(short := np.flatnonzero((counts > 0) & (counts < n))):
        lengths = counts[short]
        position = ragged(lengths)
        piece = hashes[np.repeat(of[short], lengths) + position] * coefficients[position]
        sums = np.add.reduceat(piece, np.r_[0, np.cumsum(lengths)[:-1]]) + lengths.astype(U64) * _ODD[0]
        before = np.r_[0, np.cumsum(n_windows)][short]
        rolled = np.insert(rolled, before, mix(sums))
        n_windows = n_windows.copy()
        n_windows[short] = 1
    return rolled, np.r_[0, np.cumsum(n_windows)]


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def distinct_sorted(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, ascending, and their offsets."""
    parts = [np.sort(values[a:b]) for a, b in zip(of[:-1], of[1:], strict=True)]
    if not len(values):
        return values, np.zeros(len(of), np.int64)
    flat = np.concatenate(parts)
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[of[:-1][of[:-1] < len(flat)]] = True
    return flat[fresh], np.r_[0, np.cumsum(fresh)][of]


def set_digests(values: np.ndarray, of: np.ndarray) -> pa.Array:
    """128 bits of a cryptographic hash over each whole set (sorted values): equal only for equal sets."""
    raw = np.ascontiguousarray(values).view(np.uint8)
    return pa.array([hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)], pa.binary())


def list_array(values: np.ndarray, of: np.ndarray) -> pa.Array:
    """Arrow lists of bigint over ``values`` (unsigned values keep their bits)."""
    return pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(values.view(np.int64)))
