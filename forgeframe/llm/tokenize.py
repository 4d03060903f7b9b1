"""Token ids of whole texts, for batches: each distinct piece of text is encoded once.

The tokenizers in use split a text before a space that stands between two characters that aren't white
space, and never look across such a place. So a text may be cut there, and the same short pieces
(mostly a word with its space) come again and again: their ids are kept.

Pieces are told apart by 128 bits of two hashes of their bytes; of one block of 8 bytes these are one to
one. A run of texts with two pieces of one hash and different second hashes is encoded whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from .textops import Texts, ragged, span_hashes

#: Pieces that one worker remembers (some 15 MB), and the longest of them in bytes.
REMEMBERED = 1 << 19
LONGEST = 48
#: Pieces that the tokenizer gets at once; its results hold far more than the ids. Bytes of a run of texts.
RUN_BYTES = 2 << 20
TOGETHER = 512

_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
#: First bytes of two-byte characters of which none is white space.
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True
_held: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This process's encoder for the tokenizer file at ``path``."""
    if path not in _held:
        _held[path] = PieceEncoder(path)
    return _held[path]


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark = plain[0] if plain else None
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks, self.again = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        self.at, self.lengths, self.ids = np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def _make_room(self) -> None:
        """Keeps the pieces that came again since they were learned; if these are many too, none."""
        kept = np.flatnonzero(self.again)
        if 2 * len(kept) > REMEMBERED:
            self._forget()
            return
        lengths = self.lengths[kept].astype(np.int64)
        self.ids = self.ids[np.repeat(self.at[kept], lengths) + ragged(lengths)]
        self.keys, self.checks, self.lengths = self.keys[kept], self.checks[kept], self.lengths[kept]
        self.at, self.again = (np.cumsum(lengths) - lengths).astype(np.int32), np.zeros(len(kept), bool)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has.

        Pieces go to the tokenizer joined by a special token: it cuts a text there before anything else, so
        ids are those of each piece alone, and the token's id tells them apart. Pieces that hold an added
        token themselves go one by one.
        """
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), TOGETHER):
            part = pieces[at : at + TOGETHER]
            if self.mark is not None and not any(t in p for t in self.added for p in part):
                number, text = self.mark
                joined = np.array(self.tokenizer.encode_batch_fast([text.join([*part, ""])], add_special_tokens=False)[0].ids, np.uint32)
                ends = joined == number
                ids.append(joined[~ends])
                lengths.append(np.diff(np.r_[-1, np.flatnonzero(ends)]) - 1)
            else:
                found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
                ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        raw = data.tobytes()
        ids, lengths = self._encoded([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        at, lengths = (np.cumsum(lengths) - lengths + len(self.ids)).astype(np.int32), lengths.astype(np.uint8)
        keys, checks = np.r_[self.keys, keys], np.r_[self.checks, checks]
        order = np.argsort(keys, kind="stable")
        self.keys, self.checks = keys[order], checks[order]
        self.again = np.r_[self.again, np.zeros(len(lengths), bool)][order]
        self.at, self.lengths, self.ids = np.r_[self.at, at][order], np.r_[self.lengths, lengths][order], np.r_[self.ids, ids]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts, and each text's offsets in them."""
        data, n = texts.data, len(texts.data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        cut = np.zeros(n, bool)
        space = np.flatnonzero(data[1:-1] == 0x20) + 1
        before = _PLAIN[data[space - 1]] | (_LEAD[data[space - 2]] & (data[space - 1] >= 0x80) & (space > 1))
        after = _PLAIN[data[space + 1]] | _LEAD[data[space + 1]]
        cut[space[before & after]] = True
        edges = texts.offsets[:-1][np.diff(texts.offsets) > 0]
        cut[edges] = True
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], n]
        keys, checks = span_hashes(data, starts, ends, 0), span_hashes(data, starts, ends, 1)
        unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if (checks != checks[first][which]).any():  # two pieces of one hash
            raw = data.tobytes()
            ids, lengths = self._encoded([raw[a:b].decode() for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)])
            return ids, np.r_[0, np.cumsum(lengths)]
        short = ends[first] - starts[first] <= LONGEST
        if len(self.keys) > REMEMBERED:
            self._make_room()
        place = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        known = np.zeros(len(unique), bool)
        if len(self.keys):
            known = (self.keys[place] == unique) & (self.checks[place] == checks[first])
            self.again[place[known]] = True
            short &= known | (self.keys[place] != unique)  # a piece with the hash of another one isn't remembered
        fresh = first[~known & short]
        fresh.sort()
        self._learn(data, starts[fresh], ends[fresh], keys[fresh], checks[fresh])
        at, lengths, pool = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64), self.ids
        place = np.searchsorted(self.keys, unique[short])
        at[short], lengths[short] = self.at[place], self.lengths[place]
        if not short.all():  # long pieces are encoded but not remembered
            raw, once = data.tobytes(), first[~short]
            ids, lengths[~short] = self._encoded([raw[a:b].decode() for a, b in zip(starts[once].tolist(), ends[once].tolist(), strict=True)])
            at[~short] = np.cumsum(lengths[~short]) - lengths[~short] + len(pool)
            pool = np.r_[pool, ids]
        each = lengths[which]
        out = pool[np.repeat(at[which], each) + ragged(each)]
        upto = np.r_[0, np.cumsum(each)]
        return out, upto[np.searchsorted(starts, texts.offsets)]

    def encode_with_end(self, texts: Texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with ``end_id`` after each text."""
        ids, of = self.encode(texts)
        return np.insert(ids, of[1:], end_id), of + np.arange(len(of))
