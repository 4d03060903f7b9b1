"""Language identification as a mixture of languages, fitted per document by expectation-maximisation.

Each language is a distribution over hashed byte trigrams, counted on labelled documents. A document's
words are the units of the mixture: a word's likelihood under a language is that of its trigrams. EM
finds the document's proportions over all languages; then languages are taken out, least first, while
the penalised likelihood gets no worse.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_batches
from .textops import LOWER, Texts, ragged, runs, spans

UNKNOWN = "und"
CELLS = 1 << 16
SMOOTHING = 0.5
#: Languages that can be learned; the model has CELLS numbers for each.
MOST_LANGUAGES = 256
#: A text's EM ends when none of its shares moves by TOLERANCE any more, or after so many rounds.
ROUNDS, TOLERANCE = 50, 1e-3
FOUND = "lang_pred string, score double, langs array<string>, shares array<double>"

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


@dataclass
class Model:
    languages: list[str]
    log_likelihood: np.ndarray  # languages x CELLS, float32


def _trigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cell of each letter byte with its neighbours (others count as spaces), word starts among them, words of each text."""
    lower = LOWER[texts.data]
    letter = _LETTER[lower]
    starts, ends = spans(letter, texts.offsets)
    padded = np.full(len(lower) + 2, 0x20, np.uint32)
    padded[1:-1] = np.where(letter, lower, 0x20)
    at = np.flatnonzero(letter)
    left, right = padded[at], padded[at + 2]
    first = np.cumsum(ends - starts) - (ends - starts)
    left[first] = 0x20
    right[first + (ends - starts) - 1] = 0x20
    code = (left << np.uint32(16)) | (padded[at + 1] << np.uint32(8)) | right
    cell = ((code * np.uint32(2654435769)) >> np.uint32(16)).astype(np.int64)
    return cell, first, np.searchsorted(starts, texts.offsets), ends - starts


def _counted(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: k for k, name in enumerate(languages)}
        total = np.zeros(len(languages) * CELLS, np.int64)
        for batch in batches:
            which = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for texts in runs(batch.column("text")):
                cell, _, of, lengths = _trigrams(texts)
                letters = np.diff(np.r_[0, np.cumsum(lengths)][of])
                total += np.bincount(np.repeat(which[texts.first : texts.first + len(texts)], letters) * CELLS + cell, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return run


def fit(labelled: DataFrame) -> Model:
    """The trigram model of every non-null ``lang`` of ``labelled`` (text, lang), counted over all its rows.

    Counts are combined in each task, then over tasks; the model alone comes to the driver, of a size
    that only the number of languages sets. Null texts count for nothing. No labelled rows: no languages.
    """
    labelled = labelled.select("text", "lang").where("lang is not null")
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros(len(languages) * CELLS)
    if languages:
        rows = map_batches(labelled, _counted(languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    counts = counts.reshape(len(languages), CELLS) + SMOOTHING
    return Model(languages, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def _em(p: np.ndarray, of: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Proportions of each text whose words p[:, of[i]:of[i + 1]] (likelihoods, one row a language) has any.

    Each text stops by itself, so its shares don't depend on the texts beside it.
    """
    n, share, moving = np.diff(of), share.copy(), np.arange(len(of) - 1)
    for _ in range(ROUNDS):
        weight = p * np.repeat(share[:, moving], n[moving], axis=1)
        weight /= np.maximum(weight.sum(0), np.float32(1e-30))
        new = np.add.reduceat(weight, of[:-1], axis=1) / n[moving].astype(np.float32)
        on = np.abs(new - share[:, moving]).max(0) >= TOLERANCE
        share[:, moving] = new
        if not on.any():
            break
        if not on.all():
            p, moving = p[:, np.repeat(on, n[moving])], moving[on]
            of = np.r_[0, np.cumsum(n[moving])]
    return share


def _fitted(p: np.ndarray, of: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log-likelihood of each text under its proportions."""
    seen = (p * np.repeat(share, np.diff(of), axis=1)).sum(0)
    return np.add.reduceat(np.log(np.maximum(seen, 1e-30)).astype(np.float64), of[:-1])


def mixtures(model: Model, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, number of words) of each text; proportions of languages outside the chosen set are 0.

    EM runs until no share of the text moves by TOLERANCE, ROUNDS times at most.

    The penalty of a language is the logarithm of the number of words, as for a free parameter.
    """
    cell, first, of, _ = _trigrams(texts)
    n = np.diff(of)
    share = np.zeros((len(texts), len(model.languages)))
    if not len(cell) or not model.languages:
        return share, n
    word = np.stack([np.add.reduceat(row[cell], first) for row in model.log_likelihood])
    p = np.exp(word - word.max(0)) + np.float32(1e-12)
    has = np.flatnonzero(n)
    of = np.r_[of[has], of[-1]]
    now = _em(p, of, np.full((len(model.languages), len(has)), 1 / len(model.languages), np.float32))
    likelihood = _fitted(p, of, now)
    penalty = np.log(np.diff(of) + 1)
    trying = np.arange(len(has))
    for _ in range(len(model.languages) - 1):
        if not len(trying):
            break
        fewer = now[:, trying]
        fewer[np.where(fewer > 0, fewer, np.inf).argmin(0), np.arange(len(trying))] = 0
        fewer /= np.maximum(fewer.sum(0), np.float32(1e-12))
        rows = np.repeat(of[trying], np.diff(of)[trying]) + ragged(np.diff(of)[trying])
        sub, sub_of = p[:, rows], np.r_[0, np.cumsum(np.diff(of)[trying])]
        fewer = _em(sub, sub_of, fewer) if ((fewer > 0).sum(0) > 1).any() else fewer
        without = _fitted(sub, sub_of, fewer)
        better = without + penalty[trying] >= likelihood[trying]
        took = trying[better]
        now[:, took], likelihood[took] = fewer[:, better], without[better]
        trying = took[(now[:, took] > 0).sum(0) > 1]
    share[has] = now.T
    return share, n


def _no_letter(texts: Texts) -> np.ndarray:
    """Texts without any letter. Only those without a-z are looked at one by one."""
    plain = np.r_[0, np.cumsum((texts.data | 0x20) - np.uint8(0x61) < 26)][texts.offsets]
    out = np.diff(plain) == 0
    for i in np.flatnonzero(out):
        out[i] = not any(c.isalpha() for c in texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode())
    return out


def _predicted(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for texts in runs(batch.column("text")):
                share, n = mixtures(model, texts)
                known = (n > 0) & ~_no_letter(texts) & bool(model.languages)
                best = share.argmax(1) if model.languages else np.zeros(len(texts), np.int64)
                score = np.clip(share.max(1, initial=0), 0, 1) * known
                order = np.argsort(-share, axis=1, kind="stable")
                used = (share > 0).sum(1) * known
                langs = [[model.languages[k] for k in row[:m]] for row, m in zip(order.tolist(), used.tolist(), strict=True)]
                shares = [row[ix[:m]].tolist() for row, ix, m in zip(share, order, used.tolist(), strict=True)]
                pred = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
                part = batch.slice(texts.first, len(texts))
                made = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], names=[*names, "lang_pred", "score", "langs", "shares"])

    return run


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score, langs, shares: each text's languages by share, the first one and its share.

    Only ``text`` is looked at. Null, empty or letterless text: ``und``, score 0, no languages; so are
    all texts if the model has no language. Equal shares go by the language's name. Columns of ``docs``
    named like a result are replaced. Empty table: no rows. No row is shuffled.
    """
    made = T.StructType.fromDDL(FOUND)
    docs = docs.drop(*made.names)
    return map_batches(docs, _predicted(docs.sparkSession.sparkContext.broadcast(model), docs.columns), T.StructType([*docs.schema.fields, *made.fields]))
