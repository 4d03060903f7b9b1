"""Quality and toxicity by hierarchical empirical Bayes: document evidence, host and path posteriors.

Evidence of a document is the sum of weights of what it contains (words, marks, shares of capitals and
of distinct words, length). Counts over all labelled documents choose what is weighed, a logistic regression on a bounded
sample weighs it, and labelled documents that neither has seen calibrate the sum. Hosts shrink towards the whole corpus, paths towards their host, by prior strengths that
the spread of their means sets. A document's posterior odds are its evidence times its path's odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_batches
from .lsh import small
from .storage import staged
from .textops import ALNUM, SPACED, U64, Texts, mix, runs, span_hashes, spans, words

TARGETS = ("quality", "toxic")
CELL_BITS = 18
CELLS = 1 << CELL_BITS
#: Features whose log odds are so many standard errors from 0 are weighed, this many at most, the surest first.
SURE, WEIGHED = 3.0, 4096
#: The weights are fitted on this many labelled rows at most (those of the smallest hashes of doc_id; any of them, where ids repeat).
SAMPLE = 10_000
RIDGE, STEPS, RATE = 1.0, 300, 0.05
#: Calibration sees evidence in bins of a tenth, cut off at +-60.
BIN, MOST = 0.1, 60.0
STRENGTHS = (1.0, 1e6)


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell) of the distinct features of each text, hashed into CELLS."""
    n = len(texts)
    found = words(texts, ALNUM)
    word_of = np.repeat(np.arange(n), found.counts)
    starts, ends = spans(SPACED[texts.data] & ~ALNUM[texts.data], texts.offsets)
    mark_of = np.searchsorted(texts.offsets, starts, "right") - 1
    data = texts.data
    upper = np.r_[0, np.cumsum((data >= 0x41) & (data <= 0x5A))][texts.offsets]
    letters = np.r_[0, np.cumsum(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A))][texts.offsets]
    caps = np.diff(upper) * 10 // np.maximum(np.diff(letters), 1)
    size = np.log2(found.counts + 1).astype(np.int64)

    def cells(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(64 - CELL_BITS)).astype(np.int64)

    own = np.unique(word_of * CELLS + cells(found.hashes()))
    fresh = np.bincount(own >> CELL_BITS, minlength=n) * 10 // np.maximum(found.counts, 1)
    marks = mark_of * CELLS + cells(mix(span_hashes(data, starts, ends) + U64(1)))
    shape = [np.arange(n) * CELLS + cells(mix(x.astype(U64) + U64(k << 32))) for k, x in enumerate((caps, size, fresh), 1)]
    both = np.unique(np.concatenate([own, marks, *shape]))
    return both >> CELL_BITS, both & (CELLS - 1)


@dataclass
class Evidence:
    weights: np.ndarray  # targets x CELLS

    def of(self, texts: Texts) -> np.ndarray:
        text, cell = features(texts)
        return np.stack([np.bincount(text, w[cell], minlength=len(texts)) for w in self.weights])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(TARGETS) * 2 * (CELLS + 1), np.int64)  # the last cell of each counts documents
    for batch in batches:
        labels = [batch.column(t).fill_null(-1).to_numpy(zero_copy_only=False) for t in TARGETS]
        for texts in runs(batch.column("text")):
            text, cell = features(texts)
            for k, label in enumerate(labels):
                y = label[texts.first : texts.first + len(texts)]
                for value in (0, 1):
                    base = (k * 2 + value) * (CELLS + 1)
                    total[base : base + CELLS] += np.bincount(cell[y[text] == value], minlength=CELLS)
                    total[base + CELLS] += int((y == value).sum())
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])


def _of_cells(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(CELLS, -1)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            for texts in runs(batch.column("text")):
                text, cell = features(texts)
                there = place[cell] >= 0
                of = np.searchsorted(text[there], np.arange(len(texts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(place[cell][there], pa.int32()))
                part = batch.select(TARGETS).slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays([lists, *part.columns], names=["cells", *TARGETS])

    return run


def logistic(row: np.ndarray, column: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Weights of a ridge logistic regression on 0/1 features (row, column), by Adam on all rows at once."""
    w, b = np.zeros(width), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], minlength=len(y)) + b, -40, 40)))
        off = p - y
        g = np.r_[np.bincount(column, off[row], minlength=width) + RIDGE * w, off.sum()]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w


def fit_evidence(labelled: DataFrame) -> Evidence:
    """Weights of the features, from ``labelled`` (doc_id, text, quality, toxic): all of it for the choice, a sample for the fit."""
    rows = map_batches(labelled.select("text", *TARGETS), _counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(TARGETS) * 2 * (CELLS + 1))
    counts[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    counts = counts.reshape(len(TARGETS), 2, CELLS + 1)
    chosen = []
    for no, yes in counts:
        odds = np.log((yes[:-1] + 0.5) / (yes[-1] + 1)) - np.log((no[:-1] + 0.5) / (no[-1] + 1))
        z = np.abs(odds) / np.sqrt(1 / (yes[:-1] + 0.5) + 1 / (no[:-1] + 0.5))
        best = np.argsort(-z, kind="stable")[:WEIGHED]
        chosen.append(best[z[best] > SURE])
    cells = np.unique(np.concatenate(chosen))
    picked = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()
    sample = map_batches(labelled.join(F.broadcast(picked), "doc_id", "left_semi").select("text", *TARGETS), _of_cells(cells), "cells array<int>, quality int, toxic int").limit(SAMPLE).toArrow()
    out = np.zeros((len(TARGETS), CELLS))
    lists = sample.column("cells").combine_chunks() if len(sample) else pa.array([], pa.list_(pa.int32()))
    row, column = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    for k, t in enumerate(TARGETS):
        y = sample.column(t).to_numpy()
        own = np.isin(cells[column], chosen[k]) & ~np.isnan(y[row])
        rows_of = np.flatnonzero(~np.isnan(y))
        if len(rows_of):
            out[k, cells] = logistic(np.searchsorted(rows_of, row[own]), column[own], y[rows_of], len(cells))
    return Evidence(out)


def _scored(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in runs(batch.column("text")):
                part = batch.select(names).slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, shared.value.of(texts))], names=[*names, *(f"{t}_evidence" for t in TARGETS)])

    return run


def calibrate(evidence: np.ndarray, no: np.ndarray, yes: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the log odds by evidence: ridge logistic regression on binned counts."""
    a, b = 1.0, float(np.log((yes.sum() + 0.5) / (no.sum() + 0.5)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * evidence + b, -40, 40)))
        n, w = no + yes, (no + yes) * p * (1 - p)
        g = np.array([((yes - n * p) * evidence).sum() - 0.01 * (a - 1), (yes - n * p).sum() - 0.01 * b])
        h = np.array([[(w * evidence**2).sum() + 0.01, (w * evidence).sum()], [(w * evidence).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0))))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (F.lit(1.0) - p))


def _strength(sites: DataFrame, s: str, n: str, mean: Column) -> Column:
    """Prior strength, by moments: how much wider the site means spread than their counts explain."""
    m = F.sum(s) / F.sum(n)
    spread = F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - mean, F.lit(2.0))) / F.sum(n)
    noise = F.sum(mean * (F.lit(1.0) - mean)) / F.sum(n)
    between = F.greatest(spread - noise, F.lit(1e-12))
    return F.least(F.greatest(m * (F.lit(1.0) - m) / between - 1, F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1]))


def assess(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "concat_ws('/', source, lang)", held_out: str = "crc32(cast(doc_id as string)) % 3 = 1") -> DataFrame:
    """(doc_id, host, path, quality, toxic, ...) for every row of ``docs``: posteriors and what they are made of.

    ``docs``: doc_id, text and what the SQL expressions ``host`` and ``path`` need; ``labels``: doc_id,
    quality, toxic (0 or 1). Labelled documents for which ``held_out`` is false give the counts of the
    features, the others calibrate them. A site counts each labelled document by its label and each
    other one by its calibrated evidence; a document's own share is left out of what its site says.
    ``toxic`` is true above one half; ``keep`` where quality is at least one half and toxic isn't above.

    Null text: no words. Null host or path: a site of its own. Null labels are no labels; labels that
    repeat a doc_id are averaged. Without any label evidence is 0 and all stand at one half, kept. Rows
    that repeat a doc_id are assessed one by one. Empty table: no rows. Extra columns are ignored.

    Sites are summed within tasks before the shuffle, so a host with a third of all rows is one sum. The
    model and the global priors are all that comes to the driver, of a fixed size.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text", F.expr(host).alias("host"), F.expr(path).alias("path"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held"))
    mean_label = [F.round(F.avg(t)).cast("int").alias(t) for t in TARGETS]
    labels = small(staged(labels.where("doc_id is not null").groupBy("doc_id").agg(*mean_label), "labels"))
    labelled = docs.join(labels, "doc_id").where("not held")
    shared = sc.broadcast(fit_evidence(labelled))
    scored = map_batches(docs, _scored(shared, ["doc_id", "host", "path", "held"]), "doc_id long, host string, path string, held boolean, quality_evidence double, toxic_evidence double")
    scored = staged(scored.join(labels, "doc_id", "left"), "evidence")
    priors, columns = [], {}
    for t in TARGETS:
        bins = scored.where(F.col("held") & F.col(t).isNotNull()).groupBy(F.round(F.greatest(F.least(F.col(f"{t}_evidence"), F.lit(MOST)), F.lit(-MOST)) / BIN).alias("bin")).agg(F.sum(F.lit(1) - F.col(t)).alias("no"), F.sum(t).alias("yes")).toPandas()
        a, b = calibrate(bins["bin"].to_numpy(float) * BIN, bins["no"].to_numpy(float), bins["yes"].to_numpy(float))
        columns[f"{t}_own"] = _sigmoid(F.col(f"{t}_evidence") * a + b)
        priors.append((a, b))
    scored = scored.withColumns(columns)
    share = {t: F.coalesce(F.col(t).cast("double"), F.col(f"{t}_own")) for t in TARGETS}
    paths = staged(scored.groupBy("host", "path").agg(F.count("*").alias("n_path"), *(F.sum(share[t]).alias(f"{t}_path_sum") for t in TARGETS)), "paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), *(F.sum(f"{t}_path_sum").alias(f"{t}_host_sum") for t in TARGETS)), "hosts")
    means = hosts.agg(*(F.coalesce(F.sum(f"{t}_host_sum") / F.sum("n_host"), F.lit(0.5)).alias(t) for t in TARGETS)).first()
    mean = {t: F.lit(float(means[t])) for t in TARGETS}
    ks = hosts.agg(*(_strength(hosts, f"{t}_host_sum", "n_host", mean[t]).alias(t) for t in TARGETS)).first()
    hosts = hosts.withColumns({f"{t}_host": (F.col(f"{t}_host_sum") + mean[t] * float(ks[t] or 1)) / (F.col("n_host") + float(ks[t] or 1)) for t in TARGETS})
    sites = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    kp = sites.agg(*(_strength(sites, f"{t}_path_sum", "n_path", F.col(f"{t}_host")).alias(t) for t in TARGETS)).first()
    sites = small(staged(sites.select("host", "path", "n_path", *(c for t in TARGETS for c in (f"{t}_host", f"{t}_path_sum"))), "sites"))
    out = scored.join(sites.withColumnsRenamed({"host": "h", "path": "p"}), scored["host"].eqNullSafe(F.col("h")) & scored["path"].eqNullSafe(F.col("p")))
    for t, (a, b) in zip(TARGETS, priors, strict=True):
        k = float(kp[t] or 1)
        site = (F.col(f"{t}_path_sum") - share[t] + F.col(f"{t}_host") * k) / (F.col("n_path") - 1 + k)
        posterior = _sigmoid(F.col(f"{t}_evidence") * a + b - _logit(mean[t]) + _logit(site))
        out = out.withColumns({f"{t}_path": site, f"p_{t}": posterior})
    keep = (F.col("p_quality") >= 0.5) & (F.col("p_toxic") <= 0.5)
    return out.select("doc_id", "host", "path", "quality_evidence", "toxic_evidence", "quality_host", "toxic_host", "quality_path", "toxic_path", "p_quality", "p_toxic", (F.col("p_toxic") > 0.5).alias("toxic"), keep.alias("keep"))
