"""A variational autoencoder of rows of numbers, trained by the tasks that hold them; new rows from its decoder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one replica of the network takes in an epoch; rows that are generated together.
SHARD, TOGETHER = 1 << 14, 1 << 12
#: Tasks whose replicas come to the driver one by one; beyond, others average them first.
NEAR = 64

State = dict[str, np.ndarray]


def shapes(width: int, latent: int, hidden: int) -> list[tuple[int, int]]:
    """Encoder (two layers, then means and log variances side by side), and decoder."""
    return [(width, hidden), (hidden, hidden // 2), (hidden // 2, 2 * latent), (latent, hidden // 2), (hidden // 2, hidden), (hidden, width)]


def layers(flat: np.ndarray, sizes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of weights and biases in a flat array."""
    at, found = 0, []
    for a, b in sizes:
        found.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return found


def initial(sizes: list[tuple[int, int]], seed: int) -> State:
    """Weights and biases uniform within one over the root of a layer's inputs; moments of Adam at 0."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate([rng.uniform(-1, 1, a * b + b) / np.sqrt(a) for a, b in sizes]).astype(np.float32)
    return {"weights": flat, "first": np.zeros_like(flat), "second": np.zeros_like(flat)}


def decoded(z: np.ndarray, net: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """What the decoder's layers give for places of the latent space; the last are rows within 0 to 1."""
    out = [z]
    for w, b in net[3:5]:
        out.append(np.maximum(out[-1] @ w + b, 0))
    w, b = net[5]
    return [*out, 1 / (1 + np.exp(-(out[-1] @ w + b)))]


def gradient(x: np.ndarray, noise: np.ndarray, net: list, grads: list) -> float:
    """The loss of some rows (squared errors of the rows rebuilt, and the divergence of their latent places from the normal, both summed); its gradient goes into ``grads``."""
    out = [x]
    for w, b in net[:2]:
        h = out[-1] @ w
        h += b
        out.append(np.maximum(h, 0, out=h))
    both = out[2] @ net[2][0] + net[2][1]
    mu, log = both[:, : noise.shape[1]], both[:, noise.shape[1] :]
    std = np.exp(0.5 * log)
    variance = std * std
    spread = noise * std
    back = decoded(mu + spread, net)
    off = back[3] - x
    loss = float((off * off).sum()) - 0.5 * float((1 + log - mu * mu - variance).sum())

    delta = 2 * off * back[3] * (1 - back[3])
    for k, given in ((5, back[2]), (4, back[1]), (3, back[0])):
        np.matmul(given.T, delta, out=grads[k][0])
        delta.sum(axis=0, out=grads[k][1])
        delta = delta @ net[k][0].T
        if k > 3:
            delta *= given > 0
    delta = np.concatenate([delta + mu, 0.5 * (delta * spread + variance - 1)], axis=1)
    for k, given in ((2, out[2]), (1, out[1]), (0, out[0])):
        np.matmul(given.T, delta, out=grads[k][0])
        delta.sum(axis=0, out=grads[k][1])
        if k:
            delta = delta @ net[k][0].T
            delta *= given > 0
    return loss


def trained(x: np.ndarray, state: State, sizes: list[tuple[int, int]], latent: int, epochs: range, batch: int, rate: float, seed: int, shard: int, steps: int) -> tuple[State, float, int]:
    """The state after so many epochs of Adam over shuffled batches, the loss of the last, and the steps taken until then."""
    state = {k: v.copy() for k, v in state.items()}
    weights, first, second = state["weights"], state["first"], state["second"]
    slope, part = np.zeros_like(weights), np.zeros_like(weights)
    net, grads, loss = layers(weights, sizes), layers(slope, sizes), 0.0
    for epoch in epochs:
        rng = np.random.default_rng([seed, epoch, shard])
        rows, noise, loss = x[rng.permutation(len(x))], rng.standard_normal((len(x), latent), dtype=np.float32), 0.0
        for at in range(0, len(x), batch):
            loss += gradient(rows[at : at + batch], noise[at : at + batch], net, grads)
            steps += 1
            first *= np.float32(0.9)
            np.multiply(slope, np.float32(0.1), out=part)
            first += part
            second *= np.float32(0.999)
            slope *= slope
            slope *= np.float32(0.001)
            second += slope
            np.sqrt(second, out=part)
            part *= np.float32(1 / np.sqrt(1 - 0.999**steps))
            part += np.float32(1e-8)
            np.divide(first, part, out=part)
            part *= np.float32(rate / (1 - 0.9**steps))
            weights -= part
    return state, loss, steps


def _shards(df: DataFrame, columns: list[str], n: int, low: np.ndarray, span: np.ndarray) -> tuple[DataFrame, int, int]:
    """(a row a shard with its scaled rows as bytes, how many shards, in how many tasks).

    Rows are dealt by hash, copies of one row to shards one after another, and lie in order: whatever the files, shards are the same.
    """
    shards = -(-n // SHARD)
    tasks = shards if shards <= NEAR else max(NEAR, shards // 4)
    copies = df.groupBy(*columns).agg(F.count("*").alias("n\x00"))
    copies = copies.withColumn("i\x00", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n\x00"), F.lit(shards)) - 1)))
    share = F.floor(F.col("n\x00") / shards) + (F.col("i\x00") < F.col("n\x00") % shards).cast("long")
    dealt = copies.select(*(F.col(c).alias(f"x{j}") for j, c in enumerate(columns)), share.alias("share"), F.pmod(F.pmod(F.xxhash64(*columns), F.lit(shards)) + F.col("i\x00"), F.lit(shards)).cast("int").alias("shard"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = list(batches)
        if not sum(b.num_rows for b in known):
            return
        table = pa.Table.from_batches(known)
        shard, share = table.column("shard").to_numpy(), table.column("share").to_numpy()
        x = np.stack([table.column(f"x{j}").to_numpy() for j in range(len(columns))], axis=1)
        order = np.lexsort((*x.T, shard))
        shard, share, x = shard[order], share[order], ((x[order] - low) / span).astype(np.float32)
        for k in np.unique(shard):
            mine = slice(*np.searchsorted(shard, [k, k + 1]))
            yield pa.record_batch({"shard": pa.array([k], pa.int32()), "data": pa.array([np.repeat(x[mine], share[mine], axis=0).tobytes()], pa.binary())})

    return dealt.repartitionById(tasks, F.col("shard") % tasks).mapInArrow(pack, "shard int, data binary"), shards, tasks


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of replicas, added."""
    total, facts = None, np.zeros(2)
    for batch in batches:
        for rows, loss, data in zip(*(batch.column(k).to_pylist() for k in ("rows", "loss", "state")), strict=True):
            facts += rows, loss
            total = np.frombuffer(data) if total is None else total + np.frombuffer(data)
    if total is not None:
        yield pa.record_batch({"part": pa.array([0], pa.int32()), "rows": pa.array([int(facts[0])]), "loss": pa.array([facts[1]]), "state": pa.array([total.tobytes()], pa.binary())})


SUMS = "part int, rows long, loss double, state binary"


def _epoch(packed: DataFrame, tasks: int, state: State, epochs: range, width: int, steps: int, **how) -> tuple[State, float]:
    """One round: each shard trains a replica, and replicas and their moments are averaged by their rows."""
    names = list(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, losses, part = None, 0, 0.0, 0
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = np.frombuffer(data, np.float32).reshape(-1, width)
                new, loss, _ = trained(x, state, epochs=epochs, shard=shard, steps=steps, **how)
                one = np.concatenate([new[k] for k in names]).astype(float) * len(x)
                total, rows, losses, part = one if total is None else total + one, rows + len(x), losses + loss, shard
        if total is not None:
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "rows": pa.array([rows]), "loss": pa.array([losses]), "state": pa.array([total.tobytes()], pa.binary())})

    sums = packed.mapInArrow(run, SUMS)
    if tasks > NEAR:
        few = int(np.sqrt(tasks))
        sums = sums.repartitionById(few, F.col("part") % few).mapInArrow(_mean, SUMS)
    found = sorted(sums.collect(), key=lambda r: (r.part, r.rows, r.loss))
    rows = sum(r.rows for r in found)
    mean = sum(np.frombuffer(bytes(r.state)) for r in found) / rows
    return dict(zip(names, np.split(mean.astype(np.float32), len(names)), strict=True)), sum(r.loss for r in found) / rows


def autoencoder(df: DataFrame, columns: list[str], n: int, seed: int = 42, latent: int = 16, hidden: int = 128, epochs: int = 100, batch: int = 32, rate: float = 1e-3, history: list[float] | None = None) -> DataFrame:
    """``n`` rows decoded from normal draws by a variational autoencoder of the complete rows.

    Columns are scaled to [0, 1]. The network (``shapes``; rectified layers, a logistic one at the end) is trained by Adam on all rows in each of ``epochs`` epochs, in shuffled
    batches. Up to SHARD rows one task does that step by step. Of more, each shard of about as many rows trains a replica for an epoch, and the replicas' weights and moments are
    averaged before the next: steps of one epoch follow each other only within a shard. ``history`` takes the mean loss of a row in each such round.
    """
    full = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    facts = full.agg(F.count("*"), *(F.min(c) for c in columns), *(F.max(c) for c in columns)).first()
    if not facts[0]:
        raise ValueError("no row is complete")
    low, high = (np.array(part, dtype=float) for part in (facts[1 : len(columns) + 1], facts[len(columns) + 1 :]))
    if not np.isfinite(np.r_[low, high]).all():
        raise ValueError("columns must be finite")
    span = np.where(high > low, high - low, 1.0)
    sizes = shapes(len(columns), latent, hidden)
    state = initial(sizes, seed)
    packed, shards, tasks = _shards(full, columns, facts[0], low, span)
    packed = packed.cache()
    try:
        longest = 0 if shards == 1 else packed.agg(F.max(F.length("data"))).first()[0] // (4 * len(columns))
        for k in range(1 if shards == 1 else epochs):
            turn = range(epochs) if shards == 1 else range(k, k + 1)
            state, loss = _epoch(packed, tasks, state, turn, len(columns), k * -(-longest // batch), sizes=sizes, latent=latent, batch=batch, rate=rate, seed=seed)
            if history is not None:
                history.append(loss)
    finally:
        packed.unpersist()
    weights = state["weights"]

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                z = np.random.default_rng([seed, epochs, shards, k]).standard_normal((min(TOGETHER, n - k * TOGETHER), latent), dtype=np.float32)
                rows = decoded(z, layers(weights, sizes))[-1].astype(float) * span + low
                yield pa.record_batch([pa.array(rows[:, j]) for j in range(len(columns))], names=[f"x{j}" for j in range(len(columns))])

    made = df.sparkSession.range(-(-n // TOGETHER)).mapInArrow(generate, ", ".join(f"x{j} double" for j in range(len(columns))))
    return made.select(*(F.col(f"x{j}").alias(c) for j, c in enumerate(columns)))
