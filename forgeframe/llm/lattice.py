"""Near-duplicate vectors by lattice hashing.

A unit vector is projected at random to a few times eight dimensions and each eight are decoded to the
nearest point of the lattice E8, whose 240 shortest vectors lead to the neighbouring cells. A vector's home
cell in a table is the point found, its probes are the neighbours that it lies nearest to; two vectors
are candidates if one's home is a home or probe of the other. All links are confirmed by cosine.

Dense groups cost no pairs. Vectors within half the linked angle of one centre are all linked with each
other, by the triangle inequality of angles, so they form a group that is counted and never compared. What
meets in a cell are groups: their centres decide most pairs, and members are compared, in blocks inside
tasks, only where neither all nor none can be linked.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, map_cells
from .graph import components
from .lsh import small
from .storage import release, staged, with_row_ids
from .textops import U64, list_array, mix

#: Tables, lattice points of a table's cell, neighbouring cells probed, and the length, in units of the lattice, that the
#: difference of two vectors just at the threshold has in eight dimensions. A pair at a cosine of 0.93 meets with
#: a probability of 0.999 (a test measures it); of a million unlike vectors about 1,300 meet a given one.
TABLES, POINTS, PROBES, SPREAD = 16, 2, 2, 0.5
#: Groups, or members of a group, that one task compares with as many others; values that one pass holds.
BLOCK, PASS = 1024, 1 << 20
#: Angles that bounds leave to exact comparison, in radians.
SLACK = 1e-7


@cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(found)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where rounding gives an odd one, the worst coordinate goes the other way."""
    out = np.rint(x)
    left = x - out
    odd = np.flatnonzero(out.sum(1).astype(np.int64) & 1)
    worst = np.abs(left[odd]).argmax(1)
    out[odd, worst] += np.where(left[odd, worst] >= 0, 1.0, -1.0)
    return out


def decoded(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of the even integer points and those shifted by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


class Lattice:
    """The cells of unit vectors of ``dim`` components in all tables."""

    def __init__(self, dim: int, least: float, tables: int, points: int, probes: int):
        rng = np.random.default_rng([11, dim])
        wide = 8 * points
        apart = max(math.sqrt(max(0.0, 2 - 2 * least)), 1e-3)
        maps = []
        for _ in range(tables):
            random = rng.normal(size=(dim, wide))
            maps.append(np.linalg.qr(random)[0] * math.sqrt(dim) if wide <= dim else random)
        self.maps = np.concatenate(maps, axis=1) * (SPREAD / (apart * math.sqrt(8)))
        self.shift = rng.uniform(0, 2, size=tables * wide)
        self.tables, self.points, self.probes = tables, points, probes
        # A cell's key is a scrambled weighted sum of its coordinates (doubled: whole numbers), so a neighbour's is one addition away.
        self.weights = rng.integers(0, 1 << 63, size=(points, 8)).astype(U64) * U64(2) + U64(1)
        steps = (2 * roots()).astype(np.int64).view(U64)
        self.steps = np.concatenate([(steps * w).sum(1, dtype=U64) for w in self.weights])
        self.salts = rng.integers(0, 1 << 63, size=tables).astype(U64)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(homes, probes): a key for each row and table, and PROBES for each."""
        homes, probes = [], []
        rows = max(1, PASS // (self.tables * self.points * 240))
        for at in range(0, len(unit), rows):
            x = (unit[at : at + rows] @ self.maps + self.shift).reshape(-1, 8)
            home = decoded(x)
            sums = ((2 * home).astype(np.int64).view(U64).reshape(-1, self.points, 8) * self.weights).sum((1, 2), dtype=U64)
            sums += np.tile(self.salts, len(sums) // self.tables)
            homes.append(mix(sums).reshape(-1, self.tables))
            toward = ((x - home) @ roots().T).reshape(len(sums), -1)
            nearest = np.argpartition(-toward, self.probes - 1, axis=1)[:, : self.probes] if self.probes else np.zeros((len(sums), 0), np.int64)
            probes.append(mix(sums[:, None] + self.steps[nearest]).reshape(-1, self.tables * self.probes))
        return np.concatenate(homes), np.concatenate(probes)


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components, offsets, which rows are vectors): rows scaled to length one, in double precision; others are empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    of = np.r_[0, np.cumsum(sizes)]
    out, fine = np.zeros(len(values)), np.zeros(len(sizes), bool)
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        x = values[of[rows][:, None] + np.arange(n)]
        most = np.abs(x).max(1)
        good = np.isfinite(most) & (most > 0)
        x = x[good] / most[good, None]
        x /= np.sqrt((x * x).sum(1))[:, None]
        out[(of[rows[good]][:, None] + np.arange(n)).ravel()] = (x + 0.0).ravel()
        fine[rows[good]] = True
    return out, of, fine


def _hashed(least: float, tables: int, points: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Lattice] = {}
        for batch in batches:
            flat, of, fine = units(batch.column("embedding"))
            sizes = np.diff(of)
            for n in np.unique(sizes[fine]).tolist():
                if n not in held:
                    held[n] = Lattice(n, least, tables, points, probes)
                rows = np.flatnonzero(fine & (sizes == n))
                x = flat[of[rows][:, None] + np.arange(n)]
                home, probe = held[n].cells(x)
                raw = [r.tobytes() for r in x]
                lists = [list_array(k.ravel(), np.arange(len(k) + 1) * k.shape[1]) for k in (home, probe)]
                whole = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
                picked = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [picked.column("row"), picked.column("label"), pa.array(np.full(len(rows), n, np.int32)), pa.array(whole, pa.binary()), pa.array(raw, pa.binary()), *lists],
                    names=["row", "label", "dim", "whole", "unit", "homes", "probes"],
                )

    return run


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, leader, cosine) of rows (id, leader, dim, unit, centre)."""
    for batch in batches:
        out, dims = np.zeros(batch.num_rows), batch.column("dim").to_numpy()
        for n in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == n)
            part = batch.take(pa.array(rows))
            out[rows] = (_stack(part.column("unit"), n) * _stack(part.column("centre"), n)).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("leader"), pa.array(out)], names=["id", "leader", "cosine"])


def _near_centres(angle: float):
    """Pairs of groups of a cell of which members may be linked, as (a, b, cosine) of their centres."""

    def run(rows: pa.Table, of: np.ndarray) -> Iterator[pa.RecordBatch]:
        group, home, block, radius, dims = (rows.column(c).to_numpy() for c in ("group", "home", "block", "radius", "dim"))
        low, high = (rows.column(c).to_numpy() for c in ("low", "high"))
        unit, sizes = rows.column("unit").combine_chunks(), np.diff(of)
        for n, m in sorted(set(zip(dims[of[:-1]].tolist(), sizes.tolist(), strict=True))):
            if m < 2:
                continue
            cells = of[:-1][(sizes == m) & (dims[of[:-1]] == n)]
            step = max(1, PASS // (m * max(m, n)))
            for at in range(0, len(cells), step):
                pick = cells[at : at + step][:, None] + np.arange(m)
                x = _stack(unit.take(pa.array(pick.ravel())), n).reshape(-1, m, n)
                cosine = np.clip(x @ x.transpose(0, 2, 1), -1, 1)
                reach = angle + radius[pick][:, :, None] + radius[pick][:, None, :] + SLACK
                near = (cosine >= np.cos(np.minimum(reach, math.pi))) & (home[pick][:, :, None] | home[pick][:, None, :]) & (group[pick][:, :, None] < group[pick][:, None, :])
                near &= (low[pick] == high[pick])[:, :, None] | (block[pick][:, :, None] != block[pick][:, None, :])
                c, i, j = np.nonzero(near)
                if len(c):
                    yield pa.RecordBatch.from_arrays([pa.array(group[pick[c, i]]), pa.array(group[pick[c, j]]), pa.array(cosine[c, i, j])], names=["a", "b", "cosine"])

    return run


def _linked_members(least: float):
    """Of two blocks of members: (id, n) links of each, and one row (first of a, first of b) marked as an edge, if any."""

    def run(rows: pa.Table, of: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, copies, left, first, dims = (rows.column(c).to_numpy() for c in ("id", "copies", "left", "first", "dim"))
        unit = rows.column("unit").combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s, e in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
            x, mine = _stack(unit.slice(s, e - s), int(dims[s])), left[s:e]
            hit = x[mine] @ x[~mine].T >= least
            if not hit.any():
                continue
            a, b = np.flatnonzero(mine) + s, np.flatnonzero(~mine) + s
            for who, n in ((a, hit @ copies[b]), (b, copies[a] @ hit)):
                out.append((ids[who][n > 0], n[n > 0], np.full((n > 0).sum(), -1)))
            out.append((first[a[:1]], np.zeros(1, np.int64), first[b[:1]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["id", "n", "edge"])

    return run


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.93, tables: int = TABLES, points: int = POINTS, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Two vectors of one label link if their cosine, in double precision, is at least ``least``; none below
    it do. ``n_links`` counts the other rows linked directly, copies included; component_id is the smallest vec_id
    reachable, and only it is kept. Vectors that are null, empty, all zero, or hold a null or non-finite
    component, rows of null label, and rows of null vec_id (kept, without component) link with nothing; nor do vectors of
    different lengths. Rows that repeat a vec_id are vectors of their own. Other columns are ignored. Empty table: no rows.

    More ``points`` a cell suit more vectors a label (fewer chance meetings), with more ``tables`` to keep
    the recall. Rows of one vector are one item with a count. Each vector's centre is, of the
    first vectors by hash of its home cells, the first one within half the linked angle: members of
    a group are all linked. A cell of m groups costs m*m/2 products inside tasks of BLOCK rows; only pairs
    that may hold a link leave a task. Members of two groups meet, in blocks, if the centres' angle and radii
    leave it open, without those that are too far by their angle to the own centre. So copies and tight groups of any
    size cost one pass; a loose group of m vectors, all near the threshold, costs the m*m/2 products that
    counting its links takes.
    """
    angle = math.acos(least)
    numbered = with_row_ids(vectors.select(F.col("vec_id").alias("doc_id"), "embedding", "label"), "row")
    slim = numbered.select(F.col("doc_id").alias("vec_id"), "row")
    fine = numbered.where("doc_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null)")
    hashed = map_batches(fine.select("row", "label", "embedding"), _hashed(least, tables, points, probes), f"row long, label {numbered.schema['label'].dataType.simpleString()}, dim int, whole binary, unit binary, homes array<long>, probes array<long>")
    hashed = staged(hashed, "cells")
    same = ["label", "dim", "whole"]
    classes = staged(hashed.groupBy(*same).agg(F.min("row").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "classes")
    reps = hashed.select("row", *same).join(small(classes), same, "left").select("row", F.coalesce("rep", "row").alias("id"), F.coalesce("copies", F.lit(1)).alias("copies"))
    reps = staged(reps, "copies")
    items = staged(hashed.withColumnRenamed("row", "id").join(small(classes.select(F.col("rep").alias("id"), "copies")), "id", "left").join(small(classes.select(*same, "rep")), same, "left").where("rep is null or rep = id").select("id", "label", "dim", "unit", "homes", "probes", F.coalesce("copies", F.lit(1)).alias("copies")), "items")
    release(hashed)

    # Groups: members within half the angle of a centre.
    cell = ["label", "dim", "nth", "key"]
    at_home = items.select("id", "label", "dim", F.posexplode("homes").alias("nth", "key"))
    leaders = staged(at_home.groupBy(*cell).agg(F.min(F.struct(F.xxhash64("id"), "id"))["id"].alias("leader"), F.count("*").alias("m")).where("m > 1").drop("m"), "leaders")
    under = staged(at_home.join(small(leaders), cell).where("id <> leader").select("id", "leader").distinct(), "under")
    centres = staged(items.join(small(under.select(F.col("leader").alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias("leader"), F.col("unit").alias("centre")), "centres")
    both = under.join(items.select("id", "dim", "unit"), "id").join(small(centres), "leader").select("id", "leader", "dim", "unit", "centre")
    close = map_batches(both, _cosines, "id long, leader long, cosine double").where(F.col("cosine") >= math.cos(angle / 2 - SLACK) if angle > 4 * SLACK else F.lit(False))
    led = close.groupBy("id").agg(F.min(F.struct(F.xxhash64("leader"), "leader", "cosine")).alias("by")).select("id", "by.leader", "by.cosine")
    members = items.select("id", "dim", "copies").join(led, "id", "left")
    members = staged(members.select("id", "dim", "copies", F.coalesce("leader", "id").alias("group"), F.coalesce(F.acos(F.least("cosine", F.lit(1.0))), F.lit(0.0)).alias("angle")), "members")
    groups = staged(members.groupBy("group").agg(F.max("angle").alias("radius"), F.sum("copies").alias("size"), F.count("*").alias("members"), F.min("id").alias("first")), "groups")
    release(leaders, under, centres)

    # Groups that meet in a cell, and whose centres allow a link.
    def of_kind(column: str, per: int, home: bool) -> DataFrame:
        keys = items.join(members.select("id", "group"), "id").select("group", "label", "dim", F.posexplode(column).alias("place", "key"))
        return keys.select("group", "label", "dim", F.expr(f"place div {max(per, 1)}").cast("int").alias("nth"), "key", F.lit(home).alias("home"))

    entries = staged(of_kind("homes", 1, True).union(of_kind("probes", probes, False)).groupBy(*cell, "group").agg(F.max("home").alias("home")), "entries")
    meeting = staged(entries.groupBy(*cell).agg(F.count("*").alias("m"), F.max("home").alias("any")).where("m > 1 and any").drop("any"), "meeting")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    met = entries.join(small(meeting), cell).withColumn("block", F.pmod(F.xxhash64("group"), blocks).cast("int")).withColumn("next", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.withColumns({"low": F.least("block", "next"), "high": F.greatest("block", "next")}).withColumn("cell", F.xxhash64(*cell, "low", "high"))
    centre = items.select(F.col("id").alias("group"), "unit").join(groups.select("group", "radius"), "group")
    met = met.join(centre, "group").select("cell", "dim", "group", "home", "block", "low", "high", "radius", "unit")
    near = map_cells(met, _near_centres(angle), "a long, b long, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    near = staged(near, "near")
    release(entries, meeting)

    # All, none or some of two groups' members are linked.
    facts = [small(groups.select(*(F.col(c).alias(f"{c}_{side}") if c != "group" else F.col(c).alias(side) for c in groups.columns))) for side in "ab"]
    pairs = near.join(facts[0], "a").join(facts[1], "b").withColumn("apart", F.acos(F.least("cosine", F.lit(1.0))))
    single = F.col("members_a") + F.col("members_b") == 2
    all_linked = (single & (F.col("cosine") >= least)) | (F.col("apart") + F.col("radius_a") + F.col("radius_b") <= angle - SLACK)
    pairs = staged(pairs.withColumn("sure", all_linked).where(F.col("sure") | ~single), "pairs")
    sure = pairs.where("sure")
    from_groups = sure.select(F.col("a").alias("group"), F.col("size_b").alias("n")).union(sure.select("b", "size_a")).groupBy("group").agg(F.sum("n").alias("n_sure"))
    open_pairs = pairs.where("not sure").select("a", "b", "apart", "radius_a", "radius_b", "first_a", "first_b", F.ceil(F.col("members_a") / BLOCK).cast("int").alias("blocks_a"), F.ceil(F.col("members_b") / BLOCK).cast("int").alias("blocks_b"))

    def side(own: str, other: str) -> DataFrame:
        far = F.col("angle") < F.col("apart") - angle - F.col(f"radius_{other}") - SLACK
        rows = open_pairs.join(members.withColumnRenamed("group", own), own).where(~far)
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col(f"blocks_{own}")).cast("int")).withColumn("next", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{other}") - 1)))
        place = ("block", "next") if own == "a" else ("next", "block")
        return rows.select(F.xxhash64("a", "b", *place).alias("cell"), "dim", "id", "copies", F.lit(own == "a").alias("left"), F.col(f"first_{own}").alias("first"))

    met = side("a", "b").union(side("b", "a")).join(items.select("id", "unit"), "id").select("cell", "dim", "id", "copies", "left", "first", "unit")
    some = staged(map_cells(met, _linked_members(least), "id long, n long, edge long"), "some")
    edges = sure.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")).union(some.where("edge >= 0").select("id", "edge").distinct())
    found = components(edges)

    # Rows.
    roots_of = groups.join(small(found.withColumnRenamed("id", "first")), "first", "left").withColumn("root", F.coalesce("root", "first")).join(from_groups, "group", "left")
    roots_of = roots_of.select("group", "root", (F.col("size") - 1 + F.coalesce("n_sure", F.lit(0))).alias("n_group"))
    named = staged(roots_of.join(slim.select(F.col("vec_id").alias("component_id"), F.col("row").alias("root")), "root"), "roots")
    of_members = some.where("edge < 0").groupBy("id").agg(F.sum("n").alias("n_some"))
    each = members.select("id", "group").join(of_members, "id", "left").join(small(named), "group").select("id", "component_id", (F.col("n_group") + F.coalesce("n_some", F.lit(0))).alias("n_links"))
    each = staged(each, "each")
    out = slim.join(reps.select("row", "id"), "row", "left").join(small(each), "id", "left")
    component = F.coalesce("component_id", "vec_id")
    out = staged(out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")), "vectors")
    release(classes, reps, items, members, groups, near, pairs, some, found, named, each)
    return out
