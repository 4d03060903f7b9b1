"""Prepared images pixel for pixel against a plain program; image files are written here, byte by byte."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgeframe.sources import images


def png(pixels):
    """A PNG file of an array (h, w) or (h, w, 3 or 4)."""
    h, w, *c = pixels.shape
    kind = {0: 0, 3: 2, 4: 6}[c[0] if c else 0]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = b"".join(b"\0" + pixels[r].tobytes() for r in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def lanczos(x):
    wave = lambda y: 1.0 if y == 0 else math.sin(y * math.pi) / (y * math.pi)
    return wave(x) * wave(x / 3) if -3 <= x < 3 else 0.0


def weights(size, to):
    scale = size / to
    wide, out = max(scale, 1.0), []
    for k in range(to):
        center = (k + 0.5) * scale
        first, stop = max(int(center - wide * 3 + 0.5), 0), min(int(center + wide * 3 + 0.5), size)
        raw = [lanczos((x - center + 0.5) / wide) for x in range(first, stop)]
        total = sum(raw)
        out.append((first, [int(v / total * 2**22 + (-0.5 if v < 0 else 0.5)) for v in raw]))
    return out


def resized(p, h, w):
    clip = lambda s: max(0, min(255, s >> 22))
    cols, rows = weights(len(p[0]), w), weights(len(p), h)
    mid = [[clip(2**21 + sum(r[a + i] * v for i, v in enumerate(ws))) for a, ws in cols] for r in p]
    return [[clip(2**21 + sum(mid[a + i][j] * v for i, v in enumerate(ws))) for j in range(w)] for a, ws in rows]


def enhanced(p, base, factor):
    return [[int(max(np.float32(0), min(np.float32(255), np.float32(base) + np.float32(v - base) * np.float32(factor)))) for v in r] for r in p]


def prepared(a, side):
    a = np.repeat(a[:, :, None], 3, 2) if a.ndim == 2 else a
    if a.shape[2] == 4:
        t = (a[:, :, :3].astype(int) * a[:, :, 3:] + 255 * (255 - a[:, :, 3:].astype(int))) * 128 + 16384
        a = (((t >> 8) + t) >> 8) >> 7
    a = a.astype(int)
    low = a.min()
    a = np.floor((a - low) * (255.0 / (255 - low))).astype(int) if low < 255 else a * 0
    p = ((a[:, :, 0] * 1868 + a[:, :, 1] * 9617 + a[:, :, 2] * 4899 + 8192) >> 14).tolist()
    p = enhanced(p, int(np.mean(p) + 0.5), 1.8)
    h, w = len(p), len(p[0])
    if h < side and w < side:
        ratio = side / max(h, w)
        p = resized(p, max(1, int(h * ratio)), max(1, int(w * ratio)))
    rows = [i for i, r in enumerate(p) if min(r) <= 200]
    cols = [j for r in p for j, v in enumerate(r) if v <= 200]
    if rows:
        p = [r[min(cols) : max(cols) + 1] for r in p[min(rows) : max(rows) + 1]]
    h, w = len(p), len(p[0])
    n = max(int(1.2 * max(h, w)), side)
    top, left = int((n - h) / 2), int((n - w) / 2)
    out = [[255] * n for _ in range(n)]
    for i, r in enumerate(p):
        out[top + i][left : left + w] = r
    return enhanced(out, 0, 1.6)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = np.random.default_rng(6)
    made = {
        "gray": rng.integers(0, 256, (5, 9), dtype=np.uint8), "rgb": rng.integers(40, 256, (11, 7, 3), dtype=np.uint8), "rgba": rng.integers(0, 256, (8, 8, 4), dtype=np.uint8), "white": np.full((6, 4, 3), 255, np.uint8),
        "wide": rng.integers(0, 256, (3, 40, 3), dtype=np.uint8), "dot": np.zeros((1, 1), np.uint8), "margin": np.pad(rng.integers(0, 90, (4, 6), dtype=np.uint8), 5, constant_values=255), "clear": np.zeros((4, 4, 4), np.uint8),
    }
    folder = tmp_path_factory.mktemp("images")
    for name, a in made.items():
        (folder / f"{name}.png").write_bytes(png(a))
    (folder / "broken.png").write_bytes(b"not an image")
    return folder, made


def test_bytes(spark):
    data = bytes(range(256)) * 2
    df = spark.createDataFrame([(bytearray(data),), (bytearray(b""),), (None,)], "d binary")
    assert [r[0] for r in df.select(images.byte_values(F.col("d"))).collect()] == [list(data), [], None]


@pytest.mark.parametrize("side", [16, 30])
def test_prepared(spark, files, side):
    folder, made = files
    found = images.read_images(spark, str(folder))
    rows = {r.path.rsplit("/", 1)[1][:-4]: r for r in images.prepared(found, side=side).select("path", "height", "width", "channels", "pixels").collect()}
    assert rows.keys() == {*made, "broken"} and rows["broken"].pixels is None and rows["broken"].height is None
    for name, a in made.items():
        assert (rows[name].height, rows[name].width) == a.shape[:2]
        assert rows[name].pixels == prepared(a, side), name


def test_resampling(spark):
    rng = np.random.default_rng(1)
    for h, w, to in ((7, 5, (12, 30)), (40, 23, (9, 4)), (6, 6, (6, 6))):
        p = rng.integers(0, 256, (h, w)).tolist()
        df = spark.createDataFrame([(p,)], "p array<array<int>>")
        assert df.select(images.resized(F.col("p"), F.lit(to[0]), F.lit(to[1]))).first()[0] == resized(p, *to)


def test_squared_vectors_at_whole_numbers(spark, tmp_path):
    """A vector just below a whole number, which single precision reaches: the query's rows are those of its SQL."""
    from forgeframe.plans import catalogue
    from tests.compare import connect, same

    rows = [(k, [0.062499966472387314 if i % 8 == k else 0.01 * i for i in range(64)]) for k in range(3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").toPandas().to_parquet(tmp_path / "embeddings.parquet")
    same(catalogue.queries()["f15_squared_images"](spark, str(tmp_path)), connect(str(tmp_path)), catalogue.oracle_sql()["f15_squared_images"])
