"""Images as rows of pixels: decoded by Spark's own image source, prepared for a reader by expressions on arrays.

No Python touches a pixel. The arithmetic is that of 8-bit images: whole numbers, cut or rounded as the usual tools do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.perception import let
from .files import crop

#: Side of a prepared image, its margin, and the gray from which on a pixel counts as empty.
SIDE, MARGIN, EMPTY = 512, 1.2, 200
#: Bits of the fixed-point weights of resampling.
BITS = 22


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, data) of the images at ``path`` (S07): bytes by row, blue, green, red (and opacity) or gray; nulls where one can't be decoded."""
    found = spark.read.format("image").load(path).select("image.*")
    there = F.col("nChannels") > 0
    return found.select(F.col("origin").alias("path"), *(F.when(there, F.col(c)).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))))


def byte_values(data: Column) -> Column:
    """The bytes of a binary as numbers, array<int>."""
    return F.when(F.length(data) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.filter(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c)))


def opaque(height: Column, width: Column, channels: Column, data: Column) -> Column:
    """Rows of pixels, array<array<array<int>>> with red, green and blue; what is transparent lies on white."""

    def rows(values: Column) -> Column:
        def pixel(k: Column) -> Column:
            at = lambda c: F.get(values, k * channels + c)
            return F.when(channels == 1, F.array(at(F.lit(0)), at(F.lit(0)), at(F.lit(0)))).otherwise(F.array(at(F.lit(2)), at(F.lit(1)), at(F.lit(0)))), at(F.lit(3))

        def laid(k: Column) -> Column:
            colours, alpha = pixel(k)

            def blend(c: Column) -> Column:
                t = (c * alpha + 255 * (255 - alpha)) * 128 + 16384
                return F.shiftright(F.shiftright(F.shiftright(t, 8) + t, 8), 7)

            return F.when(channels == 4, F.transform(colours, blend)).otherwise(colours)

        return F.transform(F.sequence(F.lit(0), height - 1), lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda c: laid(r * width + c)))

    return F.when((height > 0) & (width > 0), let(byte_values(data), rows))


def stretched(pixels: Column) -> Column:
    """Colours spread from their smallest value to 255, which counts as the largest (opacity has it); an image of one value becomes 0."""

    def spread(least: Column) -> Column:
        step = F.lit(255.0) / (255 - least)
        return F.transform(pixels, lambda r: F.transform(r, lambda p: F.transform(p, lambda v: F.when(least == 255, F.lit(0)).otherwise(F.floor((v - least) * step).cast("int")))))

    return let(F.array_min(F.transform(pixels, lambda r: F.array_min(F.transform(r, lambda p: F.array_min(p))))), spread)


def gray(pixels: Column) -> Column:
    """One value a pixel, array<array<int>>: the first colour counts least, as a reader of blue, green and red takes it."""
    return F.transform(pixels, lambda r: F.transform(r, lambda p: F.shiftright(p[0] * 1868 + p[1] * 9617 + p[2] * 4899 + 8192, 14)))


def enhanced(pixels: Column, around: Column | float, factor: float) -> Column:
    """Values moved away from ``around`` by ``factor``, cut to 0 to 255: contrast around the mean, brightness around 0."""

    def moved(p: Column, base: Column) -> Column:
        x = base.cast("float") + (p - base).cast("float") * F.lit(factor).cast("float")
        return F.greatest(F.least(x, F.lit(255.0).cast("float")), F.lit(0.0).cast("float")).cast("int")

    return let(F.lit(around) if isinstance(around, (int, float)) else around, lambda base: F.transform(pixels, lambda r: F.transform(r, lambda p: moved(p, base))))


def mean_gray(pixels: Column) -> Column:
    """The mean, rounded."""
    return let(F.flatten(pixels), lambda v: F.floor(F.aggregate(v, F.lit(0).cast("long"), lambda a, p: a + p) / F.size(v) + 0.5).cast("int"))


def _weights(size: Column, to: Column) -> Column:
    """For each place of ``to`` the first of the ``size`` old places that count, and their weights in fixed point, array<(start, weights)>."""

    def lanczos(x: Column) -> Column:
        wave = lambda y: F.when(y == 0, F.lit(1.0)).otherwise(F.sin(y * math.pi) / (y * math.pi))
        return F.when((x < -3) | (x >= 3), F.lit(0.0)).otherwise(wave(x) * wave(x / 3))

    scale = size / to
    wide = F.greatest(scale, F.lit(1.0))

    def at(k: Column) -> Column:
        center = (k + 0.5) * scale
        first = F.greatest((center - wide * 3 + 0.5).cast("int"), F.lit(0))
        stop = F.least((center + wide * 3 + 0.5).cast("int"), size.cast("int"))
        raw = F.transform(F.sequence(first, stop - 1), lambda x: lanczos((x - center + 0.5) / wide))
        whole = let(raw, lambda w: let(F.aggregate(w, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(w, lambda v: (v / total * (1 << BITS) + F.when(v < 0, -0.5).otherwise(0.5)).cast("long"))))
        return F.struct(first.alias("start"), whole.alias("weights"))

    return F.transform(F.sequence(F.lit(0), to.cast("int") - 1), at)


def resized(pixels: Column, height: Column, width: Column) -> Column:
    """A gray image resampled to ``height`` and ``width`` by windows of three lobes, columns first, in 8-bit fixed point."""
    clip = lambda s: F.greatest(F.least(F.shiftright(s, BITS), F.lit(255).cast("long")), F.lit(0).cast("long")).cast("int")
    half = F.lit(1 << (BITS - 1)).cast("long")

    def across(columns: Column) -> Column:
        return F.transform(pixels, lambda r: F.transform(columns, lambda c: clip(F.aggregate(F.zip_with(F.slice(r, c["start"] + 1, F.size(c["weights"])), c["weights"], lambda p, w: p * w), half, lambda a, b: a + b))))

    def down(rows: Column, places: Column) -> Column:
        def line(c: Column) -> Column:
            weighted = F.zip_with(F.slice(rows, c["start"] + 1, F.size(c["weights"])), c["weights"], lambda r, w: F.transform(r, lambda p: p * w))
            return F.transform(F.aggregate(weighted, F.transform(F.get(rows, F.lit(0)), lambda _: half), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)), clip)

        return F.transform(places, line)

    def both(rows: Column) -> Column:
        return let(_weights(F.size(pixels), height), lambda places: down(rows, places))

    return let(let(_weights(F.size(F.get(pixels, F.lit(0))), width), across), both)


def fitted(pixels: Column, side: int = SIDE) -> Column:
    """An image smaller than ``side`` in both directions enlarged so that its longer one has it; others as they are."""

    def scaled(size: Column) -> Column:
        ratio = F.lit(float(side)) / F.greatest(size["h"], size["w"])
        small = (size["h"] < side) & (size["w"] < side)
        return F.when(small, resized(pixels, F.greatest((size["h"].cast("double") * ratio).cast("int"), F.lit(1)), F.greatest((size["w"].cast("double") * ratio).cast("int"), F.lit(1)))).otherwise(pixels)

    return let(F.struct(F.size(pixels).alias("h"), F.size(F.get(pixels, F.lit(0))).alias("w")), scaled)


def trimmed(pixels: Column, empty: int = EMPTY) -> Column:
    """Without rows and columns at the rim that hold nothing darker than ``empty`` (F15); an image without anything stays."""
    used = lambda line: F.exists(line, lambda p: p <= empty)
    rows = F.filter(F.transform(pixels, lambda r, i: F.when(used(r), i)), lambda i: i.isNotNull())
    columns = F.flatten(F.transform(pixels, lambda r: F.filter(F.transform(r, lambda p, j: F.when(p <= empty, j)), lambda j: j.isNotNull())))
    bounds = F.struct(F.array_min(rows).alias("top"), F.array_max(rows).alias("bottom"), F.array_min(columns).alias("left"), F.array_max(columns).alias("right"))
    return let(bounds, lambda b: F.when(b["top"].isNotNull(), crop(pixels, b)).otherwise(pixels))


def squared(pixels: Column, margin: float = MARGIN, least: int = SIDE) -> Column:
    """In the middle of a white square, ``margin`` times as wide as the longer side, ``least`` wide at least."""

    def laid(size: Column) -> Column:
        side = F.greatest((F.lit(margin) * F.greatest(size["h"], size["w"])).cast("int"), F.lit(least))
        top, left = ((side - size["h"]) / 2).cast("int"), ((side - size["w"]) / 2).cast("int")
        white = lambda n: F.array_repeat(F.lit(255), n)
        row = lambda r: F.concat(white(left), r, white(side - left - size["w"]))
        return F.concat(F.array_repeat(white(side), top), F.transform(pixels, row), F.array_repeat(white(side), side - top - size["h"]))

    return let(F.struct(F.size(pixels).alias("h"), F.size(F.get(pixels, F.lit(0))).alias("w")), laid)


def prepared(df: DataFrame, name: str = "pixels", side: int = SIDE) -> DataFrame:
    """``df`` (height, width, channels, data) with the gray pixels that a structure reader gets (F15); null where there is no image.

    On white, colours stretched, gray, contrast 1.8, enlarged to ``side``, trimmed, in a white square of 1.2 times its longer side, brightness 1.6. The
    reader's own last step, resampling to its input and scaling to its numbers, is the model's.
    """
    steps = [
        opaque(*(F.col(c) for c in ("height", "width", "channels", "data"))), stretched(F.col(name)), gray(F.col(name)), enhanced(F.col(name), mean_gray(F.col(name)), 1.8),
        fitted(F.col(name), side), trimmed(F.col(name)), squared(F.col(name), MARGIN, side), enhanced(F.col(name), 0, 1.6),
    ]
    out = df.withColumn(name, steps[0])
    for step in steps[1:]:
        out = out.withColumn(name, F.when(F.col(name).isNotNull(), step))
    return out
