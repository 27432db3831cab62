"""Filters of any size and resampling to any size, in whole numbers, so that results repeat to the bit.

A filter works on lines: an image's row, then its column, as one array each, so a kernel of
any width costs no shuffle beyond one per direction.  Resampling meets a table of taps, one
row per (source size, target size, target place, source place), which depends on sizes only:
pixels join their taps along rows, then along columns.  Tap tables are broadcast only when
their counted rows are few.

Images are dense grids (image_id, y, x, values).  A null value stays null and takes its
neighbours with it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import small
from .masks import KEY

#: One in the fixed point of filters and of resampling taps.
ONE, TAP_ONE = 1 << 16, 1 << 22


def gaussian_taps(size: int, sigma: float = 0.0) -> list[int]:
    """A Gaussian of ``size`` taps (odd) in 65536ths; without ``sigma`` its width follows the size."""
    if size < 1 or size % 2 == 0:
        raise ValueError("the number of taps must be odd")
    #: Small kernels.
    fixed = {1: [1], 3: [1, 2, 1], 5: [1, 4, 6, 4, 1], 7: [2, 7, 14, 18, 14, 7, 2]}
    if sigma <= 0 and size in fixed:
        return [w * ONE // sum(fixed[size]) for w in fixed[size]]
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    taps = [round(x / sum(w) * ONE) for x in w]
    taps[size // 2] += ONE - sum(taps)
    return taps


def box_taps(size: int) -> list[int]:
    taps = [ONE // size] * size
    taps[size // 2] += ONE - sum(taps)
    return taps


def _place(k: Column, n: Column, border: str) -> Column:
    """Index ``k`` brought back into 0 .. n - 1, as often as needed."""
    if border == "repeat":
        return F.greatest(F.lit(0), F.least(n - 1, k))
    period = F.greatest(F.lit(1), (n - 1) * 2)
    return F.when(n == 1, 0).otherwise(F.least(F.pmod(k, period), period - F.pmod(k, period)))


def _along(pixels: DataFrame, line: str, pos: str, value: str, taps: list[int], border: str) -> DataFrame:
    lines = pixels.groupBy("image_id", line).agg(F.array_sort(F.collect_list(F.struct(pos, value))).alias("l")).select("image_id", line, F.col(f"l.{pos}").alias("at"), F.col(f"l.{value}").alias("v"))
    n, reach = F.size("v"), len(taps) // 2

    def total(i: Column) -> Column:
        parts = [F.get("v", _place(i + (k - reach), n, border)).cast("long") * w for k, w in enumerate(taps) if w]
        return sum(parts[1:], parts[0])

    out = F.transform("at", lambda at, i: F.struct(at.alias(pos), total(i).alias(value)))
    return lines.select("image_id", line, F.explode(out).alias("o")).select("image_id", line, f"o.{pos}", f"o.{value}")


def separable(pixels: DataFrame, taps: list[int], value: str = "g", border: str = "mirror") -> DataFrame:
    """(.., value) filtered by ``taps`` both ways and rounded; borders are mirrored, or repeat the last pixel."""
    both = _along(_along(pixels, "y", "x", value, taps, border), "x", "y", value, taps, border)
    return both.select(*KEY, F.shiftright(F.col(value) + (1 << 31), 32).cast("int").alias(value))


def blur(gray: DataFrame, size: int, sigma: float = 0.0) -> DataFrame:
    return separable(gray, gaussian_taps(size, sigma))


def adaptive_threshold(gray: DataFrame, block: int = 11, offset: int = 3) -> DataFrame:
    """(.., m): pixels at least ``offset`` below their surroundings; blocks are made odd and 3 at least, borders repeat."""
    size = max(3, block | 1)
    around = separable(gray, gaussian_taps(size), border="repeat").withColumnRenamed("g", "around")
    return gray.join(around, KEY).select(*KEY, (F.col("g") <= F.col("around") - offset).alias("m"))


def sampled_sizes(sizes: DataFrame, most_pixels: int) -> DataFrame:
    """Of (image_id, width, height): adds to_width, to_height, scaled down together to ``most_pixels`` at most."""
    from ..sources.rasters import sampled_size

    to = sampled_size(F.col("width"), F.col("height"), most_pixels)
    return sizes.select("image_id", "width", "height", to["width"].alias("to_width"), to["height"].alias("to_height"))


def sizes_of(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def lanczos_taps(pairs: DataFrame, lobes: int = 3) -> DataFrame:
    """(src, dst, t, s, w): taps of a Lanczos window that is widened where an image shrinks, in 2**22ths."""
    p = pairs.withColumn("t", F.explode(F.expr("sequence(0, dst - 1)")))
    scale = F.col("src") / F.col("dst")
    p = p.withColumn("wide", F.greatest(F.lit(1.0), scale)).withColumn("centre", (F.col("t") + 0.5) * scale)
    reach = F.col("wide") * lobes
    low, high = F.greatest(F.lit(0), F.floor(F.col("centre") - reach + 0.5)), F.least(F.col("src").cast("long"), F.floor(F.col("centre") + reach + 0.5))
    p = p.withColumn("s", F.explode(F.sequence(low.cast("int"), high.cast("int") - 1)))
    a = (F.col("s") - F.col("centre") + 0.5) / F.col("wide")
    sinc = lambda v: F.when(v == 0, 1.0).otherwise(F.sin(v * math.pi) / (v * math.pi))
    p = p.withColumn("f", F.when(F.abs(a) < lobes, sinc(a) * sinc(a / lobes)).otherwise(0.0))
    share = F.col("f") / F.sum("f").over(W.partitionBy("src", "dst", "t")) * TAP_ONE
    return p.select("src", "dst", "t", "s", F.when(share < 0, F.ceil(share - 0.5)).otherwise(F.floor(share + 0.5)).cast("long").alias("w"))


def area_taps(pairs: DataFrame) -> DataFrame:
    """(src, dst, t, s, w): how much of source place s lies under target place t, in dst-ths; they sum to src."""
    p = pairs.withColumn("t", F.explode(F.expr("sequence(0, dst - 1)")))
    p = p.withColumn("s", F.explode(F.expr("sequence(cast(t * src div dst as int), cast(((t + 1) * src - 1) div dst as int))")))
    return p.select("src", "dst", "t", "s", F.expr("cast(least((s + 1) * dst, (t + 1) * src) - greatest(s * dst, t * src) as bigint)").alias("w"))


def _resampled(pixels: DataFrame, sizes: DataFrame, line: str, pos: str, src: str, dst: str, values: list[str], taps, finish) -> DataFrame:
    own = sizes.select("image_id", F.col(src).alias("src"), F.col(dst).alias("dst"))
    table, _ = small(taps(own.select("src", "dst").distinct()))
    met = pixels.join(own, "image_id").join(table.withColumnRenamed("s", pos), ["src", "dst", pos])
    out = met.groupBy("image_id", line, "t", "src").agg(*[F.sum(F.col(v) * F.col("w")).alias(v) for v in values])
    return out.select("image_id", line, F.col("t").alias(pos), *[finish(F.col(v), F.col("src")).alias(v) for v in values])


def lanczos(pixels: DataFrame, sizes: DataFrame, values: list[str]) -> DataFrame:
    """8-bit ``values`` brought to the target sizes: along rows, rounded and clipped, then along columns."""
    eight_bits = lambda total, _: F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(total + (TAP_ONE >> 1), 22))).cast("int")
    rows = _resampled(pixels.select(*KEY, *values), sizes, "y", "x", "width", "to_width", values, lanczos_taps, eight_bits)
    return _resampled(rows, sizes, "x", "y", "height", "to_height", values, lanczos_taps, eight_bits).select(*KEY, *values)


def lanczos_rgba(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(.., r, g, b, a) brought to the target sizes; colors are weighed by opacity, as hidden colors must not show."""
    by_alpha = lambda c: F.col(c) * F.col("a") + 128
    weighed = pixels.select(*KEY, *[F.shiftright(F.shiftright(by_alpha(c), 8) + by_alpha(c), 8).cast("int").alias(c) for c in "rgb"], "a")
    out = lanczos(weighed, sizes, ["r", "g", "b", "a"])
    back = lambda c: F.when(F.col("a").isin(0, 255), F.col(c)).otherwise(F.least(F.lit(255), F.floor(F.col(c) * 255 / F.col("a"))).cast("int"))
    return out.select(*KEY, *[back(c).alias(c) for c in "rgb"], "a")


def _by_area(pixels: DataFrame, sizes: DataFrame, values: list[str]) -> DataFrame:
    plain = lambda total, _: total
    rows = _resampled(pixels, sizes, "y", "x", "width", "to_width", values, area_taps, plain)
    return _resampled(rows, sizes, "x", "y", "height", "to_height", values, area_taps, plain).join(sizes.select("image_id", (F.col("width") * F.col("height")).cast("long").alias("all")), "image_id")


def shrink_mask(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """(.., m) at the target sizes: where more than half of the area beneath is on."""
    v = _by_area(mask.select(*KEY, F.col("m").cast("long").alias("v")), sizes, ["v"])
    return v.select(*KEY, (F.col("v") * 2 > F.col("all")).alias("m"))


def averaged(pixels: DataFrame, sizes: DataFrame, values: list[str]) -> DataFrame:
    """(.., values) at the target sizes: means of the area beneath, halves rounded up."""
    v = _by_area(pixels.select(*KEY, *[F.col(c).cast("long").alias(c) for c in values]), sizes, values)
    return v.select(*KEY, *[F.expr(f"cast(({c} * 2 + all) div (all * 2) as int)").alias(c) for c in values])


def within_side(sizes: DataFrame, most: int = 512) -> DataFrame:
    """Of (image_id, width, height): target sizes whose longer side is ``most`` at most."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest("width", "height"))
    to = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * scale)).cast("int")
    return sizes.select("image_id", "width", "height", to("width").alias("to_width"), to("height").alias("to_height"))


def over(layers: DataFrame) -> DataFrame:
    """(.., r, g, b) of layers (.., layer, r, g, b, a), each laid over those of lesser number, on white."""
    grouped = layers.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("layer", "r", "g", "b", "a"))).alias("l"))

    def channel(c: str) -> Column:
        return F.aggregate("l", F.lit(255.0), lambda under, top: under + (top[c] - under) * top["a"] / 255.0)

    return grouped.select(*KEY, *[F.floor(channel(c) + 0.5).cast("int").alias(c) for c in "rgb"])


def shadow(mask: DataFrame, size: int = 9, down: int = 3, right: int = 3, strength: int = 120) -> DataFrame:
    """(.., a): opacity of a mask's soft shadow, moved by whole pixels, as it falls into the image."""
    soft = blur(mask.select(*KEY, (F.col("m").cast("int") * strength).alias("g")), size).select("image_id", (F.col("y") + down).alias("y"), (F.col("x") + right).alias("x"), F.col("g").alias("a"))
    return mask.select(*KEY).join(soft, KEY, "left").select(*KEY, F.coalesce("a", F.lit(0)).alias("a"))


def raised_preview(gray: DataFrame, cut: int = 128) -> DataFrame:
    """(.., r, g, b): what is darker than ``cut`` as a light plate above its shadow on a gray ground."""
    mask = gray.select(*KEY, (F.col("g") < cut).alias("m"))
    flat = lambda k, level, a: mask.select(*KEY, F.lit(k).alias("layer"), *[F.lit(level).alias(c) for c in "rgb"], a.alias("a"))
    ground = flat(0, 226, F.lit(255))
    shade = shadow(mask).select(*KEY, F.lit(1).alias("layer"), *[F.lit(0).alias(c) for c in "rgb"], "a")
    plate = flat(2, 245, F.when(F.col("m"), 255).otherwise(0))
    return over(ground.unionByName(shade).unionByName(plate))
