"""Measures of artwork: thresholds, contrast, components, widths, profiles, palettes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import regions
from .masks import KEY
from .neighbourhood import close_open, full_distance


def histogram(gray: DataFrame) -> DataFrame:
    return gray.groupBy("image_id", "g").agg(F.count("*").alias("n"))


def otsu(gray: DataFrame) -> DataFrame:
    """(image_id, cut): the gray value that parts the histogram with the greatest variance between the sides.

    The pixels are counted per value before the windows, so a window sees 256 rows at most.
    """
    w = W.partitionBy("image_id").orderBy("g").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("image_id")
    h = histogram(gray).withColumn("below", F.sum("n").over(w)).withColumn("mass", F.sum(F.col("n") * F.col("g")).over(w))
    h = h.withColumn("all", F.sum("n").over(whole)).withColumn("total", F.sum(F.col("n") * F.col("g")).over(whole)).where("below < all")
    d = F.col("mass") / F.col("below") - (F.col("total") - F.col("mass")) / (F.col("all") - F.col("below"))
    between = F.round(F.col("below") * (F.col("all") - F.col("below")) * d * d, 6)
    best = h.withColumn("between", between).groupBy("image_id").agg(F.max(F.struct("between", (-F.col("g")).alias("less"))).alias("b"))
    return gray.select("image_id").distinct().join(best, "image_id", "left").select("image_id", F.coalesce(-F.col("b.less"), F.lit(0)).alias("cut"))


def basic_silhouette(rgba: DataFrame, gray: Column, least_alpha: int = 128, invert: bool = False, radius: int = 0) -> DataFrame:
    """(image_id, y, x, m): what is more opaque than ``least_alpha`` where an image has transparency, the dark side of its Otsu cut elsewhere.

    A ``radius`` above 0 closes and opens the mask.  Images are told apart by one row each, joined back.
    """
    px = rgba.withColumn("g", gray).select(*KEY, "a", "g")
    kinds = px.groupBy("image_id").agg((F.min("a") < 255).alias("clear")).join(otsu(px.select(*KEY, "g")), "image_id")
    m = F.when(F.col("clear"), F.col("a") > least_alpha).otherwise(F.col("g") <= F.col("cut"))
    mask = px.join(kinds, "image_id").select(*KEY, (~m if invert else m).alias("m"))
    return close_open(mask, radius) if radius else mask


def contrast(gray: DataFrame) -> DataFrame:
    """(image_id, contrast): distance of the 5th and 95th percentiles over 255."""
    p = gray.groupBy("image_id").agg(F.percentile("g", [0.05, 0.95]).alias("p"))
    return p.select("image_id", F.round((F.col("p")[1] - F.col("p")[0]) / 255, 5).alias("contrast"))


def autocontrast(gray: DataFrame, cutoff: float = 0.0, gamma: float = 1.0) -> DataFrame:
    """Gray values stretched to 0 to 255 after ``cutoff`` percent at either end, then a gamma curve."""
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by g)")
    p = gray.groupBy("image_id").agg(at(cutoff / 100).alias("lo"), at(1 - cutoff / 100).alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((F.col("g") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")))))).otherwise(F.col("g").cast("double"))
    v = v if gamma == 1.0 else F.floor(F.lit(255.0) * F.pow(v / 255.0, F.lit(gamma)))
    return gray.join(p, "image_id").select(*KEY, v.cast("int").alias("g"))


def component_counts(mask: DataFrame) -> DataFrame:
    """(image_id, components, significant, small, tiny) by shares of the image's area."""
    size = mask.groupBy("image_id").agg(F.count("*").alias("all"))
    areas = regions.components(mask).groupBy("image_id", "comp").agg(F.count("*").alias("area"))
    tiny, significant = F.greatest(F.lit(6.0), F.col("all") * 0.00025), F.greatest(F.lit(24.0), F.col("all") * 0.002)
    j = size.join(areas, "image_id", "left")
    a = F.col("area")
    return j.groupBy("image_id").agg(F.count("area").alias("components"), F.count_if(a >= significant).alias("significant"), F.count_if((a >= tiny) & (a < significant)).alias("small"), F.count_if(a < tiny).alias("tiny"))


def widths(mask: DataFrame) -> DataFrame:
    """(image_id, narrow, median_width, solid): from the distance of each mask pixel to the outside."""
    d = F.when(F.col("m"), F.round("d", 4))
    out = full_distance(mask).groupBy("image_id").agg(F.avg((d <= 1.5).cast("int")).alias("narrow"), (F.median(d) * 2).alias("median_width"), F.avg((d >= 6).cast("int")).alias("solid"))
    return out.select("image_id", *[F.round(F.coalesce(c, F.lit(0.0)), 5).alias(c) for c in ("narrow", "median_width", "solid")])


def lower_profile(mask: DataFrame) -> DataFrame:
    """(image_id, variation): spread of the lowest mask pixel of each column, over the mask's height."""
    on = mask.where("m")
    tall = on.groupBy("image_id").agg(F.min("y").alias("top"), (F.max("y") - F.min("y") + 1).alias("tall"))
    low = on.groupBy("image_id", "x").agg(F.max("y").alias("low")).join(tall, "image_id")
    return low.groupBy("image_id").agg(F.round(F.stddev_pop((F.col("low") - F.col("top")) / F.col("tall")), 5).alias("variation"))


def top_colors(rgb: DataFrame, count: int = 3) -> DataFrame:
    """(image_id, place, packed, n): the most frequent colors of two bits a channel; ties to the smaller color."""
    from ..functions.color import packed_color

    n = rgb.groupBy("image_id", packed_color(F.col("r"), F.col("g"), F.col("b")).alias("packed")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("n"), "packed"))).where(F.col("place") <= count)


def palette(rgb: DataFrame, label: str = "label") -> DataFrame:
    """(image_id, label, n, share, hex, name, light): mean color of each label."""
    from ..functions import color

    g = rgb.groupBy("image_id", label).agg(F.count("*").alias("n"), *[F.round(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    r, gr, b = F.col("r"), F.col("g"), F.col("b")
    share = F.round(F.col("n") * 100 / F.sum("n").over(W.partitionBy("image_id")), 4)
    return g.select("image_id", label, "n", share.alias("share"), color.hex_color(r, gr, b).alias("hex"), color.color_name(r, gr, b).alias("name"), F.round(color.luminance(r, gr, b), 4).alias("light"))


def _clustered(x: np.ndarray, n: np.ndarray, k: int, seed: int, rounds: int, attempts: int, shift: float) -> np.ndarray:
    """Centres of the cheapest of several runs from spread seeds."""
    best, least = None, np.inf
    for r in map(np.random.default_rng, range(seed, seed + attempts)):
        c = x[r.choice(len(x), p=n / n.sum())][None, :]
        while len(c) < k:
            far = ((x[:, None, :] - c[None]) ** 2).sum(2).min(1) * n
            c = np.vstack([c, x[r.choice(len(x), p=far / far.sum())]])
        for _ in range(rounds):
            near = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
            mass = np.bincount(near, n, k)
            new = np.stack([np.bincount(near, n * x[:, j], k) / np.maximum(mass, 1) for j in range(3)], 1)
            new[mass == 0] = c[mass == 0]
            moved, c = np.abs(new - c).max(), new
            if moved <= shift:
                break
        cost = float((((x[:, None, :] - c[None]) ** 2).sum(2).min(1) * n).sum())
        if cost < least:
            best, least = c, cost
    return best


def kmeans_palette(rgb: DataFrame, colors: int, seed: int = 17, rounds: int = 35, attempts: int = 4, shift: float = 1.0) -> DataFrame:
    """(image_id, r, g, b, n, label, light): a palette for each image, labels by lightness.

    An image with ``colors`` different colors or fewer keeps them as they are.  Colors are
    counted before the shuffle, so a kernel gets one image's counted colors.
    """
    from ..functions.color import luminance

    counted = rgb.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))

    def labels(table: pa.Table) -> pa.Table:
        table = table.sort_by([("r", "ascending"), ("g", "ascending"), ("b", "ascending")])
        x, n = np.stack([table.column(c).to_numpy().astype(float) for c in "rgb"], 1), table.column("n").to_numpy().astype(float)
        c = x if len(x) <= colors else _clustered(x, n, colors, seed, rounds, attempts, shift)
        c = c[np.lexsort((c[:, 2], c[:, 1], c[:, 0], c @ [0.2126, 0.7152, 0.0722]))]
        near = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        return table.append_column("label", pa.array(near.astype(np.int32)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema)
    return counted.groupBy("image_id").applyInArrow(labels, f"{kinds}, label int").withColumn("light", luminance(F.col("r"), F.col("g"), F.col("b")))


def lower_slender(mask: DataFrame, least_area: int = 8, most_fill: float = 0.65) -> DataFrame:
    """(image_id, slender): tall thin parts within the lower 45 % of the mask, as drips are."""
    tall = mask.where("m").groupBy("image_id").agg(F.min("y").alias("top"), (F.max("y") - F.min("y") + 1).alias("tall"))
    low = mask.join(tall, "image_id").select(*KEY, (F.col("m") & (F.col("y") - F.col("top") >= F.floor(F.col("tall") * 0.55))).alias("m"))
    s = regions.stats(regions.components(low))
    thin = (F.col("area") > least_area) & (F.col("h") / F.col("w") > 1.5) & (F.col("area") / (F.col("w") * F.col("h")) < most_fill)
    return tall.select("image_id").join(s, "image_id", "left").groupBy("image_id").agg(F.count_if(thin).alias("slender"))
