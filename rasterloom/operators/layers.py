"""Layer planning: heights snapped to a printer's layers, as window arithmetic over ordered colors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def boundary_z(index: Column, first: float, step: float) -> Column:
    """Height of the boundary above ``index`` layers."""
    return F.when(index <= 0, 0.0).otherwise(F.lit(first) + (index - 1) * F.lit(step))


def at_or_above(z: Column, first: float, step: float, tolerance: float = 0.001) -> Column:
    """Least boundary at or above a height."""
    return F.when(z <= tolerance, 0).when(z <= first + tolerance, 1).otherwise(F.ceil((z - first - tolerance) / step) + 1).cast("int")


def nearest(z: Column, first: float, step: float, tolerance: float = 0.001) -> Column:
    """Nearest boundary, the upper one where two are as near."""
    up = at_or_above(z, first, step, tolerance)
    down = F.greatest(up - 1, F.lit(0))
    upper, lower = boundary_z(up, first, step) - z, z - boundary_z(down, first, step)
    return F.when((up == 0) | (upper <= lower + tolerance), up).otherwise(down).cast("int")


def strict(z: Column, first: float, step: float, tolerance: float = 0.001) -> Column:
    """Nearest boundary, or an error where none is within ``tolerance``."""
    index = nearest(z, first, step, tolerance)
    off = F.abs(boundary_z(index, first, step) - z)
    return F.when(off <= tolerance, index).otherwise(F.raise_error(F.concat(F.lit("height is not on a layer: "), F.round(z, 4).cast("string")))).cast("int")


def requested(order: Column, base: float, step: float, solid: float | None = None) -> Column:
    """Wanted top of color number ``order`` (from 0): on a solid plate of that thickness, or from the base up."""
    return F.lit(solid) + (order + 1) * F.lit(step) if solid is not None else F.lit(base) + order * F.lit(step)


def plan(colors: DataFrame, base: float = 0.8, step: float = 0.4, first: float = 0.2, layer: float = 0.2, mode: str = "snap_up", solid: float | None = None) -> DataFrame:
    """Bands of (image_id, ord, label), ord from 0: boundary indices, heights, layers and where to change.

    Each boundary lies at least one layer above the one before.  With snap(i) the wanted index,
    the recurrence ``index(i) = max(index(i - 1) + 1, snap(i))`` is ``i + running max of (snap - i)``,
    so one window with a running maximum gives all of them.
    """
    w = W.partitionBy("image_id").orderBy("ord")
    snap = {"snap_up": at_or_above, "snap_nearest": nearest, "strict": strict}[mode]
    z = requested(F.col("ord"), base, step, solid)
    low = 0 if solid is None else snap(F.lit(solid), first, layer)
    rise = F.col("snap") - F.col("ord") - 1
    start = F.lit(low) if isinstance(low, int) else low
    p = colors.withColumn("wanted_mm", z).withColumn("snap", snap(F.col("wanted_mm"), first, layer))
    p = p.withColumn("top_index", (F.col("ord") + 1 + F.greatest(F.max(rise).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), start)).cast("int"))
    p = p.withColumn("start_index", F.coalesce(F.lag("top_index").over(w), start).cast("int"))
    top, bottom = boundary_z(F.col("top_index"), first, layer), boundary_z(F.col("start_index"), first, layer)
    return p.select(
        "image_id", "ord", "label",
        F.round("wanted_mm", 4).alias("wanted_mm"),
        F.round(top, 4).alias("top_mm"),
        F.round(bottom, 4).alias("start_mm"),
        (F.col("start_index") + 1).alias("first_layer"),
        F.col("top_index").alias("last_layer"),
        F.when((F.col("ord") > 0) | F.lit(solid is not None), F.col("start_index") + 1).alias("change_before_layer"),
        (F.abs(top - F.col("wanted_mm")) > 0.001).alias("snapped"),
    )


def background(labels: DataFrame, border: int = 1, confident: float = 0.6) -> DataFrame:
    """(image_id, label, share, sure): the most frequent label along the border, the smaller one where alike."""
    whole = W.partitionBy("image_id")
    far = labels.withColumn("right", F.max("x").over(whole)).withColumn("bottom", F.max("y").over(whole))
    rim = far.where((F.col("x") < border) | (F.col("y") < border) | (F.col("x") > F.col("right") - border) | (F.col("y") > F.col("bottom") - border)).where("label is not null")
    counted = rim.groupBy("image_id", "label").agg(F.count("*").alias("n"))
    best = counted.groupBy("image_id").agg(F.max(F.struct("n", (-F.col("label")).alias("less"))).alias("b"), F.sum("n").alias("all"))
    share = F.col("b.n") / F.col("all")
    return best.select("image_id", (-F.col("b.less")).alias("label"), share.alias("share"), (share >= confident).alias("sure"))


def printable(labels: DataFrame, colors: int = 4, border: int = 1, confident: float = 0.6) -> DataFrame:
    """(image_id, label, n): the ``colors`` most frequent labels without a sure background."""
    counted = labels.where("label is not null").groupBy("image_id", "label").agg(F.count("*").alias("n"))
    ground = background(labels, border, confident).where("sure").select("image_id", F.col("label").alias("ground"))
    many = counted.withColumn("kinds", F.count("*").over(W.partitionBy("image_id"))).join(ground, "image_id", "left")
    kept = many.where((F.col("kinds") < 2) | F.col("ground").isNull() | (F.col("label") != F.col("ground")))
    top = W.partitionBy("image_id").orderBy(F.desc("n"), "label")
    return kept.withColumn("place", F.row_number().over(top)).where(F.col("place") <= colors).select("image_id", "label", "n")


def ordered(chosen: DataFrame, light: Column, style: str = "stacked_blocks", light_first: bool = True) -> DataFrame:
    """(image_id, label, n, ord) from 0: largest first with ties to lighter colors, or by lightness."""
    c = chosen.withColumn("light", light)
    if style == "stacked_blocks":
        # the base is the largest label, the smaller of two; the rest go by size, lightness, label
        base = W.partitionBy("image_id").orderBy(F.desc("n"), "label")
        c = c.withColumn("base", F.row_number().over(base) == 1)
        keys = [F.desc("base"), F.desc("n"), F.desc("light"), F.asc("label")]
    else:
        keys = [F.desc("light") if light_first else F.asc("light"), F.asc("label")]
    return c.withColumn("ord", F.row_number().over(W.partitionBy("image_id").orderBy(*keys)) - 1).select("image_id", "label", "n", "ord")


def height_map(labels: DataFrame, bands: DataFrame, solid: float | None = None) -> DataFrame:
    """(.., z): top of the pixel's band, the plate where there is one, else 0."""
    tops = bands.select("image_id", "label", "top_mm")
    return labels.join(tops, ["image_id", "label"], "left").select("image_id", "y", "x", F.coalesce("top_mm", F.lit(solid or 0.0)).alias("z"))
