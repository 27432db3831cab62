"""Masks as dense boolean columns over (image_id, y, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["image_id", "y", "x"]


def threshold(gray: DataFrame, below: int = 128, invert: bool = False) -> DataFrame:
    m = F.col("g") < below
    return gray.select(*KEY, (~m if invert else m).alias("m"))


def raw_mask(rgba: DataFrame, dark: Column, saturated: Column, visible: Column, keep_details: bool = True) -> DataFrame:
    """Foreground of artwork: what is visible where an image has transparency, dark or saturated pixels elsewhere."""
    whole = W.partitionBy("image_id")
    clear = F.max(F.when(F.col("a") < 255, 1).otherwise(0)).over(whole) == 1
    seen = visible | dark if keep_details else visible
    return rgba.withColumn("m", F.when(clear, seen).otherwise(dark | saturated)).select(*KEY, "m")


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """union, intersection, difference or symmetric difference; a pixel that one mask lacks is false there."""
    joined = a.select(*KEY, F.col("m").alias("ma")).join(b.select(*KEY, F.col("m").alias("mb")), KEY, "full")
    p, q = F.coalesce("ma", F.lit(False)), F.coalesce("mb", F.lit(False))
    m = {"union": p | q, "intersection": p & q, "difference": p & ~q, "symmetric": p != q}[how]
    return joined.select(*KEY, m.alias("m"))


def beside(**of: DataFrame) -> DataFrame:
    """(image_id, y, x, a boolean for each name): masks of the same images in one relation, dealt by image; a pixel that one mask lacks is false there."""
    each = [df.select(*KEY, *[(F.col("m") if n == name else F.lit(None).cast("boolean")).alias(n) for n in of]) for name, df in of.items()]
    both = each[0]
    for more in each[1:]:
        both = both.unionByName(more)
    return both.repartition("image_id").groupBy(*KEY).agg(*[F.coalesce(F.max(n), F.lit(False)).alias(n) for n in of])


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(image_id, kept, removed, added, changed): what an edit did to each mask."""
    joined = before.select(*KEY, F.col("m").alias("ma")).join(after.select(*KEY, F.col("m").alias("mb")), KEY, "full")
    p, q = F.coalesce("ma", F.lit(False)), F.coalesce("mb", F.lit(False))
    return joined.groupBy("image_id").agg(F.count_if(p & q).alias("kept"), F.count_if(p & ~q).alias("removed"), F.count_if(~p & q).alias("added"), F.max(p != q).alias("changed"))


def runs(mask: DataFrame) -> DataFrame:
    """(image_id, y, x0, x1): maximal runs of each row, by gaps and islands; ends inclusive."""
    on = mask.where("m").withColumn("island", F.col("x") - F.row_number().over(W.partitionBy("image_id", "y").orderBy("x")))
    return on.groupBy("image_id", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def rectangles(mask: DataFrame) -> DataFrame:
    """(image_id, x0, y0, x1, y1): runs of equal extent in successive rows merged; ends exclusive."""
    row = W.partitionBy("image_id", "x0", "x1").orderBy("y")
    r = runs(mask).withColumn("stack", F.col("y") - F.row_number().over(row))
    merged = r.groupBy("image_id", "x0", "x1", "stack").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    return merged.select("image_id", "x0", "y0", (F.col("x1") + 1).alias("x1"), "y1")


def foreground(gray: DataFrame, cut: str = "cut") -> DataFrame:
    """The side of the column ``cut`` that is foreground: least share of border pixels, then area nearest 30 %."""
    whole = W.partitionBy("image_id")
    edge = (F.col("y") == F.min("y").over(whole)) | (F.col("y") == F.max("y").over(whole)) | (F.col("x") == F.min("x").over(whole)) | (F.col("x") == F.max("x").over(whole))
    g = gray.withColumn("edge", edge).withColumn("low", F.col("g") < F.col(cut)).withColumn("high", F.col("g") > F.col(cut))
    # a corner lies on two borders and counts twice
    corner = edge & ((F.col("y") == F.min("y").over(whole)) | (F.col("y") == F.max("y").over(whole))) & ((F.col("x") == F.min("x").over(whole)) | (F.col("x") == F.max("x").over(whole)))
    g = g.withColumn("times", F.when(corner, 2).when(F.col("edge"), 1).otherwise(0))
    for side in ("low", "high"):
        on = F.col(side).cast("int")
        g = g.withColumn(f"{side}_border", F.sum(on * F.col("times")).over(whole) / F.sum("times").over(whole)).withColumn(f"{side}_off", F.abs(F.avg(on).over(whole) - 0.30))
    better = F.struct("high_border", "high_off") < F.struct("low_border", "low_off")
    return g.select(*KEY, "g", F.when(better, F.col("high")).otherwise(F.col("low")).alias("m"))
