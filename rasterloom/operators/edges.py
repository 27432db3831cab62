"""Edges by gradient, thinning and hysteresis.

All neighbourhood steps are windows on rows and columns after the pixels were dealt by image
once; hysteresis is reachability: a component of candidates stays if it holds a strong pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import regions
from .masks import KEY
from .neighbourhood import along_columns, along_rows

#: Fixed value: tan 22.5 degrees in 32768ths, with which the direction of a gradient is told.
TAN_22 = 13573


def gradients(gray: DataFrame) -> DataFrame:
    """(.., gx, gy, mag): 3 x 3 differences with repeated borders, and the sum of their sizes."""
    own = gray.select(*KEY, "g").repartition("image_id")

    def sides(c: str, w) -> tuple[Column, Column]:
        return F.coalesce(F.lag(c).over(w), F.col(c)), F.coalesce(F.lead(c).over(w), F.col(c))

    a, b = sides("g", along_rows())
    rows = own.select(*KEY, (b - a).alias("d"), (a + F.col("g") * 2 + b).alias("s"))
    (d0, d1), (s0, s1) = sides("d", along_columns()), sides("s", along_columns())
    both = rows.select(*KEY, (d0 + F.col("d") * 2 + d1).alias("gx"), (s1 - s0).alias("gy"))
    return both.withColumn("mag", F.abs("gx") + F.abs("gy"))


def thinned(found: DataFrame, low: int) -> DataFrame:
    """(.., mag): pixels above ``low`` that no neighbour along their gradient surpasses.

    Of two equal neighbours the one to the right or below gives way; outside the image there is no gradient.
    """
    none = F.struct(*[F.lit(0).alias(c) for c in ("l", "c", "r")])
    beside = lambda f: F.coalesce(f("mag").over(along_rows()), F.lit(0))
    rows = found.withColumn("row", F.struct(beside(F.lag).alias("l"), F.col("mag").alias("c"), beside(F.lead).alias("r")))
    near = rows.withColumn("up", F.coalesce(F.lag("row").over(along_columns()), none)).withColumn("down", F.coalesce(F.lead("row").over(along_columns()), none))
    ax, ay, m = F.abs("gx").cast("long"), F.shiftleft(F.abs("gy").cast("long"), 15), F.col("mag")
    flat = ay < ax * TAN_22
    steep = ay > ax * TAN_22 + F.shiftleft(ax, 16)
    opposite = (F.col("gx") < 0) != (F.col("gy") < 0)
    stays = (
        F.when(flat, (m > F.col("row.l")) & (m >= F.col("row.r")))
        .when(steep, (m > F.col("up.c")) & (m >= F.col("down.c")))
        .when(opposite, (m > F.col("up.r")) & (m > F.col("down.l")))
        .otherwise((m > F.col("up.l")) & (m > F.col("down.r")))
    )
    return near.where((m > low) & stays).select(*KEY, "mag")


def canny(gray: DataFrame, low: int = 80, high: int = 160) -> DataFrame:
    """(image_id, y, x): edge pixels, thin, above ``high`` or linked to such by pixels above ``low``."""
    weak = thinned(gradients(gray), low)
    linked = regions.components(weak.withColumn("m", F.lit(True)).select(*KEY, "m"))
    marked = linked.join(weak, KEY).withColumn("best", F.max("mag").over(W.partitionBy("image_id", "comp")))
    return marked.where(F.col("best") > high).select(*KEY)


def density(gray: DataFrame, low: int = 80, high: int = 160) -> DataFrame:
    """(image_id, edge_density): share of edge pixels, for every image."""
    n = canny(gray, low, high).groupBy("image_id").agg(F.count("*").alias("n"))
    return gray.groupBy("image_id").agg(F.count("*").alias("all")).join(n, "image_id", "left").select("image_id", F.round(F.coalesce("n", F.lit(0)) / F.col("all"), 5).alias("edge_density"))
