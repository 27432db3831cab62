"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The contraction halves what is left at least; so many rounds serve any table.
MAX_ROUNDS = 60


def _mins(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Large-star hangs a node's larger neighbours on its least neighbour, small-star the smaller
    ones; both keep the components, and the edges end as stars.  Each step counts before it
    shuffles and joins one row per node, so a hub with many edges is split by Spark.
    """
    stars = C.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    for _ in range(MAX_ROUNDS):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _mins(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _mins(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = C.written(small, "stars")
        # done when every node has one edge and no root hangs on another
        ends = new.select(F.col("u").alias("node"), F.lit(1).alias("below")).unionByName(new.select(F.col("v").alias("node"), F.lit(0).alias("below")))
        ends = ends.groupBy("node").agg(F.sum("below").alias("edges"), F.min("below").alias("root"))
        again = ends.where("edges > 1 or (edges = 1 and root = 0)").limit(1).count() > 0
        stars = new
        if not again:
            break
    else:
        raise RuntimeError("the components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
