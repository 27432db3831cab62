"""Pixel relations from image files and from tables that carry small images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of file that count as artwork.
EXTENSIONS = ("png", "jpg", "jpeg")


def is_artwork(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.\/]+)$", 1)).isin(*EXTENSIONS)


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, path, width, height, channels, data, valid): one row per artwork file of a folder.

    An image is named by its file without the ending, or with it where another file has the same
    name.  Files that no decoder reads stay, with ``valid`` false, so that the job can report them.
    """
    rows = spark.read.format("image").load(folder).select("image.*").where(is_artwork(F.col("origin")))
    stem = F.regexp_extract("origin", r"([^\/]+)\.[^.\/]+$", 1)
    shared = rows.select(stem.alias("stem")).groupBy("stem").agg((F.count("*") > 1).alias("shared"))
    named = rows.withColumn("stem", stem).join(shared, "stem").withColumn("image_id", F.when(F.col("shared"), F.regexp_extract("origin", r"([^\/]+)$", 1)).otherwise(F.col("stem")))
    return named.select("image_id", F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data", (F.col("width") > 0).alias("valid"))


def _byte(at: str) -> Column:
    return F.conv(F.hex(F.expr(f"substring(data, {at}, 1)")), 16, 10).cast("int")


def pixels(images: DataFrame) -> DataFrame:
    """(image_id, width, height, y, x, r, g, b, a): bytes come as BGRA, BGR or gray, row by row."""
    rows = images.where("valid").withColumn("k", F.explode(F.expr("sequence(0, width * height - 1)")))
    first = "(k * channels + {})"
    blue, green, red = (_byte(first.format(f"if(channels = 1, 1, {c})")) for c in (1, 2, 3))
    alpha = F.when(F.col("channels") == 4, _byte(first.format(4))).otherwise(255)
    return rows.select("image_id", "width", "height", F.expr("cast(k div width as int)").alias("y"), F.expr("cast(k % width as int)").alias("x"), red.alias("r"), green.alias("g"), blue.alias("b"), alpha.alias("a"))


def embedding_images(embeddings: DataFrame, side: int = 8) -> DataFrame:
    """(image_id, y, x, g): vectors of side * side numbers as gray images, a carrier of raster semantics."""
    cells = embeddings.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("k", "v"))
    gray = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 0.55) * 255 / 1.1))).cast("int")
    return cells.select("image_id", F.expr(f"k div {side}").cast("int").alias("y"), (F.col("k") % side).cast("int").alias("x"), gray.alias("g"))


def embedding_rgb(embeddings: DataFrame, side: int = 8) -> DataFrame:
    """(image_id, y, x, r, g, b, a): the same carrier in color; the channels are shifts of the gray value."""
    g = embedding_images(embeddings, side)
    return g.select("image_id", "y", "x", F.col("g").alias("r"), ((F.col("g") * 3 + F.col("x") * 16) % 256).alias("g"), ((255 - F.col("g") + F.col("y") * 8) % 256).alias("b"), F.when(F.col("g") % 16 == 0, 10).otherwise(255).alias("a"))


def shapes(spark: SparkSession, size: tuple[int, int], background: tuple[int, int, int], drawn: list[tuple[str, tuple[int, int, int]]], image_id: str = "shapes") -> DataFrame:
    """A synthetic image: each shape is an SQL predicate over x and y with its color; the last that holds wins."""
    height, width = size
    grid = spark.range(height * width).select(F.lit(image_id).alias("image_id"), F.expr(f"cast(id div {width} as int)").alias("y"), F.expr(f"cast(id % {width} as int)").alias("x"))
    color = F.lit(list(background))
    for predicate, rgb in drawn:
        color = F.when(F.expr(predicate), F.lit(list(rgb))).otherwise(color)
    return grid.withColumn("c", color).select("image_id", "y", "x", F.col("c")[0].alias("r"), F.col("c")[1].alias("g"), F.col("c")[2].alias("b"), F.lit(255).alias("a"))


def sampled_size(width: Column, height: Column, most_pixels: int) -> dict[str, Column]:
    """Width and height scaled down together until they hold ``most_pixels`` at most."""
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(most_pixels)) / (width * height)))
    return {"width": F.greatest(F.lit(1), F.floor(width * scale)).cast("int"), "height": F.greatest(F.lit(1), F.floor(height * scale)).cast("int")}


def discover(inputs: DataFrame, samples: DataFrame) -> DataFrame:
    """(path, kind): all files once; a path among both counts as an input."""
    both = inputs.select("path", F.lit("input").alias("kind")).unionByName(samples.select("path", F.lit("sample").alias("kind")))
    return both.groupBy("path").agg(F.min("kind").alias("kind"))


def stacked_images(embeddings: DataFrame, side: int = 64) -> DataFrame:
    """(image_id, y, x, g): ``side`` neighbouring vectors as the rows of one gray image, a disc and bars above their noise.

    A larger carrier, so that operators meet the edges of their tiles; the last image may have fewer rows.
    """
    cells = embeddings.select(F.expr(f"vec_id div {side}").alias("image_id"), (F.col("vec_id") % side).cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    noise = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 0.55) * 255 / 1.1))).cast("int")
    disc = (F.col("x") - 32) * (F.col("x") - 32) + (F.col("y") - 32) * (F.col("y") - 32) < 300 + 100 * (F.col("image_id") % 4)
    bars = F.expr("(x div 8 + y div 8) % 5 = 0")
    level = F.when(disc, 20).when(bars, 100).otherwise(160)
    return cells.select("image_id", "y", "x", (F.shiftright(noise, 2) + level).cast("int").alias("g"))
