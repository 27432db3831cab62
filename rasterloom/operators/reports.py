"""Counts and decisions of a job, as rows that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import dealt
from . import meshes, regions
from .masks import KEY


def hole_metrics(mask: DataFrame) -> DataFrame:
    """(image_id, holes, share): how many holes a mask has, and their mean area over the image's."""
    size = mask.groupBy("image_id").agg(F.count("*").alias("all"))
    each = regions.holes(mask).groupBy("image_id", "comp").agg(F.count("*").alias("area"))
    g = size.join(each, "image_id", "left").groupBy("image_id").agg(F.count("area").alias("holes"), F.coalesce(F.avg(F.col("area") / F.col("all")), F.lit(0.0)).alias("share"))
    return g.withColumn("share", F.round("share", 6))


def restore_holes(original: DataFrame, cleaned: DataFrame, least_area: int) -> DataFrame:
    """``cleaned`` with the original's holes of at least ``least_area`` pixels open again."""
    big = regions.holes(original).withColumn("area", F.count("*").over(W.partitionBy("image_id", "comp"))).where(F.col("area") >= least_area)
    return cleaned.join(big.select(*KEY, F.lit(True).alias("open")), KEY, "left").select(*KEY, (F.col("m") & F.col("open").isNull()).alias("m"))


def per_color_counts(labels: DataFrame, least_area: int) -> DataFrame:
    """(image_id, label, regions, kept, small, pixels) of each label's regions."""
    each = regions.components(labels.select(*KEY, "label", F.lit(True).alias("m")), by="label").groupBy("image_id", "label", "comp").agg(F.count("*").alias("area"))
    big = F.col("area") >= least_area
    return each.groupBy("image_id", "label").agg(F.count("*").alias("regions"), F.count_if(big).alias("kept"), F.count_if(~big).alias("small"), F.sum("area").alias("pixels"))


def island_summary(labels: DataFrame, least_area: int, most_distance: int) -> DataFrame:
    """(image_id, small, merged, by_contact, removed): what a merging policy does to small regions."""
    d = regions.merge_destinations(labels, least_area, most_distance)
    there = F.col("target").isNotNull()
    return d.groupBy("image_id").agg(F.count("*").alias("small"), F.count_if(there).alias("merged"), F.count_if(F.col("contact") > 0).alias("by_contact"), F.count_if(~there).alias("removed"))


def background_decision(ground: DataFrame, labels: DataFrame, enabled: bool = True) -> DataFrame:
    """(image_id, ignored, reason): whether the border's label is left out of the print, and why."""
    kinds = labels.where("label is not null").groupBy("image_id").agg(F.countDistinct("label").alias("kinds"))
    g = kinds.join(ground, "image_id", "left")
    out = F.lit(enabled) & F.coalesce("sure", F.lit(False)) & (F.col("kinds") > 1)
    reason = (
        F.when(F.lit(not enabled), "background detection is off")
        .when(F.col("label").isNull(), "no border pixels")
        .when(~F.col("sure"), "the border has no clear color")
        .when(F.col("kinds") < 2, "it is the only color")
        .otherwise("the border has one clear color")
    )
    return g.select("image_id", F.when(out, F.col("label")).alias("ignored"), reason.alias("reason"))


def tool_changes(bands: DataFrame, first: float, step: float) -> DataFrame:
    """(image_id, slot, label, layer, top_z): after which height each further color is loaded."""
    from .layers import boundary_z

    slot = (F.col("ord") + 1).alias("slot")
    layer = F.col("change_before_layer")
    return bands.where(layer.isNotNull()).select("image_id", slot, "label", layer.alias("layer"), F.round(boundary_z(layer - 1, first, step), 4).alias("top_z"))


def indexed(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image_id, vid, corner) and (image_id, v1, v2, v3): equal corners are one vertex, numbered in their order.

    Faces are dealt by image once; windows number their corners there, and no face is sent again to meet a number.
    What tells faces apart is only used in the task that gives it.
    """
    own, corner = W.partitionBy("image_id"), F.array("f.a", "f.b", "f.c")
    faces = dealt(faces.select("image_id", "f"), "image_id")
    vertices = faces.select("image_id", F.explode(corner).alias("corner")).distinct().withColumn("vid", F.row_number().over(own.orderBy("corner")) - 1)
    each = faces.withColumn("face", F.monotonically_increasing_id()).select("image_id", "face", F.posexplode(corner).alias("k", "corner"))
    each = each.withColumn("vid", F.dense_rank().over(own.orderBy("corner")) - 1)
    numbered = each.groupBy("image_id", "face").agg(*[F.max(F.when(F.col("k") == k, F.col("vid"))).alias(f"v{k + 1}") for k in range(3)])
    return vertices, numbered.drop("face")


def mesh_errors(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(image_id, rule, n): vertices that are no numbers, faces out of range or with a repeated corner."""
    odd = vertices.where("isnan(x) or isnan(y) or isnan(z) or x is null or y is null or z is null or abs(x) = double('Infinity') or abs(y) = double('Infinity') or abs(z) = double('Infinity')").groupBy("image_id").agg(F.count("*").alias("n"))
    size = vertices.groupBy("image_id").agg(F.count("*").alias("vertices"))
    f = faces.join(size, "image_id", "left").withColumn("vertices", F.coalesce("vertices", F.lit(0)))
    beyond = f.where("least(v1, v2, v3) < 0 or greatest(v1, v2, v3) >= vertices").groupBy("image_id").agg(F.count("*").alias("n"))
    flat = f.where("v1 = v2 or v2 = v3 or v1 = v3").groupBy("image_id").agg(F.count("*").alias("n"))
    named = [d.select("image_id", F.lit(r).alias("rule"), "n") for d, r in ((odd, "finite"), (beyond, "range"), (flat, "degenerate"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def centred(vertices: DataFrame, width_mm: float, depth_mm: float) -> DataFrame:
    """Vertices moved so that the mesh stands in the middle of a plate, on it."""
    b = meshes.bounds(vertices)
    j = vertices.join(b, "image_id")
    return j.select(*vertices.columns[:2], (F.col("x") - (F.col("x0") + F.col("x1")) / 2 + width_mm / 2).alias("x"), (F.col("y") - (F.col("y0") + F.col("y1")) / 2 + depth_mm / 2).alias("y"), (F.col("z") - F.col("z0")).alias("z"))


def physical_warnings(least_mm: Column, most_mm: Column, width_mm: Column, height_mm: Column, thinnest: float = 0.6, largest: float = 250.0) -> Column:
    """What speaks against printing a lithophane of this size."""
    return F.array_compact(
        F.array(
            F.when(least_mm < thinnest, "thinner than can be printed"),
            F.when(most_mm <= least_mm, "no relief"),
            F.when(F.greatest(width_mm, height_mm) > largest, "larger than the plate"),
        )
    )


def height_preview(heights: DataFrame) -> DataFrame:
    """(.., g): heights from the least to the most as 80 to 255, 180 where there is one height, 0 where there is none."""
    whole = W.partitionBy("image_id")
    up = F.when(F.col("z") > 0, F.col("z"))
    low, high = F.min(up).over(whole), F.max(up).over(whole)
    g = F.when(F.col("z") <= 0, 0).when(high <= low, 180).otherwise(F.floor(F.round((F.col("z") - low) / (high - low) * 175, 6) + 80))
    return heights.select(*KEY, g.cast("int").alias("g"))


def thickness_preview(cells: DataFrame) -> DataFrame:
    """(.., g): thickness from the least to the most as 0 to 255."""
    whole = W.partitionBy("image_id")
    low, high = F.min("mm").over(whole), F.max("mm").over(whole)
    return cells.select(*KEY, F.when(high > low, F.floor(F.round((F.col("mm") - low) / (high - low) * 255, 6))).otherwise(0).cast("int").alias("g"))


def level_support(heights: DataFrame) -> DataFrame:
    """(image_id, level, pixels, supported): pixels at least as high as a level, and those whose neighbours below carry them.

    A pixel of a level is carried where one of its nine neighbours reaches that level too.
    """
    from .neighbourhood import along_columns, along_rows

    levels = heights.where("z > 0").select("image_id", F.col("z").alias("level")).distinct()
    wide = heights.withColumn("a", F.greatest(F.coalesce(F.lag("z").over(along_rows()), F.lit(0.0)), F.coalesce(F.lead("z").over(along_rows()), F.lit(0.0))))
    wide = wide.withColumn("row", F.greatest("a", "z"))
    wide = wide.withColumn("near", F.greatest("a", F.coalesce(F.lag("row").over(along_columns()), F.lit(0.0)), F.coalesce(F.lead("row").over(along_columns()), F.lit(0.0))))
    met = wide.join(levels, "image_id").where("z >= level")
    return met.groupBy("image_id", "level").agg(F.count("*").alias("pixels"), F.count_if(F.col("near") >= F.col("level")).alias("supported"))


def swap_plan_text(bands: DataFrame, colors: DataFrame) -> DataFrame:
    """(image_id, text): the changes of a plan in words, a line per color of (image_id, label, hex)."""
    line = F.concat(
        F.lpad((F.col("ord") + 1).cast("string"), 2, " "), F.lit(". "), F.col("hex"), F.lit(": layers "), F.col("first_layer").cast("string"), F.lit(" to "), F.col("last_layer").cast("string"),
        F.coalesce(F.concat(F.lit(", change before layer "), F.col("change_before_layer").cast("string")), F.lit("")),
    )
    rows = bands.join(colors.select("image_id", "label", "hex"), ["image_id", "label"]).select("image_id", "ord", line.alias("line"))
    return rows.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "line")))["line"], "\n").alias("text"))


def matrix_lines(runs: DataFrame) -> DataFrame:
    """(image, text): a paragraph per image of a quality matrix: its runs, the best first."""
    line = F.concat(F.lit("- "), F.col("preset"), F.lit(": "), F.col("score").cast("string"), F.lit(" ("), F.col("note"), F.lit(")"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "preset", "run", line.alias("line"))))
    return runs.groupBy("image").agg(F.array_join(listed["line"], "\n").alias("text"))


def save_matrix(runs: DataFrame, folder: str) -> None:
    """A quality matrix as JSON, CSV and text under a folder that executors share."""
    runs.write.mode("overwrite").json(f"{folder}/json")
    runs.select(*[c for c, k in runs.dtypes if not k.startswith(("array", "struct", "map"))]).write.mode("overwrite").csv(f"{folder}/csv", header=True)
    matrix_lines(runs).select("text").write.mode("overwrite").text(f"{folder}/text")


def kept_labels(labels: DataFrame, least_area: int) -> DataFrame:
    """(image_id, y, x, label): pixels of regions of at least ``least_area`` pixels."""
    pixels = regions.components(labels.select(*KEY, "label", F.lit(True).alias("m")), by="label")
    return pixels.withColumn("area", F.count("*").over(W.partitionBy("image_id", "label", "comp"))).where(F.col("area") >= least_area).select(*KEY, "label")


def contour_text(report: DataFrame) -> DataFrame:
    """(image_id, text) of a contour report: rings, points before and after, what was lost and how often a ring fell back."""
    lost = (F.col("points_before") - F.col("points_after")) / F.col("points_before") * 100
    lines = [("contours", F.col("rings").cast("string")), ("points before", F.col("points_before").cast("string")), ("points after", F.col("points_after").cast("string")), ("point reduction percent", F.format_string("%.2f", F.bround(F.greatest(F.lit(0.0), lost), 2))), ("fallbacks", F.col("fallbacks").cast("string"))]
    return report.select("image_id", F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in lines]).alias("text"))


def settings_text(settings: DataFrame) -> DataFrame:
    """(job, text): the settings (job, section, key, value) that a job ran with, as a two-level file."""
    rows = settings.groupBy("job", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda s: F.concat(F.lit("  "), s["key"], F.lit(": "), s["value"])), "\n").alias("body"))
    return rows.groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda s: F.concat(s["section"], F.lit(":\n"), s["body"])), "\n").alias("text"))
