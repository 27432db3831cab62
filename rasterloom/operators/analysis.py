"""An artwork's measures in one row, from its pixels, as the recommendation reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..storage import written
from . import contours, edges, filters, masks, metrics, reports, scoring
from .masks import KEY


def analysed_gray(rgb: DataFrame, most_side: int = 512) -> tuple[DataFrame, DataFrame]:
    """(gray, sizes): luma of images whose longer side is ``most_side`` at most; larger ones are averaged down first."""
    own = rgb.select(*KEY, "r", "g", "b")
    sizes = written(filters.within_side(filters.sizes_of(own), most_side), "analysis-sizes")
    large = sizes.where("to_width < width or to_height < height")
    as_is = own.join(sizes.where("to_width = width and to_height = height").select("image_id"), "image_id", "left_semi")
    less = filters.averaged(own.join(large.select("image_id"), "image_id", "left_semi"), large, ["r", "g", "b"])
    luma = color.luma(F.col("r"), F.col("g"), F.col("b"))
    return written(as_is.unionByName(less).select(*KEY, luma.alias("g")), "analysis-gray"), sizes


def artwork_metrics(rgb: DataFrame, most_side: int = 512) -> DataFrame:
    """One row per image with the 20 measures that presets are scored by; an image without foreground has zeros."""
    gray, sizes = analysed_gray(rgb, most_side)
    soft = filters.blur(gray, 3)
    mask = written(masks.foreground(soft.join(metrics.otsu(soft), "image_id")).select(*KEY, "m"), "analysis-mask")
    on = mask.groupBy("image_id").agg(F.round(F.avg(F.col("m").cast("int")), 5).alias("foreground_percent"), F.count_if("m").alias("on"))
    counts = metrics.component_counts(mask).select("image_id", F.col("components").alias("component_count"), F.col("significant").alias("significant_component_count"), F.col("tiny").alias("tiny_component_count"), F.col("small").alias("small_component_count"))
    holes = reports.hole_metrics(mask).select("image_id", F.col("holes").alias("hole_count"), F.col("share").alias("average_hole_area_percent"))
    wide = metrics.widths(mask).select("image_id", F.col("narrow").alias("narrow_feature_percent"), F.col("median_width").alias("median_feature_width_px"), F.col("solid").alias("large_solid_region_percent"))
    around = contours.measures(contours.trace(mask)).groupBy("image_id").agg(F.sum("perimeter").alias("perimeter"))
    low = metrics.lower_profile(mask).select("image_id", F.col("variation").alias("lower_profile_variation"))
    slender = metrics.lower_slender(mask).select("image_id", F.col("slender").alias("lower_slender_component_count"))
    contrast = metrics.contrast(gray).select("image_id", F.col("contrast").alias("contrast_quality"))
    out = sizes.select("image_id", F.col("width").alias("source_width"), F.col("height").alias("source_height"), F.col("to_width").alias("analysis_width"), F.col("to_height").alias("analysis_height"))
    for part in (on, counts, holes, edges.density(gray), wide, around, low, slender, contrast):
        out = out.join(part, "image_id", "left")
    rough = F.round(F.coalesce("perimeter", F.lit(0.0)) / F.greatest(F.lit(1.0), F.sqrt("on")), 4)
    out = out.withColumns({"boundary_roughness": rough, "contour_count": F.col("component_count") + F.col("hole_count")}).drop("perimeter", "on")
    return out.fillna(0.0, ["lower_profile_variation"]).fillna(0, ["lower_slender_component_count"])


def recommendation(rgb: DataFrame, width_mm: float = 160.0) -> DataFrame:
    """Pixels to measures to scores to a preset, with confidence, thickness and reasons.

    What is not finite or missing among the measures gives the default preset at 2.5 mm and low confidence, with the reason in ``unavailable``.
    """
    found = scoring.reasons(scoring.recommend(scoring.preset_scores(artwork_metrics(rgb)), width_mm))
    missing = F.greatest(*[F.col(f"scores.{p}") for p in scoring.PRESETS]).isNull() | F.isnan(F.col("boundary_roughness"))
    return found.withColumn("unavailable", F.when(missing, "the artwork could not be measured")).withColumns({
        "preset": F.when(missing, "default").otherwise(F.col("preset")), "confidence": F.when(missing, "low").otherwise(F.col("confidence")), "thickness_mm": F.when(missing, 2.5).otherwise(F.col("thickness_mm")),
    })
