"""Cleanup presets as a relation of bounds, overlaid on settings by a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Preset, setting, least, most, set to.
PRESETS = [
    ("default", "simplify_tolerance", None, 0.7, None),
    ("clean_logo", "remove_small_islands", None, None, 1.0),
    ("clean_logo", "min_island_area_px", 150.0, None, None),
    ("clean_logo", "preserve_islands_near_body", None, None, 0.0),
    ("clean_logo", "island_near_body_distance_px", None, None, 0.0),
    ("clean_logo", "morph_kernel_size", 3.0, None, None),
    ("clean_logo", "morph_iterations", 1.0, None, None),
    ("clean_logo", "simplify_tolerance", None, 0.6, None),
    ("line_art", "remove_small_islands", None, None, 1.0),
    ("line_art", "min_island_area_px", 85.0, None, None),
    ("line_art", "preserve_islands_near_body", None, None, 1.0),
    ("line_art", "island_near_body_distance_px", 4.0, 6.0, None),
    ("line_art", "min_contour_area", None, 18.0, None),
    ("line_art", "morph_kernel_size", 3.0, None, None),
    ("line_art", "morph_iterations", 1.0, None, None),
    ("line_art", "simplify_tolerance", None, 0.7, None),
    ("drip_logo", "remove_small_islands", None, None, 1.0),
    ("drip_logo", "min_island_area_px", 110.0, None, None),
    ("drip_logo", "preserve_islands_near_body", None, None, 1.0),
    ("drip_logo", "island_near_body_distance_px", 14.0, None, None),
    ("drip_logo", "morph_kernel_size", 3.0, None, None),
    ("drip_logo", "morph_iterations", 1.0, None, None),
    ("drip_logo", "simplify_tolerance", None, 0.7, None),
    ("splatter_logo", "remove_small_islands", None, None, 1.0),
    ("splatter_logo", "min_island_area_px", None, 55.0, None),
    ("splatter_logo", "preserve_islands_near_body", None, None, 1.0),
    ("splatter_logo", "island_near_body_distance_px", 18.0, None, None),
    ("splatter_logo", "min_contour_area", None, 18.0, None),
    ("splatter_logo", "morph_kernel_size", 3.0, None, None),
    ("splatter_logo", "morph_iterations", 1.0, None, None),
    ("splatter_logo", "simplify_tolerance", None, 0.6, None),
    ("detail_preserving", "remove_small_islands", None, None, 1.0),
    ("detail_preserving", "min_island_area_px", None, 35.0, None),
    ("detail_preserving", "preserve_islands_near_body", None, None, 1.0),
    ("detail_preserving", "island_near_body_distance_px", 10.0, None, None),
    ("detail_preserving", "simplify_tolerance", None, 0.7, None),
    ("preserve_floating_islands", "remove_small_islands", None, None, 0.0),
    ("preserve_floating_islands", "min_island_area_px", None, None, 0.0),
    ("preserve_floating_islands", "min_contour_area", None, None, 0.0),
    ("preserve_floating_islands", "simplify_tolerance", None, None, 0.0),
    ("preserve_floating_islands", "preserve_islands_near_body", None, None, 1.0),
    ("preserve_floating_islands", "island_near_body_distance_px", None, None, 0.0),
]
NAMES = sorted({p[0] for p in PRESETS})


def bounds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, setting string, least double, most double, fixed double")


def normal_name(name):
    """Preset names as they are written by hand; unknown ones are the default."""
    n = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("default")))), "[ -]", "_")
    return F.when(n.isin(*NAMES), n).otherwise(F.lit("default"))


def overlay(settings: DataFrame) -> DataFrame:
    """(job, preset, setting, value) with each value brought within its preset's bounds.

    The bounds are a constant table of some dozens of rows, so they are broadcast.
    """
    b = F.broadcast(bounds(settings.sparkSession))
    within = F.least(F.greatest("value", F.coalesce("least", F.col("value"))), F.coalesce("most", F.greatest("value", F.coalesce("least", F.col("value")))))
    return settings.join(b, ["preset", "setting"], "left").select("job", "preset", "setting", F.coalesce("fixed", within).alias("value"))
