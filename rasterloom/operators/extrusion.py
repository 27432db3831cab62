"""Printable polygon sets, and prisms over them with a repair for the images that need one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import met, written
from . import contours, polygons
from .printability import LIMITS

#: Fixed value: no thickening moves an outline by more, in mm.
MOST_GROWTH = 0.25


def closed(points: DataFrame, distance: float, quarter: int = 16) -> tuple[DataFrame, DataFrame]:
    """(spans, outline) of directed rings moved out and back by ``distance``, so that narrower gaps close."""
    grown = polygons.outlines(polygons.spans(polygons.offset(points, distance, quarter), rule="positive"))
    found = polygons.spans(polygons.offset(polygons.rings(grown), -distance, quarter), rule="positive")
    return found, polygons.outlines(found)


def without_tiny_holes(outline: DataFrame, least_area: float) -> tuple[DataFrame, DataFrame]:
    """(rings, dropped): the outline's rings but holes under ``least_area``, and how many an image lost."""
    size = outline.where("hole").groupBy(*contours.RING).agg((F.sum(F.col("bx") * F.col("ay") - F.col("ax") * F.col("by")) / 2).alias("area"))
    tiny = written(size.where(F.col("area") < least_area).select(*contours.RING), "tiny-holes")
    return met(polygons.rings(outline), tiny, contours.RING, "left_anti"), tiny.groupBy("image_id").agg(F.count("*").alias("filled_holes"))


def part_actions(outline: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """(image_id, part, area, w, h, action, growth): what becomes of each part, thin long ones grow."""
    small, long = F.least("w", "h"), F.greatest("w", "h")
    area, segment, size, feature = (limits[k] for k in ("island_area", "segment", "dimension", "feature"))
    action = (
        F.when((small > 0) & (small < feature) & (long >= segment) & (F.col("area") >= area), "thickened")
        .when(F.col("area") < area, "area_below_minimum")
        .when((small < size) & (long < segment), "component_dimension_below_minimum")
        .when(small < size, "sliver_dimension_below_minimum")
        .otherwise("kept")
    )
    growth = F.when(action == "thickened", F.least((feature - small) / 2, F.lit(MOST_GROWTH))).otherwise(0.0)
    return polygons.part_measures(outline).select("image_id", "part", "area", "w", "h", action.alias("action"), growth.alias("growth"))


def printable(points: DataFrame, limits: dict[str, float] = LIMITS, rule: str = "evenodd", quarter: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, outline, report): holes too small are filled, gaps closed, parts thickened or removed, the rest united.

    The report has a row for every image of ``points``, also where nothing remains.  ``quarter``: chords
    of a right angle where outlines are moved; the work grows with it.
    """
    images = written(points.select("image_id").distinct(), "polygon-images")
    kept, filled = without_tiny_holes(polygons.outlines(polygons.spans(points, rule=rule)), limits["hole_area"])
    kept = written(kept, "kept-rings")
    before = polygons.spans(kept, rule="positive")
    outline = polygons.outlines(before)
    if limits["gap"] > 0:
        after, outline = closed(kept, limits["gap"] / 2, quarter)
        grew = met(polygons.areas(before).withColumnRenamed("area", "was"), polygons.areas(after), "image_id", "left")
        gaps = grew.select("image_id", (F.abs(F.coalesce("area", F.lit(0.0)) - F.col("was")) > 1e-6).cast("long").alias("closed_gaps"))
    else:
        gaps = images.select("image_id", F.lit(0).cast("long").alias("closed_gaps"))
    actions = written(part_actions(outline, limits), "part-actions")
    stay = actions.where("action in ('kept', 'thickened')").select("image_id", "part", "growth")
    moved = polygons.offset(met(polygons.rings(outline), stay, ["image_id", "part"]), "growth", quarter)
    found = polygons.spans(moved, rule="positive")
    final = polygons.outlines(found)
    size = F.least("w", "h")
    left = polygons.part_measures(final).groupBy("image_id").agg(F.count("*").alias("parts"), F.round(F.min("area"), 4).alias("smallest_area"), F.round(F.min(size), 4).alias("smallest_width"), F.max(size < limits["feature"]).alias("below_feature_width"))
    count = lambda a, n: F.count_if(F.col("action") == a).alias(n)
    did = actions.groupBy("image_id").agg(count("thickened", "thickened"), count("area_below_minimum", "removed_islands"), count("component_dimension_below_minimum", "removed_short_segments"), count("sliver_dimension_below_minimum", "removed_slivers"))
    report = images
    for table in (filled, gaps, did, left):
        report = met(report, table, "image_id", "left")
    counters = ["filled_holes", "closed_gaps", "thickened", "removed_islands", "removed_short_segments", "removed_slivers", "parts"]
    return found, final, report.fillna(0, counters).withColumn("below_feature_width", F.coalesce("below_feature_width", F.lit(False)))


def with_known_holes(points: DataFrame) -> DataFrame:
    """Rings (.., hole) without the holes that no outer ring holds."""
    slim = points.select(*contours.RING, "seq", "px", "py", "hole")
    outer, holes = slim.where("not hole"), slim.where("hole")
    inside = contours.holes_to_exteriors(outer, holes).select("image_id", F.col("hole").alias("ring"))
    return outer.unionByName(holes.join(inside, contours.RING, "left_semi"))


def vector_extrusion(points: DataFrame, height: float, limits: dict[str, float] | None = None, epsilon: float = 0.01, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(faces, report): prisms of ``height`` over the rings' insides, one row of the report per image.

    Rings may say by ``hole`` what they are; else nesting decides.  ``limits`` clean the polygons first.
    Images whose mesh has edges that not exactly two faces use are tried again with their outlines
    moved out and back by ``epsilon``; backend tells which way an image went, reason why none did.
    """
    images = written((points if images is None else images).select("image_id").distinct(), "extruded-images")
    rings = with_known_holes(points) if "hole" in points.columns else points
    if limits is None:
        found = polygons.spans(rings)
        outline = polygons.outlines(found)
    else:
        found, outline, _ = printable(rings, limits)
    faces = written(polygons.extruded(found, outline), "faces")
    report = written(polygons.mesh_report(faces, height), "mesh-report")
    bad = written(report.where("not watertight").select("image_id"), "unsafe")
    repaired, again = closed(met(polygons.rings(outline), bad, "image_id", "left_semi"), epsilon, quarter=1)
    mended = written(polygons.extruded(repaired, again), "mended-faces")
    second = written(polygons.mesh_report(mended, height), "mended-report")
    safe = second.where("watertight")
    good = report.where("watertight").withColumn("backend", F.lit("vector_extrusion")).unionByName(safe.withColumn("backend", F.lit("vector_extrusion_repaired")))
    why = met(report.where("not watertight"), safe.select("image_id"), "image_id", "left_anti").select("image_id", F.concat(F.lit("edges open "), F.col("open_edges"), F.lit(", overused "), F.col("overused_edges")).alias("unsafe"))
    out = met(met(images, good, "image_id", "left"), why, "image_id", "left")
    reason = F.when(F.col("backend").isNull(), F.coalesce("unsafe", F.lit("no polygon is left")))
    kept = met(faces, report.where("watertight").select("image_id"), "image_id", "left_semi").unionByName(met(mended, safe.select("image_id"), "image_id", "left_semi"))
    return kept, out.withColumn("reason", reason).drop("unsafe")
