"""Jobs of all modes over a table of images: checked, dispatched by mode, reported in one relation.

A job that cannot go on becomes an error row that names its stage, and leaves the others
alone: checks are joins and counts per image before any geometry, every mode works on the
images that passed, and what a mode cannot make comes back as a row without a backend.  The
report is the union of the modes' rows and the error rows, one row per job, and is written
once, partitioned by mode and status.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..storage import written
from . import contours, extrusion, filament, masks, meshes, metrics, neighbourhood, regions
from .masks import KEY

RELIEFS = tuple(meshes.PRODUCT_HEIGHT)
MODES = (*RELIEFS, "lithophane", "filament_swap_relief")
#: The ways to make a relief's mesh that a job may ask for.
BACKENDS = ("auto_vector_first", "vector_extrusion", "raster_heightfield")
COLUMNS = ("backend string", "fallback_used boolean", "reason string", "stage string", "error string", "faces long", "volume double", "watertight boolean")


def job_errors(jobs: DataFrame, pixels: DataFrame) -> DataFrame:
    """(image_id, stage, error): jobs that cannot start, by the first check that fails."""
    image = pixels.groupBy("image_id").agg(
        F.count("*").alias("n"), ((F.max("x") + 1) * (F.max("y") + 1)).alias("area"), F.count_distinct("y", "x").alias("places"), F.min(F.least("x", "y")).alias("first"),
        F.max(F.coalesce(~(F.least("r", "g", "b", "a") >= 0) | (F.greatest("r", "g", "b", "a") > 255), F.lit(True)) | F.col("r").isNull() | F.col("g").isNull() | F.col("b").isNull() | F.col("a").isNull()).alias("odd"),
    )
    per = jobs.groupBy("image_id").agg(F.count("*").alias("jobs"), F.first("mode").alias("mode"), F.first("backend").alias("backend")).join(image, "image_id", "left")
    relief = F.col("mode").isin(*RELIEFS)
    rules = [
        ("config", F.col("jobs") > 1, "the image has several jobs"),
        ("config", F.col("mode").isNull() | ~F.col("mode").isin(*MODES), "the mode is unknown"),
        ("config", relief & (F.col("backend").isNull() | ~F.col("backend").isin(*BACKENDS)), "the backend is unknown"),
        ("decode", F.col("n").isNull(), "the image has no pixels"),
        ("decode", (F.col("n") != F.col("places")) | (F.col("places") != F.col("area")) | (F.col("first") < 0), "pixels are missing or repeated"),
        ("decode", F.col("odd"), "a channel is not between 0 and 255"),
    ]
    first = F.coalesce(*[F.when(c, F.struct(F.lit(s).alias("stage"), F.lit(e).alias("error"))) for s, c, e in rules])
    return per.select("image_id", first.alias("e")).where("e is not null").select("image_id", "e.*")


def artwork_mask(rgba: DataFrame, smooth: bool = True, least_area: int = 4) -> DataFrame:
    """The raw foreground; smoothed, and without small components, if asked for."""
    r, g, b, a = (F.col(c) for c in "rgba")
    raw = masks.raw_mask(rgba, color.dark_detail(color.luma(r, g, b), color.visible(a)), color.saturated(r, g, b), color.visible(a))
    return regions.remove_small(neighbourhood.median3(raw), least_area) if smooth else raw


def palette_heights(rgba: DataFrame, colors: int = 4, base_mm: float = 0.8, step_mm: float = 0.4) -> DataFrame:
    """(.., z): each visible pixel at the height of its palette color, from dark to light."""
    labels = metrics.kmeans_palette(rgba.select(*KEY, "r", "g", "b"), colors).select("image_id", "r", "g", "b", "label")
    z = F.when(F.col("a") > 20, base_mm + F.col("label") * step_mm).otherwise(0.0)
    return rgba.join(labels, ["image_id", "r", "g", "b"]).select(*KEY, z.alias("z"))


def _reliefs(jobs: DataFrame, pixels: DataFrame, width_mm: float, smooth: bool, limits: dict[str, float] | None) -> DataFrame:
    """Vector prisms where they are asked for and come out closed, pixel boxes elsewhere, with the reason."""
    mask = written(artwork_mask(pixels, smooth), "job-mask")
    size = mask.groupBy("image_id").agg((F.max("x") + 1).alias("width"), F.count_if("m").alias("on"))
    base = written(jobs.join(size, "image_id"), "relief-jobs")
    full = mask.join(base.where("on > 0").select("image_id"), "image_id", "left_semi")
    vector = base.where("on > 0 and backend <> 'raster_heightfield'").select("image_id")
    _, made = extrusion.vector_extrusion(contours.trace(full.join(vector, "image_id", "left_semi")), 1.0, limits, images=vector)
    made = written(made.select("image_id", F.col("backend").alias("vector"), F.col("reason").alias("vector_reason"), F.col("faces").alias("v_faces"), F.col("volume").alias("v_volume")), "vector-report")
    boxes = full.join(made.where("vector is not null").select("image_id"), "image_id", "left_anti")
    faces = meshes.relief_faces(boxes)
    raster = faces.groupBy("image_id").agg(F.count("*").alias("r_faces")).join(meshes.edge_report(faces).select("image_id", F.col("watertight").alias("r_watertight")), "image_id")
    out = base.join(made, "image_id", "left").join(raster, "image_id", "left")
    high = F.lit(1.2) + F.element_at(F.create_map(*[F.lit(v) for p in meshes.PRODUCT_HEIGHT.items() for v in p]), F.col("mode"))
    scale = F.lit(float(width_mm)) / F.col("width")
    by_vector, empty = F.col("vector").isNotNull(), F.col("on") == 0
    return out.select(
        "image_id", "mode", F.when(by_vector, F.col("vector")).when(~empty, "raster_heightfield").alias("backend"),
        (~by_vector & ~empty & (F.col("backend") != "raster_heightfield")).alias("fallback_used"), F.when(~by_vector, F.col("vector_reason")).alias("reason"),
        F.when(empty, "mask").alias("stage"), F.when(empty, "the artwork is empty").alias("error"), F.coalesce("v_faces", "r_faces").alias("faces"),
        F.when(~empty, F.coalesce("v_volume", F.col("on").cast("double")) * scale * scale * high).alias("volume"), F.when(by_vector, True).otherwise(F.col("r_watertight")).alias("watertight"),
    )


def _lithophanes(jobs: DataFrame, pixels: DataFrame, width_mm: float) -> DataFrame:
    """Closed height fields; the volume is that of each pixel's box."""
    cells = written(meshes.thickness(pixels.select(*KEY, color.luma(F.col("r"), F.col("g"), F.col("b")).alias("g"))), "thickness")
    report = meshes.lithophane_report(cells, width_mm)
    body = cells.groupBy("image_id").agg(F.sum("mm").alias("mm"))
    scale = F.lit(float(width_mm)) / F.col("width")
    return jobs.join(report, "image_id").join(body, "image_id").select("image_id", "mode", F.lit("lithophane_heightfield").alias("backend"), F.lit(False).alias("fallback_used"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("error"), F.col("face_count").alias("faces"), (F.col("mm") * scale * scale).alias("volume"), "watertight")


def _filaments(jobs: DataFrame, pixels: DataFrame, width_mm: float, heights: Callable[[DataFrame], DataFrame]) -> DataFrame:
    made = filament.filament_mesh(heights(pixels), width_mm)
    none = F.col("m_backend").isNull()
    return jobs.join(made.withColumnRenamed("backend", "m_backend"), "image_id").select("image_id", "mode", F.col("m_backend").alias("backend"), (F.col("m_backend") == "pixel_heightfield").alias("fallback_used"), F.when(~none, F.col("reason")).alias("reason"), F.when(none, "mesh").alias("stage"), F.when(none, F.col("reason")).alias("error"), "faces", "volume", "watertight")


def run_jobs(jobs: DataFrame, pixels: DataFrame, width_mm: float = 80.0, smooth: bool = True, limits: dict[str, float] | None = None, heights: Callable[[DataFrame], DataFrame] = palette_heights) -> DataFrame:
    """One row per image of ``jobs`` (image_id, mode, backend) over ``pixels`` (image_id, y, x, r, g, b, a).

    Columns: image_id, mode, backend, fallback_used, reason (of a fallback), stage and error (of a failure),
    faces, volume in mm3, watertight, status.  ``heights`` makes a height map of filament jobs.
    """
    own = jobs.select("image_id", "mode", "backend")
    px = pixels.select(*KEY, "r", "g", "b", "a")
    errors = written(job_errors(own, px), "job-errors")
    good = written(own.join(errors, "image_id", "left_anti"), "good-jobs")
    branches = {"relief": F.col("mode").isin(*RELIEFS), "lithophane": F.col("mode") == "lithophane", "filament": F.col("mode") == "filament_swap_relief"}
    parts = []
    for name, condition in branches.items():
        mine = good.where(condition)
        if mine.limit(1).count() == 0:
            continue
        of = px.join(mine.select("image_id"), "image_id", "left_semi")
        parts.append(_reliefs(mine, of, width_mm, smooth, limits) if name == "relief" else _lithophanes(mine, of, width_mm) if name == "lithophane" else _filaments(mine, of, width_mm, heights))
    failed = errors.join(own.groupBy("image_id").agg(F.first("mode").alias("mode")), "image_id")
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in COLUMNS}
    out = failed.select("image_id", "mode", *[(F.col(c) if c in ("stage", "error") else F.lit(False) if c == "fallback_used" else v).alias(c) for c, v in none.items()])
    for part in parts:
        out = out.unionByName(part.select("image_id", "mode", *[F.col(c.split()[0]).cast(c.split()[1]) for c in COLUMNS]))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("fallback_used") | ~F.coalesce("watertight", F.lit(False)), "warning").otherwise("done")
    return out.withColumn("status", status)


def save_jobs(report: DataFrame, folder: str) -> None:
    """One write of all rows, a folder per mode and status; rows of a run replace those of the run before."""
    report.write.mode("overwrite").partitionBy("mode", "status").parquet(folder)
