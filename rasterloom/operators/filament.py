"""Meshes of stepped height maps: nested shells of polygons, repaired by degrees, else pixels.

Every height of an image gives a shell, from just below the height before it up to itself,
over the places that reach it.  Shells are rows of one relation under the key "image|number",
so all shells of all images go through an overlay together.  A frontier holds the shells
whose mesh is not closed; each round tries only those again, with the next larger repair.  An
image with a shell that no repair closes gets a pixel mesh, and nothing else does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import met, shared_out, written
from . import contours, extrusion, meshes, polygons
from .masks import KEY

#: Repairs in pixels, tried in turn, and how far a shell reaches into the one below, in mm.
REPAIRS, OVERLAP = (0.0, 0.02, 0.05, 0.1), 0.01
NEAR = 1e-6


def shells(heights: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """(image_id, k, level, low): an image's heights above 0, from 1 on, and where each one's shell begins."""
    order = W.partitionBy("image_id").orderBy("level")
    each = heights.where("z > 0").select("image_id", F.col("z").alias("level")).distinct()
    below = F.lag("level").over(order)
    low = F.when(below.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), below - overlap))
    return each.select("image_id", F.row_number().over(order).alias("k"), "level", low.alias("low"))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("image_id", F.concat_ws("|", F.col("image_id").cast("string"), F.col("k").cast("string")))


def level_rings(heights: DataFrame, found: DataFrame, clean: bool = False, tolerance: float = 0.7) -> DataFrame:
    """Rings around the places that reach each shell's height; ``clean`` smooths them and keeps each within the one below."""
    masks = met(heights.select(*KEY, "z"), found.select("image_id", "k", "level"), "image_id").withColumn("m", F.coalesce(F.col("z") >= F.col("level") - NEAR, F.lit(False)))
    traced = written(contours.trace(_keyed(masks).select(*KEY, "m")), "shell-rings")
    if not clean:
        return traced
    smooth = written(contours.clean_contours(traced, tolerance)[0], "smooth-rings")
    most = found.agg(F.max("k")).first()[0] or 0
    number = F.split_part("image_id", F.lit("|"), F.lit(-1)).cast("int")
    parent = F.concat_ws("|", F.split_part("image_id", F.lit("|"), F.lit(1)), (number + 1).cast("string"))
    below = polygons.rings(polygons.outlines(polygons.spans(smooth.where(number == 1))))
    every = [below.select(*contours.RING, "seq", "px", "py")]
    # a level may only lie on the one before it, so levels are taken in turn, all images at once
    for k in range(2, most + 1):
        both = polygons.spans(smooth.where(number == k), below.withColumn("image_id", parent), polygons.BOTH)
        below = polygons.rings(polygons.outlines(both))
        every.append(below.select(*contours.RING, "seq", "px", "py"))
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return written(out, "nested-rings")


def closed_shells(rings: DataFrame, repairs: tuple[float, ...] = REPAIRS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(faces, report, open): prisms of height 1 that are closed, with the attempt that made them so, and keys that none did."""
    first, directed, faces, safe, left = True, None, None, None, None
    for n, repair in enumerate(repairs, 1):
        if first:
            found = polygons.spans(rings)
            outline = polygons.outlines(found)
            directed = polygons.rings(outline)
        else:
            # a repair is far smaller than a pixel, so two chords a right angle are round enough
            found, outline = extrusion.closed(met(directed, left, "image_id", "left_semi"), repair, quarter=2)
        first = False
        made = written(polygons.extruded(found, outline), "shell-faces")
        report = written(polygons.mesh_report(made, 1.0).withColumn("attempt", F.lit(n)), "shell-report")
        good = report.where("watertight")
        kept = met(made, good.select("image_id"), "image_id", "left_semi")
        faces, safe = (kept, good) if faces is None else (faces.unionByName(kept), safe.unionByName(good))
        left = written(report.where("not watertight").select("image_id"), "open-shells")
        if left.limit(1).count() == 0:
            break
    return faces, safe, left


def pixel_faces(heights: DataFrame) -> DataFrame:
    """(image_id, f): two triangles on top, two below, and two for each piece of a side wall; corners are (x, y, z).

    Flat faces come with the walls, not by a union: Spark 4.1 takes a union of two sides dealt alike as
    dealt, also after it has joined tasks of each side by itself, and an image's rows then meet twice.
    """
    x, y = F.col("x"), F.col("y")
    at = lambda i, j, z: F.struct((x + i).cast("double").alias("x"), (y + j).cast("double").alias("y"), z.cast("double").alias("z"))
    zero, z = F.lit(0.0), F.col("z")
    flat = meshes.quad(at(0, 0, z), at(1, 0, z), at(1, 1, z), at(0, 1, z)) + meshes.quad(at(0, 0, zero), at(0, 1, zero), at(1, 1, zero), at(1, 0, zero))
    ends = {"north": ((0, 0), (1, 0)), "south": ((1, 1), (0, 1)), "west": ((0, 1), (0, 0)), "east": ((1, 0), (1, 1))}
    faces = F.when(F.col("side") == "flat", F.array(*flat))
    for side, (p, q) in ends.items():
        pair = F.array(*meshes.quad(at(*p, F.col("low")), at(*q, F.col("low")), at(*q, F.col("high")), at(*p, F.col("high"))))
        faces = faces.when(F.col("side") == side, pair)
    pieces = meshes.stepped(heights.withColumn("z", F.when(F.col("z") > 0, F.col("z"))), flat=True)
    return pieces.select("image_id", F.explode(faces).alias("f"))


def filament_mesh(heights: DataFrame, width_mm: float, clean: bool = False, style: str = "vector", overlap: float = OVERLAP, repairs: tuple[float, ...] = REPAIRS) -> DataFrame:
    """One row per image of (image_id, y, x, z): levels, backend, attempts, repaired shells, faces, volume in mm3, watertight, reason.

    ``style`` "pixel" makes pixel meshes at once.  An image without a height above 0 has no
    backend and says so; one that falls back says which shells stayed open.
    """
    base = written(heights.select(*KEY, "z"), "height-map")
    sizes = base.groupBy("image_id").agg((F.lit(float(width_mm)) / (F.max("x") + 1)).alias("scale"))
    found = written(shells(base, overlap), "shells")
    count = found.groupBy("image_id").agg(F.count("*").alias("levels"))
    if style == "vector":
        rings = level_rings(base, found, clean)
        _, safe, _ = closed_shells(rings, repairs)
        keyed = met(_keyed(found.withColumn("of", F.col("image_id"))), safe, "image_id", "left")
        tall = F.col("level") - F.col("low")
        shell = keyed.groupBy("of").agg(
            F.min(F.col("attempt").isNotNull()).alias("whole"), F.max("attempt").alias("attempts"), F.count_if(F.col("attempt") > 1).alias("repaired"),
            F.sum("faces").alias("faces"), F.sum(F.col("volume") * tall).alias("volume"),
            F.concat(F.lit("shells that stay open: "), F.array_join(F.array_sort(F.collect_list(F.when(F.col("attempt").isNull(), F.col("k").cast("string")))), ", ")).alias("open"),
        ).withColumnRenamed("of", "image_id")
        shell = written(shell, "shelled")
    else:
        shell = count.select("image_id", F.lit(False).alias("whole"), F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("repaired"), F.lit(None).cast("long").alias("faces"), F.lit(None).cast("double").alias("volume"), F.lit("pixels were asked for").alias("open"))
    fallen = written(shell.where("not whole").select("image_id"), "fallen")
    rest = written(met(base, fallen, "image_id", "left_semi"), "pixel-heights")
    # dealt by image once: faces, edges and volumes are groupings there
    rest = shared_out(rest, rest.count(), "image_id")
    made = meshes.mesh_counts(pixel_faces(rest)).select("image_id", F.col("face_count").alias("p_faces"), F.col("watertight").alias("p_watertight"))
    pixel = met(rest.where("z > 0").groupBy("image_id").agg(F.sum("z").alias("p_volume")), made, "image_id")
    out = met(met(met(sizes, count, "image_id", "left"), shell, "image_id", "left"), pixel, "image_id", "left")
    volume = F.coalesce("p_volume", "volume") * F.col("scale") * F.col("scale")
    return out.select(
        "image_id", F.coalesce("levels", F.lit(0)).alias("levels"),
        F.when(F.col("whole"), "stacked_shells").when(F.col("p_volume").isNotNull(), "pixel_heightfield").alias("backend"),
        "attempts", "repaired", F.coalesce("p_faces", "faces").alias("faces"), volume.alias("volume"), F.when(F.col("whole"), True).otherwise(F.col("p_watertight")).alias("watertight"),
        F.when(F.col("levels").isNull(), "no printable pixels").when(~F.col("whole"), F.col("open")).alias("reason"),
    )
