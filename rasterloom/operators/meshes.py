"""Triangle meshes as relations: faces carry their corners, edges and vertices follow by aggregation.

A corner is a struct (gx, gy, level): grid position and height level, so that equal corners
are equal values and no dictionary of vertices is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import met
from .masks import KEY
from .neighbourhood import along_columns, along_rows

CORNER = "struct<gx:int,gy:int,top:int>"


def corner(gx, gy, top: int) -> Column:
    return F.struct(gx.cast("int").alias("gx"), gy.cast("int").alias("gy"), F.lit(top).alias("top"))


def quad(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    """Two triangles of a quadrilateral, in its turning direction."""
    return [F.struct(a.alias("a"), b.alias("b"), c.alias("c")), F.struct(a.alias("a"), c.alias("b"), d.alias("c"))]


def exposed(mask: DataFrame) -> DataFrame:
    """Mask pixels with the sides that no mask neighbour covers: north, south, west, east."""

    def bare(c: Column) -> Column:
        return ~F.coalesce(c, F.lit(False))

    sides = {"north": bare(F.lag("m").over(along_columns())), "south": bare(F.lead("m").over(along_columns())), "west": bare(F.lag("m").over(along_rows())), "east": bare(F.lead("m").over(along_rows()))}
    return mask.select(*KEY, "m", *[c.alias(n) for n, c in sides.items()]).where("m").drop("m")


def relief_faces(mask: DataFrame) -> DataFrame:
    """(image_id, f): for each mask pixel two triangles on top, two below, and two on each exposed side."""
    x, y = F.col("x"), F.col("y")
    p = {(i, j, t): corner(x + i, y + j, t) for i in (0, 1) for j in (0, 1) for t in (0, 1)}
    top = quad(p[0, 0, 1], p[0, 1, 1], p[1, 1, 1], p[1, 0, 1])
    below = quad(p[0, 0, 0], p[1, 0, 0], p[1, 1, 0], p[0, 1, 0])
    walls = {
        "north": quad(p[0, 0, 0], p[0, 0, 1], p[1, 0, 1], p[1, 0, 0]),
        "south": quad(p[1, 1, 0], p[1, 1, 1], p[0, 1, 1], p[0, 1, 0]),
        "west": quad(p[0, 1, 0], p[0, 1, 1], p[0, 0, 1], p[0, 0, 0]),
        "east": quad(p[1, 0, 0], p[1, 0, 1], p[1, 1, 1], p[1, 1, 0]),
    }
    none = F.array(*top).cast(f"array<struct<a:{CORNER},b:{CORNER},c:{CORNER}>>")
    parts = [F.array(*top, *below), *[F.when(F.col(s), F.array(*w)).otherwise(F.slice(none, 1, 0)) for s, w in walls.items()]]
    return exposed(mask).select("image_id", F.explode(F.concat(*parts)).alias("f"))


def edges(faces: DataFrame) -> DataFrame:
    """(image_id, p, q, n): every edge with the number of faces that use it; hot images are counted before the shuffle."""
    sides = F.array(*[F.struct(F.least(f"f.{u}", f"f.{v}").alias("p"), F.greatest(f"f.{u}", f"f.{v}").alias("q")) for u, v in ("ab", "bc", "ca")])
    return faces.select("image_id", F.explode(sides).alias("e")).groupBy("image_id", "e.p", "e.q").agg(F.count("*").alias("n"))


def edge_report(faces: DataFrame) -> DataFrame:
    """(image_id, edges, open_edges, overused_edges, nonmanifold_edges, watertight)."""
    return mesh_counts(faces).drop("face_count")


def mesh_counts(faces: DataFrame) -> DataFrame:
    """As :func:`edge_report`, with ``face_count``: a face uses three edges, so faces need not be made again to be counted."""
    n = F.col("n")
    # corners count by their hashes of 64 bits, so that edges are 16 bytes wherever they are counted
    at = {c: F.xxhash64(f"f.{c}") for c in "abc"}
    slim = faces.select("image_id", *[h.alias(c) for c, h in at.items()])
    sides = F.array(*[F.struct(F.least(u, v).alias("p"), F.greatest(u, v).alias("q")) for u, v in ("ab", "bc", "ca")])
    used = slim.select("image_id", F.explode(sides).alias("e")).groupBy("image_id", "e.p", "e.q").agg(F.count("*").alias("n"))
    out = used.groupBy("image_id").agg(F.count("*").alias("edges"), F.count_if(n == 1).alias("open_edges"), F.count_if(n > 2).alias("overused_edges"), F.count_if(n != 2).alias("nonmanifold_edges"), F.expr("sum(n) div 3").alias("face_count"))
    return out.withColumn("watertight", F.col("nonmanifold_edges") == 0)


def vertex_heights(cells: DataFrame, value: str, how) -> DataFrame:
    """(image_id, gy, gx, z): each grid corner from the up to four cells around it."""
    corners = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (0, 1) for i in (0, 1)]))
    at = cells.withColumn("o", corners).select("image_id", (F.col("y") + F.col("o.j")).alias("gy"), (F.col("x") + F.col("o.i")).alias("gx"), value)
    return at.groupBy("image_id", "gy", "gx").agg(how(value).alias("z"))


def thickness(gray: DataFrame, least: float = 0.8, most: float = 3.0, invert: bool = False) -> DataFrame:
    """Lithophane thickness in mm: dark pixels are thick."""
    if most <= least:
        raise ValueError("the thickest must be above the thinnest")
    b = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("g") / 255.0))
    b = 1.0 - b if invert else b
    return gray.select(*KEY, (F.lit(most) - b * (most - least)).alias("mm"))


def lithophane_faces(cells: DataFrame) -> DataFrame:
    """All cells on top and below, walls on the image's border only: the relief of a full mask."""
    return relief_faces(cells.select(*KEY, F.lit(True).alias("m")))


def lithophane_report(cells: DataFrame, width_mm: float = 100.0) -> DataFrame:
    """One row per image: size in mm, thickness range, vertices, faces and edge uses."""
    size = cells.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.min("mm").alias("min_cell_mm"), F.max("mm").alias("max_cell_mm"))
    tops = vertex_heights(cells, "mm", F.avg).groupBy("image_id").agg(F.min("z").alias("min_z"), F.max("z").alias("max_z"), (F.count("*") * 2).alias("vertex_count"))
    faces = lithophane_faces(cells)
    joined = met(met(size, tops, "image_id"), mesh_counts(faces), "image_id")
    return joined.withColumn("width_mm", F.lit(width_mm)).withColumn("height_mm", F.lit(width_mm) * F.col("height") / F.col("width"))


#: How much higher each product's relief is.
PRODUCT_HEIGHT = {"flat_relief": 1.0, "keychain": 1.15, "wall_art": 1.6}


def relief_heights(mask: DataFrame, product: str = "flat_relief", base_mm: float = 1.2, relief_mm: float = 1.0, detail: str | None = None, mode: str = "silhouette", detail_mm: float = 0.4, engraving_mm: float = 0.3) -> DataFrame:
    """(.., z): height of each pixel; ``detail``: a boolean column of raised or engraved pixels."""
    high = relief_mm * PRODUCT_HEIGHT.get(product, 1.0)
    z = F.when(F.col("m"), base_mm + high).otherwise(F.lit(base_mm))
    if detail:
        on = F.col(detail) & F.col("m")
        if mode in ("raised_details", "layered_color_relief"):
            z = F.when(on, z + detail_mm).otherwise(z)
        elif mode == "engraved_details":
            z = F.when(on, F.greatest(F.lit(base_mm), F.lit(base_mm + high - engraving_mm))).otherwise(z)
    return mask.select(*KEY, z.alias("z"))


def bounds(vertices: DataFrame) -> DataFrame:
    """(image_id, x0, y0, z0, x1, y1, z1) of (image_id, x, y, z)."""
    return vertices.groupBy("image_id").agg(*[f(c).alias(f"{c}{n}") for n, f in ((0, F.min), (1, F.max)) for c in "xyz"])


def step_walls(heights: DataFrame) -> DataFrame:
    """(image_id, y, x, side, low, high): side walls of a height map, split at every level of the image between."""
    return stepped(heights).select(*KEY, "side", "low", "high")


def stepped(heights: DataFrame, flat: bool = False) -> DataFrame:
    """As :func:`step_walls`, with the pixel's ``z``; ``flat`` adds a row per pixel of side "flat", from 0 up to z.

    Levels are a window, so all rows stay where their image is.
    """

    def beside(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    sides = [F.struct(F.lit(n).alias("side"), beside(c).alias("low")) for n, c in (("north", F.lag("z").over(along_columns())), ("south", F.lead("z").over(along_columns())), ("west", F.lag("z").over(along_rows())), ("east", F.lead("z").over(along_rows())))]
    sides += [F.struct(F.lit("flat").alias("side"), F.lit(0.0).alias("low"))] * flat
    levels = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), F.collect_set("z").over(W.partitionBy("image_id")))))
    bare = heights.withColumns({"s": F.array(*sides), "levels": levels}).where("z is not null and image_id is not null").select(*KEY, "z", "levels", F.explode("s").alias("s")).where("s.low < z")
    cut = bare.withColumn("cuts", F.expr("if(s.side = 'flat', array(s.low, z), filter(levels, l -> l >= s.low and l <= z))"))
    pairs = F.explode(F.expr("arrays_zip(slice(cuts, 1, size(cuts) - 1), slice(cuts, 2, size(cuts) - 1))")).alias("p")
    return cut.select(*KEY, "z", "s.side", pairs).select(*KEY, "z", "side", F.col("p.0").alias("low"), F.col("p.1").alias("high"))
