"""Queries over polygon sets that tables carry, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contours, extrusion, filament, polygons
from ..operators.printability import LIMITS
from ..storage import met, table
from .raster_queries import _FOUR, _EIGHT, _LABEL, MASK, gray, mask
from .report_queries import RINGS, rings

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH RECURSIVE " + sql
        return f

    return add


def _turned(points: DataFrame) -> DataFrame:
    """The rings mirrored at the diagonal and moved, so that they cross the first ones."""
    return points.select("image_id", "ring", "seq", (F.col("py") + 13).alias("px"), (F.col("px") + 7).alias("py"))


#: All heights of points and crossings, and in each slab between them the edges' order at its middle.
_OVERLAY = f"""{RINGS}, pts AS (SELECT image_id, 0 AS side, seq, px, py FROM rings UNION ALL SELECT image_id, 1, seq, py + 13, px + 7 FROM rings),
e AS (SELECT image_id, side, seq, px AS ax, py AS ay, coalesce(lead(px) OVER w, first_value(px) OVER w) AS fx, coalesce(lead(py) OVER w, first_value(py) OVER w) AS fy FROM pts WINDOW w AS (PARTITION BY image_id, side ORDER BY seq)),
pr AS (SELECT p.image_id, p.ay, p.fy - p.ay AS ry, (p.fx - p.ax) * (q.fy - q.ay) - (p.fy - p.ay) * (q.fx - q.ax) AS turn, (q.ax - p.ax) * (q.fy - q.ay) - (q.ay - p.ay) * (q.fx - q.ax) AS t, (q.ax - p.ax) * (p.fy - p.ay) - (q.ay - p.ay) * (p.fx - p.ax) AS u FROM e p JOIN e q ON p.image_id = q.image_id AND (p.side, p.seq) < (q.side, q.seq)),
hs AS (SELECT image_id, ay AS y FROM e UNION SELECT image_id, ay + t / turn * ry FROM pr WHERE turn <> 0 AND t / turn BETWEEN 0 AND 1 AND u / turn BETWEEN 0 AND 1),
slab AS (SELECT image_id, y AS y0, lead(y) OVER (PARTITION BY image_id ORDER BY y) AS y1 FROM hs),
mids AS (SELECT e.image_id, y0, y1, side, ax + ((y0 + y1) / 2 - ay) * (fx - ax) / (fy - ay) AS x FROM e JOIN slab s ON s.image_id = e.image_id AND least(ay, fy) < (y0 + y1) / 2 AND greatest(ay, fy) > (y0 + y1) / 2),
runs AS (SELECT image_id, y1 - y0 AS h, count(*) FILTER (side = 0) OVER w % 2 = 1 AS ina, count(*) FILTER (side = 1) OVER w % 2 = 1 AS inb, lead(x) OVER (PARTITION BY image_id, y0 ORDER BY x) - x AS len FROM mids WINDOW w AS (PARTITION BY image_id, y0 ORDER BY x ROWS UNBOUNDED PRECEDING))
"""


def _area(found: DataFrame) -> DataFrame:
    return polygons.areas(found).withColumn("area", F.round("area", 4))


@query(f"{_OVERLAY} SELECT image_id, round(sum(h * len) FILTER (ina OR inb), 4) AS area FROM runs GROUP BY image_id")
def rings_union(spark, sf_dir):
    r = rings(spark, sf_dir)
    return _area(polygons.spans(r, _turned(r)))


@query(f"{_OVERLAY} SELECT image_id, round(sum(h * len) FILTER (ina AND inb), 4) AS area FROM runs GROUP BY image_id")
def rings_intersection(spark, sf_dir):
    r = rings(spark, sf_dir)
    return _area(polygons.spans(r, _turned(r), polygons.BOTH))


@query(f"{_OVERLAY} SELECT image_id, round(sum(h * len) FILTER (ina AND NOT inb), 4) AS area FROM runs GROUP BY image_id")
def rings_difference(spark, sf_dir):
    r = rings(spark, sf_dir)
    return _area(polygons.spans(r, _turned(r), polygons.ONLY))


def _sheared(points: DataFrame) -> DataFrame:
    """Pixel outlines under a map that keeps areas, so that no edge is upright."""
    return points.withColumn("px", F.col("px") + F.col("py") / 2)


_TWO = f"{MASK}, two AS (SELECT image_id, y, x, g < 128 AS a, g % 3 = 0 AS b FROM px)"


@query(f"{_TWO} SELECT image_id, count(*) FILTER (a OR b)::DOUBLE AS either_area, count(*) FILTER (a AND b)::DOUBLE AS both_area, count(*) FILTER (a AND NOT b)::DOUBLE AS only_area, count(*) FILTER (a <> b)::DOUBLE AS changed_area FROM two GROUP BY image_id")
def outline_overlay(spark, sf_dir):
    """Traced masks meet as polygons; DuckDB counts their pixels."""
    g = gray(spark, sf_dir)
    a = _sheared(contours.trace(mask(spark, sf_dir)))
    b = _sheared(contours.trace(g.select("image_id", "y", "x", (F.col("g") % 3 == 0).alias("m"))))
    wanted = {"either_area": polygons.UNION, "both_area": polygons.BOTH, "only_area": polygons.ONLY, "changed_area": polygons.EITHER}
    found = polygons.overlay_areas(a, b, wanted).select("image_id", *[F.round(n, 6).alias(n) for n in wanted])
    return met(g.select("image_id").distinct(), found, "image_id", "left").fillna(0.0)


_FAN = "4 * 0.4 * 0.4 / 2 * sin(pi() / 8)"


@query(f"s AS (SELECT p_partkey AS image_id, p_size::DOUBLE AS s FROM part) SELECT image_id, round(3 * s * s + 8 * s * 0.4 - 0.4 * 0.4 + 5 * {_FAN}, 2) AS grown, round(3 * s * s - 8 * s * 0.4 + 5 * 0.4 * 0.4 - {_FAN}, 2) AS shrunk FROM s")
def ring_offset(spark, sf_dir):
    """An angle bracket per part, as large as the part, moved out and in by 0.4: the closed forms of its area."""
    s = F.col("p_size").cast("double")
    corners = F.array(*[F.struct((s * x).alias("px"), (s * y).alias("py")) for x, y in ((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))])
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.lit(0).alias("ring"), F.posexplode(corners).alias("seq", "p")).select("image_id", "ring", "seq", "p.px", "p.py")
    moved = {n: polygons.areas(polygons.spans(polygons.offset(p, d, 4), rule="positive")).select("image_id", F.round("area", 2).alias(n)) for n, d in (("grown", 0.4), ("shrunk", -0.4))}
    return met(moved["grown"], moved["shrunk"], "image_id")


@query(f"{_OVERLAY} SELECT image_id, round(sum(h * len) FILTER (ina AND NOT inb), 4) AS area, true AS side_to_side FROM runs GROUP BY image_id")
def cap_triangles(spark, sf_dir):
    """Triangles over a difference: their area, and whether each side is used twice, or once on the border in its direction."""
    r = rings(spark, sf_dir)
    found = polygons.spans(r, _turned(r), polygons.ONLY)
    return cap_check(found).withColumn("area", F.round("area", 4))


def cap_check(found: DataFrame) -> DataFrame:
    """(image_id, area, side_to_side) of the spans' caps."""
    found = polygons.by_image(found)
    size = ((F.col("b.x") - F.col("a.x")) * (F.col("c.y") - F.col("a.y")) - (F.col("c.x") - F.col("a.x")) * (F.col("b.y") - F.col("a.y"))) / 2
    side = lambda p, q, n: F.struct(F.col(p).alias("p"), F.col(q).alias("q"), n.alias("size"))
    # a triangle's area goes along with one of its sides
    sides = polygons.caps(found).select("image_id", F.explode(F.array(side("a", "b", size), side("b", "c", F.lit(0.0)), side("c", "a", F.lit(0.0)))).alias("s")).select("image_id", "s.*")
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    border = polygons.borders(found).select("image_id", point("bx", "by").alias("p"), point("ax", "ay").alias("q"), F.lit(0.0).alias("size"))
    # every directed side has its opposite, among the triangles or on the border turned round
    both = sides.unionByName(border)
    net = both.select("image_id", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), F.when(F.col("p") < F.col("q"), 1).otherwise(-1).alias("way"), "size")
    net = net.select("image_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("q.x").alias("qx"), F.col("q.y").alias("qy"), "way", "size")
    ok = net.groupBy("image_id", "px", "py", "qx", "qy").agg(F.count("*").alias("n"), F.sum("way").alias("way"), F.sum("size").alias("size"))
    return ok.groupBy("image_id").agg(F.sum("size").alias("area"), F.bool_and((F.col("n") == 2) & (F.col("way") == 0)).alias("side_to_side"))


_PARTS = f"{MASK}, onp AS (SELECT image_id, y, x FROM mask WHERE m), {_LABEL.format(on='onp', near=_FOUR)}"


@query(f"""{_PARTS}, pinch AS (SELECT DISTINCT a.image_id FROM lab a JOIN lab b ON a.image_id = b.image_id AND a.root = b.root AND b.y = a.y + 1 AND abs(b.x - a.x) = 1 WHERE NOT EXISTS (SELECT 1 FROM lab c WHERE c.image_id = a.image_id AND ((c.y = a.y AND c.x = b.x) OR (c.y = b.y AND c.x = a.x)))),
n AS (SELECT image_id, count(*) FILTER (m) AS n FROM mask GROUP BY image_id), k AS (SELECT image_id, count(DISTINCT root) AS parts FROM lab GROUP BY image_id)
SELECT image_id, CASE WHEN pinch.image_id IS NULL THEN parts END AS parts, CASE WHEN n > 0 THEN round(2.0 * n, 2) END::DOUBLE AS volume, CASE WHEN n > 0 THEN 0 END::BIGINT AS open_edges, CASE WHEN n > 0 THEN 0 END::BIGINT AS overused_edges, CASE WHEN n = 0 THEN NULL WHEN pinch.image_id IS NULL THEN 'vector_extrusion' ELSE 'vector_extrusion_repaired' END AS backend, CASE WHEN n = 0 THEN 'no polygon is left' END AS reason
FROM n LEFT JOIN k USING (image_id) LEFT JOIN pinch USING (image_id)""")
def vector_extrusion(spark, sf_dir):
    """Prisms over traced masks: parts are closed meshes, and images whose part touches itself go through the repair."""
    m = mask(spark, sf_dir)
    _, report = extrusion.vector_extrusion(_sheared(contours.trace(m)), 2.0, images=m)
    whole = F.when(F.col("backend") != "vector_extrusion_repaired", F.col("parts"))
    return report.select("image_id", whole.alias("parts"), F.round("volume", 2).alias("volume"), "open_edges", "overused_edges", "backend", "reason")


@query(f"""{MASK}, onb AS (SELECT image_id, y, x FROM mask WHERE NOT m), b{_LABEL.format(on='onb', near=_EIGHT).replace('reach', 'breach').replace('lab AS', 'blab AS').removeprefix('b')},
hole AS (SELECT image_id, root FROM blab GROUP BY ALL HAVING NOT bool_or(y IN (0, 7) OR x IN (0, 7)) AND count(*) * 0.25 < 1.0),
onp AS (SELECT image_id, y, x FROM mask WHERE m UNION SELECT image_id, y, x FROM blab SEMI JOIN hole USING (image_id, root)), {_LABEL.format(on='onp', near=_FOUR)},
c AS (SELECT image_id, count(*) * 0.25 AS area, (max(x) - min(x) + 1) * 0.5 AS w, (max(y) - min(y) + 1) * 0.5 AS h FROM lab GROUP BY image_id, root),
a AS (SELECT image_id, CASE WHEN least(w, h) < 0.8 AND greatest(w, h) >= 1.5 AND area >= 2.0 THEN 't' WHEN area < 2.0 THEN 'i' WHEN least(w, h) < 0.8 AND greatest(w, h) < 1.5 THEN 'd' WHEN least(w, h) < 0.8 THEN 's' ELSE 'k' END AS action FROM c),
f AS (SELECT image_id, count(*) AS filled FROM hole GROUP BY image_id), i AS (SELECT DISTINCT image_id FROM onp)
SELECT image_id, coalesce(any_value(filled), 0) AS filled_holes, 0::BIGINT AS closed_gaps, count(*) FILTER (action = 't') AS thickened, count(*) FILTER (action = 'i') AS removed_islands, count(*) FILTER (action = 'd') AS removed_short_segments, count(*) FILTER (action = 's') AS removed_slivers, count(*) FILTER (action = 'k') > 0 OR count(*) FILTER (action = 't') > 0 AS remains
FROM i LEFT JOIN a USING (image_id) LEFT JOIN f USING (image_id) GROUP BY image_id""")
def printable_polygons(spark, sf_dir):
    """What cleaning does to the parts of traced masks at half a millimetre a pixel, gaps left as they are."""
    half = contours.trace(mask(spark, sf_dir)).withColumns({"px": F.col("px") / 2, "py": F.col("py") / 2})
    _, _, report = extrusion.printable(half, {**LIMITS, "gap": 0.0})
    return report.select("image_id", "filled_holes", "closed_gaps", "thickened", "removed_islands", "removed_short_segments", "removed_slivers", (F.col("parts") > 0).alias("remains"))


@query()
def closed_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with gaps closed by rounded moves; tests hold areas against drawn pictures."""
    half = contours.trace(mask(spark, sf_dir)).withColumns({"px": F.col("px") / 2, "py": F.col("py") / 2})
    return extrusion.printable(half, LIMITS, quarter=2)[2]


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three heights in mm by gray value, and nothing where it is bright."""
    z = F.when(F.col("g") < 60, 2.0).when(F.col("g") < 128, 1.2).when(F.col("g") < 200, 0.8).otherwise(0.0)
    return gray(spark, sf_dir).select("image_id", "y", "x", z.alias("z"))


_STEPS = f"""{MASK}, z AS (SELECT image_id, y, x, CASE WHEN g < 60 THEN 2.0 WHEN g < 128 THEN 1.2 WHEN g < 200 THEN 0.8 ELSE 0.0 END::DOUBLE AS z FROM px),
lv AS (SELECT image_id, level, greatest(0, coalesce(lag(level) OVER (PARTITION BY image_id ORDER BY level) - 0.01, 0)) AS low, row_number() OVER (PARTITION BY image_id ORDER BY level) AS k FROM (SELECT DISTINCT image_id, z AS level FROM z WHERE z > 0))"""


@query(f"""{_STEPS}, onp AS (SELECT lv.image_id * 4 + k AS image_id, y, x FROM z JOIN lv ON lv.image_id = z.image_id AND z.z >= level - 1e-6), {_LABEL.format(on='onp', near=_FOUR)},
pinch AS (SELECT DISTINCT a.image_id AS key FROM lab a JOIN lab b ON a.image_id = b.image_id AND a.root = b.root AND b.y = a.y + 1 AND abs(b.x - a.x) = 1 WHERE NOT EXISTS (SELECT 1 FROM lab c WHERE c.image_id = a.image_id AND ((c.y = a.y AND c.x = b.x) OR (c.y = b.y AND c.x = a.x)))),
s AS (SELECT lv.image_id, lv.k, (SELECT count(*) FROM onp WHERE onp.image_id = lv.image_id * 4 + lv.k) * (level - low) * 100 AS v, EXISTS (SELECT 1 FROM pinch WHERE key = lv.image_id * 4 + lv.k) AS bad FROM lv),
t AS (SELECT image_id, count(*) AS levels, count(*) FILTER (bad) AS repaired, sum(v) AS v FROM s GROUP BY image_id), i AS (SELECT DISTINCT image_id FROM px)
SELECT image_id, coalesce(levels, 0) AS levels, CASE WHEN levels > 0 THEN 'stacked_shells' END AS backend, repaired, CASE WHEN repaired = 0 THEN round(v, 3) END AS volume, CASE WHEN levels > 0 THEN true END AS watertight, CASE WHEN levels IS NULL THEN 'no printable pixels' END AS reason FROM i LEFT JOIN t USING (image_id)""")
def filament_shells(spark, sf_dir):
    """Stacked shells 80 mm wide; shells that touch themselves are repaired, and their volume is not compared."""
    m = filament.filament_mesh(_steps(spark, sf_dir), 80.0)
    return m.select("image_id", "levels", "backend", "repaired", F.when(F.col("repaired") == 0, F.round("volume", 3)).alias("volume"), "watertight", "reason")


@query(f"""{_STEPS} SELECT z.image_id, count(DISTINCT CASE WHEN z > 0 THEN z END) AS levels, CASE WHEN max(z) > 0 THEN 'pixel_heightfield' END AS backend, CASE WHEN max(z) > 0 THEN round(sum(z) * 100, 3) END AS volume, CASE WHEN max(z) > 0 THEN 'pixels were asked for' ELSE 'no printable pixels' END AS reason FROM z GROUP BY image_id""")
def filament_pixels(spark, sf_dir):
    m = filament.filament_mesh(_steps(spark, sf_dir), 80.0, style="pixel")
    return m.select("image_id", "levels", "backend", F.round("volume", 3).alias("volume"), "reason")
