"""Queries over the small images that ``embeddings`` carries, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import layers, masks, meshes, metrics, neighbourhood, regions
from ..sources import rasters
from ..storage import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Pixels of the carried images, and color channels derived from them.
PX = "px AS (SELECT vec_id AS image_id, ((pos - 1) // 8)::INT AS y, ((pos - 1) % 8)::INT AS x, least(255, greatest(0, floor((v::DOUBLE + 0.55) * 255 / 1.1)))::INT AS g FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings))"
RGB = PX + ", rgb AS (SELECT image_id, y, x, g AS r, (g * 3 + x * 16) % 256 AS gg, (255 - g + y * 8) % 256 AS b, CASE WHEN g % 16 = 0 THEN 10 ELSE 255 END AS a FROM px)"
MASK = PX + ", mask AS (SELECT image_id, y, x, g < 128 AS m FROM px)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = "WITH RECURSIVE " + sql
        return f

    return add


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.embedding_images(table(spark, sf_dir, "embeddings"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.embedding_rgb(table(spark, sf_dir, "embeddings"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.threshold(gray(spark, sf_dir))


@query(f"{PX} SELECT image_id, count(*) AS pixels, sum(g)::BIGINT AS total, sum(g * (y * 8 + x))::BIGINT AS weighted, min(g) AS low, max(g) AS high FROM px GROUP BY image_id")
def pixel_scan(spark, sf_dir):
    g = gray(spark, sf_dir)
    return g.groupBy("image_id").agg(F.count("*").alias("pixels"), F.sum("g").alias("total"), F.sum(F.col("g") * (F.col("y") * 8 + F.col("x"))).alias("weighted"), F.min("g").alias("low"), F.max("g").alias("high"))


@query(f"{MASK} SELECT image_id, count(*) FILTER (m) AS on_pixels, count(*) FILTER (NOT m) AS off_pixels FROM mask GROUP BY image_id")
def mask_counts(spark, sf_dir):
    return mask(spark, sf_dir).groupBy("image_id").agg(F.count_if("m").alias("on_pixels"), F.count_if(~F.col("m")).alias("off_pixels"))


@query(f"""{RGB} SELECT image_id, y, x, ((r * 299 + gg * 587 + b * 114 + 500) // 1000)::INT AS luma, CASE WHEN greatest(r, gg, b) = 0 THEN 0 ELSE floor((greatest(r, gg, b) - least(r, gg, b)) * 255 / greatest(r, gg, b)::DOUBLE + 0.5) END::INT AS s,
round(CASE WHEN greatest(r, gg, b) = least(r, gg, b) THEN 0 ELSE (360 + CASE WHEN greatest(r, gg, b) = r THEN (gg - b) * 60.0::DOUBLE / (r - least(gg, b)) WHEN greatest(r, gg, b) = gg THEN 120 + (b - r) * 60.0::DOUBLE / (gg - least(r, b)) ELSE 240 + (r - gg) * 60.0::DOUBLE / (b - least(r, gg)) END) % 360 END, 6) AS hue,
format('#{{:02X}}{{:02X}}{{:02X}}', r, gg, b) AS hex, (r // 64 * 16 + gg // 64 * 4 + b // 64)::INT AS packed,
CASE WHEN greatest(r, gg, b) - least(r, gg, b) < 24 THEN CASE WHEN 0.2126 * r + 0.7152 * gg + 0.0722 * b > 225 THEN 'white' WHEN 0.2126 * r + 0.7152 * gg + 0.0722 * b < 45 THEN 'black' ELSE 'gray' END
WHEN r - greatest(gg, b) > 45 THEN 'red' WHEN gg - greatest(r, b) > 45 THEN 'green' WHEN b - greatest(r, gg) > 45 THEN 'blue' ELSE 'custom color' END AS name FROM rgb""")
def pixel_colors(spark, sf_dir):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return rgb(spark, sf_dir).select("image_id", "y", "x", color.luma(r, g, b).alias("luma"), color.saturation(r, g, b).alias("s"), F.round(color.hue_degrees(r, g, b), 6).alias("hue"), color.hex_color(r, g, b).alias("hex"), color.packed_color(r, g, b).alias("packed"), color.color_name(r, g, b).alias("name"))


_LIN = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_ROOT = "CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE {t} * 7.787 + 16.0 / 116.0 END"


@query(f"""{RGB}, lin AS (SELECT image_id, y, x, {_LIN.format(c="r")} AS lr, {_LIN.format(c="gg")} AS lg, {_LIN.format(c="b")} AS lb FROM rgb),
xyz AS (SELECT image_id, y, x, (lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.950456 AS vx, lr * 0.212671 + lg * 0.715160 + lb * 0.072169 AS vy, (lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.088754 AS vz FROM lin),
f AS (SELECT image_id, y, x, {_ROOT.format(t="vx")} AS fx, {_ROOT.format(t="vy")} AS fy, {_ROOT.format(t="vz")} AS fz FROM xyz)
SELECT image_id, round(avg(116 * fy - 16), 4) AS l, round(avg(500 * (fx - fy)), 4) AS a, round(avg(200 * (fy - fz)), 4) AS b FROM f GROUP BY image_id""")
def lab_means(spark, sf_dir):
    lab = color.lab(F.col("r"), F.col("g"), F.col("b"))
    return rgb(spark, sf_dir).groupBy("image_id").agg(*[F.round(F.avg(c), 4).alias(n) for n, c in lab.items()])


@query(f"""{RGB}, k AS (SELECT *, bool_or(a < 255) OVER (PARTITION BY image_id) AS clear, ((r * 299 + gg * 587 + b * 114 + 500) // 1000) < 128 AND a > 20 AS dark, a > 20 AS seen,
CASE WHEN greatest(r, gg, b) = 0 THEN 0 ELSE floor((greatest(r, gg, b) - least(r, gg, b)) * 255 / greatest(r, gg, b)::DOUBLE + 0.5) END > 35 AND greatest(r, gg, b) > 45 AS sat FROM rgb)
SELECT image_id, count(*) FILTER (CASE WHEN clear THEN seen OR dark ELSE dark OR sat END) AS foreground, any_value(clear) AS has_alpha FROM k GROUP BY image_id""")
def raw_foreground(spark, sf_dir):
    r, g, b, a = (F.col(c) for c in "rgba")
    px = rgb(spark, sf_dir)
    m = masks.raw_mask(px, color.dark_detail(color.luma(r, g, b), color.visible(a)), color.saturated(r, g, b), color.visible(a))
    return m.groupBy("image_id").agg(F.count_if("m").alias("foreground")).join(px.groupBy("image_id").agg((F.min("a") < 255).alias("has_alpha")), "image_id")


@query(f"{PX} SELECT image_id, y, x, 3.0::DOUBLE - g / 255.0::DOUBLE * (3.0::DOUBLE - 0.8::DOUBLE) AS mm FROM px")
def lithophane_thickness(spark, sf_dir):
    return meshes.thickness(gray(spark, sf_dir))


_CORNERS = "SELECT image_id, y + j AS gy, x + i AS gx, {v} FROM {t}, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(j, i)"


@query(f"""{PX}, cells AS (SELECT image_id, y, x, 3.0::DOUBLE - g / 255.0::DOUBLE * (3.0::DOUBLE - 0.8::DOUBLE) AS mm FROM px),
tops AS (SELECT image_id, gy, gx, avg(mm) AS z FROM ({_CORNERS.format(v="mm", t="cells")}) GROUP BY ALL),
v AS (SELECT image_id, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z, 2 * count(*) AS vertex_count FROM tops GROUP BY image_id),
s AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM px GROUP BY image_id)
SELECT image_id, width, height, min_z, max_z, vertex_count, (4 * width * height + 4 * (width + height))::BIGINT AS face_count, ((4 * width * height + 4 * (width + height)) * 3 // 2)::BIGINT AS edges, 0::BIGINT AS open_edges, 0::BIGINT AS overused_edges, true AS watertight FROM s JOIN v USING (image_id)""")
def lithophane_mesh_report(spark, sf_dir):
    r = meshes.lithophane_report(meshes.thickness(gray(spark, sf_dir)))
    return r.select("image_id", "width", "height", F.round("min_z", 6).alias("min_z"), F.round("max_z", 6).alias("max_z"), "vertex_count", "face_count", "edges", "open_edges", "overused_edges", "watertight")


@query(f"{MASK}, d AS (SELECT *, (y + x) % 3 = 0 AS det FROM mask) SELECT image_id, round(sum(CASE WHEN m THEN 1.2 + 1.15 + CASE WHEN det THEN 0.4 ELSE 0 END ELSE 1.2 END), 6)::DOUBLE AS volume, max(CASE WHEN m THEN 1.2 + 1.15 + CASE WHEN det THEN 0.4 ELSE 0 END ELSE 1.2 END)::DOUBLE AS top FROM d GROUP BY image_id")
def relief_heights(spark, sf_dir):
    m = mask(spark, sf_dir).withColumn("det", (F.col("y") + F.col("x")) % 3 == 0)
    z = meshes.relief_heights(m, "keychain", detail="det", mode="raised_details")
    return z.groupBy("image_id").agg(F.round(F.sum("z"), 6).alias("volume"), F.max("z").alias("top"))


_SIDES = "(VALUES ('north', -1, 0), ('south', 1, 0), ('west', 0, -1), ('east', 0, 1)) AS o(side, j, i)"


@query(f"{MASK} SELECT a.image_id, side, count(*) AS n FROM mask a, {_SIDES} WHERE a.m AND NOT EXISTS (SELECT 1 FROM mask b WHERE b.image_id = a.image_id AND b.y = a.y + j AND b.x = a.x + i AND b.m) GROUP BY ALL")
def exposed_sides(spark, sf_dir):
    e = meshes.exposed(mask(spark, sf_dir))
    sides = F.explode(F.array(*[F.when(F.col(s), F.lit(s)) for s in ("north", "south", "west", "east")])).alias("side")
    return e.select("image_id", sides).where("side is not null").groupBy("image_id", "side").agg(F.count("*").alias("n"))


@query(f"""{MASK}, side AS (SELECT a.image_id, a.y, a.x, side FROM mask a, {_SIDES} WHERE a.m AND NOT EXISTS (SELECT 1 FROM mask b WHERE b.image_id = a.image_id AND b.y = a.y + j AND b.x = a.x + i AND b.m)),
onp AS (SELECT image_id, y, x FROM mask WHERE m),
q(image_id, p1, p2, p3, p4) AS (
 SELECT image_id, (x, y, 1), (x, y + 1, 1), (x + 1, y + 1, 1), (x + 1, y, 1) FROM onp UNION ALL SELECT image_id, (x, y, 0), (x + 1, y, 0), (x + 1, y + 1, 0), (x, y + 1, 0) FROM onp
 UNION ALL SELECT image_id, (x, y, 0), (x, y, 1), (x + 1, y, 1), (x + 1, y, 0) FROM side WHERE side = 'north' UNION ALL SELECT image_id, (x + 1, y + 1, 0), (x + 1, y + 1, 1), (x, y + 1, 1), (x, y + 1, 0) FROM side WHERE side = 'south'
 UNION ALL SELECT image_id, (x, y + 1, 0), (x, y + 1, 1), (x, y, 1), (x, y, 0) FROM side WHERE side = 'west' UNION ALL SELECT image_id, (x + 1, y, 0), (x + 1, y, 1), (x + 1, y + 1, 1), (x + 1, y + 1, 0) FROM side WHERE side = 'east'),
e AS (SELECT image_id, p1 AS p, p2 AS q FROM q UNION ALL SELECT image_id, p2, p3 FROM q UNION ALL SELECT image_id, p3, p4 FROM q UNION ALL SELECT image_id, p4, p1 FROM q UNION ALL SELECT image_id, p1, p3 FROM q UNION ALL SELECT image_id, p1, p3 FROM q),
n AS (SELECT image_id, least(p, q) AS p, greatest(p, q) AS q, count(*) AS n FROM e GROUP BY ALL)
SELECT image_id, count(*) AS edges, count(*) FILTER (n = 1) AS open_edges, count(*) FILTER (n > 2) AS overused_edges, count(*) FILTER (n <> 2) AS nonmanifold_edges, count(*) FILTER (n <> 2) = 0 AS watertight FROM n GROUP BY image_id""")
def relief_mesh_edges(spark, sf_dir):
    return meshes.edge_report(meshes.relief_faces(mask(spark, sf_dir)))


def _near(radius: int, how: str, source: str = "mask") -> str:
    return f"SELECT a.image_id, a.y, a.x, {how}(b.m) AS m FROM {source} a JOIN {source} b ON a.image_id = b.image_id AND abs(a.y - b.y) <= {radius} AND abs(a.x - b.x) <= {radius} GROUP BY ALL"


@query(f"{MASK}, e AS ({_near(1, 'bool_and')}), d AS ({_near(1, 'bool_or')}) SELECT e.image_id, e.y, e.x, e.m AS eroded, d.m AS dilated FROM e JOIN d USING (image_id, y, x)")
def erode_dilate(spark, sf_dir):
    m = mask(spark, sf_dir)
    return neighbourhood.erode(m).select(*masks.KEY, F.col("m").alias("eroded")).join(neighbourhood.dilate(m).select(*masks.KEY, F.col("m").alias("dilated")), masks.KEY)


@query(f"{MASK}, a1 AS ({_near(1, 'bool_or')}), a2 AS ({_near(1, 'bool_and', 'a1')}), a3 AS ({_near(1, 'bool_and', 'a2')}), a4 AS ({_near(1, 'bool_or', 'a3')}) SELECT image_id, y, x, m FROM a4")
def close_open(spark, sf_dir):
    return neighbourhood.close_open(mask(spark, sf_dir)).select(*masks.KEY, "m")


@query(f"{MASK}, k AS (SELECT a.image_id, a.y, a.x, sum((b.m)::INT) AS s FROM mask a, (VALUES (-1), (0), (1)) AS j(j), (VALUES (-1), (0), (1)) AS i(i), mask b WHERE b.image_id = a.image_id AND b.y = greatest(0, least(7, a.y + j)) AND b.x = greatest(0, least(7, a.x + i)) GROUP BY ALL) SELECT image_id, y, x, s >= 5 AS m FROM k")
def median3_mask(spark, sf_dir):
    return neighbourhood.median3(mask(spark, sf_dir))


@query(f"{PX}, k AS (SELECT a.image_id, a.y, a.x, list_sort(list(b.g))[5] AS g FROM px a, (VALUES (-1), (0), (1)) AS j(j), (VALUES (-1), (0), (1)) AS i(i), px b WHERE b.image_id = a.image_id AND b.y = greatest(0, least(7, a.y + j)) AND b.x = greatest(0, least(7, a.x + i)) GROUP BY ALL) SELECT * FROM k")
def median3_gray(spark, sf_dir):
    return neighbourhood.median3_gray(gray(spark, sf_dir))


@query(f"{PX}, w AS (SELECT a.image_id, a.y, a.x, sum(b.g * jw * iw) AS s FROM px a, (VALUES (-1, 1), (0, 2), (1, 1)) AS j(j, jw), (VALUES (-1, 1), (0, 2), (1, 1)) AS i(i, iw), px b WHERE b.image_id = a.image_id AND b.y = 7 - abs(7 - abs(a.y + j)) AND b.x = 7 - abs(7 - abs(a.x + i)) GROUP BY ALL) SELECT image_id, y, x, ((s + 8) // 16)::INT AS g FROM w")
def gaussian3(spark, sf_dir):
    return neighbourhood.blur3(gray(spark, sf_dir))


@query(f"{MASK}, e AS ({_near(1, 'bool_and')}) SELECT image_id, y, x, a.m AND NOT e.m AS m FROM mask a JOIN e USING (image_id, y, x)")
def outer_edge(spark, sf_dir):
    return neighbourhood.outer_edge(mask(spark, sf_dir))


_STEP = "0.955::DOUBLE * (greatest(abs(a.y - b.y), abs(a.x - b.x)) - least(abs(a.y - b.y), abs(a.x - b.x))) + 1.3693::DOUBLE * least(abs(a.y - b.y), abs(a.x - b.x))"
_DIST = MASK + f", dist AS (SELECT a.image_id, a.y, a.x, CASE WHEN a.m THEN least(16.0, coalesce(min({_STEP}) FILTER (NOT b.m), 16.0)) ELSE 0 END::DOUBLE AS d FROM mask a JOIN mask b ON a.image_id = b.image_id GROUP BY a.image_id, a.y, a.x, a.m)"


@query(f"{_DIST} SELECT image_id, y, x, round(d, 4) AS d FROM dist")
def chamfer_distance(spark, sf_dir):
    return neighbourhood.distance(mask(spark, sf_dir)).select(*masks.KEY, F.round("d", 4).alias("d"))


@query(f"{_DIST}, w AS (SELECT image_id, CASE WHEN m THEN round(d, 4) END AS d FROM dist JOIN mask USING (image_id, y, x)) SELECT image_id, round(coalesce(avg((d <= 1.5)::INT), 0), 5) AS narrow, round(coalesce(median(d) * 2, 0), 5) AS median_width, round(coalesce(avg((d >= 6)::INT), 0), 5) AS solid FROM w GROUP BY image_id")
def feature_widths(spark, sf_dir):
    return metrics.widths(mask(spark, sf_dir))


_LABEL = "reach AS (SELECT image_id, y * 8 + x AS p, y * 8 + x AS root FROM {on} UNION SELECT r.image_id, r.p, b.y * 8 + b.x FROM reach r JOIN {on} b ON b.image_id = r.image_id AND {near}), lab AS (SELECT image_id, p // 8 AS y, p % 8 AS x, min(root) AS root FROM reach GROUP BY image_id, p)"
_EIGHT = "abs(b.y - r.root // 8) <= 1 AND abs(b.x - r.root % 8) <= 1"
_FOUR = "abs(b.y - r.root // 8) + abs(b.x - r.root % 8) <= 1"
COMP = MASK + ", onp AS (SELECT image_id, y, x FROM mask WHERE m), " + _LABEL.format(on="onp", near=_EIGHT)


@query(f"{COMP} SELECT image_id, concat(root // 8, ':', root % 8) AS comp, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM lab GROUP BY image_id, root")
def component_stats(spark, sf_dir):
    s = regions.stats(regions.components(mask(spark, sf_dir)))
    return s.withColumn("cx", F.round("cx", 6)).withColumn("cy", F.round("cy", 6))


@query(f"{COMP}, big AS (SELECT image_id, y, x, count(*) OVER (PARTITION BY image_id, root) AS area FROM lab) SELECT image_id, y, x, m AND coalesce(area >= 5, false) AS m FROM mask LEFT JOIN big USING (image_id, y, x)")
def remove_small_components(spark, sf_dir):
    return regions.remove_small(mask(spark, sf_dir), 5)


@query(f"{MASK}, onp AS (SELECT image_id, y, x FROM mask WHERE NOT m), {_LABEL.format(on='onp', near=_FOUR)}, h AS (SELECT image_id, y, x, root, bool_or(y IN (0, 7) OR x IN (0, 7)) OVER (PARTITION BY image_id, root) AS open FROM lab) SELECT image_id, y, x, concat(root // 8, ':', root % 8) AS comp FROM h WHERE NOT open")
def holes_interior(spark, sf_dir):
    return regions.holes(mask(spark, sf_dir))


@query(f"{MASK}, onp AS (SELECT image_id, y, x FROM mask WHERE NOT m), {_LABEL.format(on='onp', near=_EIGHT)}, h AS (SELECT image_id, y, x, bool_or(y IN (0, 7) OR x IN (0, 7)) OVER (PARTITION BY image_id, root) AS open, count(*) OVER (PARTITION BY image_id, root) AS area FROM lab) SELECT image_id, y, x, m OR coalesce(NOT open AND area < 3, false) AS m FROM mask LEFT JOIN h USING (image_id, y, x)")
def fill_tiny_holes(spark, sf_dir):
    return regions.fill_holes(mask(spark, sf_dir), most_area=3, connectivity=8)


@query(f"{COMP}, s AS (SELECT *, count(*) OVER (PARTITION BY image_id, root) AS area FROM lab), close AS (SELECT DISTINCT a.image_id, a.root FROM s a JOIN s b ON a.image_id = b.image_id AND a.area < 8 AND b.area >= 8 WHERE {_STEP} <= 2), c AS (SELECT image_id, root, max(area) AS area FROM s GROUP BY ALL) SELECT image_id, concat(root // 8, ':', root % 8) AS comp, area, area >= 8 AS large, area >= 8 OR close.root IS NOT NULL AS kept FROM c LEFT JOIN close USING (image_id, root)")
def island_report(spark, sf_dir):
    return regions.islands(mask(spark, sf_dir), 8, 2.0)


@query(f"{COMP}, a AS (SELECT image_id, root, count(*) AS area FROM lab GROUP BY ALL), i AS (SELECT DISTINCT image_id FROM px) SELECT image_id, count(area) AS components, count(*) FILTER (area >= 24) AS significant, count(*) FILTER (area >= 6 AND area < 24) AS small, count(*) FILTER (area < 6) AS tiny FROM i LEFT JOIN a USING (image_id) GROUP BY image_id")
def component_counts(spark, sf_dir):
    return metrics.component_counts(mask(spark, sf_dir))


LABELS = PX + ", lb AS (SELECT image_id, y, x, (g // 86)::INT AS label FROM px)"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray(spark, sf_dir).select(*masks.KEY, F.expr("cast(g div 86 as int)").alias("label"))


_LREACH = "reach AS (SELECT image_id, label, y * 8 + x AS p, y * 8 + x AS root FROM lb UNION SELECT r.image_id, r.label, r.p, b.y * 8 + b.x FROM reach r JOIN lb b ON b.image_id = r.image_id AND b.label = r.label AND " + _EIGHT + "), lab AS (SELECT image_id, label, p // 8 AS y, p % 8 AS x, min(root) AS root FROM reach GROUP BY image_id, label, p), s AS (SELECT *, count(*) OVER (PARTITION BY image_id, label, root) AS area FROM lab)"
_DEST = f"""{LABELS}, {_LREACH}, low AS (SELECT * FROM s WHERE area < 4), big AS (SELECT * FROM s WHERE area >= 4),
touch AS (SELECT image_id, label, root, target, count(*) AS contact FROM (SELECT DISTINCT a.image_id, a.label, a.root, b.label AS target, b.y, b.x FROM low a JOIN big b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1) GROUP BY ALL),
near AS (SELECT a.image_id, a.label, a.root, b.label AS target, min({_STEP}) AS distance FROM low a JOIN big b ON a.image_id = b.image_id GROUP BY ALL HAVING min({_STEP}) <= 3),
bt AS (SELECT image_id, label, root, min((-contact, target)) AS t FROM touch GROUP BY ALL), bn AS (SELECT image_id, label, root, min((distance, target)) AS n FROM near GROUP BY ALL),
c AS (SELECT image_id, label, root, max(area) AS area FROM low GROUP BY ALL),
dest AS (SELECT image_id, label, root, area, coalesce(t[2], n[2]) AS target, coalesce(-t[1], 0) AS contact, CASE WHEN t IS NOT NULL THEN 1.0 ELSE round(n[1], 4) END::DOUBLE AS distance FROM c LEFT JOIN bt USING (image_id, label, root) LEFT JOIN bn USING (image_id, label, root))"""


@query(f"{_DEST} SELECT image_id, label, concat(root // 8, ':', root % 8) AS comp, area, target, contact, distance FROM dest")
def merge_nearest_region(spark, sf_dir):
    return regions.merge_destinations(labels(spark, sf_dir), 4, 3).withColumn("distance", F.round("distance", 4))


@query(f"{_DEST} SELECT s.image_id, s.y, s.x, CASE WHEN dest.root IS NULL THEN s.label WHEN target IS NOT NULL THEN target END AS label, CASE WHEN dest.root IS NULL THEN 'kept' WHEN target IS NOT NULL THEN 'merged' ELSE 'removed' END AS action FROM s LEFT JOIN dest USING (image_id, label, root)")
def island_policy_merge(spark, sf_dir):
    return regions.apply_island_policy(labels(spark, sf_dir), "merge", 4, 3)


@query(f"{MASK}, g1 AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM mask WHERE m), r AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1 FROM g1 GROUP BY image_id, y, k), g2 AS (SELECT *, y - row_number() OVER (PARTITION BY image_id, x0, x1 ORDER BY y) AS k FROM r) SELECT image_id, x0, min(y) AS y0, x1 + 1 AS x1, max(y) + 1 AS y1 FROM g2 GROUP BY image_id, x0, g2.x1, k")
def run_rectangles(spark, sf_dir):
    return masks.rectangles(mask(spark, sf_dir))


@query(f"{MASK} SELECT a.image_id, a.y, a.x, a.m AS falling FROM mask a JOIN mask b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x + 1 JOIN mask c ON c.image_id = a.image_id AND c.y = a.y + 1 AND c.x = a.x JOIN mask d ON d.image_id = a.image_id AND d.y = a.y + 1 AND d.x = a.x + 1 WHERE (a.m AND d.m AND NOT b.m AND NOT c.m) OR (b.m AND c.m AND NOT a.m AND NOT d.m)")
def diagonal_contacts(spark, sf_dir):
    return neighbourhood.diagonal_contacts(mask(spark, sf_dir))


@query(f"{MASK}, other AS (SELECT image_id, y, x, g % 2 = 0 AS o FROM px) SELECT image_id, count(*) FILTER (m AND o) AS kept, count(*) FILTER (m AND NOT o) AS removed, count(*) FILTER (NOT m AND o) AS added, bool_or(m <> o) AS changed FROM mask JOIN other USING (image_id, y, x) GROUP BY image_id")
def mask_changes(spark, sf_dir):
    other = gray(spark, sf_dir).select(*masks.KEY, (F.col("g") % 2 == 0).alias("m"))
    return masks.changes(mask(spark, sf_dir), other)


@query(f"{RGB}, c AS (SELECT image_id, (r // 64 * 16 + gg // 64 * 4 + b // 64)::INT AS packed, count(*) AS n FROM rgb GROUP BY ALL) SELECT image_id, packed, n, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, packed)::INT AS place FROM c QUALIFY place <= 3")
def palette_top3(spark, sf_dir):
    return metrics.top_colors(rgb(spark, sf_dir))


_GROUND = "rim AS (SELECT image_id, label, count(*) AS n FROM lb WHERE y IN (0, 7) OR x IN (0, 7) GROUP BY ALL), ground AS (SELECT image_id, max_by(label, (n, -label)) AS label, max(n) / sum(n)::DOUBLE AS share FROM rim GROUP BY image_id)"
_CHOSEN = f"{LABELS}, {_GROUND}, c0 AS (SELECT image_id, label, count(*) AS n FROM lb GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS kinds FROM c0), k AS (SELECT c.image_id, c.label, c.n FROM c LEFT JOIN ground ON ground.image_id = c.image_id AND share >= 0.45 WHERE kinds < 2 OR ground.label IS NULL OR c.label <> ground.label), chosen AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) <= 3), o AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) - 1)::INT AS ord FROM chosen)"


@query(f"{LABELS}, {_GROUND} SELECT image_id, label, round(share, 6) AS share, share >= 0.6 AS sure FROM ground")
def background_label(spark, sf_dir):
    return layers.background(labels(spark, sf_dir)).withColumn("share", F.round("share", 6))


def _ordered(spark, sf_dir):
    chosen = layers.printable(labels(spark, sf_dir), 3, 1, 0.45)
    return layers.ordered(chosen, -F.col("label"))


@query(f"{_CHOSEN} SELECT image_id, label, n, ord FROM o")
def palette_order(spark, sf_dir):
    return _ordered(spark, sf_dir)


def _plan_sql(base: float, step: float, first: float, layer: float, solid: float | None = None) -> str:
    """The recurrence itself, as a recursive query."""
    z = f"{solid} + (ord + 1) * {step}" if solid is not None else f"{base} + ord * {step}"
    snap = lambda v: f"CASE WHEN {v} <= 0.001 THEN 0 WHEN {v} <= {first} + 0.001 THEN 1 ELSE ceil(({v} - {first} - 0.001) / {layer})::INT + 1 END"
    start = snap(f"{solid}::DOUBLE") if solid is not None else "0"
    top = lambda i: f"CASE WHEN {i} <= 0 THEN 0 ELSE {first} + ({i} - 1) * {layer} END"
    changed = "true" if solid is not None else "ord > 0"
    return f"""w AS (SELECT image_id, label, ord, ({z})::DOUBLE AS wanted FROM o), sn AS (SELECT *, ({snap("wanted")})::INT AS snap FROM w),
rec AS (SELECT image_id, label, ord, wanted, ({start})::INT AS si, greatest(({start})::INT + 1, snap)::INT AS ti FROM sn WHERE ord = 0 UNION ALL SELECT sn.image_id, sn.label, sn.ord, sn.wanted, rec.ti, greatest(rec.ti + 1, sn.snap)::INT FROM rec JOIN sn ON sn.image_id = rec.image_id AND sn.ord = rec.ord + 1),
bands AS (SELECT image_id, ord, label, round(wanted, 4) AS wanted_mm, round(({top("ti")})::DOUBLE, 4) AS top_mm, round(({top("si")})::DOUBLE, 4) AS start_mm, si + 1 AS first_layer, ti AS last_layer, CASE WHEN {changed} THEN si + 1 END AS change_before_layer, abs({top("ti")} - wanted) > 0.001 AS snapped FROM rec)"""


@query(f"{_CHOSEN}, {_plan_sql(0.8, 0.4, 0.28, 0.16)} SELECT * FROM bands")
def layer_plan_snap_up(spark, sf_dir):
    return layers.plan(_ordered(spark, sf_dir), 0.8, 0.4, 0.28, 0.16)


@query(f"{_CHOSEN}, {_plan_sql(0.8, 0.8, 0.2, 0.2, 2.0)} SELECT * FROM bands")
def layer_plan_solid_base(spark, sf_dir):
    return layers.plan(_ordered(spark, sf_dir), step=0.8, solid=2.0)


@query(f"{_CHOSEN}, {_plan_sql(0.8, 0.4, 0.28, 0.16)} SELECT lb.image_id, y, x, coalesce(top_mm, 0) AS z FROM lb LEFT JOIN bands USING (image_id, label)")
def height_map(spark, sf_dir):
    return layers.height_map(labels(spark, sf_dir), layers.plan(_ordered(spark, sf_dir), 0.8, 0.4, 0.28, 0.16))


@query(f"{PX}, h AS (SELECT image_id, g, count(*) AS n FROM px GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS below, sum(n * g) OVER w AS mass, sum(n) OVER (PARTITION BY image_id) AS al, sum(n * g) OVER (PARTITION BY image_id) AS total FROM h WINDOW w AS (PARTITION BY image_id ORDER BY g)), v AS (SELECT image_id, g, round(below * (al - below) * (mass / below - (total - mass) / (al - below)) * (mass / below - (total - mass) / (al - below)), 6) AS b FROM c WHERE below < al) SELECT image_id, coalesce(max_by(g, (b, -g)), 0) AS cut FROM v GROUP BY image_id")
def otsu_threshold(spark, sf_dir):
    return metrics.otsu(gray(spark, sf_dir))


@query(f"""{RGB}, p AS (SELECT image_id, y, x, a, (r * 299 + gg * 587 + b * 114 + 500) // 1000 AS g, min(a) OVER (PARTITION BY image_id) < 255 AS clear FROM rgb), h AS (SELECT image_id, g, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS below, sum(n * g) OVER w AS mass, sum(n) OVER (PARTITION BY image_id) AS al, sum(n * g) OVER (PARTITION BY image_id) AS total FROM h WINDOW w AS (PARTITION BY image_id ORDER BY g)),
v AS (SELECT image_id, g, round(below * (al - below) * (mass / below - (total - mass) / (al - below)) * (mass / below - (total - mass) / (al - below)), 6) AS b FROM c WHERE below < al), o AS (SELECT image_id, coalesce(max_by(g, (b, -g)), 0) AS cut FROM v GROUP BY image_id)
SELECT image_id, y, x, CASE WHEN clear THEN a > 128 ELSE g <= coalesce(cut, 0) END AS m FROM p LEFT JOIN o USING (image_id)""")
def basic_silhouette(spark, sf_dir):
    r, g, b = (F.col(c) for c in "rgb")
    return metrics.basic_silhouette(rgb(spark, sf_dir), color.luma(r, g, b))


@query(f"{PX} SELECT image_id, round((quantile_cont(g, 0.95) - quantile_cont(g, 0.05)) / 255, 5) AS contrast FROM px GROUP BY image_id")
def contrast_quality(spark, sf_dir):
    return metrics.contrast(gray(spark, sf_dir))


@query(f"{PX}, p AS (SELECT image_id, quantile_disc(g, 0.02) AS lo, quantile_disc(g, 0.98) AS hi FROM px GROUP BY image_id) SELECT image_id, y, x, CASE WHEN hi > lo THEN least(255, greatest(0, floor((g - lo) * 255 / (hi - lo)))) ELSE g END::INT AS g FROM px JOIN p USING (image_id)")
def tone_autocontrast(spark, sf_dir):
    return metrics.autocontrast(gray(spark, sf_dir), 2.0)


@query(f"{MASK}, t AS (SELECT image_id, min(y) AS top, max(y) - min(y) + 1 AS tall FROM mask WHERE m GROUP BY image_id), l AS (SELECT image_id, x, max(y) AS low FROM mask WHERE m GROUP BY ALL) SELECT image_id, round(stddev_pop((low - top) / tall::DOUBLE), 5) AS variation FROM l JOIN t USING (image_id) GROUP BY image_id")
def lower_profile(spark, sf_dir):
    return metrics.lower_profile(mask(spark, sf_dir))


@query(f"{RGB}, p AS (SELECT image_id, (r // 86)::INT AS label, count(*) AS n, round(avg(r))::INT AS r, round(avg(gg))::INT AS g, round(avg(b))::INT AS b FROM rgb GROUP BY ALL) SELECT image_id, label, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY image_id), 4) AS share, format('#{{:02X}}{{:02X}}{{:02X}}', r, g, b) AS hex, CASE WHEN greatest(r, g, b) - least(r, g, b) < 24 THEN CASE WHEN 0.2126 * r + 0.7152 * g + 0.0722 * b > 225 THEN 'white' WHEN 0.2126 * r + 0.7152 * g + 0.0722 * b < 45 THEN 'black' ELSE 'gray' END WHEN r - greatest(g, b) > 45 THEN 'red' WHEN g - greatest(r, b) > 45 THEN 'green' WHEN b - greatest(r, g) > 45 THEN 'blue' ELSE 'custom color' END AS name, round(0.2126 * r + 0.7152 * g + 0.0722 * b, 4)::DOUBLE AS light FROM p")
def palette_rows(spark, sf_dir):
    return metrics.palette(rgb(spark, sf_dir).withColumn("label", F.expr("cast(r div 86 as int)")))
