"""Queries over printability, artwork stages and ring geometry, each with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import artwork, contours, masks, meshes, metrics, presets, printability, regions, reports
from ..storage import dealt, table
from . import raster_queries as R
from .filter_queries import EIGHT, FOUR, labelled
from .raster_queries import _EIGHT, _LABEL, COMP, LABELS, MASK, PX, RGB, gray, labels, mask, rgb
from .report_queries import _RUNS, _TURN, RINGS, around, rings

QUERIES: dict = {}
SQL: dict[str, str] = {}
LIMITS = {"hole_area": 3.0, "gap": 1.0, "island_area": 4.0, "segment": 4.0, "dimension": 2.0, "feature": 2.0}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH RECURSIVE " + sql
        return f

    return add


_ACTION = "CASE WHEN least(w, h) < 2 AND greatest(w, h) >= 4 AND area >= 4 THEN 'thicken' WHEN area < 4 THEN 'area_below_minimum' WHEN least(w, h) < 2 AND greatest(w, h) < 4 THEN 'segment_below_minimum' WHEN least(w, h) < 2 THEN 'sliver_below_minimum_dimension' ELSE 'keep' END"
_ACTIONS = f"{COMP}, st AS (SELECT image_id, root, count(*) AS area, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM lab GROUP BY ALL), act AS (SELECT *, {_ACTION} AS action FROM st)"


@query(f"{_ACTIONS} SELECT image_id, concat(root // 8, ':', root % 8) AS comp, area::DOUBLE AS area_mm2, w::DOUBLE AS width_mm, h::DOUBLE AS height_mm, action FROM act")
def component_actions(spark, sf_dir):
    return printability.component_actions(mask(spark, sf_dir), 1.0, LIMITS)


@query(f"{_ACTIONS}, px2 AS (SELECT lab.image_id, y, x, action FROM lab JOIN act USING (image_id, root)), kept AS (SELECT image_id, y, x FROM px2 WHERE action IN ('keep', 'thicken') UNION SELECT image_id, y + j, x + i FROM px2, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS o(j, i) WHERE action = 'thicken') SELECT mask.image_id, mask.y, mask.x, kept.y IS NOT NULL AS m FROM mask LEFT JOIN kept USING (image_id, y, x)")
def clean_components(spark, sf_dir):
    return printability.clean_components(mask(spark, sf_dir), 1.0, LIMITS)


_CROSS = "(VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS o(j, i)"


@query(f"{MASK}, d AS (SELECT a.image_id, a.y, a.x, bool_or(b.m) AS m FROM mask a, {_CROSS}, mask b WHERE b.image_id = a.image_id AND b.y = a.y + j AND b.x = a.x + i GROUP BY ALL) SELECT a.image_id, a.y, a.x, bool_and(b.m) AS m FROM d a, {_CROSS}, d b WHERE b.image_id = a.image_id AND b.y = a.y + j AND b.x = a.x + i GROUP BY ALL")
def close_gaps(spark, sf_dir):
    return printability.close_gaps(mask(spark, sf_dir), 1)


_PLUS = "SELECT a.image_id, a.y, a.x, {how}(b.m) AS m FROM {of} a JOIN {of} b ON b.image_id = a.image_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY ALL"


@query(f"""{MASK}, off AS MATERIALIZED (SELECT image_id, y, x FROM mask WHERE NOT m), {labelled('h1', 'off', EIGHT, 8)}, tiny AS (SELECT image_id, p // 8 AS y, p % 8 AS x FROM h1 QUALIFY NOT bool_or(p // 8 IN (0, 7) OR p % 8 IN (0, 7)) OVER (PARTITION BY image_id, root) AND count(*) OVER (PARTITION BY image_id, root) < 3),
m1 AS MATERIALIZED (SELECT mask.image_id, mask.y, mask.x, m OR tiny.y IS NOT NULL AS m FROM mask LEFT JOIN tiny USING (image_id, y, x)), dil AS MATERIALIZED ({_PLUS.format(how='bool_or', of='m1')}), clo AS MATERIALIZED ({_PLUS.format(how='bool_and', of='dil')}),
onc AS MATERIALIZED (SELECT image_id, y, x FROM clo WHERE m), {labelled('c1', 'onc', EIGHT, 8)},
st AS (SELECT image_id, root, count(*) AS area, least(max(p % 8) - min(p % 8), max(p // 8) - min(p // 8)) + 1 AS thin, greatest(max(p % 8) - min(p % 8), max(p // 8) - min(p // 8)) + 1 AS long FROM c1 GROUP BY ALL),
ac AS (SELECT image_id, root, CASE WHEN thin < 2 AND long >= 4 AND area >= 4 THEN 'grow' WHEN area < 4 OR thin < 2 THEN 'go' ELSE 'keep' END AS action FROM st),
cells AS (SELECT c1.image_id, p // 8 AS y, p % 8 AS x, action FROM c1 JOIN ac USING (image_id, root) WHERE action <> 'go'),
aft AS MATERIALIZED (SELECT image_id, y, x FROM cells UNION SELECT c.image_id, m.y, m.x FROM cells c JOIN mask m ON m.image_id = c.image_id AND abs(m.y - c.y) + abs(m.x - c.x) = 1 WHERE action = 'grow'), {labelled('c2', 'aft', EIGHT, 8)},
least_area AS (SELECT image_id, min(area)::DOUBLE AS area FROM (SELECT image_id, root, count(*) AS area FROM c2 GROUP BY ALL) GROUP BY image_id),
f AS (SELECT mask.image_id, m AS p, aft.y IS NOT NULL AS q FROM mask LEFT JOIN aft USING (image_id, y, x))
SELECT image_id, count(*) FILTER (p AND q) AS kept, count(*) FILTER (p AND NOT q) AS removed, count(*) FILTER (q AND NOT p) AS added, bool_or(p <> q) AS changed, any_value(area) AS least_area_mm2, any_value(area) IS NULL AS empty FROM f LEFT JOIN least_area USING (image_id) GROUP BY image_id""")
def printable_mask_report(spark, sf_dir):
    before = mask(spark, sf_dir)
    return printability.report(before, printability.enforce(before, 1.0, LIMITS), 1.0, LIMITS)


@query()
def printable_heights(spark, sf_dir):
    h = labels(spark, sf_dir).select(*masks.KEY, (F.col("label") * 0.4 + 0.8).alias("z"))
    return printability.enforce_heights(h, 1.0, LIMITS)


@query(f"""{MASK}, b AS (SELECT image_id, min(x) FILTER (m) AS x0, (min(x) FILTER (m) + max(x) FILTER (m)) // 2 AS cx, min(y) FILTER (m) AS y0, CASE WHEN bool_or(m) THEN 5 ELSE 0 END AS up FROM mask GROUP BY image_id),
g AS (SELECT b.*, gy, gx FROM b, (SELECT unnest(range(13)) AS gy), (SELECT unnest(range(8)) AS gx) WHERE gy < 8 + up),
k AS (SELECT g.image_id, gy, coalesce(m, false) AS was, x0 IS NULL AS bare, (gx - cx) * (gx - cx) + (gy - up) * (gy - up) AS far, gx BETWEEN greatest(0, cx - 1) AND least(7, cx + 1) AND gy BETWEEN up AND up + y0 + 2 AS tab FROM g LEFT JOIN mask ON mask.image_id = g.image_id AND mask.y = gy - up AND mask.x = gx)
SELECT image_id, count(*) FILTER (CASE WHEN bare THEN was ELSE (was OR far <= 9 OR tab) AND NOT far <= 4 END) AS pixels, (max(gy) + 1)::INT AS height FROM k GROUP BY image_id""")
def keychain_mask(spark, sf_dir):
    return printability.keychain(mask(spark, sf_dir)).groupBy("image_id").agg(F.count_if("m").alias("pixels"), (F.max("y") + 1).alias("height"))


@query(f"{MASK} SELECT image_id, (y // 2)::INT AS y, (x // 2)::INT AS x, avg(m::INT) > 0.5 AS m FROM mask GROUP BY ALL")
def area_shrink(spark, sf_dir):
    return printability.shrink(mask(spark, sf_dir), 2)


@query(f"""{MASK}, t AS (SELECT image_id, ty, tx, (ty + 0.5::DOUBLE) / 2 - 0.5 AS sy, (tx + 0.5::DOUBLE) / 2 - 0.5 AS sx FROM (SELECT DISTINCT image_id FROM mask), (SELECT unnest(range(16)) AS ty), (SELECT unnest(range(16)) AS tx)),
taps AS (SELECT t.image_id, ty, tx, greatest(0, least(7, floor(sy) + j))::INT AS y, greatest(0, least(7, floor(sx) + i))::INT AS x, (CASE j WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE i WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) AS w FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(j, i))
SELECT image_id, ty::INT AS y, tx::INT AS x, sum(w * m::INT * 255) >= 127 AS m FROM taps JOIN mask USING (image_id, y, x) GROUP BY image_id, ty, tx""")
def bilinear_enlarge(spark, sf_dir):
    return printability.enlarge(mask(spark, sf_dir), 2)


@query(f"{PX}, w AS (SELECT a.image_id, a.y, a.x, a.g, sum(b.g * jw * iw) AS s FROM px a, (VALUES (-1, 1), (0, 2), (1, 1)) AS j(j, jw), (VALUES (-1, 1), (0, 2), (1, 1)) AS i(i, iw), px b WHERE b.image_id = a.image_id AND b.y = 7 - abs(7 - abs(a.y + j)) AND b.x = 7 - abs(7 - abs(a.x + i)) GROUP BY ALL) SELECT image_id, y, x, g <= (s + 8) // 16 - 3 AS m FROM w")
def adaptive_threshold(spark, sf_dir):
    return artwork.adaptive_threshold(gray(spark, sf_dir))


@query(f"{PX}, s AS (SELECT a.image_id, a.y, a.x, sum(b.g * i * jw) AS gx, sum(b.g * j * iw) AS gy FROM px a, (VALUES (-1, 1), (0, 2), (1, 1)) AS j(j, jw), (VALUES (-1, 1), (0, 2), (1, 1)) AS i(i, iw), px b WHERE b.image_id = a.image_id AND b.y = greatest(0, least(7, a.y + j)) AND b.x = greatest(0, least(7, a.x + i)) GROUP BY ALL) SELECT image_id, round(avg((abs(gx) + abs(gy) > 160)::INT), 5) AS density FROM s GROUP BY image_id")
def edge_density(spark, sf_dir):
    return artwork.edge_density(gray(spark, sf_dir))


@query(f"""{RGB}, c AS (SELECT image_id, y, x, (r // 64 * 16 + gg // 64 * 4 + b // 64)::INT AS packed FROM rgb WHERE r < 128), n AS (SELECT image_id, packed, count(*) AS n FROM c GROUP BY ALL), t0 AS (SELECT *, sum(n) OVER (PARTITION BY image_id) AS al FROM n), t AS (SELECT image_id, packed, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, packed DESC) AS place FROM t0 WHERE al >= 9 QUALIFY place <= 3),
onp AS (SELECT c.* FROM c JOIN t USING (image_id, packed)), reach AS (SELECT image_id, packed, y * 8 + x AS p, y * 8 + x AS root FROM onp UNION SELECT r.image_id, r.packed, r.p, b.y * 8 + b.x FROM reach r JOIN onp b ON b.image_id = r.image_id AND b.packed = r.packed AND {_EIGHT}), lab AS (SELECT image_id, packed, p // 8 AS y, p % 8 AS x, min(root) AS root FROM reach GROUP BY image_id, packed, p), s AS (SELECT *, count(*) OVER (PARTITION BY image_id, packed, root) AS area FROM lab)
SELECT image_id, place::INT AS place, packed, y, x FROM s JOIN t USING (image_id, packed) WHERE area >= 3""")
def color_regions(spark, sf_dir):
    px = rgb(spark, sf_dir)
    return artwork.color_regions(px, px.select(*masks.KEY, (F.col("r") < 128).alias("m")), 3)


def _large(name: str, labels: str, least: int) -> str:
    return f"{name} AS MATERIALIZED (SELECT image_id, p // 8 AS y, p % 8 AS x FROM {labels} QUALIFY count(*) OVER (PARTITION BY image_id, root) >= {least})"


@query(f"""{MASK}, on1 AS MATERIALIZED (SELECT image_id, y, x FROM mask WHERE m), {labelled('l1', 'on1', EIGHT, 8)}, {_large('src', 'l1', 4)},
off AS MATERIALIZED (SELECT image_id, y, x FROM mask ANTI JOIN src USING (image_id, y, x)), {labelled('l2', 'off', FOUR, 8)},
inside AS (SELECT image_id, p // 8 AS y, p % 8 AS x FROM l2 QUALIFY NOT bool_or(p // 8 IN (0, 7) OR p % 8 IN (0, 7)) OVER (PARTITION BY image_id, root)), raw AS MATERIALIZED (SELECT * FROM inside), {labelled('l3', 'raw', EIGHT, 8)}, {_large('hole', 'l3', 4)},
filled AS MATERIALIZED (SELECT * FROM src UNION ALL SELECT * FROM inside), body AS MATERIALIZED (SELECT * FROM filled ANTI JOIN hole USING (image_id, y, x)),
rim AS (SELECT DISTINCT f.image_id, f.y, f.x FROM filled f, mask n WHERE n.image_id = f.image_id AND abs(n.y - f.y) <= 1 AND abs(n.x - f.x) <= 1 AND NOT EXISTS (SELECT 1 FROM filled g WHERE g.image_id = n.image_id AND g.y = n.y AND g.x = n.x)),
dark AS MATERIALIZED (SELECT b.image_id, b.y, b.x FROM body b ANTI JOIN rim USING (image_id, y, x) JOIN px p ON p.image_id = b.image_id AND p.y = b.y AND p.x = b.x WHERE p.g < 90), {labelled('l4', 'dark', EIGHT, 8)}, {_large('detail', 'l4', 2)},
i AS (SELECT DISTINCT image_id FROM px), n AS (SELECT image_id, 'b' AS k FROM body UNION ALL SELECT image_id, 'h' FROM hole UNION ALL SELECT image_id, 'd' FROM detail)
SELECT image_id, count(*) FILTER (k = 'b') AS body, count(*) FILTER (k = 'h') AS hole, count(*) FILTER (k = 'd') AS detail, count(*) FILTER (k = 'b') AS final FROM i LEFT JOIN n USING (image_id) GROUP BY image_id""")
def artwork_classes(spark, sf_dir):
    g, m = gray(spark, sf_dir), mask(spark, sf_dir)
    dark = g.select(*masks.KEY, (F.col("g") < 90).alias("m"))
    c = artwork.classify(m, dark, m, 4)
    f = artwork.final_mask(c, m, "raised_details", "raise", ("body", "hole", "detail"))
    return f.groupBy("image_id").agg(*[F.count_if(k).alias(k) for k in ("body", "hole", "detail")], F.count_if("m").alias("final"))


@query()
def similar_colors(spark, sf_dir):
    px = rgb(spark, sf_dir).withColumn("label", F.expr("cast(r div 40 as int)"))
    p = px.groupBy("image_id", "label").agg(F.count("*").alias("n"), *[F.round(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    return artwork.merge_similar_colors(p)


@query()
def relief_jobs(spark, sf_dir):
    return artwork.status_documents(artwork.relief_job(rgb(spark, sf_dir)))


@query(f"{LABELS}, z AS (SELECT image_id, y, x, label * 0.4::DOUBLE + 0.8::DOUBLE AS z FROM lb), lv AS (SELECT image_id, list_sort(list_distinct(list_append(list(z), 0.0::DOUBLE))) AS levels FROM z GROUP BY image_id), s AS (SELECT a.image_id, a.y, a.x, side, a.z, coalesce(b.z, 0.0) AS low FROM z a CROSS JOIN {R._SIDES} LEFT JOIN z b ON b.image_id = a.image_id AND b.y = a.y + j AND b.x = a.x + i), c AS (SELECT s.*, list_filter(levels, lambda l: l >= low AND l <= z) AS cuts FROM s JOIN lv USING (image_id) WHERE low < z) SELECT image_id, side, count(*) AS walls, round(sum(hi - lo), 6) AS height FROM (SELECT image_id, side, unnest(cuts[:-2]) AS lo, unnest(cuts[2:]) AS hi FROM c) GROUP BY ALL")
def step_walls(spark, sf_dir):
    h = labels(spark, sf_dir).select(*masks.KEY, (F.col("label") * 0.4 + 0.8).alias("z"))
    return meshes.step_walls(h).groupBy("image_id", "side").agg(F.count("*").alias("walls"), F.round(F.sum(F.col("high") - F.col("low")), 6).alias("height"))


@query(f"{RINGS}, {around('rings', 'a')}, pt AS (SELECT vec_id AS image_id, k AS point, (vec_id * 7 + k * 13) % 80 - 8 + 0.3::DOUBLE AS x, (vec_id * 11 + k * 17) % 80 - 8 + 0.3::DOUBLE AS y FROM embeddings, (SELECT unnest(range(5)) AS k)) SELECT a.image_id, a.ring, point FROM a JOIN pt ON a.image_id = pt.image_id AND (py > y) <> (cy > y) AND x < (cx - px) * (y - py) / (cy - py) + px GROUP BY ALL HAVING count(*) % 2 = 1")
def points_in_rings(spark, sf_dir):
    r = rings(spark, sf_dir)
    pts = r.select("image_id").distinct().withColumn("point", F.explode(F.expr("sequence(0, 4)")))
    i, k = F.col("image_id"), F.col("point")
    pts = pts.select("image_id", k.cast("long").alias("point"), ((i * 7 + k * 13) % 80 - 8 + 0.3).alias("x"), ((i * 11 + k * 17) % 80 - 8 + 0.3).alias("y"))
    return contours.contains(r, pts)


@query(f"{MASK} SELECT image_id, y, x FROM mask WHERE m")
def traced_and_filled(spark, sf_dir):
    """Rings traced around a mask and filled again give the mask."""
    return contours.fill(contours.trace(mask(spark, sf_dir)))


@query(f"{PX}, k AS (SELECT *, avg(g) OVER (PARTITION BY image_id) AS cut, CASE WHEN y IN (0, 7) AND x IN (0, 7) THEN 2 WHEN y IN (0, 7) OR x IN (0, 7) THEN 1 ELSE 0 END AS t FROM px), s AS (SELECT image_id, sum(CASE WHEN g < cut THEN t ELSE 0 END) / 32.0::DOUBLE AS lb, abs(avg((g < cut)::INT) - 0.3) AS lo, sum(CASE WHEN g > cut THEN t ELSE 0 END) / 32.0::DOUBLE AS hb, abs(avg((g > cut)::INT) - 0.3) AS ho FROM k GROUP BY image_id) SELECT image_id, count(*) FILTER (CASE WHEN (hb, ho) < (lb, lo) THEN g > cut ELSE g < cut END) AS pixels FROM k JOIN s USING (image_id) GROUP BY image_id")
def foreground_side(spark, sf_dir):
    from pyspark.sql import Window as W

    g = gray(spark, sf_dir).withColumn("cut", F.avg("g").over(W.partitionBy("image_id")))
    return masks.foreground(g).groupBy("image_id").agg(F.count_if("m").alias("pixels"))


@query(f"{MASK}, s AS (SELECT a.image_id, count(*) AS sides FROM mask a, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS o(j, i) WHERE a.m AND NOT EXISTS (SELECT 1 FROM mask b WHERE b.image_id = a.image_id AND b.y = a.y + j AND b.x = a.x + i AND b.m) GROUP BY a.image_id), n AS (SELECT image_id, count(*) FILTER (m) AS n FROM mask GROUP BY image_id) SELECT image_id, round(coalesce(sides, 0) / greatest(1.0::DOUBLE, sqrt(n)), 4) AS roughness FROM n LEFT JOIN s USING (image_id)")
def boundary_roughness(spark, sf_dir):
    """Perimeter of all traced rings over the square root of the mask's size."""
    m = mask(spark, sf_dir)
    p = contours.measures(contours.trace(m)).groupBy("image_id").agg(F.sum("perimeter").alias("perimeter"))
    n = m.groupBy("image_id").agg(F.count_if("m").alias("n"))
    return n.join(p, "image_id", "left").select("image_id", F.round(F.coalesce("perimeter", F.lit(0.0)) / F.greatest(F.lit(1.0), F.sqrt("n")), 4).alias("roughness"))


@query(f"{MASK}, t AS (SELECT image_id, min(y) AS top, max(y) - min(y) + 1 AS tall FROM mask WHERE m GROUP BY image_id), onp AS (SELECT mask.image_id, y, x FROM mask JOIN t USING (image_id) WHERE m AND y - top >= floor(tall * 0.55)), {_LABEL.format(on='onp', near=_EIGHT)}, s AS (SELECT image_id, root, count(*) AS area, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM lab GROUP BY ALL) SELECT image_id, count(root) FILTER (area > 2 AND h / w::DOUBLE > 1.5 AND area / (w * h)::DOUBLE < 0.95) AS slender FROM t LEFT JOIN s USING (image_id) GROUP BY image_id")
def lower_slender_parts(spark, sf_dir):
    return metrics.lower_slender(mask(spark, sf_dir), least_area=2, most_fill=0.95)


def _number(v: float | None) -> str:
    return "NULL::DOUBLE" if v is None else f"{v}::DOUBLE"


_BOUNDS = ", ".join(f"('{p}', '{k}', {_number(a)}, {_number(b)}, {_number(c)})" for p, k, a, b, c in presets.PRESETS)


@query(f"b(preset, setting, least_v, most_v, fixed) AS (VALUES {_BOUNDS}), s AS (SELECT s_suppkey AS job, preset, setting, (s_suppkey * n % 211)::DOUBLE AS value FROM supplier, (SELECT DISTINCT preset FROM b), (VALUES ('simplify_tolerance', 1), ('min_island_area_px', 7), ('island_near_body_distance_px', 3), ('min_contour_area', 5), ('morph_kernel_size', 2), ('remove_small_islands', 0)) AS k(setting, n)) SELECT job, s.preset, s.setting, coalesce(fixed, least(greatest(value, coalesce(least_v, value)), coalesce(most_v, greatest(value, coalesce(least_v, value))))) AS value FROM s LEFT JOIN b ON b.preset = s.preset AND b.setting = s.setting")
def preset_overlay(spark, sf_dir):
    """Every job under every preset, as the quality matrix runs them."""
    names = F.explode(F.array(*map(F.lit, presets.NAMES))).alias("preset")
    kinds = F.explode(F.create_map(*[F.lit(x) for kv in {"simplify_tolerance": 1, "min_island_area_px": 7, "island_near_body_distance_px": 3, "min_contour_area": 5, "morph_kernel_size": 2, "remove_small_islands": 0}.items() for x in kv]))
    jobs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("job"), names).select("job", "preset", kinds.alias("setting", "n"))
    return presets.overlay(jobs.select("job", "preset", "setting", (F.col("job") * F.col("n") % 211).cast("double").alias("value")))


@query(f"""{R.LABELS}, {R._LREACH}, low AS (SELECT * FROM s WHERE area < 4), big AS (SELECT * FROM s WHERE area >= 4), c AS (SELECT a.image_id, a.label, a.root, (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS d2, a.y AS sy, a.x AS sx, b.y AS ty, b.x AS tx FROM low a JOIN big b ON a.image_id = b.image_id AND a.label = b.label),
m AS (SELECT image_id, label, root, min((d2, sy, sx, ty, tx)) AS p FROM c WHERE d2 <= 9 GROUP BY ALL) SELECT image_id, label, concat(root // 8, ':', root % 8) AS comp, p[1]::INT AS d2, p[2]::INT AS sy, p[3]::INT AS sx, p[4]::INT AS ty, p[5]::INT AS tx FROM m""")
def island_connections(spark, sf_dir):
    return regions.connections(labels(spark, sf_dir), 4, 3)


@query(f"""{MASK}, deg AS (SELECT a.image_id, a.y, a.x, count(*) FILTER (b.m AND NOT (a.y = b.y AND a.x = b.x)) AS near FROM mask a JOIN mask b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
q AS (SELECT a.image_id, a.y AS cy, a.x AS cx, a.m AS falling FROM mask a JOIN mask b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x + 1 JOIN mask c ON c.image_id = a.image_id AND c.y = a.y + 1 AND c.x = a.x JOIN mask d ON d.image_id = a.image_id AND d.y = a.y + 1 AND d.x = a.x + 1 WHERE (a.m AND d.m AND NOT b.m AND NOT c.m) OR (b.m AND c.m AND NOT a.m AND NOT d.m)),
e AS (SELECT image_id, cy, cx, cy AS y, CASE WHEN falling THEN cx + 1 ELSE cx END AS x FROM q UNION ALL SELECT image_id, cy, cx, cy + 1, CASE WHEN falling THEN cx ELSE cx + 1 END FROM q),
f AS (SELECT DISTINCT image_id, y, x FROM (SELECT e.*, row_number() OVER (PARTITION BY image_id, cy, cx ORDER BY near DESC, y, x) AS k FROM e JOIN deg USING (image_id, y, x)) WHERE k = 1)
SELECT mask.image_id, mask.y, mask.x, m OR f.y IS NOT NULL AS m FROM mask LEFT JOIN f USING (image_id, y, x)""")
def contacts_resolved_once(spark, sf_dir):
    from ..operators import neighbourhood

    return neighbourhood.resolve_contacts_once(mask(spark, sf_dir))


@query()
def contacts_resolved(spark, sf_dir):
    """No diagonal contact is left; held in tests."""
    from ..operators import neighbourhood

    return neighbourhood.resolve_contacts(mask(spark, sf_dir)).groupBy("image_id").agg(F.count_if("m").alias("pixels"))


@query(f"{RINGS}, {around('rings', 'a')}, t AS (SELECT image_id, ring, seq, px, py, round(x1 * y2 - y1 * x2, 6) AS bend FROM (SELECT *, px - ax AS x1, py - ay AS y1, cx - px AS x2, cy - py AS y2 FROM a)) SELECT image_id, ring, count(*) FILTER (bend > 0) AS right_turns, count(*) FILTER (bend < 0) AS left_turns, count(*) FILTER (bend = 0) AS straight FROM t GROUP BY ALL")
def ring_turns(spark, sf_dir):
    return contours.turns(rings(spark, sf_dir))


@query(f"{RINGS}, {around('rings', 'a')}, s AS (SELECT *, CASE WHEN abs(180.0 - {_TURN}) > 12.0 THEN 1 ELSE 0 END AS brk FROM a), g AS (SELECT *, sum(brk) OVER (PARTITION BY image_id, ring ORDER BY seq) AS run FROM s), e AS (SELECT *, count(*) OVER (PARTITION BY image_id, ring, run) AS len, row_number() OVER (PARTITION BY image_id, ring, run ORDER BY seq) AS k FROM g) SELECT image_id, ring, seq, px, py FROM e WHERE len < 4 OR k = 1 OR k = len")
def straight_runs(spark, sf_dir):
    return contours.straighten(rings(spark, sf_dir), 12.0, 4)


_A = -0.75
_FAR = "({a} * pow({d}, 3) - 5 * {a} * pow({d}, 2) + 8 * {a} * {d} - 4 * {a})"
_NEAR = "(({a} + 2) * pow({d}, 3) - ({a} + 3) * pow({d}, 2) + 1)"


def _cubic(t: str, k: str) -> str:
    return f"CASE {k} WHEN -1 THEN {_FAR.format(a=_A, d=f'(1 + {t})')} WHEN 0 THEN {_NEAR.format(a=_A, d=t)} WHEN 1 THEN {_NEAR.format(a=_A, d=f'(1 - {t})')} ELSE {_FAR.format(a=_A, d=f'(2 - {t})')} END"


@query(f"""{PX}, t AS (SELECT image_id, ty, tx, (ty + 0.5::DOUBLE) / 2 - 0.5 AS sy, (tx + 0.5::DOUBLE) / 2 - 0.5 AS sx FROM (SELECT DISTINCT image_id FROM px), (SELECT unnest(range(16)) AS ty), (SELECT unnest(range(16)) AS tx)),
taps AS (SELECT t.image_id, ty, tx, greatest(0, least(7, floor(sy) + j))::INT AS y, greatest(0, least(7, floor(sx) + i))::INT AS x, ({_cubic('(sy - floor(sy))', 'j')}) * ({_cubic('(sx - floor(sx))', 'i')}) AS w FROM t, (SELECT unnest([-1, 0, 1, 2]) AS j), (SELECT unnest([-1, 0, 1, 2]) AS i))
SELECT image_id, ty::INT AS y, tx::INT AS x, least(255, greatest(0, floor(round(sum(w * g), 6) + 0.5)))::INT AS g FROM taps JOIN px USING (image_id, y, x) GROUP BY image_id, ty, tx""")
def cubic_enlarge(spark, sf_dir):
    return printability.enlarge_cubic(gray(spark, sf_dir), 2)


_HOLES = f"{MASK}, onp AS (SELECT image_id, y, x FROM mask WHERE NOT m), {_LABEL.format(on='onp', near=R._FOUR)}, h AS (SELECT image_id, y, x, root, bool_or(y IN (0, 7) OR x IN (0, 7)) OVER (PARTITION BY image_id, root) AS open, count(*) OVER (PARTITION BY image_id, root) AS area FROM lab)"


@query(f"{_HOLES}, e AS (SELECT DISTINCT image_id, root, area FROM h WHERE NOT open), i AS (SELECT DISTINCT image_id FROM px) SELECT image_id, count(area) AS holes, round(coalesce(avg(area / 64.0::DOUBLE), 0), 6) AS share FROM i LEFT JOIN e USING (image_id) GROUP BY image_id")
def hole_metrics(spark, sf_dir):
    return reports.hole_metrics(mask(spark, sf_dir))


@query(f"{_HOLES} SELECT mask.image_id, mask.y, mask.x, coalesce(NOT (NOT open AND area >= 3), true) AS m FROM mask LEFT JOIN h USING (image_id, y, x)")
def restored_holes(spark, sf_dir):
    full = mask(spark, sf_dir).select(*masks.KEY, F.lit(True).alias("m"))
    return reports.restore_holes(mask(spark, sf_dir), full, 3)


@query(f"{LABELS}, {R._LREACH}, e AS (SELECT image_id, label, root, count(*) AS area FROM lab GROUP BY ALL) SELECT image_id, label, count(*) AS regions, count(*) FILTER (area >= 4) AS kept, count(*) FILTER (area < 4) AS small, sum(area)::BIGINT AS pixels FROM e GROUP BY ALL")
def per_color_counts(spark, sf_dir):
    return reports.per_color_counts(labels(spark, sf_dir), 4)


@query(f"{R._DEST} SELECT image_id, count(*) AS small, count(target) AS merged, count(*) FILTER (contact > 0) AS by_contact, count(*) FILTER (target IS NULL) AS removed FROM dest GROUP BY image_id")
def island_summary(spark, sf_dir):
    return reports.island_summary(labels(spark, sf_dir), 4, 3)


@query(f"{LABELS}, {R._GROUND}, k AS (SELECT image_id, count(DISTINCT label) AS kinds FROM lb GROUP BY image_id) SELECT image_id, CASE WHEN share >= 0.6 AND kinds > 1 THEN label END AS ignored, CASE WHEN label IS NULL THEN 'no border pixels' WHEN share < 0.6 THEN 'the border has no clear color' WHEN kinds < 2 THEN 'it is the only color' ELSE 'the border has one clear color' END AS reason FROM k LEFT JOIN ground USING (image_id)")
def background_decision(spark, sf_dir):
    from ..operators import layers

    lb = labels(spark, sf_dir)
    return reports.background_decision(layers.background(lb), lb)


@query(f"{R._CHOSEN}, {R._plan_sql(0.8, 0.4, 0.28, 0.16)} SELECT image_id, ord + 1 AS slot, label, change_before_layer AS layer, start_mm AS top_z FROM bands WHERE change_before_layer IS NOT NULL")
def tool_changes(spark, sf_dir):
    from ..operators import layers

    return reports.tool_changes(layers.plan(R._ordered(spark, sf_dir), 0.8, 0.4, 0.28, 0.16), 0.28, 0.16)


@query(f"{MASK}, c AS (SELECT DISTINCT image_id, y + j AS gy, x + i AS gx, t FROM mask, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(j, i), (VALUES (0), (1)) AS l(t) WHERE m), v AS (SELECT image_id, count(*) AS vertices FROM c GROUP BY image_id) SELECT image_id, vertices, vertices - 1 AS last FROM v")
def mesh_vertices(spark, sf_dir):
    v, f = reports.indexed(meshes.relief_faces(dealt(mask(spark, sf_dir), "image_id")))
    last = f.groupBy("image_id").agg(F.max(F.greatest("v1", "v2", "v3")).cast("long").alias("last"))
    return v.groupBy("image_id").agg(F.count("*").alias("vertices")).join(last, "image_id")


_CH = "sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay))"
_ST = "sqrt(pow((ax + 2 * px + cx) / 4 - px, 2) + pow((ay + 2 * py + cy) / 4 - py, 2))"


@query(f"{RINGS}, {around('rings', 'a')}, s AS (SELECT *, n >= 6 AND ({_TURN}) >= 60 AND {_CH} >= 2 AND ({_ST} <= 0.5 OR {_ST} / greatest(1.0, {_CH}) * 100 <= 5) AS moves FROM a) SELECT image_id, ring, seq, CASE WHEN moves THEN (ax + 2 * px + cx) / 4 ELSE px END AS px, CASE WHEN moves THEN (ay + 2 * py + cy) / 4 ELSE py END AS py FROM s")
def curve_fit(spark, sf_dir):
    return contours.fit_curves(rings(spark, sf_dir))


@query(f"{RINGS}, {around('rings', 'a')}, b AS (SELECT image_id, ring, 0 AS part, seq, px, py FROM rings WHERE seq % 2 = 0 UNION ALL SELECT image_id, ring, 1, seq, px, py FROM a WHERE ({_TURN}) < 120) SELECT image_id, ring, (row_number() OVER (PARTITION BY image_id, ring ORDER BY part, seq) - 1)::INT AS seq, px, py FROM b")
def restored_corners(spark, sf_dir):
    r = rings(spark, sf_dir)
    return contours.restore_corners(r, r.where("seq % 2 = 0"), 120.0)


@query()
def straight_chords(spark, sf_dir):
    return contours.straighten_chords(rings(spark, sf_dir))


@query()
def clean_contours(spark, sf_dir):
    return contours.clean_contours(contours.trace(mask(spark, sf_dir)))[1]


@query(f"{RINGS}, {around('rings', 'a')}, m AS (SELECT image_id, ring, count(*) AS n, abs(sum(px * cy - cx * py) / 2) AS area FROM a GROUP BY ALL) SELECT image_id, ring, seq, px, py FROM rings JOIN m USING (image_id, ring) WHERE m.n >= 3 AND area > 4095")
def valid_rings(spark, sf_dir):
    return contours.valid(rings(spark, sf_dir), 4095.0)


@query(f"{R._CHOSEN}, {R._plan_sql(0.8, 0.4, 0.28, 0.16)}, z AS (SELECT lb.image_id, y, x, coalesce(top_mm, 0)::DOUBLE AS z FROM lb LEFT JOIN bands USING (image_id, label)), kz AS (SELECT *, min(CASE WHEN z > 0 THEN z END) OVER (PARTITION BY image_id) AS lo, max(z) OVER (PARTITION BY image_id) AS hi FROM z) SELECT image_id, y, x, CASE WHEN z <= 0 THEN 0 WHEN hi <= lo THEN 180 ELSE floor(round((z - lo) / (hi - lo) * 175, 6) + 80) END::INT AS g FROM kz")
def height_preview(spark, sf_dir):
    return reports.height_preview(R.height_map(spark, sf_dir))


@query(f"{PX}, c AS (SELECT image_id, y, x, 3.0::DOUBLE - g / 255.0::DOUBLE * (3.0::DOUBLE - 0.8::DOUBLE) AS mm FROM px), k AS (SELECT *, min(mm) OVER (PARTITION BY image_id) AS lo, max(mm) OVER (PARTITION BY image_id) AS hi FROM c) SELECT image_id, y, x, CASE WHEN hi > lo THEN floor(round((mm - lo) / (hi - lo) * 255, 6)) ELSE 0 END::INT AS g FROM k")
def thickness_preview(spark, sf_dir):
    return reports.thickness_preview(meshes.thickness(gray(spark, sf_dir)))


@query(f"{LABELS}, z AS (SELECT image_id, y, x, label * 0.4::DOUBLE + 0.8::DOUBLE AS z FROM lb), l AS (SELECT DISTINCT image_id, z AS level FROM z), n AS (SELECT a.image_id, a.y, a.x, a.z, max(b.z) AS near FROM z a JOIN z b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x) GROUP BY ALL) SELECT image_id, level, count(*) AS pixels, count(*) FILTER (near >= level) AS supported FROM n JOIN l USING (image_id) WHERE z >= level GROUP BY ALL")
def level_support(spark, sf_dir):
    return reports.level_support(labels(spark, sf_dir).select(*masks.KEY, (F.col("label") * 0.4 + 0.8).alias("z")))


@query(f"{R._CHOSEN}, {R._plan_sql(0.8, 0.4, 0.28, 0.16)}, t AS (SELECT image_id, ord, lpad((ord + 1)::VARCHAR, 2, ' ') || '. ' || format('#{{:02X}}{{:02X}}{{:02X}}', label * 86, label * 86, label * 86) || ': layers ' || first_layer || ' to ' || last_layer || coalesce(', change before layer ' || change_before_layer, '') AS line FROM bands) SELECT image_id, string_agg(line, chr(10) ORDER BY ord) AS text FROM t GROUP BY image_id")
def swap_plan_text(spark, sf_dir):
    from ..functions.color import hex_color
    from ..operators import layers

    bands = layers.plan(R._ordered(spark, sf_dir), 0.8, 0.4, 0.28, 0.16)
    g = F.col("label") * 86
    return reports.swap_plan_text(bands, bands.select("image_id", "label", hex_color(g, g, g).alias("hex")))


@query(f"{_RUNS} SELECT image, string_agg('- ' || preset || ': ' || score || ' (' || note || ')', chr(10) ORDER BY -score, preset, run) AS text FROM scored GROUP BY image")
def matrix_lines(spark, sf_dir):
    from ..operators import scoring
    from .report_queries import carried_runs

    return reports.matrix_lines(scoring.quality_score(carried_runs(spark, sf_dir)))


@query(f"{LABELS}, {R._LREACH} SELECT image_id, y, x, label FROM s WHERE area >= 4")
def kept_labels(spark, sf_dir):
    return reports.kept_labels(labels(spark, sf_dir), 4)


@query("p AS (SELECT p_partkey, p_name, p_brand, CASE p_partkey % 3 WHEN 0 THEN 'lithophane' WHEN 1 THEN 'filament_swap_relief' ELSE 'keychain' END AS product FROM part) SELECT p_partkey, CASE WHEN length(p_name) <= 8 THEN p_name ELSE substr(p_name, 1, 5) || '...' END AS short, CASE product WHEN 'lithophane' THEN 'lithophane_heightfield' WHEN 'filament_swap_relief' THEN 'filament_swap_heightmap' ELSE p_brand END AS backend FROM p")
def names_and_backends(spark, sf_dir):
    from ..functions import measures

    k = F.col("p_partkey") % 3
    product = F.when(k == 0, "lithophane").when(k == 1, "filament_swap_relief").otherwise("keychain")
    return table(spark, sf_dir, "part").select("p_partkey", measures.shortened(F.col("p_name"), 8).alias("short"), measures.backend_for(product, F.col("p_brand")).alias("backend"))


@query("s AS (SELECT c_custkey AS job, CASE WHEN n < 2 THEN 'stl' ELSE 'svg' END AS section, 'k' || n AS key, (c_custkey * (n + 1) % 97)::VARCHAR AS value FROM customer, (SELECT unnest(range(4)) AS n)), b AS (SELECT job, section, string_agg('  ' || key || ': ' || value, chr(10) ORDER BY key) AS body FROM s GROUP BY ALL) SELECT job, string_agg(section || ':' || chr(10) || body, chr(10) ORDER BY section) AS text FROM b GROUP BY job")
def settings_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"), F.explode(F.expr("sequence(0, 3)")).alias("n"))
    return reports.settings_text(c.select("job", F.when(F.col("n") < 2, "stl").otherwise("svg").alias("section"), F.concat(F.lit("k"), F.col("n").cast("string")).alias("key"), (F.col("job") * (F.col("n") + 1) % 97).cast("string").alias("value")))


@query()
def levels_repaired(spark, sf_dir):
    """Height levels without diagonal contacts, and how many pixels rose; held in tests."""
    from ..operators import neighbourhood

    h = F.expr("cast(g div 64 as int)")
    after = neighbourhood.repair_levels(gray(spark, sf_dir).select("image_id", "y", "x", h.alias("h"), h.alias("was")))
    return after.groupBy("image_id").agg(F.count_if(F.col("h") > F.col("was")).alias("raised"), F.max("h").alias("top"))
