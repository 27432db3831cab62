"""Queries over rings, metrics and quality runs that other tables carry, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures
from ..operators import contours, metrics, scoring
from ..storage import table
from .raster_queries import SQL as RASTER_SQL
from .raster_queries import gray, mask

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH RECURSIVE " + sql
        return f

    return add


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a ring of 64 points around a 16 x 16 square, moved by its numbers, in steps of 1/4."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("seq", "v"))
    side, k = F.expr("seq div 16"), F.col("seq") % 16
    x = F.when(side == 0, k).when(side == 1, 16).when(side == 2, 16 - k).otherwise(0)
    y = F.when(side == 0, 0).when(side == 1, k).when(side == 2, 16).otherwise(16 - k)
    move = F.floor(F.col("v").cast("double") * 8) / 4
    return e.select("image_id", F.lit(0).alias("ring"), "seq", (x * 4 + F.when(side % 2 == 0, 0.0).otherwise(move)).cast("double").alias("px"), (y * 4 + F.when(side % 2 == 0, move).otherwise(0.0)).cast("double").alias("py"))


RINGS = """ring0 AS (SELECT vec_id AS image_id, pos - 1 AS seq, v::DOUBLE AS v, (pos - 1) // 16 AS side, (pos - 1) % 16 AS k FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)),
rings AS (SELECT image_id, 0 AS ring, seq::INT AS seq, (CASE side WHEN 0 THEN k WHEN 1 THEN 16 WHEN 2 THEN 16 - k ELSE 0 END * 4 + CASE WHEN side % 2 = 0 THEN 0 ELSE floor(v * 8) / 4 END)::DOUBLE AS px, (CASE side WHEN 0 THEN 0 WHEN 1 THEN k WHEN 2 THEN 16 ELSE 16 - k END * 4 + CASE WHEN side % 2 = 0 THEN floor(v * 8) / 4 ELSE 0 END)::DOUBLE AS py FROM ring0)"""


def around(source: str, name: str) -> str:
    w = "PARTITION BY image_id, ring ORDER BY seq"
    end = f"OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"{name} AS (SELECT *, count(*) OVER (PARTITION BY image_id, ring) AS n, coalesce(lag(px) OVER ({w}), last_value(px) {end}) AS ax, coalesce(lag(py) OVER ({w}), last_value(py) {end}) AS ay, coalesce(lead(px) OVER ({w}), first_value(px) {end}) AS cx, coalesce(lead(py) OVER ({w}), first_value(py) {end}) AS cy FROM {source})"


_SIZE = "(sqrt((ax - px) * (ax - px) + (ay - py) * (ay - py)) * sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)))"
_TURN = f"CASE WHEN {_SIZE} = 0 THEN 180.0 ELSE degrees(acos(greatest(-1.0, least(1.0, ((ax - px) * (cx - px) + (ay - py) * (cy - py)) / {_SIZE})))) END"
_MEASURES = "count(*) AS n, sum(px * cy - cx * py) / 2 AS area, sum(sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py))) AS perimeter, min(px) AS x0, min(py) AS y0, max(px) - min(px) AS w, max(py) - min(py) AS h"


@query(f"{RINGS}, {around('rings', 'a')} SELECT image_id, ring, round(area, 6) AS area, round(perimeter, 6) AS perimeter, n, x0, y0, w, h FROM (SELECT image_id, ring, {_MEASURES} FROM a GROUP BY ALL)")
def ring_area(spark, sf_dir):
    m = contours.measures(rings(spark, sf_dir))
    return m.withColumn("area", F.round("area", 6)).withColumn("perimeter", F.round("perimeter", 6))


_MERGED = f"{RINGS}, {around('rings', 'a')}, t AS (SELECT *, abs(180.0 - {_TURN}) > 2.0 AS turns FROM a), t2 AS (SELECT *, count(*) FILTER (turns) OVER (PARTITION BY image_id, ring) AS lft FROM t), merged AS (SELECT image_id, ring, seq, px, py FROM t2 WHERE turns OR n <= 3 OR lft < 3)"


@query(f"{_MERGED} SELECT * FROM merged")
def collinear_merge(spark, sf_dir):
    return contours.merge_collinear(rings(spark, sf_dir))


_ROUNDED = f"""{_MERGED}, {around('merged', 'b')}, r AS (SELECT *, {_TURN} < 60.0 OR n < 4 AS sharp FROM b),
p AS (SELECT image_id, ring, seq, 0 AS k, CASE WHEN sharp THEN px ELSE px * 0.75 + cx * 0.25 END AS px, CASE WHEN sharp THEN py ELSE py * 0.75 + cy * 0.25 END AS py FROM r UNION ALL SELECT image_id, ring, seq, 1, px * 0.25 + cx * 0.75, py * 0.25 + cy * 0.75 FROM r WHERE NOT sharp),
rounded AS (SELECT image_id, ring, (row_number() OVER (PARTITION BY image_id, ring ORDER BY seq, k) - 1)::INT AS seq, px, py FROM p)"""


@query(f"{_ROUNDED} SELECT * FROM rounded")
def chaikin_round(spark, sf_dir):
    return contours.round_corners(contours.merge_collinear(rings(spark, sf_dir)))


@query(f"""{_ROUNDED}, {around('rounded', 'c')}, ma AS (SELECT image_id, ring, {_MEASURES} FROM a GROUP BY ALL), mb AS (SELECT image_id, ring, {_MEASURES} FROM c GROUP BY ALL)
SELECT image_id, ring, mb.n >= 3 AND abs(abs(mb.area) - greatest(abs(ma.area), 1e-9)) / greatest(abs(ma.area), 1e-9) * 100 <= 5 AND greatest(abs(mb.w - greatest(1, ma.w)) / greatest(1, ma.w) * 100, abs(mb.h - greatest(1, ma.h)) / greatest(1, ma.h) * 100) <= 3
AND abs(greatest(1, mb.w) / greatest(1, mb.h) - greatest(1, ma.w) / greatest(1, ma.h)) / (greatest(1, ma.w) / greatest(1, ma.h)) * 100 <= 3 AND (ma.n - mb.n) / ma.n::DOUBLE * 100 <= 85 AS safe FROM ma JOIN mb USING (image_id, ring)""")
def contour_safety(spark, sf_dir):
    before = rings(spark, sf_dir)
    return contours.is_safe(before, contours.round_corners(contours.merge_collinear(before)))


@query(f"""{RINGS}, {around('rings', 'a')}, f AS (SELECT image_id, ring, seq, [px, py, (px + cx) / 2, (py + cy) / 2] AS v FROM a), s AS (SELECT image_id, ring, seq, list_transform(v, lambda t: CASE WHEN regexp_replace(printf('%.2f', t), '\\.?0+$', '') IN ('', '-0') THEN '0' ELSE regexp_replace(printf('%.2f', t), '\\.?0+$', '') END) AS t FROM f)
SELECT image_id, ring, concat('M ', first(t[1] || ' ' || t[2] ORDER BY seq), ' ', string_agg('Q ' || t[1] || ' ' || t[2] || ' ' || t[3] || ' ' || t[4], ' ' ORDER BY seq), ' Z') AS d FROM s GROUP BY ALL""")
def svg_paths(spark, sf_dir):
    return contours.svg_paths(rings(spark, sf_dir))


@query("t AS (SELECT (p_partkey % 7)::BIGINT AS image_id, p_partkey AS ring, CASE WHEN p_partkey // 7 >= 3 THEN (p_partkey // 7 // 3) * 7 + p_partkey % 7 END AS parent FROM part), r AS (SELECT image_id, ring, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.image_id, t.ring, r.depth + 1 FROM r JOIN t ON t.image_id = r.image_id AND t.parent = r.ring) SELECT image_id, ring, depth, depth % 2 = 1 AS hole FROM r")
def hole_parity(spark, sf_dir):
    t = table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("image_id"), F.col("p_partkey").alias("ring"), F.expr("case when p_partkey div 7 >= 3 then (p_partkey div 7 div 3) * 7 + p_partkey % 7 end").alias("parent"))
    return contours.hole_parity(t)


@query()
def traced_rings(spark, sf_dir):
    """Rings around the masks: areas of outer rings less those of holes are the masks' pixels; held against brute force in tests."""
    m = contours.measures(contours.trace(mask(spark, sf_dir)))
    return m.select("image_id", "ring", "n", "area", "perimeter")


@query()
def douglas_peucker(spark, sf_dir):
    return contours.simplify(rings(spark, sf_dir), 1.0)


@query()
def kmeans_palette(spark, sf_dir):
    from .raster_queries import rgb

    return metrics.kmeans_palette(rgb(spark, sf_dir), 4).select("image_id", "r", "g", "b", "n", "label")


def carried_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of artwork metrics, from whole-number arithmetic on their keys."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("image_id"),
        (k % 41 / 100).alias("foreground_percent"), (k % 23 / 200).alias("edge_density"), (k % 29).cast("int").alias("component_count"), (k % 7).cast("int").alias("significant_component_count"), (k % 11).cast("int").alias("tiny_component_count"), (k % 9).cast("int").alias("small_component_count"),
        (k % 97).cast("int").alias("contour_count"), (k % 71).cast("int").alias("hole_count"), (k % 61 / 100).alias("narrow_feature_percent"), (k % 13 / 2).alias("median_feature_width_px"), (k % 59 / 101).alias("large_solid_region_percent"), (k % 53).cast("double").alias("boundary_roughness"), (k % 31 / 100).alias("lower_profile_variation"), (k % 3).cast("int").alias("lower_slender_component_count"),
    )


_M = """m AS (SELECT o_orderkey AS image_id, o_orderkey % 41 / 100.0::DOUBLE AS fg, o_orderkey % 23 / 200.0::DOUBLE AS ed, o_orderkey % 29 AS cc, o_orderkey % 7 AS sig, o_orderkey % 11 AS tiny, o_orderkey % 9 AS sm, o_orderkey % 97 AS con, o_orderkey % 71 AS ho, o_orderkey % 61 / 100.0::DOUBLE AS nar, o_orderkey % 13 / 2.0::DOUBLE AS med, o_orderkey % 59 / 101.0::DOUBLE AS sol, (o_orderkey % 53)::DOUBLE AS rough, o_orderkey % 31 / 100.0::DOUBLE AS low, o_orderkey % 3 AS slen FROM orders),
sg AS (SELECT *, least(nar / 0.35, 2.0) + least(ed / 0.08, 1.8) + least(ho / 60.0::DOUBLE, 2.2) + least(con / 90.0::DOUBLE, 1.6) AS fine,
least(sm / 5.0::DOUBLE, 1.8) + least(cc / 18.0::DOUBLE, 1.0) + least(rough / 28.0, 1.8) + CASE WHEN fg < 0.18 AND cc >= 8 THEN 0.8 ELSE 0 END + CASE WHEN ho BETWEEN 12 AND 60 THEN 0.6 ELSE 0 END AS spl,
slen * 2.8 + least(low / 0.18, 1.6) + CASE WHEN fg < 0.14 THEN 1.0 ELSE 0 END + CASE WHEN con <= 30 THEN 0.7 ELSE 0 END AS drip, least(sig / 4.0::DOUBLE, 2.0) + CASE WHEN cc >= 8 AND tiny < cc * 0.5 THEN 0.8 ELSE 0 END AS apart,
CASE WHEN sig <= 2 THEN 1.4 ELSE 0 END + least(sol / 0.32, 1.4) + CASE WHEN ed < 0.035 THEN 0.8 ELSE 0 END + CASE WHEN rough < 28 THEN 0.6 ELSE 0 END AS clean FROM m),
p AS (SELECT *, 1.0 + clean - CASE WHEN ho >= 30 AND sm < 4 THEN 0.8 ELSE 0 END - CASE WHEN sol > 0.5 AND cc > 8 THEN 1.0 ELSE 0 END + CASE WHEN cc <= 3 AND sol > 0.28 AND ed < 0.04 THEN 1.4 ELSE 0 END AS clean_logo,
1.2 + fine + least(rough / 45.0, 1.0) + CASE WHEN fg > 0.22 AND rough > 38 THEN 1.2 ELSE 0 END + CASE WHEN ho >= 30 AND sm < 4 THEN 1.5 ELSE 0 END AS detail_preserving,
0.8 + drip + CASE WHEN slen > 0 AND fg < 0.14 THEN 1.5 ELSE 0 END AS drip_logo,
0.7 + spl + CASE WHEN sm >= 6 AND fg < 0.2 THEN 1.3 ELSE 0 END - CASE WHEN ho >= 30 AND sm < 4 THEN 1.4 ELSE 0 END - CASE WHEN slen > 0 AND fg < 0.14 THEN 0.5 ELSE 0 END AS splatter_logo,
1.0 + fine + CASE WHEN nar > 0.35 THEN 1.0 ELSE 0 END + CASE WHEN nar > 0.45 AND med < 4 THEN 1.5 ELSE 0 END - CASE WHEN fg > 0.22 AND rough > 38 THEN 0.8 ELSE 0 END - CASE WHEN sm >= 6 AND fg < 0.2 THEN 0.8 ELSE 0 END + CASE WHEN ho >= 30 AND sm < 4 THEN 0.8 ELSE 0 END AS line_art,
0.7 + apart AS preserve_floating_islands FROM sg),
sc AS (SELECT image_id, nar, med, sol, ed, round(clean_logo, 4)::DOUBLE AS clean_logo, round(detail_preserving, 4)::DOUBLE AS detail_preserving, round(drip_logo, 4)::DOUBLE AS drip_logo, round(splatter_logo, 4)::DOUBLE AS splatter_logo, round(line_art, 4)::DOUBLE AS line_art, round(preserve_floating_islands, 4)::DOUBLE AS preserve_floating_islands,
(2.2 + CASE WHEN greatest(clean_logo, detail_preserving, drip_logo, splatter_logo, line_art, preserve_floating_islands, 2.2) < 4.0 THEN 0.8 ELSE 0 END)::DOUBLE AS "default" FROM p)"""


@query(f"{_M} SELECT * EXCLUDE (nar, med, sol, ed) FROM sc")
def preset_scores(spark, sf_dir):
    return scoring.preset_scores(carried_metrics(spark, sf_dir)).select("image_id", "scores.*")


@query(f"""{_M}, u AS (UNPIVOT sc ON clean_logo, detail_preserving, drip_logo, splatter_logo, line_art, preserve_floating_islands, "default" INTO NAME preset VALUE score),
k AS (SELECT *, list_position(['clean_logo', 'detail_preserving', 'drip_logo', 'splatter_logo', 'line_art', 'preserve_floating_islands', 'default'], preset) AS pr FROM u), o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pr) AS rn, lead(score) OVER (PARTITION BY image_id ORDER BY score DESC, pr) AS second FROM k)
SELECT image_id, preset, CASE WHEN score >= 6.0 AND score - second >= 1.2 THEN 'high' WHEN score >= 4.0 AND score - second >= 0.55 THEN 'medium' ELSE 'low' END AS confidence,
(CASE WHEN preset IN ('line_art', 'detail_preserving') THEN CASE WHEN nar > 0.32 OR med < 4.0 THEN 2.0 ELSE 2.5 END WHEN preset IN ('drip_logo', 'splatter_logo') THEN CASE WHEN sol > 0.28 THEN 3.0 ELSE 2.5 END WHEN preset = 'clean_logo' AND sol > 0.36 THEN 3.0 ELSE 2.5 END)::DOUBLE AS thickness_mm FROM o WHERE rn = 1""")
def recommendation(spark, sf_dir):
    return scoring.recommend(scoring.preset_scores(carried_metrics(spark, sf_dir))).select("image_id", "preset", "confidence", "thickness_mm")


def carried_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as quality runs: the customer is the image, the priority the preset."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("run"), F.col("o_custkey").alias("image"), F.regexp_replace("o_orderpriority", "1-URGENT", "default").alias("preset"), F.when(k % 17 == 0, 1).otherwise(0).alias("failures"), (k % 7).cast("int").alias("warnings"), (k % 5 != 0).alias("watertight"), F.when(k % 19 == 0, 0).otherwise(100).alias("face_count"), (k % 3 == 0).alias("fallback_used"), F.greatest(k % 13 - 9, F.lit(0)).cast("int").alias("preserved"), (k % 4).cast("int").alias("removed"))


_RUNS = """runs AS (SELECT o_orderkey AS run, o_custkey AS image, replace(o_orderpriority, '1-URGENT', 'default') AS preset, CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS failures, o_orderkey % 7 AS warnings, o_orderkey % 5 <> 0 AS watertight, CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE 100 END AS face_count, o_orderkey % 3 = 0 AS fallback_used, greatest(o_orderkey % 13 - 9, 0) AS preserved, o_orderkey % 4 AS removed FROM orders),
scored AS (SELECT *, greatest(0, 100 - CASE WHEN failures > 0 THEN 50 ELSE 0 END - least(25, warnings * 5) - CASE WHEN watertight THEN 0 ELSE 20 END - CASE WHEN face_count = 0 THEN 20 ELSE 0 END - CASE WHEN fallback_used THEN 5 ELSE 0 END - least(20, preserved * 2))::INT AS score,
CASE WHEN failures > 0 THEN 'failed, do not print' WHEN preserved > 0 THEN 'islands left to look at: ' || preserved WHEN warnings > 0 THEN 'has warnings' WHEN removed > 0 THEN 'islands taken out: ' || removed ELSE 'nothing to remark' END AS note FROM runs)"""


@query(f"{_RUNS} SELECT run, image, preset, score, note FROM scored")
def quality_score(spark, sf_dir):
    return scoring.quality_score(carried_runs(spark, sf_dir)).select("run", "image", "preset", "score", "note")


@query(f"{_RUNS} SELECT image, arg_min(preset, (-score, preset)) AS best_preset, max(score) AS best_score, arg_min(preset, (score, preset)) AS worst_preset, min(score) AS worst_score, count(*) AS runs FROM scored GROUP BY image")
def best_worst_per_image(spark, sf_dir):
    return scoring.best_and_worst(scoring.quality_score(carried_runs(spark, sf_dir)))


@query(f"{_RUNS}, b AS (SELECT image, max(score) AS base FROM scored WHERE preset = 'default' GROUP BY image), s AS (SELECT image, preset, max(score) AS score FROM scored GROUP BY ALL) SELECT image, preset, CASE WHEN base IS NULL THEN 'unknown' WHEN score > base THEN 'yes' WHEN score = base THEN 'neutral' ELSE 'no' END AS helped FROM s LEFT JOIN b USING (image)")
def preset_helped(spark, sf_dir):
    return scoring.preset_helped(scoring.quality_score(carried_runs(spark, sf_dir)))


@query("l AS (SELECT l_orderkey AS image_id, l_linenumber AS part, l_quantity::BIGINT AS removed_pixels, (l_partkey % 5)::BIGINT AS filled_holes, CASE WHEN l_tax > 0.02 THEN l_extendedprice END AS least_area, l_returnflag AS w FROM lineitem), s AS (SELECT image_id, w, min(part) AS first_part FROM l GROUP BY ALL), q AS (SELECT image_id, list(w ORDER BY first_part, w) AS warnings FROM s GROUP BY image_id), a AS (SELECT image_id, sum(removed_pixels)::BIGINT AS removed_pixels, sum(filled_holes)::BIGINT AS filled_holes, min(least_area) AS least_area FROM l GROUP BY image_id) SELECT image_id, removed_pixels, filled_holes, least_area, array_to_string(warnings, '|') AS warnings FROM a JOIN q USING (image_id)")
def printability_combine(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("part"), F.col("l_quantity").cast("long").alias("removed_pixels"), (F.col("l_partkey") % 5).alias("filled_holes"), F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")).alias("least_area"), F.array("l_returnflag").alias("warnings"))
    return scoring.combine_reports(l, ["removed_pixels", "filled_holes"], ["least_area"]).withColumn("warnings", F.array_join("warnings", "|"))


@query("s AS (SELECT s_suppkey, s_name, s_acctbal, s_acctbal / 3 AS v FROM supplier) SELECT s_suppkey, CASE WHEN regexp_replace(printf('%.6f', v), '\\.?0+$', '') IN ('', '-0') THEN '0' ELSE regexp_replace(printf('%.6f', v), '\\.?0+$', '') END AS trimmed, CASE WHEN s_acctbal <= 0 THEN 0 ELSE greatest(1, ceil(s_acctbal / 7)) END::INT AS px, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM s")
def scalar_functions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", measures.trimmed(F.col("s_acctbal") / 3).alias("trimmed"), measures.mm_to_pixels(F.col("s_acctbal"), F.lit(7.0)).alias("px"), measures.slug(F.col("s_name")).alias("slug"))


@query()
def stl_round_trip(spark, sf_dir):
    """Relief meshes written as STL bytes, which are read and measured again; a file without faces counts none."""
    from ..operators import meshes
    from ..sources import readers, sinks
    from ..storage import written

    f = meshes.relief_faces(mask(spark, sf_dir))
    corners = [(F.col(f"f.{p}.gx") if c == "x" else F.col(f"f.{p}.gy") if c == "y" else F.col(f"f.{p}.top")).cast("double").alias(f"{p}{c}") for p in "abc" for c in "xyz"]
    files = written(sinks.stl_files(f.select("image_id", *corners)), "stl")
    report = readers.stl_report(readers.stl_content_faces(files)).withColumn("path", F.concat("image_id", F.lit(".stl"))).drop("image_id")
    return files.select("path", F.length("content").alias("bytes")).join(report, "path", "left").fillna(0, ["faces", "edges", "open_edges", "overused_edges"])


@query()
def mask_png(spark, sf_dir):
    from ..sources import sinks

    return sinks.mask_files(mask(spark, sf_dir)).select("path", F.sha2("content", 256).alias("sha256"))


@query()
def artwork_metrics(spark, sf_dir):
    """Measures of an image in one row: each has a query of its own, and its counterpart joins theirs."""
    g, m = gray(spark, sf_dir), mask(spark, sf_dir)
    return metrics.otsu(g).join(metrics.contrast(g), "image_id").join(metrics.component_counts(m), "image_id").join(metrics.widths(m), "image_id").join(metrics.lower_profile(m), "image_id", "left")


@query(f"{_RUNS}, t AS (SELECT unnest([{{'n': count(*) FILTER (failures > 0), 'fix': 'repair the jobs that fail'}}, {{'n': count(*) FILTER (NOT watertight), 'fix': 'close open meshes'}}, {{'n': count(*) FILTER (preserved > 0), 'fix': 'raise the least island size'}}, {{'n': count(*) FILTER (fallback_used), 'fix': 'simplify outlines for the vector backend'}}]) AS f FROM runs) SELECT (row_number() OVER (ORDER BY f DESC) - 1)::INT AS place, f['fix'] AS fix, f['n'] AS runs FROM t WHERE f['n'] > 0 QUALIFY row_number() OVER (ORDER BY f DESC) <= 3")
def recommended_fixes(spark, sf_dir):
    return scoring.recommended_fixes(carried_runs(spark, sf_dir))


@query(f"""{_M.split("sg AS")[0].rstrip().rstrip(",")}, j AS (SELECT m.*, unnest(['clean_logo', 'detail_preserving', 'drip_logo', 'splatter_logo', 'line_art', 'preserve_floating_islands', 'default']) AS preset FROM m),
c AS (SELECT *, CASE WHEN image_id % 5 > 0 THEN image_id % 10 / 10.0::DOUBLE END AS contrast, preset IN ('line_art', 'detail_preserving') AS fine FROM j),
t AS (SELECT image_id, preset, list_filter([CASE WHEN fine AND nar > 0.25 THEN 'much of the shape is narrow' END, CASE WHEN fine AND ho >= 20 THEN 'the shape has many openings' END, CASE WHEN fine AND (ed >= 0.05 OR con >= 60) THEN 'dense outlines' END,
CASE WHEN preset = 'drip_logo' AND slen > 0 THEN 'slender parts hang down' END, CASE WHEN preset = 'drip_logo' AND low >= 0.16 THEN 'the lower rim is uneven' END, CASE WHEN preset = 'splatter_logo' AND sm >= 4 THEN 'many small parts' END, CASE WHEN preset = 'splatter_logo' AND rough >= 24 THEN 'rough outlines' END,
CASE WHEN preset = 'preserve_floating_islands' AND sig >= 3 THEN 'several large parts stand apart' END, CASE WHEN preset = 'clean_logo' AND sol >= 0.25 THEN 'large solid areas' END, CASE WHEN preset = 'clean_logo' AND ed < 0.04 THEN 'few outlines' END, CASE WHEN preset = 'default' THEN 'nothing stands out' END,
CASE WHEN contrast >= 0.45 THEN 'the source has good contrast' ELSE 'the source has little contrast' END], lambda x: x IS NOT NULL) AS r FROM c) SELECT image_id, preset, array_to_string(r[1:4], '|') AS reasons FROM t""")
def recommendation_reasons(spark, sf_dir):
    m = carried_metrics(spark, sf_dir).withColumn("contrast_quality", F.when(F.col("image_id") % 5 > 0, F.col("image_id") % 10 / 10))
    return scoring.reasons(scoring.matrix(m)).select("image_id", "preset", F.array_join("reasons", "|").alias("reasons"))


@query(f"""{_RUNS}, e AS (SELECT *, CASE WHEN run % 23 = 0 THEN 'stopped' END AS error FROM scored), j AS (SELECT c_custkey AS image, unnest(['default', '2-HIGH', '5-LOW']) AS preset FROM customer), r AS (SELECT j.*, e.* EXCLUDE (image, preset), e.score IS NULL OR e.error IS NOT NULL AS failed FROM j LEFT JOIN e USING (image, preset))
SELECT image, preset, run, CASE WHEN failed THEN greatest(coalesce(failures, 0), 1) ELSE failures END::INT AS failures, CASE WHEN NOT failed THEN watertight END AS watertight, CASE WHEN failed THEN 0 ELSE face_count END::INT AS face_count, CASE WHEN failed THEN 0 ELSE score END::INT AS score, CASE WHEN failed THEN coalesce(error, 'no run') ELSE note END AS note FROM r""")
def matrix_report(spark, sf_dir):
    jobs = scoring.matrix(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image")), ("default", "2-HIGH", "5-LOW"))
    return scoring.matrix_report(jobs, carried_runs(spark, sf_dir).withColumn("error", F.when(F.col("run") % 23 == 0, "stopped")))


@query("""o AS (SELECT o_orderkey AS k, 'printability: ' || o_orderstatus AS st, 'printability: ' || o_orderpriority AS pr FROM orders) SELECT k AS image_id, CASE WHEN k % 3 = 0 THEN st || '|' || pr ELSE pr || '|' || st END
|| CASE WHEN k % 2 = 0 AND k % 4 <> 0 THEN '|model package not made' || CASE WHEN k % 8 = 2 THEN ': no faces; open edges' ELSE '' END ELSE '' END AS warnings FROM o""")
def job_warnings(spark, sf_dir):
    k, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    known = F.when(k % 3 == 0, F.array(F.concat(F.lit("printability: "), status)))
    listed = scoring.with_report_warnings(known, F.array(priority, status, priority))
    errors = F.when(k % 8 == 2, F.array(F.lit("no faces"), F.lit("open edges")))
    return table(spark, sf_dir, "orders").select(k.alias("image_id"), F.array_join(scoring.with_package_warning(listed, k % 2 == 0, k % 4 == 0, errors), "|").alias("warnings"))


_MEASURES_OF = ("otsu_threshold", "contrast_quality", "component_counts", "feature_widths")
SQL["artwork_metrics"] = "SELECT * FROM " + " JOIN ".join(f"({RASTER_SQL[n]}) AS {n}" + (" USING (image_id)" if k else "") for k, n in enumerate(_MEASURES_OF)) + f" LEFT JOIN ({RASTER_SQL['lower_profile']}) AS lower_profile USING (image_id)"
