"""Queries over 64 x 64 images that rows of ``embeddings`` make up, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, edges, filters, masks, neighbourhood, regions
from ..sources import rasters
from ..storage import table
from .report_queries import _M, SQL as _REPORTS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH RECURSIVE " + sql
        return f

    return add


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.stacked_images(table(spark, sf_dir, "embeddings"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray(spark, sf_dir).select(*masks.KEY, F.col("g").alias("r"), "g", F.expr("g * 7 div 8").cast("int").alias("b"))


#: Pixels of the larger images, and their sizes.
PX = """px AS (SELECT image_id, y, x, least(255, greatest(0, floor((v::DOUBLE + 0.55) * 255 / 1.1)))::INT // 4 + CASE WHEN (x - 32) * (x - 32) + (y - 32) * (y - 32) < 300 + 100 * (image_id % 4) THEN 20 WHEN (x // 8 + y // 8) % 5 = 0 THEN 100 ELSE 160 END AS g
 FROM (SELECT vec_id // 64 AS image_id, (vec_id % 64)::INT AS y, (generate_subscripts(embedding, 1) - 1)::INT AS x, unnest(embedding) AS v FROM embeddings)),
sz AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY image_id)"""


def _mirrored(k: str, n: str) -> str:
    return f"({n}) - 1 - abs(({n}) - 1 - abs({k}))"


def _repeated(k: str, n: str) -> str:
    return f"greatest(0, least(({n}) - 1, {k}))"


def _filtered(name: str, size: int, border, source: str = "px") -> str:
    """Both passes of a Gaussian; kernels are no wider than the images, so that one fold brings a place back."""
    taps = ", ".join(f"({k - size // 2}, {w}::BIGINT)" for k, w in enumerate(filters.gaussian_taps(size)))
    return f"""{name}t(k, w) AS (VALUES {taps}),
{name}r AS (SELECT a.image_id, a.y, a.x, sum(b.g * t.w)::BIGINT AS s FROM {source} a JOIN sz USING (image_id), {name}t t, {source} b WHERE b.image_id = a.image_id AND b.y = a.y AND b.x = {border('a.x + t.k', 'sz.w')} GROUP BY ALL),
{name} AS (SELECT a.image_id, a.y, a.x, ((sum(b.s::HUGEINT * t.w) + 2147483648) // 4294967296)::INT AS g FROM {name}r a JOIN sz USING (image_id), {name}t t, {name}r b WHERE b.image_id = a.image_id AND b.x = a.x AND b.y = {border('a.y + t.k', 'sz.h')} GROUP BY ALL)"""


@query(f"{PX}, {_filtered('three', 3, _mirrored)}, {_filtered('five', 5, _mirrored)}, {_filtered('eleven', 11, _mirrored)} SELECT image_id, y, x, three.g AS g3, five.g AS g5, eleven.g AS g11 FROM three JOIN five USING (image_id, y, x) JOIN eleven USING (image_id, y, x)")
def gaussian_blurs(spark, sf_dir):
    g = gray(spark, sf_dir)
    out = filters.blur(g, 3).withColumnRenamed("g", "g3")
    for size in (5, 11):
        out = out.join(filters.blur(g, size).withColumnRenamed("g", f"g{size}"), masks.KEY)
    return out


@query(f"{PX}, {_filtered('around', 11, _repeated)}, {_filtered('close', 5, _repeated)} SELECT px.image_id, px.y, px.x, px.g <= around.g - 3 AS m11, px.g <= close.g - 3 AS m5 FROM px JOIN around USING (image_id, y, x) JOIN close USING (image_id, y, x)")
def adaptive_blocks(spark, sf_dir):
    g = gray(spark, sf_dir)
    return filters.adaptive_threshold(g, 11).withColumnRenamed("m", "m11").join(filters.adaptive_threshold(g, 4).withColumnRenamed("m", "m5"), masks.KEY)


_EDGES = """sob AS (SELECT a.image_id, a.y, a.x, sum(b.g * o.i * (2 - abs(o.j)))::INT AS gx, sum(b.g * o.j * (2 - abs(o.i)))::INT AS gy FROM px a JOIN sz USING (image_id), (SELECT j, i FROM (VALUES (-1), (0), (1)) AS j(j), (VALUES (-1), (0), (1)) AS i(i)) AS o, px b WHERE b.image_id = a.image_id AND b.y = greatest(0, least(sz.h - 1, a.y + o.j)) AND b.x = greatest(0, least(sz.w - 1, a.x + o.i)) GROUP BY ALL),
mag AS (SELECT *, abs(gx) + abs(gy) AS m FROM sob),
dir AS (SELECT *, CASE WHEN abs(gy)::BIGINT * 32768 < abs(gx)::BIGINT * 13573 THEN 0 WHEN abs(gy)::BIGINT * 32768 > abs(gx)::BIGINT * (13573 + 65536) THEN 1 WHEN (gx < 0) <> (gy < 0) THEN 2 ELSE 3 END AS d FROM mag),
thin AS MATERIALIZED (SELECT d.image_id, d.y, d.x, d.m FROM dir d LEFT JOIN mag p ON p.image_id = d.image_id AND p.y = d.y + CASE d.d WHEN 0 THEN 0 ELSE -1 END AND p.x = d.x + CASE d.d WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE -1 END
 LEFT JOIN mag q ON q.image_id = d.image_id AND q.y = d.y + CASE d.d WHEN 0 THEN 0 ELSE 1 END AND q.x = d.x + CASE d.d WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 1 END WHERE d.m > 80 AND d.m > coalesce(p.m, 0) AND CASE WHEN d.d < 2 THEN d.m >= coalesce(q.m, 0) ELSE d.m > coalesce(q.m, 0) END),
edge AS (SELECT image_id, y, x FROM thin WHERE m > 160 UNION SELECT t.image_id, t.y, t.x FROM edge e JOIN thin t ON t.image_id = e.image_id AND abs(t.y - e.y) <= 1 AND abs(t.x - e.x) <= 1)"""


@query(f"{PX}, {_EDGES} SELECT image_id, y, x FROM edge")
def canny_edges(spark, sf_dir):
    return edges.canny(gray(spark, sf_dir))


def _sizes(spark, sf_dir, most: int) -> DataFrame:
    return filters.sampled_sizes(filters.sizes_of(gray(spark, sf_dir)), most)


_TO = "dst AS (SELECT image_id, w, h, greatest(1, floor(w * least(1.0::DOUBLE, sqrt({n}.0::DOUBLE / (w * h)))))::INT AS tw, greatest(1, floor(h * least(1.0::DOUBLE, sqrt({n}.0::DOUBLE / (w * h)))))::INT AS th FROM sz)"


def _lanczos(name: str, src: str, to: str, line: str, pos: str, source: str, values: str = "g") -> str:
    return f"""{name}p AS (SELECT DISTINCT {src} AS src, {to} AS dst FROM dst),
{name}q AS (SELECT *, greatest(1.0::DOUBLE, src / dst::DOUBLE) AS wide, (t + 0.5) * (src / dst::DOUBLE) AS c FROM (SELECT src, dst, unnest(range(dst)) AS t FROM {name}p)),
{name}s AS (SELECT *, (s - c + 0.5) / wide AS a FROM (SELECT *, unnest(range(greatest(0, floor(c - wide * 3 + 0.5))::BIGINT, least(src, floor(c + wide * 3 + 0.5))::BIGINT)) AS s FROM {name}q)),
{name}f AS (SELECT *, CASE WHEN abs(a) < 3 THEN CASE WHEN a = 0 THEN 1.0 ELSE sin(a * pi()) / (a * pi()) * (sin(a / 3 * pi()) / (a / 3 * pi())) END ELSE 0.0 END::DOUBLE AS f FROM {name}s),
{name}w AS (SELECT src, dst, t, s, CASE WHEN f < 0 THEN ceil(f / tot * 4194304 - 0.5) ELSE floor(f / tot * 4194304 + 0.5) END::BIGINT AS w FROM (SELECT *, sum(f) OVER (PARTITION BY src, dst, t) AS tot FROM {name}f)),
{name} AS (SELECT p.image_id, p.{line}, k.t::INT AS {pos}, greatest(0, least(255, (sum(p.g * k.w) + 2097152) >> 22))::INT AS g FROM (SELECT image_id, y, x, g::BIGINT AS g FROM {source}) p JOIN dst d USING (image_id) JOIN {name}w k ON k.src = d.{src} AND k.dst = d.{to} AND k.s = p.{pos} GROUP BY ALL)"""


@query(f"{PX}, {_TO.format(n=1500)}, {_lanczos('rows_', 'w', 'tw', 'y', 'x', 'px')}, {_lanczos('cols_', 'h', 'th', 'x', 'y', 'rows_')} SELECT image_id, y, x, g FROM cols_")
def lanczos_budget(spark, sf_dir):
    """Images scaled down to 1,500 pixels: 38 x 38 for 64 x 64."""
    return filters.lanczos(gray(spark, sf_dir), _sizes(spark, sf_dir, 1500), ["g"])


@query(f"""{PX}, {_TO.format(n=900)}, m AS (SELECT image_id, y, x, g < 128 AS m FROM px), cell AS (SELECT d.*, ty, tx FROM dst d, (SELECT unnest(range(64)) AS ty), (SELECT unnest(range(64)) AS tx) WHERE ty < th AND tx < tw),
cover AS (SELECT c.image_id, c.ty, c.tx, c.w, c.h, sum((least((p.x + 1) * c.tw, (c.tx + 1) * c.w) - greatest(p.x * c.tw, c.tx * c.w)) * (least((p.y + 1) * c.th, (c.ty + 1) * c.h) - greatest(p.y * c.th, c.ty * c.h)) * p.m::INT) AS on_area
 FROM cell c JOIN m p ON p.image_id = c.image_id AND p.x BETWEEN c.tx * c.w // c.tw AND ((c.tx + 1) * c.w - 1) // c.tw AND p.y BETWEEN c.ty * c.h // c.th AND ((c.ty + 1) * c.h - 1) // c.th GROUP BY ALL)
SELECT image_id, ty::INT AS y, tx::INT AS x, 2 * on_area > w * h AS m FROM cover""")
def mask_budget(spark, sf_dir):
    """Masks brought to 900 pixels, in ratios that are no whole numbers."""
    return filters.shrink_mask(masks.threshold(gray(spark, sf_dir)), _sizes(spark, sf_dir, 900))


_STEP = "0.955::DOUBLE * (greatest(abs(a.y - b.y), abs(a.x - b.x)) - least(abs(a.y - b.y), abs(a.x - b.x))) + 1.3693::DOUBLE * least(abs(a.y - b.y), abs(a.x - b.x))"
_WIDTHS = f"dist AS (SELECT a.image_id, a.y, a.x, min({_STEP}) AS d FROM mask a JOIN mask b ON a.image_id = b.image_id AND a.m AND NOT b.m GROUP BY ALL)"


@query(f"{PX}, mask AS (SELECT image_id, y, x, g < 128 AND (x - 32) * (x - 32) + (y - 32) * (y - 32) < 1200 OR x < 40 AND y < 40 AS m FROM px), {_WIDTHS} SELECT image_id, y, x, round(d, 4) AS d FROM dist")
def far_distances(spark, sf_dir):
    """Distances to the outside of masks that are wider than a tile."""
    near = (F.col("x") - 32) * (F.col("x") - 32) + (F.col("y") - 32) * (F.col("y") - 32) < 1200
    m = gray(spark, sf_dir).select(*masks.KEY, (((F.col("g") < 128) & near) | ((F.col("x") < 40) & (F.col("y") < 40))).alias("m"))
    return neighbourhood.full_distance(m).where("m").select(*masks.KEY, F.round("d", 4).alias("d"))


def labelled(name: str, on: str, near: str, side: int = 64) -> str:
    """Least pixel number of each component: labels are replaced by lesser ones of neighbours until none is left."""
    return f"""{name}n AS MATERIALIZED (SELECT a.image_id, a.y * {side} + a.x AS p, b.y * {side} + b.x AS q FROM {on} a, (VALUES {near}) AS o(j, i), {on} b WHERE b.image_id = a.image_id AND b.y = a.y + o.j AND b.x = a.x + o.i),
{name}(image_id, p, root) USING KEY (image_id, p) AS (SELECT image_id, y * {side} + x, y * {side} + x FROM {on} UNION SELECT c.image_id, c.p, min(t.root) FROM {name} t JOIN {name}n e ON e.image_id = t.image_id AND e.p = t.p JOIN recurring.{name} c ON c.image_id = t.image_id AND c.p = e.q WHERE t.root < c.root GROUP BY c.image_id, c.p)"""


EIGHT = "(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)"
FOUR = "(-1, 0), (0, -1), (0, 1), (1, 0)"


@query(f"{PX}, onp AS (SELECT image_id, y, x FROM px WHERE g < 150), {labelled('lab', 'onp', EIGHT)} SELECT image_id, count(*) AS components, max(area) AS largest, sum(area * area)::BIGINT AS squares FROM (SELECT image_id, root, count(*) AS area FROM lab GROUP BY ALL) GROUP BY image_id")
def large_components(spark, sf_dir):
    c = regions.components(masks.threshold(gray(spark, sf_dir), 150)).groupBy("image_id", "comp").agg(F.count("*").alias("area"))
    return c.groupBy("image_id").agg(F.count("*").alias("components"), F.max("area").alias("largest"), F.sum(F.col("area") * F.col("area")).alias("squares"))


_LUMA = PX.replace("px AS", "px0 AS", 1).replace("FROM px ", "FROM px0 ") + ", px AS (SELECT image_id, y, x, ((g * 299 + g * 587 + g * 7 // 8 * 114 + 500) // 1000)::INT AS g FROM px0)"
_METRICS = f"""{_LUMA}, {_EDGES}, {_filtered('soft', 3, _mirrored)},
hi AS (SELECT image_id, g, count(*) AS n FROM soft GROUP BY ALL), cu AS (SELECT *, sum(n) OVER w AS below, sum(n * g) OVER w AS mass, sum(n) OVER (PARTITION BY image_id) AS al, sum(n * g) OVER (PARTITION BY image_id) AS total FROM hi WINDOW w AS (PARTITION BY image_id ORDER BY g)),
ot AS (SELECT image_id, max_by(g, (b, -g)) AS cut FROM (SELECT image_id, g, round(below * (al - below) * (mass / below - (total - mass) / (al - below)) * (mass / below - (total - mass) / (al - below)), 6) AS b FROM cu WHERE below < al) GROUP BY image_id),
sd AS (SELECT s.*, cut, (y IN (0, h - 1))::INT + (x IN (0, w - 1))::INT AS t FROM soft s JOIN ot USING (image_id) JOIN sz USING (image_id)),
ch AS (SELECT image_id, (sum((g > cut)::INT * t) / sum(t)::DOUBLE, abs(avg((g > cut)::INT) - 0.3)) < (sum((g < cut)::INT * t) / sum(t)::DOUBLE, abs(avg((g < cut)::INT) - 0.3)) AS high FROM sd GROUP BY image_id),
mask AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN high THEN g > cut ELSE g < cut END AS m FROM sd JOIN ch USING (image_id)),
onp AS MATERIALIZED (SELECT image_id, y, x FROM mask WHERE m), off AS MATERIALIZED (SELECT image_id, y, x FROM mask WHERE NOT m), {labelled('lab', 'onp', EIGHT)}, {labelled('bg', 'off', FOUR)}, {_WIDTHS},
ar AS (SELECT image_id, root, count(*) AS area FROM lab GROUP BY ALL),
cc AS (SELECT image_id, count(area) AS components, count(*) FILTER (area >= greatest(24.0, w * h * 0.002)) AS significant, count(*) FILTER (area >= greatest(6.0, w * h * 0.00025) AND area < greatest(24.0, w * h * 0.002)) AS small, count(*) FILTER (area < greatest(6.0, w * h * 0.00025)) AS tiny FROM sz LEFT JOIN ar USING (image_id) GROUP BY image_id, w, h),
ho AS (SELECT image_id, count(*) AS holes, avg(area / (w * h)::DOUBLE) AS share FROM (SELECT image_id, root, count(*) AS area, bool_or(p // 64 IN (0, h - 1) OR p % 64 IN (0, w - 1)) AS open, any_value(w) AS w, any_value(h) AS h FROM bg JOIN sz USING (image_id) GROUP BY image_id, root) WHERE NOT open GROUP BY image_id),
ed AS (SELECT image_id, count(*) AS n FROM edge GROUP BY image_id),
wi AS (SELECT image_id, avg((round(d, 4) <= 1.5)::INT) AS narrow, median(round(d, 4)) * 2 AS width, avg((round(d, 4) >= 6)::INT) AS solid FROM dist GROUP BY image_id),
ex AS (SELECT a.image_id, count(*) AS sides FROM onp a, (VALUES {FOUR}) AS o(j, i) WHERE NOT EXISTS (SELECT 1 FROM onp b WHERE b.image_id = a.image_id AND b.y = a.y + o.j AND b.x = a.x + o.i) GROUP BY a.image_id),
tl AS (SELECT image_id, min(y) AS top, max(y) - min(y) + 1 AS tall, count(*) AS n FROM onp GROUP BY image_id),
lo AS (SELECT image_id, stddev_pop((low - top) / tall::DOUBLE) AS v FROM (SELECT image_id, x, max(y) AS low FROM onp GROUP BY ALL) JOIN tl USING (image_id) GROUP BY image_id),
down AS MATERIALIZED (SELECT o.image_id, y, x FROM onp o JOIN tl USING (image_id) WHERE y - top >= floor(tall * 0.55)), {labelled('dl', 'down', EIGHT)},
sl AS (SELECT image_id, count(*) FILTER (area > 8 AND hh / ww::DOUBLE > 1.5 AND area / (ww * hh)::DOUBLE < 0.65) AS slender FROM (SELECT image_id, root, count(*) AS area, max(p % 64) - min(p % 64) + 1 AS ww, max(p // 64) - min(p // 64) + 1 AS hh FROM dl GROUP BY ALL) GROUP BY image_id),
co AS (SELECT image_id, round((quantile_cont(g, 0.95) - quantile_cont(g, 0.05)) / 255, 5) AS contrast FROM px GROUP BY image_id),
me AS (SELECT image_id, w AS source_width, h AS source_height, w AS analysis_width, h AS analysis_height, round(coalesce(tl.n, 0) / (w * h)::DOUBLE, 5) AS foreground_percent, components AS component_count, significant AS significant_component_count, tiny AS tiny_component_count, small AS small_component_count, coalesce(holes, 0) AS hole_count, round(coalesce(share, 0), 6) AS average_hole_area_percent,
 round(coalesce(ed.n, 0) / (w * h)::DOUBLE, 5) AS edge_density, round(coalesce(narrow, 0), 5) AS narrow_feature_percent, round(coalesce(width, 0), 5) AS median_feature_width_px, round(coalesce(solid, 0), 5) AS large_solid_region_percent, round(coalesce(v, 0), 5) AS lower_profile_variation, coalesce(slender, 0) AS lower_slender_component_count, contrast AS contrast_quality, round(coalesce(sides, 0) / greatest(1.0::DOUBLE, sqrt(coalesce(tl.n, 0))), 4) AS boundary_roughness, components + coalesce(holes, 0) AS contour_count
 FROM sz JOIN cc USING (image_id) LEFT JOIN ho USING (image_id) LEFT JOIN ed USING (image_id) LEFT JOIN wi USING (image_id) LEFT JOIN ex USING (image_id) LEFT JOIN tl USING (image_id) LEFT JOIN lo USING (image_id) LEFT JOIN sl USING (image_id) LEFT JOIN co USING (image_id))"""


@query(f"{_METRICS} SELECT * FROM me")
def artwork_analysis(spark, sf_dir):
    """The 20 measures of each image."""
    return analysis.artwork_metrics(rgb(spark, sf_dir))


#: The scores of the reports' queries, over these measures in place of carried ones.
_SCORED = _M.split("),\nsg AS", 1)[1]
_NAMED = f"""{_METRICS}, m AS (SELECT image_id, foreground_percent AS fg, edge_density AS ed, component_count AS cc, significant_component_count AS sig, tiny_component_count AS tiny, small_component_count AS sm, contour_count AS con, hole_count AS ho, narrow_feature_percent AS nar, median_feature_width_px AS med, large_solid_region_percent AS sol, boundary_roughness AS rough, lower_profile_variation AS low, lower_slender_component_count AS slen FROM me"""


@query(_NAMED + "),\nsg AS" + _SCORED + _REPORTS["recommendation"].removeprefix("WITH RECURSIVE " + _M))
def artwork_recommendation(spark, sf_dir):
    """From pixels to a preset."""
    return analysis.recommendation(rgb(spark, sf_dir)).select("image_id", "preset", "confidence", "thickness_mm")


@query(f"""{PX}, soft_in AS (SELECT image_id, y, x, (g < 128)::INT * 120 AS g FROM px), {_filtered('soft', 9, _mirrored, 'soft_in')},
sh AS (SELECT p.image_id, p.y, p.x, coalesce(s.g, 0) AS a, p.g < 128 AS m FROM px p LEFT JOIN soft s ON s.image_id = p.image_id AND s.y = p.y - 3 AND s.x = p.x - 3)
SELECT image_id, y, x, CASE WHEN m THEN 245 ELSE floor(226 - 226 * a / 255.0::DOUBLE + 0.5) END::INT AS r FROM sh""")
def raised_preview(spark, sf_dir):
    """A plate above its soft shadow, layer over layer."""
    return filters.raised_preview(gray(spark, sf_dir)).select(*masks.KEY, "r")


def _job_pixels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Jobs of every mode over 8 x 8 images; some images lack a pixel, some modes and backends are unknown."""
    from .raster_queries import gray as small_gray

    px = small_gray(spark, sf_dir).where("image_id % 13 <> 0 or y <> 3 or x <> 3").select(*masks.KEY, F.col("g").alias("r"), "g", F.col("g").alias("b"), F.lit(255).alias("a"))
    i = F.col("image_id")
    mode = F.when(i % 5 == 0, "flat_relief").when(i % 5 == 1, "wall_art").when(i % 5 == 2, "lithophane").when(i % 5 == 3, "filament_swap_relief").otherwise("sculpture")
    jobs_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id")).withColumn("mode", mode).withColumn("backend", F.when(i % 3 == 0, "raster_heightfield").when(i % 7 == 0, "other").otherwise("auto_vector_first"))
    return jobs_, px


@query("""px AS (SELECT vec_id AS image_id, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x, least(255, greatest(0, floor((v::DOUBLE + 0.55) * 255 / 1.1)))::INT AS g FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)),
j AS (SELECT vec_id AS image_id, CASE vec_id % 5 WHEN 0 THEN 'flat_relief' WHEN 1 THEN 'wall_art' WHEN 2 THEN 'lithophane' WHEN 3 THEN 'filament_swap_relief' ELSE 'sculpture' END AS mode, CASE WHEN vec_id % 3 = 0 THEN 'raster_heightfield' WHEN vec_id % 7 = 0 THEN 'other' ELSE 'auto_vector_first' END AS asked FROM embeddings),
m AS (SELECT image_id, count(*) FILTER (g < 128) AS dark, sum(3.0::DOUBLE - g / 255.0::DOUBLE * (3.0::DOUBLE - 0.8::DOUBLE)) AS mm FROM px GROUP BY image_id),
e AS (SELECT *, CASE WHEN mode = 'sculpture' THEN 'the mode is unknown' WHEN mode IN ('flat_relief', 'wall_art') AND asked = 'other' THEN 'the backend is unknown' WHEN image_id % 13 = 0 THEN 'pixels are missing or repeated' WHEN mode IN ('flat_relief', 'wall_art') AND dark = 0 THEN 'the artwork is empty' END AS error FROM j JOIN m USING (image_id))
SELECT image_id, mode, error, CASE WHEN error = 'the artwork is empty' THEN 'mask' WHEN error LIKE 'pixels%' THEN 'decode' WHEN error IS NOT NULL THEN 'config' END AS stage,
 CASE WHEN error IS NOT NULL THEN NULL WHEN mode = 'lithophane' THEN 'lithophane_heightfield' WHEN mode = 'filament_swap_relief' THEN 'stacked_shells' WHEN asked = 'raster_heightfield' THEN asked ELSE 'vector_extrusion' END AS backend,
 CASE WHEN error IS NULL AND mode <> 'filament_swap_relief' THEN round(100 * CASE mode WHEN 'lithophane' THEN mm WHEN 'flat_relief' THEN dark * 2.2::DOUBLE ELSE dark * 2.8::DOUBLE END, -1) END AS volume FROM e""")
def job_modes(spark, sf_dir):
    """One report over jobs of all modes, failures among them; repaired outlines count as vector ones."""
    from ..operators import jobs

    todo, px = _job_pixels(spark, sf_dir)
    z = lambda p: p.select(*masks.KEY, F.when(F.col("g") < 100, 1.2).otherwise(0.8).alias("z"))
    report = jobs.run_jobs(todo, px, smooth=False, heights=z)
    return report.select("image_id", "mode", "error", "stage", F.regexp_replace("backend", "_repaired$", "").alias("backend"), F.when(F.col("mode") != "filament_swap_relief", F.round("volume", -1)).alias("volume"))
