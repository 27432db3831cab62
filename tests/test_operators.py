"""Operators on small synthetic rasters, against values worked out by hand or by plain loops."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from rasterloom.functions import color, measures
from rasterloom.operators import contours, layers, masks, meshes, metrics, neighbourhood, printability, regions, scoring
from rasterloom.sources import rasters, readers, sinks
from rasterloom.streaming import intake


def mask_of(spark, *images):
    rows = [(k, y, x, c == "#") for k, image in enumerate(images) for y, line in enumerate(image) for x, c in enumerate(line)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, m boolean")


def drawn(df, k=0):
    rows = [r for r in df.collect() if r["image_id"] == k]
    h, w = max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1
    out = [["?"] * w for _ in range(h)]
    for r in rows:
        out[r["y"]][r["x"]] = "#" if r["m"] else "."
    return ["".join(line) for line in out]


def test_components_join_u_shapes_and_diagonals(spark):
    m = mask_of(spark, ["#.#", "#.#", "###"], ["#..", ".#.", "..#"])
    eight = regions.stats(regions.components(m)).collect()
    assert sorted((r["image_id"], r["comp"], r["area"]) for r in eight) == [(0, "0:0", 7), (1, "0:0", 3)]
    four = regions.stats(regions.components(m, 4)).collect()
    assert sorted((r["image_id"], r["comp"], r["area"]) for r in four) == [(0, "0:0", 7), (1, "0:0", 1), (1, "1:1", 1), (1, "2:2", 1)]


def test_holes_and_their_filling(spark):
    m = mask_of(spark, ["#####", "#...#", "#.#.#", "#...#", "#####"])
    assert regions.holes(m).count() == 8
    assert drawn(regions.fill_holes(m)) == ["#####"] * 5
    assert drawn(regions.fill_holes(m, most_area=8)) == ["#####", "#...#", "#.#.#", "#...#", "#####"]
    assert drawn(regions.fill_holes(mask_of(spark, [".."]), literal=True)) == ["##"]


def test_morphology_leaves_the_outside_out(spark):
    m = mask_of(spark, ["####", "####", "####"])
    assert drawn(neighbourhood.erode(m)) == ["####"] * 3
    assert drawn(neighbourhood.outer_edge(m)) == ["...."] * 3
    dot = mask_of(spark, ["....", ".#..", "...."])
    assert drawn(neighbourhood.dilate(dot)) == ["###.", "###.", "###."]
    assert drawn(neighbourhood.median3(dot)) == ["...."] * 3


def test_distances_and_widths_have_no_cap(spark):
    tall, wide = 90, 150
    off = {1: {(0, 0)}, 2: {(y, x) for y in range(tall) for x in range(wide) if (y - 45) ** 2 + (x - 70) ** 2 > 1600}, 3: {(y, x) for y in range(tall) for x in (0, wide - 1)}, 4: set()}
    m = spark.createDataFrame([(i, y, x, (y, x) not in o) for i, o in off.items() for y in range(tall) for x in range(wide)], "image_id long, y int, x int, m boolean")
    out = {i: np.array(sorted(o)) for i, o in off.items() if o}
    for r in neighbourhood.full_distance(m).collect():
        if r["image_id"] == 4:
            assert r["d"] == 16
        else:
            d = np.abs(out[r["image_id"]] - (r["y"], r["x"]))
            assert r["d"] == pytest.approx(((d.max(1) - d.min(1)) * neighbourhood.STRAIGHT + d.min(1) * neighbourhood.DIAGONAL).min())
    got = {r["image_id"]: r["median_width"] for r in metrics.widths(m).collect()}
    assert got[1] > 150 and got[3] > 70 and got[4] == 32


def test_hole_parity_of_deep_nests_and_cycles(spark, monkeypatch):
    nest = spark.createDataFrame([(1, k, k - 1 if k else None) for k in range(301)], "image_id long, ring long, parent long")
    got = {r["ring"]: (r["depth"], r["hole"]) for r in contours.hole_parity(nest).collect()}
    assert got == {k: (k, k % 2 == 1) for k in range(301)}
    monkeypatch.setattr(contours, "MAX_ROUNDS", 3)
    with pytest.raises(RuntimeError):
        contours.hole_parity(spark.createDataFrame([(1, 0, 1), (1, 1, 0)], nest.schema))


def test_stl_round_trip_measures_the_written_bytes(spark):
    from rasterloom.plans.raster_queries import mask
    from rasterloom.plans.report_queries import stl_round_trip

    got = stl_round_trip(spark, f"{DATA}/sf0.001").collect()
    faces = meshes.relief_faces(mask(spark, f"{DATA}/sf0.001")).groupBy("image_id").count().collect()
    assert {r["path"]: r["faces"] for r in got} == {f"{r['image_id']}.stl": r["count"] for r in faces}
    assert all(r["bytes"] == 84 + 50 * r["faces"] and 2 * r["edges"] <= 3 * r["faces"] + r["open_edges"] and r["min_x"] < r["max_x"] for r in got)


def test_distance_over_tiles_agrees_with_a_plain_search(spark):
    r = np.random.default_rng(1)
    a = r.random((24, 24)) < 0.93
    m = spark.createDataFrame([(0, y, x, bool(a[y, x])) for y in range(24) for x in range(24)], "image_id long, y int, x int, m boolean")
    off = np.argwhere(~a)
    for row in neighbourhood.distance(m, limit=4).collect():
        d = np.abs(off - [row["y"], row["x"]])
        expected = min(4.0, float((0.955 * (d.max(1) - d.min(1)) + 1.3693 * d.min(1)).min())) if row["m"] else 0.0
        assert row["d"] == pytest.approx(expected)


def test_diagonal_contacts_are_resolved(spark):
    m = mask_of(spark, ["....", ".#..", "..#.", "...."])
    assert neighbourhood.diagonal_contacts(m).count() == 1
    assert neighbourhood.diagonal_contacts(neighbourhood.resolve_contacts(m)).count() == 0


def test_rectangles_cover_the_mask_once(spark):
    m = mask_of(spark, ["##.#", "##.#", ".###"])
    cells = sorted((y, x) for r in masks.rectangles(m).collect() for y in range(r["y0"], r["y1"]) for x in range(r["x0"], r["x1"]))
    assert cells == sorted((r["y"], r["x"]) for r in m.where("m").collect())


def test_closed_forms_of_meshes(spark):
    g = spark.createDataFrame([(0, y, x, 10 * y + x) for y in range(3) for x in range(4)], "image_id long, y int, x int, g int")
    r = meshes.lithophane_report(meshes.thickness(g), 40.0).first()
    assert (r["face_count"], r["vertex_count"], r["height_mm"]) == (4 * 12 + 4 * 7, 2 * 4 * 5, 30.0)
    assert r["watertight"] and r["edges"] == r["face_count"] * 3 // 2
    touching = meshes.edge_report(meshes.relief_faces(mask_of(spark, ["#.", ".#"]))).first()
    assert not touching["watertight"] and touching["overused_edges"] == 1
    with pytest.raises(ValueError):
        meshes.thickness(g, 3.0, 0.8)


def test_thickness_row(spark):
    g = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 255)], "image_id long, y int, x int, g int")
    assert [r["mm"] for r in meshes.thickness(g).orderBy("x").collect()] == pytest.approx([3.0, 0.8])
    assert [r["mm"] for r in meshes.thickness(g, invert=True).orderBy("x").collect()] == pytest.approx([0.8, 3.0])


def test_walls_split_at_levels(spark):
    h = spark.createDataFrame([(0, 0, 0, 0.8), (0, 0, 1, 2.0), (0, 0, 2, 1.2)], "image_id long, y int, x int, z double")
    west = meshes.step_walls(h).where("x = 1 and side = 'west'").orderBy("low").collect()
    assert [(r["low"], r["high"]) for r in west] == [(0.8, 1.2), (1.2, 2.0)]


@pytest.mark.parametrize(
    ("options", "tops", "changes", "last"),
    [
        ({}, [0.8, 1.2, 1.6], [None, 5, 7], 8),
        ({"first": 0.28, "layer": 0.16}, [0.92, 1.24, 1.72], [None, 6, 8], 10),
        ({"step": 0.8, "solid": 2.0}, [2.8, 3.6, 4.4], [11, 15, 19], 22),
    ],
)
def test_layer_plans(spark, options, tops, changes, last):
    colors = spark.createDataFrame([(0, k, k) for k in range(3)], "image_id long, ord int, label int")
    p = layers.plan(colors, **options).orderBy("ord").collect()
    assert [r["top_mm"] for r in p] == pytest.approx(tops)
    assert [r["change_before_layer"] for r in p] == changes
    assert p[-1]["last_layer"] == last


def test_bands_never_collapse(spark):
    colors = spark.createDataFrame([(0, k, k) for k in range(5)], "image_id long, ord int, label int")
    p = layers.plan(colors, base=0.2, step=0.05, first=0.2, layer=0.2).orderBy("ord").collect()
    assert [r["last_layer"] for r in p] == [1, 2, 3, 4, 5]


def test_traced_rings_enclose_the_mask(spark):
    m = mask_of(spark, ["####", "#..#", "####"], ["#.", ".#"])
    areas = {}
    for r in contours.measures(contours.trace(m)).collect():
        areas.setdefault(r["image_id"], []).append(r["area"])
    assert sorted(areas[0]) == [-2.0, 12.0]
    assert sum(areas[1]) == 2.0


def test_simplified_square_keeps_its_corners(spark):
    points = [(0.0, 0.0), (1, 0.01), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1)]
    ring = spark.createDataFrame([(0, 0, k, float(x), float(y)) for k, (x, y) in enumerate(points)], "image_id long, ring int, seq int, px double, py double")
    assert sorted((r["px"], r["py"]) for r in contours.simplify(ring, 0.1).collect()) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert contours.merge_collinear(ring, 3.0).count() == 4


def test_colors(spark):
    named = [((255, 255, 255), "white"), ((0, 0, 0), "black"), ((128, 128, 128), "gray"), ((230, 20, 20), "red"), ((20, 200, 20), "green"), ((20, 20, 200), "blue"), ((200, 180, 20), "custom color")]
    d = spark.createDataFrame([(*c, n) for c, n in named], "r int, g int, b int, n string")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    got = d.select("n", color.color_name(r, g, b).alias("name"), color.hex_color(r, g, b).alias("hex"), color.lab(r, g, b)["l"].alias("l")).collect()
    assert all(x["n"] == x["name"] for x in got)
    assert got[0]["hex"] == "#FFFFFF" and got[0]["l"] == pytest.approx(100, abs=0.01)
    assert spark.range(1).select(color.normal_hex(F.lit("ff00aa")).alias("v")).first()["v"] == "#FF00AA"


def test_numbers(spark):
    d = spark.createDataFrame([(0.125, "0.12"), (-0.0, "0"), (2.5, "2.5"), (-1.0, "-1")], "v double, t string")
    assert all(r["t"] == r["x"] for r in d.withColumn("x", measures.trimmed(F.col("v"), 2)).collect())


def test_otsu_and_empty_images(spark):
    g = spark.createDataFrame([(0, 0, x, 10 if x < 4 else 200) for x in range(8)] + [(1, 0, 0, 7)], "image_id long, y int, x int, g int")
    assert {r["image_id"]: r["cut"] for r in metrics.otsu(g).collect()} == {0: 10, 1: 0}
    assert metrics.component_counts(mask_of(spark, ["..", ".."])).first()["components"] == 0


def test_images_and_meshes_go_through_files(spark, tmp_path):
    m = mask_of(spark, ["#.#", "###"])
    for r in sinks.mask_files(m).collect():
        (tmp_path / r["path"]).write_bytes(r["content"])
    (tmp_path / "broken.png").write_bytes(b"no image")
    files = rasters.image_files(spark, f"file://{tmp_path}")
    assert {r["image_id"]: r["valid"] for r in files.collect()} == {"0_silhouette": True, "broken": False}
    px = rasters.pixels(files).select(F.lit(0).cast("long").alias("image_id"), "y", "x", (F.col("r") == 0).alias("m"))
    assert drawn(px) == ["#.#", "###"]

    f = meshes.relief_faces(m)
    corners = [(F.col(f"f.{p}.gx") if c == "x" else F.col(f"f.{p}.gy") if c == "y" else F.col(f"f.{p}.top")).cast("double").alias(f"{p}{c}") for p in "abc" for c in "xyz"]
    (tmp_path / "stl").mkdir()
    for r in sinks.stl_files(f.select("image_id", *corners)).collect():
        (tmp_path / "stl" / r["path"]).write_bytes(r["content"])
    report = readers.stl_report(readers.stl_faces(spark, f"file://{tmp_path}/stl")).first()
    assert report["faces"] == f.count() and report["watertight"] and report["max_x"] == 3.0


def test_packages_are_repeatable(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.5), (0, 2, 0.0, 1.0, -0.0)], "image_id long, vid int, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 0, 1, 2)], "image_id long, fid int, v1 int, v2 int, v3 int")
    a, b = (sinks.model_files(sinks.model_xml(v, f)).first()["content"] for _ in range(2))
    assert bytes(a) == bytes(b)
    assert '<vertex x="1" y="0" z="0.5"/>' in sinks.model_xml(v, f).first()["xml"]


def test_configuration_files(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("stl:\n  base: 1.2 # mm\n  name: 'x y'\n\nsvg:\n  on: true\n")
    got = {(r["section"], r["key"]): r["value"] for r in readers.simple_config(spark, f"file://{tmp_path}/c.yaml").collect()}
    assert got == {("stl", "base"): "1.2", ("stl", "name"): "x y", ("svg", "on"): "true"}


def test_streaming_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(sinks.png(np.zeros((2, 2))))
    (tmp_path / "in" / "b.txt").write_text("no artwork")
    job = lambda files: files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")
    q = intake.process(intake.arrivals(spark, f"file://{tmp_path}/in"), job, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination(60)
    assert [r["name"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == ["a.png"]
    # a batch that runs again, here for want of its checkpoint, replaces its rows
    q = intake.process(intake.arrivals(spark, f"file://{tmp_path}/in"), job, f"file://{tmp_path}/out", f"file://{tmp_path}/cp2")
    q.awaitTermination(60)
    assert [(r["name"], r["batch"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [("a.png", 0)]


def test_files_count_once_stable(spark, tmp_path):
    src = tmp_path / "obs"
    src.mkdir()
    for k, (path, length) in enumerate([("a", 5), ("a", 5), ("b", 1), ("b", 2), ("a", 5)]):
        (src / f"{k}.json").write_text(f'{{"path": "{path}", "length": {length}}}')
    stream = spark.readStream.schema("path string, length long").option("maxFilesPerTrigger", 1).json(f"file://{src}")
    q = intake.stable(stream).writeStream.format("memory").queryName("ready").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("ready").collect()] == [("a", 5, True)]


def test_matrix_jobs_without_a_run_are_failed_rows(spark):
    jobs = scoring.matrix(spark.createDataFrame([(1,), (2,), (None,)], "image long"), ("a", "b"))
    kind = "run long, image long, preset string, failures int, warnings int, watertight boolean, face_count int, fallback_used boolean, preserved int, removed int, error string"
    runs = [(7, 1, "a", 0, 0, True, 9, False, 0, 0, None), (8, 1, "b", 0, 0, True, 9, False, 0, 0, "out of memory"), (9, 3, "a", 0, 0, True, 9, False, 0, 0, None)]
    got = {(r["image"], r["preset"]): (r["run"], r["failures"], r["watertight"], r["face_count"], r["score"], r["note"]) for r in scoring.matrix_report(jobs, spark.createDataFrame(runs, kind)).collect()}
    none = (None, 1, None, 0, 0, "no run")
    assert got == {(1, "a"): (7, 0, True, 9, 100, "nothing to remark"), (1, "b"): (8, 1, None, 0, 0, "out of memory"), (2, "a"): none, (2, "b"): none, (None, "a"): none, (None, "b"): none}


def test_reasons_are_distinct_and_at_most_four(spark):
    names = ["narrow_feature_percent", "hole_count", "edge_density", "contour_count", "lower_slender_component_count", "lower_profile_variation", "small_component_count", "boundary_roughness", "significant_component_count", "large_solid_region_percent", "contrast_quality"]
    rows = [("line_art", *[100.0] * 11), ("drip_logo", *[None] * 11), ("default", *[0.0] * 10, 0.45)]
    got = {r["preset"]: r["reasons"] for r in scoring.reasons(spark.createDataFrame(rows, "preset string, " + ", ".join(f"{n} double" for n in names))).collect()}
    assert got["line_art"] == ["much of the shape is narrow", "the shape has many openings", "dense outlines", "the source has good contrast"]
    assert got["drip_logo"] == ["the source has little contrast"]
    assert got["default"] == ["nothing stands out", "the source has good contrast"]


def test_warnings_are_added_once(spark):
    d = spark.createDataFrame([(["a"], ["x", "x"], True, False, ["e", "f"]), (None, None, True, None, None), (["a"], None, None, False, ["e"]), (None, ["x"], True, True, None)], "w array<string>, u array<string>, wanted boolean, made boolean, errors array<string>")
    both = scoring.with_package_warning(scoring.with_report_warnings(F.col("w"), F.col("u")), F.col("wanted"), F.col("made"), F.col("errors"))
    again = scoring.with_package_warning(both, F.col("wanted"), F.col("made"), F.col("errors"))
    got = [(r["a"], r["b"]) for r in d.select(both.alias("a"), again.alias("b")).collect()]
    assert [a for a, _ in got] == [["a", "printability: x", "model package not made: e; f"], ["model package not made"], ["a"], ["printability: x"]]
    assert all(a == b for a, b in got)


def test_basic_silhouette_takes_alpha_or_the_dark_side(spark):
    clear = [(0, y, x, 200, 200, 200, 255 if x < 3 else 128) for y in range(5) for x in range(5)]
    opaque = [(1, y, x, v, v, v, 255) for y in range(5) for x in range(5) for v in [10 if x < 3 and (y, x) != (2, 1) or (y, x) == (0, 4) else 240]]
    px = spark.createDataFrame(clear + opaque, "image_id long, y int, x int, r int, g int, b int, a int")
    side = lambda **o: {(r["image_id"], r["y"], r["x"]) for r in metrics.basic_silhouette(px, F.col("r"), **o).where("m").collect()}
    left = {(k, y, x) for k in (0, 1) for y in range(5) for x in range(3)}
    assert side() == left - {(1, 2, 1)} | {(1, 0, 4)}
    assert side(invert=True) == {(k, y, x) for k in (0, 1) for y in range(5) for x in range(5)} - side()
    assert side(radius=1) >= left  # the gap is closed


def test_images_of_one_name_are_told_apart(spark, tmp_path):
    for name, shade in (("a.png", 0), ("a.PNG", 255), ("b.png", 9)):
        (tmp_path / name).write_bytes(sinks.png(np.full((2, 2), shade)))
    files = rasters.image_files(spark, f"file://{tmp_path}")
    assert {r["image_id"] for r in files.collect()} == {"a.png", "a.PNG", "b"}
    assert {(r["image_id"], r["r"]) for r in rasters.pixels(files).collect()} == {("a.png", 0), ("a.PNG", 255), ("b", 9)}


def test_a_deep_image_stays_and_is_named(spark):
    rows = [(1, 0, x, 0.1 * (x + 1)) for x in range(40)] + [(2, y, x, 1.0) for y in range(3) for x in range(3)]
    h = spark.createDataFrame(rows, "image_id long, y int, x int, z double")
    got = {(r["image_id"], r["y"], r["x"]): r["z"] for r in printability.enforce_heights(h).collect()}
    assert got == {(i, y, x): pytest.approx(z) for i, y, x, z in rows}
    assert [(r["image_id"], r["levels"]) for r in printability.height_failures(h).collect()] == [(1, 40)]
