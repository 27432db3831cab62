"""Printability, artwork stages, presets and packages on small rasters."""

import pytest
from pyspark.sql import functions as F
from test_operators import drawn, mask_of

from rasterloom.functions import measures
from rasterloom.operators import artwork, contours, presets, printability, regions, reports, scoring
from rasterloom.sources import sinks

LIMITS = {"hole_area": 3.0, "gap": 1.0, "island_area": 4.0, "segment": 4.0, "dimension": 2.0, "feature": 2.0}


def test_kernels_are_round():
    assert sorted(printability.disc(1)) == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
    assert len(printability.disc(2)) == 17 and (3, 0) in printability.disc(3) and (3, 1) not in printability.disc(3)


def test_component_actions(spark):
    m = mask_of(spark, ["##......", "##......", "........", "#####...", "........", "#.......", "......##"])
    got = {r["comp"]: r["action"] for r in printability.component_actions(m, 1.0, LIMITS).collect()}
    assert got == {"0:0": "keep", "3:0": "thicken", "5:0": "area_below_minimum", "6:6": "area_below_minimum"}
    clean = drawn(printability.clean_components(m, 1.0, LIMITS))
    assert clean[2][:5] == "#####" and clean[5] == "........" and clean[6] == "........"


def test_scale_decides_what_is_small(spark):
    m = mask_of(spark, ["....", ".##.", ".##.", "...."])
    limits = dict(printability.LIMITS)
    assert printability.clean_components(m, 0.2, limits).where("m").count() == 0
    assert printability.clean_components(m, 1.0, limits).where("m").count() == 4


def test_gaps_close_and_tiny_holes_fill(spark):
    m = mask_of(spark, ["###.###", "###.###", "#.#.###", "###.###"])
    out = printability.enforce(m, 1.0, LIMITS)
    assert drawn(out) == ["#######"] * 4
    r = printability.report(m, out, 1.0, LIMITS).first()
    assert (r["added"], r["removed"], r["changed"], r["empty"]) == (5, 0, True, False)


def test_fragments_of_a_level_fall_to_the_level_below(spark):
    rows = [(0, y, x, 1.2 if (y, x) == (4, 4) else 0.8) for y in range(9) for x in range(9)]
    h = spark.createDataFrame(rows, "image_id long, y int, x int, z double")
    assert {r["z"] for r in printability.enforce_heights(h, 1.0, LIMITS).collect()} == {0.8}


def test_keychain_and_resampling(spark):
    m = mask_of(spark, ["#" * 20] * 6, ["." * 4] * 2)
    k = printability.keychain(m, 20.0, 8.0, 4.0)
    ring = k.where("image_id = 0")
    assert ring.agg(F.max("y")).first()[0] > 6 and ring.where("m").count() > 120
    assert k.where("image_id = 1 and m").count() == 0
    square = mask_of(spark, ["##..", "##..", "....", "...."])
    assert drawn(printability.shrink(square, 2)) == ["#.", ".."]
    assert drawn(printability.enlarge(mask_of(spark, ["##", "##"]), 3)) == ["######"] * 6


def test_classes_of_an_artwork(spark):
    m = mask_of(spark, ["#######", "#######", "##...##", "##...##", "#######", "#######"])
    dark = m.select("image_id", "y", "x", ((F.col("x") == 1) & (F.col("y").between(1, 4))).alias("m"))
    c = artwork.classify(m, dark, m, 4)
    counts = c.agg(F.count_if("body"), F.count_if("hole"), F.count_if("detail")).first()
    assert tuple(counts) == (36, 6, 4)
    cut = artwork.final_mask(c, m, "engraved_details", "cut")
    assert cut.where("m").count() == 32


def test_small_colors_join_their_family(spark):
    p = spark.createDataFrame([(0, 0, 1000, 230, 20, 20), (0, 1, 100, 200, 40, 30), (0, 2, 50, 128, 128, 128), (0, 3, 900, 20, 20, 230)], "image_id long, label int, n long, r int, g int, b int")
    assert {r["label"]: r["target"] for r in artwork.merge_similar_colors(p).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_a_color_that_grows_moves(spark):
    rows = [(0, 0, 1000, 230, 20, 20), (0, 1, 300, 190, 20, 20), (0, 2, 90, 180, 90, 20), (1, 7, 10, 9, 9, 9), (1, 8, 10, 250, 0, 0)]
    p = spark.createDataFrame(rows, "image_id long, label int, n long, r int, g int, b int")
    got = {(r["image_id"], r["label"]): r["target"] for r in artwork.merge_similar_colors(p).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, 2): 1, (1, 7): 7, (1, 8): 8}  # the grown color is too large to join


def test_levels_are_repaired_from_below(spark):
    from rasterloom.operators import neighbourhood

    h = [[1, 0, 0], [0, 1, 0], [0, 0, 2]]
    rows = [(i, y, x, h[y][x]) for i in (0, 1) for y in range(3) for x in range(3)] + [(2, 0, 0, 0)]
    got = neighbourhood.repair_levels(spark.createDataFrame(rows, "image_id long, y int, x int, h int"))
    assert got.count() == len(rows)
    for level in (1, 2):
        assert neighbourhood.diagonal_contacts(got.select("image_id", "y", "x", (F.col("h") >= level).alias("m"))).count() == 0
    assert got.where("image_id = 0 and h > 0").count() == 5 and got.where("image_id = 2").first()["h"] == 0


def test_palettes_are_per_image(spark):
    from rasterloom.operators import metrics

    few = [(0, 0, x, *c) for x, c in enumerate([(0, 0, 0), (255, 255, 255), (0, 0, 0)])]
    many = [(1, y, x, 200 * (x > 4) + y, 10, 20 + x) for y in range(9) for x in range(9)]
    got = metrics.kmeans_palette(spark.createDataFrame(few + many, "image_id long, y int, x int, r int, g int, b int"), 2).collect()
    assert {(r["r"], r["label"], r["n"]) for r in got if r["image_id"] == 0} == {(0, 0, 2), (255, 1, 1)}
    assert {(r["r"] > 100, r["label"]) for r in got if r["image_id"] == 1} == {(False, 0), (True, 1)}


def test_islands_are_connected_or_left(spark):
    rows = [(0, y, x, 1 if x < 4 and y < 4 else 1 if (y, x) == (2, 6) else None) for y in range(5) for x in range(9)]
    lab = spark.createDataFrame(rows, "image_id long, y int, x int, label int").where("label is not null")
    c = regions.connections(lab, 4, 3).first()
    assert (c["sy"], c["sx"], c["ty"], c["tx"], c["d2"]) == (2, 6, 2, 3, 9)
    full = spark.createDataFrame(rows, "image_id long, y int, x int, label int")
    tied = {(r["y"], r["x"]) for r in regions.connect(full, 4, 3).where("label = 1").collect()}
    assert {(2, 4), (2, 5), (2, 6)} <= tied and len(tied) == 19
    assert regions.connections(lab, 4, 2).count() == 0


def test_jobs_report_failures_as_rows(spark):
    rows = [(k, y, x, 10, 10, 10, 255 if k == 0 else 0) for k in range(2) for y in range(6) for x in range(6)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int")
    jobs = {r["image_id"]: r for r in artwork.relief_job(px).collect()}
    assert jobs[0]["watertight"] and jobs[0]["failures"] == []
    assert jobs[1]["failures"] == ["the artwork is empty"] and jobs[1]["face_count"] == 0
    docs = artwork.status_documents(artwork.relief_job(px)).collect()
    assert all(d["status"].startswith("{") and "next:" in d["summary"] for d in docs)


def test_presets_stay_within_their_bounds(spark):
    s = spark.createDataFrame([(1, p, "island_near_body_distance_px", v) for p in presets.NAMES for v in (1.0, 5.0, 30.0)], "job long, preset string, setting string, value double")
    got = {}
    for r in presets.overlay(s).collect():
        got.setdefault(r["preset"], []).append(r["value"])
    assert sorted(got["line_art"]) == [4, 5, 6] and sorted(got["drip_logo"]) == [14, 14, 30] and set(got["clean_logo"]) == {0} and sorted(got["default"]) == [1, 5, 30]
    names = spark.createDataFrame([("Line Art",), (None,), ("drip-logo",), ("?",)], "n string")
    assert [r[0] for r in names.select(presets.normal_name(F.col("n"))).collect()] == ["line_art", "default", "drip_logo", "default"]


def test_packages_are_checked(spark):
    good = sinks.package({"[Content_Types].xml": "x", "_rels/.rels": "x", "3D/3dmodel.model": '<model><vertex x="0"/><vertex x="1"/><triangle v1="0" v2="1" v3="0"/></model>'})
    bad = sinks.package({"../evil": "x", "3D/3dmodel.model": '<model><vertex x="0"/><triangle v1="0" v2="7" v3="0"/></model>'})
    files = spark.createDataFrame([("good", good), ("bad", bad), ("none", b"text")], "path string, content binary")
    found = {(r["path"], r["rule"]) for r in artwork.package_errors(files).collect()}
    assert found == {("bad", "safety"), ("bad", "entries"), ("bad", "mesh"), ("none", "archive")}


def test_rings_find_their_exteriors(spark):
    def square(ring, a, b):
        return [(0, ring, k, float(x), float(y)) for k, (x, y) in enumerate([(a, a), (b, a), (b, b), (a, b)])]

    kind = "image_id long, ring int, seq int, px double, py double"
    outer = spark.createDataFrame(square(0, 0, 20) + square(1, 4, 12), kind)
    holes = spark.createDataFrame(square(7, 6, 8) + square(8, 14, 16) + square(9, 30, 31), kind)
    assert {r["hole"]: r["exterior"] for r in contours.holes_to_exteriors(outer, holes).collect()} == {7: 1, 8: 0}


@pytest.mark.parametrize(("row", "score"), [((0, 0, True, 10, False, 0, 0), 100), ((1, 9, False, 0, True, 20, 0), 0), ((0, 2, True, 5, True, 3, 1), 79)])
def test_quality_scores(spark, row, score):
    kind = "failures int, warnings int, watertight boolean, face_count int, fallback_used boolean, preserved int, removed int"
    assert scoring.quality_score(spark.createDataFrame([row], kind)).first()["score"] == score


def test_strict_heights_must_lie_on_layers(spark):
    from rasterloom.operators import layers

    colors = spark.createDataFrame([(0, k, k) for k in range(3)], "image_id long, ord int, label int")
    assert [r["last_layer"] for r in layers.plan(colors, mode="strict").orderBy("ord").collect()] == [4, 6, 8]
    with pytest.raises(Exception, match="not on a layer"):
        layers.plan(colors, first=0.28, layer=0.16, mode="strict").collect()
    assert [r["last_layer"] for r in layers.plan(colors, first=0.28, layer=0.16, mode="snap_nearest").orderBy("ord").collect()] == [4, 7, 9]


def test_discovery_budgets_and_cache_keys(spark):
    from rasterloom.sources import rasters

    files = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert {r["path"]: r["kind"] for r in rasters.discover(files("a", "b"), files("b", "c")).collect()} == {"a": "input", "b": "input", "c": "sample"}
    size = rasters.sampled_size(F.lit(1000), F.lit(500), 5000)
    assert tuple(spark.range(1).select(size["width"], size["height"]).first()) == (100, 50)
    key = scoring.recommendation_key(F.col("content"), F.col("w"), F.lit("keychain"))
    jobs = spark.createDataFrame([(b"x", 100.0), (b"x", 100.0000001), (b"x", 101.0), (b"y", 100.0)], "content binary, w double").withColumn("key", key)
    assert jobs.select("key").distinct().count() == 3
    assert scoring.missing_from(jobs.limit(1), jobs).count() == 2


def test_mesh_reports_are_judged(spark):
    kind = "faces int, watertight boolean, open_edges int, overused_edges int, width double, depth double, height double"
    rows = [(12, True, 0, 0, 1.0, 1.0, 1.0), (12, False, 2, 0, 1.0, 1.0, 1.0), (0, True, 0, 0, 1.0, 1.0, 1.0), (12, None, 0, 0, 1.0, 1.0, 1.0), (12, True, 0, 0, 1.0, 0.0, 1.0)]
    assert [r["ok"] for r in spark.createDataFrame(rows, kind).select(scoring.is_sane().alias("ok")).collect()] == [True, False, False, False, False]


def test_meshes_are_numbered_and_judged(spark):
    from rasterloom.operators import meshes, reports

    v, f = reports.indexed(meshes.relief_faces(mask_of(spark, ["##"])))
    assert v.count() == 12 and f.count() == 4 * 2 + 2 * 6 and f.agg(F.max(F.greatest("v1", "v2", "v3"))).first()[0] == 11
    points = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0), (0, 1, 3.0, 6.0, 4.0), (0, 2, float("nan"), 0.0, 0.0)], "image_id long, vid int, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2), (0, 0, 0, 1), (0, 0, 1, 3)], "image_id long, v1 int, v2 int, v3 int")
    assert {(r["rule"], r["n"]) for r in reports.mesh_errors(points, faces).collect()} == {("finite", 1), ("range", 1), ("degenerate", 1)}
    moved = reports.centred(points.where("vid < 2"), 100.0, 50.0).orderBy("vid").collect()
    assert [(r["x"], r["y"], r["z"]) for r in moved] == [(49.0, 23.0, 0.0), (51.0, 27.0, 1.0)]


def test_faces_meet_their_numbers_without_a_shuffle_of_their_own(spark):
    from rasterloom.operators import meshes, reports
    from rasterloom.storage import dealt

    m = mask_of(spark, ["##.", ".##"])
    raw = {tuple(tuple(r["f"][c]) for c in "abc") for r in meshes.relief_faces(m).collect()}
    v, f = reports.indexed(meshes.relief_faces(dealt(m, "image_id")))
    at = {r["vid"]: tuple(r["corner"]) for r in v.collect()}
    got = f.collect()
    assert [at[k] for k in range(len(at))] == sorted(set(at.values()))
    assert len(got) == len(raw) and {tuple(at[r[c]] for c in ("v1", "v2", "v3")) for r in got} == raw
    # the pixels are dealt once, to as many tasks as asked for, and nothing is joined
    plan = f._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan


def test_physical_warnings(spark):
    from rasterloom.operators import reports

    w = reports.physical_warnings(F.lit(0.4), F.lit(0.4), F.lit(300.0), F.lit(10.0))
    assert spark.range(1).select(w.alias("w")).first()["w"] == ["thinner than can be printed", "no relief", "larger than the plate"]


def test_chords_replace_straight_stretches(spark):
    points = [(float(x), 0.01 * (x % 2)) for x in range(0, 11)] + [(10.0, float(y)) for y in range(1, 11)] + [(float(x), 10.0) for x in range(9, -1, -1)] + [(0.0, float(y)) for y in range(9, 0, -1)]
    ring = spark.createDataFrame([(0, 0, k, x, y) for k, (x, y) in enumerate(points)], "image_id long, ring int, seq int, px double, py double")
    kept = {(r["px"], r["py"]) for r in contours.straighten_chords(ring, 0.2, 4.0).collect()}
    assert len(kept) < 12 and (0.0, 0.0) in kept and (10.0, 0.0) in kept
    few = ring.where("seq < 4")
    assert contours.straighten_chords(few).count() == 4


def test_contours_that_change_too_much_fall_back(spark):
    m = mask_of(spark, ["#" * 30] * 20, ["##", "##"])
    rings, report = contours.clean_contours(contours.trace(m))
    r = {x["image_id"]: x for x in report.collect()}
    assert r[0]["points_after"] < r[0]["points_before"] or r[0]["fallbacks"] == 1
    assert rings.select("image_id").distinct().count() == 2


def test_choices_and_numbers_are_checked(spark):
    one = spark.createDataFrame([("Wall Art", 1.0)], "v string, x double")
    assert one.select(measures.one_of(F.col("v"), ["wall_art"], "wall_art", "product")).first()[0] == "wall_art"
    assert one.select(measures.at_least(F.col("x"), 1.0, "x")).first()[0] == 1.0
    with pytest.raises(Exception, match="must be one of"):
        one.select(measures.one_of(F.col("v"), ["keychain"], "keychain", "product")).collect()
    with pytest.raises(Exception, match="out of range"):
        one.select(measures.at_least(F.col("x"), 1.0, "x", strictly=True)).collect()


def test_contour_reports_as_text(spark):
    r = spark.createDataFrame([(0, 2, 40, 30, 1)], "image_id long, rings long, points_before long, points_after long, fallbacks long")
    assert reports.contour_text(r).first()["text"].split("\n") == ["contours: 2", "points before: 40", "points after: 30", "point reduction percent: 25.00", "fallbacks: 1"]
