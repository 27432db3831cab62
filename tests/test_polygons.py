"""Polygon sets against drawn pictures, closed forms and identities of areas."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import contours, extrusion, polygons, regions
from rasterloom.operators.printability import LIMITS

POINTS = "image_id long, ring int, seq int, px double, py double"


def frame(spark, images):
    """{image: [ring, ..]} as points."""
    return spark.createDataFrame([(i, r, k, float(x), float(y)) for i, rings in images.items() for r, ring in enumerate(rings) for k, (x, y) in enumerate(ring)], POINTS)


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def star(rng, x, y, n=9):
    return [(x + r * math.cos(a), y + r * math.sin(a)) for a, r in ((2 * math.pi * k / n, rng.uniform(2, 9)) for k in range(n))]


def inside(rings, xs, ys):
    """Even-odd of many points."""
    hit = np.zeros(len(xs), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            cross = (ay > ys) != (by > ys)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit ^= cross & (xs < (bx - ax) * (ys - ay) / (by - ay) + ax)
    return hit


def by_image(df, column="area"):
    return {r["image_id"]: r[column] for r in df.collect()}


@pytest.fixture(scope="module")
def stars():
    rng = random.Random(4)
    return {i: [star(rng, 10, 10), star(rng, 13, 9)] for i in range(6)}, {i: [star(rng, 14, 12), star(rng, 8, 14)] for i in range(6)}


def test_overlays_of_crossing_rings(spark, stars):
    a, b = stars
    got = {n: by_image(polygons.areas(polygons.spans(frame(spark, a), frame(spark, b), how))) for n, how in (("or", polygons.UNION), ("and", polygons.BOTH), ("only", polygons.ONLY), ("xor", polygons.EITHER))}
    one, two = by_image(polygons.areas(polygons.spans(frame(spark, a)))), by_image(polygons.areas(polygons.spans(frame(spark, b))))
    g = np.linspace(-5, 30, 1400)
    xs, ys = (v.ravel() for v in np.meshgrid(g, g))
    cell = (g[1] - g[0]) ** 2
    for i in a:
        assert got["or"][i] + got["and"].get(i, 0) == pytest.approx(one[i] + two[i], abs=1e-4)
        assert got["only"][i] + got["and"].get(i, 0) == pytest.approx(one[i], abs=1e-4)
        assert got["xor"][i] == pytest.approx(got["or"][i] - got["and"].get(i, 0), abs=1e-4)
        p, q = inside(a[i], xs, ys), inside(b[i], xs, ys)
        assert got["or"][i] == pytest.approx((p | q).sum() * cell, rel=0.01)
        assert got["and"].get(i, 0) == pytest.approx((p & q).sum() * cell, rel=0.02, abs=0.2)


def test_outlines_give_back_the_area_and_prisms_are_closed(spark, stars):
    a, b = stars
    found = polygons.spans(frame(spark, a), frame(spark, b), polygons.EITHER)
    outline = polygons.outlines(found)
    rings = polygons.rings(outline)
    area = by_image(polygons.areas(found))
    turned = by_image(contours.measures(rings).groupBy("image_id").agg(F.sum("area").alias("area")))
    again = by_image(polygons.areas(polygons.spans(rings, rule="positive")))
    for i in a:
        assert turned[i] == pytest.approx(area[i], abs=1e-3) and again[i] == pytest.approx(area[i], abs=1e-3)
    report = {r["image_id"]: r for r in polygons.mesh_report(polygons.extruded(found, outline), 3.0).collect()}
    for i in a:
        assert report[i]["volume"] == pytest.approx(3 * area[i], abs=1e-2)
        assert report[i]["open_edges"] == 0


def test_islands_in_holes_are_parts_of_their_own(spark):
    nest = {1: [box(0, 0, 20, 20), box(2, 2, 16, 16), box(4, 4, 12, 12), box(6, 6, 8, 8), box(30, 0, 3, 3)], 2: [box(0, 0, 4, 4)]}
    found = polygons.spans(frame(spark, nest))
    outline = polygons.outlines(found)
    parts = sorted((r["image_id"], r["area"], r["holes"], r["w"], r["h"]) for r in polygons.part_measures(outline).collect())
    assert parts == [(1, 9, 0, 3, 3), (1, 80, 1, 12, 12), (1, 144, 1, 20, 20), (2, 16, 0, 4, 4)]
    report = {r["image_id"]: r for r in polygons.mesh_report(polygons.extruded(found, outline), 1.0).collect()}
    assert report[1]["watertight"] and report[1]["parts"] == 3 and report[1]["volume"] == pytest.approx(233)


def test_offsets(spark):
    shapes = {1: [box(0, 0, 10, 6)], 2: [[(0, 0), (8, 0), (8, 4), (4, 4), (4, 8), (0, 8)]], 3: [box(0, 0, 10, 10), box(3, 3, 4, 4)[::-1]]}
    p = frame(spark, shapes)
    moved = lambda d, q: by_image(polygons.areas(polygons.spans(polygons.offset(p, d, q), rule="positive")))
    fan = lambda d, q: q * d * d / 2 * math.sin(math.pi / 2 / q)
    out, cut, back = moved(1.0, 16), moved(1.0, 1), moved(-1.0, 16)
    assert out[1] == pytest.approx(60 + 32 + 4 * fan(1, 16), abs=1e-3) and cut[1] == pytest.approx(60 + 32 + 2, abs=1e-3)
    assert out[2] == pytest.approx(48 + 32 - 1 + 5 * fan(1, 16), abs=1e-3)
    assert out[3] == pytest.approx(100 + 40 + 4 * fan(1, 16) - 4, abs=1e-3)
    assert back == pytest.approx({1: 32, 2: 48 - 32 + 5 - fan(1, 16), 3: 64 - (16 + 16 + 4 * fan(1, 16))}, abs=1e-3)
    assert by_image(polygons.areas(polygons.spans(polygons.offset(p, -4.0), rule="positive"))).get(1) is None


def test_gaps_close_and_holes_too_small_are_filled(spark):
    p = frame(spark, {1: [box(0, 0, 10, 10), box(6, 6, 0.4, 0.4), box(1, 1, 3, 3)], 2: [box(0, 0, 5, 5), box(5.4, 0, 5, 5)], 3: [box(0, 0, 5, 5), box(6, 0, 5, 5)], 4: [box(0, 0, 12, 0.5)], 5: [box(0, 0, 1, 1)], 6: [box(0, 0, 20, 0.05)]})
    found, outline, report = extrusion.printable(p, LIMITS)
    got = {r["image_id"]: r for r in report.collect()}
    area = by_image(polygons.areas(found))
    assert (got[1]["filled_holes"], got[1]["parts"]) == (1, 1) and area[1] == pytest.approx(91 + 0.36 * (1 - math.pi / 4), abs=0.01)  # the hole loses its corners
    assert (got[2]["closed_gaps"], got[2]["parts"]) == (1, 1) and area[2] == pytest.approx(52, abs=0.1)
    assert got[3]["parts"] == 2 and area[3] == pytest.approx(50, abs=0.01)
    assert got[4]["thickened"] == 1 and got[4]["smallest_width"] == pytest.approx(0.8, abs=0.01)
    assert got[5]["removed_islands"] == 1 and got[5]["parts"] == 0 and 5 not in area
    assert got[6]["removed_islands"] == 1


def test_extrusion_repairs_what_touches_itself_and_says_why_it_fails(spark):
    pinched = [(0, 0), (4, 0), (4, 4), (8, 4), (8, 8), (4, 8), (4, 4), (0, 4)]
    ring = [(0, 0), (8, 0), (8, 8), (0, 8)]
    p = frame(spark, {1: [pinched], 2: [ring, [(0, 4), (4, 2), (4, 6)]], 3: [box(0, 0, 3, 3)], 4: [[(0, 0), (1, 1)]]})
    faces, report = extrusion.vector_extrusion(p, 2.0)
    got = {r["image_id"]: r for r in report.collect()}
    assert got[3]["backend"] == "vector_extrusion" and got[3]["volume"] == pytest.approx(18)
    assert got[1]["volume"] == pytest.approx(64, abs=0.01) and got[1]["watertight"]
    assert got[2]["backend"] == "vector_extrusion_repaired" and got[2]["watertight"] and got[2]["volume"] == pytest.approx(112, abs=0.02)
    assert got[4]["backend"] is None and got[4]["reason"] == "no polygon is left"
    assert {r["image_id"] for r in faces.select("image_id").distinct().collect()} == {1, 2, 3}


def test_holes_outside_every_ring_are_left_out(spark):
    p = frame(spark, {1: [box(0, 0, 10, 10), box(2, 2, 3, 3), box(20, 20, 3, 3)]}).withColumn("hole", F.col("ring") > 0)
    _, report = extrusion.vector_extrusion(p, 1.0)
    assert report.first()["volume"] == pytest.approx(91)


def test_no_rings(spark):
    none = frame(spark, {1: []})
    assert polygons.spans(none).count() == 0
    assert extrusion.printable(none)[2].count() == 0
    assert extrusion.vector_extrusion(none, 1.0)[1].count() == 0


def test_no_side_of_a_polygon_join_passes_the_driver(spark, stars):
    a, b = stars
    found = polygons.spans(frame(spark, a), frame(spark, b))
    e = polygons._with_tile(polygons.edges(frame(spark, a)))
    labels = spark.range(64).selectExpr("1L as image_id", "cast(id div 8 as int) as y", "cast(id % 8 as int) as x", "cast(id % 7 % 3 as int) as label")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        for df in (polygons._ordered(frame(spark, a), None, "evenodd", None, None), polygons.crossings(e), polygons.caps(found), polygons.mesh_report(polygons.extruded(found, polygons.outlines(found)), 1.0), regions.apply_island_policy(labels, "merge", 4, 3)):
            df.collect()
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_side_of_checked_caps_passes_the_driver(spark, stars):
    from rasterloom.plans.polygon_queries import cap_check

    a, b = stars
    found = polygons.spans(frame(spark, a), frame(spark, b), polygons.ONLY)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        df = cap_check(found)
        assert all(r["side_to_side"] for r in df.collect())
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _sent(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[0].count("Exchange hashpartitioning"), plan.count("Join")


def test_edges_and_checked_spans_are_dealt_once_by_image(spark, stars, monkeypatch):
    from rasterloom.plans.polygon_queries import cap_check

    monkeypatch.setattr(polygons, "TASK_EDGES", 50)
    a, b = (frame(spark, s) for s in stars)
    assert _sent(polygons._ordered(a, b, "evenodd", None, None)) == (1, 0)
    # the spans are read thrice: for triangles, for borders' sides and for level pieces
    dealt, joins = _sent(cap_check(polygons.spans(a, b)))
    assert dealt <= 3 and joins == 0


def test_snapping_takes_halves_away_from_zero(spark):
    values = [0.0, -0.0, 0.5, -0.5, 1.5, -1.5, 2.5, -2.5, -0.2, 0.49, 3.0e9 + 0.5, None]
    got = spark.createDataFrame([(None if v is None else v / polygons.GRID,) for v in values], "v double").select(polygons.snap(F.col("v")).alias("s"), (F.round(F.col("v") * polygons.GRID) / polygons.GRID).alias("r")).collect()
    assert all(r["s"] == r["r"] for r in got)
    assert all(math.copysign(1, r["s"]) > 0 for r in got if r["s"] == 0)


def test_null_images_have_no_spans(spark):
    p = frame(spark, {1: [box(0, 0, 2, 3)]})
    both = p.unionByName(p.withColumn("image_id", F.lit(None).cast("long")))
    assert by_image(polygons.areas(polygons.spans(both))) == {1: pytest.approx(6)}


def test_moved_rings_meet_without_the_driver(spark):
    from conftest import DATA

    from rasterloom.plans.polygon_queries import ring_offset

    df = ring_offset(spark, f"{DATA}/sf0.001")
    assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_tiles_follow_the_edges(spark):
    p = frame(spark, {1: [box(0, 0, 3000, 2000)], 2: [box(0, 0, 0.01, 0.02)]})
    e = polygons._with_tile(polygons.edges(p))
    passed = {r["image_id"]: r["count"] for r in polygons._tiled(e).groupBy("image_id").count().collect()}
    assert all(n <= 12 for n in passed.values())


def test_several_overlays_at_once(spark, stars):
    a, b = (frame(spark, s) for s in stars)
    got = {r["image_id"]: r for r in polygons.overlay_areas(a, b, {"only": polygons.ONLY, "xor": polygons.EITHER}).collect()}
    for name, how in (("only", polygons.ONLY), ("xor", polygons.EITHER)):
        for i, area in by_image(polygons.areas(polygons.spans(a, b, how))).items():
            assert got[i][name] == pytest.approx(area, abs=1e-4)


def test_kernels_get_many_whole_groups_a_call(spark):
    import pyarrow as pa

    from rasterloom.operators import groups

    def kernel(table, begins):
        keys, n = table.column("k").to_pylist(), len(begins) - 1
        assert all(len(set(keys[b:e])) == 1 for b, e in zip(begins, begins[1:], strict=False))
        return pa.table({"k": pa.array([keys[b] for b in begins[:-1]], pa.int64()), "rows": pa.array([e - b for b, e in zip(begins, begins[1:], strict=False)], pa.int64()), "call": pa.array([n] * n, pa.int64())})

    rows = [(None if k == 0 else k, n) for k in range(300) for n in range(1 + k % 7)] + [(1000, n) for n in range(5000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = groups.by_group(spark.createDataFrame(rows, "k long, n int"), ["k"], kernel, "k long, rows long, call long", ("n",)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["k"]: r["rows"] for r in got} == {None: 1, 1000: 5000} | {k: 1 + k % 7 for k in range(1, 300)}
    assert len(got) == 301 and max(r["call"] for r in got) > 5
