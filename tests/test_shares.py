"""What the operators send: pixels carry what is known of them, and tasks get a bounded share of rows."""

import random

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import artwork, masks, meshes, neighbourhood, printability, regions
from rasterloom.storage import shared_out, written


def _random_masks(spark, images=6, tall=9, wide=11, share=0.5, seed=5):
    r = random.Random(seed)
    return spark.createDataFrame([(i, y, x, r.random() < share) for i in range(images) for y in range(tall) for x in range(wide)], "image_id long, y int, x int, m boolean")


def _joins(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(line.strip(" :+-").startswith("Join ") for line in plan.splitlines())


def _flood(on: set, near: int) -> list[set]:
    parts, left = [], set(on)
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            for j in (-1, 0, 1):
                for i in (-1, 0, 1):
                    if (near == 8 or not (j and i)) and (y + j, x + i) in left:
                        left.remove((y + j, x + i))
                        todo.append((y + j, x + i))
        parts.append(part)
    return parts


@pytest.mark.parametrize("near", [4, 8])
def test_measured_pixels_know_their_component(spark, near):
    """F16, F17, F19: size, box and border of a component come with its pixels, without a join."""
    m = _random_masks(spark)
    df = regions.measured(m.withColumn("z", F.col("x") * 2.5), F.col("m"), near, ("z",))
    assert _joins(df) == 0
    got = {(r.image_id, r.y, r.x): r for r in df.collect()}
    rows = m.collect()
    assert len(got) == len(rows) and all(got[r.image_id, r.y, r.x].on == r.m and got[r.image_id, r.y, r.x].z == r.x * 2.5 for r in rows)
    for image in range(6):
        for part in _flood({(r.y, r.x) for r in rows if r.image_id == image and r.m}, near):
            ys, xs = [p[0] for p in part], [p[1] for p in part]
            want = (*min(part), len(part), min(ys) == 0 or min(xs) == 0 or max(ys) == 8 or max(xs) == 10, max(xs) - min(xs) + 1, max(ys) - min(ys) + 1)
            assert all((g.first_y, g.first_x, g.area, g.open, g.w, g.h) == want for g in (got[image, y, x] for y, x in part))


def test_printable_masks_need_no_joins(spark):
    """filling, closing and cleaning a mask carry its columns along."""
    m = _random_masks(spark).withColumn("z", F.lit(1.0))
    df = printability.enforce(m, 1.0, printability.LIMITS, ("z",))
    assert _joins(df) == 0 and set(df.columns) == {"image_id", "y", "x", "z", "m"}


def test_spreading_keeps_to_places_an_image_has(spark):
    """a kernel's windows go by coordinates, so a gap between pixels stays one."""
    m = spark.createDataFrame([(1, 0, 0, True), (1, 0, 2, False), (1, 1, 0, False), (1, 3, 0, False), (1, 1, 1, False)], "image_id long, y int, x int, m boolean")
    got = {(r.y, r.x) for r in printability.spread(m, printability.disc(1)).where("m").collect()}
    assert got == {(0, 0), (1, 0)}


def test_contacts_are_resolved_without_joins_or_further_shuffles(spark):
    """a mask dealt by image is not sent again within a pass."""
    m = _random_masks(spark).repartition(3, "image_id")
    df = neighbourhood._marked_contacts(m)
    assert _joins(df) == 0
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_levels_keep_other_columns(spark):
    """what was known of a pixel goes along, so that nothing is joined back."""
    h = _random_masks(spark).select("image_id", "y", "x", ((F.col("x") * 7 + F.col("y") * 5 + F.col("m").cast("int")) % 4).alias("h"))
    got = neighbourhood.repair_levels(h.withColumn("was", F.col("h"))).collect()
    before = {(r.image_id, r.y, r.x): r.h for r in h.collect()}
    assert {(r.image_id, r.y, r.x): r.was for r in got} == before and all(r.h >= r.was for r in got)
    assert {(r.image_id, r.y, r.x): r.h for r in got} == _repaired(before)


def _repaired(heights: dict) -> dict:
    """The same pixel by pixel: levels from the lowest up, passes until no contact is left."""
    out = dict(heights)
    for image in {k[0] for k in heights}:
        h = {k[1:]: v for k, v in heights.items() if k[0] == image}
        for level in sorted({v for v in h.values() if v > 0}):
            on = {p for p, v in h.items() if v >= level}
            while True:
                fill = set()
                for y, x in h:
                    square = [(y, x), (y, x + 1), (y + 1, x), (y + 1, x + 1)]
                    empty = [p for p in square if p in h and p not in on]
                    if all(p in h for p in square) and empty in ([square[0], square[3]], [square[1], square[2]]):
                        near = [sum((p[0] + j, p[1] + i) in on for j in (-1, 0, 1) for i in (-1, 0, 1)) for p in empty]
                        fill.add(empty[0] if near[0] >= near[1] else empty[1])
                if not fill:
                    break
                on |= fill
            h |= {p: max(h[p], level) for p in on}
        out |= {(image, *p): v for p, v in h.items()}
    return out


def test_tasks_get_a_bounded_share_of_rows(spark):
    """the number of tasks grows with the rows, also where they shrink to few bytes."""
    df = spark.range(60_000).select((F.col("id") % 500).alias("image_id"))
    assert shared_out(df, 60_000, "image_id", share=1_000).rdd.getNumPartitions() == 60
    assert shared_out(df, 0, "image_id").rdd.getNumPartitions() == 1


def test_classes_are_found_without_joins(spark):
    """F16: the stages of a classification add columns to one relation of pixels."""
    m = _random_masks(spark)
    dark = m.withColumn("m", (F.col("x") + F.col("y")) % 3 == 0)
    assert _joins(artwork.classify(m, dark, m, 3)) == 0
    assert _joins(artwork.classify(dark, dark, m, 3, has_alpha=True, keep_holes=False)) == 0


def test_masks_beside_each_other_fill_what_one_lacks(spark):
    a = spark.createDataFrame([(1, 0, 0, True), (1, 0, 1, None)], "image_id long, y int, x int, m boolean")
    b = spark.createDataFrame([(1, 0, 1, True), (2, 0, 0, False)], "image_id long, y int, x int, m boolean")
    got = {tuple(r) for r in masks.beside(a=a, b=b).collect()}
    assert got == {(1, 0, 0, True, False), (1, 0, 1, False, True), (2, 0, 0, False, False)}


def test_faces_are_counted_by_their_edges_where_they_are_made(spark):
    """pixels are dealt once; faces and edges of an image are not sent, nor made again to be counted."""
    m = written(_random_masks(spark), "masks")
    faces = meshes.relief_faces(shared_out(m, m.count(), "image_id", share=100))
    report = meshes.mesh_counts(faces)
    plan = report._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1
    counted = {r.image_id: r["count"] for r in faces.groupBy("image_id").count().collect()}
    assert {r.image_id: r.face_count for r in report.collect()} == counted
