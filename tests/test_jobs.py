"""Job driver, result cache and the gate over polled files."""

import os
import time

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import filament, jobs
from rasterloom.operators.cache import ResultCache
from rasterloom.streaming import intake

PX = "image_id long, y int, x int, r int, g int, b int, a int"


def picture(i, rows, light=250, dark=10):
    return [(i, y, x, *([dark if c == "#" else light] * 3), 255) for y, row in enumerate(rows) for x, c in enumerate(row)]


PLATE = ["........", ".######.", ".######.", ".##..##.", ".##..##.", ".######.", ".######.", "........"]


def test_jobs_of_all_modes_and_one_poisonous_image_in_each(spark, tmp_path):
    px, todo = [], []
    for base, mode in ((10, "flat_relief"), (20, "lithophane"), (30, "filament_swap_relief")):
        px += picture(base, PLATE) + picture(base + 1, PLATE)[:-1] + [(base + 2, 0, 0, 300, 0, 0, 255)]
        todo += [(base, mode, "auto_vector_first"), (base + 1, mode, "auto_vector_first"), (base + 2, mode, "auto_vector_first"), (base + 3, mode, "auto_vector_first")]
    px += picture(40, PLATE) + picture(41, PLATE) + picture(42, ["...", "...", "..."]) + picture(43, PLATE) + picture(44, PLATE)
    todo += [(40, "sculpture", None), (41, "wall_art", "other"), (42, "keychain", "vector_extrusion"), (43, "wall_art", "raster_heightfield"), (44, "flat_relief", "auto_vector_first"), (44, "flat_relief", "auto_vector_first")]
    report = jobs.run_jobs(spark.createDataFrame(todo, "image_id long, mode string, backend string"), spark.createDataFrame(px, PX), smooth=False)
    got = {r["image_id"]: r for r in report.collect()}
    assert len(got) == report.count() == 17
    for base, backend in ((10, "vector_extrusion"), (20, "lithophane_heightfield"), (30, "stacked_shells")):
        assert got[base]["status"] == "done" and got[base]["backend"] == backend and got[base]["watertight"]
        assert (got[base + 1]["stage"], got[base + 1]["error"]) == ("decode", "pixels are missing or repeated")
        assert got[base + 2]["error"] == "a channel is not between 0 and 255"
        assert got[base + 3]["error"] == "the image has no pixels" and got[base + 3]["status"] == "failed"
    assert got[10]["volume"] == pytest.approx(32 * 100 * 2.2)
    assert [got[i]["error"] for i in (40, 41, 42, 44)] == ["the mode is unknown", "the backend is unknown", "the artwork is empty", "the image has several jobs"]
    assert got[43]["backend"] == "raster_heightfield" and not got[43]["fallback_used"] and got[43]["volume"] == pytest.approx(32 * 100 * 2.8)
    jobs.save_jobs(report, f"file://{tmp_path}/jobs")
    assert spark.read.parquet(f"file://{tmp_path}/jobs").where("status = 'failed'").count() == 13


def test_reliefs_fall_back_to_pixels_with_the_reason(spark):
    todo = spark.createDataFrame([(1, "flat_relief", "vector_extrusion")], "image_id long, mode string, backend string")
    limits = {"hole_area": 0.0, "gap": 0.0, "island_area": 1e6, "segment": 1.5, "dimension": 0.8, "feature": 0.8}
    r = jobs.run_jobs(todo, spark.createDataFrame(picture(1, PLATE), PX), smooth=False, limits=limits).first()
    assert r["backend"] == "raster_heightfield" and r["fallback_used"] and r["reason"] == "no polygon is left" and r["status"] == "warning"


def steps(spark, images):
    return spark.createDataFrame([(i, y, x, float(z)) for i, rows in images.items() for y, row in enumerate(rows) for x, z in enumerate(row)], "image_id long, y int, x int, z double")


def test_shells_are_tried_again_alone(spark):
    pinch = [[0.0] * 6] + [[0.0, 1, 1, 1, 1, 0]] * 1 + [[0.0, 1, 0, 1, 1, 0], [0.0, 1, 1, 0, 1, 0], [0.0, 1, 1, 1, 1, 0]] + [[0.0] * 6]
    flat = [[1.0, 1.0], [1.0, 2.0]]
    h = steps(spark, {1: pinch, 2: flat, 3: [[0.0, 0.0]]})
    got = {r["image_id"]: r for r in filament.filament_mesh(h, 6.0).collect()}
    assert (got[2]["backend"], got[2]["attempts"], got[2]["levels"]) == ("stacked_shells", 1, 2)
    assert got[2]["volume"] == pytest.approx((4 * 1.0 + 1 * 1.01) * 9)
    assert got[1]["backend"] == "stacked_shells" and got[1]["attempts"] == 2 and got[1]["repaired"] == 1
    assert got[3]["backend"] is None and got[3]["reason"] == "no printable pixels"
    none = {r["image_id"]: r for r in filament.filament_mesh(h, 6.0, repairs=(0.0,)).collect()}
    assert none[1]["backend"] == "pixel_heightfield" and none[1]["reason"] == "shells that stay open: 1"
    assert none[2]["backend"] == "stacked_shells"


def test_pixel_faces_are_closed_over_steps(spark):
    h = steps(spark, {1: [[0.8, 1.2, 2.0], [1.2, 0.8, 0.0], [2.0, 2.0, 0.8]]})
    r = filament.filament_mesh(h, 3.0, style="pixel").first()
    assert r["volume"] == pytest.approx(0.8 * 3 + 1.2 * 2 + 2.0 * 3) and r["faces"] > 8 * 4


def test_each_image_gets_one_pixel_mesh(spark):
    """Rows of an image meet once, also where Spark joins tasks of the sides of a plan by themselves."""
    h = steps(spark, {k: [[0.8, 1.2 + k % 3, 0.0], [2.0, 0.8, 0.8]] for k in range(60)})
    rows = filament.filament_mesh(h, 3.0, style="pixel").collect()
    assert sorted(r["image_id"] for r in rows) == list(range(60))
    # two faces above and below a pixel, and for each side two for each level between
    assert {r["image_id"]: r["faces"] for r in rows}[0] == 2 * (2 * 5 + 22)


def test_smoothed_levels_stay_within_each_other(spark):
    disc = [[(2.0 if (x - 12) ** 2 + (y - 12) ** 2 < 36 else 1.2 if (x - 12) ** 2 + (y - 12) ** 2 < 100 else 0.8) for x in range(24)] for y in range(24)]
    r = filament.filament_mesh(steps(spark, {1: disc}), 24.0, clean=True).first()
    plain = filament.filament_mesh(steps(spark, {1: disc}), 24.0).first()
    assert r["backend"] == "stacked_shells" and r["levels"] == 3 and r["volume"] == pytest.approx(plain["volume"], rel=0.05)


@pytest.fixture
def cache(spark, tmp_path):
    return ResultCache(spark, f"file://{tmp_path}/cache", "score long", most_segments=3, most_rows=6)


def test_a_second_run_computes_nothing(spark, cache):
    asked = []

    def compute(rows):
        asked.append(sorted(r["key"] for r in rows.collect()))  # null keys never come
        return rows.select("key", F.length("key").cast("long").alias("score"))

    work = spark.createDataFrame([("a", 1), ("bb", 2), ("a", 3), (None, 4)], "key string, job int")
    first = sorted((r["job"], r["score"]) for r in cache.through(work, compute, 1).collect() if r["key"])
    again = sorted((r["job"], r["score"]) for r in cache.through(work.where("key is not null"), compute, 2).collect())
    assert first == again == [(1, 1), (2, 2), (3, 1)]
    assert asked == [["a", "bb"]]


def test_a_crash_leaves_no_half_version(spark, cache):
    rows = lambda *keys: spark.createDataFrame([(k, len(k)) for k in keys], "key string, score long")
    assert cache.add(rows("a", "b"), 1) == 1
    cache._segment(rows("x").withColumn("used", F.lit(1).cast("long")).select("key", "used", "score"))
    assert sorted(r["key"] for r in cache.read().collect()) == ["a", "b"]
    assert not cache._commit(1, ["other"]) and cache.version() == 1
    assert cache.sweep() == 1 and cache.read().count() == 2


def test_segments_are_compacted_and_old_keys_go(spark, cache):
    for n in range(5):
        cache.add(spark.createDataFrame([(f"k{n}{m}", n) for m in range(3)], "key string, score long"), n)
    assert len(cache.segments(cache.version())) <= 3
    left = sorted(r["key"] for r in cache.read().collect())
    assert {"k40", "k41", "k42"} <= set(left) and "k00" not in left
    cache.add(spark.createDataFrame([("k40", 99)], "key string, score long"), 9)
    assert cache.read().where("key = 'k40'").first()["score"] == 4
    cache.touch(spark.createDataFrame([("k41",)], "key string"), 20)
    assert cache.read().where("key = 'k41'").first()["used"] == 20


def test_polled_files_pass_the_gate_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "still.png").write_bytes(b"x" * 10)
    (folder / "note.txt").write_bytes(b"x")
    (folder / "empty.png").write_bytes(b"")
    out = intake.gated(intake.polls(spark, str(folder)), expiry_seconds=4)

    def start():
        return out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()

    def rows():
        found = spark.read.schema(intake.Gate.SCHEMA).parquet(str(tmp_path / "out")) if os.path.isdir(tmp_path / "out") else None
        return {os.path.basename(r["path"]): (r["ready"], r["warning"]) for r in found.collect()} if found is not None else {}

    q = start()
    try:
        (folder / "grows.png").write_bytes(b"y")
        (folder / "leaves.png").write_bytes(b"y")
        end = time.time() + 90
        while time.time() < end and len(rows()) < 5:
            if os.path.exists(folder / "leaves.png") and len(rows()) >= 1:
                os.remove(folder / "leaves.png")
            (folder / "grows.png").open("ab").write(b"y")
            time.sleep(0.7)
        q.stop()
        got = rows()
        assert got["still.png"] == (True, None)
        assert got["note.txt"] == (False, "no artwork: passed over")
        assert got["empty.png"][0] is False and got["grows.png"][0] is False
        q = start()
        time.sleep(6)
        assert spark.read.parquet(str(tmp_path / "out")).where("path like '%still%'").count() == 1
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_files_are_put_in_place_together_or_not_at_all(spark, tmp_path):
    from rasterloom.sources import files, sinks

    masks = spark.createDataFrame([(i, y, x, (x + y + i) % 3 == 0) for i in range(5) for y in range(4) for x in range(4)], "image_id long, y int, x int, m boolean")
    pngs = sinks.mask_files(masks).withColumn("path", F.concat(F.lit("masks/"), "path"))
    folder = tmp_path / "print"
    folder.mkdir()
    (folder / "own.txt").write_text("stays")
    files.put(pngs, str(folder))
    read = lambda: {str(p.relative_to(folder)): p.read_bytes() for p in sorted(folder.rglob("*")) if p.is_file()}
    first = read()
    assert len(first) == 6 and all(not k.startswith(".pending") for k in first)
    files.put(pngs.repartition(3), str(folder))
    assert read() == first
    for bad in ([("a.png", b"no")], [("../a.txt", b"x")], [("b.stl", b"\0" * 90)], [("c.3mf", b"PK")], [("d.svg", b"<svg")], [("e.txt", b"")], [("f.txt", b"1"), ("f.txt", b"2")]):
        with pytest.raises(Exception):  # noqa: B017
            files.put(spark.createDataFrame([("good.txt", b"1"), *bad], "path string, content binary").repartition(2), str(folder))
        assert read() == first and not [p for p in os.listdir(folder) if p.startswith(".pending")]
