"""Filters, resampling, edges and measures against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import analysis, edges, filters
from rasterloom.operators.masks import KEY


def frame(spark, images):
    return spark.createDataFrame([(i, y, x, int(v)) for i, a in images.items() for (y, x), v in np.ndenumerate(a)], "image_id long, y int, x int, g int")


def grids(df, column="g"):
    out = {}
    for r in df.collect():
        out.setdefault(r["image_id"], {})[r["y"], r["x"]] = r[column]
    return {i: np.array([[c[y, x] for x in range(max(k[1] for k in c) + 1)] for y in range(max(k[0] for k in c) + 1)]) for i, c in out.items()}


@pytest.fixture(scope="module")
def images():
    r = np.random.default_rng(3)
    return {1: r.integers(0, 256, (13, 17)), 2: r.integers(0, 256, (5, 40)), 3: r.integers(0, 256, (1, 1)), 4: r.integers(0, 256, (2, 9))}


@pytest.mark.parametrize("size,border", [(3, "mirror"), (9, "mirror"), (11, "repeat"), (31, "mirror")])
def test_filters_of_any_size(spark, images, size, border):
    taps = np.array(filters.gaussian_taps(size), object)
    assert sum(taps) == filters.ONE and list(taps) == list(taps[::-1])
    got = grids(filters.separable(frame(spark, images), list(taps), border=border))
    mode = {"mirror": "reflect", "repeat": "edge"}[border]
    for i, a in images.items():
        p = np.pad(a, size // 2, mode).astype(object) if min(a.shape) > 1 or mode == "edge" else np.pad(a, [(size // 2,) * 2 if n > 1 else (0, 0) for n in a.shape], mode).astype(object)
        if mode == "reflect" and min(a.shape) == 1:
            p = np.pad(p, [(size // 2,) * 2 if n == 1 else (0, 0) for n in a.shape], "edge")
        rows = sum(p[:, k : k + a.shape[1]] * taps[k] for k in range(size))
        both = sum(rows[k : k + a.shape[0]] * taps[k] for k in range(size))
        assert (got[i] == np.array((both + (1 << 31)) >> 32, int)).all()


def test_bad_sizes_raise():
    with pytest.raises(ValueError):
        filters.gaussian_taps(4)


def plain_lanczos(line, dst):
    src = len(line)
    scale = src / dst
    wide = max(1.0, scale)
    f = lambda v: 0.0 if abs(v) >= 3 else 1.0 if v == 0 else math.sin(math.pi * v) * math.sin(math.pi * v / 3) / (math.pi * v) / (math.pi * v / 3)
    out = []
    for t in range(dst):
        c = (t + 0.5) * scale
        s = range(max(0, math.floor(c - 3 * wide + 0.5)), min(src, math.floor(c + 3 * wide + 0.5)))
        w = [f((k - c + 0.5) / wide) for k in s]
        w = [x / sum(w) * (1 << 22) for x in w]
        w = [math.ceil(x - 0.5) if x < 0 else math.floor(x + 0.5) for x in w]
        out.append(max(0, min(255, (sum(int(line[k]) * x for k, x in zip(s, w, strict=True)) + (1 << 21)) >> 22)))
    return out


def test_resampling(spark, images):
    px = frame(spark, images)
    sizes = filters.sampled_sizes(filters.sizes_of(px), 60)
    to = {r["image_id"]: (r["to_height"], r["to_width"]) for r in sizes.collect()}
    assert to[3] == (1, 1) and all(h * w <= 60 for h, w in to.values())
    got = grids(filters.lanczos(px, sizes, ["g"]))
    mean = grids(filters.averaged(px, sizes, ["g"]))
    for i, a in images.items():
        rows = np.array([plain_lanczos(r, to[i][1]) for r in a])
        assert (got[i] == np.array([plain_lanczos(c, to[i][0]) for c in rows.T]).T).all()
        fine = np.kron(a, np.ones(to[i], int)).reshape(to[i][0], a.shape[0], to[i][1], a.shape[1])
        h, w = a.shape
        each = np.kron(a, np.ones(to[i], int))
        cells = each.reshape(to[i][0], h, to[i][1], w).mean((1, 3))
        assert fine.size == each.size and (mean[i] == np.floor(cells + 0.5 + 1e-9)).all()


def test_hidden_colors_do_not_show(spark):
    a = np.zeros((4, 8), int)
    px = frame(spark, {1: a}).select(*KEY, F.when(F.col("x") < 4, 255).otherwise(0).alias("r"), F.lit(0).alias("g"), F.when(F.col("x") < 4, 0).otherwise(255).alias("b"), F.when(F.col("x") < 4, 0).otherwise(255).alias("a"))
    out = filters.lanczos_rgba(px, filters.sampled_sizes(filters.sizes_of(px), 8)).where("a > 0").collect()
    assert out and all(r["r"] == 0 and r["b"] >= 254 for r in out)


def plain_canny(a, low, high):
    p = np.pad(a, 1, "edge").astype(int)
    h, w = a.shape
    at = lambda j, i: p[1 + j : 1 + j + h, 1 + i : 1 + i + w]
    gx = sum(k * (at(j, 1) - at(j, -1)) for j, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (at(1, i) - at(-1, i)) for i, k in ((-1, 1), (0, 2), (1, 1)))
    m = np.pad(abs(gx) + abs(gy), 1)
    weak = set()
    for y in range(h):
        for x in range(w):
            v, ax, ay = m[y + 1, x + 1], abs(gx[y, x]), abs(gy[y, x]) << 15
            n = lambda j, i: m[y + 1 + j, x + 1 + i]  # noqa: B023, E731
            if ay < ax * 13573:
                ok = v > n(0, -1) and v >= n(0, 1)
            elif ay > ax * 13573 + (ax << 16):
                ok = v > n(-1, 0) and v >= n(1, 0)
            else:
                s = -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1
                ok = v > n(-1, -s) and v > n(1, s)
            if v > low and ok:
                weak.add((y, x))
    stack = [q for q in weak if m[q[0] + 1, q[1] + 1] > high]
    found = set(stack)
    while stack:
        y, x = stack.pop()
        for q in ((y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)):
            if q in weak and q not in found:
                found.add(q)
                stack.append(q)
    return found


def test_edges_by_hysteresis(spark, images):
    yy, xx = np.mgrid[0:40, 0:50]
    more = {**images, 5: np.where((yy - 20) ** 2 + (xx - 25) ** 2 < 150, 200, 40) + np.where(xx > 40, 25, 0), 6: np.full((6, 6), 9)}
    got = {}
    for r in edges.canny(frame(spark, more)).collect():
        got.setdefault(r["image_id"], set()).add((r["y"], r["x"]))
    for i, a in more.items():
        assert got.get(i, set()) == plain_canny(a, 80, 160)
    shares = {r["image_id"]: r["edge_density"] for r in edges.density(frame(spark, more)).collect()}
    assert set(shares) == set(more) and shares[6] == 0


def test_layers_over_each_other(spark):
    rows = [(1, 0, 0, 0, 100, 0, 0, 255), (1, 0, 0, 2, 200, 0, 0, 255), (1, 0, 0, 1, 0, 0, 0, 255), (1, 0, 1, 0, 0, 0, 0, 51)]
    got = {r["x"]: r["r"] for r in filters.over(spark.createDataFrame(rows, "image_id long, y int, x int, layer int, r int, g int, b int, a int")).collect()}
    assert got == {0: 200, 1: 204}


def test_recommendation_reads_large_and_blank_images(spark):
    r = random.Random(1)
    big = np.full((30, 700), 250)
    big[8:22, 100:600] = 10
    blank = np.full((9, 9), 77)
    px = frame(spark, {1: big, 2: blank, 3: np.array([[r.randrange(256) for _ in range(20)] for _ in range(20)])}).select(*KEY, F.col("g").alias("r"), "g", F.col("g").alias("b"))
    got = {x["image_id"]: x for x in analysis.recommendation(px).collect()}
    assert (got[1]["source_width"], got[1]["analysis_width"], got[1]["analysis_height"]) == (700, 512, 22)
    assert got[1]["component_count"] == 1 and got[1]["preset"] == "clean_logo" and got[1]["unavailable"] is None
    assert got[2]["component_count"] == 0 and got[2]["edge_density"] == 0 and got[2]["foreground_percent"] == 0
    assert got[3]["edge_density"] > 0
    assert len(got[1]["reasons"]) <= 4
