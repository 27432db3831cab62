"""Rings of points (image_id, ring, seq, px, py) and what their order tells, as windows over seq."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import groups
from .meshes import exposed

RING = ["image_id", "ring"]


def _around(points: DataFrame) -> DataFrame:
    """Adds the points before (ax, ay) and after (cx, cy), around the ring, and the ring's length n."""
    w = W.partitionBy(*RING).orderBy("seq")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = points.withColumn("n", F.count("*").over(W.partitionBy(*RING)))
    for a, c, p in (("ax", "cx", "px"), ("ay", "cy", "py")):
        out = out.withColumn(a, F.coalesce(F.lag(p).over(w), F.last(p).over(whole))).withColumn(c, F.coalesce(F.lead(p).over(w), F.first(p).over(whole)))
    return out


def turn_degrees() -> Column:
    """Angle at a point between its neighbours: 180 where the ring goes straight on."""
    ux, uy, vx, vy = F.col("ax") - F.col("px"), F.col("ay") - F.col("py"), F.col("cx") - F.col("px"), F.col("cy") - F.col("py")
    size = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / size))
    return F.when(size == 0, 180.0).otherwise(F.degrees(F.acos(cosine)))


def merge_collinear(points: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Points where the ring turns by more than ``tolerance`` degrees; rings that would keep under three stay whole."""
    marked = _around(points).withColumn("turns", F.abs(180.0 - turn_degrees()) > tolerance)
    marked = marked.withColumn("left", F.count_if("turns").over(W.partitionBy(*RING)))
    return marked.where(F.col("turns") | (F.col("n") <= 3) | (F.col("left") < 3)).select(*RING, "seq", "px", "py")


def round_corners(points: DataFrame, sharp: float = 60.0) -> DataFrame:
    """One round of corner cutting: each point but sharp ones gives way to two on the segment to the next."""
    near = _around(points).withColumn("sharp", turn_degrees() < sharp)
    cut = lambda t: F.struct((F.col("px") * (1 - t) + F.col("cx") * t).alias("px"), (F.col("py") * (1 - t) + F.col("cy") * t).alias("py"))
    same = F.array(F.struct("px", "py"))
    new = F.when(F.col("sharp") | (F.col("n") < 4), same).otherwise(F.array(cut(0.25), cut(0.75)))
    made = near.select(*RING, "seq", F.posexplode(new).alias("k", "p"))
    seq = F.row_number().over(W.partitionBy(*RING).orderBy("seq", "k")) - 1
    return made.select(*RING, seq.alias("seq"), "p.px", "p.py")


def measures(points: DataFrame) -> DataFrame:
    """(image_id, ring, n, area, perimeter, x0, y0, w, h): area is signed, positive where y grows down and x leads."""
    p = _around(points)
    return p.groupBy(*RING).agg(
        F.count("*").alias("n"),
        (F.sum(F.col("px") * F.col("cy") - F.col("cx") * F.col("py")) / 2).alias("area"),
        F.sum(F.sqrt((F.col("cx") - F.col("px")) ** 2 + (F.col("cy") - F.col("py")) ** 2)).alias("perimeter"),
        F.min("px").alias("x0"), F.min("py").alias("y0"), (F.max("px") - F.min("px")).alias("w"), (F.max("py") - F.min("py")).alias("h"),
    )


def is_safe(before: DataFrame, after: DataFrame, area: float = 5.0, box: float = 3.0, aspect: float = 3.0, points: float = 85.0) -> DataFrame:
    """(image_id, ring, safe): whether a rewritten ring stays near the original one, by percent limits."""
    a = measures(before).select(*RING, *[F.col(c).alias(f"{c}_a") for c in ("n", "area", "w", "h")])
    b = measures(after).select(*RING, *[F.col(c).alias(f"{c}_b") for c in ("n", "area", "w", "h")])
    one = lambda c: F.greatest(F.lit(1.0), F.col(c))
    off = lambda p, q: F.abs(q - p) / p * 100
    ok = (
        (F.col("n_b") >= 3)
        & (off(F.greatest(F.abs("area_a"), F.lit(1e-9)), F.abs("area_b")) <= area)
        & (F.greatest(off(one("w_a"), F.col("w_b")), off(one("h_a"), F.col("h_b"))) <= box)
        & (off(one("w_a") / one("h_a"), one("w_b") / one("h_b")) <= aspect)
        & ((F.col("n_a") - F.col("n_b")) / F.col("n_a") * 100 <= points)
    )
    return a.join(b, RING, "left").select(*RING, F.coalesce(ok, F.lit(False)).alias("safe"))


def svg_paths(points: DataFrame) -> DataFrame:
    """(image_id, ring, d): a closed path of quadratic curves through the midpoints of the ring's segments."""
    from ..functions.measures import trimmed

    p = _around(points).where("n >= 3")
    x, y = trimmed(F.col("px"), 2), trimmed(F.col("py"), 2)
    mx, my = trimmed((F.col("px") + F.col("cx")) / 2, 2), trimmed((F.col("py") + F.col("cy")) / 2, 2)
    steps = p.select(*RING, "seq", F.concat_ws(" ", F.lit("Q"), x, y, mx, my).alias("q"), F.concat_ws(" ", F.lit("M"), x, y).alias("m"))
    g = steps.groupBy(*RING).agg(F.array_sort(F.collect_list(F.struct("seq", "q", "m"))).alias("s"))
    return g.select(*RING, F.concat_ws(" ", F.col("s")[0]["m"], F.array_join("s.q", " "), F.lit("Z")).alias("d"))


#: Pointers double, so that so many rounds serve any forest.
MAX_ROUNDS = 30


def hole_parity(parents: DataFrame) -> DataFrame:
    """(image_id, ring, depth, hole) of a forest (image_id, ring, parent): odd depths are holes.

    Pointers are doubled until none is left, so that a depth of d takes log d joins; rings that
    are their own ancestors raise an error.
    """
    from ..storage import written

    state = written(parents.select(*RING, F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")), "parity")
    for _ in range(MAX_ROUNDS):
        if state.where("up is not null").limit(1).count() == 0:
            break
        above = state.select("image_id", F.col("ring").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = written(state.join(above, ["image_id", "up"], "left").select(*RING, F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "parity")
    else:
        raise RuntimeError("the rings' parents did not settle")
    return state.select(*RING, "depth", (F.col("depth") % 2 == 1).alias("hole"))


def _chain(table: pa.Table, begins: list[int]) -> pa.Table:
    """Directed border edges into rings, image by image; at a corner where two rings touch, the left turn keeps them apart."""
    columns = [table.column(c).to_pylist() for c in ("ax", "ay", "bx", "by")]
    image, number, seq, px, py = [], [], [], [], []
    for begin, end in zip(begins, begins[1:], strict=False):
        follow: dict[tuple, list[tuple]] = {}
        for ax, ay, bx, by in zip(*(c[begin:end] for c in columns), strict=True):
            follow.setdefault((ax, ay), []).append((bx, by))
        rings = 0
        for start in sorted(follow, key=lambda p: (p[1], p[0])):
            while follow.get(start):
                ring, at, came = [], start, None
                while follow.get(at):
                    ways = follow[at]
                    turn = lambda q: (came[0] * (q[1] - at[1]) - came[1] * (q[0] - at[0])) if came else 0  # noqa: B023, E731
                    to = min(ways, key=lambda q: (turn(q), q)) if len(ways) > 1 else ways[0]
                    ways.remove(to)
                    ring.append(at)
                    came, at = (to[0] - at[0], to[1] - at[1]), to
                    if at == start:
                        break
                n = len(ring)
                image += [begin] * n
                number += [rings] * n
                seq += range(n)
                px += [float(p[0]) for p in ring]
                py += [float(p[1]) for p in ring]
                rings += 1
    return pa.table({"image_id": table.column("image_id").take(pa.array(image, pa.int64())), "ring": pa.array(number, pa.int32()), "seq": pa.array(seq, pa.int32()), "px": pa.array(px, pa.float64()), "py": pa.array(py, pa.float64())})


def trace(mask: DataFrame) -> DataFrame:
    """Rings along the pixel borders of a mask, outer ones and holes in opposite directions.

    The border edges come from windows; only they meet in a kernel, image by image.
    """
    e = exposed(mask)
    sides = {"north": (0, 0, 1, 0), "east": (1, 0, 1, 1), "south": (1, 1, 0, 1), "west": (0, 1, 0, 0)}
    edge = F.array(*[F.when(F.col(s), F.struct((F.col("x") + a).alias("ax"), (F.col("y") + b).alias("ay"), (F.col("x") + c).alias("bx"), (F.col("y") + d).alias("by"))) for s, (a, b, c, d) in sides.items()])
    edges = e.select("image_id", F.explode(F.array_compact(edge)).alias("e")).select("image_id", "e.*")
    kind = mask.schema["image_id"].dataType.simpleString()
    return groups.by_group(edges, ["image_id"], _chain, f"image_id {kind}, ring int, seq int, px double, py double")


def _kept(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on an open line: flags of the points that stay."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    spans = [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        line, off = points[b] - points[a], points[a + 1 : b] - points[a]
        size = np.hypot(*line)
        d = np.abs(line[0] * off[:, 1] - line[1] * off[:, 0]) / size if size else np.hypot(*off.T)
        k = int(np.argmax(d))
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def _filtered(points: DataFrame, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The points of each ring that ``keep`` flags, given all of them in order."""

    def run(table: pa.Table, begins: list[int]) -> pa.Table:
        p = np.stack([table.column("px").to_numpy(), table.column("py").to_numpy()], 1)
        return table.filter(pa.array(np.concatenate([keep(p[begin:end]) for begin, end in zip(begins, begins[1:], strict=False)])))

    slim = points.select(*RING, "seq", "px", "py")
    return groups.by_group(slim, RING, run, slim.schema, ("seq",))


def simplify(points: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker on each ring, from its first point and the point farthest from it."""

    def one(p: np.ndarray) -> np.ndarray:
        if len(p) < 4:
            return np.ones(len(p), bool)
        far = int(np.argmax(np.hypot(*(p - p[0]).T)))
        if not far:
            return np.arange(len(p)) < 1
        return np.concatenate([_kept(p[: far + 1], tolerance)[:-1], _kept(np.concatenate([p[far:], p[:1]]), tolerance)[:-1]])

    return _filtered(points, one)


def contains(rings: DataFrame, points: DataFrame) -> DataFrame:
    """(image_id, ring, point): the rings around each point (image_id, point, x, y), by crossings of a ray to the right.

    An edge meets the points of its rows only: both are keyed by whole y, an edge once per row it spans.
    """
    p = _around(rings).where("py <> cy").select("image_id", "ring", "px", "py", "cx", "cy")
    p = p.withColumn("row", F.explode(F.sequence(F.floor(F.least("py", "cy")), F.floor(F.greatest("py", "cy")))))
    hit = p.join(points.withColumn("row", F.floor("y")), ["image_id", "row"]).where(((F.col("py") > F.col("y")) != (F.col("cy") > F.col("y"))) & (F.col("x") < (F.col("cx") - F.col("px")) * (F.col("y") - F.col("py")) / (F.col("cy") - F.col("py")) + F.col("px")))
    return hit.groupBy("image_id", "ring", "point").agg(F.count("*").alias("n")).where("n % 2 = 1").select("image_id", "ring", "point")


def holes_to_exteriors(exteriors: DataFrame, holes: DataFrame) -> DataFrame:
    """(image_id, hole, exterior): the smallest exterior around each hole's first point; holes outside all are left out."""
    first = holes.groupBy("image_id", F.col("ring").alias("point")).agg(F.min_by(F.struct("px", "py"), "seq").alias("p")).select("image_id", "point", F.col("p.px").alias("x"), F.col("p.py").alias("y"))
    size = measures(exteriors).select(*RING, F.abs("area").alias("area"))
    found = contains(exteriors, first).join(size, RING)
    return found.groupBy("image_id", F.col("point").alias("hole")).agg(F.min(F.struct("area", "ring")).alias("s")).select("image_id", "hole", F.col("s.ring").alias("exterior"))


def fill(points: DataFrame, resolution: int = 1) -> DataFrame:
    """(image_id, y, x): pixels whose centres rings enclose an odd number of times, row by row.

    Each edge meets its rows only; crossings of a row, sorted, open and close spans in turn.
    """
    mid = lambda c: F.col(c) * resolution - 0.5
    e = _around(points).select("image_id", mid("px").alias("px"), mid("py").alias("py"), mid("cx").alias("cx"), mid("cy").alias("cy")).where("py <> cy")
    low, high = F.least("py", "cy"), F.greatest("py", "cy")
    rows = e.withColumn("a", F.ceil(low)).withColumn("b", F.ceil(high) - 1).where("b >= a").withColumn("y", F.explode(F.expr("sequence(a, b)")))
    cross = rows.select("image_id", "y", (F.col("px") + (F.col("y") - F.col("py")) * (F.col("cx") - F.col("px")) / (F.col("cy") - F.col("py"))).alias("at"))
    w = W.partitionBy("image_id", "y").orderBy("at")
    spans = cross.withColumn("k", F.row_number().over(w)).withColumn("to", F.lead("at").over(w)).where("k % 2 = 1 and to is not null")
    spans = spans.withColumn("a", F.ceil("at")).withColumn("b", F.ceil("to") - 1).where("b >= a")
    return spans.select("image_id", F.col("y").cast("int").alias("y"), F.explode(F.expr("sequence(cast(a as int), cast(b as int))")).alias("x"))


def turns(points: DataFrame) -> DataFrame:
    """(image_id, ring, right_turns, left_turns, straight): how a ring bends at its points, y growing down."""
    bend = F.round((F.col("px") - F.col("ax")) * (F.col("cy") - F.col("py")) - (F.col("py") - F.col("ay")) * (F.col("cx") - F.col("px")), 6)
    return _around(points).groupBy(*RING).agg(F.count_if(bend > 0).alias("right_turns"), F.count_if(bend < 0).alias("left_turns"), F.count_if(bend == 0).alias("straight"))


def straighten(points: DataFrame, tolerance: float = 12.0, least: int = 4) -> DataFrame:
    """Runs of ``least`` points or more without a turn over ``tolerance`` degrees keep their ends only.

    Runs are islands between turns: a running count of turns numbers them, and each ends at its last point.
    """
    w = W.partitionBy(*RING).orderBy("seq")
    near = _around(points).withColumn("run", F.sum((F.abs(180.0 - turn_degrees()) > tolerance).cast("int")).over(w))
    inside = W.partitionBy(*RING, "run")
    sized = near.withColumn("len", F.count("*").over(inside)).withColumn("k", F.row_number().over(inside.orderBy("seq")))
    return sized.where((F.col("len") < least) | (F.col("k") == 1) | (F.col("k") == F.col("len"))).select(*RING, "seq", "px", "py")


def fit_curves(points: DataFrame, tolerance: float = 0.5, least_chord: float = 2.0, most_percent: float = 5.0, sharp: float = 60.0) -> DataFrame:
    """Each point but sharp ones moved a quarter of the way to its neighbours' middle and back, where that is a small step.

    All points look at the unmoved ring, so one window pass does it.
    """
    near = _around(points)
    chord = F.sqrt((F.col("cx") - F.col("ax")) ** 2 + (F.col("cy") - F.col("ay")) ** 2)
    mx, my = ((F.col(a) + F.col(p) * 2 + F.col(c)) / 4 for a, p, c in (("ax", "px", "cx"), ("ay", "py", "cy")))
    step = F.sqrt((mx - F.col("px")) ** 2 + (my - F.col("py")) ** 2)
    moves = (F.col("n") >= 6) & (turn_degrees() >= sharp) & (chord >= least_chord) & ((step <= tolerance) | (step / F.greatest(F.lit(1.0), chord) * 100 <= most_percent))
    return near.select(*RING, "seq", F.when(moves, mx).otherwise(F.col("px")).alias("px"), F.when(moves, my).otherwise(F.col("py")).alias("py"))


def restore_corners(original: DataFrame, cleaned: DataFrame, sharp: float = 60.0, literal: bool = True) -> DataFrame:
    """``cleaned`` with the original's sharp corners: put at the ring's end (``literal``), or at their own places."""
    corners = _around(original).where(turn_degrees() < sharp).select(*RING, "seq", "px", "py")
    if not literal:
        return cleaned.select(*RING, "seq", "px", "py").unionByName(corners).dropDuplicates([*RING, "seq"])
    both = cleaned.select(*RING, F.lit(0).alias("part"), "seq", "px", "py").unionByName(corners.select(*RING, F.lit(1).alias("part"), "seq", "px", "py"))
    order = W.partitionBy(*RING).orderBy("part", "seq")
    return both.select(*RING, (F.row_number().over(order) - 1).alias("seq"), "px", "py")


def straighten_chords(points: DataFrame, tolerance: float = 0.6, least_length: float = 6.0, ahead: int = 17) -> DataFrame:
    """From each point on, the farthest of the next ``ahead`` points whose chord no point between leaves by more than ``tolerance``.

    What a chord spans goes; the next one starts behind it, so the points of a ring are taken in turn by a kernel.
    """

    def one(p: np.ndarray) -> np.ndarray:
        if len(p) < 5:
            return np.ones(len(p), bool)
        keep = np.zeros(len(p), bool)
        at = 0
        while at < len(p):
            reach = at
            lines = p[at + 2 : at + ahead + 1] - p[at]
            sizes = np.hypot(lines[:, 0], lines[:, 1])
            for n in np.flatnonzero(sizes >= least_length):
                to, line = at + 2 + int(n), lines[n]
                off = p[at : to + 1] - p[at]
                if np.abs(line[0] * off[:, 1] - line[1] * off[:, 0]).max() <= tolerance * sizes[n]:
                    reach = to
            keep[reach] = True
            if reach > at and not keep[:at].any():
                keep[at] = True
            at = reach + 1
        return keep if keep.sum() >= 3 else np.ones(len(p), bool)

    return _filtered(points, one)


def clean_contours(points: DataFrame, tolerance: float = 0.7, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rings, report): simplified, merged, straightened, curve-fitted and rounded rings where safe, else the original.

    The report has a row per image: rings, points before and after, rings that fell back.
    """
    from ..storage import written

    merged = merge_collinear(written(simplify(points, tolerance), "simplified"))
    new = fit_curves(written(straighten_chords(merged), "straight"))
    for _ in range(rounds):
        new = round_corners(new)
    new = written(merge_collinear(new), "rounded")
    safe = written(is_safe(points, new), "safe")
    out = new.join(safe.where("safe").select(*RING), RING, "left_semi").unionByName(points.join(safe.where("not safe").select(*RING), RING, "left_semi").select(*RING, "seq", "px", "py"))
    out = written(out, "contours")
    before = points.groupBy("image_id").agg(F.countDistinct("ring").alias("rings"), F.count("*").alias("points_before"))
    after = out.groupBy("image_id").agg(F.count("*").alias("points_after"))
    fell = safe.groupBy("image_id").agg(F.count_if(~F.col("safe")).alias("fallbacks"))
    return out, before.join(after, "image_id").join(fell, "image_id")


def valid(points: DataFrame, least_area: float = 0.0) -> DataFrame:
    """Rings of three points or more that enclose more than ``least_area``."""
    good = measures(points).where((F.col("n") >= 3) & (F.abs("area") > least_area)).select(*RING)
    return points.join(good, RING, "left_semi")
