"""Polygon sets as relations: overlay, offset, parts, caps and extrusion.

Two sets of rings meet in slabs.  A slab lies between two neighbouring heights of an image,
where heights are those of all points and of all crossings, so that no two edges cross
inside it and their order is that of their middles.  Running windings along that order tell
what each stretch belongs to; the stretches that a rule selects are the result: spans
(image_id, k, y0, y1, l0, l1, r0, r1), trapezoids with level tops and bottoms.  Everything
else follows from the spans: areas are sums, borders are their sides and what differs
between the slabs above and below a height, caps are their triangles.

Edges are dealt by image once.  There they meet by tile to find crossings and by row of
tiles to be ordered: groupings and windows keyed by image and tile, row or slab, whose
arrays hold what shares a tile or a row, and which send nothing again.  One kernel, an
image's border at a call, follows borders into rings.  Coordinates are kept on a grid of ``GRID`` steps per unit, so equal
places are equal values.

Points are (image_id, ring, seq, px, py).  A result's outer rings have a positive area and
its holes a negative one.  Rings of less than three points, edges of no length and level
edges add nothing; an image without any span has no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import met, shared_out, written
from . import contours, groups, meshes

GRID = 2.0**20
#: So many edges or spans, each of which becomes about ten rows, are a task's share.
TASK_EDGES = 100_000
#: Which windings are inside a set of rings: overlapping outlines, nested outlines, or outlines with a direction.
INSIDE: dict[str, Callable[[Column], Column]] = {"nonzero": lambda w: w != 0, "evenodd": lambda w: w % 2 != 0, "positive": lambda w: w > 0}
UNION: Callable[[Column, Column], Column] = lambda a, b: a | b
BOTH: Callable[[Column, Column], Column] = lambda a, b: a & b
ONLY: Callable[[Column, Column], Column] = lambda a, b: a & ~b
EITHER: Callable[[Column, Column], Column] = lambda a, b: a != b


def _along():
    """A slab's edges from left to right."""
    return W.partitionBy("image_id", "k").orderBy("mid", "x0", "x1")


def snap(c: Column) -> Column:
    # halves away from zero; round() would go through decimals, and -0.0 becomes 0.0
    return F.signum(c) * F.floor(F.abs(c) * GRID + 0.5) / GRID + 0.0


def edges(points: DataFrame, side: int = 0) -> DataFrame:
    """(image_id, side, ax, ay, bx, by): a ring's edges, but level ones, on the grid."""
    e = contours._around(points.select(*contours.RING, "seq", "px", "py"))
    return e.select("image_id", F.lit(side).alias("side"), *[snap(F.col(c)).alias(n) for c, n in (("px", "ax"), ("py", "ay"), ("cx", "bx"), ("cy", "by"))]).where("ay <> by")


def _with_tile(e: DataFrame, tile: float | None = None) -> DataFrame:
    """Adds the side of an image's tiles: about twice its edges' mean length, so that tiles passed are in proportion to edges."""
    if tile is not None:
        return e.withColumn("tile", F.lit(float(tile)))
    length = F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))).over(W.partitionBy("image_id"))
    return e.withColumn("tile", F.pow(F.lit(2.0), F.round(F.log2(length)) + 1))


def _tiled(e: DataFrame) -> DataFrame:
    """Edges once per tile (ty, tx) that they pass: within each row of tiles, the columns between their ends there; ``first`` marks one of them."""
    low, high, tile = F.least("ay", "by"), F.greatest("ay", "by"), F.col("tile")
    rows = e.select("*", F.posexplode(F.sequence(F.floor(low / tile), F.floor(high / tile))).alias("row", "ty"))
    at = lambda y: F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    p, q = at(F.greatest(low, F.col("ty") * tile)), at(F.least(high, (F.col("ty") + 1) * tile))
    both = rows.select("*", F.posexplode(F.sequence(F.floor((F.least(p, q) - 1e-6) / tile), F.floor((F.greatest(p, q) + 1e-6) / tile))).alias("column", "tx"))
    return both.withColumn("first", F.expr("row = 0 and column = 0")).drop("row", "column")


def _meetings(e: DataFrame) -> DataFrame:
    """(image_id, tile, p, y): each edge p once, without y, and the heights y at which it crosses others; only edges that share a tile meet."""
    ends = ("ax", "ay", "bx", "by")
    box = {"x0": F.least("ax", "bx"), "x1": F.greatest("ax", "bx"), "y0": F.least("ay", "by"), "y1": F.greatest("ay", "by")}
    more = [c for c in e.columns if c not in ("image_id", "tile", *ends)]
    edge = F.struct(*ends, *more, "first", *[c.alias(n) for n, c in box.items()])
    held = _tiled(e).groupBy("image_id", "tile", "ty", "tx").agg(F.sort_array(F.collect_list(edge)).alias("es"))
    own = held.select("image_id", "tile", "es", F.posexplode("es").alias("i", "p"))
    flat = [F.col(f"p.{c}").alias(f"p{c}") for c in (*ends, *more, "first", *box)]
    # an edge meets itself, which stands for itself, and those behind it; flat columns keep the compiled code short
    pairs = own.select("image_id", "tile", *flat, F.slice("es", F.col("i") + 1, F.size("es")).alias("es"))
    pairs = pairs.select("image_id", "tile", *[f"p{c}" for c in (*ends, *more, "first", *box)], F.inline("es").alias(*[f"q{c}" for c in (*ends, *more, "first", *box)]))
    same = " and ".join(f"p{c} = q{c}" for c in ends)
    pairs = pairs.where("if(" + same + ", pfirst, px1 >= qx0 and qx1 >= px0 and py1 >= qy0 and qy1 >= py0)")
    (rx, ry), (sx, sy) = ((F.col(f"{s}bx") - F.col(f"{s}ax"), F.col(f"{s}by") - F.col(f"{s}ay")) for s in "pq")
    ox, oy = F.col("qax") - F.col("pax"), F.col("qay") - F.col("pay")
    p = F.struct(*[F.col(f"p{c}").alias(c) for c in (*ends, *more)]).alias("p")
    # an edge crosses none of its own direction, itself included
    turn = F.nullif(rx * sy - ry * sx, F.lit(0.0))
    cut = pairs.select("image_id", "tile", p, F.expr(same).alias("same"), ((ox * sy - oy * sx) / turn).alias("t"), ((ox * ry - oy * rx) / turn).alias("u")).where("same or (t between 0 and 1 and u between 0 and 1)")
    return cut.select("image_id", "tile", "p", F.when(~F.col("same"), snap(F.col("p.ay") + F.col("t") * (F.col("p.by") - F.col("p.ay")))).alias("y"))


def crossings(e: DataFrame) -> DataFrame:
    """(image_id, tile, y): heights at which two edges of an image cross."""
    return _meetings(e).where("y is not null").select("image_id", "tile", "y").distinct()


def _ordered(a: DataFrame, b: DataFrame | None, rule: str, rule_b: str | None, tile: float | None) -> DataFrame:
    """(image_id, k, y0, y1, mid, x0, x1, m0, m1, ina, inb): the edges of each slab from left to right, and what lies to their right.

    An edge meets the slabs that begin in its rows of tiles, and keeps those between its ends.
    """
    e = (edges(a) if b is None else edges(a).unionByName(edges(b, 1))).where("image_id is not null")
    # from left to right, an edge that goes to lesser y enters a ring of positive area
    turn = F.when(F.col("by") < F.col("ay"), 1).otherwise(-1)
    e = written(e.select("image_id", "ax", "ay", "bx", "by", F.when(F.col("side") == 0, turn).otherwise(0).alias("da"), F.when(F.col("side") == 1, turn).otherwise(0).alias("db")), "polygon-edges")
    # one shuffle serves all groupings and windows below, since their keys begin with the image
    e = shared_out(e, e.count(), "image_id", share=TASK_EDGES).groupBy("image_id", "ax", "ay", "bx", "by").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    rows = _meetings(_with_tile(e, tile))
    # edges, which have no height, go along before the heights of their ends and crossings
    rows = rows.select("image_id", "tile", "p", F.explode(F.when(F.col("y").isNull(), F.array(F.lit(None).cast("double"), "p.ay", "p.by")).otherwise(F.array("y"))).alias("y0"))
    up = W.partitionBy("image_id").orderBy(F.col("y0").asc_nulls_first())
    rows = rows.select("image_id", "tile", F.when(F.col("y0").isNull(), F.col("p")).alias("p"), "y0", F.lead("y0").over(up).alias("y1"), (F.dense_rank().over(up) - 1).alias("k")).where("p is not null or y1 > y0")
    low, high = F.coalesce(F.least("p.ay", "p.by"), "y0"), F.coalesce(F.greatest("p.ay", "p.by"), "y0")
    rows = rows.select("image_id", "p", "k", "y0", "y1", F.explode(F.sequence(F.floor(low / F.col("tile")), F.floor(high / F.col("tile")))).alias("ty"))
    held = rows.groupBy("image_id", "ty").agg(F.collect_list("p").alias("ps"), F.collect_list(F.when(F.col("p").isNull(), F.struct("k", "y0", "y1"))).alias("slabs"))
    each = held.select("image_id", "slabs", F.explode("ps").alias("p")).select("image_id", "p", F.explode("slabs").alias("s")).select("image_id", "p.*", "s.*")
    each = each.where((F.col("y0") >= F.least("ay", "by")) & (F.col("y0") < F.greatest("ay", "by")))
    x = lambda y: F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    placed = each.select("image_id", "k", "y0", "y1", snap(x(F.col("y0"))).alias("x0"), snap(x(F.col("y1"))).alias("x1"), x((F.col("y0") + F.col("y1")) / 2).alias("mid"), "da", "db")
    sides = placed.groupBy("image_id", "k", "y0", "y1", "x0", "x1").agg(F.min("mid").alias("mid"), F.sum("da").alias("da"), F.sum("db").alias("db"))
    so_far = _along().rowsBetween(W.unboundedPreceding, 0)
    # rounding may swap ends of edges that meet at a height; a running maximum keeps them in order
    return sides.select("image_id", "k", "y0", "y1", "mid", "x0", "x1", F.max("x0").over(so_far).alias("m0"), F.max("x1").over(so_far).alias("m1"), INSIDE[rule](F.sum("da").over(so_far)).alias("ina"), INSIDE[rule_b or rule](F.sum("db").over(so_far)).alias("inb"))


def spans(a: DataFrame, b: DataFrame | None = None, select: Callable[[Column, Column], Column] = UNION, rule: str = "evenodd", rule_b: str | None = None, tile: float | None = None) -> DataFrame:
    """Trapezoids of the places that ``select`` picks by their being inside ``a`` and inside ``b``.

    ``area`` is that of the unsnapped trapezoid.
    """
    marked = _ordered(a, b, rule, rule_b, tile).withColumn("inside", select(F.col("ina"), F.col("inb")))
    changes = marked.withColumn("before", F.coalesce(F.lag("inside").over(_along()), F.lit(False))).where("inside <> before")
    ends = {f"r{c}": F.lead(f"m{c}").over(_along()) for c in "01"} | {"right": F.lead("mid").over(_along())}
    out = changes.withColumns(ends).where("inside and right is not null")
    out = out.select("image_id", "k", "y0", "y1", F.col("m0").alias("l0"), F.col("m1").alias("l1"), "r0", "r1", ((F.col("y1") - F.col("y0")) * (F.col("right") - F.col("mid"))).alias("area"))
    return written(out.where("l0 < r0 or l1 < r1"), "spans")


def overlay_areas(a: DataFrame, b: DataFrame, selects: dict[str, Callable[[Column, Column], Column]], rule: str = "evenodd", tile: float | None = None) -> DataFrame:
    """(image_id, a column per name): the areas of several overlays of the same two sets, which are ordered once."""
    along = _ordered(a, b, rule, None, tile)
    size = (F.col("y1") - F.col("y0")) * (F.lead("mid").over(_along()) - F.col("mid"))
    stretches = along.select("image_id", "ina", "inb", size.alias("area")).where("ina or inb")
    return stretches.groupBy("image_id").agg(*[F.coalesce(F.sum(F.when(how(F.col("ina"), F.col("inb")), F.col("area"))), F.lit(0.0)).alias(n) for n, how in selects.items()])


def areas(found: DataFrame) -> DataFrame:
    return found.groupBy("image_id").agg(F.sum("area").alias("area"))


def _level_points(found: DataFrame) -> DataFrame:
    """(image_id, y, x, above, below, next): places on each height where spans end, and whether spans lie above and below up to the next."""
    ends = F.explode(F.array(*[F.struct(F.col(y).alias("y"), F.col(x).alias("x"), F.lit(u).alias("u"), F.lit(v).alias("v")) for y, x, u, v in (("y0", "l0", 1, 0), ("y0", "r0", -1, 0), ("y1", "l1", 0, 1), ("y1", "r1", 0, -1))]))
    p = found.select("image_id", ends.alias("p")).select("image_id", "p.*").groupBy("image_id", "y", "x").agg(F.sum("u").alias("u"), F.sum("v").alias("v"))
    w = W.partitionBy("image_id", "y").orderBy("x")
    return p.select("image_id", "y", "x", (F.sum("u").over(w) > 0).alias("above"), (F.sum("v").over(w) > 0).alias("below"), F.lead("x").over(w).alias("next"))


def borders(found: DataFrame) -> DataFrame:
    """(image_id, ax, ay, bx, by, kind, k, l0, l1): directed border pieces, the inside to their left where y grows up.

    Kinds are L and R, the sides of a span, and H, level pieces where only one of the slabs at a height is inside.
    """
    piece = lambda ax, ay, bx, by, kind: F.struct(F.col(ax).alias("ax"), F.col(ay).alias("ay"), F.col(bx).alias("bx"), F.col(by).alias("by"), F.lit(kind).alias("kind"))
    sides = found.select("image_id", F.explode(F.array(piece("l1", "y1", "l0", "y0", "L"), piece("r0", "y0", "r1", "y1", "R"))).alias("p"), "k", "l0", "l1").select("image_id", "p.*", "k", "l0", "l1")
    level = _level_points(found).where("above <> below and next is not null")
    ahead = F.col("above")
    level = level.select("image_id", F.when(ahead, F.col("x")).otherwise(F.col("next")).alias("ax"), F.col("y").alias("ay"), F.when(ahead, F.col("next")).otherwise(F.col("x")).alias("bx"), F.col("y").alias("by"), F.lit("H").alias("kind"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("double").alias("l0"), F.lit(None).cast("double").alias("l1"))
    return sides.unionByName(level)


def _corners(x: list[float], y: list[float]) -> list[bool]:
    """Which points of a ring stay: those farther than rounding from the line between the last that stayed and the next."""
    n, last, stays = len(x), 0, [0]

    def off(a: int, p: int, c: int) -> bool:
        dx, dy = x[c] - x[a], y[c] - y[a]
        chord = math.hypot(dx, dy)
        turn = abs(dx * (y[p] - y[a]) - dy * (x[p] - x[a]))
        return turn > 1.5 / GRID * chord if chord else (x[p], y[p]) != (x[a], y[a])

    for p in range(1, n):
        if off(last, p, (p + 1) % n):
            stays.append(p)
            last = p
    if len(stays) > 2 and not off(stays[-1], 0, stays[1]):
        stays = stays[1:]
    keep = [False] * n
    for p in stays:
        keep[p] = True
    return keep


def _rings_of(ax: list[float], ay: list[float], bx: list[float], by: list[float]) -> list[list[int]]:
    """One image's border pieces, sorted by ay, ax, bx, by, as rings; where rings touch, the sharpest left turn keeps what is inside apart."""
    leaving: dict[tuple[float, float], list[int]] = {}
    for n, at in enumerate(zip(ax, ay, strict=True)):
        leaving.setdefault(at, []).append(n)
    used, rings = [False] * len(ax), []
    for first in range(len(ax)):
        if used[first]:
            continue
        at, ring = first, []
        while True:
            used[at] = True
            ring.append(at)
            ways = [w for w in leaving[bx[at], by[at]] if not used[w] or w == first]
            if not ways:
                break
            to = ways[0]
            if len(ways) > 1:
                dx, dy, best = bx[at] - ax[at], by[at] - ay[at], -math.inf
                for w in ways:
                    ex, ey = bx[w] - ax[w], by[w] - ay[w]
                    cross, dot = dx * ey - dy * ex, dx * ex + dy * ey
                    # straight back comes last: what is inside lies between
                    turn = -math.pi if cross == 0 and dot < 0 else math.atan2(cross, dot)
                    if turn > best:
                        to, best = w, turn
            at = to
            if at == first:
                break
        rings.append(ring)
    return rings


def _follow(table: pa.Table, begins: list[int]) -> pa.Table:
    """Border pieces in ring order, image by image, with ring, part, hole and whether the ring turns at a piece's start.

    A hole belongs to the ring at the left end of the span that ends at the hole's leftmost piece, or
    to what that ring belongs to.
    """
    columns = [table.column(c).to_pylist() for c in ("ax", "ay", "bx", "by", "kind", "k", "l0", "l1")]
    order, corner, ring_no, seq, part_no, is_hole = [], [], [], [], [], []
    for begin, end in zip(begins, begins[1:], strict=False):
        ax, ay, bx, by, kind, k, l0, l1 = (c[begin:end] for c in columns)
        found = _rings_of(ax, ay, bx, by)
        size = [sum(ax[n] * by[n] - bx[n] * ay[n] for n in ring) / 2 for ring in found]
        up = {}
        if min(size) < 0:
            left_ring = {(k[n], l0[n], l1[n]): r for r, ring in enumerate(found) for n in ring if kind[n] == "L"}
            for r, ring in enumerate(found):
                if size[r] < 0:
                    n = min((n for n in ring if kind[n] == "R"), key=lambda n: (min(ax[n], bx[n]), ay[n]), default=None)  # noqa: B023
                    up[r] = r if n is None else left_ring[k[n], l0[n], l1[n]]
        for r, ring in enumerate(found):
            part, seen = r, set()
            while size[part] < 0 and part not in seen:
                seen.add(part)
                part = up[part]
            n = len(ring)
            order += [begin + i for i in ring]
            corner += _corners([ax[i] for i in ring], [ay[i] for i in ring])
            ring_no += [r] * n
            seq += range(n)
            part_no += [part] * n
            is_hole += [size[r] < 0] * n
    take = table.take(pa.array(order, pa.int64()))
    for name, values, kind_ in (("corner", corner, pa.bool_()), ("ring", ring_no, pa.int32()), ("seq", seq, pa.int32()), ("part", part_no, pa.int32()), ("hole", is_hole, pa.bool_())):
        take = take.append_column(name, pa.array(values, kind_))
    return take


def outlines(found: DataFrame) -> DataFrame:
    """Border pieces with ring, seq, part and hole."""
    kind, found = found.schema["image_id"].dataType.simpleString(), by_image(found)
    schema = f"image_id {kind}, ax double, ay double, bx double, by double, kind string, k int, l0 double, l1 double, corner boolean, ring int, seq int, part int, hole boolean"
    return written(groups.by_group(borders(found), ["image_id"], _follow, schema, ("ay", "ax", "bx", "by")), "outlines")


def rings(outline: DataFrame) -> DataFrame:
    """(image_id, ring, seq, px, py, part, hole): the points at which outlines turn."""
    return outline.where("corner").select(*contours.RING, "seq", F.col("ax").alias("px"), F.col("ay").alias("py"), "part", "hole")


def part_measures(outline: DataFrame) -> DataFrame:
    """(image_id, part, area, holes, w, h): an outer ring less its holes, and the box around it."""
    cross = (F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2
    out = outline.groupBy("image_id", "part").agg(F.sum(cross).alias("area"), F.count_distinct(F.when(F.col("hole"), F.col("ring"))).alias("holes"), (F.max("ax") - F.min("ax")).alias("w"), (F.max("ay") - F.min("ay")).alias("h"))
    return out.where("area > 0")


def offset(points: DataFrame, distance: float | str, quarter: int = 16) -> DataFrame:
    """Directed rings moved outwards by ``distance`` (inwards below 0; a column's name for one per row).

    Corners that open get an arc of ``quarter`` chords per right angle (1: cut straight), the others run
    through the corner itself, so that the windings of what folds over there are not positive.
    The outline of the result is ``spans(offset(..), rule="positive")``.
    """
    d = F.col(distance) if isinstance(distance, str) else F.lit(float(distance))
    own = [c for c in points.columns if c not in (*contours.RING, "seq", "px", "py")]
    p = contours._around(points)
    # normals to the right of the edge before and of the edge after
    ux, uy, vx, vy = F.col("px") - F.col("ax"), F.col("py") - F.col("ay"), F.col("cx") - F.col("px"), F.col("cy") - F.col("py")
    nu, nv = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
    p = p.where((nu > 0) & (nv > 0)).withColumns({"d": d, "nx": uy / nu, "ny": -ux / nu, "mx": vy / nv, "my": -vx / nv})
    turn = F.atan2(F.col("nx") * F.col("my") - F.col("ny") * F.col("mx"), F.col("nx") * F.col("mx") + F.col("ny") * F.col("my"))
    p = p.withColumn("turn", turn).withColumn("steps", F.greatest(F.lit(1), F.ceil(F.abs("turn") / (math.pi / 2 / quarter) - 1e-9)).cast("int"))
    point = lambda x, y: F.struct(x.alias("px"), y.alias("py"))
    moved = lambda n, m: point(F.col("px") + F.col("d") * n, F.col("py") + F.col("d") * m)

    def on_arc(j: Column) -> Column:
        a = F.col("turn") * j / F.col("steps")
        return F.when(j == 0, moved(F.col("nx"), F.col("ny"))).when(j == F.col("steps"), moved(F.col("mx"), F.col("my"))).otherwise(moved(F.col("nx") * F.cos(a) - F.col("ny") * F.sin(a), F.col("nx") * F.sin(a) + F.col("ny") * F.cos(a)))

    arc = F.transform(F.sequence(F.lit(0), F.col("steps")), on_arc)
    sharp = F.array(moved(F.col("nx"), F.col("ny")), point(F.col("px"), F.col("py")), moved(F.col("mx"), F.col("my")))
    straight = F.array(moved(F.col("nx"), F.col("ny")))
    new = F.when(F.col("d") == 0, F.array(point(F.col("px"), F.col("py")))).when(F.abs("turn") < 1e-12, straight).when(F.col("turn") * F.col("d") > 0, arc).otherwise(sharp)
    made = p.select(*contours.RING, *own, "seq", F.posexplode(new).alias("j", "p"))
    seq = F.row_number().over(W.partitionBy(*contours.RING).orderBy("seq", "j")) - 1
    return made.select(*contours.RING, seq.alias("seq"), "p.px", "p.py", *own)


def by_image(found: DataFrame) -> DataFrame:
    """Written spans dealt by image, so that what groups them by image and height or side sends them once."""
    return shared_out(found, found.count(), "image_id", share=TASK_EDGES)


def caps(found: DataFrame, part: DataFrame | None = None) -> DataFrame:
    """(image_id, part, a, b, c): triangles that cover the spans, in positive turn.

    A span's top and bottom are split where spans beyond them end, so triangles meet side to side:
    each piece of the bottom has its apex at the top's left end, each of the top at the bottom's right end.
    """
    own = found.withColumn("part", F.lit(0)) if part is None else met(found, part, ["image_id", "k", "l0", "l1"])
    level = lambda y, l, r, x, apex, top: F.struct(F.col(y).alias("y"), F.struct(F.col("part"), F.col(l).alias("l"), F.col(r).alias("r"), F.struct(F.col(x).alias("x"), F.col(apex).alias("y")).alias("apex"), F.lit(top).alias("top")).alias("s"))  # noqa: E731, E741
    levels = own.select("image_id", F.explode(F.array(level("y0", "l0", "r0", "l1", "y1", False), level("y1", "l1", "r1", "r0", "y0", True))).alias("e")).select("image_id", "e.*")
    held = levels.groupBy("image_id", "y").agg(F.collect_list("s").alias("ss"))
    held = held.select("image_id", "y", "ss", F.sort_array(F.array_distinct(F.concat("ss.l", "ss.r"))).alias("xs"))
    each = held.select("image_id", "y", "xs", F.explode("ss").alias("s")).select("image_id", "y", "s", F.filter("xs", lambda x: (x >= F.col("s.l")) & (x <= F.col("s.r"))).alias("xs"))
    pieces = each.select("image_id", "y", "s", "xs", F.posexplode(F.slice("xs", 2, F.size("xs"))).alias("j", "x"))
    left, right = (F.struct(x.alias("x"), F.col("y")) for x in (F.get("xs", F.col("j")), F.col("x")))
    on_top = lambda yes, no: F.when(F.col("s.top"), yes).otherwise(no)
    return pieces.select("image_id", F.col("s.part").alias("part"), on_top(F.col("s.apex"), left).alias("a"), right.alias("b"), on_top(left, F.col("s.apex")).alias("c"))


def extruded(found: DataFrame, outline: DataFrame) -> DataFrame:
    """(image_id, f): faces of the prisms over the spans; corners are (part, x, y, top), so parts that touch share none."""
    part = outline.where("kind = 'L'").select("image_id", "k", "l0", "l1", "part")
    corner = lambda p, top: F.struct(F.col("part"), F.col(f"{p}.x").alias("x"), F.col(f"{p}.y").alias("y"), F.lit(top).alias("top"))
    tri = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    flat = caps(found, part).select("image_id", F.explode(F.array(tri(corner("a", 1), corner("b", 1), corner("c", 1)), tri(corner("b", 0), corner("a", 0), corner("c", 0)))).alias("f"))
    side = outline.select("image_id", "part", F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("a"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")).alias("b"))
    walls = side.select("image_id", F.explode(F.array(tri(corner("a", 0), corner("b", 0), corner("b", 1)), tri(corner("a", 0), corner("b", 1), corner("a", 1)))).alias("f"))
    return flat.unionByName(walls)


def mesh_report(faces: DataFrame, height: float) -> DataFrame:
    """(image_id, parts, faces, volume, open_edges, overused_edges, watertight)."""
    z = lambda p: F.col(f"f.{p}.top") * height
    x, y = (lambda p: F.col(f"f.{p}.x")), (lambda p: F.col(f"f.{p}.y"))
    six = x("a") * (y("b") * z("c") - z("b") * y("c")) - y("a") * (x("b") * z("c") - z("b") * x("c")) + z("a") * (x("b") * y("c") - y("b") * x("c"))
    body = faces.groupBy("image_id").agg(F.count_distinct("f.a.part").alias("parts"), F.count("*").alias("faces"), (F.sum(six) / 6).alias("volume"))
    return met(body, meshes.edge_report(faces).select("image_id", "open_edges", "overused_edges", "watertight"), "image_id")
