"""What a printer can make: gaps closed, tiny holes filled, components thickened or removed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import masks, regions
from .masks import KEY
from .neighbourhood import along_columns, along_rows

#: Defaults in mm and mm².
LIMITS = {"hole_area": 1.0, "gap": 0.6, "island_area": 2.0, "segment": 1.5, "dimension": 0.8, "feature": 0.8}


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic kernel: each row reaches to the rounded half chord."""
    rows = [(j, int(radius * math.sqrt(max(0, radius * radius - j * j)) / radius + 0.5)) for j in range(-radius, radius + 1)] if radius else [(0, 0)]
    return [(j, i) for j, reach in rows for i in range(-reach, reach + 1)]


def spread(cells: DataFrame, offsets: list[tuple[int, int]], column: str = "m") -> DataFrame:
    """Dilation of a boolean column by any kernel, within the image: windows on rows for each reach, then on columns.

    Frames are by coordinates, so that pixels an image lacks stay apart; other columns stay.  Offsets fill their rows from side to side.
    """
    reach: dict[int, tuple[int, int]] = {}
    for j, i in offsets:
        low, high = reach.get(j, (i, i))
        reach[j] = (min(low, i), max(high, i))
    row, column_ = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    wide = {r: f"{column}_{k}" for k, r in enumerate(sorted(set(reach.values())))}
    out = cells.withColumns({n: F.max(column).over(row.rangeBetween(*r)) for r, n in wide.items()})
    # a pixel is hit from j rows above, so it looks back
    hit = [F.coalesce(F.max(wide[r]).over(column_.rangeBetween(-j, -j)), F.lit(False)) for j, r in reach.items()]
    any_hit = hit[0]
    for h in hit[1:]:
        any_hit = any_hit | h
    return out.withColumn(column, any_hit).drop(*wide.values())


def close_gaps(mask: DataFrame, radius: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Closing by an elliptic kernel; pixels outside the image do not count."""
    if radius <= 0:
        return mask.select(*KEY, *keep, "m")
    k = disc(min(radius, 3))
    # dealt by image once, which serves the windows of all passes
    grown = spread(mask.select(*KEY, *keep, "m").repartition("image_id"), k).withColumn("m", ~F.col("m"))
    return spread(grown, k).select(*KEY, *keep, (~F.col("m")).alias("m"))


def _action(area: Column, width: Column, height: Column, limits: dict[str, float]) -> Column:
    """What becomes of a component of this size in mm and mm²."""
    small, long = F.least(width, height), F.greatest(width, height)
    least, segment, size, feature = (limits[k] for k in ("island_area", "segment", "dimension", "feature"))
    return (
        F.when((small < feature) & (long >= segment) & (area >= least), "thicken")
        .when(area < least, "area_below_minimum")
        .when((small < size) & (long < segment), "segment_below_minimum")
        .when(small < size, "sliver_below_minimum_dimension")
        .otherwise("keep")
    )


def component_actions(mask: DataFrame, scale: float = 1.0, limits: dict[str, float] = LIMITS) -> DataFrame:
    """(image_id, comp, area_mm2, width_mm, height_mm, action): thicken, keep, or why it goes."""
    # the first run of a component begins at its first pixel and knows its size
    first = regions.measured_runs(mask, F.col("m")).where((F.col("y") == F.col("first_y")) & (F.col("x0") == F.col("first_x")) & F.col("on"))
    s = first.select("image_id", F.concat_ws(":", "first_y", "first_x").alias("comp"), (F.col("area") * scale * scale).alias("area_mm2"), (F.col("w") * scale).alias("width_mm"), (F.col("h") * scale).alias("height_mm"))
    return s.withColumn("action", _action(F.col("area_mm2"), F.col("width_mm"), F.col("height_mm"), limits))


def clean_components(mask: DataFrame, scale: float = 1.0, limits: dict[str, float] = LIMITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The mask after the actions: removed components go, thin ones grow by a pixel."""
    px = regions.measured(mask, F.col("m"), 8, keep)
    action = F.when(F.col("on"), _action(F.col("area") * scale * scale, F.col("w") * scale, F.col("h") * scale, limits))
    px = px.select(*KEY, *keep, F.coalesce(action == "keep", F.lit(False)).alias("stays"), F.coalesce(action == "thicken", F.lit(False)).alias("m"))
    return spread(px.repartition("image_id"), disc(1)).select(*KEY, *keep, (F.col("stays") | F.col("m")).alias("m"))


def enforce(mask: DataFrame, scale: float = 1.0, limits: dict[str, float] = LIMITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tiny holes filled, gaps closed, components cleaned; the columns ``keep`` go along."""
    filled = regions.fill_holes(mask, most_area=limits["hole_area"] / (scale * scale), connectivity=8, keep=keep)
    gap = max(1, math.ceil(limits["gap"] / scale)) if limits["gap"] > 0 else 0
    return clean_components(close_gaps(filled, gap, keep), scale, limits, keep)


def report(before: DataFrame, after: DataFrame, scale: float = 1.0, limits: dict[str, float] = LIMITS) -> DataFrame:
    """(image_id, kept, removed, added, changed, least_area_mm2, empty) of an edit."""
    left = component_actions(after, scale, limits).groupBy("image_id").agg(F.min("area_mm2").alias("least_area_mm2"))
    return masks.changes(before, after).join(left, "image_id", "left").withColumn("empty", F.col("least_area_mm2").isNull())


def height_failures(heights: DataFrame, most_levels: int = 32) -> DataFrame:
    """(image_id, levels, error): images whose heights :func:`enforce_heights` leaves as they are."""
    n = heights.where("z > 0").groupBy("image_id").agg(F.count_distinct("z").alias("levels"))
    return n.where(F.col("levels") > most_levels).withColumn("error", F.concat(F.col("levels").cast("string"), F.lit(f" levels; at most {most_levels} are printable")))


def enforce_heights(heights: DataFrame, scale: float = 1.0, limits: dict[str, float] = LIMITS, most_levels: int = 32) -> DataFrame:
    """Each level's mask enforced, from the lowest up; what a level loses falls to the level below.

    Images of more than ``most_levels`` stay as they are, and :func:`height_failures` names them.

    A level sees what lower ones changed, so the levels are taken in turn: the k-th level of
    every image at once, as many turns as an image has levels.
    """
    from ..storage import shared_out, written

    of = W.partitionBy("image_id")
    up = F.min(F.when(F.col("z") > 0, F.col("z"))).over(of)
    state = written(heights.select(*KEY, "z"), "heights")
    rows = state.count()
    state = shared_out(state, rows, "image_id")
    state = state.withColumn("levels", F.size(F.collect_set(F.when(F.col("z") > 0, F.col("z"))).over(of)))
    state = state.withColumn("level", F.when(F.col("levels") <= most_levels, up)).withColumn("below", F.lit(0.0))
    state = written(state, "heights")
    turns = state.where("level is not null").agg(F.max("levels")).first()[0] or 0
    z, level, kept = F.col("z"), F.col("level"), ("z", "level", "below")
    was = F.coalesce(F.abs(z - level) < 1e-5, F.lit(False))
    for _ in range(turns):
        done = enforce(shared_out(state, rows, "image_id").withColumn("m", was), scale, limits, kept)
        new = F.when(was & ~F.col("m"), F.col("below")).when(~was & F.col("m") & (z < level), level).otherwise(z)
        # no level above has changed yet, so the next one is the least height above this one
        then = F.min(F.when(new > level, new)).over(of)
        state = written(done.select(*KEY, new.alias("z"), then.alias("level"), level.alias("below")), "heights")
    return state.select(*KEY, "z")


def keychain(mask: DataFrame, width_mm: float = 100.0, outer_mm: float = 12.0, hole_mm: float = 5.0) -> DataFrame:
    """The mask with room above, a ring over its middle and a tab down to it; an empty mask stays as it is."""
    size = mask.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.min(F.when(F.col("m"), F.col("x"))).alias("x0"), F.max(F.when(F.col("m"), F.col("x"))).alias("x1"), F.min(F.when(F.col("m"), F.col("y"))).alias("y0"))
    size = size.withColumn("outer", F.greatest(F.lit(3), F.floor(F.lit(outer_mm / 2) * F.col("w") / width_mm))).withColumn("inner", F.greatest(F.lit(2), F.floor(F.lit(hole_mm / 2) * F.col("w") / width_mm)))
    size = size.withColumn("up", F.when(F.col("x0").isNull(), 0).otherwise(F.col("outer") + F.greatest(F.lit(2), F.floor(F.col("outer") / 4)))).withColumn("cx", F.floor((F.col("x0") + F.col("x1")) / 2))
    grid = size.withColumn("y", F.explode(F.expr("sequence(0, cast(h + up - 1 as int))"))).withColumn("x", F.explode(F.expr("sequence(0, w - 1)")))
    old = mask.where("m").select("image_id", F.col("y").alias("oy"), "x", F.lit(True).alias("was"))
    grid = grid.withColumn("oy", (F.col("y") - F.col("up")).cast("int")).join(old, ["image_id", "oy", "x"], "left")
    far = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("up")) * (F.col("y") - F.col("up"))
    tab = F.col("x").between(F.greatest(F.lit(0), F.col("cx") - F.floor(F.col("outer") / 2)), F.least(F.col("w") - 1, F.col("cx") + F.floor(F.col("outer") / 2))) & F.col("y").between(F.col("up"), F.col("up") + F.col("y0") + 2)
    on = F.coalesce("was", F.lit(False))
    m = F.when(F.col("x0").isNull(), on).otherwise((on | (far <= F.col("outer") ** 2) | tab) & ~(far <= F.col("inner") ** 2))
    return grid.select("image_id", "y", "x", m.alias("m"))


def shrink(mask: DataFrame, factor: int) -> DataFrame:
    """Area average over squares of ``factor`` pixels: on where more than half is."""
    cell = lambda c: F.expr(f"cast({c} div {factor} as int)").alias(c)
    return mask.groupBy("image_id", cell("y"), cell("x")).agg((F.avg(F.col("m").cast("int")) > 0.5).alias("m"))


def enlarge(mask: DataFrame, factor: int) -> DataFrame:
    """Bilinear enlargement by a whole factor; on from the value 127 of 255.  Four taps per pixel, by windows."""
    on = mask.select(*KEY, (F.col("m").cast("int") * 255).alias("v"))

    def taps(c: str, w) -> Column:
        return F.array(F.coalesce(F.lag(c).over(w), F.col(c)), F.col(c), F.coalesce(F.lead(c).over(w), F.col(c)))

    offs = [((k + 0.5) / factor - 0.5) for k in range(factor)]
    blend = lambda c, o: F.col(c)[1] * (1 - abs(o)) + (F.col(c)[0] if o < 0 else F.col(c)[2]) * abs(o)
    wide = on.withColumn("t", taps("v", along_rows())).withColumn("cols", F.array(*[blend("t", o) for o in offs]))
    tall = wide.withColumn("t", taps("cols", along_columns()))
    out = [F.array(*[F.col("t")[1][k] * (1 - abs(o)) + F.col("t")[0 if o < 0 else 2][k] * abs(o) for k in range(factor)]) for o in offs]
    rows = tall.select("image_id", "y", "x", F.posexplode(F.array(*out)).alias("j", "line")).select("image_id", "y", "x", "j", F.posexplode("line").alias("i", "v"))
    return rows.select("image_id", (F.col("y") * factor + F.col("j")).cast("int").alias("y"), (F.col("x") * factor + F.col("i")).cast("int").alias("x"), (F.col("v") >= 127).alias("m"))


def cubic_weights(t: float, a: float = -0.75) -> list[float]:
    """Weights of the four taps around a place ``t`` past the second one, by cubic convolution."""

    def near(d: float) -> float:
        return (a + 2) * d**3 - (a + 3) * d**2 + 1

    def far(d: float) -> float:
        return a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a

    return [far(1 + t), near(t), near(1 - t), far(2 - t)]


def enlarge_cubic(gray: DataFrame, factor: int) -> DataFrame:
    """Gray values enlarged by a whole factor with cubic convolution, borders repeated, rounded into 0 to 255."""
    offs = [(k + 0.5) / factor - 0.5 for k in range(factor)]

    def five(c: str, w) -> Column:
        before, after = F.coalesce(F.lag(c).over(w), F.col(c)), F.coalesce(F.lead(c).over(w), F.col(c))
        return F.array(F.coalesce(F.lag(c, 2).over(w), before), before, F.col(c), after, F.coalesce(F.lead(c, 2).over(w), after))

    def blended(o: float, tap) -> Column:
        first, t = (0, o + 1) if o < 0 else (1, o)
        return sum((tap(first + k) * wt for k, wt in enumerate(cubic_weights(t))), F.lit(0.0))

    wide = gray.withColumn("t", five("g", along_rows()))
    wide = wide.withColumn("cols", F.array(*[blended(o, lambda k: F.col("t")[k]) for o in offs]))
    tall = wide.withColumn("t", five("cols", along_columns()))
    lines = [F.array(*[blended(o, lambda k, i=i: F.col("t")[k][i]) for i in range(factor)]) for o in offs]
    rows = tall.select("image_id", "y", "x", F.posexplode(F.array(*lines)).alias("j", "line")).select("image_id", "y", "x", "j", F.posexplode("line").alias("i", "v"))
    g = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.round("v", 6) + 0.5))).cast("int")
    return rows.select("image_id", (F.col("y") * factor + F.col("j")).cast("int").alias("y"), (F.col("x") * factor + F.col("i")).cast("int").alias("x"), g.alias("g"))
