"""Neighbourhood operators as windows over rows, then columns, of a dense grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .masks import KEY

def along_rows():
    return W.partitionBy("image_id", "y").orderBy("x")


def along_columns():
    return W.partitionBy("image_id", "x").orderBy("y")


def square(mask: DataFrame, radius: int, how) -> DataFrame:
    """``how`` over (2 radius + 1)^2 neighbours; pixels outside the image do not count."""
    frame = (-radius, radius)
    first = mask.withColumn("m", how("m").over(along_rows().rowsBetween(*frame)))
    return first.withColumn("m", how("m").over(along_columns().rowsBetween(*frame)))


def erode(mask: DataFrame, radius: int = 1, times: int = 1) -> DataFrame:
    return square(mask, radius * times, F.min)


def dilate(mask: DataFrame, radius: int = 1, times: int = 1) -> DataFrame:
    return square(mask, radius * times, F.max)


def close_open(mask: DataFrame, radius: int = 1) -> DataFrame:
    """Closing, then opening; dealt by image once, which serves the windows of all eight passes."""
    return dilate(erode(erode(dilate(mask.repartition("image_id"), radius), radius), radius), radius)


def _edges(c: str, w) -> tuple[Column, Column]:
    """Neighbours before and after, the pixel itself at the border."""
    return F.coalesce(F.lag(c).over(w), F.col(c)), F.coalesce(F.lead(c).over(w), F.col(c))


def median3(mask: DataFrame) -> DataFrame:
    """3 x 3 median of a mask with repeated borders: at least five of nine."""
    a, b = _edges("m", along_rows())
    first = mask.repartition("image_id").withColumn("s", a.cast("int") + F.col("m").cast("int") + b.cast("int"))
    a, b = _edges("s", along_columns())
    return first.withColumn("m", a + F.col("s") + b >= 5).select(*KEY, "m")


def median3_gray(gray: DataFrame) -> DataFrame:
    """3 x 3 median of gray values with repeated borders."""
    a, b = _edges("g", along_rows())
    first = gray.repartition("image_id").withColumn("row", F.array(a, F.col("g"), b))
    a, b = _edges("row", along_columns())
    return first.withColumn("g", F.sort_array(F.concat(a, F.col("row"), b))[4]).select(*KEY, "g")


def outer_edge(mask: DataFrame) -> DataFrame:
    inner = erode(mask.repartition("image_id").withColumn("was", F.col("m")))
    return inner.select(*KEY, (F.col("was") & ~F.col("m")).alias("m"))


def blur3(gray: DataFrame) -> DataFrame:
    """3 x 3 Gaussian (1 2 1) with mirrored borders, rounded."""

    def mirrored(c: str, w) -> tuple[Column, Column]:
        return F.coalesce(F.lag(c).over(w), F.lead(c).over(w), F.col(c)), F.coalesce(F.lead(c).over(w), F.lag(c).over(w), F.col(c))

    a, b = mirrored("g", along_rows())
    first = gray.repartition("image_id").withColumn("s", a + F.col("g") * 2 + b)
    a, b = mirrored("s", along_columns())
    return first.withColumn("g", F.floor((a + F.col("s") * 2 + b + 8) / 16).cast("int")).select(*KEY, "g")


#: Steps of the 3 x 3 chamfer distance, straight and diagonal.
STRAIGHT, DIAGONAL = 0.955, 1.3693


def distance(mask: DataFrame, limit: int = 16) -> DataFrame:
    """(.., d): chamfer distance of mask pixels to the nearest other pixel, ``limit`` at most; 0 outside the mask.

    Only the rim of the outside can be nearest, and only rims of neighbouring tiles of side
    ``limit`` can be near enough, so the join is on tiles and its size is bounded per pixel.
    """
    seen = dilate(mask.withColumn("was", F.col("m")))
    tile = lambda c: F.floor(F.col(c) / limit).cast("int")
    rim = seen.where("not was and m").select("image_id", F.col("y").alias("ry"), F.col("x").alias("rx"), tile("y").alias("ty"), tile("x").alias("tx"))
    around = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (-1, 0, 1) for i in (-1, 0, 1)]))
    rim = rim.withColumn("o", around).select("image_id", "ry", "rx", (F.col("ty") + F.col("o.j")).alias("ty"), (F.col("tx") + F.col("o.i")).alias("tx"))
    on = mask.where("m").select(*KEY, tile("y").alias("ty"), tile("x").alias("tx"))
    dy, dx = F.abs(F.col("y") - F.col("ry")), F.abs(F.col("x") - F.col("rx"))
    step = (F.greatest(dy, dx) - F.least(dy, dx)) * F.lit(STRAIGHT) + F.least(dy, dx) * F.lit(DIAGONAL)
    near = on.join(rim, ["image_id", "ty", "tx"]).groupBy(*KEY).agg(F.min(step).alias("d"))
    return mask.join(near, KEY, "left").select(*KEY, "m", F.when(F.col("m"), F.least(F.coalesce("d", F.lit(float(limit))), F.lit(float(limit)))).otherwise(0.0).alias("d"))


def full_distance(mask: DataFrame, limit: int = 16) -> DataFrame:
    """As :func:`distance`, without the cap; only images that are all mask have no distance and keep ``limit``.

    Pixels still at the limit meet, for each row of their column within a tile's reach, the
    nearest outside pixel of that row; the tiles double until no pixel is left.  Rows beyond
    side are farther than STRAIGHT (side + 1), so distances up to that are final.
    """
    from ..storage import written

    known = written(distance(mask, limit), "distance")
    tall = known.groupBy("image_id").agg((F.max("y") - F.min("y") + 1).alias("tall"), F.min("m").alias("full")).where("not full")
    left = written(known.where(F.col("m") & (F.col("d") >= limit)).join(tall, "image_id").select(*KEY, "tall"), "far")
    before = F.max(F.when(~F.col("m"), F.col("x"))).over(along_rows().rowsBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(~F.col("m"), F.col("x"))).over(along_rows().rowsBetween(0, W.unboundedFollowing))
    row = known.select("image_id", F.col("y").alias("ry"), "x", F.least(F.col("x") - before, after - F.col("x")).alias("dx")).where("dx is not null")
    side, far = limit, None
    while left.limit(1).count():
        side *= 2
        tile = lambda c: F.floor(F.col(c) / side).cast("int")  # noqa: B023, E731
        rows = row.withColumn("ty", F.explode(F.array(*[tile("ry") + j for j in (-1, 0, 1)])))
        dy = F.abs(F.col("y") - F.col("ry"))
        step = (F.greatest(dy, F.col("dx")) - F.least(dy, F.col("dx"))) * F.lit(STRAIGHT) + F.least(dy, F.col("dx")) * F.lit(DIAGONAL)
        met = left.withColumn("ty", tile("y")).join(rows, ["image_id", "x", "ty"]).groupBy(*KEY, "tall").agg(F.min(step).alias("far"))
        met = written(met.where((F.col("far") <= STRAIGHT * (side + 1)) | (F.col("tall") <= side)).select(*KEY, "far"), "far")
        far = met if far is None else far.unionByName(met)
        left = written(left.join(met, KEY, "left_anti"), "far")
    return known if far is None else known.join(far, KEY, "left").select(*KEY, "m", F.coalesce("far", "d").alias("d"))


def diagonal_contacts(mask: DataFrame) -> DataFrame:
    """(image_id, y, x, falling): 2 x 2 blocks, by upper left pixel, with exactly two pixels that touch at a corner."""
    right = F.lead("m").over(along_rows())
    a = mask.withColumn("mr", right)
    b = a.withColumn("md", F.lead("m").over(along_columns())).withColumn("mdr", F.lead("mr").over(along_columns()))
    falling = F.col("m") & F.col("mdr") & ~F.col("mr") & ~F.col("md")
    rising = ~F.col("m") & ~F.col("mdr") & F.col("mr") & F.col("md")
    return b.where("mdr is not null").where(falling | rising).select(*KEY, falling.alias("falling"))


def _marked_contacts(mask: DataFrame) -> DataFrame:
    """Adds ``fill``, whether a contact picks the pixel, and ``contact``, whether one begins here; other columns stay.

    Two windows on rows and two on columns, so a mask dealt by image is not sent again.
    """
    row, col = along_rows(), along_columns()
    n = F.coalesce(F.col("m"), F.lit(False)).cast("int")
    a = mask.withColumns({"mr_": F.lead("m").over(row), "s_": F.sum(n).over(row.rowsBetween(-1, 1)), "sr_": F.sum(n).over(row.rowsBetween(0, 2))})
    a = a.withColumns({
        "md_": F.lead("m").over(col), "mdr_": F.lead("mr_").over(col), "na_": F.sum("s_").over(col.rowsBetween(-1, 1)) - n, "nb_": F.sum("sr_").over(col.rowsBetween(-1, 1)) - F.col("mr_").cast("int"),
        "nc_": F.sum("s_").over(col.rowsBetween(0, 2)) - F.lead("m").over(col).cast("int"), "nd_": F.sum("sr_").over(col.rowsBetween(0, 2)) - F.lead("mr_").over(col).cast("int"),
    })
    m, mr, md, mdr = F.col("m"), F.col("mr_"), F.col("md_"), F.col("mdr_")
    falling, rising = (F.coalesce(c, F.lit(False)) for c in (m & mdr & ~mr & ~md, ~m & ~mdr & mr & md))
    right, own = falling & (F.col("nb_") >= F.col("nc_")), rising & (F.col("na_") >= F.col("nd_"))
    a = a.select(*mask.columns, (falling | rising).alias("contact"), own.alias("f0_"), right.alias("f1_"), (falling & ~right).alias("f2_"), (rising & ~own).alias("f3_"))
    back = lambda c, w: F.coalesce(F.lag(c).over(w), F.lit(False))
    a = a.withColumns({"f0_": F.col("f0_") | back("f1_", row), "f2_": F.col("f2_") | back("f3_", row)})
    return a.select(*mask.columns, "contact", (F.col("f0_") | back("f2_", col)).alias("fill"))


def resolve_contacts_once(mask: DataFrame) -> DataFrame:
    """Fills, for each diagonal contact, the empty pixel with more neighbours, the upper one where alike; one pass."""
    return _marked_contacts(mask.select(*KEY, "m").repartition("image_id")).select(*KEY, (F.col("m") | F.col("fill")).alias("m"))


def resolve_contacts(mask: DataFrame, passes: int = 64) -> DataFrame:
    """Passes until no diagonal contact is left, ``passes`` at most; other columns stay.

    An image without contacts is settled, so each pass takes only the others.
    """
    from ..storage import shared_out, written

    settled, m = [], (F.col("m") | F.col("fill")).alias("m")
    rows = mask.count()
    for _ in range(passes):
        once = _marked_contacts(shared_out(mask, rows, "image_id"))
        once = once.select(*[m if c == "m" else c for c in mask.columns], F.max("contact").over(W.partitionBy("image_id")).alias("contact"))
        once = written(once, "contacts")
        settled.append(once.where("not contact").select(*mask.columns))
        mask = once.where("contact").select(*mask.columns)
        rows = mask.count()
        if not rows:
            break
    else:
        settled.append(mask)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def repair_levels(heights: DataFrame, passes: int = 64) -> DataFrame:
    """(image_id, y, x, h): diagonal contacts of what reaches a level are filled at that level, from the lowest level up; other columns stay.

    Filled pixels count for the levels above.  Images take their levels in step, the k-th of each at a time.
    """
    from ..storage import shared_out, written

    of, h, level = W.partitionBy("image_id"), F.col("h"), F.col("level")
    state = written(shared_out(heights, heights.count(), "image_id").withColumn("level", F.min(F.when(h > 0, h)).over(of)), "level-heights")
    rows = state.count()
    while state.where("level is not null").limit(1).count():
        # images without a further level have no mask, so no contact either
        filled = resolve_contacts(state.withColumn("m", F.coalesce(h >= level, F.lit(False))), passes)
        new = F.when(F.col("m") & (h < level), level).otherwise(h)
        # levels above are as they came, so the next one is the least height above this one
        then = F.min(F.when(new > level, new)).over(of)
        state = written(shared_out(filled, rows, "image_id").select(*[new.alias("h") if c == "h" else c for c in heights.columns], then.alias("level")), "level-heights")
    return state.select(*heights.columns)
