"""Distances, cells and interpolation on the bed, in millimetres."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.operators import zones as Z
from canopia.sources.shared import cut


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """q39 to q41: pairs of rows (id, x, y, ...) closer than radius; columns of right get the prefix `o_`.

    Both sides are dealt to square cells of the radius; the right side goes to
    its cell and the eight around it, so the join is an equi-join. It is dealt
    out after that, so that its ninefold size is known before one is broadcast.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    other = right.select([F.col(c).alias(f"o_{c}") for c in right.columns]).withColumn("_d", around)
    other = other.select("*", (cell("o_x") + F.col("_d.i")).alias("_cx"), (cell("o_y") + F.col("_d.j")).alias("_cy")).drop("_d").repartition("_cx", "_cy")
    pairs = left.withColumns({"_cx": cell("x"), "_cy": cell("y")}).join(other, ["_cx", "_cy"]).drop("_cx", "_cy")
    return pairs.withColumn("distance", F.sqrt((F.col("x") - F.col("o_x")) * (F.col("x") - F.col("o_x")) + (F.col("y") - F.col("o_y")) * (F.col("y") - F.col("o_y")))).where(F.col("distance") <= radius)


def linked(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """q41: (id, o_id) of all pairs of rows (id, x, y) closer than radius.

    Distances are taken between distinct places only; a pair of places then meets
    its rows on each side, so the work beyond the places is the output's.
    """
    near = within(left.select("x", "y").distinct(), right.select("x", "y").distinct(), radius)
    mine = left.select("id", "x", "y").join(near, ["x", "y"]).select("id", "o_x", "o_y")
    return mine.join(right.select(F.col("id").alias("o_id"), F.col("x").alias("o_x"), F.col("y").alias("o_y")).hint("merge"), ["o_x", "o_y"]).select("id", "o_id")


def nearest_edges(places: DataFrame, obstacles: DataFrame, first: float = 400.0) -> DataFrame:
    """(id, edge): how far the nearest edge of an obstacle (x, y, radius) lies from each place; places without any are left out.

    The search doubles its reach, and only places go on whose nearest edge so
    far might be beaten by the widest obstacle out of reach; it ends when all is
    settled or the reach spans everything. Places that coincide are one, and so
    are obstacles, of which the widest counts.
    """
    bounds = [F.min("x"), F.max("x"), F.min("y"), F.max("y")]
    extent = places.select("x", "y").unionByName(obstacles.select("x", "y")).agg(*bounds).first()
    widest = obstacles.agg(F.max("radius")).first()[0]
    if widest is None or extent[0] is None:
        return places.select("id", F.lit(None).cast("double").alias("edge")).limit(0)
    span = math.hypot(extent[1] - extent[0], extent[3] - extent[2])
    discs = cut(obstacles.groupBy("x", "y").agg(F.max("radius").alias("radius")))
    rest, reach, found = cut(places.select("x", "y").distinct()), first, None
    while True:
        near = within(rest, discs, reach).groupBy("x", "y").agg(F.min(F.col("distance") - F.col("o_radius")).alias("edge"))
        near = cut(near if reach >= span else near.where(F.col("edge") <= reach - widest))
        found = near if found is None else found.unionByName(near)
        if reach >= span:
            break
        rest = cut(rest.join(near, ["x", "y"], "left_anti"))
        if rest.isEmpty():
            break
        reach *= 2
    return places.select("id", "x", "y").join(found, ["x", "y"]).groupBy("id").agg(F.min("edge").alias("edge"))


def clearance(places: DataFrame, obstacles: DataFrame, baseline: float, zones: list | None = None, first: float = 400.0) -> DataFrame:
    """pln10: per place (id, x, y) the clear soil around the stereo pair's reach of two baselines: -1 where that is blocked, 10,000 without obstacles.

    With zones, the margin is halved in on 24 times until it just fits them.
    """
    reach = 2 * baseline
    margins = places.select("id", "x", "y").join(nearest_edges(places, obstacles, first), "id", "left").withColumn("limit", F.coalesce(F.col("edge") - reach, F.lit(10_000.0)))
    blocked, margin = F.col("limit") < 0, F.col("limit")
    if zones:
        fits = lambda r: Z.evaluate(zones, "centers", F.col("x"), F.col("y"), r)["allowed"]
        start = F.struct(F.lit(0.0).alias("low"), F.least(F.lit(10_000.0), F.col("limit")).alias("high"))

        def halve(acc, _):
            middle = (acc["low"] + acc["high"]) / 2
            inside = fits(middle + reach)
            return F.struct(F.when(inside, middle).otherwise(acc["low"]).alias("low"), F.when(inside, acc["high"]).otherwise(middle).alias("high"))

        blocked = blocked | ~fits(F.lit(reach))
        margin = F.when(fits(start["high"] + reach), start["high"]).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, halve, lambda acc: acc["low"]))
    return margins.select("id", F.when(blocked, -1.0).otherwise(margin).alias("margin_mm"))


def grid_cells(images: DataFrame, dx: float = 373.0, dy: float = 294.0) -> DataFrame:
    """Processed images of each cell of the capture grid."""
    cell = lambda c, d: F.floor(F.col(c) / d + 0.5).cast("long")
    return images.where("processed").groupBy(cell("x", dx).alias("cell_x"), cell("y", dy).alias("cell_y")).agg(F.count("*").alias("images"), F.max("created_at").alias("newest"))


def wilson_lower(successes, trials, z: float = 1.2816):
    """fn17: one-sided lower bound of a share; 0 without trials. Takes and returns Columns."""
    n, p = trials.cast("double"), successes / trials.cast("double")
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(trials <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), bound))


HALF_LIFE = math.log(2)


def recency(days, half_life: float = 14.0):
    """fn11: weight of an observation of that age."""
    return F.exp(F.lit(-HALF_LIFE) * days / half_life)


def obstacles(plants: DataFrame, weeds: DataFrame, least_radius: float = 15.0, least_age: int = 10) -> DataFrame:
    """set3: plants that are large and old enough (or of unknown age), and all weeds."""
    grown = plants.where((F.col("radius") >= least_radius) & (F.col("age_days").isNull() | (F.col("age_days") >= least_age)))
    columns = ["id", "x", "y", "radius"]
    return grown.select(F.lit("plant").alias("kind"), *columns).unionByName(weeds.select(F.lit("weed").alias("kind"), *columns))


def missing_cells(cells: DataFrame) -> DataFrame:
    """set5: cells of the product of the grid's axes that hold no image; cells has cell_x and cell_y, one row a cell."""
    xs, ys = cells.select("cell_x").distinct(), cells.select("cell_y").distinct()
    return xs.crossJoin(ys).join(cells, ["cell_x", "cell_y"], "left_anti")  # the axes are a few values each


def neighbour_cells(cells: DataFrame) -> DataFrame:
    """q45: pairs of cells at Manhattan distance 1."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    moved = cells.select("cell_x", "cell_y", steps.alias("d")).select("cell_x", "cell_y", (F.col("cell_x") + F.col("d.i")).alias("o_cell_x"), (F.col("cell_y") + F.col("d.j")).alias("o_cell_y"))
    return moved.join(cells.select(F.col("cell_x").alias("o_cell_x"), F.col("cell_y").alias("o_cell_y")), ["o_cell_x", "o_cell_y"])


def reach_pairs(points: DataFrame, discs: DataFrame, widest: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a point's id and a disc (x, y, reach) that holds it, with reach, gap, their distance, and the disc's tag, if it has one; of equal `by` only.

    Pairs are found in cells of side `widest`; a disc that reaches further is
    joined in cells of the next power of two, so no link is lost. Discs are dealt
    out when their cells are known, so that their ninefold size decides the join.
    """
    level = F.when(F.col("reach") <= widest, 0).otherwise(F.ceil(F.log2(F.col("reach") / widest))).cast("int")
    tag = [c for c in discs.columns if c == "tag"]
    marked = discs.where("reach >= 0").select("x", "y", "reach", *tag, *by, level.alias("level"))
    levels = marked.select("level").distinct()  # a few values: sizes double from one to the next
    left = points.select("id", "x", "y", *by).crossJoin(F.broadcast(levels))
    side = F.lit(widest) * F.pow(F.lit(2.0), F.col("level"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("d")
    right = marked.select(F.col("x").alias("o_x"), F.col("y").alias("o_y"), "reach", "level", *tag, *by, steps)
    right = right.select("o_x", "o_y", "reach", "level", *tag, *by, (F.floor(F.col("o_x") / side) + F.col("d.i")).alias("_cx"), (F.floor(F.col("o_y") / side) + F.col("d.j")).alias("_cy"))
    right = right.repartition("level", "_cx", "_cy", *by)
    left = left.select("*", F.floor(F.col("x") / side).alias("_cx"), F.floor(F.col("y") / side).alias("_cy"))
    gap = F.sqrt((F.col("x") - F.col("o_x")) * (F.col("x") - F.col("o_x")) + (F.col("y") - F.col("o_y")) * (F.col("y") - F.col("o_y")))
    return left.join(right, ["level", "_cx", "_cy", *by]).select("id", *by, "reach", *tag, gap.alias("gap")).where("gap <= reach")


def reached(points: DataFrame, discs: DataFrame, widest: float, strict: bool = False) -> DataFrame:
    """Ids of points (id, x, y) within a disc (x, y, reach); strict leaves the rim out."""
    pairs = reach_pairs(points, discs, widest)
    return (pairs.where("gap < reach") if strict else pairs).select("id").distinct()


def near_detection(points: DataFrame, detections: DataFrame, standing: tuple[str, ...], judged: tuple[str, ...], least: float = 20.0, hours: float = 24.0) -> DataFrame:
    """q39, q40: points (id, x, y, image_id, image_timestamp) that a detection stands for.

    One of a standing status counts within `least`; if it is `created`, up to
    `hours` before the point's image. A judged one counts for its own image only,
    within max(least, 1.5 times its radius). Of detections that coincide the
    newest created one and the widest judged one speak for all, and points of
    one place (and image) are asked once.
    """
    created = F.col("status") == "created"
    spots = detections.where(F.col("status").isin(*standing)).groupBy("x", "y").agg(F.max(F.when(created, F.col("image_timestamp"))).alias("newest"), F.bool_or(~created).alias("lasting"))
    near = within(points.select("x", "y").distinct(), spots, least).groupBy("x", "y").agg(F.max("o_newest").alias("_newest"), F.bool_or("o_lasting").alias("_lasting"))
    discs = detections.where(F.col("status").isin(*judged)).groupBy("image_id", "x", "y").agg(F.greatest(F.lit(least), 1.5 * F.coalesce(F.max("radius_mm"), F.lit(0.0))).alias("reach"))
    seen = points.select("image_id", "x", "y").distinct().withColumn("id", F.struct("x", "y"))
    own = reach_pairs(seen, discs, 2.5 * least, ("image_id",)).select("image_id", "id.x", "id.y").distinct().withColumn("_own", F.lit(True))
    age = (F.col("image_timestamp").cast("double") - F.col("_newest").cast("double")) / 3600
    marked = points.join(near, ["x", "y"], "left").join(own, ["image_id", "x", "y"], "left")
    return marked.where(F.col("_own") | F.col("_lasting") | (age <= hours)).select(points.columns)
