"""Unique assignments that depend on earlier ones, in rounds: each round settles every choice that no open one can change."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.operators import geometry, runs
from canopia.operators import zones as Z
from canopia.sources.shared import cut


def greedy_pairs(pairs: DataFrame, left: str, right: str, order: list[str]) -> DataFrame:
    """Pairs taken one by one by rising `order` while neither side is taken.

    A pair that is the first left of both its sides is taken whatever happens
    elsewhere, so a round takes all of those and drops what they block. The
    order must be total; its last columns may be the sides themselves. A round
    deals the open pairs by one side and then by the other; no task holds all.
    """
    key, columns = F.struct(*order), pairs.columns
    open_, taken = pairs, None
    while True:
        first = [F.min(key).over(W.partitionBy(side)) for side in (left, right)]
        marked = cut(open_.withColumns({"_left": key == first[0], "_right": key == first[1]}))
        won = marked.where("_left AND _right").select(columns)
        taken = won if taken is None else taken.unionByName(won)
        if won.isEmpty():
            return taken
        # estimates made before rows were multiplied would broadcast them: joins here are merged
        open_ = marked.select(columns).join(won.select(left).hint("merge"), left, "left_anti").join(won.select(right).hint("merge"), right, "left_anti")


def in_turn(options: DataFrame, agent: str, turn: str, item: str, rank: list[str]) -> DataFrame:
    """One option an agent: by rising `turn` each agent takes its first option by `rank` whose item is left.

    An item that no open agent with an earlier turn wants is safe: its agent
    takes it or a better one, so a round drops what is worse, which makes items
    of others safe. Where the best one is safe, the agent settles. Turns differ
    between agents.
    """
    key, columns = F.struct(*rank), options.columns
    open_, taken = options, None
    by_item, by_agent = W.partitionBy(item), W.partitionBy(agent)
    while True:
        free = open_.withColumn("_free", F.col(turn) == F.min(turn).over(by_item))
        safe = F.min(F.when(F.col("_free"), key)).over(by_agent)
        marked = cut(free.withColumns({"_safe": safe, "_best": F.min(key).over(by_agent)}))
        settled = F.coalesce(F.col("_safe") == F.col("_best"), F.lit(False))
        won = marked.where(settled & (key == F.col("_best"))).select(columns)
        taken = won if taken is None else taken.unionByName(won)
        if won.isEmpty():
            return taken
        rest = marked.where(~settled & (F.col("_safe").isNull() | (key <= F.col("_safe")))).select(columns)
        open_ = rest.join(won.select(item), item, "left_anti")


def _clear(sites: DataFrame, obstacles: DataFrame, zones: list, margin: float) -> DataFrame:
    """(x, y, clearance_mm) of the distinct sites whose margin meets no obstacle and is allowed by the zones; 10,000 without obstacles."""
    places = sites.select("x", "y").distinct().withColumn("id", F.xxhash64("x", "y"))
    if zones:
        places = places.where(Z.evaluate(zones, "centers", F.col("x"), F.col("y"), F.lit(margin))["allowed"])
    places = cut(places)
    near = geometry.nearest_edges(places, obstacles)
    found = places.join(near.hint("merge"), "id", "left").withColumn("clearance_mm", F.coalesce(F.col("edge") - margin, F.lit(10_000.0)))
    return found.where(F.col("clearance_mm") >= 0).select("x", "y", "clearance_mm")


#: The distances in millimetres between which options are made together, up to the reach of candidates.
BANDS = (0.0, 25.0, 50.0, 100.0, 200.0)


def safe_sites(points: DataFrame, obstacles: DataFrame, zones: list, bed: tuple[float, float, float, float], baseline: float, margin: float, cutoff: Column | None = None) -> DataFrame:
    """pln7: per soil point (id, x, y, updated_at) the nearest clear capture site, no site twice: id, site_x, site_y, distance_mm, clearance_mm.

    Points without a date, or measured at the cutoff or later, are left alone.
    Among all pairs the nearest goes first, ties by point, then x and y. So what
    is nearer than a distance is settled before any option beyond it is made, and
    only points that are left, and sites that are, go on to the next band.
    """
    old = points.where(F.col("updated_at").isNotNull() & (F.lit(True) if cutoff is None else F.col("updated_at") < cutoff))
    reach = margin + 2 * baseline
    site = F.struct(F.rint(F.col("x") * 1000), F.rint(F.col("y") * 1000))
    left, taken = cut(old.select("id", "x", "y")), None
    for low, high in zip(BANDS, BANDS[1:], strict=False):
        options = runs.soil_candidates(left, bed, baseline, reach=high, least=low)
        options = options.join(_clear(options, obstacles, zones, reach).hint("merge"), ["x", "y"])
        places = options.select("id", F.col("x").alias("site_x"), F.col("y").alias("site_y"), "distance_mm", "clearance_mm", site.alias("site"))
        if taken is not None:
            places = places.join(taken.select("site").hint("merge"), "site", "left_anti")
        won = greedy_pairs(places, "id", "site", ["distance_mm", "id", "site_x", "site_y"])
        taken = won if taken is None else taken.unionByName(won)
        left = cut(left.join(won.select("id").hint("merge"), "id", "left_anti"))
    return taken.drop("site")


def axis_grid(spacing: float, low: float, high: float) -> list[float]:
    """Places half a spacing from zero and every spacing on, within the bounds."""
    return [v for v in (spacing * (k + 0.5) for k in range(max(0, math.floor(high / spacing + 0.5)))) if low <= v <= high]


#: How far a soil point may be from its grid place or site, and the most places of a plan.
MOST_MOVE, MOST_PLACES = 200.0, 10_000


def measurement_grid(
    points: DataFrame, obstacles: DataFrame, zones: list, bed: tuple[float, float, float, float], spacing: float, deviation: float, baseline: float, margin: float, cutoff: Column | None = None
) -> DataFrame:
    """pln8: a row per grid place: grid_x, grid_y, point_id, site_x, site_y, deviation_mm, clearance_mm, status, reason, hint_mm.

    Row by row each place takes the nearest soil point left within MOST_MOVE, by
    id if equally near, then the nearest clear site left within the deviation.
    status is clear, replaced or skipped; reason says why one is skipped: no
    point, no date, recent, deviation (hint_mm: the least that would do), margin
    (hint_mm: the largest that would do) or blocked.
    """
    if not 50 <= spacing <= 5000 or not 0 <= deviation < MOST_MOVE or baseline <= 0 or margin < 0:
        raise ValueError("spacing from 50 to 5000, deviation from 0 to below 200, a positive baseline and no negative margin")
    xs, ys = axis_grid(spacing, bed[0], bed[2]), axis_grid(spacing, bed[1], bed[3])
    if len(xs) * len(ys) > MOST_PLACES:
        raise ValueError(f"more than {MOST_PLACES} grid places")
    spark = points.sparkSession
    # a plan's places are at most MOST_PLACES
    grid = spark.createDataFrame([(k * len(xs) + i, x, y) for k, y in enumerate(ys) for i, x in enumerate(xs)], "turn long, x double, y double")
    about = points.where(F.col("x").between(bed[0] - MOST_MOVE, bed[2] + MOST_MOVE) & F.col("y").between(bed[1] - MOST_MOVE, bed[3] + MOST_MOVE))
    near = geometry.within(grid.select(F.col("turn").alias("id"), "x", "y"), about.select("id", "x", "y", "updated_at"), MOST_MOVE).where(F.col("distance") < MOST_MOVE)
    near = near.select(F.col("id").alias("turn"), F.col("o_id").alias("point_id"), "distance", F.col("o_x").alias("px"), F.col("o_y").alias("py"), F.col("o_updated_at").alias("updated_at"))
    anchors = in_turn(near, "turn", "turn", "point_id", ["distance", "point_id"])
    held = cut(grid.join(anchors.drop("distance"), "turn", "left"))
    recent = F.lit(False) if cutoff is None else F.col("updated_at") >= cutoff
    early = F.when(F.col("point_id").isNull(), "no point").when(F.col("updated_at").isNull(), "no date").when(recent, "recent")
    held = held.withColumn("early", early)
    sites = runs.soil_candidates(held.where("early IS NULL").select(F.col("turn").alias("id"), "x", "y"), bed, baseline)
    sites = sites.withColumnRenamed("id", "turn").join(held.select("turn", "px", "py", F.col("x").alias("gx"), F.col("y").alias("gy")), "turn")
    sites = sites.where(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) < MOST_MOVE)
    site = F.struct(F.rint(F.col("x") * 1000), F.rint(F.col("y") * 1000))
    # among equally near sites the one along an axis first, then as the lattice is walked
    walk = F.abs(F.col("x") - F.col("gx")) + F.abs(F.col("y") - F.col("gy"))
    places = sites.select("x", "y").distinct().withColumn("id", F.xxhash64("x", "y"))
    room = geometry.clearance(places, obstacles, baseline, zones or None)
    sites = cut(sites.join(places.join(room, "id").select("x", "y", "margin_mm"), ["x", "y"]).select("turn", "x", "y", "distance_mm", F.round(walk, 6).alias("walk"), "margin_mm", site.alias("site")))
    fits = sites.where(F.col("margin_mm") + 1e-6 >= margin)
    allowed = fits.where(F.col("distance_mm") <= deviation + 1e-6)
    chosen = in_turn(allowed, "turn", "turn", "site", ["distance_mm", "walk", "x", "y"])
    chosen = cut(chosen.select("turn", F.col("x").alias("site_x"), F.col("y").alias("site_y"), F.col("distance_mm").alias("deviation_mm"), (F.col("margin_mm") - margin).alias("clearance_mm"), "site"))
    # a place that is skipped sees the sites taken before its turn
    used = chosen.select("site", F.col("turn").alias("taker"))
    left = fits.join(used, "site", "left").where(F.col("taker").isNull() | (F.col("taker") >= F.col("turn"))).groupBy("turn").agg(F.min("distance_mm").alias("nearest"))
    best = sites.where((F.col("distance_mm") <= deviation + 1e-6) & (F.col("margin_mm") >= 0)).groupBy("turn").agg(F.max("margin_mm").alias("roomiest"))
    rows = held.join(chosen.drop("site"), "turn", "left").join(left, "turn", "left").join(best, "turn", "left")
    found = F.col("early").isNull() & F.col("site_x").isNotNull()
    status = F.when(found, F.when(F.col("deviation_mm") < 0.001, "clear").otherwise("replaced")).otherwise("skipped")
    late = F.when(F.col("nearest").isNotNull(), "deviation").when(F.col("roomiest").isNotNull(), "margin").otherwise("blocked")
    hint = F.when(F.col("nearest").isNotNull(), F.ceil("nearest")).when(F.col("roomiest").isNotNull(), F.floor("roomiest"))
    skipped = ~found & F.col("early").isNull()
    return rows.select(
        F.col("x").alias("grid_x"), F.col("y").alias("grid_y"), "point_id", "site_x", "site_y", "deviation_mm", F.greatest(F.lit(0.0), F.col("clearance_mm")).alias("clearance_mm"), status.alias("status"),
        F.when(~found, F.coalesce("early", late)).alias("reason"), F.when(skipped, hint).cast("long").alias("hint_mm"),
    )
