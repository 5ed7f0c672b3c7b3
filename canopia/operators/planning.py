"""Soil heights between samples, capture grids, clear places, scouting."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.operators import folds, geometry


def soil_samples(points: DataFrame, soil: DataFrame, since: str) -> DataFrame:
    """set2: fresh valid or applied measurements, and points that none of them measured."""
    used = soil.where("status IN ('valid', 'applied') AND proposed_z_mm IS NOT NULL").where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    measured = used.select(F.concat(F.lit("m"), F.col("measurement_id").cast("string")).alias("sample"), F.col("capture_x").alias("x"), F.col("capture_y").alias("y"), F.col("proposed_z_mm").alias("z"))
    rest = points.join(used.select(F.col("point_id").alias("id")).distinct(), "id", "left_anti")
    return measured.unionByName(rest.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("sample"), "x", "y", "z"))


def soil_height(places: DataFrame, samples: DataFrame, reach: float = 500.0) -> DataFrame:
    """pln1: id, z, samples, nearest_mm, spread_mm and method per place (id, x, y) with a sample (x, y, z) within reach.

    Inverse squared distance, not under 1 mm; a sample closer than half a
    millimetre wins outright. Moments are summed about the nearest sample's
    height, so the spread does not cancel. Samples that coincide go as one, with
    their number, mean and variance, and places that coincide are asked once.
    """
    heights = samples.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count("*").alias("n"), F.count("z").alias("known"), F.min("z").alias("low"), F.avg("z").alias("mean"), F.var_pop("z").alias("bend"))
    near = geometry.within(places.select("x", "y").distinct(), heights, reach)
    w = 1 / F.pow(F.greatest(F.col("distance"), F.lit(1.0)), F.lit(2.0))
    base = F.min_by("o_low", F.struct("distance", "o_low")).over(W.partitionBy("x", "y"))
    near = near.withColumns({"w": w, "base": base}).withColumn("dz", F.col("o_mean") - F.col("base"))
    known = F.col("w") * F.col("o_known")
    sums = near.groupBy("x", "y").agg(F.sum("o_n").alias("samples"), F.min("distance").alias("nearest_mm"), F.first("base").alias("base"), F.sum(F.col("w") * F.col("o_n")).alias("w"), F.sum(known * F.col("dz")).alias("wz"), F.sum(known * (F.col("dz") * F.col("dz") + F.col("o_bend"))).alias("wzz"))
    sums = places.select("id", "x", "y").join(sums, ["x", "y"])
    exact = F.col("nearest_mm") < 0.5
    mean = F.col("wz") / F.col("w")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("wzz") / F.col("w") - mean * mean))
    method = F.when(exact, "exact").when(F.col("samples") > 1, "interpolated").otherwise("nearest")
    return sums.select("id", F.when(exact, F.col("base")).otherwise(F.col("base") + mean).alias("z"), F.when(exact, 1).otherwise(F.col("samples")).cast("long").alias("samples"), "nearest_mm", F.when(exact, 0.0).otherwise(spread).alias("spread_mm"), method.alias("method"))


def _centres(span, frame, overlap: float):
    count = F.when(frame >= span, 1).otherwise(F.greatest(F.lit(2), F.ceil((span - frame) / (frame * (1 - overlap))) + 1)).cast("int")
    step = F.when(count > 1, (span - frame) / F.greatest(F.lit(1), count - 1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(k.alias("k"), F.round(F.when(count == 1, span / 2).otherwise(frame / 2 + step * k), 3).alias("at"))), count


def capture_grid(beds: DataFrame, overlap: float = 0.15) -> DataFrame:
    """grd1: per bed (bed_id, width_mm, depth_mm, frame_x, frame_y) its capture cells on a serpentine path.

    Rows and columns spread evenly with at least that overlap; a bed smaller
    than the frame has one. Map-only: cells are generated from their bed's row.
    """
    xs, columns = _centres(F.col("width_mm"), F.col("frame_x"), overlap)
    ys, _ = _centres(F.col("depth_mm"), F.col("frame_y"), overlap)
    cells = beds.select("bed_id", columns.alias("columns"), F.explode(ys).alias("r"), xs.alias("xs")).select("bed_id", "columns", "r", F.explode("xs").alias("c"))
    back = F.col("r.k") % 2 == 1
    index = F.col("r.k") * F.col("columns") + F.when(back, F.col("columns") - 1 - F.col("c.k")).otherwise(F.col("c.k"))
    return cells.select("bed_id", index.alias("index"), F.col("r.k").alias("row"), F.col("c.k").alias("column"), F.col("c.at").alias("x"), F.col("r.at").alias("y"))


def cell_bounds(cells: DataFrame, beds: DataFrame) -> DataFrame:
    """grd2: the rectangle of each cell: half-way to its neighbours, or to the bed's border."""

    def axis(label, at, span, low, high):
        means = cells.groupBy("bed_id", label).agg(F.avg(at).alias("_m"))
        by = W.partitionBy("bed_id").orderBy(label)
        around = means.withColumns({"_a": F.lag("_m").over(by), "_b": F.lead("_m").over(by)}).join(beds.select("bed_id", span), "bed_id")
        left = F.greatest(F.lit(0.0), F.coalesce((F.col("_a") + F.col("_m")) / 2, F.lit(0.0)))
        right = F.least(F.col(span), F.coalesce((F.col("_m") + F.col("_b")) / 2, F.col(span)))
        return around.select("bed_id", label, left.alias(low), right.alias(high))

    columns, rows = axis("column", "x", "width_mm", "x0", "x1"), axis("row", "y", "depth_mm", "y0", "y1")
    return cells.join(columns, ["bed_id", "column"]).join(rows, ["bed_id", "row"])


def axis_groups(rows: DataFrame, key: str, value: str, tolerance: float = 25.0) -> DataFrame:
    """win7: per key the means of runs of sorted values, each within the tolerance of the running mean before it.

    Equal values never part, so the distinct values of a key are gone through in
    order with the last run's sum and number as the only state.
    """
    seen = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))

    def ended(state):
        return ((state["sum"] / state["n"], state["n"]),) if state["n"] else ()

    def step(state, row):
        done = ()
        if state["n"] and abs(row["v"] - state["sum"] / state["n"]) > tolerance:
            done = ended(state)
            state["sum"], state["n"] = 0.0, 0
        state["sum"] += row["v"] * row["n"]
        state["n"] += row["n"]
        return done

    return folds.carried(seen, key, ["v"], lambda: {"sum": 0.0, "n": 0}, step, "position double, members long", ended)


def measurement_target(places: DataFrame, points: DataFrame, reach: float = 200.0) -> DataFrame:
    """pln11: per place (id, x, y) the nearest point closer than reach and its distance, or point 0."""
    spots = points.groupBy("x", "y").agg(F.min("id").alias("id"))  # of points that coincide the smallest id wins
    near = geometry.within(places.select("x", "y").distinct(), spots, reach).where(F.col("distance") < reach)
    best = near.groupBy("x", "y").agg(F.min(F.struct("distance", "o_id")).alias("b"))
    return places.select("id", "x", "y").join(best, ["x", "y"], "left").select("id", F.coalesce("b.o_id", F.lit(0)).alias("point_id"), F.coalesce("b.distance", F.lit(0.0)).alias("moved_mm"))


def clear_site(weeds: DataFrame, obstacles: DataFrame, anchors: DataFrame, bed: tuple[float, float], clear: float = 75.0, reach: float = 200.0) -> DataFrame:
    """pln12: per weed (id, x, y) a place on 11 rings of 24 that lies on the bed, outside every obstacle's disc and
    clear zone, and closer than reach to an anchor: innermost ring, largest clearance, smallest angle.

    The weed is one of the obstacles, so a clearance is at most its ring; only
    obstacles that near can matter and are joined. Weeds that coincide are
    settled once, by their smallest id; of obstacles that coincide the widest
    counts, of anchors the one of the smallest id.
    """
    every = weeds.select(F.col("id").cast("long").alias("own_id"), "x", "y")
    first = every.groupBy("x", "y").agg(F.min("own_id").alias("weed_id"))
    rings = F.explode(F.sequence(F.lit(75), F.lit(325), F.lit(25)))
    spots = first.select("weed_id", "x", "y", rings.alias("ring")).select("*", F.explode(F.sequence(F.lit(0), F.lit(345), F.lit(15))).alias("angle"))
    rad = F.col("angle") * (math.pi / 180)
    # a spot's number holds its weed, ring and angle: joins compare one long
    number = (F.col("weed_id") * 1000 + F.col("ring")) * 1000 + F.col("angle")
    spots = spots.select(number.alias("id"), (F.col("x") + F.col("ring") * F.cos(rad)).alias("x"), (F.col("y") + F.col("ring") * F.sin(rad)).alias("y"))
    spots = spots.where(F.col("x").between(0, bed[0]) & F.col("y").between(0, bed[1]))
    discs = obstacles.groupBy("x", "y").agg((F.max("radius") + clear).alias("reach"))
    free = spots.join(geometry.reached(spots, discs, 100.0, strict=True), "id", "left_anti")
    near = geometry.within(free.select("id", "x", "y"), anchors.groupBy("x", "y").agg(F.min("id").alias("id")), reach).where(F.col("distance") < reach)
    best = near.groupBy("id", "x", "y").agg(F.min(F.struct("distance", "o_id")).alias("a"))
    weed, ring, angle = F.expr("id div 1000000"), F.expr("id div 1000 % 1000"), F.expr("id % 1000")
    inner = best.withColumns({"weed_id": weed, "ring": ring}).withColumn("_r", F.min("ring").over(W.partitionBy("weed_id"))).where("ring = _r")
    margin = 325.0
    around = geometry.reach_pairs(inner, discs.withColumn("reach", F.col("reach") + margin), 500.0)
    gaps = around.groupBy("id").agg(F.min(F.col("gap") - F.col("reach") + margin).alias("clearance"))
    ranked = inner.join(gaps, "id", "left").withColumn("clearance", F.round(F.coalesce("clearance", F.lit(margin)), 6))
    chosen = ranked.groupBy("weed_id").agg(F.min(F.struct("ring", -F.col("clearance"), angle.alias("angle"), "x", "y", "clearance", F.col("a.o_id").alias("anchor_id"))).alias("s"))
    settled = every.join(first, ["x", "y"]).select("own_id", "weed_id").join(chosen, "weed_id")
    return settled.select(F.col("own_id").alias("id"), F.col("s.ring").cast("int").alias("ring"), F.col("s.angle").cast("int").alias("angle"), "s.x", "s.y", "s.clearance", "s.anchor_id")
