"""Review decisions over groups, gates for automatic changes, progress of capture runs, retention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.operators import geometry, store


def superseded(measurements: DataFrame, decisions: DataFrame) -> DataFrame:
    """win5: decisions that a re-analysis adds: every row of a plant and image but the last written, once."""
    last = measurements.groupBy("plant_id", "image_id").agg(F.max("measurement_id").alias("last"))
    older = measurements.select("plant_id", "image_id", "measurement_id").join(last, ["plant_id", "image_id"]).where("measurement_id <> last")
    done = decisions.where("action = 'superseded'").select("measurement_id").distinct()
    return older.join(done, "measurement_id", "left_anti").select("measurement_id", F.lit("superseded").alias("action"))


def group_decisions(choices: DataFrame, measurements: DataFrame, decisions: DataFrame) -> DataFrame:
    """dec10: the rows that each choice (measurement_id, plant_id, action) decides.

    That is every pending row of its plant if these come from several images,
    else the chosen row alone.
    """
    rows = store.pending(measurements, decisions).select("plant_id", "image_id", "measurement_id")
    groups = rows.groupBy("plant_id").agg((F.min("image_id") < F.max("image_id")).alias("several"))
    marked = choices.join(groups, "plant_id", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    whole = marked.where("several").select("plant_id", "action").join(rows, "plant_id").select("measurement_id", "action")
    return whole.unionByName(marked.where("NOT several").select("measurement_id", "action"))


def cleared(measurements: DataFrame, decisions: DataFrame, detections: DataFrame) -> DataFrame:
    """dec12: what clearing the queues marks as superseded, by kind; nothing is deleted."""
    rows = store.pending(measurements, decisions).select(F.lit("measurement").alias("kind"), F.col("measurement_id").alias("id"))
    found = detections.where(F.col("status").isin("recommended", "observing")).select(F.lit("detection").alias("kind"), F.col("detection_id").alias("id"))
    return rows.unionByName(found)


def may_create(verified: Column, observations: Column, flags: list[Column], accept: float = 0.7, create: float = 0.8, least: int = 3) -> Column:
    """dec6: whether a candidate becomes a weed unasked: a sure verifier, enough observations, no flag set."""
    clear = ~F.greatest(*[F.coalesce(f, F.lit(False)) for f in flags])
    return F.coalesce((verified >= max(accept, create)) & (observations >= least) & clear, F.lit(False))


def may_widen(verified: Column, present: Column, observed: Column, target: Column, current: Column, fallback: Column, accept: float = 0.7, least: int = 2) -> Column:
    """dec7: whether a weed's radius grows unasked; an image counts once, and growth under half a millimetre never does."""
    sure = (verified >= accept) & (present >= least) & ~observed & ~F.coalesce(fallback, F.lit(False))
    return F.coalesce(sure & (target > current + 0.5), F.lit(False))


def fusion_reliable(coverage: Column, corroborated: Column, views: Column, fused: Column, single: Column, least_coverage: float = 0.5, least_corroborated: float = 0.35, most_apart: float = 35.0) -> Column:
    """can4: whether a fused radius may be applied; one view needs no corroboration."""
    return (coverage >= least_coverage) & ((views == 1) | (corroborated >= least_corroborated)) & (F.abs(fused - single) <= most_apart)


def run_progress(cells: DataFrame) -> DataFrame:
    """win12: the state of each cell (run, index, verified, finished, retrying).

    Cells behind the furthest verified one were passed without a photo and are
    missed; the first ahead is active; where none is ahead a retry works from
    the first missed one.
    """
    by = W.partitionBy("run")
    frontier = F.coalesce(F.max(F.when(F.col("verified"), F.col("index"))).over(by), F.lit(-1))
    rows = cells.withColumn("frontier", frontier)
    lost = ~F.col("verified") & (F.col("finished") | (F.col("index") < F.col("frontier")))
    rows = rows.withColumns({"_lost": lost, "_ahead": ~F.col("verified") & ~F.col("finished") & (F.col("index") > F.col("frontier"))})
    rows = rows.withColumns({"_first": F.min(F.when(F.col("_ahead"), F.col("index"))).over(by), "_again": F.min(F.when(F.col("_lost"), F.col("index"))).over(by)})
    again = F.col("retrying") & ~F.col("finished") & F.col("_first").isNull() & (F.col("index") == F.col("_again"))
    state = F.when(F.col("verified"), "verified").when(F.col("index") == F.col("_first"), "active").when(again, "active").when(F.col("_lost"), "missed").otherwise("unattempted")
    return rows.select("run", "index", "frontier", state.alias("state"))


def progress_counts(cells: DataFrame) -> DataFrame:
    """agg9: cells of each state by run."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return run_progress(cells).groupBy("run").agg(F.max("frontier").alias("frontier"), *map(count, ("verified", "active", "missed", "unattempted")))


def next_repairs(targets: DataFrame, attempts: DataFrame, tolerance: float = 25.0) -> DataFrame:
    """win10: each run's repair targets (run, x, y, reason) in the order of work: missing cells first, then by place.

    A target within the tolerance of an attempt (run, x, y) is left out; a run
    has as many attempts as its grid has cells, so the join is by run.
    """
    tried = attempts.select(F.col("run").alias("_run"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    near = (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")) <= tolerance * tolerance
    left = targets.distinct().join(tried, (F.col("run") == F.col("_run")) & near, "left_anti")
    order = W.partitionBy("run").orderBy(F.col("reason") != "missing", "x", "y", "reason")
    return left.select("run", "x", "y", "reason", F.row_number().over(order).alias("turn"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """win14: per key the element at half the number of its sorted values; counted by distinct value first."""
    seen = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    by = W.partitionBy(key)
    running = F.sum("n").over(by.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    marked = seen.withColumns({"_run": running, "_all": F.sum("n").over(by)})
    return marked.groupBy(key).agg(F.min(F.when(F.col("_run") > F.floor(F.col("_all") / 2), F.col(value))).alias("median"))


def ordinary_median(rows: DataFrame, key: str, value: str, apart: Column) -> DataFrame:
    """agg11: per key the median of the rows that are not apart, of all rows where every one is."""
    return rows.groupBy(key).agg(F.coalesce(F.percentile(F.when(~apart, F.col(value)), F.lit(0.5)), F.percentile(value, F.lit(0.5))).alias("median"))


def visible_plants(images: DataFrame, plants: DataFrame, half_x: float = 500.0, half_y: float = 400.0) -> DataFrame:
    """q20: per image (id, x, y) how many plants lie in its frame, and the smallest id, 0 where there is none.

    Images of one place see the same plants, so places are joined, not images,
    and plants of one place go as one with their number.
    """
    spots = plants.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    near = geometry.within(images.select("x", "y").distinct(), spots, math.hypot(half_x, half_y) * (1 + 1e-9))
    near = near.where((F.abs(F.col("x") - F.col("o_x")) <= half_x) & (F.abs(F.col("y") - F.col("o_y")) <= half_y))
    seen = near.groupBy("x", "y").agg(F.sum("o_n").alias("plants"), F.min("o_first").alias("first_plant"))
    return images.select("id", "x", "y").join(seen, ["x", "y"], "left").select("id", F.coalesce("plants", F.lit(0)).alias("plants"), F.coalesce("first_plant", F.lit(0)).alias("first_plant"))


def with_cell(measurements: DataFrame, frames: DataFrame, cells: DataFrame, dx: float = 373.0, dy: float = 294.0) -> DataFrame:
    """q43: measurements with the grid cell of their image's frame and what is known of the cell (images, 0 where none is known)."""
    cell = lambda c, d: F.floor(F.col(c) / d + 0.5).cast("long")
    placed = frames.select(F.col("id").alias("image_id"), cell("x", dx).alias("cell_x"), cell("y", dy).alias("cell_y"))
    return measurements.join(placed, "image_id", "left").join(cells, ["cell_x", "cell_y"], "left").fillna(0, ["images"])


def evicted(files: DataFrame, time: str, tie: str, most: int = 256) -> DataFrame:
    """snk8: files beyond the newest `most`; the kept ones are that many rows at most."""
    kept = files.select(time, tie).orderBy(F.desc(time), F.desc(tie)).limit(most).select(tie)
    return files.join(F.broadcast(kept), tie, "left_anti")


def expired(artifacts: DataFrame, time: str, now: Column, mask: Column, mask_days: int = 7, days: int = 14) -> DataFrame:
    """snk10: artifacts past their keeping time; masks are kept for a shorter one."""
    age = now.cast("long") - F.col(time).cast("timestamp").cast("long")
    return artifacts.where(age > F.when(mask, mask_days * 86400).otherwise(days * 86400))


def rejected_near(detections: DataFrame, tolerance: float = 40.0) -> DataFrame:
    """dec11: detection_id and status of pending detections after all rejections: one within the tolerance rejects them."""
    open_ = detections.where(F.col("status").isin("recommended", "observing")).select(F.col("detection_id").alias("id"), "x", "y", "status")
    discs = detections.where("status = 'rejected'").select("x", "y", F.lit(tolerance).alias("reach")).distinct()
    hit = geometry.reached(open_, discs, tolerance).withColumn("hit", F.lit(True))
    return open_.join(hit, "id", "left").select(F.col("id").alias("detection_id"), F.when(F.col("hit"), "rejected").otherwise(F.col("status")).alias("status"))


def upserted(writes: DataFrame, key: str, order: str, replaced: list[str], kept: list[str], first: list[str]) -> DataFrame:
    """dec14, dec16: one row a key from its writes: columns that the last write replaces, columns that keep their
    last value over nulls, and columns that the first write sets for good. Partial aggregates, no sort."""
    last = [F.max_by(c, order).alias(c) for c in replaced]
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in kept]
    return writes.groupBy(key).agg(*last, *known, *[F.min_by(c, order).alias(c) for c in first])


def boundary_union(views: DataFrame, key: str, sectors: Column, total: int = 72) -> DataFrame:
    """set4: share of the boundary's sectors that any view of the key covers; at most `total` values a key are gathered."""
    seen = views.select(key, F.explode_outer(sectors).alias("sector")).distinct()
    return seen.groupBy(key).agg(F.count("sector").alias("sectors")).select(key, (F.col("sectors") / total).alias("coverage"))


def due(at: Column, days: tuple[int, ...], clock: str, enabled: bool = True) -> Column:
    """fn20: whether a schedule fires in that minute; days count from Monday, 0, and none means never."""
    return F.lit(enabled) & F.weekday(at).isin(*days) & (F.date_format(at, "HH:mm") == clock) if days else F.lit(False)


def selected_images(images: DataFrame, excluded: DataFrame) -> DataFrame:
    """q23: processed images that are not excluded (id), for one job."""
    return images.where("processed").join(excluded.select("id").distinct(), "id", "left_anti")


def applicable(status: Column, height: Column, x: Column, y: Column, point: Column, updated: Column) -> Column:
    """q24: whether a measured soil height may be applied: valid, with a place, and for a known point its update time."""
    return (status == "valid") & height.isNotNull() & x.isNotNull() & y.isNotNull() & ((F.coalesce(point, F.lit(0)) == 0) | updated.isNotNull())


def absence(observations: DataFrame, least: int = 2, sure: float = 0.5) -> DataFrame:
    """dec8: for each counted observation (weed_id, image_id, at, id, absent, confidence, fully_visible) how often in a
    row the weed was absent, the least confidence of that run, and whether the weed may be removed.

    Only fully visible weeds count, each once an image; a present one starts anew.
    """
    once = W.partitionBy("weed_id", "image_id").orderBy("at", "id")
    rows = observations.where("fully_visible").withColumn("_n", F.row_number().over(once)).where("_n = 1")
    order = W.partitionBy("weed_id").orderBy("at", "id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.count_if(~F.col("absent")).over(order))
    within = W.partitionBy("weed_id", "_run").orderBy("at", "id").rowsBetween(W.unboundedPreceding, 0)
    streak, least_sure = F.count_if("absent").over(within), F.min(F.when(F.col("absent"), F.col("confidence"))).over(within)
    rows = rows.withColumns({"streak": streak, "confidence": F.when(F.col("absent"), least_sure).otherwise(F.col("confidence"))})
    return rows.select("weed_id", "id", "streak", "confidence", (F.col("absent") & (F.col("streak") >= least) & (F.col("confidence") >= sure)).alias("remove"))


#: The directions in which an obstructed cell is viewed again, in shares of the offset.
ASIDE = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1), (-0.5, 0), (0.5, 0), (0, -0.5), (0, 0.5))


def views_aside(cells: DataFrame, share: float = 0.2, least: float = 20.0, most: int = 4) -> DataFrame:
    """grd9: the first `most` distinct places beside each cell (bed_id, index, x, y, width_mm, depth_mm, frame_x, frame_y), kept on the bed.

    Map-only: a row's places are made and told apart within it.
    """
    dx, dy = (F.greatest(F.lit(least), F.col(f) * share) for f in ("frame_x", "frame_y"))
    on = lambda at, span: F.round(F.least(F.col(span), F.greatest(F.lit(0.0), at)), 3)
    places = F.array(*[F.struct(on(F.col("x") + dx * float(i), "width_mm").alias("x"), on(F.col("y") + dy * float(j), "depth_mm").alias("y")) for i, j in ASIDE])
    moved = F.filter(places, lambda p: (p["x"] != F.col("x")) | (p["y"] != F.col("y")))
    rows = cells.select("bed_id", "index", F.posexplode(F.slice(F.array_distinct(moved), 1, most)).alias("turn", "p"))
    return rows.select("bed_id", "index", "turn", "p.x", "p.y")
