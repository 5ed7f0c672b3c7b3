"""Which views of a plant count, what they add up to, and the canopy's edge from foliage points."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.operators import folds

SECTORS = 72


def consolidate(rows: DataFrame, half_life: float = 14.0) -> DataFrame:
    """agg1: one judgement a plant from the views that sel1 chose, else from those that show its place empty.

    A weight is confidence, visible share (each from 0.05 to 1) and recency
    against the first view. The heavier of present and absent decides; radius is
    the weighted median, confidence the weighted mean with a bonus for views. One
    view stands for itself. A fused edge (fused_mm, fused_confidence,
    fusion_reliable) overrides: with several views the first chosen one's, with
    one view the newest reliable one's. A plant without any such view keeps its
    newest row, uncertain and of confidence 0.2 at most. newest_id is the plant's
    newest row. Rows without a plant are not judged.
    """
    by = W.partitionBy("plant_id")
    rows = rows.where("plant_id IS NOT NULL")
    aged = rows.withColumn("_age", F.row_number().over(by.orderBy(F.desc("image_timestamp"), F.desc("measurement_id"))))
    chosen = chosen_views(rows).where("measurement_id IS NOT NULL").select("plant_id", "measurement_id", F.col("pos").alias("_pos"))
    marked = aged.join(chosen.repartition("plant_id"), ["plant_id", "measurement_id"], "left")  # both sides lie by plant, so the rows stay where the windows need them
    marked = marked.withColumn("_used", F.count("_pos").over(by))
    empty = (F.col("_used") == 0) & F.col("vegetation_absent") & F.col("center_visible")
    marked = marked.withColumn("_pos", F.when(F.col("_used") > 0, F.col("_pos")).when(empty, F.col("_age")))
    seconds = F.min_by("image_timestamp", "_pos").over(by).cast("double") - F.col("image_timestamp").cast("double")
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.coalesce(c, F.lit(0.0))))
    weight = clip(F.col("confidence")) * clip(F.col("visible_fraction")) * F.exp(-math.log(2) * F.greatest(F.lit(0.0), seconds / 86400) / half_life)
    marked = marked.withColumn("w", F.when(F.col("_pos").isNotNull(), weight.cast("decimal(20,12)")))  # sums of doubles depend on their order
    side = F.sum(F.when(F.col("vegetation_absent"), F.col("w")).otherwise(-F.col("w"))).over(by) > 0
    marked = marked.withColumn("_absent", F.coalesce(side, F.lit(False))).withColumn("w", F.when(F.col("vegetation_absent") == F.col("_absent"), F.col("w")))
    running = F.sum("w").over(by.orderBy("recommended_mm").rangeBetween(W.unboundedPreceding, 0))
    marked = marked.withColumns({"_run": running, "_total": F.sum("w").over(by)})
    whole = F.struct("measurement_id", "image_timestamp", "current_radius_mm", "recommended_mm", "confidence", "visible_fraction", "vegetation_absent")
    fused, has = F.struct("fused_mm", "fused_confidence", "fusion_reliable"), F.col("fused_mm").isNotNull()
    share = lambda c: F.sum((F.col(c) * F.col("w").cast("double")).cast("decimal(20,12)")).cast("double") / F.greatest(F.sum("w").cast("double"), F.lit(1e-9))
    facts = marked.groupBy("plant_id").agg(
        F.count("*").alias("views"), F.count("_pos").alias("n"), F.max("_used").alias("chosen"), F.count("w").alias("agreeing"), F.bool_or("_absent").alias("side"),
        F.min_by(whole, "_pos").alias("one"), F.min_by(whole, "_age").alias("newest"),
        F.min_by(fused, F.when(has, F.col("_pos"))).alias("many_fused"), F.min_by(fused, F.when(has & F.col("fusion_reliable"), F.col("_age"))).alias("one_fused"),
        share("confidence").alias("confidence"), share("visible_fraction").alias("visible_fraction"),
        F.min(F.when(F.col("w").isNotNull() & (F.col("_run") * 2 >= F.col("_total")), F.col("recommended_mm"))).alias("median"),
    )
    none, single = F.col("n") == 0, F.col("n") == 1
    stands = F.when(none, F.col("newest")).otherwise(F.col("one"))
    over = F.when(single, F.col("one_fused")).when(~none & ~F.col("side"), F.col("many_fused"))
    sure = F.least(F.lit(0.99), F.col("confidence") + F.least(F.lit(0.08), (F.col("agreeing") - 1) * 0.02))
    low = F.least(F.lit(0.2), F.when(F.coalesce("newest.confidence", F.lit(0.0)) == 0, 0.05).otherwise(F.col("newest.confidence")))
    facts = facts.withColumns({"stands": stands, "over": over})
    return facts.select(
        "plant_id", "stands.measurement_id", "stands.image_timestamp", F.col("newest.measurement_id").alias("newest_id"), F.col("stands.current_radius_mm").alias("current_mm"),
        F.when(none, False).when(single, F.col("one.vegetation_absent")).otherwise(F.col("side")).alias("absent"),
        "views", F.when(single, F.lit(1)).otherwise(F.col("chosen")).cast("long").alias("used"),
        (none | (~single & F.coalesce(~F.col("over.fusion_reliable"), F.lit(False)))).alias("uncertain"),
        F.when(none, low).otherwise(F.coalesce("over.fused_confidence", F.when(single, F.col("one.confidence")).otherwise(sure))).alias("confidence"),
        F.when(none | single, F.col("stands.visible_fraction")).otherwise(F.least(F.lit(1.0), F.col("visible_fraction"))).alias("visible_fraction"),
        F.when(none, F.col("newest.recommended_mm")).otherwise(F.coalesce("over.fused_mm", F.when(single, F.col("one.recommended_mm")).when(F.col("side"), 0.0).otherwise(F.col("median")))).alias("radius_mm"),
    )


def quality():
    """sel2: confidence times the root of image and segmentation quality, as a Column."""
    clip = lambda c, low: F.least(F.lit(1.0), F.greatest(F.lit(low), F.col(c)))
    return clip("confidence", 0.0) * F.sqrt(clip("image_quality", 0.05) * clip("segmentation_quality", 0.05))


def is_complete():
    """sel2: a view that shows the whole plant, as a Column."""
    return F.col("has_evidence") & F.col("center_visible") & ~F.col("truncated") & (F.col("coverage") >= 0.98)


def _covered(coverage):
    return F.rint(F.least(F.lit(1.0), F.greatest(F.lit(0.0), coverage)) * SECTORS).cast("int")


def sectors(first, coverage):
    """fn6: the sectors a view covers, from its first one on, as an array Column."""
    n = _covered(coverage)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: (k + first) % SECTORS)).otherwise(F.array().cast("array<int>"))


def _gather(plant: dict, view: dict) -> tuple:
    """One view more of a plant, best first. Sectors are bits of one integer; of equal ones only the first can add any."""
    if view["_whole"]:
        plant["mode"] = "single_complete"
    elif view["useful"]:
        plant["mode"] = "no_center"
        bits = 0 if view["first_sector"] is None else ((1 << (view["n"] or 0)) - 1) << view["first_sector"] % SECTORS
        bits = (bits | bits >> SECTORS) & ((1 << SECTORS) - 1)
        plant["first"].setdefault(bits, len(plant["ids"]))
        if plant["centre"] is None and view["center_visible"]:
            plant["centre"] = len(plant["ids"]), bits
        plant["fits"] &= view["fits"] is not False
    plant["ids"].append(view["measurement_id"])
    return ()


def _cover(plant: dict) -> Iterator[tuple]:
    """Greedy cover of one plant's boundary: best centre view, then the most new sectors, quality, time, smaller id."""
    mode, ids, first, fits = plant["mode"], plant["ids"], plant["first"], plant["fits"]
    if mode == "single_complete":
        yield ids[0], 0, mode, SECTORS
        return
    if plant["centre"] is None:
        yield None, None, mode, 0
        return
    centre, seen = plant["centre"]
    used = [centre]
    while first and not (fits and 2 * seen.bit_count() >= SECTORS):
        best = max(first, key=lambda bits: (bits & ~seen).bit_count())
        if not best & ~seen:
            break
        used.append(first.pop(best))
        seen |= best
    if not fits:  # all its views count, those without a new sector in their order
        taken = set(used)
        used += [k for k in range(len(ids)) if k not in taken]
    mode = "large_composite" if not fits else "partial_composite" if 2 * seen.bit_count() >= SECTORS else "insufficient_partial"
    for pos, k in enumerate(used):
        yield ids[k], pos, mode, seen.bit_count()


def chosen_views(rows: DataFrame, hours: float = 6.0, least_quality: float = 0.12) -> DataFrame:
    """sel1: the chosen views, one a row: plant_id, measurement_id, pos (from 0), mode and the plant's covered sectors; a plant without any has one row of null measurement_id.

    The window starts at the newest row, useful or not. Of plants with a complete
    view, or without a useful one, one row goes on; of the others the views within
    the window, which the camera's pace bounds. They are folded plant by plant.
    """
    by = W.partitionBy("plant_id")
    age = (F.max("image_timestamp").over(by).cast("double") - F.col("image_timestamp").cast("double")) / 3600
    useful = (F.col("_age") <= hours) & F.col("has_evidence") & (F.col("segmentation_quality") >= least_quality)
    marked = rows.withColumn("_age", age).withColumn("useful", F.coalesce(useful, F.lit(False)))
    marked = marked.withColumns({"q": quality(), "_whole": F.coalesce(F.col("useful") & is_complete(), F.lit(False))})
    best = by.orderBy(F.desc("useful"), F.desc("_whole"), F.desc("q"), F.desc("image_timestamp"), "measurement_id")
    marked = marked.withColumns({"_r": F.row_number().over(best), "_any": F.bool_or("_whole").over(by)})
    views = marked.where("_r = 1 OR (useful AND NOT _any)").select("plant_id", "_r", "measurement_id", "useful", "_whole", "center_visible", "fits", "first_sector", _covered(F.col("coverage")).alias("n"))
    start = lambda: {"mode": "no_evidence", "ids": [], "first": {}, "centre": None, "fits": True}
    return folds.carried(views, "plant_id", ["_r"], start, _gather, "measurement_id long, pos int, mode string, covered long", _cover)


def select_evidence(rows: DataFrame, hours: float = 6.0, least_quality: float = 0.12) -> DataFrame:
    """sel1: plant_id, mode, used (measurement ids in order of choice) and covered sectors."""
    view = F.when(F.col("measurement_id").isNotNull(), F.struct("pos", "measurement_id"))
    plants = chosen_views(rows, hours, least_quality).groupBy("plant_id").agg(F.max("mode").alias("mode"), F.array_sort(F.collect_list(view)).alias("used"), F.max("covered").alias("covered"))
    return plants.select("plant_id", "mode", F.col("used.measurement_id").alias("used"), "covered")


def edge_limits(points: DataFrame, current: DataFrame, margin: float = 20.0) -> DataFrame:
    """can2, agg10: per plant and sector with an edge: edge, limit (where its foliage ends to count), cut, current_mm.

    points: plant_id, sector (0 to 71), distance_mm. current: plant_id, current_mm.
    A sector's edge is the 98th percentile of at least three points. Sectors
    beyond the band of growth are cut to the prior edge where they form a run of
    more than 7, or number more than 16 in all. Runs are islands over 72 rows a
    plant, joined across the seam.
    """
    edges = points.groupBy("plant_id", "sector").agg(F.percentile("distance_mm", F.lit(0.98)).alias("edge"), F.count("*").alias("n")).where("n >= 3")
    cur = F.greatest(F.lit(0.0), F.col("current_mm"))
    aware = cur > margin + 5
    prior = F.greatest(F.lit(5.0), F.when(aware, cur - margin).otherwise(cur))
    band = F.when(aware, F.greatest(F.lit(20.0), F.least(F.lit(40.0), prior * 0.30))).otherwise(F.greatest(F.lit(40.0), F.least(F.lit(75.0), prior * 1.5)))
    edges = edges.join(current.select("plant_id", "current_mm"), "plant_id").withColumns({"prior": prior, "over": F.col("edge") > prior + band})
    by = W.partitionBy("plant_id")
    over = edges.where("over").withColumn("_g", F.col("sector") - F.row_number().over(by.orderBy("sector")))
    runs = over.groupBy("plant_id", "_g").agg(F.min("sector").alias("a"), F.max("sector").alias("b"), F.count("*").alias("size"))
    seam = F.sum(F.when((F.col("a") == 0) | (F.col("b") == SECTORS - 1), F.col("size"))).over(by)
    at_seam = (F.max(F.col("a") == 0).over(by)) & (F.max(F.col("b") == SECTORS - 1).over(by)) & ((F.col("a") == 0) | (F.col("b") == SECTORS - 1))
    whole = (F.col("a") == 0) & (F.col("b") == SECTORS - 1)
    length = F.when(at_seam & ~whole, seam).otherwise(F.col("size"))
    runs = runs.withColumns({"length": length, "total": F.sum("size").over(by)})
    cut = over.join(runs, ["plant_id", "_g"]).where("length > 7 OR total > 16").select("plant_id", "sector", F.lit(True).alias("cut"))
    limits = edges.join(cut, ["plant_id", "sector"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    limit = F.when(F.col("cut"), F.col("prior")).otherwise(F.col("edge"))
    return limits.select("plant_id", "sector", "edge", limit.alias("limit"), "cut", "current_mm")


def kept_points(points: DataFrame, limits: DataFrame) -> DataFrame:
    """The points within their sector's limit; a sector without an edge keeps none."""
    return points.join(limits, ["plant_id", "sector"]).where(F.col("distance_mm") <= F.col("limit") + 1e-6)


def canopy_edge(points: DataFrame, current: DataFrame, margin: float = 20.0, limits: DataFrame | None = None) -> DataFrame:
    """can1: per plant outer_mm, unclipped_mm, typical_mm, broad and recommended_mm from foliage points, with limits as from `edge_limits`."""
    limits = edge_limits(points, current, margin) if limits is None else limits
    kept = kept_points(points, limits)
    inner = kept.groupBy("plant_id", "sector").agg(F.percentile("distance_mm", F.lit(0.98)).alias("e"), F.count("*").alias("n")).where("n >= 3")
    outer = inner.groupBy("plant_id").agg(F.max("e").alias("outer_mm"))
    typical = kept.groupBy("plant_id").agg(F.percentile("distance_mm", F.lit(0.9)).alias("typical"))
    facts = limits.groupBy("plant_id").agg(F.max("edge").alias("unclipped_mm"), F.bool_or("cut").alias("broad"), F.max("current_mm").alias("current_mm"))
    out = facts.join(outer, "plant_id").join(typical, "plant_id")
    cur = F.greatest(F.lit(0.0), F.col("current_mm"))
    advice = F.greatest(F.col("outer_mm") + margin, F.least(cur, F.col("unclipped_mm") + margin))
    return out.select("plant_id", "outer_mm", "unclipped_mm", F.least("typical", "outer_mm").alias("typical_mm"), "broad", advice.alias("recommended_mm"))
