"""Reads of the garden store: latest rows, pending rows, summaries, growth baselines.

Every function takes and returns DataFrames; parameters carry the reference
behaviour's defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.operators import evidence, folds

#: The decisions that end a measurement's review.
TERMINAL = ("applied", "approved_no_change", "reject", "removed", "keep", "superseded")


def pending(measurements: DataFrame, decisions: DataFrame) -> DataFrame:
    """q30: measurements without a terminal decision."""
    done = decisions.where(F.col("action").isin(*TERMINAL)).select("measurement_id").distinct()
    return measurements.join(done, "measurement_id", "left_anti")


def newest_per_image(measurements: DataFrame) -> DataFrame:
    """win4: the newest row of each plant and image."""
    w = W.partitionBy("plant_id", "image_id").orderBy(F.desc("image_timestamp"), F.desc("measurement_id"))
    return measurements.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def weighted_median(rows: DataFrame, key: str, value: str, weight: str, out: str) -> DataFrame:
    """agg2: per key the first value whose running weight reaches half the total; the last if the total is not positive."""
    by = W.partitionBy(key)
    exact = F.col(weight).cast("decimal(20,12)")  # sums of doubles depend on their order
    running = F.sum(exact).over(by.orderBy(value).rangeBetween(W.unboundedPreceding, 0))
    marked = rows.withColumn("_run", running).withColumn("_total", F.sum(exact).over(by))
    return marked.groupBy(key).agg(F.when(F.max("_total") <= 0, F.max(value)).otherwise(F.min(F.when(F.col("_run") * 2 >= F.col("_total"), F.col(value)))).alias(out))


def _open(measurements: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending rows, newest per image, dealt out by plant once for all windows that follow."""
    return newest_per_image(pending(measurements, decisions).repartition("plant_id"))


def review_queue(measurements: DataFrame, decisions: DataFrame, least_confidence: float = 0.0, least_increase: float = 0.0, least_reduction: float = 0.0, limit: int = 100) -> DataFrame:
    """q32: pending rows, newest per image, judged per plant; small changes lose their confidence; newest first, limited last."""
    judged = evidence.consolidate(_open(measurements, decisions))
    change = F.coalesce("radius_mm", F.lit(0.0)) - F.coalesce("current_mm", F.lit(0.0))
    least = F.when(change > 0, least_increase).otherwise(least_reduction)
    small = ~F.col("absent") & (change != 0) & (F.abs(change) < least)
    kept = judged.withColumns({"confidence": F.when(small, 0.05).otherwise(F.col("confidence")), "change_mm": change}).where(F.col("confidence") >= least_confidence)
    return kept.orderBy(F.desc("image_timestamp"), F.desc("measurement_id")).limit(limit)


def measurement_rows(measurements: DataFrame, decisions: DataFrame) -> DataFrame:
    """q8: each measurement as it is shown: the plant's newest pending one as the judgement of all pending ones, others as stored."""
    judged = evidence.consolidate(_open(measurements, decisions))  # the newest of each image's newest rows is the plant's newest
    shown = judged.select(F.col("newest_id").alias("measurement_id"), F.struct("absent", "confidence", "radius_mm").alias("j"))
    both = measurements.join(shown, "measurement_id", "left")
    pick = lambda new, old: F.when(F.col("j").isNotNull(), F.col(f"j.{new}")).otherwise(F.col(old)).alias(new)
    return both.select("measurement_id", "plant_id", F.col("j").isNotNull().alias("judged"), pick("absent", "vegetation_absent"), pick("confidence", "confidence"), pick("radius_mm", "recommended_mm"))


def outstanding_failures(soil: DataFrame, decisions: DataFrame, retry_before: str, reach: float = 0.001) -> DataFrame:
    """q33: failed rows up to a time, without a newer row of the same target and without a later retry.

    A target is the point, or for point 0 the capture coordinates within
    `reach`. Points are settled by a window; point 0 by an equi-join on cells,
    which only its failed rows enter nine times. Ties in time go to the larger id.
    """
    until = F.lit(retry_before).cast("timestamp")
    w = W.partitionBy("point_id").orderBy(F.desc("created_at"), F.desc("measurement_id"))
    named = soil.where("point_id > 0").withColumn("_n", F.row_number().over(w)).where("_n = 1 AND status = 'failed'").drop("_n")
    loose = soil.where("point_id = 0 AND status = 'failed'")
    side = 2 * reach
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("d")
    old = loose.select("measurement_id", "capture_x", "capture_y", "created_at", steps)
    old = old.select("*", (F.floor(F.col("capture_x") / side) + F.col("d.i")).alias("_cx"), (F.floor(F.col("capture_y") / side) + F.col("d.j")).alias("_cy"))
    new = soil.select(F.col("measurement_id").alias("n_id"), F.col("capture_x").alias("n_x"), F.col("capture_y").alias("n_y"), F.col("created_at").alias("n_at"), F.floor(F.col("capture_x") / side).alias("_cx"), F.floor(F.col("capture_y") / side).alias("_cy"))
    near = (F.abs(F.col("n_x") - F.col("capture_x")) <= reach) & (F.abs(F.col("n_y") - F.col("capture_y")) <= reach)
    later = (F.col("n_at") > F.col("created_at")) | ((F.col("n_at") == F.col("created_at")) & (F.col("n_id") > F.col("measurement_id")))
    replaced = old.join(new, ["_cx", "_cy"]).where(near & later).select("measurement_id").distinct()
    failed = named.unionByName(loose.join(replaced, "measurement_id", "left_anti")).where(F.col("created_at") <= until)
    retried = decisions.where((F.col("action") == "automatic_retry_started") & (F.col("created_at") > until)).select("measurement_id").distinct()
    return failed.join(retried, "measurement_id", "left_anti")


def growth_baseline(changes: DataFrame, current: DataFrame, since: str) -> DataFrame:
    """win2: per entity (entity_id, current_mm) the radius before its first increase since a time, to the second; the current one without any."""
    at = F.date_trunc("second", "created_at")
    rows = changes.where((F.col("change_type") == "radius increased") & (at >= F.date_trunc("second", F.lit(since).cast("timestamp"))))
    first = rows.groupBy("entity_id").agg(F.min_by("original_radius_mm", F.struct(at, "id")).alias("baseline_mm"))
    return current.join(first, "entity_id", "left").select("entity_id", F.coalesce("baseline_mm", "current_mm").alias("baseline_mm"))


def absent_streak(measurements: DataFrame) -> DataFrame:
    """win1: how many of a plant's newest images in a row show no vegetation."""
    rows = newest_per_image(measurements)
    w = W.partitionBy("plant_id").orderBy(F.desc("image_timestamp"), F.desc("measurement_id")).rowsBetween(W.unboundedPreceding, 0)
    present = F.sum(F.when(F.col("vegetation_absent"), 0).otherwise(1)).over(w)
    return rows.withColumn("_p", present).groupBy("plant_id").agg(F.sum(F.when(F.col("_p") == 0, 1).otherwise(0)).alias("streak"))


def label_counts(training: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """agg3: samples of each label of a fixed list, zeros included."""
    spark = training.sparkSession
    names = spark.createDataFrame([(x,) for x in labels], "label string")
    return names.join(training.groupBy("label").count(), "label", "left").select("label", F.coalesce("count", F.lit(0)).alias("samples"))


def latest(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """q1, q2, q18: the newest row of each key."""
    w = W.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def recent(rows: DataFrame, time: str, tie: str, limit: int) -> DataFrame:
    """q7, q16, q17: newest first, limited."""
    return rows.orderBy(F.desc(time), F.desc(tie)).limit(limit)


def newest_mask(measurements: DataFrame) -> DataFrame:
    """q4: per plant the newest row that shows vegetation; with the tie rule of `latest`."""
    return latest(measurements.where("NOT vegetation_absent"), "plant_id", "image_timestamp", "measurement_id")


def seen_present(measurements: DataFrame) -> DataFrame:
    """q5: per plant whether any row shows vegetation."""
    return measurements.groupBy("plant_id").agg(F.bool_or(~F.col("vegetation_absent")).alias("present"))


def crop_observations(measurements: DataFrame, least_confidence: float = 0.6) -> DataFrame:
    """q6: rows sure enough to teach a growth curve; absent rows count too."""
    return measurements.where(F.col("confidence") >= least_confidence)


def has_terminal(measurements: DataFrame, decisions: DataFrame) -> DataFrame:
    """q9: measurements with a terminal decision."""
    return measurements.join(decisions.where(F.col("action").isin(*TERMINAL)).select("measurement_id"), "measurement_id", "left_semi")


def pending_of(measurements: DataFrame, decisions: DataFrame, images: list[int]) -> DataFrame:
    """q31: the newest pending row of each plant and listed image; the filter precedes both joins."""
    return newest_per_image(pending(measurements.where(F.col("image_id").isin(*images)), decisions))


def unprocessed_repairs(soil: DataFrame, repairs: DataFrame) -> DataFrame:
    """q34: usable heights that no repair has classified."""
    done = repairs.select(F.col("legacy_measurement_id").alias("measurement_id"))
    return soil.where("status IN ('valid', 'applied') AND proposed_z_mm IS NOT NULL").join(done, "measurement_id", "left_anti")


def pending_repairs(soil: DataFrame, repairs: DataFrame) -> DataFrame:
    """q35: pending repairs with their measurement, largest change first."""
    waiting = repairs.where("state = 'pending'").withColumnRenamed("created_at", "repaired_at")
    found = waiting.join(soil, F.col("legacy_measurement_id") == F.col("measurement_id"))
    return found.orderBy(F.desc(F.abs("delta_mm")), "repaired_at", "measurement_id")


def current_plants(measurements: DataFrame) -> DataFrame:
    """q38: rows at the plant's newest time of any kind that show vegetation.

    A plant whose newest row is absent has none; equal times keep all rows.
    """
    newest = F.max("image_timestamp").over(W.partitionBy("plant_id"))
    rows = measurements.withColumn("_t", newest).where("image_timestamp = _t AND NOT vegetation_absent").drop("_t")
    return rows.withColumn("radius_mm", F.greatest("current_radius_mm", "recommended_mm"))


def labels_since(total: DataFrame, runs: DataFrame) -> DataFrame:
    """agg4: labels beyond those of the last model run, not below zero; total and runs (id, sample_count) are frames."""
    last = runs.agg(F.coalesce(F.max_by("sample_count", "id"), F.lit(0)).alias("last"))
    return total.agg(F.count("*").alias("n")).crossJoin(last).select(F.greatest(F.lit(0), F.col("n") - F.col("last")).alias("fresh"))  # one row each


#: The states of a repair.
STATES = ("pending", "unavailable", "unchanged", "applied", "rejected", "conflict")


def repair_summary(soil: DataFrame, repairs: DataFrame) -> DataFrame:
    """agg5: one row with eligible, unprocessed, a count of each state, and whether the repair is over."""
    eligible = soil.where("status IN ('valid', 'applied') AND proposed_z_mm IS NOT NULL").agg(F.count("*").alias("eligible"))
    states = repairs.agg(F.count("*").alias("processed"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    both = eligible.crossJoin(states)  # one row each
    over = (F.col("eligible") > 0) & (F.col("processed") >= F.col("eligible")) & (F.col("pending") == 0)
    return both.select("eligible", F.greatest(F.lit(0), F.col("eligible") - F.col("processed")).alias("unprocessed"), *STATES, over.alias("retired"))


def height_changes(soil: DataFrame, decisions: DataFrame, repairs: DataFrame, limit: int = 100) -> DataFrame:
    """set1: applied height changes and who approved them, newest first."""
    heights = soil.select("measurement_id", "proposed_z_mm")
    asked = decisions.where("action IN ('approve', 'automatic_approve')").join(heights, "measurement_id")
    by = F.when(F.col("action") == "automatic_approve", "automatic").otherwise("user")
    approved = asked.select("measurement_id", "created_at", F.col("proposed_z_mm").alias("new_z_mm"), by.alias("method"))
    fixed = repairs.select(F.col("legacy_measurement_id").alias("measurement_id"), "delta_mm")
    redone = decisions.where("action = 'legacy_v2_repair_apply'").join(heights, "measurement_id").join(fixed, "measurement_id")
    redone = redone.select("measurement_id", "created_at", (F.col("proposed_z_mm") + F.col("delta_mm")).alias("new_z_mm"), F.lit("user").alias("method"))
    return approved.unionByName(redone).orderBy(F.desc("created_at"), F.desc("measurement_id")).limit(limit)


def time_clusters(images: DataFrame, key: str, seconds: int = 3600) -> DataFrame:
    """win6: cluster number of each image of a key; a cluster reaches that long from its first image.

    Where a cluster starts depends on the one before, so the distinct times of a
    key are gone through in order with the last start as the only state.
    """
    seen = images.select(key, F.col("created_at").cast("long").alias("t")).where("t IS NOT NULL").distinct()

    def step(state, row):
        if state["anchor"] is None or row["t"] - state["anchor"] > seconds:
            state["anchor"] = row["t"]
        return ((row["t"], state["anchor"]),)

    dealt = folds.carried(seen, key, ["t"], lambda: {"anchor": None}, step, "t long, anchor long")
    return images.withColumn("t", F.col("created_at").cast("long")).join(dealt, [key, "t"]).drop("t")
