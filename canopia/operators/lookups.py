"""Settings and lookups of the store: calibrations in force, versions, images without a plant, depth fits, grid windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.operators import evidence, planning, store

#: The sources of a calibration that a user made.
MANUAL = ("manual", "manual_transformed")


def active_calibration(calibrations: DataFrame) -> DataFrame:
    """q1: per entry the newest active one that a user made; an unknown origin is the top left."""
    rows = store.latest(calibrations.where(F.col("active") & F.col("source").isin(*MANUAL)), "entry", "created_at", "id")
    return rows.withColumn("origin", F.coalesce("origin", F.lit("top_left")))


def decoded(calibrations: DataFrame) -> DataFrame:
    """q3, fn5: each calibration, active or not, with its payload's fields; a payload that is no JSON gives none."""
    fields = F.from_json("payload", "slope double, camera string")
    return calibrations.select("id", fields["slope"].alias("slope"), F.coalesce(fields["camera"], F.lit("")).alias("camera"))


def in_force(calibrations: DataFrame) -> DataFrame:
    """cal6: whether each row is still active once every later manual row of its entry has replaced the manual ones before it; derived rows never are."""
    by = W.partitionBy("entry").orderBy(F.desc("created_at"), F.desc("id")).rowsBetween(W.unboundedPreceding, -1)
    manual = F.col("source").isin(*MANUAL)
    newer = F.coalesce(F.max(manual).over(by), F.lit(False))
    return calibrations.withColumn("in_force", manual & ~newer)


def numbered(calibrations: DataFrame) -> DataFrame:
    """cal7: each entry's versions, counted from 1 in order of creation; only the newest is active."""
    by = W.partitionBy("entry")
    version = F.row_number().over(by.orderBy("created_at", "id"))
    return calibrations.withColumns({"version": version, "current": version == F.count("*").over(by)})


def images_of(unlinked: DataFrame, entry) -> DataFrame:
    """q19: per plant the images unlinked from it under an entry, where null is an entry like others."""
    rows = unlinked.where(F.col("entry").eqNullSafe(F.lit(entry).cast("long")))
    return rows.groupBy("plant_id").agg(F.array_sort(F.collect_set("image_id")).alias("images"))


def depth_fit(stereo: DataFrame, most_residual: float = 5.0) -> DataFrame:
    """soi6: per point the line from disparity to inverse distance over the medians of its levels.

    A point needs three levels, disparities that fall as the distance grows, and
    a positive slope; `flagged` marks a residual beyond the limit.
    """
    levels = stereo.where("passes").groupBy("point_id", "level").agg(F.median("disparity").alias("d"), F.median("distance_mm").alias("far"))
    by = W.partitionBy("point_id").orderBy("far")
    levels = levels.withColumn("rises", F.coalesce(F.col("d") >= F.lag("d").over(by), F.lit(False))).withColumn("near", 1 / F.col("far"))
    fits = levels.groupBy("point_id").agg(F.count("*").alias("levels"), F.bool_or("rises").alias("rises"), F.regr_slope("near", "d").alias("slope"), F.regr_intercept("near", "d").alias("intercept"))
    fits = fits.where("levels >= 3 AND NOT rises AND slope > 0")
    miss = F.abs(1 / (F.col("slope") * F.col("d") + F.col("intercept")) - F.col("far"))
    worst = levels.join(fits, "point_id").groupBy("point_id").agg(F.max(miss).alias("residual_mm"))
    return fits.join(worst, "point_id").withColumn("flagged", F.col("residual_mm") > most_residual)


def grid_window(beds: DataFrame, targets: DataFrame) -> DataFrame:
    """q44: per target (target_id, bed_id, x, y) the rows and columns around the cell that holds it, one more on each side, within the grid.

    A target meets the columns and the rows of its bed, not their product. On a
    border between cells the first on the path counts; targets outside give none.
    """
    cells = planning.capture_grid(beds)
    bounds = planning.cell_bounds(cells, beds)
    size = cells.groupBy("bed_id").agg(F.max("row").alias("rows"), F.max("column").alias("columns"))
    places = targets.select("target_id", "bed_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    columns = bounds.groupBy("bed_id", "column").agg(F.min("x0").alias("x0"), F.min("x1").alias("x1"))
    rows = bounds.groupBy("bed_id", "row").agg(F.min("y0").alias("y0"), F.min("y1").alias("y1"))
    across = places.join(columns, "bed_id").where(F.col("_x").between(F.col("x0"), F.col("x1"))).select("target_id", "bed_id", "_y", "column")
    held = across.join(rows, "bed_id").where(F.col("_y").between(F.col("y0"), F.col("y1"))).join(cells.select("bed_id", "row", "column", "index"), ["bed_id", "row", "column"])
    first = held.groupBy("target_id", "bed_id").agg(F.min_by(F.struct("row", "column"), "index").alias("c"))
    low = lambda c: F.greatest(F.lit(0), F.col(c) - 1)
    window = [low("c.row").alias("row_min"), F.least("rows", F.col("c.row") + 1).alias("row_max"), low("c.column").alias("column_min"), F.least("columns", F.col("c.column") + 1).alias("column_max")]
    return first.join(size, "bed_id").select("target_id", "bed_id", *window)


def absences_so_far(measurements: DataFrame) -> DataFrame:
    """str6: per row how many images in a row, by image time and up to it, show no vegetation, whenever they arrived."""
    by = W.partitionBy("plant_id").orderBy("image_timestamp", "measurement_id")
    run = F.sum(F.when(F.col("vegetation_absent"), 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0))
    own = measurements.withColumn("_run", run)
    streak = F.sum(F.when(F.col("vegetation_absent"), 1).otherwise(0)).over(W.partitionBy("plant_id", "_run").orderBy("image_timestamp", "measurement_id").rowsBetween(W.unboundedPreceding, 0))
    return own.withColumn("streak", streak).drop("_run")


def explained(rows: DataFrame, heads: dict[str, tuple[dict[str, float], float]]) -> DataFrame:
    """ml6: per row the heads' chances, renormalised to one, as an array of (label, share), most likely first."""
    logit = lambda w, b: sum((F.col(k) * v for k, v in w.items()), F.lit(b))
    chance = {n: 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), logit(w, b))))) for n, (w, b) in heads.items()}
    total = sum(chance.values(), F.lit(0.0))
    pairs = F.array(*[F.struct((-c / total).alias("order"), F.lit(n).alias("label")) for n, c in chance.items()])
    return rows.withColumn("guesses", F.transform(F.array_sort(pairs), lambda p: F.struct(p["label"].alias("label"), (-p["order"]).alias("share"))))


def evidence_reasons(rows: DataFrame, hours: float = 6.0, least_quality: float = 0.12) -> DataFrame:
    """sel3: per view (plant_id, measurement_id) whether its plant's evidence uses it, and if not, why."""
    chosen = evidence.select_evidence(rows, hours, least_quality)
    used = chosen.select("plant_id", F.explode("used").alias("measurement_id"), F.lit(True).alias("used"))
    newest = F.max("image_timestamp").over(W.partitionBy("plant_id")).cast("double")
    age = (newest - F.col("image_timestamp").cast("double")) / 3600
    why = F.when(age > hours, "outside window").when(~F.col("has_evidence"), "no evidence").when(F.col("segmentation_quality") < least_quality, "low quality").otherwise("not needed")
    marked = rows.withColumn("reason", why).join(used, ["plant_id", "measurement_id"], "left").withColumn("used", F.coalesce("used", F.lit(False)))
    return marked.withColumn("reason", F.when(~F.col("used"), F.col("reason"))).select("plant_id", "measurement_id", "used", "reason")


def audit_log(decisions: DataFrame, changes: DataFrame, soil_decisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """dec17: all insert-only logs as one: kind, key, action."""
    parts = [(decisions, "decision", "measurement_id", "action"), (changes, "change", "id", "change_type"), (soil_decisions, "soil decision", "measurement_id", "action"), (proposals, "proposal", "id", "status")]
    frames = [df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), F.col(action).alias("action")) for df, kind, key, action in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """snk12: rows of each table; one partial count a partition."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out
