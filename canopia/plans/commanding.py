"""Command logs made of events and orders, each with the same fold in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.operators import commands
from canopia.plans.garden import _of

c = F.col


def _review(images):
    """Every event is a measurement of a plant; most are commands on an earlier event's measurement, too."""
    plant, radius = c("id") * 7 % 113, 40.0 + c("id") * 7 % 113 % 60
    measured = images.select(
        c("id").alias("measurement_id"), plant.alias("plant_id"), c("created_at").alias("measured_at"), (radius + F.when(c("id") % 4 == 3, 2.0).otherwise(0.0)).alias("current_mm"),
        (radius + c("id") % 13 - 4).alias("recommended_mm"), (c("id") % 11 != 0).alias("calibrated"), (c("id") % 17 != 0).alias("zone_allows"), (c("id") % 3 == 0).alias("misaligned"), (c("id") % 5 != 0).alias("centre_allows"),
    )
    action = F.get(F.array(*map(F.lit, ("approve", "approve", "approve", "move-center", "reject", "keep", "remove", "approve"))), (c("id") % 8).cast("int"))
    target = c("id") - c("id") * 31 % 700
    log = images.where("id % 6 <> 5").select(c("id").alias("command_id"), target.alias("measurement_id"), c("created_at").alias("at"), action.alias("action"))
    plants = measured.select("plant_id").distinct().where("plant_id % 19 <> 0").select("plant_id", (40.0 + c("plant_id") % 60).alias("radius_mm"))
    return commands.review(plants, measured, log).withColumn("plant_id", F.coalesce("plant_id", F.lit(-1).cast("long")))


def _repairs(points, soil):
    z = lambda k: (k * 7 % 40).cast("double")
    own = points.select(c("id").alias("point_id"), "x", "y", z(c("id")).alias("z"), F.when(c("id") % 13 != 0, F.lit("2024-01-01").cast("timestamp")).alias("updated_at"))
    k = c("measurement_id")
    point = k % 400 + 1
    px, py = (((point - 1) * m) % s for m, s in ((53, 3000), (29, 1500)))
    repairs = soil.select(
        k.alias("repair_id"), point.alias("point_id"), F.when(k % 7 == 0, "applied").otherwise("pending").alias("state"), (px + F.when(k % 9 == 0, 5.0).otherwise(0.0)).alias("expected_x"), py.cast("double").alias("expected_y"),
        z(point).alias("expected_z"), F.when(k % 4 == 0, px + 3.0).alias("new_x"), F.lit(None).cast("double").alias("new_y"), F.when(k % 10 != 0, z(point) + k % 3 * 0.06).alias("repaired_z"),
    )
    log = soil.select(k.alias("command_id"), (k - k % 2 * 400).alias("repair_id"), c("created_at").alias("at"), F.when(k % 5 == 0, "reject").otherwise("apply").alias("action"))
    return commands.repair_heights(own, repairs, log).withColumn("point_id", F.coalesce("point_id", F.lit(-1).cast("long")))


PLANS = {
    "dec9": (
        _of("images")(_review),
        """
WITH RECURSIVE me AS (
    SELECT id AS m, id * 7 % 113 AS plant, created_at AS measured_at, lead(created_at) OVER (PARTITION BY id * 7 % 113 ORDER BY created_at, id) AS next_at, 40.0::DOUBLE + id * 7 % 113 % 60 + CASE WHEN id % 4 = 3 THEN 2 ELSE 0 END AS cur,
           40.0::DOUBLE + id * 7 % 113 % 60 + id % 13 - 4 AS rec, id % 11 <> 0 AS calibrated, id % 17 <> 0 AS zone, id % 3 = 0 AS misaligned, id % 5 <> 0 AS centre FROM images),
lg AS (
    SELECT id AS command_id, id - id * 31 % 700 AS target, created_at AS at_, list_extract(['approve', 'approve', 'approve', 'move-center', 'reject', 'keep', 'remove', 'approve'], CAST(id % 8 + 1 AS INT)) AS act FROM images WHERE id % 6 <> 5),
lo AS (SELECT lg.*, me.*, ROW_NUMBER() OVER (PARTITION BY plant ORDER BY at_, command_id) AS k FROM lg JOIN me ON me.m = lg.target),
fo(plant, k, radius, settled, command_id, m, outcome, reason, before) AS (
    SELECT plant, 0::BIGINT, CASE WHEN plant % 19 <> 0 THEN 40.0::DOUBLE + plant % 60 END, TIMESTAMP '1900-01-01 00:00:00', NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE FROM lo GROUP BY plant
    UNION ALL
    SELECT plant, k, CASE v[1] WHEN 'applied' THEN rec WHEN 'removed' THEN NULL ELSE radius END, CASE WHEN v[1] IN ('conflict', 'center_moved') THEN settled ELSE at_ END, command_id, m, v[1], v[2], radius
    FROM (SELECT lo.*, fo.radius, fo.settled,
                 CASE WHEN measured_at > at_ THEN ['conflict', 'no measurement'] WHEN measured_at <= settled THEN ['conflict', 'reviewed'] WHEN act = 'reject' THEN ['rejected', NULL]
                      WHEN act IN ('remove', 'keep') AND coalesce(next_at <= at_, false) THEN ['conflict', 'newer measurement'] WHEN act = 'keep' THEN ['kept', NULL] WHEN radius IS NULL THEN ['conflict', 'no plant']
                      WHEN act = 'remove' THEN ['removed', NULL] WHEN act = 'move-center' THEN CASE WHEN misaligned AND centre THEN ['center_moved', NULL] WHEN misaligned THEN ['conflict', 'zone'] ELSE ['conflict', 'no centre'] END
                      WHEN NOT calibrated THEN ['conflict', 'calibration'] WHEN rec = cur THEN ['approved_no_change', NULL] WHEN abs(rec - cur) < 3 THEN ['conflict', 'small change'] WHEN NOT zone THEN ['conflict', 'zone']
                      WHEN abs(radius - cur) <= 0.1 THEN ['applied', NULL] ELSE ['conflict', 'changed'] END AS v
          FROM fo JOIN lo ON lo.plant = fo.plant AND lo.k = fo.k + 1))
SELECT command_id, plant AS plant_id, m AS measurement_id, outcome, reason, before AS before_mm, radius AS after_mm FROM fo WHERE k > 0
UNION ALL SELECT command_id, -1, target, 'conflict', 'no measurement', NULL, NULL FROM lg WHERE target NOT IN (SELECT m FROM me)""",
    ),
    "soi11": (
        _of("soil_points", "soil_measurements")(_repairs),
        """
WITH RECURSIVE re AS (
    SELECT measurement_id AS r, measurement_id % 400 + 1 AS point, measurement_id % 7 <> 0 AS pending, (measurement_id % 400 * 53) % 3000 + CASE WHEN measurement_id % 9 = 0 THEN 5.0 ELSE 0 END AS ex, (measurement_id % 400 * 29) % 1500 AS ey,
           (measurement_id % 400 + 1) * 7 % 40 AS ez, CASE WHEN measurement_id % 4 = 0 THEN (measurement_id % 400 * 53) % 3000 + 3.0 END AS nx,
           CASE WHEN measurement_id % 10 <> 0 THEN CAST((measurement_id % 400 + 1) * 7 % 40 AS DOUBLE) + measurement_id % 3 * 0.06::DOUBLE END AS nz FROM soil_measurements),
lg AS (SELECT measurement_id AS command_id, measurement_id - measurement_id % 2 * 400 AS target, created_at AS at_, measurement_id % 5 = 0 AS rejects FROM soil_measurements),
lo AS (SELECT lg.*, re.*, ROW_NUMBER() OVER (PARTITION BY point ORDER BY at_, command_id) AS k FROM lg JOIN re ON re.r = lg.target),
fo(point, k, x, y, z, dated, done, cid, rid, outcome, reason, before) AS (
    SELECT lo.point, 0::BIGINT, any_value(p.x), any_value(p.y), any_value(CAST(p.id * 7 % 40 AS DOUBLE)), any_value(p.id % 13 <> 0), [-1::BIGINT], NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE
    FROM lo LEFT JOIN soil_points p ON p.id = lo.point GROUP BY lo.point
    UNION ALL
    SELECT point, k, CASE WHEN v[1] = 'applied' THEN coalesce(nx, x) ELSE x END, y, CASE WHEN v[1] = 'applied' THEN nz ELSE z END, dated, CASE WHEN v[1] = 'ignored' THEN done ELSE list_append(done, r) END, command_id, r, v[1], v[2], z
    FROM (SELECT lo.*, x, y, z, dated, done,
                 CASE WHEN NOT pending OR list_contains(done, r) THEN ['ignored', 'not pending'] WHEN rejects THEN ['rejected', NULL] WHEN nz IS NULL THEN ['ignored', 'nothing to apply']
                      WHEN NOT coalesce(dated, false) THEN ['conflict', 'missing or undated'] WHEN abs(x - ex) <= 0.1 AND abs(y - ey) <= 0.1 AND abs(z - ez) <= 0.1 THEN ['applied', NULL] ELSE ['conflict', 'changed'] END AS v
          FROM fo JOIN lo ON lo.point = fo.point AND lo.k = fo.k + 1))
SELECT cid AS command_id, point AS point_id, rid AS repair_id, outcome, reason, before AS z_before, z AS z_after FROM fo WHERE k > 0
UNION ALL SELECT command_id, -1, target, 'ignored', 'not pending', NULL, NULL FROM lg WHERE target NOT IN (SELECT r FROM re)""",
    ),
}
