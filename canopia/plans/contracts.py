"""Checks of image metadata and writes, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.operators import contracts, store
from canopia.plans.garden import _of

_COLUMNS = ("measurement_id", "plant_id", "image_id", "recommended_mm")


def _write(stored, views, decisions):
    fresh = views.where("has_evidence").withColumn("recommended_mm", F.col("recommended_mm") + 1)
    return contracts.written(stored.select(*_COLUMNS), fresh.select(*_COLUMNS), decisions).select("measurement_id", "recommended_mm", "superseded")


def _fused(views):
    edges = store.latest(views.where("fusion_reliable AND fused_mm IS NOT NULL"), "plant_id", "image_timestamp", "measurement_id")
    values = edges.select("plant_id", "fused_mm", "fused_confidence")
    return contracts.set_values(views, values, "plant_id", F.col("has_evidence")).select("measurement_id", F.coalesce("fused_mm", F.lit(-1.0)).alias("fused_mm"), "fused_confidence")


PLANS = {
    "cal1": (
        _of("contracts")(lambda c: c.select("id", contracts.processed_verdict().alias("verdict"))),
        """
SELECT id, CASE WHEN NOT coalesce(available, false) THEN 'none' WHEN basis IS DISTINCT FROM 'processed_image' THEN 'basis'
                WHEN p_width IS DISTINCT FROM width OR p_height IS DISTINCT FROM height THEN 'dimensions'
                WHEN NOT coalesce(ppm_x > 0 AND ppm_y > 0, false) THEN 'scales' ELSE 'used' END AS verdict
FROM contracts""",
    ),
    "cal8": (
        _of("contracts")(lambda c: c.select("id", F.coalesce(contracts.dimension_fault(), F.lit("sound")).alias("verdict"))),
        """
WITH k AS (SELECT *, width / oriented_width AS ex, height / oriented_height AS ey FROM contracts)
SELECT id, CASE
    WHEN coalesce(source_width, source_height, oriented_width, oriented_height, scale_x, scale_y) IS NULL THEN 'sound'
    WHEN source_width IS NULL OR source_height IS NULL OR oriented_width IS NULL OR oriented_height IS NULL OR scale_x IS NULL OR scale_y IS NULL THEN 'incomplete'
    WHEN scale_x <= 0 OR scale_y <= 0 THEN 'scale not positive'
    WHEN least(source_width, source_height) <> least(oriented_width, oriented_height) OR greatest(source_width, source_height) <> greatest(oriented_width, oriented_height) THEN 'not a rotation'
    WHEN width > oriented_width OR height > oriented_height THEN 'upscaled'
    WHEN abs(scale_x - ex) > CAST(0.03 AS DOUBLE) * ex + CAST(1e-6 AS DOUBLE) THEN 'scale_x inconsistent'
    WHEN abs(scale_y - ey) > CAST(0.03 AS DOUBLE) * ey + CAST(1e-6 AS DOUBLE) THEN 'scale_y inconsistent'
    WHEN abs(scale_x - scale_y) > CAST(0.03 AS DOUBLE) * greatest(scale_x, scale_y) THEN 'distorted' ELSE 'sound' END AS verdict
FROM k""",
    ),
    "can5": (
        _of("viewings")(_fused),
        """
WITH e AS (
    SELECT plant_id, fused_mm AS mm, fused_confidence AS sure FROM viewings WHERE fusion_reliable AND fused_mm IS NOT NULL
    QUALIFY ROW_NUMBER() OVER (PARTITION BY plant_id ORDER BY image_timestamp DESC, measurement_id DESC) = 1)
SELECT measurement_id, coalesce(CASE WHEN has_evidence AND mm IS NOT NULL THEN mm ELSE fused_mm END, -1) AS fused_mm,
       CASE WHEN has_evidence AND mm IS NOT NULL THEN sure ELSE fused_confidence END AS fused_confidence
FROM viewings LEFT JOIN e USING (plant_id)""",
    ),
    "dec15": (
        _of("measurements", "viewings", "decisions")(_write),
        """
WITH r AS (SELECT m.measurement_id, m.plant_id, m.image_id, CASE WHEN v.has_evidence THEN v.recommended_mm + 1 ELSE m.recommended_mm END AS recommended_mm FROM measurements m JOIN viewings v USING (measurement_id))
SELECT measurement_id, recommended_mm,
       measurement_id < max(measurement_id) OVER (PARTITION BY plant_id, image_id) OR measurement_id IN (SELECT measurement_id FROM decisions WHERE action = 'superseded') AS superseded
FROM r""",
    ),
}
