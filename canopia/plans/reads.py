"""Reads of the garden store: pending, newest and unlabelled rows, repairs and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.operators import geometry, store
from canopia.plans.garden import _PENDING, _TERMINAL, _of

_TIE = "ORDER BY image_timestamp DESC, measurement_id DESC"
_USABLE = "status IN ('valid', 'applied') AND proposed_z_mm IS NOT NULL"
_NEARBY = """
SELECT s.id FROM sites s
WHERE EXISTS (
    SELECT 1 FROM detections d
    WHERE abs(s.x - d.x) <= 60 AND abs(s.y - d.y) <= 60
    AND ({standing} AND sqrt((s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y)) <= 20
         OR d.status IN ({judged}) AND d.image_id = s.image_id
            AND sqrt((s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y)) <= greatest(20, 1.5 * d.radius_mm)))"""


PLANS = {
    "q4": (_of("measurements")(lambda m: store.newest_mask(m).select("plant_id", "measurement_id")),
           f"SELECT plant_id, measurement_id FROM measurements WHERE NOT vegetation_absent QUALIFY ROW_NUMBER() OVER (PARTITION BY plant_id {_TIE}) = 1"),
    "q5": (_of("measurements")(store.seen_present),
           "SELECT plant_id, bool_or(NOT vegetation_absent) AS present FROM measurements GROUP BY plant_id"),
    "q6": (_of("measurements")(lambda m: store.crop_observations(m).select("measurement_id", "plant_id", "recommended_mm")),
           "SELECT measurement_id, plant_id, recommended_mm FROM measurements WHERE confidence >= 0.6"),
    "q9": (_of("measurements", "decisions")(lambda m, d: store.has_terminal(m, d).select("measurement_id")),
           f"SELECT measurement_id FROM measurements WHERE measurement_id IN (SELECT measurement_id FROM decisions WHERE action IN ({_TERMINAL}))"),
    "q10": (_of("measurements")(lambda m: store.latest(m, "plant_id", "image_timestamp", "measurement_id").select("plant_id", "measurement_id")),
            f"SELECT plant_id, measurement_id FROM measurements QUALIFY ROW_NUMBER() OVER (PARTITION BY plant_id {_TIE}) = 1"),
    "q11": (_of("detections")(lambda d: store.recent(d.where("status IN ('recommended', 'observing')"), "image_timestamp", "detection_id", 100).select("detection_id", "status")),
            "SELECT detection_id, status FROM detections WHERE status IN ('recommended', 'observing') ORDER BY image_timestamp DESC, detection_id DESC LIMIT 100"),
    "q14": (_of("detections")(lambda d: d.where("status IN ('recommended', 'created')").select("detection_id", "x", "y", "radius_mm")),
            "SELECT detection_id, x, y, radius_mm FROM detections WHERE status IN ('recommended', 'created')"),
    "q31": (_of("measurements", "decisions")(lambda m, d: store.pending_of(m, d, [1, 2, 3, 5, 8, 13, 21]).select("plant_id", "image_id", "measurement_id")),
            f"WITH {_PENDING} SELECT plant_id, image_id, measurement_id FROM p WHERE image_id IN (1, 2, 3, 5, 8, 13, 21) QUALIFY ROW_NUMBER() OVER (PARTITION BY plant_id, image_id {_TIE}) = 1"),
    "q34": (_of("soil_measurements", "legacy_repairs")(lambda s, r: store.unprocessed_repairs(s, r).select("measurement_id")),
            f"SELECT measurement_id FROM soil_measurements LEFT JOIN legacy_repairs ON legacy_measurement_id = measurement_id WHERE {_USABLE} AND legacy_measurement_id IS NULL"),
    "q35": (_of("soil_measurements", "legacy_repairs")(lambda s, r: store.pending_repairs(s, r).select("measurement_id", "point_id", "delta_mm")),
            "SELECT measurement_id, point_id, delta_mm FROM soil_measurements JOIN legacy_repairs ON legacy_measurement_id = measurement_id WHERE state = 'pending'"),
    "q36": (_of("labelled", "detections")(lambda s, d: s.join(d.select("detection_id", "image_id"), "detection_id", "left").select("detection_id", "label", "image_id")),
            "SELECT detection_id, label, image_id FROM labelled LEFT JOIN detections USING (detection_id)"),
    "q37": (_of("detections", "labelled")(lambda d, s: store.recent(d.where("has_crop").join(s, "detection_id", "left_anti"), "image_timestamp", "detection_id", 200).select("detection_id")),
            "SELECT detection_id FROM detections d WHERE has_crop AND NOT EXISTS (SELECT 1 FROM labelled s WHERE s.detection_id = d.detection_id) ORDER BY image_timestamp DESC, detection_id DESC LIMIT 200"),
    "q38": (_of("measurements")(lambda m: store.current_plants(m).select("plant_id", "measurement_id", "radius_mm")),
            "SELECT plant_id, measurement_id, greatest(current_radius_mm, recommended_mm) AS radius_mm FROM measurements m WHERE NOT vegetation_absent AND image_timestamp = (SELECT max(image_timestamp) FROM measurements n WHERE n.plant_id = m.plant_id)"),
    "q39": (_of("sites", "detections")(lambda w, d: geometry.near_detection(w, d, ("created",), ("rejected", "dismissed")).select("id")),
            _NEARBY.format(standing="d.status = 'created' AND epoch(s.image_timestamp) - epoch(d.image_timestamp) <= 24 * 3600", judged="'rejected', 'dismissed'")),
    "q40": (_of("sites", "detections")(lambda w, d: geometry.near_detection(w, d, ("recommended", "created"), ("rejected",)).select("id")),
            _NEARBY.format(standing="(d.status = 'recommended' OR d.status = 'created' AND epoch(s.image_timestamp) - epoch(d.image_timestamp) <= 24 * 3600)", judged="'rejected'")),
    "agg4": (_of("labelled", "detections")(lambda s, d: store.labels_since(s, d.where("status = 'created'").selectExpr("detection_id AS id", "image_id AS sample_count"))),
             "SELECT greatest(0, (SELECT count(*) FROM labelled) - coalesce((SELECT image_id FROM detections WHERE status = 'created' ORDER BY detection_id DESC LIMIT 1), 0)) AS fresh"),
    "agg5": (_of("soil_measurements", "legacy_repairs")(store.repair_summary),
             f"SELECT e AS eligible, greatest(0, e - n) AS unprocessed, {', '.join(store.STATES)}, e > 0 AND n >= e AND pending = 0 AS retired FROM (SELECT count(*) AS e FROM soil_measurements WHERE {_USABLE}), (SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in store.STATES) + " FROM legacy_repairs)"),
    "set1": (_of("soil_measurements", "soil_decisions", "legacy_repairs")(lambda s, d, r: store.height_changes(s, d, r).select("measurement_id", "new_z_mm", "method")),
             "SELECT measurement_id, new_z_mm, method FROM (SELECT d.measurement_id, d.created_at, proposed_z_mm AS new_z_mm, CASE WHEN action = 'automatic_approve' THEN 'automatic' ELSE 'user' END AS method FROM soil_decisions d JOIN soil_measurements USING (measurement_id) WHERE action IN ('approve', 'automatic_approve') UNION ALL SELECT d.measurement_id, d.created_at, proposed_z_mm + delta_mm, 'user' FROM soil_decisions d JOIN soil_measurements USING (measurement_id) JOIN legacy_repairs r ON r.legacy_measurement_id = d.measurement_id WHERE action = 'legacy_v2_repair_apply') ORDER BY created_at DESC, measurement_id DESC LIMIT 100"),
    "win6": (_of("images")(lambda i: store.time_clusters(i.selectExpr("id", "id % 31 AS camera", "created_at"), "camera").groupBy("camera", "anchor").agg(F.count("*").alias("images")).select("camera", "anchor", "images")),
             """WITH RECURSIVE i AS (SELECT id % 31 AS camera, CAST(floor(epoch(created_at)) AS BIGINT) AS t FROM images),
c(camera, anchor) AS (SELECT camera, min(t) FROM i GROUP BY camera UNION ALL SELECT camera, anchor FROM (SELECT c.camera, (SELECT min(t) FROM i WHERE i.camera = c.camera AND i.t > c.anchor + 3600) AS anchor FROM c) WHERE anchor IS NOT NULL)
SELECT c.camera, c.anchor, count(*) AS images FROM c JOIN i ON i.camera = c.camera AND i.t BETWEEN c.anchor AND c.anchor + 3600 GROUP BY c.camera, c.anchor"""),
    "win11": (_of("detections")(lambda d: d.where("has_crop").orderBy(F.abs(F.col("score") - 0.5), "detection_id").limit(8).select("detection_id", "score")),
              "SELECT detection_id, score FROM detections WHERE has_crop ORDER BY abs(score - 0.5), detection_id LIMIT 8"),
    "win13": (_of("soil_points")(lambda p: p.withColumn("d", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).orderBy("d", "id").limit(200).select("id", F.round("d", 6).alias("distance_mm"))),
              "SELECT id, round(sqrt(x * x + y * y), 6) AS distance_mm FROM soil_points ORDER BY sqrt(x * x + y * y), id LIMIT 200"),
}
