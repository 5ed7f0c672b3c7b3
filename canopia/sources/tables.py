"""Garden views over the given tables, as DataFrames (Spark SQL) and for DuckDB.

Integer arithmetic only where rows are derived, so that both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The views by name; the text runs unchanged in Spark (session zone UTC) and in DuckDB.
VIEWS = {
    "plants": "SELECT p_partkey + 1 AS id, p_type AS crop, CAST((p_partkey * 37) % 3000 AS DOUBLE) AS x, CAST((p_partkey * 91) % 1500 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS radius, CAST((p_partkey * 13) % 90 AS INT) AS age_days, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size * 10 AS DOUBLE) END AS height_mm FROM part",
    "weeds": "SELECT s_suppkey + 1 AS id, CAST((s_suppkey * 211) % 3000 AS DOUBLE) AS x, CAST((s_suppkey * 131) % 1500 AS DOUBLE) AS y, CAST(10 + s_nationkey AS DOUBLE) AS radius FROM supplier",
    "soil_points": "SELECT c_custkey + 1 AS id, CAST((c_custkey * 53) % 3000 AS DOUBLE) AS x, CAST((c_custkey * 29) % 1500 AS DOUBLE) AS y, round(c_acctbal / 100.0, 2) AS z FROM customer",
    "images": "SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS created_at, CAST((event_id % 11) * 373 AS DOUBLE) AS x, CAST((CAST(floor(event_id / 11.0) AS BIGINT) % 7) * 294 AS DOUBLE) AS y, event_type <> 'signup' AS processed FROM events",
    "measurements": "SELECT event_id AS measurement_id, user_id AS plant_id, event_id % 97 AS image_id, CAST(ts AS TIMESTAMP) AS image_timestamp, CAST(40 + user_id % 60 AS DOUBLE) AS current_radius_mm, value / 2 AS recommended_mm, CAST((event_id * 31) % 100 AS DOUBLE) / 100 AS confidence, CAST(event_id % 20 + 1 AS DOUBLE) / 20 AS visible_fraction, event_type = 'error' AS vegetation_absent FROM events",
    "decisions": "SELECT event_id AS measurement_id, CASE event_id % 5 WHEN 0 THEN 'applied' WHEN 1 THEN 'reject' WHEN 2 THEN 'curve_flagged' WHEN 3 THEN 'keep' ELSE 'note' END AS action FROM events WHERE event_id % 3 = 0",
    "soil_measurements": "SELECT o_orderkey AS measurement_id, o_custkey % 200 AS point_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'valid' ELSE 'applied' END AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST((o_orderkey * 17) % 3000 AS DOUBLE) AS capture_x, CAST((o_orderkey * 7) % 1500 AS DOUBLE) AS capture_y, o_totalprice / 1000 AS proposed_z_mm FROM orders",
    "change_log": "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS entity_id, CASE l_returnflag WHEN 'A' THEN 'radius increased' WHEN 'R' THEN 'radius decreased' ELSE 'weed added' END AS change_type, CAST(l_shipdate AS TIMESTAMP) AS created_at, CAST(l_quantity AS DOUBLE) AS original_radius_mm FROM lineitem",
    "training": "SELECT l.doc_id, CASE WHEN l.toxic = 1 THEN 'weed' WHEN l.quality = 1 THEN 'crop' ELSE 'soil' END AS label, CAST(d.n_chars AS DOUBLE) AS f1, d.doc_id % 50 AS image_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id",
    "detections": "SELECT event_id AS detection_id, event_id % 211 AS image_id, CAST(ts AS TIMESTAMP) AS image_timestamp, CAST((event_id * 211) % 3000 AS DOUBLE) AS x, CAST((event_id * 131) % 1500 AS DOUBLE) AS y, CAST(8 + event_id % 25 AS DOUBLE) AS radius_mm, CAST((event_id * 17) % 1000 AS DOUBLE) / 1000 AS score, event_id % 9 <> 0 AS has_crop, CASE event_id % 6 WHEN 0 THEN 'created' WHEN 1 THEN 'rejected' WHEN 2 THEN 'dismissed' WHEN 3 THEN 'recommended' WHEN 4 THEN 'observing' ELSE 'superseded' END AS status FROM events",
    "labelled": "SELECT event_id AS detection_id, CASE event_id % 3 WHEN 0 THEN 'weed' WHEN 1 THEN 'crop' ELSE 'soil' END AS label FROM events WHERE event_id % 4 = 1",
    "soil_decisions": "SELECT o_orderkey AS measurement_id, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY AS created_at, CASE o_orderkey % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'automatic_approve' WHEN 2 THEN 'legacy_v2_repair_apply' ELSE 'automatic_retry_started' END AS action FROM orders WHERE o_orderkey % 3 = 0",
    "legacy_repairs": "SELECT o_orderkey AS legacy_measurement_id, CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderkey % 41 - 20 AS DOUBLE) AS delta_mm, CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'applied' WHEN 4 THEN 'rejected' ELSE 'conflict' END AS state FROM orders WHERE o_orderkey % 5 = 0",
    "growth": "SELECT event_id AS id, user_id % 13 AS crop, CAST(event_id % 90 AS INT) AS age_days, CAST(10 + event_id % 90 AS DOUBLE) + value / 10 AS radius FROM events",
    "foliage": "SELECT l_partkey % 20 AS plant_id, (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 72 AS sector, CAST(l_quantity AS DOUBLE) + CASE WHEN (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 72 < (l_partkey % 20) THEN 60 ELSE 0 END AS distance_mm FROM lineitem",
    "beds": "SELECT s_suppkey AS bed_id, CAST(1000 + (s_suppkey * 37) % 2000 AS DOUBLE) AS width_mm, CAST(500 + (s_suppkey * 91) % 1000 AS DOUBLE) AS depth_mm, CAST(300 + s_suppkey % 90 AS DOUBLE) AS frame_x, CAST(200 + s_suppkey % 70 AS DOUBLE) AS frame_y FROM supplier",
    "cases": "SELECT event_id AS measurement_id, event_id % 11 <> 0 AS calibrated, event_type = 'error' AS absent, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 90 END AS age_days, CAST(20 + user_id % 90 AS DOUBLE) AS current_mm, CAST(20 + (event_id * 7) % 120 AS DOUBLE) AS proposed_mm, event_id % 5 <> 0 AS seen_before, event_id % 4 AS streak, CAST((event_id * 31) % 100 AS DOUBLE) / 100 AS confidence, event_id % 3 = 0 AS misaligned, event_id % 17 = 0 AS ambiguous, event_id % 6 AS days FROM events",
    "sightings": "SELECT event_id AS measurement_id, user_id AS plant_id, CAST(ts AS TIMESTAMP) AS image_timestamp, event_type <> 'error' AS has_evidence, event_id % 3 <> 0 AS center_visible, event_id % 4 = 0 AS truncated, user_id % 5 <> 0 AS fits, CAST((event_id * 37) % 101 AS DOUBLE) / 100 AS coverage, CAST((event_id * 31) % 100 AS DOUBLE) / 100 AS confidence, CAST((event_id * 13) % 100 AS DOUBLE) / 100 AS image_quality, CAST((event_id * 7) % 100 AS DOUBLE) / 100 AS segmentation_quality, CAST((event_id * 53) % 72 AS INT) AS first_sector FROM events",
    "traits": "SELECT l.doc_id, l.quality, d.doc_id % 97 AS image_id, CAST(d.n_chars AS DOUBLE) / 1000 AS f1, CAST(length(regexp_replace(d.text, '[^0-9]', '')) AS DOUBLE) / greatest(1, length(d.text)) AS f2, CAST(length(regexp_replace(d.text, '[a-z ]', '')) AS DOUBLE) / greatest(1, length(d.text)) AS f3 FROM labels l JOIN documents d ON d.doc_id = l.doc_id",
    "sites": """
        SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS image_timestamp, (event_id - (event_id % 4 + 2)) % 211 AS image_id,
               CAST(((event_id - (event_id % 4 + 2)) * 211) % 3000 AS DOUBLE) + 9 AS x, CAST(((event_id - (event_id % 4 + 2)) * 131) % 1500 AS DOUBLE) + 12 AS y
        FROM events""",
    "unlinked": """
        SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 END AS entry, user_id AS plant_id, event_id % 97 AS image_id FROM events""",
    "proposals": """
        SELECT event_id AS id, user_id % 13 AS crop, CAST(ts AS TIMESTAMP) AS created_at, value AS diameter_mm,
               CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'applied' WHEN 2 THEN 'rejected' ELSE 'flagged' END AS status FROM events""",
    "calibrations": """
        SELECT o_orderkey AS id, o_custkey % 50 AS entry, CAST(o_orderdate AS TIMESTAMP) AS created_at, o_orderkey % 3 <> 0 AS active,
               CASE o_orderkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'manual_transformed' WHEN 2 THEN 'integration' ELSE 'reference' END AS source,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'bottom_right' END AS origin,
               CAST(o_orderkey % 40 + 10 AS DOUBLE) / 20 AS ppm, CAST(o_orderkey % 7 AS DOUBLE) / 10 AS mm_per_pixel,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CASE o_orderkey % 3 WHEN 0 THEN 640 WHEN 1 THEN 960 ELSE 720 END END AS width,
               CASE o_orderkey % 3 WHEN 0 THEN 480 WHEN 1 THEN 720 ELSE 960 END AS height,
               CASE WHEN o_orderkey % 6 = 0 THEN 'broken' WHEN o_orderkey % 6 = 1 THEN NULL ELSE '{"slope": ' || CAST(o_orderkey % 9 AS VARCHAR(20)) || ', "camera": "c' || CAST(o_orderkey % 4 AS VARCHAR(20)) || '"}' END AS payload
        FROM orders""",
    "viewings": """
        SELECT event_id AS measurement_id, user_id AS plant_id, event_id % 97 AS image_id,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * (event_id * 37 % 43200) AS image_timestamp,
               CAST(40 + user_id % 60 AS DOUBLE) AS current_radius_mm, value / 2 AS recommended_mm,
               CAST((event_id * 31) % 100 AS DOUBLE) / 100 AS confidence, CAST(event_id % 20 + 1 AS DOUBLE) / 20 AS visible_fraction,
               event_type = 'error' AS vegetation_absent, event_type <> 'error' AND user_id % 7 <> 0 AS has_evidence,
               event_id % 3 <> 0 AS center_visible, event_id % 4 = 0 AS truncated, user_id % 5 <> 0 AS fits,
               CAST((event_id * 37) % 101 AS DOUBLE) / 100 AS coverage, CAST((event_id * 13) % 100 AS DOUBLE) / 100 AS image_quality,
               CAST((event_id * 7) % 100 AS DOUBLE) / 100 AS segmentation_quality, CAST((event_id * 53) % 72 AS INT) AS first_sector,
               CASE WHEN event_id % 11 = 0 THEN value / 2 + 5 END AS fused_mm, CAST(40 + event_id % 50 AS DOUBLE) / 100 AS fused_confidence, event_id % 2 = 0 AS fusion_reliable
        FROM events""",
    "grid_images": """
        SELECT CAST(floor(event_id / 100.0) AS BIGINT) % 25 AS entry, event_id AS id,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * (event_id * 97 + CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 7200 ELSE 0 END) AS created_at,
               CAST((CASE WHEN event_type IN ('error', 'signup') AND event_id % 2 = 1 THEN event_id - 1 ELSE event_id END % 6) * 200 + CAST(floor(event_id / 7.0) AS BIGINT) % 3 AS DOUBLE) AS x,
               CAST((CAST(floor(event_id / 6.0) AS BIGINT) % 5) * 150 + event_id % 4 AS DOUBLE) AS y, CAST(event_id % 5 AS DOUBLE) AS z, event_id % 13 = 0 AS gantry
        FROM events""",
    "grid_repairs": """
        SELECT CAST(floor(event_id / 100.0) AS BIGINT) % 25 AS entry, event_id AS id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * (event_id * 97 - 3600) AS run_started_at
        FROM events WHERE event_type = 'error' AND event_id % 2 = 0""",
    "frames": """
        SELECT CAST(floor(event_id / 40.0) AS BIGINT) AS run, event_id AS seq, CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_id * 3 END AS image_id,
               CAST((event_id * 7 % 6) * 200 + event_id % 17 AS DOUBLE) AS x, CAST((event_id * 11 % 5) * 150 + event_id % 23 AS DOUBLE) AS y, CAST(event_id % 9 AS DOUBLE) AS z,
               CASE WHEN event_type = 'click' THEN event_id * 13 % 33 END AS declared
        FROM events""",
    "capture_cells": """
        SELECT event_id % 77 AS cell, CAST((event_id % 11) * 373 AS DOUBLE) AS x, CAST((CAST(floor((event_id % 77) / 11.0) AS BIGINT) % 7) * 294 AS DOUBLE) AS y,
               CASE max(event_id) % 5 WHEN 0 THEN 'blurry' ELSE 'usable' END AS issue
        FROM events GROUP BY 1, 2, 3""",
    "blobs": """
        SELECT event_id AS blob, event_id * 31 % 77 AS cell, CAST((event_id * 17) % 1000 AS DOUBLE) / 1000 AS u, CAST((event_id * 29) % 1000 AS DOUBLE) / 1000 AS v,
               CAST(8 + event_id % 25 AS DOUBLE) / 4000 AS area_fraction
        FROM events""",
    "qualities": """
        SELECT event_id AS image_id, CAST(floor(event_id / 77.0) AS BIGINT) AS run, CAST(floor((event_id % 77) / 11.0) AS BIGINT) AS cell_y, event_id % 11 AS cell_x,
               CASE event_id * 5 % 13 WHEN 0 THEN 'washed_out' WHEN 1 THEN 'leaf_obstruction' WHEN 2 THEN 'blurry' ELSE 'usable' END AS issue,
               CAST(event_id * 37 % 300 AS DOUBLE) / 2 AS laplacian, CAST(event_id * 41 % 100 AS DOUBLE) / 500 AS edges, CAST(event_id * 7 % 50 AS DOUBLE) / 400 AS contrast,
               CAST(event_id * 3 % 10 AS DOUBLE) / 20 AS blur, CAST(event_id * 3 % 7 AS DOUBLE) / 7 AS clear, CAST(event_id * 11 % 5 AS DOUBLE) / 5 AS obstruction,
               CAST(event_id * 13 % 9 AS DOUBLE) / 9 AS vegetation, CAST(event_id * 17 % 100 AS DOUBLE) / 100 AS sharpness
        FROM events""",
    "stereo_pairs": """
        SELECT l_orderkey * 100 + CAST(floor(n / 3.0) AS BIGINT) AS measurement_id, n % 3 AS pair, l_partkey % 6 <> 0 AS passes,
               CAST(180 + (l_orderkey * 7 + n * 3) % 40 * CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END + l_suppkey % 4 AS DOUBLE) / 20 - CASE WHEN l_partkey % 31 = 0 THEN 20 ELSE 0 END AS disparity,
               CAST(l_partkey % 50 AS DOUBLE) / 100 AS coverage, CAST(50 + l_partkey % 50 AS DOUBLE) / 100 AS support,
               CAST(l_partkey % 15 AS DOUBLE) / 10 AS lr_error, CAST(l_partkey % 20 AS DOUBLE) / 10 AS mad,
               CAST(100 + l_orderkey % 50 AS DOUBLE) AS camera_z, CAST(l_orderkey % 12 AS DOUBLE) / 10 AS z_spread
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n FROM lineitem) l""",
    "photo_pixels": """
        SELECT image_id, x, y, CASE WHEN k < 2 THEN 40 + n WHEN k = 2 THEN 185 + n % 9 ELSE 50 + n END AS b,
               CASE WHEN k < 2 THEN 140 + n * 2 WHEN k = 2 THEN 195 + n % 10 ELSE 60 + n END AS g, CASE WHEN k < 2 THEN 60 + n * 2 WHEN k = 2 THEN 188 + n % 12 ELSE 80 + n END AS r
        FROM (SELECT image_id, x, y, (CAST(floor((x + image_id) / 6.0) AS BIGINT) * 37 + CAST(floor(y / 5.0) AS BIGINT) * 53 + image_id * 29 + CASE WHEN n % 11 = 0 THEN 3 ELSE 0 END) % 7 AS k, n
              FROM (SELECT CAST(floor(event_id / 3072.0) AS BIGINT) AS image_id, event_id % 64 AS x, CAST(floor((event_id % 3072) / 64.0) AS BIGINT) AS y, (event_id * 7919) % 41 AS n FROM events) p) q""",
    "photo_plants": """
        SELECT CAST(floor(event_id / 3072.0) AS BIGINT) AS image_id, event_id AS plant_id, CAST((event_id * 37) % 80 - 8 AS DOUBLE) AS cx, CAST((event_id * 53) % 60 - 6 AS DOUBLE) AS cy,
               CAST(4 + event_id % 29 AS DOUBLE) AS radius_mm
        FROM events WHERE event_id % 512 = 7""",
    "contracts": """
        SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 640 WHEN 1 THEN 960 WHEN 2 THEN 720 ELSE CASE WHEN o_custkey % 5 = 0 THEN 2000 ELSE 1280 END END AS width,
               CASE o_orderkey % 4 WHEN 0 THEN 480 WHEN 1 THEN CASE WHEN o_custkey % 7 = 0 THEN 1270 ELSE 1280 END WHEN 2 THEN 960 ELSE 960 END AS height,
               CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 1280 END AS source_width, CASE WHEN o_custkey % 11 = 0 AND o_custkey % 2 = 0 THEN NULL ELSE 960 END AS source_height,
               CASE WHEN o_custkey % 22 = 0 THEN NULL WHEN o_orderkey % 2 = 1 AND o_orderkey % 4 = 1 THEN 960 ELSE 1280 END AS oriented_width,
               CASE WHEN o_custkey % 22 = 0 THEN NULL WHEN o_custkey % 13 = 0 THEN 1000 WHEN o_orderkey % 4 = 1 THEN 1280 ELSE 960 END AS oriented_height,
               CASE WHEN o_custkey % 22 = 0 THEN NULL WHEN o_custkey % 17 = 0 THEN 0e0 ELSE CASE o_orderkey % 4 WHEN 0 THEN 5e-1 WHEN 2 THEN 5625e-4 ELSE 1e0 END * (100 + o_custkey % 9 - 4) / 100 END AS scale_x,
               CASE WHEN o_custkey % 22 = 0 THEN NULL ELSE CASE o_orderkey % 4 WHEN 0 THEN 5e-1 ELSE 1e0 END * (100 + o_orderkey % 7 - 3) / 100 END AS scale_y,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 10 <> 0 END AS available, CASE WHEN o_custkey % 6 = 0 THEN 'source_image' ELSE 'processed_image' END AS basis,
               CASE WHEN o_custkey % 8 = 0 THEN NULL ELSE CASE o_orderkey % 4 WHEN 0 THEN 640 WHEN 1 THEN 960 WHEN 2 THEN 720 ELSE 1280 END END AS p_width,
               CASE o_orderkey % 4 WHEN 0 THEN 480 WHEN 1 THEN 1280 ELSE 960 END AS p_height, CAST(o_custkey % 5 AS DOUBLE) / 4 AS ppm_x, CAST(o_custkey % 7 - 1 AS DOUBLE) / 4 AS ppm_y
        FROM (SELECT o_orderkey, o_custkey FROM orders) o""",
    "stereo": """
        SELECT o_orderkey AS id, o_custkey % 400 AS point_id, o_orderkey % 5 AS level, CAST(100 + 40 * (o_orderkey % 5) AS DOUBLE) AS distance_mm,
               1000.0 / (100 + 40 * (o_orderkey % 5)) + CAST(o_orderkey % 7 AS DOUBLE) / 50 AS disparity, o_orderstatus <> 'F' AS passes
        FROM orders""",
}
#: Which given tables a view reads.
READS = {"photo_pixels": ["events"], "photo_plants": ["events"], "contracts": ["orders"], "grid_images": ["events"], "grid_repairs": ["events"], "frames": ["events"], "capture_cells": ["events"], "blobs": ["events"], "qualities": ["events"], "stereo_pairs": ["lineitem"], "viewings": ["events"], "sites": ["events"], "unlinked": ["events"], "proposals": ["events"], "calibrations": ["orders"], "stereo": ["orders"], "traits": ["labels", "documents"], "foliage": ["lineitem"], "beds": ["supplier"], "cases": ["events"], "sightings": ["events"], "detections": ["events"], "labelled": ["events"], "soil_decisions": ["orders"], "legacy_repairs": ["orders"], "growth": ["events"], "plants": ["part"], "weeds": ["supplier"], "soil_points": ["customer"], "images": ["events"], "measurements": ["events"], "decisions": ["events"], "soil_measurements": ["orders"], "change_log": ["lineitem"], "training": ["labels", "documents"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named garden view; column pruning and filters reach the Parquet scan."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in READS[name]}
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")  # names in braces are frames
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **frames)


def with_views(sql: str) -> str:
    """SQL for DuckDB: the views that the query names, as CTEs, before it."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    body = sql.strip()
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}" if used else body
    return f"WITH {ctes} {body}" if used else body
