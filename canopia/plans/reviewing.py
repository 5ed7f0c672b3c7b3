"""Reviews, gates, capture progress and retention over the garden views."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.operators import evidence, geometry, planning, reviews, store
from canopia.plans.garden import _PENDING, _of
from canopia.plans.judgements import PLANS as JUDGED
from canopia.plans.measures import _GRID
from canopia.sources.tables import view
from canopia.streaming import events

NOW = "2024-01-20"


def _expr(text: str):
    return F.expr(text)


_CHOICE = "CASE WHEN vegetation_absent THEN 'keep' ELSE 'reject' END"


def _group(m, d):
    newest = store.latest(m, "plant_id", "image_timestamp", "measurement_id")
    return reviews.group_decisions(newest.select("measurement_id", "plant_id", _expr(_CHOICE).alias("action")), m, d)


_RUN = "CAST(floor(id / 77.0) AS BIGINT)"


def _cells(i):
    return i.selectExpr(f"{_RUN} AS run", "id % 77 AS index", "processed AND id % 77 < 60 AS verified", f"{_RUN} % 3 = 0 AS finished", f"{_RUN} % 3 = 1 AS retrying")


_PROGRESS = f"""ce AS (SELECT {_RUN} AS run, id % 77 AS index, processed AND id % 77 < 60 AS verified, {_RUN} % 3 = 0 AS finished, {_RUN} % 3 = 1 AS retrying FROM images),
fr AS (SELECT *, coalesce(max(CASE WHEN verified THEN index END) OVER (PARTITION BY run), -1) AS frontier FROM ce),
st AS (SELECT *, min(CASE WHEN NOT verified AND NOT finished AND index > frontier THEN index END) OVER (PARTITION BY run) AS ahead, min(CASE WHEN NOT verified AND (finished OR index < frontier) THEN index END) OVER (PARTITION BY run) AS again FROM fr),
pg AS (SELECT run, index, frontier, CASE WHEN verified THEN 'verified' WHEN index = ahead THEN 'active' WHEN retrying AND NOT finished AND ahead IS NULL AND index = again THEN 'active' WHEN finished OR index < frontier THEN 'missed' ELSE 'unattempted' END AS state FROM st)"""


def _repairs(i):
    rows = i.withColumn("run", _expr(_RUN))
    return reviews.next_repairs(rows.where("NOT processed").selectExpr("run", "x", "y", "CASE WHEN id % 2 = 0 THEN 'missing' ELSE 'gantry' END AS reason"), rows.where("id % 5 = 0").selectExpr("run", "x + id % 40 AS x", "y"))


_BED = "CAST(floor(x / 373) AS BIGINT)"
_CX, _CY = "CAST(floor(x / 373 + 0.5) AS BIGINT)", "CAST(floor(y / 294 + 0.5) AS BIGINT)"
_CREATE = "score >= 0.8 AND detection_id % 5 >= 3 AND NOT (NOT has_crop OR detection_id % 7 = 0)"
_WIDEN = "score >= 0.7 AND detection_id % 4 >= 2 AND NOT has_crop AND detection_id % 7 <> 0 AND radius_mm > 20 + 0.5"
_FUSED = "coverage >= 0.5 AND (first_sector % 6 + 1 = 1 OR image_quality >= 0.35) AND abs(first_sector - 60 * segmentation_quality) <= 35"


def _fused(s):
    ok = reviews.fusion_reliable(F.col("coverage"), F.col("image_quality"), _expr("first_sector % 6 + 1"), F.col("first_sector"), F.col("segmentation_quality") * 60)
    return s.select("measurement_id", ok.alias("reliable"))


def _waiting(spark, sf_dir):
    """str2: events of the stream whose image is not excluded."""
    stream = events.event_stream(spark, sf_dir).select("event_id", "user_id")
    gone = view(spark, sf_dir, "decisions").where("action = 'reject'").select(F.col("measurement_id").alias("event_id"))
    return events.drained(spark, stream.join(gone, "event_id", "left_anti")).select("event_id", "user_id")


def _queue(m, d, w):
    found = store.recent(w.where("status IN ('recommended', 'observing')"), "image_timestamp", "detection_id", 100)
    return store.review_queue(m, d, 0.1, 5.0, 3.0, 100).select(F.lit("plant").alias("kind"), F.col("plant_id").alias("id")).unionByName(found.select(F.lit("weed").alias("kind"), F.col("detection_id").alias("id")))


def _tracks(spark, sf_dir):
    """str5: tracks of weed candidates, one state an observer."""
    seen = events.event_stream(spark, sf_dir).selectExpr("user_id AS entry_id", "event_id AS detection_id", "event_id % 211 AS image_id", "ts", "CAST((event_id * 211) % 3000 AS DOUBLE) AS x", "CAST((event_id * 131) % 1500 AS DOUBLE) AS y", "CAST((event_id * 17) % 1000 AS DOUBLE) / 1000 AS confidence")
    return events.drained(spark, events.candidate_tracks(seen, 150.0, 240))


_APPLICABLE = "status = 'valid' AND proposed_z_mm IS NOT NULL AND (point_id = 0 OR measurement_id % 3 <> 0)"

PLANS = {
    "win5": (_of("measurements", "decisions")(reviews.superseded),
             "SELECT measurement_id, 'superseded' AS action FROM measurements m WHERE EXISTS (SELECT 1 FROM measurements o WHERE o.plant_id = m.plant_id AND o.image_id = m.image_id AND o.measurement_id > m.measurement_id) AND NOT EXISTS (SELECT 1 FROM decisions d WHERE d.measurement_id = m.measurement_id AND d.action = 'superseded')"),
    "dec10": (_of("measurements", "decisions")(_group),
              f"WITH {_PENDING}, ch AS (SELECT measurement_id, plant_id, {_CHOICE} AS action FROM measurements QUALIFY ROW_NUMBER() OVER (PARTITION BY plant_id ORDER BY image_timestamp DESC, measurement_id DESC) = 1), g AS (SELECT plant_id FROM p GROUP BY plant_id HAVING count(DISTINCT image_id) > 1) SELECT p.measurement_id, ch.action FROM p JOIN ch ON ch.plant_id = p.plant_id WHERE p.plant_id IN (SELECT plant_id FROM g) UNION ALL SELECT measurement_id, action FROM ch WHERE plant_id NOT IN (SELECT plant_id FROM g)"),
    "dec12": (_of("measurements", "decisions", "detections")(reviews.cleared),
              f"WITH {_PENDING} SELECT 'measurement' AS kind, measurement_id AS id FROM p UNION ALL SELECT 'detection', detection_id FROM detections WHERE status IN ('recommended', 'observing')"),
    "dec6": (_of("detections")(lambda d: d.select("detection_id", reviews.may_create(F.col("score"), _expr("detection_id % 5"), [~F.col("has_crop"), _expr("detection_id % 7 = 0")]).alias("automatic"))),
             f"SELECT detection_id, {_CREATE} AS automatic FROM detections"),
    "dec7": (_of("detections")(lambda d: d.select("detection_id", reviews.may_widen(F.col("score"), _expr("detection_id % 4"), F.col("has_crop"), F.col("radius_mm"), F.lit(20.0), _expr("detection_id % 7 = 0")).alias("automatic"))),
             f"SELECT detection_id, {_WIDEN} AS automatic FROM detections"),
    "can4": (_of("sightings")(_fused), f"SELECT measurement_id, {_FUSED} AS reliable FROM sightings"),
    "win12": (_of("images")(lambda i: reviews.run_progress(_cells(i))), f"WITH {_PROGRESS} SELECT * FROM pg"),
    "agg9": (_of("images")(lambda i: reviews.progress_counts(_cells(i))),
             f"WITH {_PROGRESS} SELECT run, max(frontier) AS frontier, count(*) FILTER (state = 'verified') AS verified, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'missed') AS missed, count(*) FILTER (state = 'unattempted') AS unattempted FROM pg GROUP BY run"),
    "win10": (_of("images")(_repairs),
              f"WITH rw AS (SELECT *, {_RUN} AS run FROM images), t AS (SELECT DISTINCT run, x, y, CASE WHEN id % 2 = 0 THEN 'missing' ELSE 'gantry' END AS reason FROM rw WHERE NOT processed) SELECT run, x, y, reason, ROW_NUMBER() OVER (PARTITION BY run ORDER BY reason <> 'missing', x, y, reason) AS turn FROM t WHERE NOT EXISTS (SELECT 1 FROM rw WHERE rw.run = t.run AND rw.id % 5 = 0 AND sqrt(power(t.x - rw.x - rw.id % 40, 2) + power(t.y - rw.y, 2)) <= 25)"),
    "win14": (_of("soil_points")(lambda p: reviews.upper_median(p.withColumn("bay", _expr(_BED)), "bay", "z")),
              f"SELECT bay, z AS median FROM (SELECT {_BED} AS bay, z, ROW_NUMBER() OVER (PARTITION BY {_BED} ORDER BY z) - 1 AS i, count(*) OVER (PARTITION BY {_BED}) AS n FROM soil_points) WHERE i = n // 2"),
    "agg11": (_of("soil_points")(lambda p: reviews.ordinary_median(p.withColumn("bay", _expr("id % 40")), "bay", "z", _expr("id % 3 = 0 OR id % 40 = 7")).select("bay", F.round("median", 6).alias("median"))),
              "SELECT id % 40 AS bay, round(coalesce(median(z) FILTER (NOT (id % 3 = 0 OR id % 40 = 7)), median(z)), 6) AS median FROM soil_points GROUP BY ALL"),
    "q20": (_of("images", "plants")(reviews.visible_plants),
            "WITH pl AS (SELECT DISTINCT x, y FROM images), sn AS (SELECT pl.x, pl.y, count(*) AS n, min(plants.id) AS f FROM pl JOIN plants ON abs(plants.x - pl.x) <= 500 AND abs(plants.y - pl.y) <= 400 GROUP BY ALL) SELECT i.id, coalesce(n, 0) AS plants, coalesce(f, 0) AS first_plant FROM images i LEFT JOIN sn ON sn.x = i.x AND sn.y = i.y"),
    "q43": (_of("measurements", "images")(lambda m, i: reviews.with_cell(m, i, geometry.grid_cells(i)).select("measurement_id", "cell_x", "cell_y", "images")),
            f"WITH ce AS (SELECT {_CX} AS cx, {_CY} AS cy, count(*) AS n FROM images WHERE processed GROUP BY ALL), fr AS (SELECT id, {_CX} AS cx, {_CY} AS cy FROM images) SELECT measurement_id, fr.cx AS cell_x, fr.cy AS cell_y, coalesce(n, 0) AS images FROM measurements m LEFT JOIN fr ON fr.id = m.image_id LEFT JOIN ce ON ce.cx = fr.cx AND ce.cy = fr.cy"),
    "snk8": (_of("images")(lambda i: reviews.evicted(i, "created_at", "id").select("id")),
             "SELECT id FROM (SELECT id, ROW_NUMBER() OVER (ORDER BY created_at DESC, id DESC) AS n FROM images) WHERE n > 256"),
    "snk10": (_of("detections")(lambda d: reviews.expired(d, "image_timestamp", F.lit(NOW).cast("timestamp"), F.col("has_crop")).select("detection_id")),
              f"SELECT detection_id FROM detections WHERE floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(image_timestamp)) > CASE WHEN has_crop THEN 7 ELSE 14 END * 86400"),
    "dec11": (_of("detections")(reviews.rejected_near),
              "SELECT detection_id, CASE WHEN EXISTS (SELECT 1 FROM detections r WHERE r.status = 'rejected' AND sqrt(power(r.x - d.x, 2) + power(r.y - d.y, 2)) <= 40) THEN 'rejected' ELSE status END AS status FROM detections d WHERE status IN ('recommended', 'observing')"),
    "dec14": (_of("measurements")(lambda m: reviews.upserted(m.selectExpr("plant_id", "measurement_id", "image_id", "CASE WHEN measurement_id % 3 = 0 THEN confidence ELSE NULL END AS confidence", "visible_fraction"), "plant_id", "measurement_id", ["image_id"], ["confidence"], ["visible_fraction"]).fillna(-1.0, ["confidence"])),
              "SELECT plant_id, arg_max(image_id, measurement_id) AS image_id, coalesce(arg_max(confidence, measurement_id) FILTER (measurement_id % 3 = 0), -1) AS confidence, arg_min(visible_fraction, measurement_id) AS visible_fraction FROM measurements GROUP BY plant_id"),
    "set4": (_of("sightings")(lambda s: reviews.boundary_union(s, "plant_id", evidence.sectors(F.col("first_sector"), F.col("coverage"))).select("plant_id", F.round("coverage", 9).alias("coverage"))),
             "WITH se AS (SELECT plant_id, (k + first_sector) % 72 AS sector FROM (SELECT plant_id, first_sector, unnest(range(CAST(round_even(coverage * 72, 0) AS BIGINT))) AS k FROM sightings)) SELECT plant_id, round(count(DISTINCT sector) / 72, 9) AS coverage FROM (SELECT plant_id, sector FROM se UNION ALL SELECT DISTINCT plant_id, NULL FROM sightings) GROUP BY plant_id"),
    "fn20": (_of("images")(lambda i: i.select("id", reviews.due(F.col("created_at"), (0, 2, 5), "12:30").alias("due"))),
             "SELECT id, isodow(created_at) IN (1, 3, 6) AND strftime(created_at, '%H:%M') = '12:30' AS due FROM images"),
    "fn24": (_of("plants")(lambda p: p.where(F.lower("crop").contains("econ")).select("id", "crop")),
             "SELECT id, crop FROM plants WHERE contains(lower(crop), 'econ')"),
    "q17": (_of("soil_measurements")(lambda s: store.recent(s, "created_at", "measurement_id", 100).select("measurement_id", "point_id", "status")),
            "SELECT measurement_id, point_id, status FROM soil_measurements ORDER BY created_at DESC, measurement_id DESC LIMIT 100"),
    "q22": (_of("viewings", "decisions", "detections")(_queue),
            f"SELECT 'plant' AS kind, plant_id AS id FROM ({JUDGED['q32'][1]}) UNION ALL SELECT 'weed', detection_id FROM (SELECT detection_id FROM detections WHERE status IN ('recommended', 'observing') ORDER BY image_timestamp DESC, detection_id DESC LIMIT 100)"),
    "q23": (_of("images", "decisions")(lambda i, d: reviews.selected_images(i, d.where("action = 'reject'").select(F.col("measurement_id").alias("id"))).select("id", "x", "y")),
            "SELECT id, x, y FROM images WHERE processed AND id NOT IN (SELECT measurement_id FROM decisions WHERE action = 'reject')"),
    "q24": (_of("soil_measurements")(lambda s: s.select("measurement_id", reviews.applicable(F.col("status"), F.col("proposed_z_mm"), F.col("capture_x"), F.col("capture_y"), F.col("point_id"), F.when(_expr("measurement_id % 3 <> 0"), F.col("created_at"))).alias("applicable"))),
            f"SELECT measurement_id, {_APPLICABLE} AS applicable FROM soil_measurements"),
    "dec8": (_of("sightings")(lambda s: reviews.absence(s.selectExpr("plant_id AS weed_id", "measurement_id % 97 AS image_id", "image_timestamp AS at", "measurement_id AS id", "NOT has_evidence AS absent", "confidence", "center_visible AND NOT truncated AS fully_visible"), 1)),
             "WITH ob AS (SELECT plant_id AS weed_id, image_timestamp AS t, measurement_id AS id, NOT has_evidence AS absent, confidence FROM sightings WHERE center_visible AND NOT truncated QUALIFY ROW_NUMBER() OVER (PARTITION BY plant_id, measurement_id % 97 ORDER BY image_timestamp, measurement_id) = 1), rn AS (SELECT *, count(*) FILTER (NOT absent) OVER (PARTITION BY weed_id ORDER BY t, id) AS run FROM ob), sk AS (SELECT weed_id, id, absent, count(*) FILTER (absent) OVER w AS streak, CASE WHEN absent THEN min(confidence) FILTER (absent) OVER w ELSE confidence END AS confidence FROM rn WINDOW w AS (PARTITION BY weed_id, run ORDER BY t, id)) SELECT weed_id, id, streak, confidence, absent AND streak >= 1 AND confidence >= 0.5 AS remove FROM sk"),
    "grd9": (_of("beds")(lambda b: reviews.views_aside(planning.capture_grid(b).join(b, "bed_id"))),
             f"WITH {_GRID}, vc(p, i, j) AS (VALUES {', '.join(f'({k}, {i}, {j})' for k, (i, j) in enumerate(reviews.ASIDE))}), mv AS (SELECT c.bed_id, c.index, p, c.x AS ox, c.y AS oy, round(least(b.width_mm, greatest(0, c.x + greatest(20, b.frame_x * 0.2) * i)), 3) AS x, round(least(b.depth_mm, greatest(0, c.y + greatest(20, b.frame_y * 0.2) * j)), 3) AS y FROM cells c JOIN beds b ON b.bed_id = c.bed_id, vc), ds AS (SELECT bed_id, index, x, y, min(p) AS p FROM mv WHERE x <> ox OR y <> oy GROUP BY ALL) SELECT bed_id, index, x, y, turn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY bed_id, index ORDER BY p) - 1 AS turn FROM ds) WHERE turn < 4"),
    "str5": (_tracks, None),
    "str2": (_waiting, "SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT measurement_id FROM decisions WHERE action = 'reject')"),
}
