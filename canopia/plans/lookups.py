"""Lookups, scalars, calibration, depth fits: queries with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.functions import scalars as S
from canopia.operators import curves, geometry, lookups, store
from canopia.operators import zones as Z
from canopia.plans.garden import _of
from canopia.plans.measures import _GRID
from canopia.plans.shapes import HEDGE

HEADS = {"weed": ({"f1": 0.4}, -0.3), "crop": ({"f1": -0.2}, 0.1), "soil": ({"f1": 0.05}, 0.2)}
WALL = ((500.0, 200.0), (2500.0, 1300.0))


def c(name: str):
    return F.col(name)


def _segment_sql(x1, y1, x2, y2) -> str:
    dx, dy = x2 - x1, y2 - y1
    t = f"greatest(0, least(1, ((x - {x1}) * {dx} + (y - {y1}) * {dy}) / {dx * dx + dy * dy}))"
    return f"sqrt(power(x - ({x1} + {t} * {dx}), 2) + power(y - ({y1} + {t} * {dy}), 2))"


_HEDGE = list(zip(HEDGE.points, HEDGE.points[1:] + HEDGE.points[:1], strict=True))
_RAYS = " + ".join(f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < {x1} + (y - {y1}) / {y2 - y1} * {x2 - x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in _HEDGE)
_CHANCE = {n: f"1 / (1 + exp(-({' + '.join(f'{k} * {v}' for k, v in w.items())} + {b})))" for n, (w, b) in HEADS.items()}

#: Targets of each bed, as shares of its sides; the last lies outside.
_TARGETS = ((0.37, 0.61), (0.93, 0.08), (0.37, 0.95), (1.5, 0.5))


def _windows(beds):
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(x).alias("x"), F.lit(y).alias("y")) for t, (x, y) in enumerate(_TARGETS)])).alias("v")
    rows = beds.select("bed_id", "width_mm", "depth_mm", one)
    return lookups.grid_window(beds, rows.select((c("bed_id") * 10 + c("v.t")).alias("target_id"), "bed_id", (c("width_mm") * c("v.x")).alias("x"), (c("depth_mm") * c("v.y")).alias("y")))


PLANS = {
    "q1": (_of("calibrations")(lambda k: lookups.active_calibration(k).select("entry", "id", "origin")), """
SELECT entry, id, coalesce(origin, 'top_left') AS origin FROM calibrations
WHERE active AND source IN ('manual', 'manual_transformed')
QUALIFY ROW_NUMBER() OVER (PARTITION BY entry ORDER BY created_at DESC, id DESC) = 1"""),
    "q2": (_of("calibrations")(lambda k: store.latest(k.where("active"), "entry", "created_at", "id").select("entry", "id")), """
SELECT entry, id FROM calibrations WHERE active
QUALIFY ROW_NUMBER() OVER (PARTITION BY entry ORDER BY created_at DESC, id DESC) = 1"""),
    "q3": (_of("calibrations")(lookups.decoded), """
SELECT id, CASE WHEN json_valid(payload) THEN CAST(payload ->> '$.slope' AS DOUBLE) END AS slope,
       coalesce(CASE WHEN json_valid(payload) THEN payload ->> '$.camera' END, '') AS camera
FROM calibrations"""),
    "q12": (_of("detections")(lambda d: d.where(c("detection_id").isin(3, 14, 159, 2653)).select("detection_id", "status", "score")), """
SELECT detection_id, status, score FROM detections WHERE detection_id IN (3, 14, 159, 2653)"""),
    "q13": (_of("measurements", "unlinked")(lambda m, u: m.join(u.select("plant_id", "image_id", (c("id") % 60 + 40).cast("double").alias("current_radius_mm")).distinct(), ["plant_id", "image_id", "current_radius_mm"], "left_semi").select("measurement_id")), """
SELECT measurement_id FROM measurements m WHERE EXISTS (
    SELECT 1 FROM unlinked u WHERE u.plant_id = m.plant_id AND u.image_id = m.image_id AND u.id % 60 + 40 = m.current_radius_mm)"""),
    "q15": (_of("proposals")(lambda p: p.where("status = 'pending'").orderBy(F.desc("created_at"), F.desc("id")).select("id", "crop", "diameter_mm")), """
SELECT id, crop, diameter_mm FROM proposals WHERE status = 'pending'"""),
    "q19": (_of("unlinked")(lambda u: lookups.images_of(u, None).select("plant_id", F.array_join(F.transform("images", lambda x: x.cast("string")), ",").alias("images"))), """
SELECT plant_id, array_to_string(list_sort(list(DISTINCT image_id)), ',') AS images
FROM unlinked WHERE entry IS NOT DISTINCT FROM NULL GROUP BY plant_id"""),
    "q44": (_of("beds")(_windows), f"""
WITH {_GRID},
cx AS (
    SELECT bed_id, "column", width_mm, x, lag(x) OVER (PARTITION BY bed_id ORDER BY "column") AS a, lead(x) OVER (PARTITION BY bed_id ORDER BY "column") AS b
    FROM (SELECT DISTINCT bed_id, "column", width_mm, x FROM cells)),
cy AS (
    SELECT bed_id, "row", depth_mm, y, lag(y) OVER (PARTITION BY bed_id ORDER BY "row") AS a, lead(y) OVER (PARTITION BY bed_id ORDER BY "row") AS b
    FROM (SELECT DISTINCT bed_id, "row", depth_mm, y FROM cells)),
tg AS (SELECT bed_id * 10 + t AS target_id, bed_id, width_mm * fx AS tx, depth_mm * fy AS ty FROM beds, (VALUES (0, 0.37, 0.61), (1, 0.93, 0.08), (2, 0.37, 0.95), (3, 1.5, 0.5)) v(t, fx, fy)),
hit AS (
    SELECT target_id, cells.bed_id, arg_min(cells."row", "index") AS r, arg_min(cells."column", "index") AS k
    FROM tg JOIN cells ON cells.bed_id = tg.bed_id JOIN cx ON cx.bed_id = cells.bed_id AND cx."column" = cells."column" JOIN cy ON cy.bed_id = cells.bed_id AND cy."row" = cells."row"
    WHERE tx BETWEEN coalesce((cx.a + cx.x) / 2, 0) AND coalesce((cx.x + cx.b) / 2, cx.width_mm)
      AND ty BETWEEN coalesce((cy.a + cy.y) / 2, 0) AND coalesce((cy.y + cy.b) / 2, cy.depth_mm)
    GROUP BY target_id, cells.bed_id)
SELECT target_id, bed_id, greatest(0, r - 1) AS row_min, least(max("row"), r + 1) AS row_max, greatest(0, k - 1) AS column_min, least(max("column"), k + 1) AS column_max
FROM hit JOIN cells USING (bed_id) GROUP BY target_id, bed_id, r, k"""),
    "fn1": (_of("weeds")(lambda w: w.select("id", F.round(F.hypot(c("x") - 100, c("y") - 50), 6).alias("distance_mm"))), """
SELECT id, round(sqrt((x - 100) * (x - 100) + (y - 50) * (y - 50)), 6) AS distance_mm FROM weeds"""),
    "fn2": (_of("images")(lambda i: i.select("id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("utc"))), """
SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS utc FROM images"""),
    "fn3": (_of("measurements")(lambda m: m.select("measurement_id", S.age_days(F.to_date(F.lit("1998-01-01")), F.to_date("image_timestamp")).alias("days"))), """
SELECT measurement_id, greatest(0, CAST(image_timestamp AS DATE) - DATE '1998-01-01') AS days FROM measurements"""),
    "fn4": (_of("soil_measurements")(lambda s: s.where(c("created_at") >= F.lit("1996-06-01").cast("timestamp")).select("measurement_id", F.round((c("created_at").cast("double") - F.lit("1996-06-01").cast("timestamp").cast("double")) / 86400, 6).alias("days"))), """
SELECT measurement_id, round(julian(created_at) - julian(TIMESTAMP '1996-06-01'), 6) AS days
FROM soil_measurements WHERE created_at >= TIMESTAMP '1996-06-01'"""),
    "fn5": (_of("calibrations")(lambda k: k.select("id", F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>")).alias("k")).select("id", F.size("k").alias("fields"))), """
SELECT id, CAST(coalesce(CASE WHEN json_valid(payload) THEN len(json_keys(payload)) END, 0) AS INTEGER) AS fields FROM calibrations"""),
    "fn7": (_of("calibrations")(lambda k: k.select("id", F.coalesce(F.from_json("payload", "map<string,string>")["slope"].try_cast("double"), F.lit(-1.0)).alias("slope"))), """
SELECT id, coalesce(CASE WHEN json_valid(payload) THEN CAST(payload ->> '$.slope' AS DOUBLE) END, -1.0) AS slope FROM calibrations"""),
    "fn8": (_of("calibrations")(lambda k: k.where("width IS NOT NULL").groupBy("entry", "source").agg(F.min(F.struct("width", "height")).alias("g"), F.count_distinct("width", "height").alias("n")).select("entry", "source", F.when(c("n") == 1, F.sha2(F.concat(F.lit('{"declared":"'), c("source"), F.lit('","processed":['), c("g.width").cast("string"), F.lit(","), c("g.height").cast("string"), F.lit("]}")), 256)).alias("signature"))), """
SELECT entry, source, CASE WHEN count(DISTINCT (width, height)) = 1
    THEN sha256('{"declared":"' || source || '","processed":[' || min(width) || ',' || min(height) || ']}') END AS signature
FROM calibrations WHERE width IS NOT NULL GROUP BY entry, source"""),
    "fn9": (_of("plants")(lambda p: p.select("id", (c("radius") * 2).alias("diameter_mm"))), "SELECT id, radius * 2 AS diameter_mm FROM plants"),
    "fn10": (_of("growth")(lambda g: g.select("id", F.when(c("id") % 7 == 0, F.concat(F.lit("0"), c("age_days").cast("string"))).when(c("id") % 7 == 1, "-3").otherwise(c("age_days").cast("string")).alias("t")).select("id", F.coalesce(S.curve_day(c("t")), F.lit(-1)).alias("day"))), """
SELECT id, CASE WHEN id % 7 > 1 THEN age_days ELSE -1 END AS day FROM growth"""),
    "fn11": (_of("measurements")(lambda m: m.select("measurement_id", F.round(geometry.recency(c("image_id").cast("double")), 9).alias("weight"))), """
SELECT measurement_id, round(exp(-ln(2) * image_id / 14), 9) AS weight FROM measurements"""),
    "fn13": (_of("plants")(lambda p: p.select("id", F.round(S.proximity_factor(c("x") % 60, c("radius") - 5), 9).alias("factor"))), """
SELECT id, CASE WHEN radius - 5 <= 0 THEN 1.0 ELSE round(least(1, power((x % 60) / (radius - 5), 2)), 9) END AS factor FROM plants"""),
    "fn16": (_of("growth")(lambda g: g.select("id", S.curve_radius(c("radius"), F.lit(60.0), c("age_days"), F.create_map(F.lit(10), F.lit(50.0), F.lit(40), F.lit(130.0), F.lit(70), F.lit(150.0))).alias("radius_mm"))), """
SELECT id, CASE WHEN radius >= 60 THEN radius ELSE greatest(60, CASE WHEN age_days > 70 THEN 75 WHEN age_days > 40 THEN 65 WHEN age_days > 10 THEN 25 ELSE 0 END) END AS radius_mm FROM growth"""),
    "fn18": (_of("images")(lambda i: i.join(i.select((c("id") + 1).alias("id"), c("created_at").alias("before")), "id").select("id", S.same_run(c("created_at"), c("before")).alias("same"))), """
SELECT i.id, epoch(i.created_at) - epoch(b.created_at) BETWEEN 0 AND 3600 AS same FROM images i JOIN images b ON b.id + 1 = i.id"""),
    "fn19": (_of("weeds")(lambda w: w.select("id", S.chunk_size(F.when(c("id") % 3 == 0, F.array(F.lit("a"), F.lit("continuous"))).otherwise(F.array(F.lit("a"))), "continuous").alias("cells"))), """
SELECT id, CASE WHEN id % 3 = 0 THEN 256 ELSE 12 END AS cells FROM weeds"""),
    "fn21": (_of("calibrations")(lambda k: k.groupBy("width", "height").agg(F.count("*").alias("rows")).where("width IS NOT NULL").select("width", "height", "rows", F.round(c("width") * c("height") / (640 * 480), 2).alias("workload"))), """
SELECT width, height, count(*) AS "rows", round(width * height / 307200.0, 2) AS workload FROM calibrations WHERE width IS NOT NULL GROUP BY width, height"""),
    "fn23": (_of("plants")(lambda p: p.select("id", S.snippet(c("crop"), 12).alias("text"))), """
SELECT id, CASE WHEN length(crop) > 12 THEN substring(crop, 1, 11) || '…' ELSE crop END AS text FROM plants"""),
    "fn25": (_of("plants")(lambda p: p.select("id", F.regexp_replace(F.concat(F.lit("//a/"), F.regexp_replace("crop", " ", "//")), "/+", "/").alias("path"))), """
SELECT id, '/a/' || replace(crop, ' ', '/') AS path FROM plants"""),
    "fn27": (_of("weeds")(lambda w: w.select("id", S.polygon_points(F.concat(c("x").cast("string"), F.when(c("id") % 5 == 0, "").otherwise(", "), c("y").cast("string"), F.lit("; ;1, 2\n"))).alias("p")).select("id", F.coalesce(F.size("p"), F.lit(-1)).alias("points"), F.coalesce(F.get("p", F.lit(0))["x"], F.lit(-1.0)).alias("x"))), """
SELECT id, CASE WHEN id % 5 = 0 THEN -1 ELSE 2 END AS points, CASE WHEN id % 5 = 0 THEN -1 ELSE x END AS x FROM weeds"""),
    "cal2": (_of("calibrations")(lambda k: k.select("id", F.round(S.rescaled(c("ppm"), c("width"), c("height"), 960, 720), 6).alias("ppm"))), """
SELECT id, CASE WHEN width >= height AND abs(960 / 720.0 / (CAST(width AS DOUBLE) / height) - 1) <= 0.02 THEN round(ppm * 960 / width, 6) END AS ppm FROM calibrations"""),
    "cal3": (_of("calibrations")(lambda k: k.select("id", F.when(c("mm_per_pixel") > 0, F.round(S.rescaled(1 / c("mm_per_pixel"), c("width"), c("height"), 960, 720), 6)).alias("ppm"))), """
SELECT id, CASE WHEN mm_per_pixel > 0 AND width >= height AND abs(960 / 720.0 / (CAST(width AS DOUBLE) / height) - 1) <= 0.02 THEN round(1 / mm_per_pixel * 960 / width, 6) END AS ppm FROM calibrations"""),
    "cal4": (_of("calibrations")(lambda k: k.where(c("source").isin(*lookups.MANUAL)).select("id", F.when(c("width").isNull(), "recalibrate").when((c("width") == 960) & (c("height") == 720), "as is").otherwise("transformed").alias("use"), F.round(c("ppm") * 960 / c("width"), 6).alias("ppm_x"), F.when(c("width").isNotNull(), F.round(c("ppm") * 720 / c("height"), 6)).alias("ppm_y"))), """
SELECT id, CASE WHEN width IS NULL THEN 'recalibrate' WHEN width = 960 AND height = 720 THEN 'as is' ELSE 'transformed' END AS use,
       round(ppm * 960 / width, 6) AS ppm_x, CASE WHEN width IS NOT NULL THEN round(ppm * 720 / height, 6) END AS ppm_y
FROM calibrations WHERE source IN ('manual', 'manual_transformed')"""),
    "cal5": (_of("calibrations")(lambda k: k.groupBy("entry").agg(*[F.max_by("id", F.when(c("source").isin(*s), F.struct("created_at", "id"))).alias(n) for n, s in (("processed", ("integration",)), ("reference", ("reference",)), ("manual", lookups.MANUAL))]).select("entry", F.coalesce("processed", "reference", "manual").alias("id"), F.when(c("processed").isNotNull(), "processed").when(c("reference").isNotNull(), "reference").when(c("manual").isNotNull(), "manual").otherwise("none").alias("basis"))), """
WITH n AS (
    SELECT entry, arg_max(id, (created_at, id)) FILTER (source = 'integration') AS p, arg_max(id, (created_at, id)) FILTER (source = 'reference') AS r,
           arg_max(id, (created_at, id)) FILTER (source IN ('manual', 'manual_transformed')) AS m
    FROM calibrations GROUP BY entry)
SELECT entry, coalesce(p, r, m) AS id, CASE WHEN p IS NOT NULL THEN 'processed' WHEN r IS NOT NULL THEN 'reference' WHEN m IS NOT NULL THEN 'manual' ELSE 'none' END AS basis FROM n"""),
    "cal6": (_of("calibrations")(lambda k: lookups.in_force(k).where("in_force").select("entry", "id")), """
SELECT entry, id FROM calibrations WHERE source IN ('manual', 'manual_transformed')
QUALIFY ROW_NUMBER() OVER (PARTITION BY entry ORDER BY created_at DESC, id DESC) = 1"""),
    "cal7": (_of("calibrations")(lambda k: lookups.numbered(k).select("id", "version", "current")), """
SELECT id, CAST(ROW_NUMBER() OVER (PARTITION BY entry ORDER BY created_at, id) AS INTEGER) AS version,
       ROW_NUMBER() OVER (PARTITION BY entry ORDER BY created_at DESC, id DESC) = 1 AS current FROM calibrations"""),
    "geo11": (_of("weeds")(lambda w: w.select("id", F.round(Z.segment_distance(c("x"), c("y"), *WALL[0], *WALL[1]), 6).alias("distance_mm"))), f"""
SELECT id, round({_segment_sql(*WALL[0], *WALL[1])}, 6) AS distance_mm FROM weeds"""),
    "geo12": (_of("weeds")(lambda w: w.select("id", Z.segments_touch((c("x"), c("y")), (c("x") + 400, c("y") - 300), *WALL).alias("touch"))), """
WITH k AS (SELECT id, 400 * 1100 + 300 * 2000 AS across, (500 - x) * 1100 - (200 - y) * 2000 AS t, (500 - x) * -300 - (200 - y) * 400 AS u FROM weeds)
SELECT id, t / across BETWEEN -1e-9 AND 1 + 1e-9 AND u / across BETWEEN -1e-9 AND 1 + 1e-9 AS touch FROM k"""),
    "geo13": (_of("plants")(lambda p: p.select("id", Z.in_polygon(HEDGE.points, c("x"), c("y")).alias("inside"))), f"""
SELECT id, least({", ".join(_segment_sql(*a, *b) for a, b in _HEDGE)}) <= 1e-9 OR ({_RAYS}) % 2 = 1 AS inside FROM plants"""),
    "win9": (_of("growth")(lambda g: curves.neighbours(g.groupBy("crop", c("age_days").cast("long").alias("day")).agg((F.min("radius") * 2).alias("diameter_mm")), "crop")), """
WITH k AS (SELECT crop, CAST(age_days AS BIGINT) AS day, min(radius) * 2 AS diameter_mm FROM growth GROUP BY ALL)
SELECT crop, day, diameter_mm, lag(diameter_mm) OVER w AS before_mm, lead(diameter_mm) OVER w AS after_mm
FROM k WINDOW w AS (PARTITION BY crop ORDER BY day)"""),
    "ml6": (_of("traits")(lambda t: lookups.explained(t, HEADS).select("doc_id", c("guesses")[0]["label"].alias("label"), F.round(c("guesses")[0]["share"], 6).alias("share"))), f"""
WITH k AS (SELECT doc_id, {", ".join(f"{e} AS {n}" for n, e in _CHANCE.items())} FROM traits),
u AS (SELECT doc_id, unnest(['weed', 'crop', 'soil']) AS label, unnest([weed, crop, soil]) AS chance FROM k)
SELECT doc_id, arg_max(label, chance) AS label, round(max(chance) / sum(chance), 6) AS share FROM u GROUP BY doc_id"""),
    "soi6": (_of("stereo")(lambda s: lookups.depth_fit(s).select("point_id", "levels", F.round("slope", 6).alias("slope"), F.round("residual_mm", 4).alias("residual_mm"), "flagged")), """
WITH l AS (SELECT point_id, level, median(disparity) AS d, median(distance_mm) AS far FROM stereo WHERE passes GROUP BY ALL),
r AS (SELECT *, coalesce(d >= lag(d) OVER (PARTITION BY point_id ORDER BY far), false) AS rises FROM l),
f AS (
    SELECT point_id, count(*) AS levels, regr_slope(1 / far, d) AS slope, regr_intercept(1 / far, d) AS intercept
    FROM r GROUP BY point_id HAVING count(*) >= 3 AND NOT bool_or(rises) AND regr_slope(1 / far, d) > 0)
SELECT point_id, levels, round(slope, 6) AS slope, round(max(abs(1 / (slope * d + intercept) - far)), 4) AS residual_mm, max(abs(1 / (slope * d + intercept) - far)) > 5 AS flagged
FROM r JOIN f USING (point_id) GROUP BY point_id, levels, slope"""),
    "str6": (_of("measurements")(lambda m: lookups.absences_so_far(m).select("measurement_id", "streak")), """
WITH r AS (SELECT *, sum(CASE WHEN vegetation_absent THEN 0 ELSE 1 END) OVER (PARTITION BY plant_id ORDER BY image_timestamp, measurement_id ROWS UNBOUNDED PRECEDING) AS run FROM measurements)
SELECT measurement_id, CAST(sum(CASE WHEN vegetation_absent THEN 1 ELSE 0 END) OVER (PARTITION BY plant_id, run ORDER BY image_timestamp, measurement_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM r"""),
    "dec17": (_of("decisions", "change_log", "soil_decisions", "proposals")(lambda d, k, s, p: lookups.audit_log(d, k, s, p).groupBy("kind", "action").agg(F.count("*").alias("rows"), F.max("key").alias("last"))), """
WITH l AS (
    SELECT 'decision' AS kind, measurement_id AS key, action FROM decisions
    UNION ALL SELECT 'change', id, change_type FROM change_log
    UNION ALL SELECT 'soil decision', measurement_id, action FROM soil_decisions
    UNION ALL SELECT 'proposal', id, status FROM proposals)
SELECT kind, action, count(*) AS "rows", max(key) AS last FROM l GROUP BY kind, action"""),
    "snk12": (_of("measurements", "soil_measurements", "change_log", "plants", "weeds")(lambda *t: lookups.health(dict(zip(("measurements", "soil_measurements", "change_log", "plants", "weeds"), t, strict=True)))), """
SELECT 'measurements' AS name, count(*) AS "rows" FROM measurements
UNION ALL SELECT 'soil_measurements', count(*) FROM soil_measurements
UNION ALL SELECT 'change_log', count(*) FROM change_log
UNION ALL SELECT 'plants', count(*) FROM plants
UNION ALL SELECT 'weeds', count(*) FROM weeds"""),
    "sel3": (_of("sightings")(lookups.evidence_reasons), None),
    "dec18": (_of("detections")(lambda d: d.where("status IN ('recommended', 'observing') AND score < 0.4").select("detection_id", F.lit("dismissed").alias("status")).unionByName(d.where("NOT (status IN ('recommended', 'observing') AND score < 0.4)").select("detection_id", "status")).groupBy("status").agg(F.count("*").alias("rows"))), """
SELECT CASE WHEN status IN ('recommended', 'observing') AND score < 0.4 THEN 'dismissed' ELSE status END AS status, count(*) AS "rows" FROM detections GROUP BY 1"""),
}
