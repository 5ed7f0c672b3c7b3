"""Curves, evidence, decisions and plans over the garden views."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.functions import scalars as S
from canopia.operators import curves, decisions, evidence, planning
from canopia.plans.garden import _of

FRESH = "1996-01-01"
AUTO = decisions.Rules("auto_radius", apply_removal=True)


def c(name: str):
    return F.col(name)


def _lists(g):
    """One curve a crop: the smallest radius of every three days, doubled; the new point falls between."""
    rows = g.groupBy("crop", F.expr("cast(age_days - age_days % 3 as bigint)").alias("day")).agg((F.min("radius") * 2).alias("diameter_mm"))
    new = g.groupBy("crop").agg((F.max("id") % 90).alias("day"), F.round(F.max("radius") * 2, 2).alias("diameter_mm"))
    return rows, new


_CURVES = "cv AS (SELECT crop, CAST(age_days - age_days % 3 AS BIGINT) AS day, min(radius) * 2 AS diameter_mm FROM growth GROUP BY ALL), nw AS (SELECT crop, max(id) % 90 AS day, round(max(radius) * 2, 2) AS diameter_mm FROM growth GROUP BY crop)"
_BINS = "b AS (SELECT crop, CAST(floor(greatest(0, age_days) / 3.0) * 3 AS BIGINT) AS day, quantile_cont(radius, 0.9) AS upper, count(*) AS n FROM growth GROUP BY ALL)"
_ISO = f"{_BINS}, mn AS (SELECT j.crop, j.day AS j, k.day AS k, (SELECT sum(upper * n) / sum(n) FROM b WHERE b.crop = j.crop AND b.day BETWEEN j.day AND k.day) AS m FROM b j JOIN b k ON j.crop = k.crop AND k.day >= j.day), lo AS (SELECT mn.crop, mn.j, b.day AS i, min(m) AS m FROM mn JOIN b ON b.crop = mn.crop AND b.day BETWEEN mn.j AND mn.k WHERE mn.k >= b.day GROUP BY ALL), fit AS (SELECT crop, i AS day, max(m) AS fitted FROM lo GROUP BY ALL)"
_SPAN = lambda span, frame: f"CASE WHEN {frame} >= {span} THEN 1 ELSE greatest(2, ceil(({span} - {frame}) / ({frame} * 0.85)) + 1) END"
_GRID = f"""g AS (SELECT *, CAST({_SPAN('width_mm', 'frame_x')} AS BIGINT) AS nx, CAST({_SPAN('depth_mm', 'frame_y')} AS BIGINT) AS ny FROM beds), cells AS (SELECT bed_id, width_mm, depth_mm, r.range * nx + CASE WHEN r.range % 2 = 1 THEN nx - 1 - q.range ELSE q.range END AS "index", r.range AS "row", q.range AS "column",
round(CASE WHEN nx = 1 THEN width_mm / 2 ELSE frame_x / 2 + (width_mm - frame_x) / (nx - 1) * q.range END, 3) AS x, round(CASE WHEN ny = 1 THEN depth_mm / 2 ELSE frame_y / 2 + (depth_mm - frame_y) / (ny - 1) * r.range END, 3) AS y FROM g, range(64) q, range(64) r WHERE q.range < nx AND r.range < ny)"""
_EDGES = """ed AS (SELECT plant_id, sector, quantile_cont(distance_mm, 0.98) AS edge FROM foliage GROUP BY ALL HAVING count(*) >= 3), cur AS (SELECT DISTINCT plant_id, CAST(20 + plant_id * 3 AS DOUBLE) AS current_mm FROM foliage),
pr AS (SELECT ed.*, current_mm, greatest(5, CASE WHEN current_mm > 25 THEN current_mm - 20 ELSE current_mm END) AS prior FROM ed JOIN cur USING (plant_id)),
ov AS (SELECT *, edge > prior + CASE WHEN current_mm > 25 THEN greatest(20, least(40, prior * 0.3)) ELSE greatest(40, least(75, prior * 1.5)) END AS over FROM pr),
dbl AS (SELECT plant_id, sector AS s FROM ov WHERE over UNION ALL SELECT plant_id, sector + 72 FROM ov WHERE over),
isl AS (SELECT plant_id, s, s - ROW_NUMBER() OVER (PARTITION BY plant_id ORDER BY s) AS g FROM dbl), run AS (SELECT plant_id, s % 72 AS sector, max(least(72, n)) AS length FROM (SELECT *, count(*) OVER (PARTITION BY plant_id, g) AS n FROM isl) GROUP BY ALL),
lim AS (SELECT ov.*, coalesce(length > 7 OR total > 16, false) AS cut FROM ov LEFT JOIN run USING (plant_id, sector) LEFT JOIN (SELECT plant_id, count(*) AS total FROM ov WHERE over GROUP BY ALL) t ON t.plant_id = ov.plant_id AND over),
kp AS (SELECT f.plant_id, f.sector, f.distance_mm FROM foliage f JOIN lim USING (plant_id, sector) WHERE distance_mm <= CASE WHEN cut THEN prior ELSE edge END + 1e-6),
outr AS (SELECT plant_id, max(e) AS outer_mm FROM (SELECT plant_id, quantile_cont(distance_mm, 0.98) AS e FROM kp GROUP BY plant_id, sector HAVING count(*) >= 3) GROUP BY ALL), ty AS (SELECT plant_id, quantile_cont(distance_mm, 0.9) AS typical FROM kp GROUP BY ALL)"""


def _edge(f):
    points = f.withColumn("sector", c("sector").cast("int"))
    current = f.select("plant_id").distinct().select("plant_id", (c("plant_id") * 3 + 20).cast("double").alias("current_mm"))
    out = evidence.canopy_edge(points, current)
    return out.select("plant_id", "broad", *[F.round(n, 4).alias(n) for n in ("outer_mm", "unclipped_mm", "typical_mm", "recommended_mm")])


def _on_map(cells):
    """Each cell's place on a turned map with its origin at the bottom right, sized by its bed's grid."""
    by = W.partitionBy("bed_id")
    place = S.display_cell(c("column"), c("row"), F.max("column").over(by) + 1, F.max("row").over(by) + 1, "bottom_right", True)
    return cells.select("bed_id", "index", *[v.alias(n) for n, v in zip(("map_row", "map_column"), place, strict=True)])


_PCT = "100 * abs(proposed_mm - current_mm) / greatest(current_mm, 1)"
_SURE = f"CASE WHEN NOT calibrated OR absent OR ambiguous OR proposed_mm = current_mm THEN confidence WHEN proposed_mm < current_mm AND {_PCT} > 25 THEN greatest(0.05, least(CASE WHEN abs(proposed_mm - current_mm) < 3 THEN 0.05 ELSE confidence END, least(1 - {_PCT} / 100, 0.79))) WHEN abs(proposed_mm - current_mm) < 3 THEN 0.05 ELSE confidence END"

PLANS = {
    "agg6": (_of("growth")(lambda g: curves.fit_curve(g, "crop")),
             f"WITH {_ISO}, rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY crop ORDER BY day) - 1 AS p, count(*) OVER (PARTITION BY crop) AS n FROM fit) SELECT crop, day, round(fitted * 2, 1) AS diameter_mm FROM rk WHERE n <= 10 OR p IN (SELECT CAST(round_even(range * (n - 1) / 9.0, 0) AS BIGINT) FROM range(10))"),
    "agg7": (_of("growth")(lambda g: curves.isotonic(g.groupBy("crop", (F.floor(F.greatest(F.lit(0), c("age_days")) / 3) * 3).cast("long").alias("day")).agg(F.percentile("radius", F.lit(0.9)).alias("upper"), F.count("*").alias("n")), "crop", "day", "upper", "n").select("crop", "day", F.round("fitted", 9).alias("fitted"))),
             f"WITH {_ISO} SELECT crop, day, round(fitted, 9) AS fitted FROM fit"),
    "agg10": (_of("foliage")(lambda f: f.groupBy("plant_id", "sector").agg(F.percentile("distance_mm", F.lit(0.98)).alias("edge_mm"), F.count("*").alias("n")).where("n >= 3").select("plant_id", "sector", F.round("edge_mm", 6).alias("edge_mm"))),
              "SELECT plant_id, sector, round(quantile_cont(distance_mm, 0.98), 6) AS edge_mm FROM foliage GROUP BY ALL HAVING count(*) >= 3"),
    "agg13": (_of("sightings")(lambda s: s.select("measurement_id", F.round(S.fused_confidence(c("confidence"), c("coverage"), c("first_sector") % 6 + 1, c("image_quality"), c("truncated")), 6).alias("confidence"))),
              "WITH r AS (SELECT measurement_id, coverage, truncated, least(0.99, greatest(0.05, confidence * 0.75 + coverage * 0.2 + least(0.08, 0.02 * (first_sector % 6)) + least(0.05, image_quality * 0.1))) AS v FROM sightings) SELECT measurement_id, round(least(v, CASE WHEN truncated THEN 0.74 ELSE 1 END, CASE WHEN coverage < 0.5 THEN 0.45 ELSE 1 END), 6) AS confidence FROM r"),
    "agg14": (_of("sightings")(lambda s: s.groupBy("plant_id").agg(F.round(F.percentile("coverage", F.lit(0.9)) - F.percentile("coverage", F.lit(0.1)), 6).alias("spread"))),
              "SELECT plant_id, round(quantile_cont(coverage, 0.9) - quantile_cont(coverage, 0.1), 6) AS spread FROM sightings GROUP BY plant_id"),
    "can1": (_of("foliage")(_edge),
             f"WITH {_EDGES} SELECT plant_id, bool_or(cut) AS broad, round(max(outer_mm), 4) AS outer_mm, round(max(edge), 4) AS unclipped_mm, round(least(max(typical), max(outer_mm)), 4) AS typical_mm, round(greatest(max(outer_mm) + 20, least(max(current_mm), max(edge) + 20)), 4) AS recommended_mm FROM lim JOIN outr USING (plant_id) JOIN ty USING (plant_id) GROUP BY plant_id"),
    "sel2": (_of("sightings")(lambda s: s.select("measurement_id", F.round(evidence.quality(), 6).alias("quality"), evidence.is_complete().alias("complete"))),
             "SELECT measurement_id, round(confidence * sqrt(greatest(0.05, image_quality) * greatest(0.05, segmentation_quality)), 6) AS quality, has_evidence AND center_visible AND NOT truncated AND coverage >= 0.98 AS complete FROM sightings"),
    "fn6": (_of("sightings")(lambda s: s.select("measurement_id", F.size(evidence.sectors(c("first_sector"), c("coverage"))).alias("sectors"))),
            "SELECT measurement_id, CAST(round_even(coverage * 72, 0) AS INT) AS sectors FROM sightings"),
    "dec1": (_of("cases")(lambda k: k.select("measurement_id", decisions.decide(AUTO).alias("d")).select("measurement_id", "d.decision", F.round("d.confidence", 6).alias("confidence"))),
             f"""SELECT measurement_id, CASE WHEN NOT calibrated THEN 'observed'
WHEN absent THEN CASE WHEN age_days IS NULL OR age_days <= 30 OR current_mm <= 50 OR NOT seen_before OR (streak < 2 AND NOT (confidence >= 0.9 AND misaligned)) THEN 'observed' WHEN confidence >= 0.8 THEN 'removed' ELSE 'removal_recommended' END
WHEN ambiguous THEN 'uncertain' WHEN proposed_mm = current_mm THEN 'retain'
WHEN {_SURE} < 0.8 OR (proposed_mm < current_mm AND {_PCT} > 25) OR (proposed_mm > current_mm AND ({_PCT} > 50 OR proposed_mm - current_mm > 10 * greatest(days, 1))) THEN 'uncertain' ELSE 'applied' END AS decision, round({_SURE}, 6) AS confidence FROM cases"""),
    "dec4": (_of("growth")(lambda g: curves.insert_points(*_lists(g), "crop")),
             f"""WITH {_CURVES}, mg AS (SELECT cv.crop, cv.day, cv.diameter_mm, nw.day AS nd FROM cv JOIN nw USING (crop) WHERE cv.day <> nw.day UNION ALL SELECT crop, day, diameter_mm, day FROM nw),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY crop ORDER BY day) AS p, count(*) OVER (PARTITION BY crop) AS n FROM mg), mu AS (SELECT *, p = 1 OR p = n OR day = nd AS must FROM rk),
fr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY crop, must ORDER BY day) - 1 AS f, count(*) FILTER (must) OVER (PARTITION BY crop) AS fixed FROM mu)
SELECT crop, day, diameter_mm, n > 10 AS downsampled FROM fr WHERE must OR n <= 10 OR f IN (SELECT CAST(round_even(range * (n - fixed - 1) / CAST(9 - fixed AS DOUBLE), 0) AS BIGINT) FROM range(10) WHERE range < 10 - fixed)"""),
    "dec5": (_of("growth")(lambda g: curves.gate(*_lists(g), "crop", 2.0, 60.0)),
             f"""WITH {_CURVES}, nb AS (SELECT nw.crop, nw.day, nw.diameter_mm, max(cv.day) FILTER (cv.day < nw.day) AS pd, arg_max(cv.diameter_mm, cv.day) FILTER (cv.day < nw.day) AS pm, arg_min(cv.diameter_mm, cv.day) FILTER (cv.day > nw.day) AS nm FROM nw LEFT JOIN cv USING (crop) GROUP BY ALL)
SELECT crop, day, diameter_mm, CASE WHEN diameter_mm < pm THEN 'falls after previous' WHEN diameter_mm > nm THEN 'exceeds next' WHEN (diameter_mm - pm) / greatest(1, day - pd) > 4 THEN 'grows too fast' WHEN diameter_mm > 120 THEN 'too large' ELSE 'ok' END AS verdict FROM nb"""),
    "fn12": (_of("sightings")(lambda s: s.select("measurement_id", F.round(S.absence_confidence(c("coverage") / 10), 6).alias("confidence"))),
             "SELECT measurement_id, round(least(0.98, greatest(0.05, 0.72 + 0.25 * (1 - coverage / 10 / 0.035))), 6) AS confidence FROM sightings"),
    "fn14": (_of("plants")(lambda p: p.select("id", S.growth_hold(c("radius") * c("radius"), c("age_days")).alias("hold"))),
             "SELECT id, CASE WHEN radius * radius < 150 THEN 'area' WHEN age_days < 10 THEN 'age' END AS hold FROM plants"),
    "fn15": (_of("plants")(lambda p: p.select("id", S.prior_edge(c("radius"), 20.0).alias("edge_mm"))),
             "SELECT id, greatest(5, CASE WHEN radius > 25 THEN radius - 20 ELSE radius END) AS edge_mm FROM plants"),
    "fn22": (_of("soil_measurements")(lambda s: s.select("measurement_id", S.queue_key(c("point_id"), c("capture_x"), c("capture_y")).alias("target"))),
             "SELECT measurement_id, CASE WHEN point_id <> 0 THEN 'point:' || point_id ELSE 'coordinate:' || CAST(round(capture_x * 1000) AS BIGINT) || ':' || CAST(round(capture_y * 1000) AS BIGINT) END AS target FROM soil_measurements"),
    "fn26": (_of("beds")(lambda b: _on_map(planning.capture_grid(b))), f"""
WITH {_GRID},
size AS (SELECT bed_id, max("column") AS columns, max("row") AS depth FROM cells GROUP BY bed_id)
SELECT bed_id, "index", columns - "column" AS map_row, depth - "row" AS map_column FROM cells JOIN size USING (bed_id)"""),
    "win3": (_of("measurements")(lambda m: m.select("measurement_id", F.round(S.limited_growth(c("current_radius_mm"), c("recommended_mm"), c("current_radius_mm") - 10, 30.0, 40.0), 6).alias("radius_mm"))),
             "SELECT measurement_id, round(greatest(current_radius_mm, least(recommended_mm, current_radius_mm - 10 + 30, (current_radius_mm - 10) * 1.4)), 6) AS radius_mm FROM measurements"),
    "win7": (_of("weeds")(lambda w: planning.axis_groups(w.selectExpr("id % 3 AS bed", "x"), "bed", "x", 400.0).groupBy("bed").agg(F.count("*").alias("positions"), F.sum("members").alias("members"))), None),
    "set2": (_of("soil_points", "soil_measurements")(lambda p, s: planning.soil_samples(p, s, FRESH).select("sample", "x", "y", "z")),
             f"SELECT 'm' || measurement_id AS sample, capture_x AS x, capture_y AS y, proposed_z_mm AS z FROM soil_measurements WHERE status IN ('valid', 'applied') AND created_at >= TIMESTAMP '{FRESH}' UNION ALL SELECT 'p' || id, x, y, z FROM soil_points WHERE id NOT IN (SELECT point_id FROM soil_measurements WHERE status IN ('valid', 'applied') AND created_at >= TIMESTAMP '{FRESH}')"),
    "pln1": (_of("weeds", "soil_points")(lambda w, p: planning.soil_height(w, p).select("id", "samples", "method", F.round("z", 4).alias("z"), F.round("nearest_mm", 4).alias("nearest_mm"), F.round("spread_mm", 3).alias("spread_mm"))),
             """WITH n AS (SELECT w.id, p.z, sqrt((w.x - p.x) * (w.x - p.x) + (w.y - p.y) * (w.y - p.y)) AS d FROM weeds w JOIN soil_points p ON sqrt((w.x - p.x) * (w.x - p.x) + (w.y - p.y) * (w.y - p.y)) <= 500), k AS (SELECT *, 1 / power(greatest(d, 1), 2) AS w, min(d) OVER (PARTITION BY id) AS nd FROM n),
m AS (SELECT *, CASE WHEN nd < 0.5 THEN arg_min(z, (d, z)) OVER (PARTITION BY id) ELSE sum(w * z) OVER (PARTITION BY id) / sum(w) OVER (PARTITION BY id) END AS v FROM k)
SELECT id, CASE WHEN min(nd) < 0.5 THEN 1 ELSE count(*) END AS samples, CASE WHEN min(nd) < 0.5 THEN 'exact' WHEN count(*) > 1 THEN 'interpolated' ELSE 'nearest' END AS method, round(min(v), 4) AS z, round(min(nd), 4) AS nearest_mm, round(CASE WHEN min(nd) < 0.5 THEN 0 ELSE sqrt(sum(w * (z - v) * (z - v)) / sum(w)) END, 3) AS spread_mm FROM m GROUP BY id"""),
    "pln11": (_of("weeds", "soil_points")(lambda w, p: planning.measurement_target(w, p).select("id", "point_id", F.round("moved_mm", 4).alias("moved_mm"))),
              "SELECT w.id, coalesce(arg_min(p.id, (d, p.id)), 0) AS point_id, round(coalesce(min(d), 0), 4) AS moved_mm FROM weeds w LEFT JOIN (SELECT w.id AS wid, p.id, sqrt((w.x - p.x) * (w.x - p.x) + (w.y - p.y) * (w.y - p.y)) AS d FROM weeds w, soil_points p) p ON p.wid = w.id AND d < 200 GROUP BY w.id"),
    "pln12": (_of("weeds", "plants", "soil_points")(lambda w, p, s: planning.clear_site(w, p.select("x", "y", "radius").unionByName(w.select("x", "y", F.greatest("radius", F.lit(10.0)).alias("radius"))), s, (3000.0, 1500.0)).select("id", "ring", "angle", "anchor_id")),
              """WITH c AS (SELECT w.id, 75 + 25 * r.range AS ring, 15 * a.range AS angle, w.x + (75 + 25 * r.range) * cos(15 * a.range * (pi() / 180)) AS x, w.y + (75 + 25 * r.range) * sin(15 * a.range * (pi() / 180)) AS y FROM weeds w, range(11) r, range(24) a), b AS (SELECT * FROM c WHERE x BETWEEN 0 AND 3000 AND y BETWEEN 0 AND 1500),
o AS (SELECT x AS ox, y AS oy, radius + 75 AS reach FROM plants UNION ALL SELECT x, y, greatest(radius, 10) + 75 FROM weeds), f AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) < reach)),
n AS (SELECT f.id, ring, angle, f.x, f.y, arg_min(p.id, (sqrt((f.x - p.x) * (f.x - p.x) + (f.y - p.y) * (f.y - p.y)), p.id)) AS anchor_id FROM f JOIN soil_points p ON sqrt((f.x - p.x) * (f.x - p.x) + (f.y - p.y) * (f.y - p.y)) < 200 GROUP BY ALL),
g AS (SELECT n.*, (SELECT round(min(sqrt((n.x - ox) * (n.x - ox) + (n.y - oy) * (n.y - oy)) - reach), 6) FROM o) AS clearance FROM n) SELECT id, ring, angle, anchor_id FROM g QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY ring, clearance DESC, angle) = 1"""),
    "grd1": (_of("beds")(planning.capture_grid),
             f'WITH {_GRID} SELECT bed_id, "index", "row", "column", x, y FROM cells'),
    "grd2": (_of("beds")(lambda b: planning.cell_bounds(planning.capture_grid(b), b).select("bed_id", "index", *[F.round(n, 6).alias(n) for n in ("x0", "x1", "y0", "y1")])),
             f"""WITH {_GRID}, cx AS (SELECT bed_id, "column", width_mm, x, lag(x) OVER (PARTITION BY bed_id ORDER BY "column") AS a, lead(x) OVER (PARTITION BY bed_id ORDER BY "column") AS b FROM (SELECT DISTINCT bed_id, "column", width_mm, x FROM cells)), cy AS (SELECT bed_id, "row", depth_mm, y, lag(y) OVER (PARTITION BY bed_id ORDER BY "row") AS a, lead(y) OVER (PARTITION BY bed_id ORDER BY "row") AS b FROM (SELECT DISTINCT bed_id, "row", depth_mm, y FROM cells))
SELECT cells.bed_id, "index", round(coalesce((cx.a + cx.x) / 2, 0), 6) AS x0, round(coalesce((cx.x + cx.b) / 2, cx.width_mm), 6) AS x1, round(coalesce((cy.a + cy.y) / 2, 0), 6) AS y0, round(coalesce((cy.y + cy.b) / 2, cy.depth_mm), 6) AS y1 FROM cells JOIN cx ON cx.bed_id = cells.bed_id AND cx."column" = cells."column" JOIN cy ON cy.bed_id = cells.bed_id AND cy."row" = cells."row" """),
}
