"""Grid runs, scouting, photo quality and soil triplets, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.operators import runs
from canopia.plans.garden import _of
from canopia.plans.shapes import _COS, _DISC, _SIN, CAMERA

SLOPE, INTERCEPT, RESIDUAL = 0.0004, 0.0012, 1.5
BED = (0.0, 0.0, 3000.0, 1500.0)
CAPTURE_BASELINE = 120.0
RETRIED = ("washed_out", "blurry")


def _targets(frames):
    """Thirty targets a run, one a cell of its grid; the last one's place is another's, a few millimetres on."""
    index = F.explode(F.sequence(F.lit(0), F.lit(30))).alias("target_index")
    at = F.when(F.col("target_index") == 30, 0).otherwise(F.col("target_index"))
    shift = F.when(F.col("target_index") == 30, 9.0).otherwise(0.0)
    return frames.select("run").distinct().select("run", index).select("run", "target_index", ((at % 6) * 200 + shift).cast("double").alias("x"), (F.floor(at / 6) * 150).cast("double").alias("y"), F.lit(0.0).alias("z"))


def _triplets(pairs):
    one = F.struct("pair", "disparity", "passes", "coverage", "support", "lr_error", "mad")
    return pairs.groupBy("measurement_id").agg(F.max("camera_z").alias("camera_z"), F.max("z_spread").alias("z_spread"), F.collect_list(one).alias("pairs"))


def _text(points):
    return F.array_join(F.transform(points, lambda v: v.cast("string")), ",")


def _shown(images, plants, weeds):
    kept = runs.newest_per_location(images).select(F.lit("image").alias("kind"), "id", "x", "y")
    return kept.unionByName(plants.select(F.lit("plant").alias("kind"), "id", "x", "y")).unionByName(weeds.select(F.lit("weed").alias("kind"), "id", "x", "y"))


_RANGE = "created_at BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-09 00:00:00'"
# places of grid_images lie within a few millimetres of a lattice, so the newest of each lattice place is the newest of its surroundings
_LATEST = "QUALIFY ROW_NUMBER() OVER (PARTITION BY entry, round(x / 200), round(y / 150) ORDER BY created_at DESC, id DESC) = 1"
_BLUR = """
ab AS (
    SELECT a.image_id, count(*) AS n, median(b.laplacian) AS l, median(b.edges) AS e
    FROM q a JOIN q b ON a.run = b.run AND abs(a.cell_y - b.cell_y) + abs(a.cell_x - b.cell_x) = 1 AND b.issue = 'usable'
    GROUP BY a.image_id),
rb AS (
    SELECT q.*, coalesce(issue = 'usable' AND n >= 2 AND l >= 25 AND laplacian <= 80 AND laplacian / greatest(1, l) <= 0.35
           AND edges / greatest(0.005, e) <= 0.65 AND contrast >= 0.025, false) AS worse,
           least(1, greatest(0, 0.65 * (1 - laplacian / greatest(1, l) / 0.35) + 0.35 * (1 - edges / greatest(0.005, e) / 0.65))) AS score
    FROM q LEFT JOIN ab USING (image_id)),
out AS (SELECT * REPLACE (CASE WHEN worse THEN 'blurry' ELSE issue END AS issue, CASE WHEN worse THEN greatest(blur, score) ELSE blur END AS blur) FROM rb)"""

PLANS = {
    "grd3": (
        _of("frames")(lambda f: runs.match_frames(_targets(f), f)),
        """
WITH RECURSIVE tg AS (
    SELECT run, t.range AS target_index, (CASE WHEN t.range = 30 THEN 0 ELSE t.range % 6 END) * 200 + CASE WHEN t.range = 30 THEN 9 ELSE 0 END AS tx,
           CASE WHEN t.range = 30 THEN 0 ELSE floor(t.range / 6) END * 150 AS ty
    FROM (SELECT DISTINCT run FROM frames), range(31) t),
cd AS (
    SELECT f.run, f.seq, f.image_id, list(target_index ORDER BY CASE WHEN declared IS NULL THEN sqrt(power(x - tx, 2) + power(y - ty, 2) + z * z) ELSE 0 END, target_index) AS ts
    FROM frames f JOIN tg ON tg.run = f.run AND (declared = target_index OR (declared IS NULL AND sqrt(power(x - tx, 2) + power(y - ty, 2) + z * z) <= 25))
    WHERE image_id IS NOT NULL GROUP BY f.run, f.seq, f.image_id),
nb AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY seq) AS k FROM cd),
st(run, k, taken, target_index, image_id) AS (
    SELECT DISTINCT run, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM nb
    UNION ALL
    SELECT st.run, nb.k, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, pick, CASE WHEN pick IS NULL THEN NULL ELSE nb.image_id END
    FROM st JOIN nb ON nb.run = st.run AND nb.k = st.k + 1, LATERAL (SELECT list_filter(nb.ts, lambda t: NOT list_contains(taken, t))[1] AS pick))
SELECT run, target_index, image_id FROM st WHERE target_index IS NOT NULL""",
    ),
    "grd4": (
        _of("grid_images", "grid_repairs")(lambda i, r: runs.latest_grid_run(i, r).select("entry", F.unix_seconds("started_at").alias("started"), F.unix_seconds("completed_at").alias("completed"), "expected", *[F.round(n, 6).alias(n) for n in ("coverage", "x", "y", "z")], "reason", F.coalesce("image_id", F.lit(-1)).alias("image_id"))),
        """
WITH RECURSIVE i AS (SELECT *, CAST(epoch(created_at) AS BIGINT) AS t FROM grid_images WHERE id NOT IN (SELECT id FROM grid_repairs)),
c(entry, anchor) AS (
    SELECT entry, min(t) FROM i GROUP BY entry
    UNION ALL
    SELECT entry, anchor FROM (SELECT c.entry, (SELECT min(t) FROM i WHERE i.entry = c.entry AND i.t > c.anchor + 3600) AS anchor FROM c) WHERE anchor IS NOT NULL),
d AS (SELECT i.*, anchor FROM i JOIN c ON c.entry = i.entry AND t BETWEEN anchor AND anchor + 3600 QUALIFY count(*) OVER (PARTITION BY i.entry, anchor) >= 4),
ax AS (
    SELECT entry, anchor, avg(x) AS ax
    FROM (SELECT *, sum(n) OVER (PARTITION BY entry, anchor ORDER BY x, id) AS g FROM (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY entry, anchor ORDER BY x, id) > 25 THEN 1 ELSE 0 END AS n FROM d))
    GROUP BY entry, anchor, g),
ay AS (
    SELECT entry, anchor, avg(y) AS ay
    FROM (SELECT *, sum(n) OVER (PARTITION BY entry, anchor ORDER BY y, id) AS g FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY entry, anchor ORDER BY y, id) > 25 THEN 1 ELSE 0 END AS n FROM d))
    GROUP BY entry, anchor, g),
xs AS (SELECT entry, anchor, count(*) AS nx, min(ax) AS x0, max(ax) AS x1 FROM ax GROUP BY entry, anchor HAVING count(*) > 1),
ys AS (SELECT entry, anchor, count(*) AS ny, min(ay) AS y0, max(ay) AS y1 FROM ay GROUP BY entry, anchor HAVING count(*) > 1),
fa AS (SELECT entry, anchor, min(created_at) AS started_at, max(created_at) AS completed_at, coalesce(median(z) FILTER (NOT gantry), median(z)) AS height FROM d GROUP BY entry, anchor),
im AS (
    SELECT entry, anchor, id, created_at, x, y, z, gantry, false AS late FROM d
    UNION ALL
    SELECT g.entry, anchor, g.id, g.created_at, x, y, z, gantry, true FROM grid_images g JOIN grid_repairs r USING (id) JOIN fa ON fa.entry = g.entry AND epoch(started_at) - epoch(run_started_at) BETWEEN 0 AND 3600),
pl AS (
    SELECT im.*, ax, ay FROM im JOIN ax USING (entry, anchor) JOIN ay USING (entry, anchor)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY entry, anchor, id ORDER BY abs(x - ax), ax, abs(y - ay), ay) = 1),
ce AS (
    SELECT * FROM pl WHERE NOT late OR (abs(x - ax) <= 25 AND abs(y - ay) <= 25)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY entry, anchor, ax, ay ORDER BY created_at DESC, id DESC) = 1),
ru AS (
    SELECT fa.*, nx * ny AS expected, nc / (nx * ny) AS coverage, x0, x1, y0, y1
    FROM fa JOIN xs USING (entry, anchor) JOIN ys USING (entry, anchor) JOIN (SELECT entry, anchor, count(*) AS nc FROM ce GROUP BY entry, anchor) USING (entry, anchor)
    WHERE nc / (nx * ny) >= 0.6 QUALIFY ROW_NUMBER() OVER (PARTITION BY entry ORDER BY anchor DESC) = 1),
ta AS (
    SELECT ru.entry, ru.anchor, ax.ax AS x, ay.ay AS y, coalesce(ce.z, height) AS z, ce.id AS image_id,
           CASE WHEN ce.id IS NULL THEN 'missing' WHEN gantry AND ax.ax > x0 AND ax.ax < x1 AND ay.ay > y0 AND ay.ay < y1 THEN 'gantry' END AS reason
    FROM ru JOIN ax USING (entry, anchor) JOIN ay USING (entry, anchor) LEFT JOIN ce ON ce.entry = ru.entry AND ce.anchor = ru.anchor AND ce.ax = ax.ax AND ce.ay = ay.ay)
SELECT ru.entry, CAST(epoch(started_at) AS BIGINT) AS started, CAST(epoch(completed_at) AS BIGINT) AS completed, CAST(expected AS INT) AS expected, round(coverage, 6) AS coverage,
       round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, reason, coalesce(image_id, -1) AS image_id
FROM ru LEFT JOIN ta ON ta.entry = ru.entry AND reason IS NOT NULL""",
    ),
    "grd6": (
        _of("capture_cells", "blobs", "plants")(lambda k, b, p: runs.scout_cells(k, b, p, 200.0, 150.0, CAMERA).select("cell", "issue", F.col("candidates").cast("long").alias("candidates"), F.coalesce(F.size("full"), F.lit(0)).alias("framed"), F.coalesce(_text("full"), F.lit("")).alias("full"), F.coalesce(_text("partial"), F.lit("")).alias("partial"))),
        f"""
WITH {_DISC},
sp AS (
    SELECT cell, blob, x + 15 + ((u - 0.5) * 400) * {_COS} - ((v - 0.5) * 300) * ({_SIN}) AS gx, y - 20 - (((u - 0.5) * 400) * ({_SIN}) + ((v - 0.5) * 300) * {_COS}) AS gy
    FROM blobs JOIN capture_cells USING (cell) WHERE issue = 'usable' AND area_fraction >= 0.004),
wd AS (
    SELECT cell, count(*) AS candidates FROM sp
    WHERE NOT EXISTS (SELECT 1 FROM plants p WHERE sqrt((gx - p.x) * (gx - p.x) + (gy - p.y) * (gy - p.y)) <= p.radius + 45) GROUP BY cell),
nr AS (SELECT cell, p.id, p.x AS px, p.y AS py, greatest(1, p.radius + 20) AS r, k0.x AS fx, k0.y AS fy FROM capture_cells k0 JOIN plants p ON abs(p.x - k0.x - 15) <= 260 + p.radius + 20 AND abs(p.y - k0.y + 20) <= 260 + p.radius + 20),
dd AS (SELECT cell, id, px + u * r - fx - 15 AS dx, -(py + v * r - fy + 20) AS dy FROM nr, k),
sh AS (SELECT cell, id, avg(CASE WHEN abs(dx * {_COS} + dy * {_SIN}) <= 200 AND abs(dy * {_COS} - dx * {_SIN}) <= 150 THEN 1.0 ELSE 0 END) AS share FROM dd GROUP BY cell, id),
fr AS (
    SELECT cell, count(*) FILTER (share >= 0.999) AS framed, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (share >= 0.999) AS "full",
           string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (share > 0 AND share < 0.999) AS partial
    FROM sh GROUP BY cell)
SELECT cell, issue, coalesce(candidates, 0) AS candidates, CAST(coalesce(framed, 0) AS INT) AS framed, coalesce("full", '') AS "full", coalesce(partial, '') AS partial
FROM capture_cells LEFT JOIN wd USING (cell) LEFT JOIN fr USING (cell)""",
    ),
    "grd8": (
        _of("grid_images")(lambda i: runs.newest_per_location(i).select("entry", "id")),
        f"SELECT entry, id FROM grid_images {_LATEST}",
    ),
    "q21": (
        _of("grid_images", "plants", "weeds")(lambda i, p, w: _shown(i.where(_RANGE), p, w)),
        f"""
SELECT 'image' AS kind, id, x, y FROM (SELECT * FROM grid_images WHERE {_RANGE} {_LATEST})
UNION ALL SELECT 'plant', id, x, y FROM plants
UNION ALL SELECT 'weed', id, x, y FROM weeds""",
    ),
    "img19": (
        _of("qualities")(lambda q: runs.relative_blur(q).select("image_id", "issue", F.round("blur", 6).alias("blur"))),
        f"WITH q AS (SELECT * FROM qualities), {_BLUR} SELECT image_id, issue, round(blur, 6) AS blur FROM out",
    ),
    "grd10": (
        _of("qualities", "decisions")(lambda q, d: runs.quality_repairs(q, d.where("action = 'reject'").select(F.col("measurement_id").alias("image_id")), RETRIED).select("image_id", "run", "issue")),
        f"WITH q AS (SELECT * FROM qualities WHERE image_id NOT IN (SELECT measurement_id FROM decisions WHERE action = 'reject')), {_BLUR} SELECT image_id, run, issue FROM out WHERE issue IN ('washed_out', 'blurry')",
    ),
    "img20": (
        _of("qualities")(lambda q: runs.best_photo(q.withColumn("cell", F.col("cell_y") * 11 + F.col("cell_x")), "cell").select("cell", "image_id")),
        """
SELECT cell_y * 11 + cell_x AS cell, image_id FROM qualities
QUALIFY ROW_NUMBER() OVER (PARTITION BY cell ORDER BY issue = 'usable' DESC, issue <> 'washed_out' DESC, clear DESC, obstruction, vegetation DESC, sharpness DESC, image_id DESC) = 1""",
    ),
    "soi7": (
        _of("stereo_pairs")(lambda p: runs.soil_heights(_triplets(p), SLOPE, INTERCEPT, RESIDUAL).select("measurement_id", "valid", "reason", "proposed_z", F.round("uncertainty", 6).alias("uncertainty"), F.round("confidence", 6).alias("confidence"))),
        f"""
WITH e AS (SELECT measurement_id, {SLOPE} * disparity + {INTERCEPT} AS inv, passes, coverage, support, lr_error, mad, camera_z, z_spread FROM stereo_pairs),
f AS (SELECT measurement_id, max(camera_z) AS camera_z, max(z_spread) AS z_spread, count(*) FILTER (passes) AS passing, count(*) FILTER (passes AND inv > 0) AS n FROM e GROUP BY measurement_id),
r AS (SELECT *, 1 / inv AS d, ROW_NUMBER() OVER (PARTITION BY measurement_id ORDER BY 1 / inv, coverage, support, lr_error, mad) AS k FROM e WHERE passes AND inv > 0),
g AS (SELECT measurement_id, max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2, max(d) FILTER (k = 3) AS d3 FROM r GROUP BY measurement_id),
a AS (
    SELECT measurement_id, max(d) - min(d) AS spread, median(d) AS d, median(coverage) AS coverage, median(support) AS support, median(lr_error) AS lr_error, median(mad) AS mad
    FROM r JOIN g USING (measurement_id)
    WHERE d3 IS NULL OR d3 - d1 <= 8 OR (d3 - d2 < d2 - d1 AND k >= 2) OR (d3 - d2 >= d2 - d1 AND k <= 2) GROUP BY measurement_id),
v AS (
    SELECT f.*, a.* EXCLUDE (measurement_id), greatest({RESIDUAL}, spread / 2) AS u,
           CASE WHEN z_spread > 1 THEN 'frames span too much in Z' WHEN passing < 2 THEN 'fewer than two pairs passed' WHEN n < 2 THEN 'pairs could not be converted'
                WHEN spread > 8 THEN 'pairs disagree' WHEN greatest({RESIDUAL}, spread / 2) > 10 THEN 'too uncertain' ELSE 'passed' END AS reason
    FROM f LEFT JOIN a USING (measurement_id))
SELECT measurement_id, reason = 'passed' AS valid, reason, CASE WHEN reason = 'passed' THEN round_even(camera_z + d, 0) END AS proposed_z,
       CASE WHEN reason = 'passed' THEN round(u, 6) END AS uncertainty,
       CASE WHEN reason = 'passed' THEN round(least(0.99, greatest(0, 0.2 * least(1, coverage / 0.35) + 0.2 * least(1, support / 0.8) + 0.15 * greatest(0, 1 - lr_error / 1.5) + 0.15 * greatest(0, 1 - mad / 2) + 0.15 * greatest(0, 1 - spread / 8) + 0.15 * {1 - RESIDUAL / 5})), 6) END AS confidence
FROM v""",
    ),
    "pln9": (
        _of("soil_points")(lambda p: runs.soil_candidates(p, BED, CAPTURE_BASELINE).groupBy("id").agg(F.count("*").alias("places"), F.round(F.max("distance_mm"), 6).alias("furthest_mm"))),
        """
WITH o AS (SELECT (a.range - 8) * 25 AS dx, (b.range - 8) * 25 AS dy FROM range(17) a, range(17) b WHERE sqrt(power((a.range - 8) * 25, 2) + power((b.range - 8) * 25, 2)) < 200),
c AS (SELECT id, x + dx AS x, y + dy AS y, sqrt(dx * dx + dy * dy) AS d FROM soil_points, o)
SELECT id, count(*) AS places, round(max(d), 6) AS furthest_mm FROM c
WHERE x BETWEEN 0 AND 3000 AND y BETWEEN 0 AND 1500 AND ((y - 120 >= 0 AND y + 120 <= 1500) OR y + 240 <= 1500 OR y - 240 >= 0) GROUP BY id""",
    ),
}
