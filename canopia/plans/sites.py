"""Soil capture sites; the grid plan has the same question in SQL, the assignment of all points is tested against its loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.operators import assignment
from canopia.plans.garden import _of

BED, FIELD = (0.0, 0.0, 3000.0, 1500.0), (0.0, 0.0, 3e6, 1500.0)
BASELINE, MARGIN, SPACING, DEVIATION = 12.0, 20.0, 200.0, 60.0
CUTOFF = "2024-06-01"


def _points(points):
    """Beds side by side, 1,500 points each; one in eleven has no date."""
    at = F.expr("TIMESTAMP '2023-01-01 00:00:00' + INTERVAL '1' DAY * CAST(id % 700 AS INT)")
    return points.select("id", (F.col("x") + 3000 * F.floor(F.col("id") / 1501)).alias("x"), "y", F.when(F.col("id") % 11 != 0, at).alias("updated_at"))


def _weeds(weeds):
    return weeds.select((F.col("x") + 3000 * F.floor(F.col("id") / 101)).alias("x"), "y", "radius")


def _sites(points, weeds):
    found = assignment.safe_sites(_points(points), _weeds(weeds), [], FIELD, BASELINE, MARGIN, F.lit(CUTOFF).cast("timestamp"))
    return found.select("id", "site_x", "site_y", F.round("distance_mm", 6).alias("distance_mm"), F.round("clearance_mm", 6).alias("clearance_mm"))


def _grid(points, weeds):
    found = assignment.measurement_grid(_points(points), _weeds(weeds), [], BED, SPACING, DEVIATION, BASELINE, MARGIN, F.lit(CUTOFF).cast("timestamp"))
    rounded = {c: F.round(c, 6) for c in ("deviation_mm", "clearance_mm")}
    return found.withColumns(rounded | {c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("point_id", "hint_mm")})


def _fold(name: str, source: str) -> str:
    """Turn by turn the first option whose item is left, from source (turn, item, rank...) as lists c."""
    return f"""
{name}q AS (SELECT turn, c, ROW_NUMBER() OVER (ORDER BY turn) AS k FROM {source}),
{name}(k, taken, turn, pick) AS (
    SELECT 0::BIGINT, list_slice(list(item), 1, 0), NULL::BIGINT, NULL::INT FROM (SELECT unnest(c).item AS item FROM {source})
    UNION ALL
    SELECT q.k, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, q.c[p].item) END, q.turn, p
    FROM (SELECT s.k AS was, taken, q.k AS k, q.turn AS turn, q.c AS c, list_position(list_transform(q.c, lambda v: NOT list_contains(taken, v.item)), true) AS p FROM {name} s JOIN {name}q q ON q.k = s.k + 1) q)"""


PLANS = {
    "pln7": (_of("soil_points", "weeds")(_sites), None),
    "pln8": (
        _of("soil_points", "weeds")(_grid),
        f"""
WITH RECURSIVE pt AS (SELECT id, x + 3000 * floor(id / 1501) AS x, y, CASE WHEN id % 11 <> 0 THEN TIMESTAMP '2023-01-01 00:00:00' + INTERVAL '1' DAY * CAST(id % 700 AS INT) END AS seen FROM soil_points),
wd AS (SELECT x + 3000 * floor(id / 101) AS x, y, radius FROM weeds),
gr AS (SELECT b.range * 15 + a.range AS turn, 100 + a.range * 200 AS gx, 100 + b.range * 200 AS gy FROM range(15) a, range(8) b),
nr AS (SELECT turn, list({{'item': id, 'd': sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy))}} ORDER BY sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)), id) AS c
       FROM gr JOIN pt ON sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)) < 200 GROUP BY turn),
{_fold("an", "nr")},
hd AS (
    SELECT gr.*, pt.id AS point_id, pt.x AS px, pt.y AS py, CASE WHEN pt.id IS NULL THEN 'no point' WHEN seen IS NULL THEN 'no date' WHEN seen >= TIMESTAMP '{CUTOFF} 00:00:00' THEN 'recent' END AS early
    FROM gr LEFT JOIN (SELECT an.turn, anq.c[pick].item AS id FROM an JOIN anq ON anq.turn = an.turn WHERE pick IS NOT NULL) w ON w.turn = gr.turn LEFT JOIN pt ON pt.id = w.id),
ol AS (SELECT (a.range - 8) * 25 AS dx, (b.range - 8) * 25 AS dy FROM range(17) a, range(17) b WHERE sqrt(power((a.range - 8) * 25, 2) + power((b.range - 8) * 25, 2)) < 200),
s0 AS (
    SELECT turn, gx + dx AS x, gy + dy AS y, sqrt(dx * dx + dy * dy) AS d, abs(dx) + abs(dy) AS walk FROM hd, ol
    WHERE early IS NULL AND gx + dx BETWEEN 0 AND 3000 AND gy + dy BETWEEN 0 AND 1500 AND sqrt(power(gx + dx - px, 2) + power(gy + dy - py, 2)) < 200
      AND ((gy + dy - 12 >= 0 AND gy + dy + 12 <= 1500) OR gy + dy + 24 <= 1500 OR gy + dy - 24 >= 0)),
rm AS (SELECT x, y, min(sqrt((x - wx) * (x - wx) + (y - wy) * (y - wy)) - radius) - 24 AS m FROM (SELECT DISTINCT x, y FROM s0), (SELECT x AS wx, y AS wy, radius FROM wd) GROUP BY x, y),
si AS (SELECT s0.*, CASE WHEN m < 0 THEN -1 ELSE m END AS m, CAST(round(y * 1000) AS BIGINT) * 100000000 + CAST(round(x * 1000) AS BIGINT) AS item FROM s0 JOIN rm USING (x, y)),
al AS (SELECT turn, list({{'item': item, 'x': x, 'y': y, 'd': d, 'm': m}} ORDER BY d, walk, x, y) AS c FROM si WHERE m + 1e-6 >= {MARGIN} AND d <= {DEVIATION} + 1e-6 GROUP BY turn),
{_fold("ch", "al")},
pk AS (SELECT ch.turn, chq.c[pick] AS v FROM ch JOIN chq ON chq.turn = ch.turn WHERE pick IS NOT NULL),
lf AS (SELECT si.turn, min(si.d) AS nearest FROM si LEFT JOIN pk ON pk.v.item = si.item WHERE si.m + 1e-6 >= {MARGIN} AND (pk.turn IS NULL OR pk.turn >= si.turn) GROUP BY si.turn),
bs AS (SELECT turn, max(m) AS roomiest FROM si WHERE d <= {DEVIATION} + 1e-6 AND m >= 0 GROUP BY turn)
SELECT CAST(gx AS DOUBLE) AS grid_x, CAST(gy AS DOUBLE) AS grid_y, coalesce(point_id, -1) AS point_id, CAST(v.x AS DOUBLE) AS site_x, CAST(v.y AS DOUBLE) AS site_y, round(v.d, 6) AS deviation_mm, round(greatest(0, v.m - {MARGIN}), 6) AS clearance_mm,
       CASE WHEN v IS NULL THEN 'skipped' WHEN v.d < 0.001 THEN 'clear' ELSE 'replaced' END AS status,
       CASE WHEN v IS NULL THEN coalesce(early, CASE WHEN nearest IS NOT NULL THEN 'deviation' WHEN roomiest IS NOT NULL THEN 'margin' ELSE 'blocked' END) END AS reason,
       coalesce(CASE WHEN v IS NULL AND early IS NULL THEN CAST(coalesce(ceil(nearest), floor(roomiest)) AS BIGINT) END, -1) AS hint_mm
FROM hd LEFT JOIN pk ON pk.turn = hd.turn LEFT JOIN lf ON lf.turn = hd.turn LEFT JOIN bs ON bs.turn = hd.turn""",
    ),
}
