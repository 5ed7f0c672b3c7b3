"""Cuts, routes and orders of weeding runs; the search over angles and the chain have the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.operators import cutting
from canopia.plans.garden import _of

#: Every hundred weeds have a bed of their own, side by side; plants thin out with them.
WIDTH, DEPTH = 3000.0, 1500.0
FIELD = 3e6
#: For routes all plants stand, so beds are smaller and more: so many weeds and plants share one.
WEEDS, PLANTS, FIELDS = 11, 220, 3e9
#: Plants taller than this, or of unknown height, are gone around; the reference's default.
TALL = 300.0


def _weeds(weeds, each: int = 101):
    bed = F.floor(F.col("id") / each)
    return weeds.select("id", bed.alias("bed_id"), (F.col("x") + WIDTH * bed).alias("x"), "y", "radius")


def _plants(plants, each: int = 2001):
    bed = F.floor(F.col("id") / each)
    return plants.select("id", bed.alias("bed_id"), (F.col("x") + WIDTH * bed).alias("x"), "y", (F.col("radius") / 2).alias("radius"), "height_mm")


def _cuts(weeds, plants, field: float = FIELD):
    return cutting.cut_paths(weeds, plants, (0.0, field), (0.0, DEPTH))


def _shown(rows):
    return rows.select("id", "partial", "degrees", *[F.round(c, 4).alias(c) for c in ("sx", "sy", "ex", "ey", "length_mm", "clearance_mm")])


def _routes(weeds, plants):
    own, all_ = _weeds(weeds, WEEDS), _plants(plants, PLANTS)
    bed = F.col("bed_id") * WIDTH
    trips = _cuts(own, all_, FIELDS).join(own.select("id", "bed_id"), "id")
    trips = trips.select(F.col("id").alias("route_id"), "bed_id", bed.alias("x"), F.lit(0.0).alias("y"), "sx", "sy", "ex", "ey", bed.alias("x0"), F.lit(0.0).alias("y0"), (bed + WIDTH).alias("x1"), F.lit(DEPTH).alias("y1"))
    found = cutting.routes(trips, all_.where(F.col("height_mm").isNull() | (F.col("height_mm") > TALL)), end_margin=0.0)
    return found.select("route_id", "reversed", F.size("waypoints").alias("turns"), F.round("length_mm", 4).alias("length_mm"), "error")


def _order(weeds):
    own = _weeds(weeds)
    paths = own.select(F.col("bed_id").alias("run_id"), "id", (F.col("x") - 50).alias("sx"), F.col("y").alias("sy"), (F.col("x") + 61).alias("ex"), (F.col("y") + F.col("radius")).alias("ey"))
    return cutting.ordered(paths, own.groupBy(F.col("bed_id").alias("run_id")).agg(F.min("x").alias("x"), F.min("y").alias("y")))


_SEEN = """SELECT id, d, sx, sy, ex, ey, coalesce(min(c), 10000) AS cl, coalesce(sum(power(greatest(0, 150 - c), 2)), 0) AS pen
    FROM (SELECT *, sqrt(power(px - sx - t * (ex - sx), 2) + power(py - sy - t * (ey - sy), 2)) - pr - 25 AS c
          FROM (SELECT l.*, p.x AS px, p.y AS py, p.radius AS pr, greatest(0, least(1, ((p.x - sx) * (ex - sx) + (p.y - sy) * (ey - sy)) / (power(ex - sx, 2) + power(ey - sy, 2)))) AS t FROM {0} l LEFT JOIN pl p ON true))
    GROUP BY ALL HAVING cl >= 0"""
_PICK = "QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY round(cl, 6) DESC, round(pen, 6), round(sqrt(power(ex - sx, 2) + power(ey - sy, 2)), 6) DESC, d) = 1"

PLANS = {
    "pln2": (
        _of("weeds", "plants")(lambda w, p: _shown(_cuts(_weeds(w), _plants(p).where("id % 9 = 0")))),
        f"""
WITH wd AS (SELECT id, x + 3000 * floor(id / 101) AS x, y, radius, least(220, greatest(100, radius * 2 + 60)) / 2 AS half, greatest(20, radius + 30) AS part FROM weeds),
pl AS (SELECT x + 3000 * floor(id / 2001) AS x, y, radius / 2 AS radius FROM plants WHERE id % 9 = 0),
an AS (SELECT range AS d, cos(radians(range)) AS ux, sin(radians(range)) AS uy FROM range(0, 360, 5)),
lf AS (
    SELECT id, d, greatest(0, x - ux * half * s) AS sx, least(1500, greatest(0, y - uy * half * s)) AS sy, x + ux * half * s AS ex, least(1500, greatest(0, y + uy * half * s)) AS ey
    FROM (SELECT wd.*, an.*, least(1, CASE WHEN abs(ux) < 1e-9 OR x >= half * abs(ux) THEN 1 ELSE x / (half * abs(ux)) END,
                 CASE WHEN abs(uy) < 1e-9 OR y >= half * abs(uy) THEN 1 ELSE y / (half * abs(uy)) END, CASE WHEN abs(uy) < 1e-9 OR 1500 - y >= half * abs(uy) THEN 1 ELSE (1500 - y) / (half * abs(uy)) END) AS s
          FROM wd, an WHERE d < 180) WHERE s * half * 2 >= greatest(20, radius * 2)),
fb AS (SELECT * FROM ({_SEEN.format('lf')}) {_PICK}),
lp AS (
    SELECT id, d, x - ux * f AS sx, y - uy * f AS sy, x AS ex, y AS ey
    FROM (SELECT wd.*, an.*, least(part, CASE WHEN abs(ux) < 1e-9 THEN part WHEN ux > 0 THEN x / ux ELSE (x - {FIELD}) / ux END, CASE WHEN abs(uy) < 1e-9 THEN part WHEN uy > 0 THEN y / uy ELSE (y - 1500) / uy END) AS f
          FROM wd, an WHERE id NOT IN (SELECT id FROM fb)) WHERE f >= 20),
pb AS (SELECT * FROM ({_SEEN.format('lp')}) {_PICK}),
bo AS (SELECT *, false AS partial FROM fb UNION ALL SELECT *, true FROM pb)
SELECT id, partial, CAST(d % 180 AS INT) AS degrees, round(sx, 4) AS sx, round(sy, 4) AS sy, round(ex, 4) AS ex, round(ey, 4) AS ey, round(sqrt(power(ex - sx, 2) + power(ey - sy, 2)), 4) AS length_mm, round(cl, 4) AS clearance_mm FROM bo""",
    ),
    "pln3": (_of("weeds", "plants")(_routes), None),
    "pln5": (
        _of("weeds")(_order),
        """
WITH RECURSIVE p AS (
    SELECT CAST(floor(id / 101) AS BIGINT) AS run_id, id, x + 3000 * floor(id / 101) - 50 AS sx, y AS sy, x + 3000 * floor(id / 101) + 61 AS ex, y + radius AS ey, x + 3000 * floor(id / 101) AS x FROM weeds),
c AS (
    SELECT run_id, -1::BIGINT AS k, min(x) AS x, min(sy) AS y, [-1::BIGINT] AS done, NULL::BIGINT AS id, NULL::BOOLEAN AS turned FROM p GROUP BY run_id
    UNION ALL
    SELECT run_id, k, CASE WHEN b.back THEN b.sx ELSE b.ex END, CASE WHEN b.back THEN b.sy ELSE b.ey END, list_append(done, b.id), b.id, b.back
    FROM (SELECT c.run_id, c.k + 1 AS k, done,
                 (SELECT first({'id': p.id, 'sx': p.sx, 'sy': p.sy, 'ex': p.ex, 'ey': p.ey, 'back': sqrt(power(p.ex - c.x, 2) + power(p.ey - c.y, 2)) < sqrt(power(p.sx - c.x, 2) + power(p.sy - c.y, 2))}
                         ORDER BY least(sqrt(power(p.sx - c.x, 2) + power(p.sy - c.y, 2)), sqrt(power(p.ex - c.x, 2) + power(p.ey - c.y, 2))), p.id)
                  FROM p WHERE p.run_id = c.run_id AND NOT list_contains(c.done, p.id)) AS b
          FROM c) WHERE b IS NOT NULL)
SELECT run_id, id, k AS position, turned AS "reversed" FROM c WHERE id IS NOT NULL""",
    ),
}
