"""Zone verdicts and camera transforms over weeds, plants and images."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from canopia.operators import transforms as T
from canopia.operators import zones as Z
from canopia.plans.garden import _of

BED = Z.rectangle("bed", "boundary", 0, 0, 3000, 1500, allows=("weeds", "centers", "radius"))
POND = Z.Zone("pond", "exclusion", circle=(1500.0, 750.0, 200.0))
SHED = Z.rectangle("shed", "exclusion", 200, 200, 600, 500, allows=("centers",))
HEDGE = Z.Zone("hedge", "exclusion", points=((2000.0, 200.0), (2600.0, 300.0), (2300.0, 900.0)), allows=("weeds",))
ZONES = [BED, POND, SHED, HEDGE]
CAMERA = T.Calibration(0.8, 0.9, rotation=12.0, offset_x=15.0, offset_y=-20.0, sign_x=1, sign_y=-1)
WIDTH, HEIGHT = 960, 720
_COS, _SIN = (f"{v!r}e0" for v in CAMERA.turn)

_EDGES = "e(zone, x1, y1, x2, y2) AS (SELECT * FROM (VALUES ('shed',200,200,600,200),('shed',600,200,600,500),('shed',600,500,200,500),('shed',200,500,200,200),('hedge',2000,200,2600,300),('hedge',2600,300,2300,900),('hedge',2300,900,2000,200)))"
_T = "greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"
_DIST = f"min(sqrt(power(x - x1 - {_T} * (x2 - x1), 2) + power(y - y1 - {_T} * (y2 - y1), 2)))"
_RAY = "sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * 1.0 / (y2 - y1) * (x2 - x1) THEN 1 ELSE 0 END) % 2 = 1"


def _measured(table: str) -> str:
    """SQL: distance to each border and whether the centre is inside, per row."""
    return f"{_EDGES}, z AS (SELECT id, x, y, radius, zone, {_DIST} AS edge, {_DIST} <= 1e-9 OR {_RAY} AS inside FROM {table}, e GROUP BY ALL), m AS (SELECT id, x, y, radius, max(edge) FILTER (zone = 'shed') AS shed_mm, max(edge) FILTER (zone = 'hedge') AS hedge_mm, bool_or(inside) FILTER (zone = 'shed') AS in_shed, bool_or(inside) FILTER (zone = 'hedge') AS in_hedge, abs(sqrt((x - 1500) * (x - 1500) + (y - 750) * (y - 750)) - 200) AS pond_mm, sqrt((x - 1500) * (x - 1500) + (y - 750) * (y - 750)) <= 200 AS in_pond FROM z GROUP BY ALL)"


def _pixels(p, i):
    """Plants and images are paired ey number, not ey place: the transform is the matter here."""
    return p.join(i.select((F.col("id") + 1).alias("id"), F.col("x").alias("ix"), F.col("y").alias("iy")), "id")


_PAIR = "SELECT p.id, p.x, p.y, p.radius, i.x AS ix, i.y AS iy FROM plants p JOIN images i ON i.id + 1 = p.id"
_VX, _VY = "((x - ix - 15) * 0.8)", "((y - iy + 20) * -0.9)"
_PX, _PY = f"(480 + {_VX} * {_COS} + {_VY} * {_SIN})", f"(360 + {_VY} * {_COS} - {_VX} * {_SIN})"
_DISC = "k AS (SELECT a.i / 20.0 - 1 AS u, b.i / 20.0 - 1 AS v FROM range(41) a(i), range(41) b(i) WHERE (a.i / 20.0 - 1) * (a.i / 20.0 - 1) + (b.i / 20.0 - 1) * (b.i / 20.0 - 1) <= 1)"


def _round(names, columns):
    return [F.round(c, 4).alias(n) for n, c in zip(names, columns, strict=True)]


def _near_camera(rows):
    px, py = T.garden_to_pixel(F.col("x"), F.col("y"), F.floor(F.col("x") / 373) * 373.0, F.floor(F.col("y") / 294) * 294.0, WIDTH, HEIGHT, CAMERA)
    return rows.select("id", "radius", px.alias("px"), py.alias("py"))


def _cut(weeds, angle):
    length = F.least(F.lit(300.0), F.greatest(F.lit(80.0), F.col("radius") * 2 + 60))
    return weeds.withColumn("s", T.bounded_segment(F.col("x"), F.col("y"), F.col("radius"), F.lit(angle), length, (0.0, 3000.0), (0.0, 1500.0))).where("s IS NOT NULL")


_LEN = "least(300, greatest(80, radius * 2 + 60))"
_A = math.radians(35)
_UX, _UY = math.cos(_A), math.sin(_A)
_SCALE = f"least(1, x / ({_LEN} / 2 * {_UX}), (3000 - x) / ({_LEN} / 2 * {_UX}), y / ({_LEN} / 2 * {_UY}), (1500 - y) / ({_LEN} / 2 * {_UY}))"
_SEG = f"SELECT id, least(3000, greatest(0, x - {_UX} * h)) AS sx, least(1500, greatest(0, y - {_UY} * h)) AS sy, least(3000, greatest(0, x + {_UX} * h)) AS ex, least(1500, greatest(0, y + {_UY} * h)) AS ey FROM (SELECT *, {_LEN} / 2 * greatest(0, {_SCALE}) AS h FROM weeds WHERE {_SCALE} * {_LEN} >= greatest(20, radius * 2))"

PLANS = {
    "zon1": (_of("weeds")(lambda w: w.select("id", *[Z.contains(z, F.col("x"), F.col("y")).alias(f"in_{z.name}") for z in (POND, SHED, HEDGE)])),
             f"WITH {_measured('weeds')} SELECT id, in_pond, in_shed, in_hedge FROM m"),
    "zon2": (_of("weeds")(lambda w: w.select("id", *[F.round(Z.edge_distance(z, F.col("x"), F.col("y")), 4).alias(f"{z.name}_mm") for z in (POND, SHED, HEDGE)])),
             f"WITH {_measured('weeds')} SELECT id, round(pond_mm, 4) AS pond_mm, round(shed_mm, 4) AS shed_mm, round(hedge_mm, 4) AS hedge_mm FROM m"),
    "zon3": (_of("plants")(lambda p: p.select("id", *[f(z, F.col("x"), F.col("y"), F.col("radius")).alias(f"{n}_{z.name}") for z in (POND, SHED, HEDGE) for n, f in (("holds", Z.contains_disc), ("meets", Z.overlaps_disc))])),
             f"WITH {_measured('plants')} SELECT id, " + ", ".join(f"in_{z} AND (radius <= 0 OR {z}_mm >= radius) AS holds_{z}, in_{z} OR (radius > 0 AND {z}_mm <= radius) AS meets_{z}" for z in ("pond", "shed", "hedge")) + " FROM m"),
    "zon4": (_of("weeds")(lambda w: _cut(w, _A).select("id", Z.touches_segment(SHED, (F.col("s.sx"), F.col("s.sy")), (F.col("s.ex"), F.col("s.ey"))).alias("touches_shed"))),
             # a segment meets a rectangle if the parameter ranges inside both slabs overlap
             f"WITH g AS ({_SEG}) SELECT id, greatest(0, (200 - sx) / (ex - sx), (200 - sy) / (ey - sy)) <= least(1, (600 - sx) / (ex - sx), (500 - sy) / (ey - sy)) AS touches_shed FROM g"),
    "zon5": (_of("plants")(lambda p: p.withColumn("v", Z.evaluate(ZONES, "radius", F.col("x"), F.col("y"), F.col("radius"))).select("id", "v.allowed", "v.step", "v.zone")),
             f"WITH {_measured('plants')}, v AS (SELECT id, CASE WHEN in_pond OR pond_mm <= radius THEN {{'allowed': false, 'step': 2, 'zone': 'pond'}} WHEN in_shed OR shed_mm <= radius THEN {{'allowed': false, 'step': 2, 'zone': 'shed'}} WHEN in_hedge OR hedge_mm <= radius THEN {{'allowed': false, 'step': 2, 'zone': 'hedge'}} WHEN x BETWEEN 0 AND 3000 AND y BETWEEN 0 AND 1500 THEN {{'allowed': true, 'step': 4, 'zone': 'bed'}} ELSE {{'allowed': false, 'step': 4, 'zone': NULL}} END AS v FROM m) SELECT id, v.allowed AS allowed, v.step AS step, v.zone AS zone FROM v"),
    "zon6": (_of("weeds")(lambda w: w.withColumn("v", Z.weeds_allowed(ZONES, F.col("x"), F.col("y"))).select("id", "v.allowed", "v.zone")),
             f"WITH {_measured('weeds')} SELECT id, CASE WHEN in_hedge THEN true WHEN in_pond OR in_shed THEN false ELSE x BETWEEN 0 AND 3000 AND y BETWEEN 0 AND 1500 END AS allowed, CASE WHEN in_hedge THEN 'hedge' WHEN in_pond THEN 'pond' WHEN in_shed THEN 'shed' WHEN x BETWEEN 0 AND 3000 AND y BETWEEN 0 AND 1500 THEN 'bed' END AS zone FROM m"),
    "q42": (_of("weeds")(lambda w: w.withColumn("v", Z.weeds_allowed(ZONES, F.col("x"), F.col("y"))).where("NOT v.allowed").select("id", "v.step", "v.zone")),
            f"""
WITH {_measured('weeds')}
SELECT id, CASE WHEN in_pond OR in_shed THEN 2 ELSE 4 END AS step, CASE WHEN in_pond THEN 'pond' WHEN in_shed THEN 'shed' END AS zone
FROM m WHERE NOT in_hedge AND (in_pond OR in_shed OR NOT (x BETWEEN 0 AND 3000 AND y BETWEEN 0 AND 1500))"""),
    "zon7": (_of("weeds")(lambda w: w.select("id", F.round(F.least(*[F.sqrt((F.col("x") - a) * (F.col("x") - a) + (F.col("y") - b) * (F.col("y") - b)) - c for a, b, c in map(Z.obstacle, (POND, SHED, HEDGE))]), 4).alias("clearance_mm"))),
             "SELECT id, round(min(sqrt((x - a) * (x - a) + (y - b) * (y - b)) - c), 4) AS clearance_mm FROM weeds, (VALUES (1500, 750, 200), (400, 350, 250), (2300, 1400 / 3.0, 1300 / 3.0)) o(a, b, c) GROUP BY id"),
    "geo1": (_of("plants", "images")(lambda p, i: _pixels(p, i).select("id", *_round(("px", "py"), T.garden_to_pixel(F.col("x"), F.col("y"), F.col("ix"), F.col("iy"), WIDTH, HEIGHT, CAMERA)))),
             f"SELECT id, round({_PX}, 4) AS px, round({_PY}, 4) AS py FROM ({_PAIR})"),
    "geo2": (_of("plants", "images")(lambda p, i: _pixels(p, i).select("id", *_round(("gx", "gy"), T.pixel_to_garden(F.col("x") % 960, F.col("y") % 720, F.col("ix"), F.col("iy"), WIDTH, HEIGHT, CAMERA)))),
             f"SELECT id, round(ix + 15 + (({_COS}) * (x % 960 - 480) - ({_SIN}) * (y % 720 - 360)) / 0.8, 4) AS gx, round(iy - 20 + (({_SIN}) * (x % 960 - 480) + ({_COS}) * (y % 720 - 360)) / -0.9, 4) AS gy FROM ({_PAIR})"),
    "geo4": (_of("plants", "images")(lambda p, i: _pixels(p, i).withColumn("t", T.relative_transform(F.col("x"), F.col("y"), F.col("ix"), F.col("iy"), WIDTH, HEIGHT, CAMERA)).select("id", *_round(("a", "c", "f"), (F.col("t.a"), F.col("t.c"), F.col("t.f"))))),
             f"SELECT id, round(({_COS}) / 0.8, 4) AS a, round(-(x - ix - 15) - ({_COS} * 480 - ({_SIN}) * 360) / 0.8, 4) AS c, round(-(y - iy + 20) - ({_SIN} * 480 + {_COS} * 360) / -0.9, 4) AS f FROM ({_PAIR})"),
    "geo5": (_of("plants")(lambda p: T.visibility(_near_camera(p), WIDTH, HEIGHT, CAMERA).select("id", F.round("visible_fraction", 4).alias("visible_fraction"), F.size("visible_sectors").alias("sectors"))),
             f"""WITH {_DISC}, c AS (SELECT id, greatest(1, radius) AS r, {_PX} AS px, {_PY} AS py FROM (SELECT *, floor(x / 373) * 373 AS ix, floor(y / 294) * 294 AS iy FROM plants)),
a AS (SELECT id, r, px, py, u * r * 0.8 AS vx, v * r * -0.9 AS vy FROM c, k), d AS (SELECT id, px + vx * {_COS} + vy * {_SIN} AS x, py + vy * {_COS} - vx * {_SIN} AS y FROM a),
s AS (SELECT id, px + cos(t) * r * 0.8 * {_COS} + sin(t) * r * -0.9 * {_SIN} AS x, py + sin(t) * r * -0.9 * {_COS} - cos(t) * r * 0.8 * {_SIN} AS y FROM c, (SELECT range * 2 * pi() / 72 AS t FROM range(72)))
SELECT id, visible_fraction, sectors FROM (SELECT id, round(avg(CASE WHEN x >= 0 AND x < 960 AND y >= 0 AND y < 720 THEN 1.0 ELSE 0 END), 4) AS visible_fraction FROM d GROUP BY id) JOIN (SELECT id, count(*) FILTER (x >= 0 AND x < 960 AND y >= 0 AND y < 720) AS sectors FROM s GROUP BY id) USING (id)"""),
    "geo7": (_of("plants")(lambda p: p.select("id", F.round(T.frame_coverage(F.col("x"), F.col("y"), F.col("radius"), F.floor(F.col("x") / 373) * 373.0, F.floor(F.col("y") / 294) * 294.0, 200.0, 150.0, CAMERA), 4).alias("coverage"))),
             f"WITH {_DISC}, d AS (SELECT id, (x + u * greatest(1, radius) - floor(x / 373) * 373 - 15) AS dx, -(y + v * greatest(1, radius) - floor(y / 294) * 294 + 20) AS dy FROM plants, k) SELECT id, round(avg(CASE WHEN abs(dx * {_COS} + dy * {_SIN}) <= 200 AND abs(dy * {_COS} - dx * {_SIN}) <= 150 THEN 1.0 ELSE 0 END), 4) AS coverage FROM d GROUP BY id"),
    "geo8": (_of("detections")(lambda d: d.select("detection_id", *_round(("gx", "gy"), T.blob_to_garden(F.col("score"), F.col("x") / 3000, F.col("x"), F.col("y"), 200.0, 150.0, CAMERA)))),
             f"SELECT detection_id, round(x + 15 + ((score - 0.5) * 400) * {_COS} - ((x / 3000 - 0.5) * 300) * ({_SIN}), 4) AS gx, round(y - 20 - (((score - 0.5) * 400) * ({_SIN}) + ((x / 3000 - 0.5) * 300) * {_COS}), 4) AS gy FROM detections"),
    "geo9": (_of("plants")(lambda p: p.select("id", *[c.alias(n) for n, c in zip(("w", "h"), T.footprint(F.col("x") + 10, F.col("y") + 10, F.col("age_days").cast("double")), strict=True)])),
             """WITH q AS (SELECT id, x + 10 AS w, y + 10 AS h, abs(sin(radians(age_days))) AS s, abs(cos(radians(age_days))) AS c FROM plants)
SELECT id, round(CASE WHEN s < 1e-12 THEN w WHEN least(w, h) <= 2 * s * c * greatest(w, h) OR abs(s - c) < 1e-12 THEN greatest(1, least(w, h) / 2 / CASE WHEN w >= h THEN s ELSE c END) ELSE greatest(1, (w * c - h * s) / (c * c - s * s)) END, 3) AS w,
round(CASE WHEN s < 1e-12 THEN h WHEN least(w, h) <= 2 * s * c * greatest(w, h) OR abs(s - c) < 1e-12 THEN greatest(1, least(w, h) / 2 / CASE WHEN w >= h THEN c ELSE s END) ELSE greatest(1, (h * c - w * s) / (c * c - s * s)) END, 3) AS h FROM q"""),
    "geo14": (_of("weeds")(lambda w: _cut(w, _A).select("id", *_round(("sx", "sy", "ex", "ey"), [F.col(f"s.{n}") for n in ("sx", "sy", "ex", "ey")]))),
              f"SELECT id, round(sx, 4) AS sx, round(sy, 4) AS sy, round(ex, 4) AS ex, round(ey, 4) AS ey FROM ({_SEG})"),
}
