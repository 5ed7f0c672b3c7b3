"""Photographs of pixel rows: masks, islands and ownership, each with the same question in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from canopia.functions import rasters as R
from canopia.operators import fusion, inspection, ownership, photos, stereo
from canopia.plans.garden import _of
from canopia.sources.shared import cut

WIDTH, HEIGHT, PPM = 64, 48, 0.4
OPEN, CLOSE, REACH, WEED_CLOSE = 3, 5, 4, 1
GAP, SPAN, MARGIN = 4.0, 20.0, 20.0
BOX = ("x0", "y0", "x1", "y1")


def _images(pixels):
    raster = photos.rastered(pixels, HEIGHT, WIDTH)
    return photos.scaled(raster.withColumns({"ppm_x": F.lit(PPM), "ppm_y": F.lit(PPM), "rotation": F.lit(0.0)}))


def _masks(pixels):
    return cut(photos.vegetation(_images(pixels)))


def _summed(pixels, layer):
    own = pixels.groupBy("image_id").agg(F.count("*").alias("pixels"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))
    return own.select("image_id", F.lit(layer).alias("layer"), "pixels", "sum_x", "sum_y")


def _layers(pixels):
    masks = _masks(pixels)
    parts = [_summed(photos.pixels_of(masks, n), n) for n in ("strong", "pale", "mask")]
    least = masks.select("image_id", F.lit("threshold").alias("layer"), F.col("threshold").cast("long").alias("pixels"), F.lit(0).cast("long").alias("sum_x"), F.lit(0).cast("long").alias("sum_y"))
    return reduce(lambda a, b: a.unionByName(b), parts, least)


def _weed(pixels):
    canopy = _masks(pixels).select("image_id", F.col("mask").alias("canopy"))
    return _summed(photos.pixels_of(photos.weed_vegetation(_images(pixels).join(canopy, "image_id"))), "weed")


def _valid(pixels):
    limits = _images(pixels).select("image_id", "min_area", "max_area", "line_area")
    return photos.valid(photos.islands(_masks(pixels)).join(limits, "image_id")).select("image_id", "label", *BOX, "area")


def _groups(pixels):
    islands = cut(photos.islands(_masks(pixels)))
    return photos.group_boxes(islands, photos.bounded_groups(islands, GAP, SPAN)).select("image_id", "group", *BOX, "area", "islands")


def _owned(pixels, plants):
    masks = _masks(pixels)
    frames = cut(_images(pixels).join(masks.select("image_id", "mask"), "image_id"))
    history = masks.join(plants.where("plant_id % 2 = 0").select("image_id", "plant_id"), "image_id").select("image_id", "plant_id", F.col("strong").alias("mask"))
    found, _ = ownership.owned_pixels(frames, plants, history, MARGIN, tile=16)
    own = found.groupBy("image_id", F.coalesce("plant_id", F.lit(-1)).alias("plant_id"))
    return own.agg(F.count("*").alias("pixels"), F.count_if("ambiguous").alias("ambiguous"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


#: Images are views of a plant, three each, turned a little and moved by known millimetres.
TURN, STEP_X, STEP_Y, SINGLE = 0.3, 7.3, 5.1, 0.6


def _views(pixels):
    nth, plant = F.col("image_id") % 3, F.floor(F.col("image_id") / 3)
    to_mm = F.array(F.lit(1 / PPM), F.lit(TURN), nth * STEP_X - 80, F.lit(-TURN), F.lit(1 / PPM), nth * STEP_Y - 60)
    known = {"plant_id": plant, "to_mm": to_mm, "scale": F.lit(PPM), "confidence": 0.5 + nth * 0.15, "current_mm": F.lit(70.0), "age_days": F.lit(30), "accepted_mm": 60.0 + nth * 5}
    return _masks(pixels).withColumns(known | {"image_timestamp": F.lit("2024-01-01").cast("timestamp")})


def _fused_cells(pixels):
    cells = fusion.fused_cells(fusion.canvases(_views(pixels)), {"single": SINGLE})
    sums = [F.count("*").alias("cells"), F.sum("support").alias("support"), F.sum("cx").alias("sum_x"), F.sum("cy").alias("sum_y"), F.round(F.sum("strongest"), 4).alias("strongest")]
    return cells.groupBy("plant_id").agg(*sums)


def _fused(pixels):
    rows = fusion.fuse(_views(pixels), {"single": SINGLE})
    return rows.select("plant_id", "views", "held", "broad", *[F.round(c, 6).alias(c) for c in ("typical_mm", "outer_mm", "recommended_mm", "confidence", "coverage", "corroborated", "spread_mm", "area_mm2")])


def _shifts(pixels):
    masks = _masks(pixels).select("image_id", "height", "width", "mask")
    later = masks.select((F.col("image_id") - 1).alias("image_id"), F.col("mask").alias("after"))
    return fusion.registered(masks.join(later, "image_id").select(F.col("image_id").alias("pair_id"), "height", "width", F.col("mask").alias("before"), "after"))


def _heights(pixels):
    """Three frames an image, each five pixels on from the one before at 15 mm."""
    shifted = pixels.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "x", "y", ((F.col("image_id") * 3072 + F.col("y") * WIDTH + F.col("x")) * 7919 % 41 * 6).alias("v"))
    rows = shifted.select((F.col("image_id") * 3 + F.col("k")).alias("image_id"), ((F.col("x") + 5 * F.col("k")) % WIDTH).alias("x"), "y", *[F.col("v").alias(c) for c in "bgr"])
    images = photos.rastered(rows, HEIGHT, WIDTH)
    grey = F.unhex(F.regexp_replace(F.hex("bgr"), "(..)....", "$1"))
    at = (F.col("image_id") % 3) * 15.0
    frames = images.select(F.floor(F.col("image_id") / 3).alias("measurement_id"), at.alias("lateral_mm"), at.alias("x"), F.lit(0.0).alias("y"), F.lit(300.0).alias("z"), "height", "width", grey.alias("grey"), F.lit(None).cast("binary").alias("usable"))
    found = stereo.estimate_triplets(frames)
    return found.select("measurement_id", "pair", "passes", "error", *[F.round(c, 4).alias(c) for c in ("normalised", "coverage", "support", "lr_error", "mad")])


def _inspected(pixels):
    rows = inspection.inspected(photos.rastered(pixels, HEIGHT, WIDTH), least_side=1)
    figures = [F.round(c, 6).alias(c) for c in ("washed_out", "obstruction", "blur", "vegetation", "clear", "sharpness", "laplacian", "edges", "contrast", "image_quality")]
    return rows.select("image_id", "issue", *figures, F.size("blobs").alias("blobs"), F.round(F.aggregate("blobs", F.lit(0.0), lambda a, b: a + b["u"] * b["area_fraction"]), 6).alias("weight_u"))


def _near(kernel) -> str:
    """b lies under the kernel around a."""
    return "(" + " OR ".join(f"(b.y - a.y = {dy} AND abs(b.x - a.x) <= {half})" for dy, half in kernel) + ")"


def _grown(source: str, kernel) -> str:
    return f"SELECT DISTINCT a.image_id, a.x, a.y FROM cv a JOIN {source} b ON a.image_id = b.image_id AND {_near(kernel)}"


def _shrunk(source: str, kernel) -> str:
    return f"SELECT image_id, x, y FROM cv EXCEPT SELECT a.image_id, a.x, a.y FROM cv a JOIN (SELECT image_id, x, y FROM cv EXCEPT SELECT image_id, x, y FROM {source}) b ON a.image_id = b.image_id AND {_near(kernel)}"


def _fixed(numerator: int, factor: str, by: str) -> str:
    """factor times the rounded table entry of `by`, in fixed point, rounded."""
    return f"CAST(floor(({factor} * CASE WHEN {by} = 0 THEN 0 ELSE CAST(round_even({numerator} / {by}, 0) AS BIGINT) END + 2048) / 4096.0) AS BIGINT)"


_COLOURS = f"""
cv AS (
    SELECT i.image_id, a.range AS x, c.range AS y, coalesce(b, 0) AS b, coalesce(g, 0) AS g, coalesce(r, 0) AS r
    FROM (SELECT DISTINCT image_id FROM photo_pixels) i CROSS JOIN range({WIDTH}) a CROSS JOIN range({HEIGHT}) c LEFT JOIN photo_pixels p ON p.image_id = i.image_id AND p.x = a.range AND p.y = c.range),
sp AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d, 2 * g - r - b AS e FROM cv),
hu AS (SELECT *, {_fixed(255 * 4096, "d", "v")} AS s, {_fixed(180 * 4096 // 6, "(CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END)", "d")} AS h0 FROM sp),
co AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS h FROM hu),
hi AS (SELECT image_id, greatest(0, least(255, e)) AS t, CAST(count(*) AS DOUBLE) AS c FROM co GROUP BY ALL),
cu AS (SELECT *, sum(c) OVER w AS n1, sum(c * t) OVER w AS s1, sum(c) OVER (PARTITION BY image_id) AS n, sum(c * t) OVER (PARTITION BY image_id) AS s FROM hi WINDOW w AS (PARTITION BY image_id ORDER BY t)),
bw AS (SELECT *, CASE WHEN n1 < n THEN (s1 * n - n1 * s) * (s1 * n - n1 * s) / (n1 * (n - n1)) ELSE 0 END AS between_classes FROM cu),
th AS (SELECT image_id, greatest(10, least(32, CASE WHEN between_classes > 0 THEN t ELSE 0 END)) AS least_e FROM bw QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY between_classes DESC, t) = 1),
st AS (SELECT image_id, x, y FROM co JOIN th USING (image_id) WHERE ((h BETWEEN 25 AND 100 AND s >= 35 AND v >= 25) OR (g > r * 0.92 AND g > b * 0.92)) AND e > least_e AND s > 22 AND v > 20),
pa AS (SELECT image_id, x, y FROM co WHERE h BETWEEN 20 AND 105 AND s >= 5 AND v >= 35 AND e >= 2 AND g >= r - 6 AND g >= b - 6 EXCEPT SELECT * FROM st),
rc AS (
    SELECT DISTINCT a.image_id, a.x, a.y FROM pa a JOIN st b ON a.image_id = b.image_id AND {_near(R.disc(REACH))}
    UNION SELECT p.image_id, p.x, p.y FROM rc JOIN pa p ON p.image_id = rc.image_id AND abs(p.x - rc.x) <= 1 AND abs(p.y - rc.y) <= 1),
un AS (SELECT * FROM st UNION SELECT * FROM rc),
o1 AS ({_shrunk("un", R.square(OPEN))}), o2 AS ({_grown("o1", R.square(OPEN))}), c1 AS ({_grown("o2", R.square(CLOSE))}),
mk AS ({_shrunk("c1", R.square(CLOSE))})"""
_SUMS = "count(*) AS pixels, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y"


def _labelled(source: str) -> str:
    """Labels of the islands of a mask: every first pixel of a run without a set one before it spreads; the least that arrives counts."""
    return f"""
s0 AS (SELECT a.image_id, a.x, a.y FROM {source} a WHERE NOT EXISTS (SELECT 1 FROM {source} b WHERE b.image_id = a.image_id AND ((b.y = a.y AND b.x = a.x - 1) OR (b.y = a.y - 1 AND abs(b.x - a.x) <= 1)))),
sq AS (
    SELECT image_id, y * {WIDTH} + x AS k, x, y FROM s0
    UNION SELECT sq.image_id, sq.k, p.x, p.y FROM sq JOIN {source} p ON p.image_id = sq.image_id AND abs(p.x - sq.x) <= 1 AND abs(p.y - sq.y) <= 1),
ro AS (SELECT image_id, x, y, min(k) AS k FROM sq GROUP BY ALL),
lb AS (SELECT image_id, x, y, DENSE_RANK() OVER (PARTITION BY image_id ORDER BY k) AS label FROM ro),
il AS (SELECT image_id, label, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS area FROM lb GROUP BY ALL)"""


_AREA = PPM * PPM
_LIMITS = (max(8, round(12 * _AREA)), round(200_000 * _AREA), round(max(8, round(12 * _AREA)) * 20))
_LINE = "greatest(x1 - x0, y1 - y0) > 9 * least(x1 - x0, y1 - y0)"
_WEED_CHOSEN = "(h BETWEEN 25 AND 100 AND s >= 45 AND e >= 20 AND v > 20) OR (h BETWEEN 17 AND 108 AND s >= 15 AND e >= 2 AND v > 20 AND g >= r - 4 AND g >= b - 4)"

PLANS = {
    "img3": (
        _of("photo_pixels")(_layers),
        f"""
WITH RECURSIVE {_COLOURS}
SELECT image_id, 'strong' AS layer, {_SUMS} FROM st GROUP BY image_id UNION ALL SELECT image_id, 'pale', {_SUMS} FROM rc GROUP BY image_id
UNION ALL SELECT image_id, 'mask', {_SUMS} FROM mk GROUP BY image_id UNION ALL SELECT image_id, 'threshold', CAST(least_e AS BIGINT), 0, 0 FROM th""",
    ),
    "img4": (
        _of("photo_pixels")(_weed),
        f"""
WITH RECURSIVE {_COLOURS},
wd AS (SELECT image_id, x, y FROM co WHERE {_WEED_CHOSEN} UNION SELECT * FROM mk),
w1 AS ({_grown("wd", R.disc(WEED_CLOSE))}), w2 AS ({_shrunk("w1", R.disc(WEED_CLOSE))})
SELECT image_id, 'weed' AS layer, {_SUMS} FROM w2 GROUP BY image_id""",
    ),
    "img6": (
        _of("photo_pixels")(lambda p: photos.islands(_masks(p))),
        f"WITH RECURSIVE {_COLOURS}, {_labelled('mk')} SELECT * FROM il",
    ),
    "img8": (
        _of("photo_pixels")(_valid),
        f"WITH RECURSIVE {_COLOURS}, {_labelled('mk')} SELECT * FROM il WHERE area BETWEEN {_LIMITS[0]} AND {_LIMITS[1]} AND NOT ({_LINE} AND area > {_LIMITS[2]})",
    ),
    "img7": (
        _of("photo_pixels")(_groups),
        f"""
WITH RECURSIVE {_COLOURS}, {_labelled('mk')},
pr AS (
    SELECT image_id, a, b, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY gap2, a, b) AS k
    FROM (SELECT p.image_id, p.label AS a, q.label AS b, power(greatest(0, greatest(p.x0, q.x0) - least(p.x1, q.x1)), 2) + power(greatest(0, greatest(p.y0, q.y0) - least(p.y1, q.y1)), 2) AS gap2
          FROM il p JOIN il q ON p.image_id = q.image_id AND p.label < q.label) WHERE gap2 <= {GAP * GAP}),
fo(image_id, k, heads, x0s, y0s, x1s, y1s) AS (
    SELECT image_id, 0::BIGINT, list(label ORDER BY label), list(x0 ORDER BY label), list(y0 ORDER BY label), list(x1 ORDER BY label), list(y1 ORDER BY label) FROM il GROUP BY image_id
    UNION ALL
    SELECT image_id, k, CASE WHEN fits THEN list_transform(heads, lambda h: CASE WHEN h = hb THEN ha ELSE h END) ELSE heads END,
           CASE WHEN fits THEN list_transform(x0s, lambda v, i: CASE WHEN i = ha THEN least(x0s[ha], x0s[hb]) ELSE v END) ELSE x0s END,
           CASE WHEN fits THEN list_transform(y0s, lambda v, i: CASE WHEN i = ha THEN least(y0s[ha], y0s[hb]) ELSE v END) ELSE y0s END,
           CASE WHEN fits THEN list_transform(x1s, lambda v, i: CASE WHEN i = ha THEN greatest(x1s[ha], x1s[hb]) ELSE v END) ELSE x1s END,
           CASE WHEN fits THEN list_transform(y1s, lambda v, i: CASE WHEN i = ha THEN greatest(y1s[ha], y1s[hb]) ELSE v END) ELSE y1s END
    FROM (SELECT *, ha <> hb AND greatest(greatest(x1s[ha], x1s[hb]) - least(x0s[ha], x0s[hb]), greatest(y1s[ha], y1s[hb]) - least(y0s[ha], y0s[hb])) <= {SPAN} AS fits
          FROM (SELECT fo.* REPLACE (pr.k AS k), heads[a] AS ha, heads[b] AS hb FROM fo JOIN pr ON pr.image_id = fo.image_id AND pr.k = fo.k + 1))),
hd AS (SELECT image_id, unnest(heads) AS head, generate_subscripts(heads, 1) AS label FROM fo WHERE (image_id, k) IN (SELECT image_id, max(k) FROM fo GROUP BY image_id)),
nu AS (SELECT image_id, head, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY min(label)) AS g FROM hd GROUP BY image_id, head)
SELECT il.image_id, CAST(g AS INT) AS "group", min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(sum(area) AS BIGINT) AS area, count(*) AS islands
FROM il JOIN hd USING (image_id, label) JOIN nu USING (image_id, head) GROUP BY il.image_id, g""",
    ),
    "img18": (
        _of("photo_pixels")(_inspected),
        f"""
WITH RECURSIVE {_COLOURS},
li AS (SELECT *, CAST(floor((1868 * b + 9617 * g + 4899 * r + 8192) / 16384.0) AS BIGINT) AS l FROM co),
nb AS (
    SELECT a.image_id, a.x, a.y, any_value(a.l) AS l, sum(b.l * w.lap) AS bend, sum(b.l * w.sx) AS gx, sum(b.l * w.sy) AS gy
    FROM li a CROSS JOIN (VALUES (-1,-1,0,-1,-1),(0,-1,1,0,-2),(1,-1,0,1,-1),(-1,0,1,-2,0),(0,0,-4,0,0),(1,0,1,2,0),(-1,1,0,-1,1),(0,1,1,0,2),(1,1,0,1,1)) w(i, j, lap, sx, sy)
    JOIN li b ON b.image_id = a.image_id AND b.x = CASE WHEN a.x + i < 0 THEN 1 WHEN a.x + i >= {WIDTH} THEN {WIDTH - 2} ELSE a.x + i END AND b.y = CASE WHEN a.y + j < 0 THEN 1 WHEN a.y + j >= {HEIGHT} THEN {HEIGHT - 2} ELSE a.y + j END
    GROUP BY a.image_id, a.x, a.y),
fg AS (SELECT image_id, var_pop(bend) AS laplacian, avg(CASE WHEN gx * gx + gy * gy >= 10000 THEN 1.0 ELSE 0 END) AS edges, stddev_pop(l) / 255 AS contrast, avg(CASE WHEN l <= 5 OR l >= 250 THEN 1.0 ELSE 0 END) AS clipped FROM nb GROUP BY image_id),
vf AS (SELECT image_id, avg(CASE WHEN v >= 205 AND s <= 85 THEN 1.0 ELSE 0 END) AS bright, avg(CASE WHEN v >= 235 AND s <= 85 THEN 1.0 ELSE 0 END) AS highlight, quantile_cont(v, 0.5) / 255 AS med, quantile_cont(v, 0.1) / 255 AS low FROM co GROUP BY image_id),
g0 AS (SELECT image_id, x, y FROM co WHERE h BETWEEN 25 AND 105 AND s >= 32 AND v >= 25 AND e >= 9),
g1 AS ({_shrunk("g0", R.square(5))}), g2 AS ({_grown("g1", R.square(5))}), g3 AS ({_grown("g2", R.square(5))}), gn AS ({_shrunk("g3", R.square(5))}), {_labelled("gn")},
th2 AS (SELECT DISTINCT lb.image_id, lb.label FROM lb WHERE NOT EXISTS (SELECT 1 FROM cv o WHERE o.image_id = lb.image_id AND power(o.x - lb.x, 2) + power(o.y - lb.y, 2) < {(HEIGHT * 0.075) ** 2} AND NOT EXISTS (SELECT 1 FROM gn WHERE gn.image_id = o.image_id AND gn.x = o.x AND gn.y = o.y))),
ce AS (SELECT lb.image_id, lb.label, avg(lb.x) / {WIDTH} AS u FROM lb GROUP BY ALL),
ia AS (
    SELECT il.*, u, area / {WIDTH * HEIGHT}.0 AS f, (x0 = 0)::INT + (y0 = 0)::INT + (x1 >= {WIDTH})::INT + (y1 >= {HEIGHT})::INT >= 2 AND th2.label IS NOT NULL AS leaf
    FROM il JOIN ce USING (image_id, label) LEFT JOIN th2 ON th2.image_id = il.image_id AND th2.label = il.label),
su AS (SELECT image_id, sum(f) AS veg, coalesce(max(f) FILTER (leaf), 0) AS leaf, coalesce(sum(f) FILTER (NOT leaf), 0) AS clear, count(*) FILTER (f >= 0.0015) AS blobs, coalesce(sum(u * f) FILTER (f >= 0.0015), 0) AS weight_u FROM ia GROUP BY image_id),
al AS (SELECT fg.*, vf.* EXCLUDE (image_id), coalesce(veg, 0) AS veg, coalesce(leaf, 0) AS leaf, coalesce(clear, 0) AS clear, coalesce(blobs, 0) AS blobs, coalesce(weight_u, 0) AS weight_u FROM fg JOIN vf USING (image_id) LEFT JOIN su USING (image_id))
SELECT image_id, CASE WHEN highlight >= 0.3 AND med >= 0.84 AND low >= 0.58 AND veg < 0.12 THEN 'washed_out' WHEN leaf >= 0.3 AND veg >= 0.3 AND leaf / greatest(0.01, veg) >= 0.88 AND clear <= 0.05 THEN 'leaf_obstruction'
            WHEN laplacian <= 5 AND edges <= 0.025 AND contrast >= 0.025 THEN 'blurry' ELSE 'usable' END AS issue,
       round(least(1, 0.35 * bright + 0.35 * highlight + 0.2 * med + 0.1 * low), 6) AS washed_out, round(least(1, 0.65 * leaf / 0.4 + 0.35 * leaf / greatest(0.01, veg)), 6) AS obstruction,
       round(least(1, greatest(0, (0.6 * (1 - least(1, laplacian / 20)) + 0.4 * (1 - least(1, edges / 0.06))) * least(1, contrast / 0.04))), 6) AS blur, round(veg, 6) AS vegetation, round(clear, 6) AS clear,
       round(least(1, ln(1 + laplacian) / ln(101)), 6) AS sharpness, round(laplacian, 6) AS laplacian, round(edges, 6) AS edges, round(contrast, 6) AS contrast,
       round(least(1, greatest(0.05, 0.6 * least(1, ln(1 + laplacian) / ln(101)) + 0.4 * greatest(0, 1 - clipped * 2.5))), 6) AS image_quality, CAST(blobs AS INT) AS blobs, round(weight_u, 6) AS weight_u FROM al""",
    ),
    "can3": (
        _of("photo_pixels")(_fused_cells),
        f"""
WITH RECURSIVE {_COLOURS},
vw AS (SELECT DISTINCT image_id, image_id // 3 AS plant_id, image_id % 3 * {STEP_X} - 80 AS c, image_id % 3 * {STEP_Y} - 60 AS f, 0.5 + image_id % 3 * 0.15 AS sure FROM mk),
cn AS (
    SELECT plant_id, min(c) AS min_x, max(c) + {WIDTH / PPM} + {TURN * HEIGHT} AS max_x, min(f) - {TURN * WIDTH} AS min_y, max(f) + {HEIGHT / PPM} AS max_y, count(*) AS views FROM vw GROUP BY plant_id),
ca AS (SELECT *, CAST(round_even((max_x - min_x) * {PPM}, 0) AS BIGINT) AS cols, CAST(round_even((max_y - min_y) * {PPM}, 0) AS BIGINT) AS nrows FROM cn),
gx AS (SELECT *, unnest(range(cols)) AS cx FROM ca), gr AS (SELECT *, unnest(range(nrows)) AS cy FROM gx),
so AS (
    SELECT g.plant_id, image_id, cx, cy, views, sure, (ax * 1 - ay * {TURN * PPM}) / {1 + (TURN * PPM) ** 2} AS sx, (ax * {TURN * PPM} + ay) / {1 + (TURN * PPM) ** 2} AS sy
    FROM (SELECT gr.*, image_id, sure, cx - (c - min_x) * {PPM} AS ax, cy - (f - min_y) * {PPM} AS ay FROM gr JOIN vw USING (plant_id)) g),
su AS (SELECT so.plant_id, so.image_id, cx, cy FROM so JOIN mk ON mk.image_id = so.image_id AND mk.x = round_even(sx, 0) AND mk.y = round_even(sy, 0)),
ev AS (
    SELECT so.plant_id, so.image_id, cx, cy, sum((1 - abs(sx - mk.x)) * (1 - abs(sy - mk.y)) * sure * least(1, greatest(0.2, least(mk.x, mk.y, {WIDTH - 1} - mk.x, {HEIGHT - 1} - mk.y) / {20 * PPM}))) AS found
    FROM so JOIN mk ON mk.image_id = so.image_id AND mk.x BETWEEN floor(sx) AND floor(sx) + 1 AND mk.y BETWEEN floor(sy) AND floor(sy) + 1 GROUP BY ALL),
vo AS (
    SELECT so.plant_id, so.cx, so.cy, any_value(views) AS views, count(su.cx) AS support, max(coalesce(found, 0)) AS strongest
    FROM so LEFT JOIN su ON su.image_id = so.image_id AND su.cx = so.cx AND su.cy = so.cy LEFT JOIN ev ON ev.image_id = so.image_id AND ev.cx = so.cx AND ev.cy = so.cy GROUP BY so.plant_id, so.cx, so.cy)
SELECT plant_id, count(*) AS cells, CAST(sum(support) AS BIGINT) AS support, CAST(sum(cx) AS BIGINT) AS sum_x, CAST(sum(cy) AS BIGINT) AS sum_y, round(sum(strongest), 4) AS strongest
FROM vo WHERE support >= 2 OR (support >= 1 AND strongest >= CASE WHEN views = 1 THEN 0.35 ELSE {SINGLE} END) GROUP BY plant_id""",
    ),
    "can3_fused": (_of("photo_pixels")(_fused), None),
    "img9": (_of("photo_pixels")(_shifts), None),
    "soi5": (_of("photo_pixels")(_heights), None),
    "img10": (
        _of("photo_pixels", "photo_plants")(_owned),
        f"""
WITH RECURSIVE {_COLOURS}, w1 AS ({_shrunk("mk", R.disc(1))}), w2 AS ({_grown("w1", R.disc(1))}), {_labelled('w2')},
pl AS (
    SELECT *, greatest(6, least(35, greatest(12, radius_mm * 0.28)) * {PPM}) AS core FROM photo_plants
    WHERE power(greatest(0, -cx, cx - {WIDTH - 1}) / {PPM}, 2) + power(greatest(0, -cy, cy - {HEIGHT - 1}) / {PPM}, 2) < power(greatest(30, radius_mm + {MARGIN}), 2)),
ds AS (SELECT lb.*, plant_id, cx, cy, radius_mm, core, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS f2, plant_id % 2 = 0 AND EXISTS (SELECT 1 FROM st WHERE st.image_id = lb.image_id AND st.x = lb.x AND st.y = lb.y) AS before FROM lb JOIN pl USING (image_id)),
nr AS (SELECT *, ROW_NUMBER() OVER w AS k, lead(f2) OVER w AS second FROM ds WINDOW w AS (PARTITION BY image_id, x, y ORDER BY f2, plant_id)),
fa AS (
    SELECT image_id, label, plant_id, any_value(cx) AS cx, any_value(cy) AS cy, any_value(radius_mm) AS r, bool_or(f2 <= core * core) AS in_core, bool_or(before) AS prior,
           sqrt(min(f2)) AS near_px, sqrt(max(f2) FILTER (k = 1)) AS far_px, sqrt(min(f2) FILTER (k = 1)) / {PPM} AS near_mm, count(*) FILTER (k = 1) AS mine
    FROM nr GROUP BY image_id, label, plant_id),
ok AS (SELECT il.* FROM il WHERE area BETWEEN {_LIMITS[0]} AND {_LIMITS[1]} AND (NOT ({_LINE} AND area > {_LIMITS[2]}) OR EXISTS (SELECT 1 FROM fa WHERE fa.image_id = il.image_id AND fa.label = il.label AND in_core))),
ve AS (
    SELECT fa.*, in_core OR (prior AND far_px <= greatest(r * 1.5, r + 30) * {PPM}) OR (NOT (cx >= 0 AND cx < {WIDTH} AND cy >= 0 AND cy < {HEIGHT}) AND near_mm <= greatest(30, r * 1.25, r + {MARGIN})) AS owned,
           (near_px < greatest(r * 1.35, r + 60) * {PPM} AND area / {_AREA} >= 600) OR prior AS doubtful
    FROM fa JOIN ok USING (image_id, label) WHERE mine > 0)
SELECT image_id, CASE WHEN owned THEN plant_id ELSE -1 END AS plant_id, count(*) AS pixels, count(*) FILTER (NOT owned OR sqrt(second) - sqrt(f2) < {max(5.0, 5 * PPM)}) AS ambiguous, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y
FROM nr JOIN ve USING (image_id, label, plant_id) WHERE k = 1 AND (owned OR doubtful) GROUP BY 1, 2""",
    ),
}
