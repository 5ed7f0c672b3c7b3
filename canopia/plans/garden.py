"""Garden queries over the views, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.operators import geometry, store
from canopia.sources.tables import view

LABELS = ("weed", "crop", "soil", "debris")
SINCE = "1998-01-01"
RETRY = "1998-06-01"
_NEWEST = "ROW_NUMBER() OVER (PARTITION BY plant_id, image_id ORDER BY image_timestamp DESC, measurement_id DESC) = 1"
_TERMINAL = ", ".join(f"'{x}'" for x in store.TERMINAL)
_PENDING = f"p AS (SELECT * FROM measurements m WHERE NOT EXISTS (SELECT 1 FROM decisions d WHERE d.measurement_id = m.measurement_id AND d.action IN ({_TERMINAL})))"
_CELL_X, _CELL_Y = "CAST(floor(x / 373 + 0.5) AS BIGINT)", "CAST(floor(y / 294 + 0.5) AS BIGINT)"


def _of(*names):
    return lambda f: lambda spark, sf_dir: f(*(view(spark, sf_dir, n) for n in names))


def _far_clearance(weeds, plants):
    """Obstacles on another bed, some of them wide."""
    radius = F.col("radius") + 400.0 * (F.col("id") % 97 == 0).cast("int")
    far = plants.where("id % 5 = 0").select((F.col("x") + 6000).alias("x"), "y", radius.alias("radius"))
    return geometry.clearance(weeds, far, 12.0).select("id", F.round("margin_mm", 6).alias("margin_mm"))


PLANS = {
    "q7": (_of("measurements")(lambda m: store.recent(m, "image_timestamp", "measurement_id", 20).select("measurement_id", "plant_id", "recommended_mm")),
           "SELECT measurement_id, plant_id, recommended_mm FROM measurements ORDER BY image_timestamp DESC, measurement_id DESC LIMIT 20"),
    "q16": (_of("change_log")(lambda c: store.recent(c, "created_at", "id", 50).select("id", "entity_id", "change_type")),
            "SELECT id, entity_id, change_type FROM change_log ORDER BY created_at DESC, id DESC LIMIT 50"),
    "q18": (_of("soil_measurements")(lambda s: store.latest(s, "point_id", "created_at", "measurement_id").select("point_id", "measurement_id", "status")),
            "SELECT point_id, measurement_id, status FROM soil_measurements QUALIFY ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY created_at DESC, measurement_id DESC) = 1"),
    "q25": (_of("plants")(lambda p: p.where("height_mm IS NULL OR height_mm > 250").select("id", "height_mm")),
            "SELECT id, height_mm FROM plants WHERE height_mm IS NULL OR height_mm > 250"),
    "q30": (_of("measurements", "decisions")(lambda m, d: store.pending(m, d).select("measurement_id", "plant_id")),
            f"WITH {_PENDING} SELECT measurement_id, plant_id FROM p"),
    "q33": (_of("soil_measurements", "soil_decisions")(lambda s, d: store.outstanding_failures(s, d, RETRY).select("measurement_id", "point_id")),
            f"""SELECT measurement_id, point_id FROM soil_measurements m WHERE status = 'failed' AND created_at <= TIMESTAMP '{RETRY}'
AND NOT EXISTS (SELECT 1 FROM soil_measurements n WHERE m.point_id > 0 AND n.point_id = m.point_id AND (n.created_at > m.created_at OR (n.created_at = m.created_at AND n.measurement_id > m.measurement_id)))
AND NOT EXISTS (SELECT 1 FROM soil_measurements n WHERE m.point_id = 0 AND abs(n.capture_x - m.capture_x) <= 0.001 AND abs(n.capture_y - m.capture_y) <= 0.001 AND (n.created_at > m.created_at OR (n.created_at = m.created_at AND n.measurement_id > m.measurement_id)))
AND NOT EXISTS (SELECT 1 FROM soil_decisions d WHERE d.measurement_id = m.measurement_id AND d.action = 'automatic_retry_started' AND d.created_at > TIMESTAMP '{RETRY}')"""),
    "q41": (_of("plants", "weeds")(lambda p, w: geometry.linked(w, p, 200.0)),
            "SELECT w.id, p.id AS o_id FROM weeds w JOIN plants p ON sqrt((w.x - p.x) * (w.x - p.x) + (w.y - p.y) * (w.y - p.y)) <= 200"),
    "agg2": (_of("measurements")(lambda m: store.weighted_median(m, "plant_id", "recommended_mm", "visible_fraction", "median_mm")),
             "WITH s AS (SELECT plant_id, recommended_mm, sum(CAST(visible_fraction AS DECIMAL(20,12))) OVER (PARTITION BY plant_id ORDER BY recommended_mm) AS run, sum(CAST(visible_fraction AS DECIMAL(20,12))) OVER (PARTITION BY plant_id) AS total FROM measurements) SELECT plant_id, CASE WHEN max(total) <= 0 THEN max(recommended_mm) ELSE min(CASE WHEN 2 * run >= total THEN recommended_mm END) END AS median_mm FROM s GROUP BY plant_id"),
    "agg3": (_of("training")(lambda t: store.label_counts(t, LABELS)),
             "SELECT l.label, count(t.doc_id) AS samples FROM (VALUES ('weed'), ('crop'), ('soil'), ('debris')) AS l(label) LEFT JOIN training t ON t.label = l.label GROUP BY l.label"),
    "agg8": (_of("decisions")(lambda d: d.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("applied", "reject", "keep")])),
             "SELECT count(*) FILTER (action = 'applied') AS applied, count(*) FILTER (action = 'reject') AS reject, count(*) FILTER (action = 'keep') AS keep FROM decisions"),
    "win1": (_of("measurements")(store.absent_streak),
             f"WITH n AS (SELECT * FROM measurements QUALIFY {_NEWEST}), s AS (SELECT plant_id, sum(CASE WHEN vegetation_absent THEN 0 ELSE 1 END) OVER (PARTITION BY plant_id ORDER BY image_timestamp DESC, measurement_id DESC ROWS UNBOUNDED PRECEDING) AS present FROM n) SELECT plant_id, CAST(count(*) FILTER (present = 0) AS BIGINT) AS streak FROM s GROUP BY plant_id"),
    "win2": (_of("change_log", "plants")(lambda c, p: store.growth_baseline(c, p.select((F.col("id") - 1).alias("entity_id"), F.col("radius").alias("current_mm")), SINCE)),
             f"""
WITH f AS (
    SELECT entity_id, original_radius_mm FROM change_log
    WHERE change_type = 'radius increased' AND date_trunc('second', created_at) >= TIMESTAMP '{SINCE}'
    QUALIFY ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY date_trunc('second', created_at), id) = 1)
SELECT id - 1 AS entity_id, coalesce(original_radius_mm, radius) AS baseline_mm
FROM plants LEFT JOIN f ON f.entity_id = id - 1"""),
    "win4": (_of("measurements")(lambda m: store.newest_per_image(m).select("measurement_id", "plant_id", "image_id")),
             f"SELECT measurement_id, plant_id, image_id FROM measurements QUALIFY {_NEWEST}"),
    "pln10": (_of("weeds", "plants")(lambda w, p: geometry.clearance(w, p, 12.0).select("id", F.round("margin_mm", 6).alias("margin_mm"))),
              """
WITH k AS (SELECT w.id, min(sqrt((w.x - p.x) * (w.x - p.x) + (w.y - p.y) * (w.y - p.y)) - p.radius) - 24 AS edge FROM weeds w LEFT JOIN plants p ON true GROUP BY w.id)
SELECT id, CASE WHEN edge < 0 THEN -1 ELSE round(coalesce(edge, 10000), 6) END AS margin_mm FROM k"""),
    "pln10_far": (_of("weeds", "plants")(_far_clearance),
                  """
WITH o AS (SELECT x + 6000 AS x, y, radius + 400 * CAST(id % 97 = 0 AS INT) AS radius FROM plants WHERE id % 5 = 0),
k AS (SELECT w.id, min(sqrt((w.x - o.x) * (w.x - o.x) + (w.y - o.y) * (w.y - o.y)) - o.radius) - 24 AS edge FROM weeds w LEFT JOIN o ON true GROUP BY w.id)
SELECT id, CASE WHEN edge < 0 THEN -1 ELSE round(coalesce(edge, 10000), 6) END AS margin_mm FROM k"""),
    "set3": (_of("plants", "weeds")(geometry.obstacles),
             "SELECT 'plant' AS kind, id, x, y, radius FROM plants WHERE radius >= 15 AND (age_days IS NULL OR age_days >= 10) UNION ALL SELECT 'weed', id, x, y, radius FROM weeds"),
    "set5": (_of("weeds")(lambda w: geometry.missing_cells(geometry.grid_cells(w.selectExpr("x", "y", "true AS processed", "id AS created_at")).select("cell_x", "cell_y"))),
             f"WITH c AS (SELECT DISTINCT {_CELL_X} AS cell_x, {_CELL_Y} AS cell_y FROM weeds) SELECT * FROM (SELECT DISTINCT cell_x FROM c), (SELECT DISTINCT cell_y FROM c) EXCEPT SELECT * FROM c"),
    "q45": (_of("images")(lambda i: geometry.neighbour_cells(geometry.grid_cells(i).select("cell_x", "cell_y"))),
            f"WITH c AS (SELECT DISTINCT {_CELL_X} AS cell_x, {_CELL_Y} AS cell_y FROM images WHERE processed) SELECT a.cell_x, a.cell_y, b.cell_x AS o_cell_x, b.cell_y AS o_cell_y FROM c a JOIN c b ON abs(a.cell_x - b.cell_x) + abs(a.cell_y - b.cell_y) = 1"),
    "fn17": (_of("training")(lambda t: t.groupBy("image_id").agg(F.count_if(F.col("label") == "crop").alias("s"), F.count("*").alias("n")).select("image_id", F.round(geometry.wilson_lower(F.col("s"), F.col("n")), 6).alias("bound"))),
             "SELECT image_id, round(greatest(0, (s / n + 1.2816 * 1.2816 / (2 * n) - 1.2816 * sqrt(s / n * (1 - s / n) / n + 1.2816 * 1.2816 / (4.0 * n * n))) / (1 + 1.2816 * 1.2816 / n)), 6) AS bound FROM (SELECT image_id, CAST(count(*) FILTER (label = 'crop') AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM training GROUP BY image_id)"),
}
