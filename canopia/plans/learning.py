"""The verifier and the streams, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.operators import verifier
from canopia.plans.garden import _of
from canopia.streaming import events

FEATURES = ["f1", "f2", "f3"]


def _scored(detections, labelled):
    return detections.join(labelled, "detection_id").select("score", (F.col("label") == "weed").alias("actual"))


_CURVE = """s AS (SELECT score, label = 'weed' AS actual FROM detections JOIN labelled USING (detection_id)), t AS (SELECT DISTINCT round(score * 1000) / 1000 AS threshold FROM s UNION SELECT 0.5),
n AS (SELECT threshold, count(*) FILTER (score >= threshold AND actual) AS tp, count(*) FILTER (score >= threshold AND NOT actual) AS fp, count(*) FILTER (score < threshold AND actual) AS fn, count(*) FILTER (score < threshold AND NOT actual) AS tn FROM t, s GROUP BY threshold),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS re, CAST(tp + fp AS DOUBLE) AS m FROM n),
cv AS (SELECT threshold, tp, fp, fn, tn, round(pr, 4) AS "precision", round(re, 4) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 4) AS f1, round(CASE WHEN m = 0 THEN 0 ELSE greatest(0, (pr + 1.2816 * 1.2816 / (2 * m) - 1.2816 * sqrt(pr * (1 - pr) / m + 1.2816 * 1.2816 / (4 * m * m))) / (1 + 1.2816 * 1.2816 / m)) END, 4) AS bound FROM r)"""

PLANS = {
    "ml3": (_of("traits")(lambda t: verifier.grouped_split(t, "image_id").select("doc_id", "held_out")),
            "SELECT doc_id, (DENSE_RANK() OVER (ORDER BY CAST(image_id AS VARCHAR)) - 1) % 4 = 0 AS held_out FROM (SELECT l.doc_id, d.doc_id % 97 AS image_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"),
    "ml4": (_of("detections", "labelled")(lambda d, s: verifier.operating_point(verifier.threshold_curve(_scored(d, s)), 0.3)),
            f"WITH {_CURVE}, v AS (SELECT threshold, CASE WHEN bool_or(bound >= 0.3 AND tp > 0) OVER () THEN CASE WHEN bound >= 0.3 AND tp > 0 THEN recall END ELSE f1 END AS v FROM cv), b AS (SELECT threshold, ROW_NUMBER() OVER (ORDER BY threshold) - 1 AS i, count(*) OVER () AS n FROM v WHERE v = (SELECT max(v) FROM v)) SELECT threshold FROM b WHERE i = n // 2"),
    "agg15": (_of("detections", "labelled")(lambda d, s: verifier.threshold_curve(_scored(d, s), None).select("threshold", "tp", "fp", "fn", "tn", *[F.round(n, 9).alias(n) for n in ("precision", "recall", "f1", "bound")])),
              f"WITH {_CURVE.replace(', 4)', ', 9)')} SELECT * FROM cv"),
    "ml5": (_of("traits")(lambda t: verifier.held_out_scores(t, "quality", "image_id", FEATURES).select("doc_id", "held_out", F.round("score", 6).alias("score"))), None),
    "str3": (lambda spark, sf_dir: events.drained(spark, events.once(events.event_stream(spark, sf_dir).select("event_id", "user_id", "ts"), ["event_id"], "1 day")).select("event_id", "user_id"),
             "SELECT DISTINCT event_id, user_id FROM events"),
    "str4": (lambda spark, sf_dir: events.drained(spark, events.streaks(events.event_stream(spark, sf_dir))),
             "WITH a AS (SELECT event_id, user_id, ts, event_type = 'error' AS absent FROM events), c AS (SELECT *, CASE WHEN absent IS DISTINCT FROM lag(absent) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS turn FROM a), g AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM c) SELECT event_id, user_id, absent, ROW_NUMBER() OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS streak FROM g"),
    "agg12": (_of("sightings")(lambda s: events.bursts(s.selectExpr("plant_id AS entry_id", "first_sector % 3 AS mode", "CASE WHEN measurement_id % 40 = 0 THEN NULL ELSE measurement_id % 17 END AS image_id")).select("entry_id", "mode", "full", F.array_join(F.transform("images", lambda v: v.cast("string")), ",").alias("images"))),
              "SELECT plant_id AS entry_id, first_sector % 3 AS mode, bool_or(measurement_id % 40 = 0) AS \"full\", CASE WHEN bool_or(measurement_id % 40 = 0) THEN '' ELSE array_to_string(list_sort(list(DISTINCT measurement_id % 17)), ',') END AS images FROM sightings GROUP BY ALL"),
}
