"""Bursts and hand-offs of the events as a stream, each with the same question in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from canopia.sources import shared
from canopia.sources.tables import view
from canopia.streaming import bursts
from canopia.streaming.events import drained, event_stream

HOURS = 6


def _events(spark, sf_dir):
    """Events as requests: one in nine without an image, one in five for all plants."""
    image = F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 97)
    plants = F.when(F.col("event_id") % 5 != 0, F.array(F.col("user_id") % 7)).otherwise(F.array().cast("array<bigint>"))
    return event_stream(spark, sf_dir).select((F.col("user_id") % 25).alias("entry_id"), F.col("event_type").alias("mode"), "ts", image.alias("image_id"), plants.alias("plant_ids"))


def _bursts(spark, sf_dir):
    found = drained(spark, bursts.bursts(_events(spark, sf_dir), HOURS * 3600, by_event_time=True))
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda v: v.cast("string")), ",")
    return found.select("entry_id", "mode", F.unix_millis("anchor").alias("anchor"), "events", "full", listed("images").alias("images"), "everyone", listed("plants").alias("plants"))


def _handed(spark, sf_dir):
    """Frames are events; those with an error or a rejecting decision are excluded."""
    folder = f"{shared.folder(spark)}/handed-{uuid.uuid4().hex}"
    frames = event_stream(spark, sf_dir).where("event_type <> 'error'").select((F.col("user_id") % 25).alias("entry_id"), (F.col("event_id") % 211).alias("image_id"), "ts")
    excluded = view(spark, sf_dir, "unlinked").select(F.coalesce("entry", F.lit(3)).alias("entry_id"), "image_id")
    bursts.hand_off(frames, excluded, f"{folder}/rows", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = bursts.written(spark, f"{folder}/rows")
    if found is None:  # a stream over nothing has no batch
        return excluded.limit(0)
    return found.select("entry_id", "image_id")


PLANS = {
    "str1": (
        _bursts,
        f"""
WITH RECURSIVE e AS (
    SELECT user_id % 25 AS entry_id, event_type AS mode, CAST(floor(epoch_us(CAST(ts AS TIMESTAMP)) / 1000.0) AS BIGINT) AS t, CASE WHEN event_id % 9 <> 0 THEN event_id % 97 END AS image_id,
           CASE WHEN event_id % 5 <> 0 THEN user_id % 7 END AS plant FROM events),
c(entry_id, mode, anchor) AS (
    SELECT entry_id, mode, min(t) FROM e GROUP BY ALL
    UNION ALL
    SELECT * FROM (SELECT c.entry_id, c.mode, (SELECT min(t) FROM e WHERE e.entry_id = c.entry_id AND e.mode = c.mode AND e.t >= c.anchor + {HOURS * 3600000}) AS anchor FROM c) WHERE anchor IS NOT NULL),
b AS (
    SELECT c.entry_id, c.mode, anchor, count(*) AS events, bool_or(image_id IS NULL) AS "full", list_sort(list(DISTINCT image_id) FILTER (image_id IS NOT NULL)) AS im, bool_or(plant IS NULL) AS everyone, list_sort(list(DISTINCT plant) FILTER (plant IS NOT NULL)) AS pl
    FROM c JOIN e ON e.entry_id = c.entry_id AND e.mode = c.mode AND t >= anchor AND t < anchor + {HOURS * 3600000} GROUP BY ALL)
SELECT entry_id, mode, anchor, events, "full", CASE WHEN "full" THEN '' ELSE array_to_string(im, ',') END AS images, everyone, CASE WHEN everyone THEN '' ELSE array_to_string(pl, ',') END AS plants
FROM b WHERE EXISTS (SELECT 1 FROM e WHERE (e.entry_id, e.mode) = (b.entry_id, b.mode) AND e.t >= anchor + {HOURS * 3600000}) OR anchor + {HOURS * 3600000} < (SELECT max(t) FROM e)""",
    ),
    "str10": (
        _handed,
        """
SELECT DISTINCT user_id % 25 AS entry_id, event_id % 211 AS image_id FROM events e
WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM unlinked u WHERE coalesce(u.entry, 3) = e.user_id % 25 AND u.image_id = e.event_id % 211)""",
    ),
}
