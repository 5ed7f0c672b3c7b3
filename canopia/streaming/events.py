"""Streams of observations: once-only events, streaks in processing order, bursts."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from canopia.sources import shared


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src6: the events table as a stream, with an event time that takes a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def once(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """str3: the first event of each key within the delay; state is dropped behind the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def _streak(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, run = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    out = []
    for event_id, absent in zip(rows.event_id, rows.absent, strict=True):
        run = run + 1 if last == bool(absent) else 1
        last = bool(absent)
        out.append((int(event_id), int(key[0]), last, run))
    state.update((last, run))
    yield pd.DataFrame(out, columns=["event_id", "user_id", "absent", "streak"])


def streaks(stream: DataFrame) -> DataFrame:
    """str4: how often in a row an entity was seen absent, or present, at each event; the opposite starts anew.

    Events of one micro-batch are taken in the order of time and id, batches in
    the order of arrival. The state is two values an entity.
    """
    rows = stream.select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("absent"))
    return rows.groupBy("user_id").applyInPandasWithState(_streak, "event_id long, user_id long, absent boolean, streak long", "absent boolean, run long", "append", GroupStateTimeout.NoTimeout)


TRACK = "track long, x double, y double, observations long, seen double, image long, confidence double"
SEEN = "entry_id long, detection_id long, track long, observations long, x double, y double, confidence double"


def candidate_tracks(stream: DataFrame, distance_mm: float, gap_hours: int) -> DataFrame:
    """str5, dec13: the track of each detection (entry_id, detection_id, image_id, ts, x, y, confidence) and its running means.

    A detection joins the nearest track of its entry within the distance and
    the gap, ties to the older one, or opens one named after itself; a second
    detection of a track's last image changes nothing. Detections of a
    micro-batch are taken in the order of time and id. Tracks unseen for twice
    the gap leave the state, so it grows with what is active, not with time.
    """
    gap = gap_hours * 3600.0

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks = [list(t) for t in zip(*state.get, strict=True)] if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "detection_id"], kind="stable")
        out, latest = [], 0.0
        for d in rows.itertuples(index=False):
            at = d.ts.timestamp()
            latest = max(latest, at)
            near = [(math.hypot(t[1] - d.x, t[2] - d.y), k) for k, t in enumerate(tracks) if t[4] >= at - gap]
            found = min((n for n in near if n[0] <= distance_mm), default=None)
            if found is None:
                tracks.append([int(d.detection_id), d.x, d.y, 1, at, int(d.image_id), d.confidence])
            elif (t := tracks[found[1]])[5] != d.image_id:
                n = t[3] + 1
                t[1:] = [(t[1] * t[3] + d.x) / n, (t[2] * t[3] + d.y) / n, n, at, int(d.image_id), (t[6] * t[3] + d.confidence) / n]
            t = tracks[-1] if found is None else tracks[found[1]]
            out.append((int(key[0]), int(d.detection_id), t[0], t[3], t[1], t[2], t[6]))
        tracks = [t for t in tracks if t[4] >= latest - 2 * gap]
        state.update(tuple(list(c) for c in zip(*tracks, strict=True)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SEEN.split(", ")])

    kept = ", ".join(f"{name} array<{kind}>" for name, kind in (c.split() for c in TRACK.split(", ")))
    rows = stream.select("entry_id", "detection_id", "image_id", "ts", "x", "y", "confidence")
    return rows.groupBy("entry_id").applyInPandasWithState(follow, SEEN, kept, "append", GroupStateTimeout.NoTimeout)


def bursts(batch: DataFrame) -> DataFrame:
    """agg12: one request an entry and mode of a micro-batch: any event without an image asks for all of them."""
    return batch.groupBy("entry_id", "mode").agg(F.bool_or(F.col("image_id").isNull()).alias("full"), F.array_sort(F.collect_set("image_id")).alias("images")).select("entry_id", "mode", "full", F.when(F.col("full"), F.array().cast("array<bigint>")).otherwise(F.col("images")).alias("images"))


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is there, through a Parquet sink in the shared folder, and returns its rows."""
    folder = f"{shared.folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows")  # what a stream over nothing leaves
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
