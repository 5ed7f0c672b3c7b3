"""str1, str10: bursts of events anchored at their first one, and a sink that hands every key on once, restarts included."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: how long a burst collects from its first event on, in seconds.
WINDOW_S = 0.75

REQUEST = "entry_id long, mode string, anchor timestamp, events long, full boolean, images array<long>, everyone boolean, plants array<long>"
_STATE = "anchor long, events long, full boolean, images array<long>, everyone boolean, plants array<long>"


class Burst:
    """One burst of a key; `anchor` is in milliseconds."""

    def __init__(self, anchor: int, events: int = 0, full: bool = False, images=(), everyone: bool = False, plants=()):
        self.anchor, self.events, self.full, self.everyone = int(anchor), int(events), bool(full), bool(everyone)
        self.images, self.plants = dict.fromkeys(map(int, images)), dict.fromkeys(map(int, plants))

    def add(self, image, plants) -> None:
        """An event without image asks for all images, one without plants for all plants."""
        self.events += 1
        if image is None or image != image:
            self.full = True
        else:
            self.images[int(image)] = None
        if plants is None or len(plants) == 0:
            self.everyone = True
        else:
            self.plants |= dict.fromkeys(map(int, plants))

    def state(self) -> tuple:
        return self.anchor, self.events, self.full, list(self.images), self.everyone, list(self.plants)

    def request(self, key: tuple) -> tuple:
        images, plants = ([] if self.full else list(self.images)), ([] if self.everyone else list(self.plants))
        return (*key, pd.Timestamp(self.anchor, unit="ms", tz="UTC"), self.events, self.full, images, self.everyone, plants)


def collect(window_s: float, by_event_time: bool):
    """The step of a key's state: what a micro-batch brings, or that its time is up.

    By event time a burst starts at its first event's time, and the next event
    at or beyond its end opens another. By processing time all events of a
    micro-batch arrive at once, when it is worked on.
    """
    window = int(window_s * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        burst, done = (Burst(*state.get) if state.exists else None), []
        now = None if by_event_time else state.getCurrentProcessingTimeMs()
        if burst and (state.hasTimedOut or (now is not None and now >= burst.anchor + window)):
            done.append(burst)
            burst = None
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            rows = rows.sort_values(["ts", "image_id"], kind="stable") if by_event_time else rows
            for at, image, plants in zip(rows.ts, rows.image_id, rows.plant_ids, strict=True):
                here = at.value // 1_000_000 if by_event_time else now
                if burst and here >= burst.anchor + window:
                    done.append(burst)
                    burst = None
                burst = burst or Burst(here)
                burst.add(image, plants)
        if burst is None:
            state.remove()
        else:
            state.update(burst.state())
            end = burst.anchor + window
            if by_event_time:
                state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
            else:
                state.setTimeoutDuration(max(1, end - now))
        yield pd.DataFrame([b.request(key) for b in done], columns=[c.split()[0] for c in REQUEST.split(", ")])

    return step


def bursts(stream: DataFrame, window_s: float = WINDOW_S, by_event_time: bool = False, delay: str = "0 seconds") -> DataFrame:
    """str1: one request a burst of events (entry_id, mode, ts, image_id, plant_ids) of an entry and mode.

    A burst collects for a fixed time from its first event, however many follow.
    By processing time a timer ends it, between micro-batches too. By event time
    it ends when the watermark passes, so replays give the same bursts.
    """
    rows = stream.select("entry_id", "mode", "ts", "image_id", "plant_ids")
    kind = GroupStateTimeout.ProcessingTimeTimeout
    if by_event_time:
        rows, kind = rows.withWatermark("ts", delay), GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("entry_id", "mode").applyInPandasWithState(collect(window_s, by_event_time), REQUEST, _STATE, "append", kind)


def handed_once(keys: list[str], order: list[str], folder: str):
    """str10, str3: a foreachBatch step that writes the first row of each key not handed on before, for ever.

    A micro-batch writes its own part, `batch=<id>`, over what an earlier try left
    there, and looks for its keys in the parts of other batches only. A batch
    that is replayed after a failure therefore leaves the same rows, once.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        by = W.partitionBy(*keys).orderBy(*order)
        fresh = batch.withColumn("_nth", F.row_number().over(by)).where("_nth = 1").drop("_nth")
        before = written(batch.sparkSession, folder)
        if before is not None:
            fresh = fresh.join(before.where(F.col("batch") != batch_id).select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return step


def written(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows handed on so far with the number of their batch, or None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path) or not [s for s in files.listStatus(path) if s.getPath().getName().startswith("batch=")]:
        return None
    return spark.read.parquet(folder)


def hand_off(stream: DataFrame, excluded: DataFrame, folder: str, state: str):
    """str10: verified frames (entry_id, image_id, ts) of a stream, each handed on once, without the excluded (entry_id, image_id)."""
    kept = stream.join(excluded.select("entry_id", "image_id").distinct(), ["entry_id", "image_id"], "left_anti")
    return kept.writeStream.foreachBatch(handed_once(["entry_id", "image_id"], ["ts"], folder)).option("checkpointLocation", state)
