"""Bursts under a clock set by hand and under a real one; hand-offs that are replayed."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from canopia.streaming import bursts

EVENTS = "entry_id long, mode string, ts timestamp, image_id long, plant_ids array<long>"
T0 = datetime(2024, 1, 1)


class Clock:
    """A key's state with the time set by hand."""

    def __init__(self):
        self.value, self.now, self.watermark, self.hasTimedOut, self.timer = None, 0, 0, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.timer = value, None

    def remove(self):
        self.value = self.timer = None

    def getCurrentProcessingTimeMs(self):
        return self.now

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutDuration(self, ms):
        self.timer = self.now + ms

    def setTimeoutTimestamp(self, ms):
        self.timer = ms


def arrive(step, clock, at, *events):
    """What the key gives out when events arrive at that time; the timer goes off before if it is due."""
    out = []
    if clock.timer is not None and at >= clock.timer:
        clock.now, clock.hasTimedOut = max(at, clock.timer), True
        out += list(step((1, "auto"), iter([]), clock))
        clock.hasTimedOut = False
    clock.now = at
    if events:
        frame = pd.DataFrame([(pd.Timestamp(T0), i, p) for i, p in events], columns=["ts", "image_id", "plant_ids"])
        out += list(step((1, "auto"), iter([frame]), clock))
    rows = pd.concat([o for o in out if len(o)]) if any(map(len, out)) else pd.DataFrame(columns=["images"])
    return [(int(r.events), bool(r.full), list(r.images), bool(r.everyone), list(r.plants)) for r in rows.itertuples()]


def test_two_bursts_split_at_the_window():
    step, clock = bursts.collect(0.75, False), Clock()
    assert arrive(step, clock, 1000, (7, [1])) == [] and clock.timer == 1750
    # later events do not move the end
    assert arrive(step, clock, 1400, (8, [1, 2]), (7, [3])) == [] and clock.timer == 1750
    assert arrive(step, clock, 1749, (9, [1])) == [] and clock.timer == 1750
    assert arrive(step, clock, 1750, (10, [])) == [(4, False, [7, 8, 9], False, [1, 2, 3])]
    assert clock.timer == 2500
    assert arrive(step, clock, 2600) == [(1, False, [10], True, [])] and not clock.exists
    assert arrive(step, clock, 9000, (None, [4])) == [] and arrive(step, clock, 9800) == [(1, True, [], False, [4])]


def test_a_timer_that_is_late():
    """Without the timer having gone off, an event beyond the end still opens a burst of its own."""
    step, clock = bursts.collect(0.75, False), Clock()
    arrive(step, clock, 0, (1, [1]))
    clock.timer = None
    assert arrive(step, clock, 5000, (2, [1])) == [(1, False, [1], False, [1])]
    assert clock.timer == 5750


def test_bursts_under_a_real_clock(spark, tmp_path):
    source, rows, state = (str(tmp_path / n) for n in ("in", "rows", "state"))
    put = lambda *images: spark.createDataFrame([(1, "auto", T0, i, [i]) for i in images], EVENTS).coalesce(1).write.mode("append").parquet(source)
    put(1, 2)
    made = bursts.bursts(spark.readStream.schema(EVENTS).parquet(source), 1.5)
    query = made.writeStream.format("parquet").option("path", rows).option("checkpointLocation", state).trigger(processingTime="200 milliseconds").start()
    try:
        seen = lambda: spark.read.schema(bursts.REQUEST).parquet(rows).collect()

        def until(n):
            end = time.time() + 60
            while time.time() < end and len(query.recentProgress) < 1:
                time.sleep(0.1)
            while time.time() < end:
                found = seen() if (tmp_path / "rows" / "_spark_metadata").exists() else []
                if len(found) >= n:
                    return found
                time.sleep(0.2)
            raise AssertionError(query.lastProgress)

        assert [sorted(r.images) for r in until(1)] == [[1, 2]]
        put(3)
        assert sorted(sorted(r.images) for r in until(2)) == [[1, 2], [3]]
    finally:
        query.stop()


def test_hand_offs_are_written_once(spark, tmp_path):
    source, rows, state = (str(tmp_path / n) for n in ("in", "rows", "state"))
    schema = "entry_id long, image_id long, ts timestamp"
    put = lambda *keys: spark.createDataFrame([(e, i, T0 + timedelta(seconds=s)) for e, i, s in keys], schema).coalesce(1).write.mode("append").parquet(source)
    excluded = spark.createDataFrame([(1, 9)], "entry_id long, image_id long")
    run = lambda: bursts.hand_off(spark.readStream.schema(schema).parquet(source), excluded, rows, state).trigger(availableNow=True).start().awaitTermination()
    keys = lambda: sorted((r.entry_id, r.image_id) for r in bursts.written(spark, rows).collect())
    put((1, 1, 5), (1, 1, 3), (1, 9, 1), (2, 1, 1))
    run()
    assert keys() == [(1, 1), (2, 1)]
    assert bursts.written(spark, rows).where("entry_id = 1").first().ts == T0 + timedelta(seconds=3)
    put((1, 1, 9), (1, 2, 9))
    run()
    run()
    assert keys() == [(1, 1), (1, 2), (2, 1)]


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    step = bursts.handed_once(["k"], ["v"], str(tmp_path / "rows"))
    batch = lambda *rows: spark.createDataFrame(list(rows), "k long, v long")
    assert bursts.written(spark, str(tmp_path / "rows")) is None
    step(batch((1, 5), (1, 4), (2, 1)), 0)
    step(batch((2, 7), (3, 1)), 1)
    step(batch((2, 7), (3, 1)), 1)  # the try before failed after its write
    step(batch((1, 5), (1, 4), (2, 1)), 0)
    step(batch((1, 1)).where(F.lit(False)), 2)
    found = sorted((r.k, r.v, r.batch) for r in bursts.written(spark, str(tmp_path / "rows")).collect())
    assert found == [(1, 4, 0), (2, 1, 0), (3, 1, 1)]
