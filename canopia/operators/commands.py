"""dec9, dec2, soi11: logs of commands, folded in order onto the state they change, with conflicts reported.

A log is dealt by what it changes and sorted, and a task goes through its
partition once, with one state at a time: however long one entity's log is, a
few values are kept. What a command may do whatever the state is worked out
before, as columns.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Millimetres within which a state is what a command expects, and the least change worth applying.
SAME_MM, LEAST_CHANGE_MM = 0.1, 3.0


def folded(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """What `step` makes of the rows of each key in order.

    start() is a key's state; step(state, row) changes it and returns a tuple in
    the order of the schema, or None.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    target = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        last, state = object(), None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if row[key] != last:
                    last, state = row[key], start()
                found = step(state, row)
                if found is not None:
                    made.append(found)
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], f.type) for k, f in enumerate(target)], names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


REVIEWED = "command_id long, plant_id long, measurement_id long, outcome string, reason string, before_mm double, after_mm double"


def review(plants: DataFrame, measurements: DataFrame, commands: DataFrame, least_change: float = LEAST_CHANGE_MM) -> DataFrame:
    """dec9: the outcome of each command (command_id, measurement_id, at, action) on plants (plant_id, radius_mm), in order of time and id.

    measurements: measurement_id, plant_id, measured_at, current_mm,
    recommended_mm, calibrated, zone_allows, misaligned, centre_allows.

    approve, reject, remove and keep settle all that was measured of the plant
    until then; move-center leaves it open. approve needs a calibration, a
    change of at least `least_change` (no change at all is approved as such), the
    zones' leave, and a radius that is still the measured one; remove and keep need the newest
    measurement. What is not given is a conflict and changes nothing.
    """
    later = F.lead("measured_at").over(W.partitionBy("plant_id").orderBy("measured_at", "measurement_id"))
    facts = measurements.withColumn("next_at", later)
    names = ["measurement_id", "plant_id", "measured_at", "next_at", "current_mm", "recommended_mm", "calibrated", "zone_allows", "misaligned", "centre_allows"]
    known = commands.select("command_id", F.col("measurement_id").alias("target"), "at", "action").join(facts.select(names), F.col("target") == F.col("measurement_id"), "left")
    log = known.select(
        F.col("plant_id").cast("long"), F.lit(1).alias("turn"), F.col("at").cast("double").alias("at"), F.col("command_id").cast("long"), F.col("target").cast("long").alias("measurement_id"), "action",
        F.col("measured_at").cast("double").alias("measured_at"), F.coalesce(F.col("next_at") <= F.col("at"), F.lit(False)).alias("older"), *names[4:], F.lit(None).cast("double").alias("radius_mm"),
    )
    begin = plants.select(F.col("plant_id").cast("long"), F.lit(0).alias("turn"), F.col("radius_mm").cast("double"))
    rows = log.unionByName(begin, allowMissingColumns=True)

    def start():
        return {"radius": None, "settled": float("-inf")}

    def step(state, row):
        if row["turn"] == 0:
            state["radius"] = row["radius_mm"]
            return None
        before, action = state["radius"], row["action"]

        def verdict():
            if row["measured_at"] is None or row["measured_at"] > row["at"]:
                return "conflict", "no measurement"
            if row["measured_at"] <= state["settled"]:
                return "conflict", "reviewed"
            if action == "reject":
                return "rejected", None
            if action in ("remove", "keep") and row["older"]:
                return "conflict", "newer measurement"
            if action == "keep":
                return "kept", None
            if before is None:
                return "conflict", "no plant"
            if action == "remove":
                return "removed", None
            if action == "move-center":
                return ("center_moved", None) if row["misaligned"] and row["centre_allows"] else ("conflict", "zone" if row["misaligned"] else "no centre")
            if action != "approve":
                return "conflict", "unknown action"
            change = abs(row["recommended_mm"] - row["current_mm"])
            if not row["calibrated"]:
                return "conflict", "calibration"
            if change == 0:
                return "approved_no_change", None
            if change < least_change:
                return "conflict", "small change"
            if not row["zone_allows"]:
                return "conflict", "zone"
            return ("applied", None) if abs(before - row["current_mm"]) <= SAME_MM else ("conflict", "changed")

        outcome, reason = verdict()
        if outcome == "applied":
            state["radius"] = row["recommended_mm"]
        if outcome == "removed":
            state["radius"] = None
        if outcome not in ("conflict", "center_moved"):
            state["settled"] = row["at"]
        return row["command_id"], row["plant_id"], row["measurement_id"], outcome, reason, before, state["radius"]

    return folded(rows, "plant_id", ["turn", "at", "command_id"], start, step, REVIEWED)


def automatic(judged: DataFrame, least_views: int = 2) -> DataFrame:
    """dec2: approvals of judged plants (measurement_id, plant_id, views, reliable, decision, at) whose fusion can be relied on."""
    return judged.where((F.col("views") >= least_views) & F.col("reliable") & F.col("decision").isin("apply", "automatic")).select(F.col("measurement_id").alias("command_id"), "measurement_id", "at", F.lit("approve").alias("action"))


def changes(outcomes: DataFrame) -> DataFrame:
    """The change log of applied commands: radius increased or decreased, or plant removed."""
    kind = F.when(F.col("outcome") == "removed", "plant removed").when(F.col("after_mm") > F.col("before_mm"), "radius increased").otherwise("radius decreased")
    return outcomes.where(F.col("outcome").isin("applied", "removed")).select("command_id", "plant_id", kind.alias("change_type"), "before_mm", "after_mm")


REPAIRED = "command_id long, point_id long, repair_id long, outcome string, reason string, z_before double, z_after double"


def repair_heights(points: DataFrame, repairs: DataFrame, commands: DataFrame) -> DataFrame:
    """soi11: the outcome of commands (command_id, repair_id, at, action) to apply or reject repairs of soil points.

    points: point_id, x, y, z, updated_at. repairs: repair_id, point_id, state,
    expected_x, expected_y, expected_z, new_x, new_y, repaired_z. A repair is
    applied once, if the point is dated and still within SAME_MM of what the
    repair expects; otherwise it ends as a conflict, as it does when it has none.
    """
    names = ["state", "expected_x", "expected_y", "expected_z", "new_x", "new_y", "repaired_z"]
    known = commands.select("command_id", F.col("repair_id").alias("target"), "at", "action").join(repairs.select("repair_id", "point_id", *names), F.col("target") == F.col("repair_id"), "left")
    log = known.select(F.col("point_id").cast("long"), F.lit(1).alias("turn"), F.col("at").cast("double").alias("at"), F.col("command_id").cast("long"), F.col("target").cast("long").alias("repair_id"), "action", *names)
    begin = points.select(F.col("point_id").cast("long"), F.lit(0).alias("turn"), *[F.col(c).cast("double").alias(f"p_{c}") for c in "xyz"], F.col("updated_at").isNotNull().alias("dated"))
    rows = log.unionByName(begin, allowMissingColumns=True)

    def start():
        return {"at": None, "dated": False, "done": set()}

    def step(state, row):
        if row["turn"] == 0:
            state["at"], state["dated"] = (row["p_x"], row["p_y"], row["p_z"]), row["dated"]
            return None
        before = state["at"][2] if state["at"] else None

        def verdict():
            if row["state"] != "pending" or row["repair_id"] in state["done"]:
                return "ignored", "not pending"
            if row["action"] == "reject":
                return "rejected", None
            if row["action"] != "apply" or row["repaired_z"] is None:
                return "ignored", "nothing to apply"
            if state["at"] is None or not state["dated"]:
                return "conflict", "missing or undated"
            expected = row["expected_x"], row["expected_y"], row["expected_z"]
            return ("applied", None) if all(abs(a - b) <= SAME_MM for a, b in zip(state["at"], expected, strict=True)) else ("conflict", "changed")

        outcome, reason = verdict()
        if outcome != "ignored":
            state["done"].add(row["repair_id"])
        if outcome == "applied":
            x, y, _ = state["at"]
            state["at"] = (x if row["new_x"] is None else row["new_x"], y if row["new_y"] is None else row["new_y"], row["repaired_z"])
        return row["command_id"], row["point_id"], row["repair_id"], outcome, reason, before, state["at"][2] if state["at"] else None

    return folded(rows, "point_id", ["turn", "at", "command_id"], start, step, REPAIRED)


def may_apply_height(confidence: Column, uncertainty: Column, least_confidence: float, most_uncertainty: float, enabled: bool = True) -> Column:
    """soi9: whether a soil height goes on without a person; unknown figures never do."""
    return F.lit(enabled) & F.coalesce((confidence >= least_confidence) & (uncertainty <= most_uncertainty), F.lit(False))
