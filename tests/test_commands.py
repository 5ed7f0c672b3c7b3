"""Command logs by hand: guards, conflicts, repeats, and one long log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from canopia.operators import commands

T0 = datetime(2024, 1, 1)
MEASURED = "measurement_id long, plant_id long, measured_at timestamp, current_mm double, recommended_mm double, calibrated boolean, zone_allows boolean, misaligned boolean, centre_allows boolean"
LOG = "command_id long, measurement_id long, at timestamp, action string"


def at(hours):
    return T0 + timedelta(hours=hours)


def measured(k, plant, hours, current=50.0, recommended=60.0, **more):
    return (k, plant, at(hours), current, recommended, *(more.get(n, d) for n, d in (("calibrated", True), ("zone", True), ("misaligned", False), ("centre", True))))


def run(spark, plants, rows, log):
    found = commands.review(spark.createDataFrame(plants, "plant_id long, radius_mm double"), spark.createDataFrame(rows, MEASURED), spark.createDataFrame([(k, m, at(h), a) for k, m, h, a in log], LOG)).collect()
    return {r.command_id: (r.outcome, r.reason, r.before_mm, r.after_mm) for r in found}


def test_approvals_settle_and_go_stale(spark):
    rows = [measured(1, 1, 1), measured(2, 1, 2), measured(3, 1, 9), measured(4, 1, 10, current=60.0, recommended=55.0), measured(5, 2, 1, recommended=50.0), measured(6, 2, 9, recommended=51.0), measured(7, 2, 9, calibrated=False), measured(8, 2, 9, zone=False)]
    log = [(1, 1, 5, "approve"), (2, 1, 6, "approve"), (3, 2, 7, "reject"), (4, 3, 12, "approve"), (5, 4, 13, "approve"), (6, 5, 5, "approve"), (7, 6, 10, "approve"), (8, 7, 10, "approve"), (9, 8, 10, "approve"), (10, 3, 8, "approve"), (11, 99, 9, "approve")]
    found = run(spark, [(1, 50.0), (2, 50.0)], rows, log)
    assert found[1] == ("applied", None, 50.0, 60.0)
    assert found[2] == found[3] == ("conflict", "reviewed", 60.0, 60.0)  # the second measurement was settled with the first
    assert found[10] == ("conflict", "no measurement", 60.0, 60.0)  # not yet measured at the time
    assert found[4] == ("conflict", "changed", 60.0, 60.0) and found[5] == ("applied", None, 60.0, 55.0)
    assert found[6][0] == "approved_no_change" and [found[k][1] for k in (7, 8, 9)] == ["small change", "calibration", "zone"]
    assert found[11] == ("conflict", "no measurement", None, None)


def test_removals_need_the_newest(spark):
    rows = [measured(1, 1, 1), measured(2, 1, 5), measured(3, 1, 9, misaligned=True), measured(4, 2, 1, misaligned=True, centre=False), measured(5, 3, 1)]
    log = [(1, 1, 6, "remove"), (2, 2, 6, "move-center"), (3, 2, 7, "keep"), (4, 3, 10, "move-center"), (5, 3, 11, "remove"), (6, 3, 12, "approve"), (7, 4, 2, "move-center"), (8, 5, 2, "approve"), (9, 5, 3, "keep"), (10, 4, 4, "dance")]
    found = run(spark, [(1, 50.0), (2, 50.0)], rows, log)
    assert [found[k][:2] for k in range(1, 6)] == [("conflict", "newer measurement"), ("conflict", "no centre"), ("kept", None), ("center_moved", None), ("removed", None)]
    assert found[5][3] is None and found[6][1] == "reviewed" and found[7][1] == "zone" and found[8][1] == "no plant" and found[9][0] == "kept" and found[10][1] == "unknown action"


def test_one_plant_holds_the_log(spark):
    rows = [measured(k, 1, k, current=50.0 + k, recommended=51.0 + k) for k in range(3000)]
    log = [(k, k, k + 0.5, "approve") for k in range(3000)]
    made = commands.review(spark.createDataFrame([(1, 50.0)], "plant_id long, radius_mm double"), spark.createDataFrame(rows, MEASURED), spark.createDataFrame([(k, m, at(h), a) for k, m, h, a in log], LOG).repartition(7), least_change=0.5)
    assert made.where("outcome <> 'applied'").isEmpty() and made.agg(F.max("after_mm")).first()[0] == 3050.0
    assert commands.changes(made).groupBy("change_type").count().collect()[0]["count"] == 3000


def test_automatic_commands_are_approvals(spark):
    judged = spark.createDataFrame([(1, 1, 2, True, "apply", T0), (2, 1, 1, True, "apply", T0), (3, 1, 3, False, "apply", T0), (4, 1, 3, True, "review", T0)], "measurement_id long, plant_id long, views long, reliable boolean, decision string, at timestamp")
    assert [(r.command_id, r.action) for r in commands.automatic(judged).collect()] == [(1, "approve")]
    rows = spark.createDataFrame([(0.9, 4.0), (0.5, 4.0), (0.9, None), (None, 1.0)], "c double, u double")
    assert [r[0] for r in rows.select(commands.may_apply_height(F.col("c"), F.col("u"), 0.8, 5.0)).collect()] == [True, False, False, False]


def test_repairs_check_the_point(spark):
    points = spark.createDataFrame([(1, 10.0, 20.0, -5.0, T0), (2, 10.0, 20.0, -5.0, None), (3, 0.0, 0.0, 0.0, T0)], "point_id long, x double, y double, z double, updated_at timestamp")
    schema = "repair_id long, point_id long, state string, expected_x double, expected_y double, expected_z double, new_x double, new_y double, repaired_z double"
    ask = lambda k, p, state="pending", z=-5.0, new=-8.0, x=10.05: (k, p, state, x, 20.0, z, 12.0 if k == 1 else None, None, new)
    repairs = spark.createDataFrame([ask(1, 1), ask(2, 1), ask(3, 2), ask(4, 1, "applied"), ask(5, 1, new=None), ask(6, 7), ask(8, 1, z=-8.0, new=-9.0, x=12.0), ask(9, 1)], schema)
    log = [(1, 1, "apply"), (2, 1, "apply"), (3, 2, "apply"), (4, 3, "apply"), (5, 4, "apply"), (6, 5, "apply"), (7, 6, "apply"), (8, 8, "apply"), (9, 9, "reject"), (10, 9, "apply"), (11, 77, "apply")]
    found = commands.repair_heights(points, repairs, spark.createDataFrame([(k, r, at(k), a) for k, r, a in log], "command_id long, repair_id long, at timestamp, action string"))
    got = {r.command_id: (r.outcome, r.reason, r.z_after) for r in found.collect()}
    assert got == {
        1: ("applied", None, -8.0), 2: ("ignored", "not pending", -8.0), 3: ("conflict", "changed", -8.0), 4: ("conflict", "missing or undated", -5.0), 5: ("ignored", "not pending", -8.0), 6: ("ignored", "nothing to apply", -8.0),
        7: ("conflict", "missing or undated", None), 8: ("applied", None, -9.0), 9: ("rejected", None, -9.0), 10: ("ignored", "not pending", -9.0), 11: ("ignored", "not pending", None),
    }


def test_empty_logs(spark):
    none = commands.review(spark.createDataFrame([], "plant_id long, radius_mm double"), spark.createDataFrame([], MEASURED), spark.createDataFrame([], LOG))
    assert none.collect() == [] and commands.changes(none).collect() == []
