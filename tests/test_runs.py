"""Grid runs, captures, frames and photo quality by hand and against plain loops."""

import datetime as dt
import math

from canopia.operators import runs

START = dt.datetime(2024, 5, 1, 8)


def _run(spark, gone=(), gantry=(), repaired=(), start=START):
    """A 4 x 3 grid, an image a minute, 200 mm apart with noise of a few millimetres."""
    rows, marks = [], []
    for k in range(12):
        x, y = 200.0 * (k % 4) + k % 3, 150.0 * (k // 4) - k % 2
        if k in gone:
            continue
        late = k in repaired
        rows.append((1, k, start + dt.timedelta(minutes=k + 600 * late), x, y, -float(k % 2), k in gantry))
        if late:
            marks.append((1, k, start - dt.timedelta(minutes=5)))
    images = spark.createDataFrame(rows, "entry int, id int, created_at timestamp, x double, y double, z double, gantry boolean")
    return images, spark.createDataFrame(marks, "entry int, id int, run_started_at timestamp")


def test_missing_cells_and_inner_gantry(spark):
    found = runs.latest_grid_run(*_run(spark, gone=(2,), gantry=(1, 5))).collect()
    assert {(r.reason, round(r.x / 200), round(r.y / 150), r.image_id) for r in found} == {("missing", 2, 0, None), ("gantry", 1, 1, 5)}
    assert {(r.expected, round(r.coverage, 3)) for r in found} == {(12, 0.917)}


def test_repairs_fill_their_run_only(spark):
    images, repairs = _run(spark, repaired=(2,))
    found = runs.latest_grid_run(images, repairs).collect()
    assert [(r.reason, r.coverage, r.completed_at) for r in found] == [(None, 1.0, START + dt.timedelta(minutes=11))]
    old = repairs.selectExpr("entry", "id", "run_started_at - interval 2 hours as run_started_at")
    assert [r.reason for r in runs.latest_grid_run(images, old).collect()] == ["missing"]


def test_runs_that_are_no_grid(spark):
    images, repairs = _run(spark)
    assert runs.latest_grid_run(images.where("id < 3"), repairs).count() == 0
    assert runs.latest_grid_run(images.where("y < 100"), repairs).count() == 0
    assert runs.latest_grid_run(images.where("id IN (0, 5, 10, 3)"), repairs).count() == 0
    assert runs.latest_grid_run(images.limit(0), repairs).count() == 0


def test_newest_captures_equal_a_loop(spark):
    rows = [(k % 2, k, START + dt.timedelta(seconds=k * 7919 % 1009), float(k * 37 % 151), float(k * 61 % 149)) for k in range(600)]
    kept = {0: [], 1: []}
    for e, k, _, x, y in sorted(rows, key=lambda r: (r[2], r[1]), reverse=True):
        if all(math.hypot(x - a, y - b) > 25 for _, a, b in kept[e]):
            kept[e].append((k, x, y))
    images = spark.createDataFrame(rows, "entry int, id int, created_at timestamp, x double, y double")
    found = runs.newest_per_location(images).collect()
    assert {(r.entry, r.id) for r in found} == {(e, k) for e, own in kept.items() for k, _, _ in own}
    assert runs.newest_per_location(images.limit(0)).count() == 0


def test_frames_take_their_targets_in_order(spark):
    targets = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 20.0, 0.0, 0.0), (1, 2, 200.0, 0.0, 0.0)], "run int, target_index int, x double, y double, z double")
    rows = [
        (1, 1, 10, 2.0, 0.0, 0.0, None), (1, 2, 11, 1.0, 0.0, 0.0, None),  # the second takes what is left, 19 mm off
        (1, 3, 12, 3.0, 0.0, 0.0, None), (1, 4, None, 200.0, 0.0, 0.0, None), (1, 5, 13, 200.0, 0.0, 30.0, None),
        (1, 6, 14, 900.0, 0.0, 0.0, 2), (1, 7, 15, 200.0, 0.0, 0.0, 2), (1, 8, 16, 200.0, 0.0, 0.0, 9),
    ]
    frames = spark.createDataFrame(rows, "run int, seq int, image_id int, x double, y double, z double, declared int")
    assert {(r.target_index, r.image_id) for r in runs.match_frames(targets, frames).collect()} == {(0, 10), (1, 11), (2, 14)}


def test_blur_against_neighbours(spark):
    rows = [(1, x, y, 10 * y + x, "usable", 20.0 if (x, y) == (1, 1) else 100.0, 0.02 if (x, y) == (1, 1) else 0.1, 0.1, 0.1) for x in range(3) for y in range(3)]
    df = spark.createDataFrame(rows, "run int, cell_x int, cell_y int, image_id int, issue string, laplacian double, edges double, contrast double, blur double")
    found = {r.image_id: r for r in runs.relative_blur(df).collect()}
    assert len(found) == 9 and [k for k, r in found.items() if r.issue == "blurry"] == [11]
    assert math.isclose(found[11].blur, 0.65 * (1 - 0.2 / 0.35) + 0.35 * (1 - 0.2 / 0.65))
    # one usable neighbour is no measure
    assert runs.relative_blur(df.where("image_id IN (11, 1)")).where("issue = 'blurry'").count() == 0
    assert [r.image_id for r in runs.quality_repairs(df, df.where("image_id = 11").select("image_id")).collect()] == []


def test_soil_triplets_by_hand(spark):
    def rows(*d, passes=(True, True, True), spread=0.0):
        return [(1, 500.0, spread, [(1 / v, p, 0.35, 0.8, 0.0, 0.0) for v, p in zip(d, passes, strict=True)])]

    kind = "measurement_id int, camera_z double, z_spread double, pairs array<struct<disparity:double,passes:boolean,coverage:double,support:double,lr_error:double,mad:double>>"
    found = lambda *a, **k: runs.soil_heights(spark.createDataFrame(rows(*a, **k), kind), 1.0, 0.0, 1.0).first()
    assert (found(100.0, 103.0, 104.0).proposed_z, found(100.0, 103.0, 104.0).uncertainty) == (603.0, 2.0)
    assert found(100.0, 103.0, 150.0).proposed_z == 602.0  # 601.5, to even
    assert found(100.0, 120.0, 140.0).reason == "pairs disagree"
    assert found(100.0, 103.0, 104.0, passes=(True, False, False)).reason == "fewer than two pairs passed"
    assert found(100.0, 103.0, 104.0, spread=1.5).valid is False
