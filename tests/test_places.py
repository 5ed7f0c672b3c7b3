"""Rows that coincide meet once: the pairs that a query forms follow the places, not the rows, and the results stay those of all rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from canopia.operators import assignment, geometry, planning, reviews, runs
from canopia.operators import transforms as T

N = 40  # rows of each place


@pytest.fixture
def pairs(monkeypatch):
    """The number of pairs within a cell's reach that each call has formed, and of rows on its right."""
    seen = []
    within = geometry.within

    def counted(left, right, radius):
        found = within(left, right, radius)
        seen.append((found.count(), right.count()))
        return found

    monkeypatch.setattr(geometry, "within", counted)
    return seen


@pytest.fixture
def discs_met(monkeypatch):
    """The number of pairs that each call of reach_pairs has formed."""
    seen = []
    reach_pairs = geometry.reach_pairs

    def counted(*args):
        found = reach_pairs(*args)
        seen.append(found.count())
        return found

    monkeypatch.setattr(geometry, "reach_pairs", counted)
    return seen


def _rows(places, first=1):
    return [(first + k, float(x), float(y)) for k, (x, y) in enumerate(places * N)]


def _near(places):
    return [(10.0 * k, 5.0 * k) for k in range(places)]


def test_images_and_plants_of_a_place(spark, pairs):
    images, plants = _rows(_near(3)), _rows(_near(4), 7)
    rows = reviews.visible_plants(spark.createDataFrame(images, "id long, x double, y double"), spark.createDataFrame(plants, "id long, x double, y double")).collect()
    assert {tuple(r) for r in rows} == {(i, 4 * N, 7) for i, _, _ in images}
    assert pairs == [(12, 4)]


def test_soil_heights_of_a_place(spark, pairs):
    rng = random.Random(5)
    places = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 30.0, 40.0), (4, 5000.0, 0.0)]
    samples = [(x, y, round(rng.uniform(-9, 9), 2)) for x, y in ((10.0, 0.0), (0.0, 20.0), (30.0, 40.0)) for _ in range(N)]
    found = {r["id"]: r for r in planning.soil_height(spark.createDataFrame(places, "id long, x double, y double"), spark.createDataFrame(samples, "x double, y double, z double")).collect()}
    assert set(found) == {1, 2, 3} and pairs == [(6, 3)]
    for k in (1, 2):
        w = [1 / max(1.0, math.hypot(x, y)) ** 2 for x, y, _ in samples]
        mean = sum(a * s[2] for a, s in zip(w, samples, strict=True)) / sum(w)
        spread = math.sqrt(sum(a * (s[2] - mean) ** 2 for a, s in zip(w, samples, strict=True)) / sum(w))
        assert (found[k]["samples"], found[k]["nearest_mm"], found[k]["method"]) == (3 * N, 10.0, "interpolated")
        assert found[k]["z"] == pytest.approx(mean, abs=1e-9) and found[k]["spread_mm"] == pytest.approx(spread, abs=1e-9)
    assert (found[3]["samples"], found[3]["method"], found[3]["z"]) == (1, "exact", min(z for x, _, z in samples if x == 30))


def test_targets_of_a_place(spark, pairs):
    places, points = _rows([(0.0, 0.0), (900.0, 0.0)]), _rows([(3.0, 4.0), (60.0, 0.0)], 11)
    rows = planning.measurement_target(spark.createDataFrame(places, "id long, x double, y double"), spark.createDataFrame(points, "id long, x double, y double")).collect()
    assert {tuple(r) for r in rows} == {(i, 11, 5.0) if x == 0 else (i, 0, 0.0) for i, x, _ in places}
    assert pairs == [(2, 2)]


def test_clear_sites_of_a_place(spark, pairs, discs_met):
    weeds = [(k + 1, 500.0, 500.0) for k in range(N)]
    discs, anchors = [(500.0, 500.0, 10.0 + k % 5) for k in range(N)], [(k + 3, 500.0, 600.0) for k in range(N)]
    rows = planning.clear_site(
        spark.createDataFrame(weeds, "id long, x double, y double"), spark.createDataFrame(discs, "x double, y double, radius double"), spark.createDataFrame(anchors, "id long, x double, y double"), (1000.0, 1000.0)
    ).collect()
    assert {(r["id"], r["ring"], r["anchor_id"]) for r in rows} == {(i, 100, 3) for i, _, _ in weeds}
    assert len({(r["angle"], r["x"], r["y"], r["clearance"]) for r in rows}) == 1 and rows[0]["clearance"] == 100 - 14 - 75
    assert pairs[0][1] == 1 and max(discs_met) <= 24 * 11


@pytest.mark.parametrize("away", [0.0, 5000.0])
def test_nearest_edges_of_a_place(spark, pairs, away):
    places, discs = _rows(_near(3)), [(away + 50.0, 0.0, 1.0 + k % 7) for k in range(N)]
    rows = geometry.nearest_edges(spark.createDataFrame(places, "id long, x double, y double"), spark.createDataFrame(discs, "x double, y double, radius double")).collect()
    assert {r["id"]: r["edge"] for r in rows} == {i: math.sqrt((x - away - 50) ** 2 + y * y) - 7 for i, x, y in places}
    assert all(n <= 3 and right == 1 for n, right in pairs)


def test_pairs_are_whole(spark, pairs):
    left, right = _rows([(0.0, 0.0), (90.0, 0.0)]), _rows([(0.0, 10.0), (100.0, 0.0)], 500)
    frames = [spark.createDataFrame(r, "id long, x double, y double") for r in (left, right)]
    rows = [tuple(r) for r in geometry.linked(*frames, 20.0).collect()]
    assert sorted(rows) == sorted((i, o) for i, x, y in left for o, a, b in right if math.hypot(x - a, y - b) <= 20)
    assert pairs == [(2, 2)]


def test_detections_of_a_place(spark, pairs, discs_met):
    """A plain loop over all pairs, with equal ages, no times and no radius among them."""
    rng = random.Random(2)
    day = dt.datetime(2024, 5, 1)
    at = lambda: None if rng.random() < 0.1 else day + dt.timedelta(hours=rng.choice([0, 1, 24, 25, 60]))
    spot = lambda: (float(rng.choice([0, 15, 20, 300, 347])), 0.0)
    points = [(k, *spot(), k % 3, at()) for k in range(120)]
    found = [(*spot(), k % 3, at(), rng.choice(["created", "recommended", "rejected", "other"]), rng.choice([None, 4.0, 32.0, 90.0])) for k in range(60)]

    def stands(p, d):
        gap = math.hypot(p[1] - d[0], p[2] - d[1])
        if d[4] in ("created", "recommended") and gap <= 20:
            return d[4] != "created" or (p[4] is not None and d[3] is not None and (p[4] - d[3]).total_seconds() <= 24 * 3600)
        return d[4] == "rejected" and p[3] == d[2] and gap <= max(20.0, 1.5 * (d[5] or 0.0))

    rows = geometry.near_detection(
        spark.createDataFrame(points, "id long, x double, y double, image_id long, image_timestamp timestamp"),
        spark.createDataFrame(found, "x double, y double, image_id long, image_timestamp timestamp, status string, radius_mm double"), ("created", "recommended"), ("rejected",),
    )
    assert sorted(r["id"] for r in rows.collect()) == [p[0] for p in points if any(stands(p, d) for d in found)]
    assert pairs[0][0] <= 13 and pairs[0][1] <= 5 and discs_met[0] <= 3 * 25


def test_plan_leaves_far_points_alone(spark, pairs):
    points = [(k, 60.0 + 900 * k, 50.0, dt.datetime(2024, 1, 1)) for k in range(50)]
    frame = spark.createDataFrame(points, "id long, x double, y double, updated_at timestamp")
    rows = assignment.measurement_grid(frame, spark.createDataFrame([], "x double, y double, radius double"), [], (0.0, 0.0, 300.0, 100.0), 100.0, 60.0, 12.0, 20.0).collect()
    assert sorted((r["grid_x"], r["point_id"] if r["point_id"] is not None else -1) for r in rows) == [(50.0, 0), (150.0, -1), (250.0, -1)]
    assert pairs[0][1] == 1


def test_cells_meet_discs_once(spark, discs_met):
    cells = [(1, 0.0, 0.0, "usable")]
    plants = [(k + 1, 10.0, 10.0, 5.0) for k in range(N)] + [(N + k + 1, 200.0, 0.0, None) for k in range(N)]
    blobs = [(1, k, 0.5, 0.5, 0.01) for k in range(N)] + [(1, N + k, 0.95, 0.95, 0.01) for k in range(N)]
    row = runs.scout_cells(
        spark.createDataFrame(cells, "cell long, x double, y double, issue string"), spark.createDataFrame(blobs, "cell long, blob long, u double, v double, area_fraction double"),
        spark.createDataFrame(plants, "id long, x double, y double, radius double"), 200.0, 150.0, T.Calibration(1.0, 1.0),
    ).collect()[0]
    assert row["full"] == list(range(1, N + 1)) and row["partial"] == list(range(N + 1, 2 * N + 1))
    assert row["candidates"] == N and len(row["points"]) == N
    assert max(discs_met) <= 2


def _broadcasts(frame):
    return frame._jdf.queryExecution().toString().count("BroadcastHashJoin")


def test_targets_are_not_broadcast(spark, tmp_path):
    """Thirty targets a run are estimated at the size of the few rows that they come from."""
    path = str(tmp_path / "runs")
    spark.range(64).select(F.col("id").alias("run")).write.parquet(path)
    targets = spark.read.parquet(path).select("run", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("target_index")).select("run", "target_index", *[(F.col("target_index") * 40.0).alias(c) for c in "xyz"])
    frames = spark.range(640).select((F.col("id") % 64).alias("run"), F.col("id").alias("seq"), F.col("id").alias("image_id"), *[(F.col("id") % 31 * 40.0 + 1).alias(c) for c in "xyz"], F.when(F.col("id") % 5 == 0, F.col("id") % 31).alias("declared"))
    rows = runs.match_frames(targets, frames)
    assert not _broadcasts(rows)
    assert rows.count() > 0


def test_only_points_that_are_left_see_further_sites(spark, monkeypatch):
    made = []
    candidates = runs.soil_candidates

    def counted(*args, **more):
        found = candidates(*args, **more)
        made.append(found.count())
        return found

    monkeypatch.setattr(runs, "soil_candidates", counted)
    points = [(k, 500.0 + 400 * k, 500.0, dt.datetime(2024, 1, 1)) for k in range(20)]
    discs = [(500.0, 500.0, 60.0)]
    rows = assignment.safe_sites(spark.createDataFrame(points, "id long, x double, y double, updated_at timestamp"), spark.createDataFrame(discs, "x double, y double, radius double"), [], (0.0, 0.0, 9000.0, 1000.0), 12.0, 20.0).collect()
    assert {r["id"]: r["distance_mm"] for r in rows if r["id"]} == {k: 0.0 for k in range(1, 20)}
    assert next(r["distance_mm"] for r in rows if r["id"] == 0) == 106.06601717798213
    assert made[0] == 20 and sum(made) < 250


def test_discs_of_a_frame_are_measured_once(spark, monkeypatch):
    met = spark.sparkContext.accumulator(0)
    share = T._disc_share

    def counted(test):
        first = []

        def met_once(u, v, px, *rest):
            if not first or first[0] == (u, v):
                first[:] = [(u, v)]
                met.add(len(px))
            return test(u, v, px, *rest)

        return share(met_once)

    monkeypatch.setattr(T, "_disc_share", counted)
    rows = spark.createDataFrame([(k, 10.0 * (k % 2), 0.0 if k % 2 else None, None if k % 4 == 1 else 1.0) for k in range(200)], "id long, px double, py double, radius double")
    found = T.visibility(rows, 960, 720, T.Calibration(1.0, 1.0)).select("id", "visible_fraction", F.size("visible_sectors").alias("n")).collect()
    assert sorted(r["id"] for r in found) == list(range(200))
    assert len({(r["visible_fraction"], r["n"]) for r in found if r["id"] % 2}) == 1
    assert 0 < met.value <= 2
