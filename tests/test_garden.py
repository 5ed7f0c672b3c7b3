import math
import random

import pytest
from conftest import same_rows

from canopia.operators import curves, evidence, planning, verifier, zones
from canopia.plans import learning, registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    same_rows(registry.QUERIES[name](spark, sf_dir), duck.execute(registry.ORACLES[name]).df())


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def _greedy(views):
    """Brute force: the choice of evidence of one plant, as sets."""
    newest = max(v["image_timestamp"] for v in views)
    useful = [v for v in views if (newest - v["image_timestamp"]).total_seconds() <= 6 * 3600 and v["has_evidence"] and v["segmentation_quality"] >= 0.12]

    def q(v):
        return v["confidence"] * math.sqrt(max(0.05, v["image_quality"]) * max(0.05, v["segmentation_quality"]))

    def area(v):
        return {(v["first_sector"] + k) % 72 for k in range(round(v["coverage"] * 72))}

    rank = lambda v: (q(v), v["image_timestamp"], -v["measurement_id"])
    whole = [v for v in useful if v["center_visible"] and not v["truncated"] and v["coverage"] >= 0.98]
    if whole:
        return "single_complete", [max(whole, key=rank)["measurement_id"]]
    if not useful:
        return "no_evidence", []
    centre = [v for v in useful if v["center_visible"]]
    if not centre:
        return "no_center", []
    fits = all(v["fits"] for v in useful)
    used = [max(centre, key=rank)]
    seen = area(used[0])
    while len(used) < len(useful) and (len(seen) < 36 or not fits):
        best = max((v for v in useful if v not in used), key=lambda v: (len(area(v) - seen), *rank(v)))
        if fits and not area(best) - seen:
            break
        used.append(best)
        seen |= area(best)
    return ("large_composite" if not fits else "partial_composite" if len(seen) >= 36 else "insufficient_partial"), [v["measurement_id"] for v in used]


@pytest.mark.parametrize("hours", [1, 40])
def test_evidence_equals_brute_force(spark, sf_dir, hours):
    """Time is squeezed so that the window holds few, then many views."""
    from canopia.sources.tables import view

    rows = view(spark, sf_dir, "sightings").selectExpr("* except (image_timestamp)", f"timestamp_seconds(cast(measurement_id * 3600 * 6 / {hours} as bigint)) as image_timestamp")
    rows = rows.selectExpr("* except (plant_id)", "measurement_id % 60 as plant_id")
    plants = {}
    for r in rows.toPandas().to_dict("records"):
        plants.setdefault(r["plant_id"], []).append(r)
    found = {r["plant_id"]: (r["mode"], list(r["used"])) for r in evidence.select_evidence(rows).collect()}
    assert found == {p: _greedy(v) for p, v in plants.items()}


def test_axis_groups_equal_a_fold(spark):
    values = [(k % 2, float((k * 37) % 400)) for k in range(60)] + [(0, 5.0), (0, 5.0)]
    want = {}
    for key in (0, 1):
        groups = []
        for v in sorted(v for k, v in values if k == key):
            if not groups or abs(v - sum(groups[-1]) / len(groups[-1])) > 25:
                groups.append([])
            groups[-1].append(v)
        want[key] = sorted((round(sum(g) / len(g), 6), len(g)) for g in groups)
    found = planning.axis_groups(spark.createDataFrame(values, "k int, v double"), "k", "v").collect()
    assert {k: sorted((round(r["position"], 6), r["members"]) for r in found if r["k"] == k) for k in (0, 1)} == want


def test_isotonic_of_known_values(spark):
    rows = [(1, 0, 20.0, 1), (1, 3, 18.0, 1), (1, 6, 30.0, 1), (1, 9, 28.0, 3)]
    fit = curves.isotonic(spark.createDataFrame(rows, "k int, d int, v double, n int"), "k", "d", "v", "n").orderBy("d").collect()
    assert [round(r["fitted"], 6) for r in fit] == [19.0, 19.0, 28.5, 28.5]


def test_verifier_learns_and_refuses(spark):
    rows = [(i, i % 2, i // 4, float(i % 2) + (i * 7 % 10) / 20, None if i % 9 == 0 else 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, y int, image int, a double, b double")
    scored = verifier.held_out_scores(df, "y", "image", ["a", "b"])
    held = scored.where("held_out").collect()
    assert held and sum((r["score"] >= 0.5) == (r["y"] == 1) for r in held) / len(held) > 0.9
    assert scored.count() == 200
    assert verifier.held_out_scores(df.where("y = 1"), "y", "image", ["a"]).count() == 0


def test_ml5_scores_every_sample(spark, sf_dir):
    rows = learning.PLANS["ml5"][0](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/labels.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_tracks_equal_a_fold(spark, sf_dir):
    tracks, want = {}, set()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").collect()
    for e in events:
        x, y, own = e.event_id * 211 % 3000, e.event_id * 131 % 1500, tracks.setdefault(e.user_id, [])
        near = [t for t in own if (e.ts - t["seen"]).total_seconds() <= 240 * 3600 and math.dist((x, y), t["at"]) <= 150]
        if near:
            track = min(near, key=lambda t: math.dist((x, y), t["at"]))
            if track["image"] != e.event_id % 211:
                n = track["n"]
                track.update(at=((track["at"][0] * n + x) / (n + 1), (track["at"][1] * n + y) / (n + 1)), n=n + 1, seen=e.ts, image=e.event_id % 211)
        else:
            track = {"id": e.event_id, "at": (x, y), "n": 1, "seen": e.ts, "image": e.event_id % 211}
            own.append(track)
        want.add((e.event_id, track["id"], track["n"], round(track["at"][0], 6)))
    found = registry.QUERIES["str5"](spark, sf_dir).collect()
    assert {(r.detection_id, r.track, r.observations, round(r.x, 6)) for r in found} == want
    assert len(found) == len(events)
    assert max(n for _, _, n, _ in want) > 1


def test_zone_settings_are_checked():
    with pytest.raises(ValueError):
        zones.Zone("line", "exclusion", points=((0, 0), (1, 1)))
    with pytest.raises(ValueError):
        zones.Zone("x", "area", circle=(0, 0, 1))
    assert zones.rectangle("r", "boundary", 5, 6, 1, 2).points[0] == (1, 2)


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for table in ("part", "supplier", "customer", "events", "orders", "lineitem", "labels", "documents"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(f"{folder}/{table}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_of_empty_tables(spark, empty_dir, name):
    registry.QUERIES[name](spark, empty_dir).collect()


def test_clear_margins_by_hand(spark):
    from canopia.operators import geometry

    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0), (3, 105.0, 0.0), (4, 2500.0, 0.0)], "id int, x double, y double")
    plants = spark.createDataFrame([(100.0, 0.0, 30.0), (1900.0, 0.0, 400.0)], "x double, y double, radius double")
    found = lambda *z: {r.id: round(r.margin_mm, 2) for r in geometry.clearance(places, *z).collect()}
    assert found(plants, 10.0) == {1: 50.0, 2: 480.0, 3: -1.0, 4: 180.0}
    assert set(found(plants.limit(0), 10.0).values()) == {10_000.0}
    pond = zones.Zone("pond", "exclusion", circle=(1000.0, 300.0, 100.0))
    assert found(plants, 10.0, [pond]) == {1: 50.0, 2: 180.0, 3: -1.0, 4: 180.0}


def test_clear_margins_beyond_the_first_reach(spark):
    from canopia.operators import geometry

    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 200_000.0, 0.0)], "id int, x double, y double")
    found = lambda rows: {r.id: round(r.margin_mm, 2) for r in geometry.clearance(places, spark.createDataFrame(rows, "x double, y double, radius double"), 50.0).collect()}
    assert found([(0.0, 5000.0, 100.0)]) == {1: 4800.0, 2: 199_862.49}
    assert found([(0.0, 4100.0, 500.0), (3900.0, 0.0, 10.0)]) == {1: 3500.0, 2: 195_990.0}
    rng = random.Random(4)
    rows = [(rng.uniform(-9e4, 9e4), rng.uniform(-9e4, 9e4), rng.choice((1.0, 300.0, 20_000.0))) for _ in range(60)]
    expected = {k: round(min(math.hypot(px - x, y) - r for x, y, r in rows) - 100, 2) for k, px in ((1, 0.0), (2, 200_000.0))}
    assert found(rows) == {k: v if v >= 0 else -1.0 for k, v in expected.items()}


def test_detections_that_stand_for_a_place(spark):
    """A created one for a day, a judged one for its own image only, whatever lies nearer."""
    from canopia.operators import geometry

    at = "timestamp_seconds({0} * 3600)"
    points = spark.createDataFrame([(1, 0.0, 0.0, 7, 30), (2, 500.0, 0.0, 7, 30), (3, 900.0, 0.0, 8, 30)], "id int, x double, y double, image_id int, h int")
    seen = spark.createDataFrame([("created", 5.0, 0.0, 1, 6, 1.0), ("created", 505.0, 0.0, 1, 5, 1.0), ("rejected", 900.0, 40.0, 7, 30, 30.0), ("dismissed", 900.0, 40.0, 8, 30, 30.0)], "status string, x double, y double, image_id int, h int, radius_mm double")
    points, seen = (f.withColumn("image_timestamp", __import__("pyspark").sql.functions.expr(at.format("h"))).drop("h") for f in (points, seen))
    near = lambda *s: {r.id for r in geometry.near_detection(points, seen, *s).collect()}
    assert near(("created",), ("rejected", "dismissed")) == {1, 3} and near(("recommended", "created"), ("rejected",)) == {1}


def test_reasons_agree_with_the_choice_of_evidence(spark, sf_dir):
    from canopia.operators import lookups
    from canopia.sources.tables import view

    rows = view(spark, sf_dir, "sightings").selectExpr("* except (plant_id)", "measurement_id % 60 as plant_id")
    views = {r["measurement_id"]: r for r in rows.toPandas().to_dict("records")}
    plants = {}
    for v in views.values():
        plants.setdefault(v["plant_id"], []).append(v)
    used = {m for v in plants.values() for m in _greedy(v)[1]}
    found = lookups.evidence_reasons(rows).collect()
    assert len(found) == len(views) and {r.measurement_id for r in found if r.used} == used
    for r in found:
        v = views[r.measurement_id]
        old = (max(x["image_timestamp"] for x in plants[v["plant_id"]]) - v["image_timestamp"]).total_seconds() > 6 * 3600
        want = "outside window" if old else "no evidence" if not v["has_evidence"] else "low quality" if v["segmentation_quality"] < 0.12 else "not needed"
        assert r.reason == (None if r.used else want)
