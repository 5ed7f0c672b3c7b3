"""Judgements of a plant against a plain loop and by hand."""

import datetime as dt
import math

import __spark_entry__
import duckdb
import pytest
from conftest import same_rows

from canopia.operators import evidence

AT = dt.datetime(2024, 1, 1)
BASE = {"image_id": 1, "current_radius_mm": 50.0, "recommended_mm": 60.0, "confidence": 0.8, "visible_fraction": 0.5, "vegetation_absent": False, "has_evidence": True, "center_visible": True,
        "truncated": True, "fits": False, "coverage": 0.5, "image_quality": 1.0, "segmentation_quality": 1.0, "first_sector": 0, "fused_mm": None, "fused_confidence": None, "fusion_reliable": None}
TYPES = "measurement_id bigint, plant_id bigint, image_timestamp timestamp, image_id bigint, current_radius_mm double, recommended_mm double, confidence double, visible_fraction double, vegetation_absent boolean, has_evidence boolean, center_visible boolean, truncated boolean, fits boolean, coverage double, image_quality double, segmentation_quality double, first_sector int, fused_mm double, fused_confidence double, fusion_reliable boolean"


def _views(spark, rows):
    names = [t.split()[0] for t in TYPES.split(", ")]
    full = [{**BASE, "measurement_id": k, "image_timestamp": AT + dt.timedelta(minutes=k), **r} for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], TYPES)


def _judge(spark, *rows):
    return {r.plant_id: r for r in evidence.consolidate(_views(spark, rows)).collect()}


def test_weighted_median_and_bonus_over_chosen_views(spark):
    found = _judge(spark, *[{"plant_id": 1, "recommended_mm": v, "confidence": c} for v, c in ((50.0, 0.5), (70.0, 0.9), (400.0, 0.3))])[1]
    w = [0.5 * 0.5, 0.9 * 0.5, 0.3 * 0.5]
    # recency counts from the first chosen view (of 0.9): the view a minute older loses next to nothing
    mean = sum(c * x for c, x in zip((0.5, 0.9, 0.3), w, strict=True)) / sum(w)
    assert found.radius_mm == 70.0 and found.used == 3 and found.views == 3 and found.measurement_id == 1
    assert math.isclose(found.confidence, mean + 0.04, abs_tol=1e-4)


def test_plants_without_evidence(spark):
    none = {"has_evidence": False}
    found = _judge(
        spark,
        {"plant_id": 1, **none, "confidence": 0.9}, {"plant_id": 1, **none, "confidence": 0.0, "recommended_mm": 33.0},
        {"plant_id": 2, **none, "vegetation_absent": True}, {"plant_id": 2, **none, "vegetation_absent": True, "confidence": 0.4},
        {"plant_id": 3, **none, "vegetation_absent": True, "center_visible": False},
    )
    assert (found[1].uncertain, found[1].confidence, found[1].radius_mm, found[1].absent) == (True, 0.05, 33.0, False)
    assert (found[2].uncertain, found[2].radius_mm, found[2].absent, found[2].used, found[2].measurement_id) == (False, 0.0, True, 0, 3)
    assert (found[3].uncertain, found[3].absent, found[3].confidence) == (True, False, 0.2)


def test_fused_edges_override(spark):
    whole = {"coverage": 1.0, "truncated": False}
    edge = {"fused_mm": 81.0, "fused_confidence": 0.7}
    found = _judge(
        spark,
        {"plant_id": 1, **whole}, {"plant_id": 1, **edge, "fusion_reliable": True},  # one view: another row's reliable edge
        {"plant_id": 2, **whole}, {"plant_id": 2, **edge, "fusion_reliable": False},
        {"plant_id": 3}, {"plant_id": 3, **edge, "fusion_reliable": False},  # several: unreliable ones too, then uncertain
    )
    assert [(found[k].radius_mm, found[k].confidence, found[k].uncertain) for k in (1, 2, 3)] == [(81.0, 0.7, False), (60.0, 0.8, False), (81.0, 0.7, True)]


@pytest.mark.parametrize("name", ["sel1", "sel3", "q8", "q32"])
def test_plants_are_not_groups_of_their_own(spark, sf_dir, name):
    """A group in pandas costs milliseconds a plant; views are folded over partitions instead."""
    plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_views_of_unknown_fit_or_place(spark):
    """As in SQL: an unknown fit does not count, and a view of unknown place covers nothing."""
    rows = [
        {"plant_id": 1, "fits": True, "coverage": 0.25}, {"plant_id": 1, "fits": None, "coverage": 0.5, "confidence": 0.7}, {"plant_id": 1, "fits": True, "coverage": 0.25, "confidence": 0.6},
        {"plant_id": 2, "fits": True, "coverage": 0.25}, {"plant_id": 2, "fits": True, "coverage": 0.9, "confidence": 0.7, "first_sector": None},
    ]
    found = {r.plant_id: (r.mode, list(r.used), r.covered) for r in evidence.select_evidence(_views(spark, rows)).collect()}
    assert found == {1: ("partial_composite", [0, 1], 36), 2: ("insufficient_partial", [3], 18)}


@pytest.mark.parametrize("name", ["agg1", "q8", "q32"])
def test_rows_without_a_plant_equal_sql(spark, duck, tmp_path, name):
    duck.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS user_id) FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    same_rows(__spark_entry__.queries()[name](spark, str(tmp_path)), con.execute(__spark_entry__.oracle_sql()[name]).df())
