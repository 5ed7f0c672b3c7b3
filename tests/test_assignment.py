"""Assignments in rounds against the sequential loops."""

from __future__ import annotations

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from canopia.operators import assignment
from canopia.operators import zones as Z


@pytest.mark.parametrize("seed", range(3))
def test_greedy_pairs_and_turns_equal_loops(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(rng.randrange(6), rng.randrange(25), rng.randrange(20)) for _ in range(150)})
    df = spark.createDataFrame(rows, "d int, a int, b int").repartition(3)
    left, right, taken = set(), set(), []
    for d, a, b in rows:
        if a not in left and b not in right:
            taken.append((d, a, b))
            left.add(a)
            right.add(b)
    assert sorted(map(tuple, assignment.greedy_pairs(df, "a", "b", ["d", "a", "b"]).collect())) == taken
    used, turns = set(), []
    for a in range(25):
        free = [(d, b) for d, x, b in rows if x == a and b not in used]
        if free:
            turns.append((min(free)[0], a, min(free)[1]))
            used.add(min(free)[1])
    assert sorted(map(tuple, assignment.in_turn(df, "a", "a", "b", ["d", "b"]).collect())) == sorted(turns)
    assert assignment.greedy_pairs(df.limit(0), "a", "b", ["d"]).collect() == [] == assignment.in_turn(df.limit(0), "a", "a", "b", ["d"]).collect()


def test_a_long_chain_of_turns(spark):
    """Each agent prefers what the one before it takes."""
    rows = [(k, max(0, k - 1), 0) for k in range(8)] + [(k, k, 1) for k in range(8)]
    found = assignment.in_turn(spark.createDataFrame(rows, "a int, b int, r int"), "a", "a", "b", ["r", "b"]).collect()
    assert sorted((r.a, r.b) for r in found) == [(0, 0)] + [(k, k) for k in range(1, 8)]


BED, BASE, MARGIN = (0.0, 0.0, 1400.0, 900.0), 15.0, 40.0
POND = Z.Zone("pond", "exclusion", circle=(900.0, 400.0, 120.0))


def offsets():
    found = [(math.hypot(i * 25, j * 25), i * 25.0, j * 25.0) for i in range(-8, 9) for j in range(-8, 9) if math.hypot(i * 25, j * 25) < 200]
    return sorted(found, key=lambda o: (o[0], abs(o[1]) + abs(o[2])))


def fits(y):
    return (y - BASE >= BED[1] and y + BASE <= BED[3]) or y + 2 * BASE <= BED[3] or y - 2 * BASE >= BED[1]


def room(x, y, obstacles):
    """How far the margin may grow; the pond is a disc."""
    limit = min((math.hypot(x - a, y - b) - r for a, b, r in obstacles), default=10_000.0 + 2 * BASE) - 2 * BASE
    pond = math.hypot(x - 900, y - 400) - 120 - 2 * BASE
    return -1.0 if limit < 0 or pond < 0 else min(limit, pond)


def scene(seed):
    rng = random.Random(seed)
    dates = [None, datetime(2024, 1, 1), datetime(2025, 1, 1)]
    points = [(k, rng.randrange(0, 1400) + 0.0, rng.randrange(0, 900) + 0.0, rng.choice(dates[1:] if k % 7 else dates)) for k in range(60)]
    points += [(100 + k, 300.0 + k % 2, 300.0, dates[1]) for k in range(6)]
    obstacles = [(rng.uniform(0, 1400), rng.uniform(0, 900), rng.uniform(10, 90)) for _ in range(14)]
    return points, obstacles


def frames(spark, points, obstacles):
    return spark.createDataFrame(points, "id long, x double, y double, updated_at timestamp"), spark.createDataFrame(obstacles, "x double, y double, radius double")


def test_safe_sites_equal_the_loop(spark):
    points, obstacles = scene(3)
    options = []
    for k, px, py, at in points:
        if at == datetime(2024, 1, 1):
            for d, dx, dy in offsets():
                x, y = px + dx, py + dy
                gap = min(math.hypot(x - a, y - b) - r for a, b, r in obstacles) - MARGIN - 2 * BASE
                if BED[0] <= x <= BED[2] and BED[1] <= y <= BED[3] and fits(y) and gap >= 0 and math.hypot(x - 900, y - 400) - 120 > MARGIN + 2 * BASE:
                    options.append((d, k, x, y, gap))
    ids, sites, expected = set(), set(), []
    for d, k, x, y, gap in sorted(options):
        if k not in ids and (round(x, 3), round(y, 3)) not in sites:
            ids.add(k)
            sites.add((round(x, 3), round(y, 3)))
            expected.append((k, x, y, round(d, 6), round(gap, 6)))
    found = assignment.safe_sites(*frames(spark, points, obstacles), [POND], BED, BASE, MARGIN, F.lit("2024-06-01").cast("timestamp"))
    assert sorted((r.id, r.site_x, r.site_y, round(r.distance_mm, 6), round(r.clearance_mm, 6)) for r in found.collect()) == sorted(expected)
    assert len(expected) > 20


@pytest.mark.parametrize("deviation", [30.0, 120.0])
def test_measurement_grid_equals_the_loop(spark, deviation):
    points, obstacles = scene(5)
    assigned, used, expected = set(), set(), []
    axis = lambda low, high: [v for v in (100 + 200.0 * k for k in range(20)) if low <= v <= high]
    for gy in axis(BED[1], BED[3]):
        for gx in axis(BED[0], BED[2]):
            near = min(((math.hypot(px - gx, py - gy), k, px, py, at) for k, px, py, at in points if k not in assigned), default=None, key=lambda p: p[:2])
            if near is None or near[0] >= 200:
                expected.append((gx, gy, None, None, None, "skipped", "no point", None))
                continue
            _, k, px, py, at = near
            assigned.add(k)
            if at is None or at >= datetime(2024, 6, 1):
                expected.append((gx, gy, k, None, None, "skipped", "no date" if at is None else "recent", None))
                continue
            seen = []
            for d, dx, dy in offsets():
                x, y = gx + dx, gy + dy
                if BED[0] <= x <= BED[2] and BED[1] <= y <= BED[3] and fits(y) and math.hypot(x - px, y - py) < 200:
                    seen.append((d, abs(dx) + abs(dy), x, y, room(x, y, obstacles)))
            seen.sort()
            free = [s for s in seen if s[4] + 1e-6 >= MARGIN and s[2:4] not in used]
            good = [s for s in free if s[0] <= deviation + 1e-6]
            if good:
                used.add(good[0][2:4])
                expected.append((gx, gy, k, *good[0][2:4], "clear" if good[0][0] < 0.001 else "replaced", None, None))
            elif free:
                expected.append((gx, gy, k, None, None, "skipped", "deviation", math.ceil(free[0][0])))
            else:
                best = max((s[4] for s in seen if s[0] <= deviation + 1e-6 and s[4] >= 0), default=-1)
                expected.append((gx, gy, k, None, None, "skipped", "margin" if best >= 0 else "blocked", math.floor(best) if best >= 0 else None))
    found = assignment.measurement_grid(*frames(spark, points, obstacles), [POND], BED, 200.0, deviation, BASE, MARGIN, F.lit("2024-06-01").cast("timestamp")).collect()
    show = lambda rows: sorted(rows, key=str)
    got = [(r.grid_x, r.grid_y, r.point_id, r.site_x, r.site_y, r.status, r.reason, r.hint_mm) for r in found]
    assert show(got) == show(expected)
    assert {x[5] for x in expected} >= {"skipped", "replaced"}


def test_bad_settings(spark):
    points, obstacles = frames(spark, [], [])
    for bad in ((10.0, 30.0, 15.0, 1.0), (100.0, 200.0, 15.0, 1.0), (100.0, 30.0, 0.0, 1.0)):
        with pytest.raises(ValueError):
            assignment.measurement_grid(points, obstacles, [], BED, *bad)
    rows = assignment.measurement_grid(points, obstacles, [], BED, 500.0, 30.0, 15.0, 1.0).collect()
    assert {r.reason for r in rows} == {"no point"} and len(rows) == 6
