"""Mask fusion against plain loops, and shifts that were planted."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from canopia.functions import rasters as R
from canopia.operators import fusion

SCHEMA = "plant_id long, measurement_id long, image_timestamp timestamp, height int, width int, mask binary, to_mm array<double>, scale double, confidence double, current_mm double, margin_mm double, age_days int, accepted_mm double"
NOW = datetime(2024, 5, 1)


def disc(h, w, cy, cx, r):
    y, x = np.mgrid[:h, :w]
    return (y - cy) ** 2 + (x - cx) ** 2 <= r * r


def loop(mask, to_mm, min_x, min_y, ppm, columns, rows, edge_px, confidence):
    """One cell at a time: {(y, x): (seen, evidence)}."""
    a, b, c, d, e, f = to_mm
    det = a * e - b * d
    h, w = mask.shape

    def value(y, x):
        if not (0 <= x < w and 0 <= y < h and mask[y, x]):
            return 0.0
        border = min(x, y, w - 1 - x, h - 1 - y)
        return confidence * (1.0 if edge_px <= 0 else min(1.0, max(0.2, border / max(1.0, edge_px))))

    out = {}
    for cy in range(rows):
        for cx in range(columns):
            mx, my = cx / ppm + min_x - c, cy / ppm + min_y - f
            sx, sy = (e * mx - b * my) / det, (a * my - d * mx) / det
            nx, ny = round(sx), round(sy)
            seen = 0 <= nx < w and 0 <= ny < h and bool(mask[ny, nx])
            fx, fy = math.floor(sx), math.floor(sy)
            u, v = sx - fx, sy - fy
            found = (1 - v) * ((1 - u) * value(fy, fx) + u * value(fy, fx + 1)) + v * ((1 - u) * value(fy + 1, fx) + u * value(fy + 1, fx + 1))
            if seen or found > 0:
                out[cy, cx] = (seen, found)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_warp_equals_a_loop(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((23, 31)) < 0.3
    angle, size = rng.uniform(0, 6), rng.uniform(0.7, 3)
    to_mm = [size * math.cos(angle), -size * math.sin(angle), rng.uniform(-40, 0), size * math.sin(angle), size * math.cos(angle), rng.uniform(-40, 0)]
    y, x, seen, found = fusion.warp(mask, fusion.to_canvas(to_mm, -60.0, -60.0, 0.8), 90, 80, 4.5, 0.9)
    expected = loop(mask, to_mm, -60.0, -60.0, 0.8, 90, 80, 4.5, 0.9)
    got = {(a, b): (bool(s), f) for a, b, s, f in zip(y.tolist(), x.tolist(), seen, found, strict=True)}
    both = got.keys() & expected.keys()
    # a cell whose evidence is rounding alone may be on either side
    assert all((got.get(k) or expected.get(k))[1] < 1e-9 for k in got.keys() ^ expected.keys())
    assert all(got[k][0] == expected[k][0] and abs(got[k][1] - expected[k][1]) < 1e-9 for k in both) and len(both) > 200


def view(plant, k, mask, shift=(0.0, 0.0), confidence=0.9, hours=0.0, current=40.0, age=60, accepted=40.0):
    h, w = mask.shape
    to_mm = [1.0, 0.0, shift[0] - w / 2, 0.0, 1.0, shift[1] - h / 2]
    return (plant, k, NOW - timedelta(hours=hours), h, w, bytearray(R.pack(mask)), to_mm, 1.0, confidence, current, 20.0, age, accepted)


def test_views_count_by_votes_strength_and_age(spark):
    both, left, right = disc(120, 120, 60, 60, 20), disc(120, 120, 60, 20, 12), disc(120, 120, 60, 100, 12)
    rows = [
        view(1, 1, both | left, confidence=0.7), view(1, 2, both, confidence=0.7), view(1, 3, right, confidence=0.95), view(1, 4, disc(120, 120, 20, 60, 9), confidence=0.2), view(1, 5, disc(120, 120, 100, 60, 9), hours=7.0),
        view(2, 6, both, confidence=0.4), view(3, 7, np.zeros((120, 120), bool)),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    cells = {}
    for r in fusion.fused_cells(fusion.canvases(df)).collect():
        cells.setdefault(r.plant_id, {})[r.cy, r.cx] = r.support
    assert cells.keys() == {1, 2}
    # the disc at the left is one weak view's, the one at the right a sure one's, both but for the border
    one = np.zeros((120, 120), int)
    for (y, x), n in cells[1].items():
        one[y, x] = n
    assert (one[both] == 2).all() and not one[left & ~both].any() and (one[right & disc(120, 120, 60, 60, 41)] == 1).all()
    assert not one[15:25, 55:65].any() and not one[95:105, 55:65].any()
    # one view alone needs the least confidence only
    assert all(cells[2][y, x] == 1 for y, x in zip(*np.nonzero(disc(120, 120, 60, 60, 19)), strict=True))


def test_fused_edges_and_held_growth(spark):
    h = w = 200
    leaf = disc(h, w, 100, 100, 50)
    speck = np.zeros((h, w), bool)
    speck[10, 10] = speck[10:12, 30:32] = True
    rows = [view(1, 1, (leaf & (np.mgrid[:h, :w][1] < 140)) | speck, current=68.0), view(1, 2, (leaf & (np.mgrid[:h, :w][1] > 60)) | speck, current=68.0)]
    rows += [view(2, 3, disc(h, w, 100, 100, 30), current=30.0, age=5), view(2, 4, disc(h, w, 100, 100, 30), current=30.0, age=5)]
    rows += [view(3, 5, disc(h, w, 100, 100, 6), current=20.0), view(3, 6, disc(h, w, 100, 100, 6), current=20.0)]
    found = {r.plant_id: r for r in fusion.fuse(spark.createDataFrame(rows, SCHEMA)).collect()}
    one = found[1]
    assert abs(one.outer_mm - 50) < 1.5 and abs(one.typical_mm - 50 * math.sqrt(0.9)) < 1.5 and one.views == 2
    assert abs(one.area_mm2 - leaf.sum()) < 0.03 * leaf.sum() and one.coverage == 1.0 and one.held is None
    share = (leaf & (np.mgrid[:h, :w][1] < 140) & (np.mgrid[:h, :w][1] > 60)).sum() / leaf.sum()
    assert abs(one.corroborated - share) < 0.03
    assert abs(one.confidence - min(0.99, 0.9 * 0.75 + 0.2 + 0.02 + 0.05)) < 1e-9
    assert found[2].held == "age" and found[2].recommended_mm == 30.0
    assert found[3].held == "area" and found[3].recommended_mm == 20.0


def test_nothing_to_fuse(spark):
    assert fusion.fuse(spark.createDataFrame([], SCHEMA)).collect() == []
    assert fusion.fuse(spark.createDataFrame([view(1, 1, np.zeros((9, 9), bool))], SCHEMA)).collect() == []


def test_planted_shifts(spark):
    rng = np.random.default_rng(4)
    plain = rng.random((90, 120)) < 0.08
    pairs = [(1, np.roll(plain, (6, -11), (0, 1))), (2, rng.random((90, 120)) < 0.08), (3, np.roll(plain, (44, 0), (0, 1))), (4, None)]
    rows = [(k, 90, 120, bytearray(R.pack(plain)), None if m is None else bytearray(R.pack(m))) for k, m in pairs]
    found = {r.pair_id: r for r in fusion.registered(spark.createDataFrame(rows, "pair_id long, height int, width int, before binary, after binary")).collect()}
    assert abs(found[1].dx + 11) < 0.2 and abs(found[1].dy - 6) < 0.2 and found[1].response > 0.8
    assert (found[3].dx, found[3].dy, found[4].response) == (0.0, 0.0, 0.0) and found[2].response < 0.3


def test_cells_half_way_equal_decimals():
    """Moves of 7.3 and 5.1 mm at 0.4 pixels a millimetre and a turn of 0.3: products are exact decimals, divided once."""
    from fractions import Fraction as Q

    cx, cy = np.meshgrid(np.arange(90), np.arange(70))
    size, ties = Q(10144, 10000), 0
    for k in range(3):
        sx, sy = fusion.from_canvas(fusion.to_canvas([2.5, 0.3, k * 7.3 - 80, -0.3, 2.5, k * 5.1 - 60], -80.0, -60.0 - 0.3 * 64, 0.4), cx, cy)
        for x, y, fx, fy in zip(cx.flat, cy.flat, sx.flat, sy.flat, strict=True):
            ax, ay = int(x) - k * Q(292, 100), int(y) - k * Q(204, 100) - Q(768, 100)
            for exact, found in ((ax - ay * Q(12, 100), fx), (ax * Q(12, 100) + ay, fy)):
                ties += exact / size % 1 == Q(1, 2)
                assert found == float(exact) / float(size)
    assert ties > 2
