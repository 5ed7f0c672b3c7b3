"""Photo quality: each issue planted, figures against plain loops."""

from __future__ import annotations

import math

import numpy as np

from canopia.functions import rasters as R
from canopia.operators import inspection

SCHEMA = "image_id long, height int, width int, bgr binary"
LEAF, SOIL = (20, 210, 30), (60, 80, 100)


def frame(k, image):
    return (k, *image.shape[:2], bytearray(np.clip(image, 0, 255).astype(np.uint8).tobytes()))


def disc(h, w, cy, cx, r):
    y, x = np.mgrid[:h, :w]
    return (y - cy) ** 2 + (x - cx) ** 2 <= r * r


def ground(seed, h=240, w=320, noise=25):
    rng = np.random.default_rng(seed)
    return np.full((h, w, 3), SOIL) + rng.integers(-noise, noise + 1, (h, w, 1))


def test_issues(spark):
    washed = np.full((240, 320, 3), 250) - np.random.default_rng(1).integers(0, 9, (240, 320, 1))
    leaf = ground(2)
    leaf[:, :200] = LEAF
    beside = leaf.copy()
    beside[disc(240, 320, 120, 270, 40)] = LEAF  # another plant: the leaf does not dominate
    thin = ground(3)
    thin[100:112] = LEAF  # meets two sides, but is thin
    ramp = np.repeat(np.linspace(40, 200, 320)[None, :, None], 240, axis=0).repeat(3, axis=2)  # contrast without an edge
    many = ground(4)
    for k in range(30):
        many[disc(240, 320, 20 + 40 * (k // 6), 25 + 52 * (k % 6), 8 + k % 3)] = LEAF
    rows = [frame(1, washed), frame(2, leaf), frame(3, beside), frame(4, thin), frame(5, ramp), frame(6, many), frame(7, ground(5)), frame(8, ground(6, 60, 60)), frame(9, np.repeat(np.repeat(ground(7, 480, 640), 2, 0), 2, 1))]
    found = {r.image_id: r for r in inspection.inspected(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: r.issue for k, r in found.items()} == {1: "washed_out", 2: "leaf_obstruction", 3: "usable", 4: "usable", 5: "blurry", 6: "usable", 7: "usable", 8: "usable", 9: "usable"}
    assert len(found[6].blobs) == inspection.MOST_BLOBS and [b.area_fraction for b in found[6].blobs] == sorted((b.area_fraction for b in found[6].blobs), reverse=True)
    assert not any(b.touches_edge for b in found[6].blobs) and found[4].blobs[0].touches_edge
    assert abs(found[2].vegetation - 200 / 320) < 0.02 and found[2].obstruction > 0.9 and found[2].clear == 0
    assert abs(found[4].blobs[0].v - 105.5 / 240) < 0.01 and found[4].clear > 0.04
    assert found[8].laplacian == 0 == found[8].washed_out and found[8].blobs == []
    assert found[5].blur > 0.9 and found[7].sharpness == 1.0 and 0.05 <= found[1].image_quality < found[7].image_quality


def test_figures_equal_a_loop():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (14, 19, 3))
    values, _ = inspection.measured(image.astype(np.uint8))
    got = dict(zip(inspection.FIGURES, values, strict=True))
    light = [[int((1868 * b + 9617 * g + 4899 * r + 8192) >> 14) for b, g, r in row] for row in image.tolist()]
    h, w = 14, 19
    at = lambda y, x: light[-y if y < 0 else 2 * h - 2 - y if y >= h else y][-x if x < 0 else 2 * w - 2 - x if x >= w else x]
    bend, strong = [], 0
    for y in range(h):
        for x in range(w):
            bend.append(at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x))
            gx = sum(f * (at(y + d, x + 1) - at(y + d, x - 1)) for d, f in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(f * (at(y + 1, x + d) - at(y - 1, x + d)) for d, f in ((-1, 1), (0, 2), (1, 1)))
            strong += math.hypot(gx, gy) >= 100
    assert math.isclose(got["laplacian"], np.var(bend)) and math.isclose(got["edges"], strong / (h * w)) and math.isclose(got["contrast"], np.std(light) / 255)
    assert math.isclose(got["highlight"], ((image.max(axis=2) >= 235) & (R.hsv(image)[1] <= 85)).mean(), abs_tol=1e-12)


def test_no_photographs(spark):
    assert inspection.inspected(spark.createDataFrame([], SCHEMA)).collect() == []
