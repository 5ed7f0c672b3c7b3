"""Stereo on made-up soil: known shifts, planes with outliers, steering of the outer pair."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopia.functions import rasters as R
from canopia.functions import stereo as S
from canopia.operators import runs, stereo

FRAMES = "measurement_id long, lateral_mm double, x double, y double, z double, height int, width int, grey binary, usable binary"


def soil(seed, height=160, width=260):
    rng = np.random.default_rng(seed)
    image = rng.random((height, width))
    for axis in (0, 1):
        image = sum(np.roll(image, k, axis) for k in (-1, 0, 1)) / 3
    return (image - image.min()) / (image.max() - image.min()) * 255


def moved(image, dx, dy=0.0):
    """The image with what it shows dx to the right and dy down; dx and dy may vary over the image."""
    height, width = image.shape
    y, x = np.mgrid[:height, :width].astype(float)
    sx, sy = np.clip(x - dx, 0, width - 1.001), np.clip(y - dy, 0, height - 1.001)
    fx, fy = sx.astype(int), sy.astype(int)
    u, v = sx - fx, sy - fy
    return (1 - v) * ((1 - u) * image[fy, fx] + u * image[fy, fx + 1]) + v * ((1 - u) * image[fy + 1, fx] + u * image[fy + 1, fx + 1])


@pytest.mark.parametrize("shift", [7.0, 12.4, 21.75])
def test_known_disparities_within_a_pixel(shift):
    right = soil(int(shift))
    left = moved(right, shift)
    forward, backward = S.matched(left, right, *S.search(260, shift))
    inner = forward[12:-12, 60:-12]
    assert np.median(np.abs(inner - shift)) < 0.3 and (np.abs(inner - shift) < 1).mean() > 0.97
    assert np.median(np.abs(backward[12:-12, 12:-60] - shift)) < 0.3


def test_the_search_range_of_a_pair():
    assert S.search(300, 20.0) == (8, 32) and S.search(300, 2.0) == (0, 16) and S.search(60, 15.0) == (3, 17) or S.search(60, 15.0)[0] >= 0
    with pytest.raises(ValueError):
        S.search(90, 200.0)


@pytest.mark.parametrize("seed", range(3))
def test_planes_with_outliers(seed):
    rng = np.random.default_rng(seed)
    height, width = 120, 150
    y, x = np.mgrid[:height, :width]
    truth = 0.03 * x - 0.02 * y + 14
    disparity = truth + rng.normal(0, 0.3, truth.shape)
    stray = rng.random(truth.shape) < 0.35
    disparity[stray] += rng.uniform(5, 40, stray.sum())
    valid = rng.random(truth.shape) < 0.8
    found = S.plane(disparity, valid)
    assert abs(found["centre"] - (0.03 * width / 2 - 0.02 * height / 2 + 14)) < 0.1
    assert abs(found["support"] - 0.65) < 0.03 and found["mad"] < 0.4
    assert not (found["mask"] & stray).any() and found["mask"].sum() > 0.6 * valid.sum()
    assert S.plane(disparity, valid)["centre"] == found["centre"]
    with pytest.raises(ValueError):
        S.plane(disparity, np.zeros_like(valid))
    with pytest.raises(ValueError):
        S.plane(rng.uniform(0, 5000, truth.shape), valid)


def test_frames_that_move_aslant():
    right = soil(9)
    for dx, dy in ((10.0, 6.0), (-10.0, 3.0), (14.0, 0.0)):
        a, b, seen, shift = S.rectified(moved(right, dx, dy), right)
        assert abs(shift - np.hypot(dx, dy)) < 0.6
        forward, _ = S.matched(a, b, *S.search(260, shift))
        inner = seen & (np.indices(a.shape)[1] > 70)
        inner[:20] = inner[-20:] = False
        inner[:, -20:] = False
        assert abs(np.nanmedian(forward[inner]) - np.hypot(dx, dy)) < 0.6


def frame(k, lateral, image, usable=None, z=300.0):
    return (k, lateral, lateral, 0.0, z, *image.shape, bytearray(np.rint(image).astype(np.uint8).tobytes()), None if usable is None else bytearray(R.pack(usable)))


def test_triplets_feed_soil_heights(spark):
    base = soil(3)
    y, x = np.mgrid[: base.shape[0], : base.shape[1]]
    tilt = 0.01 * (x - 130)
    rows = [frame(1, 15.0 * k, moved(base, 6.0 * k + tilt * k)) for k in range(3)]  # what is seen moves right with the camera's index
    rows += [frame(2, 15.0 * k, soil(30 + k)) for k in range(3)]  # nothing in common
    rows += [frame(3, 15.0 * k, moved(base, 6.0 * k)) for k in range(2)]  # a frame is missing
    rows += [frame(4, 2.0 * k, moved(base, 6.0 * k)) for k in range(3)]  # too close: only the outer pair would do, and it is 4 mm
    rows += [frame(5, 15.0 * k, moved(base, 6.0 * k), np.zeros(base.shape, bool)) for k in range(3)]  # all green
    frames = spark.createDataFrame(rows, FRAMES)
    found = {}
    for r in stereo.estimate_triplets(frames).collect():
        found.setdefault(r.measurement_id, {})[r.pair] = r
    assert found.keys() == {1, 2, 4, 5}
    for pair, r in found[1].items():
        assert r.passes and abs(r.normalised - 6.0 / 15) < 0.03 and abs(r.baseline - (30 if pair == 2 else 15)) < 1e-9, (pair, r)
        assert r.coverage > 0.5 and r.support > 0.9
    assert not any(r.passes for k in (2, 4, 5) for r in found[k].values())
    assert {r.error for r in found[4].values()} == {"the baseline is too small"} and {r.error for r in found[5].values()} == {"not enough clear overlapping soil"}
    heights = runs.soil_heights(stereo.triplets(frames, stereo.estimate_triplets(frames)), 0.01, 0.0, 1.0).where(F.col("measurement_id") == 1).first()
    assert heights.valid and abs(heights.proposed_z - (300 + 1 / (0.01 * 0.4))) < 20


def test_no_frames(spark):
    assert stereo.estimate_triplets(spark.createDataFrame([], FRAMES)).collect() == []
