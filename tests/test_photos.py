"""Photographs: decoding, masks, islands and ownership against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopia.functions import rasters as R
from canopia.operators import ownership, photos


def window(mask, y, x, kernel):
    h, w = mask.shape
    for dy, half in kernel:
        if 0 <= y + dy < h:
            for xx in range(max(0, x - half), min(w, x + half + 1)):
                yield mask[y + dy, xx]


def loop(mask, kernel, f):
    return np.array([[f(window(mask, y, x, kernel)) for x in range(mask.shape[1])] for y in range(mask.shape[0])], bool)


def flood(mask):
    labels, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not labels[y, x]:
            n += 1
            labels[y, x], todo = n, [(y, x)]
            while todo:
                a, b = todo.pop()
                for p in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                    for q in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                        if mask[p, q] and not labels[p, q]:
                            labels[p, q] = n
                            todo.append((p, q))
    return labels, n


@pytest.mark.parametrize("seed", range(6))
def test_neighbourhoods_and_components_equal_loops(seed):
    rng = np.random.default_rng(seed)
    for h, w in rng.integers(1, 22, (8, 2)):
        mask = rng.random((h, w)) < rng.random()
        for kernel in (R.square(3), R.square(5), R.disc(1), R.disc(4)):
            assert (R.dilate(mask, kernel) == loop(mask, kernel, any)).all()
            assert (R.erode(mask, kernel) == loop(mask, kernel, all)).all()
        labels, n = R.components(mask)
        expected, m = flood(mask)
        assert n == m and (labels == expected).all()
        assert (R.unpack(R.pack(mask), h, w) == mask).all()
        for k, (x0, y0, x1, y1, area) in enumerate(R.boxes(labels, n).tolist(), 1):
            y, x = np.nonzero(expected == k)
            assert (x0, y0, x1, y1, area) == (x.min(), y.min(), x.max() + 1, y.max() + 1, len(x))


def test_components_of_spirals_and_combs():
    spiral = np.zeros((31, 31), bool)
    y = x = 0
    for length, (dy, dx) in zip([30, 30, 30, 28, 28, 26, 26, 24, 24], [(0, 1), (1, 0), (0, -1), (-1, 0)] * 3, strict=False):
        for _ in range(length):
            spiral[y, x] = True
            y, x = y + dy, x + dx
    comb = np.zeros((20, 41), bool)
    comb[:, ::2] = True
    comb[-1] = True
    for mask, n in ((spiral, 1), (comb, 1), (comb[:-1], 21)):
        assert R.components(mask)[1] == n == flood(mask)[1]


def test_otsu_and_colours_equal_loops():
    rng = np.random.default_rng(5)
    for values in (rng.integers(0, 256, 500), np.concatenate((rng.integers(0, 20, 300), rng.integers(150, 255, 90))), np.full(9, 7), np.zeros(4, int)):
        best, at = 0.0, 0
        for t in range(256):
            low, high = values[values <= t], values[values > t]
            if len(low) and len(high):
                v = len(low) * len(high) * (low.mean() - high.mean()) ** 2
                if v > best * (1 + 1e-12):
                    best, at = v, t
        assert R.otsu(values) == at
    hue, saturation, value = R.hsv(np.array([[[0, 255, 0], [255, 0, 0], [0, 0, 255], [9, 9, 9], [0, 128, 255], [20, 210, 30]]], np.uint8))
    assert hue.tolist() == [[60, 120, 0, 0, 15, 58]]
    assert saturation.tolist() == [[255, 255, 255, 0, 255, 231]] and value.tolist() == [[255, 255, 255, 9, 255, 210]]


def test_phase_correlation_finds_planted_shifts():
    rng = np.random.default_rng(2)
    plain = rng.random((96, 128)) < 0.1
    for dy, dx in ((0, 0), (7, -12), (-30, 5)):
        x, y, response = R.shift_between(plain, np.roll(plain, (dy, dx), (0, 1)))
        assert abs(x - dx) < 0.3 and abs(y - dy) < 0.3 and response > 0.9
    assert R.shift_between(plain, rng.random((96, 128)) < 0.1)[2] < 0.2
    assert R.shift_between(np.zeros((4, 4)), np.zeros((4, 4))) == (0.0, 0.0, 0.0)


def images(spark, arrays, ppm=1.0):
    rows = [(k, *a.shape[:2], bytearray(a.astype(np.uint8).tobytes()), ppm, ppm, 0.0) for k, a in enumerate(arrays)]
    return photos.scaled(spark.createDataFrame(rows, "image_id long, height int, width int, bgr binary, ppm_x double, ppm_y double, rotation double"))


def disc(h, w, cy, cx, r):
    y, x = np.mgrid[:h, :w]
    return (y - cy) ** 2 + (x - cx) ** 2 <= r * r


def test_vegetation_finds_discs_and_recovers_pale_leaves(spark):
    soil = np.full((120, 160, 3), (60, 70, 90))
    image = soil.copy()
    image[disc(120, 160, 40, 50, 20)] = (20, 210, 30)
    image[disc(120, 160, 40, 78, 6)] = (188, 198, 190)  # pale, beside the leaf
    image[disc(120, 160, 100, 140, 8)] = (188, 198, 190)  # pale, far from any
    found = photos.vegetation(images(spark, [image, soil])).orderBy("image_id").collect()
    strong, pale, mask = (R.unpack(found[0][c], 120, 160) for c in ("strong", "pale", "mask"))
    assert (strong == disc(120, 160, 40, 50, 20)).all()
    assert (pale == disc(120, 160, 40, 78, 6)).all()
    assert mask[40, 50] and mask[40, 78] and not mask[100, 140]
    assert not R.unpack(found[1].mask, 120, 160).any()


def test_thresholds_follow_the_scale(spark):
    rows = images(spark, [np.zeros((4, 4, 3))], 2.5).first()
    assert (rows.min_area, rows.max_area, rows.line_area, rows.open_kernel, rows.close_kernel, rows.pale_reach) == (75, 1_250_000, 1500, 9, 13, 25)
    bare = images(spark, [np.zeros((480, 640, 3))], None).first()
    assert (bare.min_area, bare.open_kernel, bare.close_kernel, bare.mean_ppm) == (12, 3, 5, 1.0)


def masks(spark, arrays):
    return spark.createDataFrame([(k, *a.shape, bytearray(R.pack(a))) for k, a in enumerate(arrays)], "image_id long, height int, width int, mask binary")


def merged(found, gap, span):
    """Brute force: all pairs by rising gap."""
    pairs = []
    for a in range(len(found)):
        for b in range(a + 1, len(found)):
            p, q = found[a], found[b]
            gx, gy = (max(0, max(p[k], q[k]) - min(p[k + 2], q[k + 2])) for k in (0, 1))
            if math.hypot(gx, gy) <= gap:
                pairs.append((gx * gx + gy * gy, a, b))
    sets, boxes = [{k} for k in range(len(found))], list(found)
    for _, a, b in sorted(pairs):
        i, j = (next(k for k, s in enumerate(sets) if x in s) for x in (a, b))
        if i != j:
            box = tuple(f(x, y) for f, x, y in zip((min, min, max, max), boxes[i], boxes[j], strict=True))
            if max(box[2] - box[0], box[3] - box[1]) <= span:
                sets[i] |= sets[j]
                boxes[i] = box
                sets[j] = set()
    return sorted(sorted(k + 1 for k in s) for s in sets if s)


@pytest.mark.parametrize(("gap", "span"), [(3.0, 12.0), (6.5, 30.0), (0.0, 100.0)])
def test_groups_of_islands_equal_brute_force(spark, gap, span):
    rng = np.random.default_rng(int(gap * 10))
    arrays = [rng.random((60, 70)) < p for p in (0.01, 0.05, 0.2)] + [np.zeros((5, 5), bool), np.ones((5, 5), bool)]
    arrays[1][10, :50] = True  # a long thin one
    islands = photos.islands(masks(spark, arrays)).cache()
    groups = {}
    for r in photos.bounded_groups(islands, gap, span).collect():
        groups.setdefault(r.image_id, {}).setdefault(r.group, []).append(r.label)
    for k, a in enumerate(arrays):
        labels, n = flood(a)
        found = R.boxes(labels, n)[:, :4].tolist()
        assert sorted(sorted(g) for g in groups.get(k, {}).values()) == merged([tuple(f) for f in found], gap, span)
        firsts = [min(g) for _, g in sorted(groups.get(k, {}).items())]
        assert firsts == sorted(firsts)


def test_islands_over_a_gap_keep_their_own_pixels(spark):
    mask = np.zeros((20, 40), bool)
    mask[5:8, 5:8] = mask[5:8, 11:14] = mask[15:18, 30:33] = True
    found = photos.islands(masks(spark, [mask]), gap_px=4.0).orderBy("label").collect()
    assert [(r.x0, r.y0, r.x1, r.y1, r.area) for r in found] == [(5, 5, 14, 8, 18), (30, 15, 33, 18, 9)]


def owned_loop(mask, seeds, prior, ppm, margin, limits):
    """Plain loop over islands and pixels of one image."""
    opened = R.opened(mask, R.disc(1))
    labels, n = flood(opened)
    h, w = mask.shape
    out = {}

    def outside(s):
        dx, dy = (max(0, -s[k], s[k] - (size - 1)) / ppm for k, size in ((1, w), (2, h)))
        return math.hypot(dx, dy) >= max(30, s[3] + margin)

    seeds = [s for s in seeds if not outside(s)]
    core = {s[0]: max(6, min(35, max(12, s[3] * 0.28)) * ppm) for s in seeds}
    for k in range(1, n + 1):
        pixels = [(int(y), int(x)) for y, x in zip(*np.nonzero(labels == k), strict=True)]
        gap = {s[0]: [math.hypot(x - s[1], y - s[2]) for y, x in pixels] for s in seeds}
        in_core = {s: any(d * d <= core[s] ** 2 + 1e-9 for d in g) for s, g in gap.items()}
        ys, xs = zip(*pixels, strict=True)
        sides = sorted((max(ys) - min(ys) + 1, max(xs) - min(xs) + 1))
        if not limits[0] <= len(pixels) <= limits[1] or (sides[1] > 9 * sides[0] and len(pixels) > limits[2] and not any(in_core.values())):
            continue
        nearest = [min((gap[s[0]][i], s[0]) for s in seeds)[1] if seeds else None for i in range(len(pixels))]
        for plant, cx, cy, r in seeds:
            mine = [i for i, x in enumerate(nearest) if x == plant]
            if not mine:
                continue
            before = plant in prior and any(prior[plant][p] for p in pixels)
            far = max(gap[plant][i] for i in mine)
            own = in_core[plant] or (before and far <= max(r * 1.5, r + 30) * ppm)
            own = own or (not (0 <= cx < w and 0 <= cy < h) and min(gap[plant][i] for i in mine) / ppm <= max(30, r * 1.25, r + margin))
            doubtful = (min(gap[plant]) < max(r * 1.35, r + 60) * ppm and len(pixels) / ppm**2 >= 600) or before
            for i in mine if own or doubtful else ():
                two = sorted(gap[s[0]][i] for s in seeds)[:2]
                close = len(two) > 1 and two[1] - two[0] < max(5, 5 * ppm)
                out[pixels[i]] = (plant, close) if own else (None, True)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ownership_equals_a_loop(spark, seed):
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    h, w, ppm, margin = 90, 110, 0.8, 20.0
    frames, plants, history, expected = [], [], [], {}
    for image in range(4):
        mask = np.zeros((h, w), bool)
        for _ in range(9):
            mask |= disc(h, w, pick.randrange(h), pick.randrange(w), pick.randrange(2, 14))
        mask[pick.randrange(h), :] = True
        mask[:, pick.randrange(w)] = True
        mask[3:6, :] |= image == 2
        seeds = [(image * 10 + k, pick.randrange(-30, w + 30) + 0.25, pick.randrange(-30, h + 30) + 0.25, float(pick.randrange(5, 60))) for k in range(image * 2)]
        prior = {s[0]: rng.random((h, w)) < 0.002 for s in seeds[::2]}
        frames.append((image, h, w, bytearray(R.pack(mask)), ppm, ppm, 0.0))
        plants += [(image, *s) for s in seeds]
        history += [(image, k, bytearray(R.pack(m))) for k, m in prior.items()]
        expected |= {(image, *p): v for p, v in owned_loop(mask, seeds, prior, ppm, margin, (8, 128_000, 160)).items()}
    frames = photos.scaled(spark.createDataFrame(frames, "image_id long, height int, width int, mask binary, ppm_x double, ppm_y double, rotation double"))
    plants = spark.createDataFrame(plants, "image_id long, plant_id long, cx double, cy double, radius_mm double")
    history = spark.createDataFrame(history, "image_id long, plant_id long, mask binary")
    for tile in (16, 256):
        pixels, _ = ownership.owned_pixels(frames, plants, history, margin, tile)
        assert {(r.image_id, r.y, r.x): (r.plant_id, r.ambiguous) for r in pixels.collect()} == expected
    assert len(expected) > 500


def test_jpeg_files(spark, tmp_path):
    jvm = spark._jvm
    sizes = {"small": (40, 60), "large": (1200, 2000)}
    for name, (h, w) in sizes.items():
        image = jvm.java.awt.image.BufferedImage(w, h, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
        g = image.createGraphics()
        g.setColor(jvm.java.awt.Color(30, 210, 20))
        g.fillRect(0, 0, w // 2, h)
        g.dispose()
        jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / f"{name}.jpg")))
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8 no picture")
    (tmp_path / "text.txt").write_bytes(b"hello")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in photos.read_photos(spark, str(tmp_path)).collect()}
    assert {k: (r.height, r.width) for k, r in rows.items()} == {"small.jpg": (40, 60), "large.jpg": (768, 1280)}
    for r in rows.values():
        image = np.frombuffer(r.bgr, np.uint8).reshape(r.height, r.width, 3)
        assert abs(image[r.height // 2, 5].astype(int) - (20, 210, 30)).max() < 12 and image[r.height // 2, -5].max() < 12
    assert photos.read_photos(spark, str(tmp_path), most_bytes=900).count() <= 1


def test_shrinking_keeps_means():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (30, 50, 3))
    half = R.shrunk(image, 15, 25)
    assert (half == np.rint(image.reshape(15, 2, 25, 2, 3).mean(axis=(1, 3)))).mean() > 0.99
    assert abs(float(R.shrunk(image, 7, 11).mean()) - image.mean()) < 1.5


def test_no_images(spark):
    none = masks(spark, [np.zeros((3, 3), bool)]).limit(0)
    assert photos.islands(none).collect() == [] and photos.pixels_of(none).collect() == []
    assert photos.bounded_groups(photos.islands(none), 3.0, 9.0).collect() == []
    assert photos.vegetation(images(spark, [np.zeros((2, 2, 3))]).where(F.lit(False))).collect() == []
