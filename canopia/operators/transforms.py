"""Pixels and millimetres: camera transforms, footprints, visibility, calibration rules, as Columns.

A calibration is one setting of the camera, passed as a dataclass; positions
and sizes are Columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTORS = 72


@dataclass(frozen=True)
class Calibration:
    """Pixels per millimetre on each axis, turn in degrees, offset of the optical centre, signs of the origin's axes."""

    ppm_x: float
    ppm_y: float
    rotation: float = 0.0
    offset_x: float = 0.0
    offset_y: float = 0.0
    sign_x: int = 1
    sign_y: int = 1
    reference_width: int | None = None
    reference_height: int | None = None

    @property
    def turn(self) -> tuple[float, float]:
        t = math.radians(-self.rotation)
        return math.cos(t), math.sin(t)


def world_to_pixel_offset(dx: Column, dy: Column, cal: Calibration) -> tuple[Column, Column]:
    """geo3: bed offset in millimetres to an image offset: reflect and scale, then turn."""
    cos, sin = cal.turn
    vx, vy = dx * (cal.sign_x * cal.ppm_x), dy * (cal.sign_y * cal.ppm_y)
    return vx * cos + vy * sin, vy * cos - vx * sin


def pixel_to_world_offset(px: Column, py: Column, cal: Calibration) -> tuple[Column, Column]:
    """geo3: the inverse."""
    cos, sin = cal.turn
    return (px * cos - py * sin) / (cal.sign_x * cal.ppm_x), (px * sin + py * cos) / (cal.sign_y * cal.ppm_y)


def garden_to_pixel(x: Column, y: Column, image_x: Column, image_y: Column, width: int, height: int, cal: Calibration) -> tuple[Column, Column]:
    """geo1: garden position to a pixel of the image taken at (image_x, image_y)."""
    px, py = world_to_pixel_offset(x - image_x - cal.offset_x, y - image_y - cal.offset_y, cal)
    return px + width / 2, py + height / 2


def pixel_to_garden(px: Column, py: Column, image_x: Column, image_y: Column, width: int, height: int, cal: Calibration) -> tuple[Column, Column]:
    """geo2: the exact inverse of garden_to_pixel."""
    dx, dy = pixel_to_world_offset(px - width / 2, py - height / 2, cal)
    return image_x + dx + cal.offset_x, image_y + dy + cal.offset_y


def _disc_steps() -> list[tuple[float, float]]:
    axis = [k / 20.0 - 1.0 for k in range(41)]
    return [(u, v) for v in axis for u in axis if u * u + v * v <= 1]


def _disc_share(test):
    """A vectorised UDF: the share of the disc's sample points, over all rows of a batch at once, that pass test(u, v, *columns)."""
    steps = np.array(_disc_steps())

    @F.pandas_udf("double")
    def share(columns: pd.DataFrame) -> pd.Series:
        values = [columns[c].to_numpy(dtype=float) for c in columns.columns]
        hits = np.zeros(len(columns))
        for u, v in steps:
            hits += test(u, v, *values)
        return pd.Series(hits / len(steps))

    return share


def visibility(rows: DataFrame, width: int, height: int, cal: Calibration) -> DataFrame:
    """geo5: adds `visible_fraction` of the disc (px, py in pixels, radius in mm) and its `visible_sectors`.

    The share is a sum over the sample's points in Arrow batches; a row stays one
    row. Discs that coincide in their frames are measured once.
    """
    cos, sin = cal.turn
    kx, ky = cal.sign_x * cal.ppm_x, cal.sign_y * cal.ppm_y

    def inside(u, v, px, py, r):
        vx, vy = u * r * kx, v * r * ky
        x, y = px + (vx * cos + vy * sin), py + (vy * cos - vx * sin)
        return (x >= 0) & (x < width) & (y >= 0) & (y < height)

    rows = rows.withColumn("_r", F.greatest(F.lit(1.0), F.col("radius")))
    own, r = rows.select("px", "py", "_r").distinct(), F.col("_r")

    def seen(u, v):
        ox, oy = world_to_pixel_offset(u * r, v * r, cal)
        x, y = F.col("px") + ox, F.col("py") + oy
        return (x >= 0) & (x < width) & (y >= 0) & (y < height)

    angle = lambda k: k * (2 * math.pi / SECTORS)
    sectors = F.filter(F.sequence(F.lit(0), F.lit(SECTORS - 1)), lambda k: seen(F.cos(angle(k)), F.sin(angle(k))))
    share = _disc_share(inside)(F.struct(F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"), r.alias("r")))
    found = own.withColumns({"visible_fraction": share, "visible_sectors": sectors}).select(*[F.col(c).alias(f"_{c}") for c in ("px", "py")], F.col("_r").alias("_size"), "visible_fraction", "visible_sectors")
    same = F.col("px").eqNullSafe(F.col("_px")) & F.col("py").eqNullSafe(F.col("_py")) & (F.col("_r") == F.col("_size"))
    return rows.join(found, same, "left").drop("_r", "_px", "_py", "_size")


def frame_coverage(x: Column, y: Column, radius: Column, frame_x: Column, frame_y: Column, half_width: float, half_height: float, cal: Calibration) -> Column:
    """geo7: share of a disc's sample inside the turned frame around (frame_x, frame_y)."""
    cos, sin = cal.turn

    def inside(u, v, cx, cy, r, fx, fy):
        dx = (cx + u * r - fx - cal.offset_x) * cal.sign_x
        dy = (cy + v * r - fy - cal.offset_y) * cal.sign_y
        return (np.abs(dx * cos + dy * sin) <= half_width) & (np.abs(dy * cos - dx * sin) <= half_height)

    columns = {"cx": x, "cy": y, "r": F.greatest(F.lit(1.0), radius), "fx": frame_x, "fy": frame_y}
    return _disc_share(inside)(F.struct(*[c.cast("double").alias(n) for n, c in columns.items()]))


def blob_to_garden(u: Column, v: Column, frame_x: Column, frame_y: Column, half_width: float, half_height: float, cal: Calibration) -> tuple[Column, Column]:
    """geo8: a place in the frame, as shares of its sides, to the garden; inverse of frame_coverage's transform."""
    cos, sin = cal.turn
    lx, ly = (u - 0.5) * 2 * half_width, (v - 0.5) * 2 * half_height
    return frame_x + cal.offset_x + (lx * cos - ly * sin) * cal.sign_x, frame_y + cal.offset_y + (lx * sin + ly * cos) * cal.sign_y


def footprint(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """geo9: sides of the largest upright rectangle inside a rectangle turned by `rotation` degrees."""
    degrees = F.abs(rotation) % 180
    angle = F.radians(F.when(degrees > 90, 180 - degrees).otherwise(degrees))
    sin, cos = F.abs(F.sin(angle)), F.abs(F.cos(angle))
    short, long = F.least(width, height), F.greatest(width, height)
    half = (short <= 2 * sin * cos * long) | (F.abs(sin - cos) < 1e-12)
    wide = width >= height
    double = cos * cos - sin * sin
    w = F.when(half, short / 2 / F.when(wide, sin).otherwise(cos)).otherwise((width * cos - height * sin) / double)
    h = F.when(half, short / 2 / F.when(wide, cos).otherwise(sin)).otherwise((height * cos - width * sin) / double)
    flat = sin < 1e-12
    return tuple(F.round(F.when(flat, side).otherwise(F.greatest(F.lit(1.0), cut)), 3) for side, cut in ((width, w), (height, h)))


def bounded_segment(x: Column, y: Column, radius: Column, angle: Column, length: Column, xb: tuple, yb: tuple) -> Column:
    """geo14: struct(sx, sy, ex, ey) of a segment centred at the point, scaled to lie within the bed; null if too short."""
    ux, uy, half = F.cos(angle), F.sin(angle), length / 2

    def limits(c, d, b):
        reach = half * F.abs(d)
        flat = F.abs(d) < 1e-9
        room = lambda free: F.when(flat | (free >= reach), F.lit(1.0)).otherwise(free / reach)
        return [room(c - b[0]), room(b[1] - c)]

    scale = F.least(F.lit(1.0), *limits(x, ux, xb), *limits(y, uy, yb))
    h = half * F.greatest(F.lit(0.0), scale)
    clip = lambda v, b: F.least(F.lit(float(b[1])), F.greatest(F.lit(float(b[0])), v))
    ends = F.struct(clip(x - ux * h, xb).alias("sx"), clip(y - uy * h, yb).alias("sy"), clip(x + ux * h, xb).alias("ex"), clip(y + uy * h, yb).alias("ey"))
    return F.when(scale * length >= F.greatest(F.lit(20.0), radius * 2), ends)


def relative_transform(x: Column, y: Column, image_x: Column, image_y: Column, width: int, height: int, cal: Calibration) -> Column:
    """geo4: the affine map (a, b, c, d, e, f) from a pixel to millimetres from the plant; null if a position is missing."""
    px, py = garden_to_pixel(x, y, image_x, image_y, width, height, cal)
    cos, sin = cal.turn
    kx, ky = 1 / (cal.sign_x * cal.ppm_x), 1 / (cal.sign_y * cal.ppm_y)
    a, b, d, e = cos * kx, -sin * kx, sin * ky, cos * ky
    parts = F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (-(px * a + py * b)).alias("c"), F.lit(d).alias("d"), F.lit(e).alias("e"), (-(px * d + py * e)).alias("f"))
    return F.when(x.isNotNull() & y.isNotNull() & image_x.isNotNull() & image_y.isNotNull(), parts)


def rescale(cal: Calibration, width: int, height: int, tolerance: float = 0.02) -> Calibration | None:
    """cal2: the calibration for another size of the same picture; none if orientation or aspect differ."""
    rw, rh = cal.reference_width, cal.reference_height
    if not rw or not rh or (rw >= rh) != (width >= height) or abs((width / height) / (rw / rh) - 1) > tolerance:
        return None
    return replace(cal, ppm_x=cal.ppm_x * width / rw, ppm_y=cal.ppm_y * height / rh)


def from_coordinate_scale(mm_per_pixel: float, reference: tuple[int, int], width: int, height: int, **rest) -> Calibration | None:
    """cal3: a calibration at the processed size from millimetres a pixel at the reference size."""
    if mm_per_pixel <= 0:
        return None
    return rescale(Calibration(1 / mm_per_pixel, 1 / mm_per_pixel, reference_width=reference[0], reference_height=reference[1], **rest), width, height)


def resolve(processed: Calibration | None, reference: Calibration | None, manual: Calibration | None) -> tuple[Calibration | None, str]:
    """cal5: the first that is there, and its name."""
    for cal, name in ((processed, "processed"), (reference, "reference"), (manual, "manual")):
        if cal is not None:
            return cal, name
    return None, "none"
