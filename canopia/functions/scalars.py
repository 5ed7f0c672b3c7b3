"""Scalar rules of the garden, as functions from Columns to a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def age_days(planted: Column, at: Column) -> Column:
    """fn3: whole days since planting, not below 0."""
    return F.greatest(F.lit(0), F.datediff(at, planted))


def absence_confidence(coverage: Column) -> Column:
    """fn12: confidence that an empty centre is empty, from the share of it that is covered."""
    return clip(0.72 + 0.25 * (1 - coverage / 0.035), 0.05, 0.98)


def proximity_factor(distance: Column, radius: Column) -> Column:
    """fn13: 0 at a crop's centre, 1 from its radius on; 1 without a radius."""
    ratio = F.greatest(F.lit(0.0), distance) / radius
    return F.when(radius <= 0, 1.0).otherwise(F.least(F.lit(1.0), ratio * ratio))


def growth_hold(area: Column, age: Column, least_area: float = 150.0, least_age: int = 10) -> Column:
    """fn14: why growth is held: `area`, `age` or null; unknown values hold nothing."""
    return F.when(area < least_area, "area").when(age < least_age, "age")


def prior_edge(current: Column, margin: float) -> Column:
    """fn15: the foliage edge that a stored radius stood for."""
    cur = F.greatest(F.lit(0.0), current)
    return F.greatest(F.lit(5.0), F.when(cur > margin + 5, cur - margin).otherwise(cur))


def limited_growth(current: Column, measured: Column, baseline: Column, most_mm: float, most_percent: float) -> Column:
    """win3: the measured radius, up to a ceiling over the baseline, never below the current one."""
    base = F.greatest(F.lit(0.0), baseline)
    ceiling = F.least(base + max(0.0, most_mm), base * (1 + max(0.0, most_percent) / 100))
    return F.greatest(current, F.least(measured, ceiling))


def fused_confidence(mean: Column, coverage: Column, views: Column, corroborated: Column, broad: Column) -> Column:
    """agg13: confidence of a fusion from its views' mean, the boundary seen, their number and the share seen twice; broad overreach and a boundary under half seen cap it."""
    raw = clip(mean * 0.75 + coverage * 0.20 + F.least(F.lit(0.08), (views - 1) * 0.02) + F.least(F.lit(0.05), corroborated * 0.1), 0.05, 0.99)
    held = F.when(broad, F.least(raw, F.lit(0.74))).otherwise(raw)
    return F.when(coverage < 0.5, F.least(held, F.lit(0.45))).otherwise(held)


def queue_key(point_id: Column, x: Column, y: Column) -> Column:
    """fn22: what a soil measurement is about: its point, or its place (to a thousandth) where it has none."""
    known = F.coalesce(point_id, F.lit(0)) != 0
    place = lambda v: F.round(F.coalesce(v, F.lit(0.0)) * 1000).cast("long").cast("string")
    return F.when(known, F.concat(F.lit("point:"), point_id.cast("string"))).otherwise(F.concat_ws(":", F.lit("coordinate"), place(x), place(y)))


def display_cell(column: Column, row: Column, columns: Column, rows: Column, origin: str, rotate: bool) -> tuple[Column, Column]:
    """fn26: (row, column) of a cell on a map with that origin corner, turned on its diagonal first if asked."""
    dx, dy = (row, column) if rotate else (column, row)
    wide, high = (rows, columns) if rotate else (columns, rows)
    dx = wide - 1 - dx if origin.endswith("right") else dx
    dy = high - 1 - dy if origin.startswith("bottom") else dy
    return dy, dx


def curve_radius(proposed: Column, current: Column, age: Column, curve: Column) -> Column:
    """fn16: a proposal that shrinks is raised to the current radius and to half of what the curve (a map from day to diameter) reached before that age."""
    before = F.array_max(F.map_values(F.map_filter(curve, lambda day, _: day < age)))
    return F.when(proposed >= current, proposed).otherwise(F.greatest(proposed, current, F.coalesce(before, F.lit(0.0)) / 2))


def same_run(started: Column, remembered: Column, hours: float = 1.0) -> Column:
    """fn18: whether a run that started then is the remembered one: not earlier, and at most so many hours later."""
    later = started.cast("double") - remembered.cast("double")
    return F.coalesce(later.between(0, hours * 3600), F.lit(False))


def chunk_size(capabilities: Column, capability: str, large: int = 256, small: int = 12) -> Column:
    """fn19: cells of one capture call, by what a device (an array of names) can do."""
    return F.when(F.array_contains(capabilities, capability), large).otherwise(small)


def curve_day(text: Column) -> Column:
    """fn10: a day written as a plain non-negative whole number, else null."""
    return F.when(text.rlike("^(0|[1-9][0-9]{0,8})$"), text.try_cast("int"))


def polygon_points(text: Column) -> Column:
    """fn27: array of (x, y) from lines or semicolons of `x, y`; null where an entry is not two numbers."""
    entries = F.filter(F.transform(F.split(text, "[;\n\r]"), lambda e: F.trim(e)), lambda e: e != "")
    parts = F.transform(entries, lambda e: F.filter(F.split(F.regexp_replace(e, "\t", ","), ","), lambda p: F.trim(p) != ""))
    points = F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y"), F.size(p).alias("n")))
    fine = F.forall(points, lambda p: (p["n"] == 2) & p["x"].isNotNull() & p["y"].isNotNull())
    return F.when(fine, F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))


def snippet(text: Column, most: int = 80) -> Column:
    """fn23: text with white space collapsed, cut to so many characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def rescaled(ppm: Column, width: Column, height: Column, to_width: int, to_height: int, tolerance: float = 0.02) -> Column:
    """cal2, cal4: pixels a millimetre for another size of the same picture; null if its size is unknown, or orientation or aspect differ."""
    turned = (width >= height) != F.lit(to_width >= to_height)
    apart = F.abs(F.lit(to_width / to_height) / (width / height) - 1) > tolerance
    return F.when(width.isNotNull() & height.isNotNull() & ~turned & ~apart, ppm * to_width / width)
