"""can3: the masks of a plant's views, fused on a canvas around the plant; img9: the shift between two masks.

A view is a row (plant_id, measurement_id, image_timestamp, height, width, mask,
to_mm, scale, confidence, current_mm, margin_mm, age_days, accepted_mm); to_mm
holds the six numbers that take a pixel to millimetres from the plant, scale is
pixels a millimetre. A task warps one view and returns the cells it has foliage
in; votes and evidence are aggregates over cells, and the edge is can1's.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.functions import rasters as R
from canopia.functions import scalars
from canopia.operators import evidence
from canopia.sources.shared import cut

#: Settings of the user, with their defaults.
SETTINGS = {"least_confidence": 0.35, "views": 2, "single": 0.82, "hours": 6.0, "edge_mm": 20.0, "most_px": 2400}
#: The least scale of a canvas, the least island in square millimetres, the share of the edge at its border.
LEAST_PPM, LEAST_MM2, BORDER = 0.25, 12.0, 0.2
#: Places in a view are compared to a billionth of a pixel.
DIGITS = 9
SECTORS = evidence.SECTORS


def canvases(views: DataFrame, settings: dict | None = None) -> DataFrame:
    """views that count, with their plant's canvas: min_x, min_y (mm), ppm, columns, rows, and the number of views.

    A view counts if its mask shows foliage, it is confident enough and not
    older than the plant's newest by more than the window.
    """
    s = SETTINGS | (settings or {})
    newest = F.max("image_timestamp").over(W.partitionBy("plant_id")).cast("double")
    late = (newest - F.col("image_timestamp").cast("double")) > s["hours"] * 3600
    some = views.withColumn("_late", late).where((F.col("confidence") >= s["least_confidence"]) & ~F.col("_late") & F.col("mask").isNotNull() & (F.hex("mask").rlike("[1-9A-F]"))).drop("_late")
    at = lambda k, x, y: F.get("to_mm", F.lit(k)) * x + F.get("to_mm", F.lit(k + 1)) * y + F.get("to_mm", F.lit(k + 2))
    corners = [(F.lit(0), F.lit(0)), (F.col("width"), F.lit(0)), (F.lit(0), F.col("height")), (F.col("width"), F.col("height"))]
    xs, ys = ([at(k, x, y) for x, y in corners] for k in (0, 3))
    own = some.withColumns({"_x0": F.least(*xs), "_x1": F.greatest(*xs), "_y0": F.least(*ys), "_y1": F.greatest(*ys)})
    plants = own.groupBy("plant_id").agg(
        F.min("_x0").alias("min_x"), F.max("_x1").alias("_mx"), F.min("_y0").alias("min_y"), F.max("_y1").alias("_my"), F.median("scale").alias("_ppm"), F.count("*").alias("views")
    )
    side = F.greatest(F.lit(1.0), F.col("_mx") - F.col("min_x"), F.col("_my") - F.col("min_y"))
    plants = plants.withColumn("ppm", F.greatest(F.lit(LEAST_PPM), F.least("_ppm", F.lit(float(s["most_px"])) / side)))
    size = lambda a, b: F.greatest(F.lit(1), F.rint((F.col(a) - F.col(b)) * F.col("ppm")).cast("int"))
    plants = plants.select("plant_id", "min_x", "min_y", "ppm", size("_mx", "min_x").alias("columns"), size("_my", "min_y").alias("rows"), "views")
    return own.drop("_x0", "_x1", "_y0", "_y1").join(plants, "plant_id")


def to_canvas(to_mm: list[float], min_x: float, min_y: float, ppm: float) -> np.ndarray:
    """The map from a pixel to its place on the canvas, 2 by 3."""
    a = np.array(to_mm, np.float64).reshape(2, 3)
    a[:, 2] -= np.array([min_x, min_y])
    return a * ppm


def from_canvas(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place in the view (x, y) of canvas cells, by the inverse of the map `a` with its products taken to DIGITS, as decimals are: a cell half-way between two pixels then goes where SQL puts it."""
    dx, dy = x - a[0, 2], y - a[1, 2]
    size = a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]
    return np.round(a[1, 1] * dx - a[0, 1] * dy, DIGITS) / size, np.round(a[0, 0] * dy - a[1, 0] * dx, DIGITS) / size


def warp(mask: np.ndarray, placed: np.ndarray, columns: int, rows: int, edge_px: float, confidence: float):
    """Cells (y, x) of the canvas in which the view has foliage or evidence, both there.

    Foliage is the nearest pixel's; evidence is the view's confidence, less
    towards the frame's border, between the four pixels around, nothing beyond.
    """
    height, width = mask.shape
    x, y = np.meshgrid(np.arange(columns), np.arange(rows))
    sx, sy = from_canvas(placed, x, y)
    near_x, near_y = np.rint(sx).astype(np.int64), np.rint(sy).astype(np.int64)
    inside = (near_x >= 0) & (near_x < width) & (near_y >= 0) & (near_y < height)
    seen = np.zeros((rows, columns), bool)
    seen[inside] = mask[near_y[inside], near_x[inside]]
    py, px = np.mgrid[:height, :width]
    border = np.minimum.reduce((px, py, width - 1 - px, height - 1 - py))
    sure = np.ones(mask.shape) if edge_px <= 0 else np.clip(border / max(1.0, edge_px), BORDER, 1.0)
    padded = np.zeros((height + 2, width + 2))
    padded[1:-1, 1:-1] = mask * sure * confidence
    fx, fy = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
    beside = (fx >= -1) & (fx < width) & (fy >= -1) & (fy < height)
    u, v = (sx - fx)[beside], (sy - fy)[beside]
    gx, gy = fx[beside] + 1, fy[beside] + 1
    found = np.zeros((rows, columns))
    found[beside] = (1 - v) * ((1 - u) * padded[gy, gx] + u * padded[gy, gx + 1]) + v * ((1 - u) * padded[gy + 1, gx] + u * padded[gy + 1, gx + 1])
    cy, cx = np.nonzero(seen | (found > 0))
    return cy, cx, seen[cy, cx], found[cy, cx]


def fused_cells(views: DataFrame, settings: dict | None = None) -> DataFrame:
    """(plant_id, cy, cx, support, strongest) of the accepted cells of views from `canvases`.

    A cell counts with foliage in enough views, or in one with enough evidence
    (of a single view, the least confidence is enough).
    """
    s = SETTINGS | (settings or {})
    columns = ["plant_id", "height", "width", "mask", "to_mm", "scale", "confidence", "min_x", "min_y", "ppm", "columns", "rows", "views"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                v = {c: batch.column(c)[k].as_py() for c in columns}
                mask = R.unpack(v["mask"], v["height"], v["width"])
                y, x, seen, found = warp(mask, to_canvas(v["to_mm"], v["min_x"], v["min_y"], v["ppm"]), v["columns"], v["rows"], s["edge_mm"] * v["scale"], v["confidence"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(y), v["plant_id"], np.int64)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(seen.astype(np.int64)), pa.array(found), pa.array(np.full(len(y), v["views"], np.int64))],
                    ["plant_id", "cy", "cx", "seen", "found", "views"],
                )

    cells = views.select(F.col("plant_id").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), *columns[3:]).mapInArrow(run, "plant_id long, cy int, cx int, seen long, found double, views long")
    votes = cells.groupBy("plant_id", "cy", "cx").agg(F.sum("seen").alias("support"), F.max("found").alias("strongest"), F.max("views").alias("views"))
    least = F.when(F.col("views") == 1, s["least_confidence"]).otherwise(s["single"])
    return votes.where((F.col("support") >= s["views"]) | ((F.col("support") >= 1) & (F.col("strongest") >= least))).select("plant_id", "cy", "cx", "support", "strongest")


def _cleaned(cells: DataFrame, plants: DataFrame) -> DataFrame:
    """cells without specks: opened, and without islands below LEAST_MM2. A canvas is bounded, so a plant is a task's."""

    def run(own: pa.Table, canvas: pa.Table) -> pa.Table:
        if not len(own) or not len(canvas):
            return own.slice(0, 0)
        rows, columns, ppm = (canvas.column(c)[0].as_py() for c in ("rows", "columns", "ppm"))
        y, x = (own.column(c).to_numpy() for c in ("cy", "cx"))
        mask = np.zeros((rows, columns), bool)
        mask[y, x] = True
        labels, n = R.components(R.opened(mask, R.disc(1)))
        large = np.bincount(labels.ravel(), minlength=n + 1) >= max(3, round(LEAST_MM2 * ppm * ppm))
        large[0] = False
        return own.filter(pa.array(large[labels[y, x]]))

    sizes = plants.select(F.col("plant_id").alias("canvas_id"), "rows", "columns", "ppm")
    kinds = ", ".join(f"{c} {t}" for c, t in cells.dtypes)
    return cells.groupBy("plant_id").cogroup(sizes.groupBy("canvas_id")).applyInArrow(run, kinds)


def _observed(views: DataFrame, outer: DataFrame) -> DataFrame:
    """(plant_id, observed): the sectors of the ring around the outer edge that some view shows."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                v = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                x, y = np.meshgrid(np.arange(v["columns"]), np.arange(v["rows"]))
                dx, dy = x / v["ppm"] + v["min_x"], y / v["ppm"] + v["min_y"]
                far = np.hypot(dx, dy)
                sx, sy = (np.rint(c) for c in from_canvas(to_canvas(v["to_mm"], v["min_x"], v["min_y"], v["ppm"]), x, y))
                ring = (far >= max(1.0, v["outer_mm"] * 0.75)) & (far <= max(2.0, v["outer_mm"] * 1.05))
                shown = ring & (sx >= 0) & (sx < v["width"]) & (sy >= 0) & (sy < v["height"])
                found = np.unique(np.floor(np.mod(np.arctan2(dy, dx)[shown], 2 * math.pi) / (2 * math.pi) * SECTORS).astype(np.int32) % SECTORS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), v["plant_id"], np.int64)), pa.array(found)], ["plant_id", "sector"])

    rows = views.join(outer, "plant_id").select(F.col("plant_id").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), "to_mm", "min_x", "min_y", "ppm", "columns", "rows", "outer_mm")
    return rows.mapInArrow(run, "plant_id long, sector int").groupBy("plant_id").agg(F.count_distinct("sector").alias("observed"))


def fuse(views: DataFrame, settings: dict | None = None, margin: float = 20.0) -> DataFrame:
    """Per plant with accepted foliage: views, typical_mm, outer_mm, recommended_mm, held, confidence, coverage, corroborated, spread_mm, area_mm2, broad.

    Growth without evidence is held at the current radius, with the reason.
    coverage is the larger of what the views show of the ring around the edge
    and, where views have `covered`, the sectors that their selection covers.
    """
    own = cut(canvases(views, settings))
    plants = own.groupBy("plant_id").agg(
        *[F.first(c).alias(c) for c in ("min_x", "min_y", "ppm", "columns", "rows", "views")], F.median("current_mm").alias("current_mm"), F.max("age_days").alias("age_days"), F.avg("confidence").alias("sure"),
        (F.percentile("accepted_mm", F.lit(0.9)) - F.percentile("accepted_mm", F.lit(0.1))).alias("spread_mm"),
        (F.max("covered") if "covered" in views.columns else F.lit(0)).alias("covered"),
    )
    plants = cut(plants)
    cells = cut(_cleaned(fused_cells(own, settings), plants))
    placed = cells.join(plants.select("plant_id", "min_x", "min_y", "ppm"), "plant_id")
    dx, dy = F.col("cx") / F.col("ppm") + F.col("min_x"), F.col("cy") / F.col("ppm") + F.col("min_y")
    turn = F.pmod(F.atan2(dy, dx), F.lit(2 * math.pi)) / (2 * math.pi) * SECTORS
    points = placed.select("plant_id", (F.floor(turn).cast("int") % SECTORS).alias("sector"), F.hypot(dx, dy).alias("distance_mm"), "support")
    points = cut(points)
    limits = cut(evidence.edge_limits(points, plants, margin))
    edge = cut(evidence.canopy_edge(points, plants, margin, limits))
    kept = evidence.kept_points(points, limits).groupBy("plant_id").agg(F.count("*").alias("cells"), F.avg((F.col("support") >= 2).cast("double")).alias("corroborated"))
    observed = _observed(own, edge.select("plant_id", "outer_mm"))
    rows = edge.join(plants, "plant_id").join(kept, "plant_id").join(observed, "plant_id", "left")
    area = F.col("cells") / (F.col("ppm") * F.col("ppm"))
    rows = rows.withColumns({"area_mm2": area, "coverage": F.greatest(F.coalesce("observed", F.lit(0)), F.coalesce("covered", F.lit(0))) / SECTORS})
    held = F.when(F.col("recommended_mm") > F.col("current_mm"), scalars.growth_hold(F.col("area_mm2"), F.col("age_days")))
    advice = F.when(held.isNotNull(), F.col("current_mm")).otherwise(F.col("recommended_mm"))
    sure = scalars.fused_confidence(F.col("sure"), F.col("coverage"), F.col("views"), F.col("corroborated"), F.col("broad"))
    return rows.select("plant_id", "views", "typical_mm", "outer_mm", advice.alias("recommended_mm"), held.alias("held"), sure.alias("confidence"), "coverage", "corroborated", "spread_mm", "area_mm2", "broad")


#: The least response and the largest shift that count, in pixels.
LEAST_RESPONSE, MOST_SHIFT = 0.05, 40.0


def registered(pairs: DataFrame) -> DataFrame:
    """img9: (pair_id, dx, dy, response) of pairs (pair_id, height, width, before, after) of masks.

    A shift of weak response or beyond MOST_SHIFT is none; masks of another
    size, given as null, have no response.
    """

    def run(batches):
        for batch in batches:
            made = []
            for k in range(batch.num_rows):
                pair, height, width, before, after = (batch.column(i)[k].as_py() for i in range(5))
                x, y, response = (0.0, 0.0, 0.0) if before is None or after is None else R.shift_between(R.unpack(before, height, width).astype(float), R.unpack(after, height, width).astype(float))
                weak = response < LEAST_RESPONSE or math.hypot(x, y) > MOST_SHIFT
                made.append((pair, 0.0 if weak else x, 0.0 if weak else y, response))
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["pair_id", "dx", "dy", "response"])

    return pairs.select(F.col("pair_id").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), "before", "after").mapInArrow(run, "pair_id long, dx double, dy double, response double")
