"""img17, img18: how good a photograph is, from figures that a task measures on it and rules that are columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.functions import rasters as R
from canopia.functions.scalars import clip
from canopia.sources.shared import cut

#: The side photographs are inspected at and the least they need, the share that a blob fills at least, blobs reported.
SIDE, LEAST_SIDE, LEAST_BLOB, MOST_BLOBS = 640, 80, 0.0015, 24
#: Brightness of highlights and of bright ground, their most saturation, thickness of a leaf as a share of the short side.
HIGHLIGHT, BRIGHT, NEUTRAL, THICK = 235, 205, 85, 0.075

FIGURES = ("bright", "highlight", "median_value", "low_value", "vegetation", "clipped", "laplacian", "edges", "contrast")
_ISLAND = pa.struct([(n, pa.float64()) for n in ("u", "v", "area", "edges_touched")] + [("thick", pa.bool_())])
_MADE = "image_id long, " + ", ".join(f"{n} double" for n in FIGURES) + ", islands array<struct<u: double, v: double, area: double, edges_touched: double, thick: boolean>>"


def grey(bgr: np.ndarray) -> np.ndarray:
    """Brightness in integers, as the eye weighs the colours."""
    b, g, r = (bgr[..., k].astype(np.int64) for k in range(3))
    return 1868 * b + 9617 * g + 4899 * r + 8192 >> 14


def measured(bgr: np.ndarray) -> tuple[list[float], list[dict]]:
    """FIGURES of one image, and its islands of vegetation in shares of the frame."""
    hue, saturation, value = R.hsv(bgr)
    b, g, r = (bgr[..., k].astype(np.int64) for k in range(3))
    green = (hue >= 25) & (hue <= 105) & (saturation >= 32) & (value >= 25) & (2 * g - r - b >= 9)
    green = R.closed(R.opened(green, R.square(5)), R.square(5))
    light = grey(bgr)
    around = np.pad(light, 1, mode="reflect") if min(light.shape) > 1 else np.pad(light, 1, mode="edge")
    up, down, left, right = around[:-2, 1:-1], around[2:, 1:-1], around[1:-1, :-2], around[1:-1, 2:]
    bend = up + down + left + right - 4 * light
    across = (around[:-2, 2:] - around[:-2, :-2]) + 2 * (right - left) + (around[2:, 2:] - around[2:, :-2])
    along = (around[2:, :-2] - around[:-2, :-2]) + 2 * (down - up) + (around[2:, 2:] - around[:-2, 2:])
    neutral = saturation <= NEUTRAL
    figures = [
        ((value >= BRIGHT) & neutral).mean(), ((value >= HIGHLIGHT) & neutral).mean(), np.median(value) / 255, np.percentile(value, 10) / 255, green.mean(),
        ((light <= 5) | (light >= 250)).mean(), bend.var(), (across * across + along * along >= 100 * 100).mean(), light.std() / 255,
    ]
    height, width = green.shape
    labels, n = R.components(green)
    box = R.boxes(labels, n)
    least = min(height, width) * THICK
    inner = [(dy, math.isqrt(math.ceil(least * least - dy * dy) - 1)) for dy in range(-math.ceil(least) + 1, math.ceil(least)) if dy * dy < least * least]
    thick = np.zeros(n + 1, bool)
    thick[np.unique(labels[R.erode(green, inner)])] = True
    y, x = np.nonzero(labels)
    own = labels[y, x] - 1
    mean = [np.bincount(own, v, n) / np.maximum(box[:, 4], 1) for v in (x, y)]
    touched = (box[:, 0] == 0).astype(int) + (box[:, 1] == 0) + (box[:, 2] >= width) + (box[:, 3] >= height)
    islands = [{"u": float(mean[0][k] / width), "v": float(mean[1][k] / height), "area": float(box[k, 4] / green.size), "edges_touched": float(touched[k]), "thick": bool(thick[k + 1])} for k in range(n)]
    return [float(v) for v in figures], islands


def figures(images: DataFrame, side: int = SIDE, least_side: int = LEAST_SIDE) -> DataFrame:
    """(image_id, FIGURES, islands) of images (image_id, height, width, bgr), shrunk to `side`; smaller ones than least_side have none."""
    target = pa.schema([("image_id", pa.int64()), *[(n, pa.float64()) for n in FIGURES], ("islands", pa.list_(_ISLAND))])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                image_id, height, width, bgr = (batch.column(i)[k].as_py() for i in range(4))
                values, islands = [None] * len(FIGURES), []
                if min(height, width) >= max(1, least_side):
                    image = np.frombuffer(bgr, np.uint8).reshape(height, width, 3)
                    scale = side / max(height, width)
                    if scale < 1:
                        image = R.shrunk(image, max(1, round(height * scale)), max(1, round(width * scale)))
                    values, islands = measured(image)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((image_id, *values, islands), target, strict=True)], schema=target)

    return images.select(F.col("image_id").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), "bgr").mapInArrow(run, _MADE)


def sharpness() -> Column:
    return clip(F.log1p("laplacian") / math.log(101), 0.0, 1.0)


def image_quality() -> Column:
    """img17: sharpness and exposure in one figure."""
    exposure = F.greatest(F.lit(0.0), 1 - F.col("clipped") * 2.5)
    return clip(0.6 * F.least(F.lit(1.0), F.log1p("laplacian") / math.log(101)) + 0.4 * exposure, 0.05, 1.0)


def inspected(images: DataFrame, side: int = SIDE, least_side: int = LEAST_SIDE) -> DataFrame:
    """img18: per image issue, scores, shares, sharpness, laplacian, edges, contrast, image_quality, and blobs, largest first.

    Washed out goes before a leaf over the lens, that before blur. A leaf covers
    the lens if it is thick, meets two sides and is nearly all the vegetation.
    Images too small to tell are usable, with all figures zero.
    """
    rows = cut(figures(images, side, least_side))
    each = rows.select("image_id", F.explode("islands").alias("i")).select("image_id", "i.*")
    leaf = (F.col("edges_touched") >= 2) & F.col("thick")
    sums = each.groupBy("image_id").agg(F.max(F.when(leaf, F.col("area"))).alias("leaf"), F.sum(F.when(~leaf, F.col("area"))).alias("clear"))
    order = W.partitionBy("image_id").orderBy(F.desc("area"), "v", "u")
    top = each.where(F.col("area") >= LEAST_BLOB).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= MOST_BLOBS)
    one = F.struct("nth", F.col("u").alias("u"), "v", F.col("area").alias("area_fraction"), (F.col("edges_touched") > 0).alias("touches_edge"))
    blobs = top.groupBy("image_id").agg(F.array_sort(F.collect_list(one)).alias("blobs"))
    zero = {n: F.coalesce(n, F.lit(0.0)) for n in (*FIGURES, "leaf", "clear")}
    all_ = rows.drop("islands").join(sums, "image_id", "left").join(blobs, "image_id", "left").withColumn("told", F.col("contrast").isNotNull()).withColumns(zero)
    c = F.col
    dominance = c("leaf") / F.greatest(F.lit(0.01), c("vegetation"))
    washed = (c("highlight") >= 0.30) & (c("median_value") >= 0.84) & (c("low_value") >= 0.58) & (c("vegetation") < 0.12)
    covered = (c("leaf") >= 0.30) & (c("vegetation") >= 0.30) & (dominance >= 0.88) & (c("clear") <= 0.05)
    blurred = (c("laplacian") <= 5.0) & (c("edges") <= 0.025) & (c("contrast") >= 0.025)
    missing = lambda v, full: 1 - F.least(F.lit(1.0), v / full)
    blur = clip((0.6 * missing(c("laplacian"), 20.0) + 0.4 * missing(c("edges"), 0.06)) * F.least(F.lit(1.0), c("contrast") / 0.04), 0.0, 1.0)
    shown = lambda v: F.when(c("told"), v).otherwise(0.0)
    return all_.select(
        "image_id", F.when(c("told") & washed, "washed_out").when(c("told") & covered, "leaf_obstruction").when(c("told") & blurred, "blurry").otherwise("usable").alias("issue"),
        shown(clip(0.35 * c("bright") + 0.35 * c("highlight") + 0.20 * c("median_value") + 0.10 * c("low_value"), 0.0, 1.0)).alias("washed_out"),
        shown(clip(0.65 * c("leaf") / 0.40 + 0.35 * dominance, 0.0, 1.0)).alias("obstruction"), shown(blur).alias("blur"), "vegetation", c("clear"), shown(sharpness()).alias("sharpness"), "laplacian", "edges", "contrast",
        shown(image_quality()).alias("image_quality"), F.coalesce(F.transform("blobs", lambda b: b.dropFields("nth")), F.array().cast("array<struct<u: double, v: double, area_fraction: double, touches_edge: boolean>>")).alias("blobs"),
    )
