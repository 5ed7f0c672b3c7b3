"""img10: which plant each leaf pixel belongs to.

Islands are cut into tiles, so that one large image is many tasks. A tile says
for each of its islands and each plant of the image how near they come; an
aggregate puts islands together again, the verdict is a column, and goes back
to the tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopia.functions import rasters as R

TILE = 256
#: Fixed values, in millimetres unless they are shares or pixels.
CORE = {"share": 0.28, "least": 12.0, "most": 35.0, "least_px": 6.0}
HISTORY = {"factor": 1.5, "extra": 30.0}
CANOPY = {"least": 30.0, "factor": 1.25}
SOFT = {"factor": 1.35, "extra": 60.0}
LARGE_MM2, AMBIGUOUS_MM = 600.0, 5.0

_TILES = "image_id long, ty int, tx int, y0 int, x0 int, height int, width int, labels binary"
_FACTS = "image_id long, label int, seed int, pixels long, area long, x0 int, y0 int, x1 int, y1 int, nearest_px double, farthest_px double, nearest_mm double, in_core boolean, prior boolean"
_FACT_TYPES = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in _FACTS.split(", "))])


def labelled_tiles(masks: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles of the labels of masks (image_id, height, width, mask), whose hairline bridges are opened before."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                image_id, height, width, mask = (batch.column(i)[k].as_py() for i in range(4))
                labels = R.components(R.opened(R.unpack(mask, height, width), R.disc(1)))[0].astype(np.int32)
                parts = [(y, x, labels[y : y + tile, x : x + tile]) for y in range(0, height, tile) for x in range(0, width, tile)]
                parts = [p for p in parts if p[2].any()]
                if parts:
                    columns = [[image_id] * len(parts), [p[0] // tile for p in parts], [p[1] // tile for p in parts], [p[0] for p in parts], [p[1] for p in parts], [p[2].shape[0] for p in parts], [p[2].shape[1] for p in parts], [p[2].tobytes() for p in parts]]
                    kinds = [pa.int64(), *[pa.int32()] * 6, pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in _TILES.split(", ")])

    return masks.select(F.col("image_id").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), "mask").mapInArrow(run, _TILES)


def core_px(radius_mm: Column, mean_ppm: Column) -> Column:
    """How near to its centre a plant's own leaf must come, in pixels."""
    own = F.least(F.lit(CORE["most"]), F.greatest(F.lit(CORE["least"]), radius_mm * CORE["share"]))
    return F.greatest(F.lit(CORE["least_px"]), own * mean_ppm)


def seeds_of(plants: DataFrame, frames: DataFrame, margin_mm: float) -> DataFrame:
    """(image_id, seeds, ppm_x, ppm_y, mean_ppm, turn): the plants (image_id, plant_id, cx, cy, radius_mm) whose expected disc meets the frame, by id.

    frames are scaled images with `rotation` in degrees.
    """
    near = F.greatest(F.lit(CANOPY["least"]), F.col("radius_mm") + margin_mm)
    dx = F.greatest(F.lit(0.0), -F.col("cx"), F.col("cx") - (F.col("width") - 1)) / F.col("ppm_x")
    dy = F.greatest(F.lit(0.0), -F.col("cy"), F.col("cy") - (F.col("height") - 1)) / F.col("ppm_y")
    rows = plants.join(frames.select("image_id", "height", "width", "ppm_x", "ppm_y", "mean_ppm", F.radians("rotation").alias("turn")), "image_id").where(dx * dx + dy * dy < near * near)
    one = F.struct("plant_id", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"), F.col("radius_mm").cast("double").alias("radius_mm"), core_px(F.col("radius_mm"), F.col("mean_ppm")).alias("core"))
    return rows.groupBy("image_id").agg(F.sort_array(F.collect_list(one)).alias("seeds"), *[F.first(c).alias(c) for c in ("ppm_x", "ppm_y", "mean_ppm", "turn")])


def _distances(labels: np.ndarray, y0: int, x0: int, seeds: list[dict]):
    """Pixels of a tile in an island, and their squared distances to each seed."""
    y, x = np.nonzero(labels)
    dx = x[None, :] + x0 - np.array([s["cx"] for s in seeds])[:, None]
    dy = y[None, :] + y0 - np.array([s["cy"] for s in seeds])[:, None]
    return y, x, dx, dy, dx * dx + dy * dy


def _tile(row) -> np.ndarray:
    return np.frombuffer(row["labels"], np.int32).reshape(row["height"], row["width"])


def _facts(batches):
    for batch in batches:
        for row in batch.to_pylist():
            labels, seeds = _tile(row), row["seeds"]
            y, x, dx, dy, far2 = _distances(labels, row["y0"], row["x0"], seeds)
            own, at = np.unique(labels[y, x], return_inverse=True)
            nearest = far2.argmin(axis=0)
            cos, sin = np.cos(row["turn"]), np.sin(row["turn"])
            mm = np.hypot((cos * dx - sin * dy) / row["ppm_x"], (sin * dx + cos * dy) / row["ppm_y"])
            area = np.bincount(at, minlength=len(own))
            box = [np.full(len(own), 1 << 30), np.full(len(own), 1 << 30), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)]
            for k, v in ((0, x + row["x0"]), (1, y + row["y0"])):
                np.minimum.at(box[k], at, v)
                np.maximum.at(box[k + 2], at, v + 1)
            prior = {p["plant_id"]: p["mask"] for p in row["history"] or ()}
            for s, seed in enumerate(seeds):
                mine = nearest == s
                near, far, near_mm = np.full(len(own), np.inf), np.full(len(own), -np.inf), np.full(len(own), np.inf)
                np.minimum.at(near, at, far2[s])
                np.maximum.at(far, at[mine], far2[s, mine])
                np.minimum.at(near_mm, at[mine], mm[s, mine])
                before = np.zeros(len(own), bool)
                if seed["plant_id"] in prior:
                    mask = R.unpack(prior[seed["plant_id"]], row["image_height"], row["image_width"])
                    np.logical_or.at(before, at, mask[y + row["y0"], x + row["x0"]])
                columns = [np.full(len(own), row["image_id"]), own, np.full(len(own), s), np.bincount(at[mine], minlength=len(own)), area, *box, np.sqrt(near), np.sqrt(np.maximum(far, 0)), near_mm, near <= seed["core"] ** 2, before]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, _FACT_TYPES, strict=True)], schema=_FACT_TYPES)


def verdicts(facts: DataFrame, frames: DataFrame, seeds: DataFrame, margin_mm: float) -> DataFrame:
    """(image_id, label, seed, owned, doubtful, uncertain) of every island and plant that is nearest to a part of it.

    A part is owned if the island comes into the plant's core, if an earlier mask
    of the plant overlaps it and it stays within reach, or if the centre is out
    of the frame and the part meets the expected canopy. What is not owned but
    near and large, or overlaps the earlier mask, is doubtful. Islands of an
    implausible size count for nothing, long thin ones only if they reach a core.
    """
    whole = facts.groupBy("image_id", "label", "seed").agg(
        *[F.sum(c).alias(c) for c in ("pixels", "area")], *[F.min(c).alias(c) for c in ("x0", "y0", "nearest_px", "nearest_mm")], *[F.max(c).alias(c) for c in ("x1", "y1", "farthest_px")], *[F.bool_or(c).alias(c) for c in ("in_core", "prior")]
    )
    cores = whole.groupBy("image_id", "label").agg(F.bool_or("in_core").alias("any_core"))
    plants = seeds.select("image_id", "mean_ppm", "ppm_x", "ppm_y", F.posexplode("seeds").alias("seed", "s")).select("*", "s.*").drop("s")
    limits = frames.select("image_id", "height", "width", "min_area", "max_area", "line_area")
    rows = whole.where("pixels > 0").join(cores, ["image_id", "label"]).join(plants, ["image_id", "seed"]).join(limits, "image_id")
    long, short = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    line = (long > 9 * short) & (F.col("area") > F.col("line_area"))
    rows = rows.where(F.col("area").between(F.col("min_area"), F.col("max_area")) & (~line | F.col("any_core")))
    r = F.col("radius_mm")
    history = F.col("prior") & (F.col("farthest_px") <= F.greatest(r * HISTORY["factor"], r + HISTORY["extra"]) * F.col("mean_ppm"))
    outside = ~((F.col("cx") >= 0) & (F.col("cx") < F.col("width")) & (F.col("cy") >= 0) & (F.col("cy") < F.col("height")))
    canopy = F.col("nearest_mm") <= F.greatest(F.lit(CANOPY["least"]), r * CANOPY["factor"], r + margin_mm)
    owned = F.col("in_core") | history | (outside & canopy)
    soft = F.col("nearest_px") < F.greatest(r * SOFT["factor"], r + SOFT["extra"]) * F.col("mean_ppm")
    large = F.col("area") / (F.col("ppm_x") * F.col("ppm_y")) >= LARGE_MM2
    return rows.select("image_id", "label", "seed", "plant_id", owned.alias("owned"), (~owned & ((soft & large) | F.col("prior"))).alias("doubtful"), (~owned & (soft | F.col("prior"))).alias("uncertain"))


def _assigned(batches):
    schema = pa.schema([("image_id", pa.int64()), ("y", pa.int32()), ("x", pa.int32()), ("plant_id", pa.int64()), ("ambiguous", pa.bool_())])
    for batch in batches:
        for row in batch.to_pylist():
            labels, seeds = _tile(row), row["seeds"]
            y, x, _, _, far2 = _distances(labels, row["y0"], row["x0"], seeds)
            nearest = far2.argmin(axis=0)
            two = np.sqrt(np.sort(far2, axis=0)[:2])
            close = two[-1] - two[0] < max(AMBIGUOUS_MM, AMBIGUOUS_MM * row["mean_ppm"]) if len(seeds) > 1 else np.zeros(len(x), bool)
            state = np.zeros((int(labels.max()) + 1, len(seeds)), np.int8)
            for v in row["said"] or ():
                if v["label"] < len(state):
                    state[v["label"], v["seed"]] = 1 if v["owned"] else 2 if v["doubtful"] else 0
            own = state[labels[y, x], nearest]
            at = np.flatnonzero(own)
            plant = np.array([s["plant_id"] for s in seeds])[nearest[at]]
            columns = [np.full(len(at), row["image_id"]), y[at] + row["y0"], x[at] + row["x0"], plant, (own[at] == 2) | close[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type, mask=own[at] == 2 if f.name == "plant_id" else None) for c, f in zip(columns, schema, strict=True)], schema=schema)


def owned_pixels(frames: DataFrame, plants: DataFrame, history: DataFrame | None = None, margin_mm: float = 20.0, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(pixels, verdicts): rows (image_id, y, x, plant_id, ambiguous) of all owned or doubtful pixels, and what was said of each island and plant.

    frames are scaled images with rotation and mask, plants are (image_id,
    plant_id, cx, cy, radius_mm), history (image_id, plant_id, mask) of the same
    size. A pixel goes to its nearest plant, of equally near ones to the first
    by id; it is ambiguous if the second is hardly further. Doubtful pixels have
    no plant.
    """
    seeds = seeds_of(plants, frames, margin_mm)
    sizes = frames.select("image_id", F.col("height").alias("image_height"), F.col("width").alias("image_width"))
    tiles = labelled_tiles(frames, tile).join(seeds, "image_id").join(sizes, "image_id")
    if history is None:
        past = tiles.withColumn("history", F.lit(None).cast("array<struct<plant_id: bigint, mask: binary>>"))
    else:
        past = tiles.join(history.groupBy("image_id").agg(F.collect_list(F.struct("plant_id", "mask")).alias("history")), "image_id", "left")
    said = verdicts(past.mapInArrow(_facts, _FACTS), frames, seeds, margin_mm)
    back = said.groupBy("image_id").agg(F.collect_list(F.struct("label", "seed", "owned", "doubtful")).alias("said"))
    return tiles.join(back, "image_id").mapInArrow(_assigned, "image_id long, y int, x int, plant_id long, ambiguous boolean"), said
