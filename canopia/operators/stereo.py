"""soi1 to soi5: disparities of the soil from three frames a measurement, as rows for soi7.

A frame is a row (measurement_id, lateral_mm, x, y, z, height, width, grey,
usable): grey a byte a pixel, usable a bit a pixel or null. Pairs are a self
join on the frames' order; a task estimates one pair; the gates are columns.
Matching sums differences over blocks instead of along paths, so its disparities
are close to, not equal to, those of semi-global matching.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.functions import rasters as R
from canopia.functions import stereo
from canopia.sources.shared import cut

#: The shortest baseline in millimetres, and the gates of a pair.
LEAST_BASELINE = 4.99
GATES = {"coverage": 0.03, "support": 0.50, "lr_error": 1.5, "mad": 2.0}

_MADE = "measurement_id long, pair int, baseline double, disparity double, normalised double, coverage double, support double, lr_error double, mad double, error string"
_TYPES = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[t]) for n, t in (c.split() for c in _MADE.split(", "))])
FRAME = ("x", "y", "z", "height", "width", "grey", "usable")


def pairs_of(frames: DataFrame) -> DataFrame:
    """(measurement_id, pair, baseline, a_..., b_...) of measurements with exactly three frames: pairs 0 and 1 of neighbours, 2 of the outer ones."""
    by = W.partitionBy("measurement_id")
    ordered = frames.withColumns({"_k": F.row_number().over(by.orderBy("lateral_mm", "x", "y")) - 1, "_n": F.count("*").over(by)}).where("_n = 3")
    side = lambda p: ordered.select("measurement_id", F.col("_k").alias(f"{p}_k"), *[F.col(c).alias(f"{p}_{c}") for c in FRAME])
    both = side("a").join(side("b"), "measurement_id").where("a_k < b_k")
    pair = F.when(F.col("b_k") - F.col("a_k") == 2, 2).otherwise(F.col("a_k"))
    return both.withColumns({"pair": pair.cast("int"), "baseline": F.hypot(F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y"))}).drop("a_k", "b_k")


def _estimates(pairs: DataFrame) -> DataFrame:
    """pairs with `expected`, or null, as rows of what `stereo.estimate` finds, or of why it finds nothing."""

    def one(row: dict) -> dict:
        own = {"measurement_id": row["measurement_id"], "pair": row["pair"], "baseline": row["baseline"], "error": None}
        if not np.isfinite(row["baseline"]) or row["baseline"] < LEAST_BASELINE:
            return own | {"error": "the baseline is too small"}
        if (row["a_height"], row["a_width"]) != (row["b_height"], row["b_width"]):
            return own | {"error": "the frames differ in size"}
        size = row["a_height"], row["a_width"]
        grey = [np.frombuffer(row[f"{p}_grey"], np.uint8).reshape(size).astype(np.float64) for p in "ab"]
        clear = [np.ones(size, bool) if row[f"{p}_usable"] is None else R.unpack(row[f"{p}_usable"], *size) for p in "ab"]
        try:
            return own | stereo.estimate(*grey, clear[0] & clear[1], row["baseline"], row["expected"], GATES["lr_error"])
        except ValueError as why:
            return own | {"error": str(why)}

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([one(batch.slice(k, 1).to_pylist()[0])], schema=_TYPES)

    return pairs.mapInArrow(run, _MADE)


def passes() -> Column:
    """soi4: whether a pair's geometry is good enough."""
    c = F.col
    return c("error").isNull() & (c("coverage") >= GATES["coverage"]) & (c("support") >= GATES["support"]) & (c("lr_error") <= GATES["lr_error"]) & (c("mad") <= GATES["mad"])


def estimate_triplets(frames: DataFrame) -> DataFrame:
    """soi5: up to three rows a measurement: pair, baseline, disparity, normalised, the gates' figures, passes, error.

    The outer pair is looked for where the inner ones, whose shift is smaller,
    say it must be. Measurements of which fewer than two pairs succeed have rows
    with errors only.
    """
    pairs = cut(pairs_of(frames))
    inner = cut(_estimates(pairs.where("pair < 2").withColumn("expected", F.lit(None).cast("double"))))
    hint = inner.where("error IS NULL").groupBy("measurement_id").agg(F.median("normalised").alias("_a_mm"))
    outer = pairs.where("pair = 2").join(hint, "measurement_id", "left").withColumn("expected", F.abs("_a_mm") * F.col("baseline")).drop("_a_mm")
    rows = inner.unionByName(_estimates(outer)).withColumn("passes", passes())
    enough = F.count_if(F.col("error").isNull()).over(W.partitionBy("measurement_id")) >= 2
    return rows.withColumn("error", F.when(F.col("error").isNull() & ~enough, "fewer than two pairs succeeded").otherwise(F.col("error"))).withColumn("passes", F.col("passes") & F.col("error").isNull())


def triplets(frames: DataFrame, estimates: DataFrame) -> DataFrame:
    """The rows that soi7 takes: measurement_id, camera_z, z_spread, pairs."""
    z = frames.groupBy("measurement_id").agg(F.median("z").alias("camera_z"), (F.max("z") - F.min("z")).alias("z_spread"))
    one = F.struct("pair", F.col("normalised").alias("disparity"), "passes", "coverage", "support", "lr_error", "mad")
    return z.join(estimates.where("error IS NULL").groupBy("measurement_id").agg(F.collect_list(one).alias("pairs")), "measurement_id")
