"""Checks of image metadata and writes to the measurement store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopia.operators import reviews

DIMENSIONS = ("source_width", "source_height", "oriented_width", "oriented_height", "scale_x", "scale_y")


def positive(value: Column) -> Column:
    """hlp1: a finite number above zero."""
    return value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))


def dimension_fault(tolerance: float = 0.03) -> Column:
    """cal8: what is wrong with an image's dimensions (width, height and DIMENSIONS), null if nothing is; images without any of them pass."""
    present = sum(F.col(n).isNotNull().cast("int") for n in DIMENSIONS)
    sx, sy = F.col("scale_x"), F.col("scale_y")
    source, turned = (F.array_sort(F.array(f"{p}_width", f"{p}_height")) for p in ("source", "oriented"))
    ex, ey = F.col("width") / F.col("oriented_width"), F.col("height") / F.col("oriented_height")
    return (
        F.when(present == 0, None)
        .when(present < len(DIMENSIONS), "incomplete")
        .when(~(positive(sx) & positive(sy)), "scale not positive")
        .when(source != turned, "not a rotation")
        .when((F.col("width") > F.col("oriented_width")) | (F.col("height") > F.col("oriented_height")), "upscaled")
        .when(F.abs(sx - ex) > tolerance * ex + 1e-6, "scale_x inconsistent")
        .when(F.abs(sy - ey) > tolerance * ey + 1e-6, "scale_y inconsistent")
        .when(F.abs(sx - sy) > tolerance * F.greatest(sx, sy), "distorted")
    )


def processed_verdict() -> Column:
    """cal1: used, or why the calibration that came with the image (available, basis, p_width, p_height, ppm_x, ppm_y) is not."""
    return (
        F.when(~F.coalesce("available", F.lit(False)), "none")
        .when(~F.col("basis").eqNullSafe("processed_image"), "basis")
        .when(~(F.col("p_width").eqNullSafe(F.col("width")) & F.col("p_height").eqNullSafe(F.col("height"))), "dimensions")
        .when(~(positive(F.col("ppm_x")) & positive(F.col("ppm_y"))), "scales")
        .otherwise("used")
    )


def written(stored: DataFrame, fresh: DataFrame, decisions: DataFrame) -> DataFrame:
    """dec15: the store after a write: a row replaces that of its measurement_id; rows of the same plant and image but the last are marked `superseded`."""
    rows = stored.join(fresh.select("measurement_id"), "measurement_id", "left_anti").unionByName(fresh)
    gone = reviews.superseded(rows, decisions.limit(0)).select("measurement_id", F.lit(True).alias("superseded"))
    earlier = decisions.where("action = 'superseded'").select("measurement_id", F.lit(True).alias("_earlier")).distinct()
    marked = rows.join(gone, "measurement_id", "left").join(earlier, "measurement_id", "left")
    return marked.withColumn("superseded", F.coalesce("superseded", "_earlier", F.lit(False))).drop("_earlier")


def set_values(rows: DataFrame, values: DataFrame, key: str, only: Column) -> DataFrame:
    """can5: the rows with a plant's values (key and columns of the same names) in place of their own, where `only` holds and the plant has values."""
    names = [n for n in values.columns if n != key]
    both = rows.join(values.select(key, F.struct(*names).alias("_new")), key, "left")
    return both.withColumns({n: F.when(only & F.col("_new").isNotNull(), F.col(f"_new.{n}")).otherwise(F.col(n)) for n in names}).drop("_new")
