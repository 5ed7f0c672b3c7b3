"""Growth curves in long form: rows of key, day and diameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_POINTS = 10


def spaced(position: Column, count: Column, most: Column) -> Column:
    """Whether a position (from 0) of `count` is among `most` evenly spaced ones, halves to even."""
    return F.exists(F.sequence(F.lit(0), F.greatest(F.lit(0), most - 1)), lambda k: F.rint(k * (count - 1) / F.greatest(F.lit(1), most - 1)) == position)


def isotonic(bins: DataFrame, key: str, at: str, value: str, weight: str) -> DataFrame:
    """agg7: weighted non-decreasing least-squares fit of each key's ordered bins, as `fitted`.

    The fit at i is the largest, over starts j up to i, of the smallest mean of
    j..k over ends k from i on. Prefix sums give each mean; a running minimum
    per start leaves one row a pair of bins, so the work is the square of a
    key's bins, which time bounds, not its observations.
    """
    by = W.partitionBy(key).orderBy("_j").rowsBetween(W.unboundedPreceding, 0)
    sums = bins.select(key, F.col(at).alias("_j"), (F.col(value) * F.col(weight)).alias("_vw"), F.col(weight).alias("_w"))
    sums = sums.withColumns({"_sv": F.sum("_vw").over(by), "_sw": F.sum("_w").over(by)})
    ends = sums.select(key, F.col("_j").alias("_k"), F.col("_sv").alias("_ev"), F.col("_sw").alias("_ew"))
    pairs = sums.join(ends, key).where("_k >= _j")
    mean = (F.col("_ev") - F.col("_sv") + F.col("_vw")) / (F.col("_ew") - F.col("_sw") + F.col("_w"))
    lowest = F.min(mean).over(W.partitionBy(key, "_j").orderBy(F.desc("_k")).rowsBetween(W.unboundedPreceding, 0))
    fit = pairs.select(key, "_k", lowest.alias("_m")).groupBy(key, F.col("_k").alias(at)).agg(F.max("_m").alias("fitted"))
    return bins.join(fit, [key, at])


def fit_curve(rows: DataFrame, key: str, margin: float = 0.0, quantile: float = 0.9, bin_days: int = 3) -> DataFrame:
    """agg6: key, day, diameter_mm: a quantile of radius per age bin, made non-decreasing, at most ten points.

    rows has age_days and radius; negative ages count as 0.
    """
    day = (F.floor(F.greatest(F.lit(0), F.col("age_days")) / bin_days) * bin_days).cast("long")
    bins = rows.where("age_days IS NOT NULL AND radius IS NOT NULL").groupBy(key, day.alias("day"))
    bins = bins.agg((F.percentile("radius", F.lit(quantile)) + margin).alias("upper"), F.count("*").alias("n"))
    fitted = isotonic(bins, key, "day", "upper", "n")
    by = W.partitionBy(key)
    ranked = fitted.withColumns({"_p": F.row_number().over(by.orderBy("day")) - 1, "_c": F.count("*").over(by)})
    kept = ranked.where((F.col("_c") <= MOST_POINTS) | spaced(F.col("_p"), F.col("_c"), F.lit(MOST_POINTS)))
    return kept.select(key, "day", F.round(F.col("fitted") * 2, 1).alias("diameter_mm"))


def insert_points(curves: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """dec4, win8: each key's curve with its new point put in or replaced, thinned to ten.

    First, last and new point stay; the others are evenly spaced. Both frames
    are (key, day, diameter_mm), points with one row a key.
    """
    new = points.select(key, F.col("day").alias("_new"), "diameter_mm")
    kept = curves.join(new.select(key, "_new"), key).where("day <> _new").select(key, "day", "diameter_mm", "_new")
    merged = kept.unionByName(new.select(key, F.col("_new").alias("day"), "diameter_mm", "_new"))
    by = W.partitionBy(key)
    merged = merged.withColumns({"_p": F.row_number().over(by.orderBy("day")), "_c": F.count("*").over(by)})
    must = (F.col("_p") == 1) | (F.col("_p") == F.col("_c")) | (F.col("day") == F.col("_new"))
    merged = merged.withColumn("_must", must).withColumn("_fixed", F.count_if("_must").over(by))
    free = W.partitionBy(key, "_must").orderBy("day")
    merged = merged.withColumn("_f", F.row_number().over(free) - 1)
    chosen = F.col("_must") | (F.col("_c") <= MOST_POINTS) | spaced(F.col("_f"), F.col("_c") - F.col("_fixed"), MOST_POINTS - F.col("_fixed"))
    return merged.where(chosen).select(key, "day", "diameter_mm", (F.col("_c") > MOST_POINTS).alias("downsampled"))


def gate(curves: DataFrame, points: DataFrame, key: str, daily_mm: float, radius_mm: float) -> DataFrame:
    """dec5, win9: `verdict` on each key's new point against the controls before and after its day; the point itself is replaced."""
    new = points.select(key, F.col("day").alias("_day"), F.col("diameter_mm").alias("_d"))
    before, after = F.col("day") < F.col("_day"), F.col("day") > F.col("_day")
    near = new.join(curves, key, "left").groupBy(key, "_day", "_d").agg(
        F.max(F.when(before, F.col("day"))).alias("prev_day"),
        F.max_by("diameter_mm", F.when(before, F.col("day"))).alias("prev_mm"),
        F.min_by("diameter_mm", F.when(after, F.col("day"))).alias("next_mm"),
    )
    rate = (F.col("_d") - F.col("prev_mm")) / F.greatest(F.lit(1), F.col("_day") - F.col("prev_day"))
    verdict = F.when(F.col("_d") < F.col("prev_mm"), "falls after previous").when(F.col("_d") > F.col("next_mm"), "exceeds next").when(rate > 2 * daily_mm, "grows too fast").when(F.col("_d") > 2 * radius_mm, "too large").otherwise("ok")
    return near.select(key, F.col("_day").alias("day"), F.col("_d").alias("diameter_mm"), verdict.alias("verdict"))


def neighbours(curves: DataFrame, key: str) -> DataFrame:
    """win9: each control point (key, day, diameter_mm) with the diameters before and after it."""
    by = W.partitionBy(key).orderBy("day")
    return curves.withColumns({"before_mm": F.lag("diameter_mm").over(by), "after_mm": F.lead("diameter_mm").over(by)})
