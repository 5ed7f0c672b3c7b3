"""The weed verifier: held-out images, a weighted logistic model, thresholds and their bounds."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.operators import folds
from canopia.operators.geometry import wilson_lower
from canopia.sources.shared import cut


def grouped_split(samples: DataFrame, group: str, every: int = 4) -> DataFrame:
    """ml3: adds `held_out`: every fourth group in the order of its text, all its samples together."""
    groups = folds.ranked(samples.select(F.col(group).cast("string").alias("_g")).distinct(), ["_g"], "_r")
    held = groups.select("_g", (F.col("_r") % every == 0).alias("held_out"))
    return samples.withColumn("_g", F.col(group).cast("string")).join(held, "_g").drop("_g")


class Model:
    """ml2, ml5: standard scores, weights and the prior's log odds; scores are expressions, without a UDF."""

    def __init__(self, features: list[str], means: list[float], scales: list[float], weights: list[float], bias: float):
        self.features, self.means, self.scales, self.weights, self.bias = features, means, scales, weights, bias

    def score(self) -> Column:
        """ml5: a missing feature counts as 0; the logit is held within 30."""
        logit = F.lit(self.bias)
        for f, m, s, w in zip(self.features, self.means, self.scales, self.weights, strict=True):
            logit = logit + (F.coalesce(F.col(f), F.lit(0.0)) - m) / s * w
        return 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), logit))))


def train(samples: DataFrame, label: str, features: list[str], least: int = 4, ridge: float = 0.015) -> Model | None:
    """ml1, ml2: a ridge logistic model with balanced classes, shifted back to the classes' odds; none below `least` a class.

    The solver is Spark's own: each step is one pass with partial sums, so
    samples stay where they are.
    """
    filled = samples.select(F.col(label).cast("double").alias("label"), *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in features])
    facts = filled.agg(F.count("*").alias("n"), F.sum("label").alias("pos"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    n, pos = facts["n"], facts["pos"] or 0
    if pos < least or n - pos < least:
        return None
    means, scales = [facts[f"m_{f}"] for f in features], [facts[f"s_{f}"] or 1.0 for f in features]
    scaled = filled.select("label", F.when(F.col("label") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))).alias("w"), *[((F.col(f) - m) / s).alias(f) for f, m, s in zip(features, means, scales, strict=True)])
    vectors = VectorAssembler(inputCols=features, outputCol="x").transform(scaled)
    fit = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=ridge, standardization=False, maxIter=50).fit(vectors)
    return Model(features, means, scales, [float(v) for v in fit.coefficients], float(fit.intercept) + math.log(pos / (n - pos)))


def threshold_curve(scored: DataFrame, digits: int | None = 4) -> DataFrame:
    """ml4, agg15: counts, precision, recall, F1 and the precision's lower bound at each score to three decimals, and at 0.5.

    scored: score, actual (boolean). Shares are rounded to `digits`, if given. Scores fall into at most 1001 steps, so the
    suffix sums run over that many rows however many samples there are.
    """
    at = lambda k: k / 1000.0
    low = F.floor(F.col("score") * 1000)
    step = F.when(at(low) > F.col("score"), low - 1).when(at(low + 1) <= F.col("score"), low + 1).otherwise(low)  # the last threshold it reaches
    counts = scored.groupBy(step.alias("k")).agg(F.count_if("actual").alias("p"), F.count_if(~F.col("actual")).alias("n"))
    asked = scored.select(F.round(F.col("score") * 1000).cast("long").alias("k")).distinct().unionByName(scored.sparkSession.range(1).select(F.lit(500).cast("long").alias("k"))).distinct()
    both = counts.withColumn("asked", F.lit(False)).unionByName(asked.select("k", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    steps = both.groupBy("k").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))
    down = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    rows = steps.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down)})
    rows = rows.withColumns({"fn": F.sum("p").over(W.partitionBy()) - F.col("tp"), "tn": F.sum("n").over(W.partitionBy()) - F.col("fp")}).where("asked")
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = rows.withColumns({"precision": precision, "recall": recall}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    bound = wilson_lower(F.col("tp"), F.col("tp") + F.col("fp"))
    return rows.select(at(F.col("k")).alias("threshold"), "tp", "fp", "fn", "tn", *[(F.round(v, digits) if digits is not None else v).alias(n) for n, v in (("precision", F.col("precision")), ("recall", F.col("recall")), ("f1", F.col("f1")), ("bound", bound))])


def operating_point(curve: DataFrame, target: float = 0.95) -> DataFrame:
    """ml4: one row: the middle of the thresholds with the best recall among those whose bound meets the target, else with the best F1."""
    marked = curve.withColumn("_ok", (F.col("bound") >= target) & (F.col("tp") > 0))
    whole = W.partitionBy()  # at most 1001 rows
    marked = marked.withColumn("_any", F.bool_or("_ok").over(whole))
    value = F.when(F.col("_any"), F.when(F.col("_ok"), F.col("recall"))).otherwise(F.col("f1"))
    tied = marked.withColumn("_v", value).withColumn("_best", F.max("_v").over(whole)).where("_v = _best")
    return tied.agg(F.array_sort(F.collect_list("threshold")).alias("t")).select(F.element_at("t", (F.floor(F.size("t") / 2) + 1).cast("int")).alias("threshold"))


def held_out_scores(samples: DataFrame, label: str, group: str, features: list[str]) -> DataFrame:
    """ml1 to ml5: every sample's score by the model of the images that are not held out; no rows if it cannot be trained."""
    # features are worked out once: the split, each step of the fit and the scores read what is written
    split = cut(grouped_split(cut(samples), group))
    model = train(split.where("NOT held_out"), label, features)
    if model is None:
        return split.withColumn("score", F.lit(None).cast("double")).limit(0)
    return split.withColumn("score", model.score())
