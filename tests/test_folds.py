"""Folds and ranks over partitions, and the verifier's fit, against plain loops."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from canopia.operators import folds, planning, store, verifier


def test_folds_go_over_batches_and_keys(spark):
    rng = random.Random(1)
    rows = [(k, t) for k in range(7) for t in rng.sample(range(100_000), 3000)]
    df = spark.createDataFrame(rows, "k long, t long").repartition(5)
    expected = {}
    for k, t in sorted(rows):
        anchor = expected.get((k, "a"))
        if anchor is None or t - anchor > 500:
            expected[k, "a"] = anchor = t
        expected[k, t] = anchor
    found = store.time_clusters(df.select("k", F.timestamp_seconds("t").alias("created_at")), "k", 500).select("k", F.unix_timestamp("created_at").alias("t"), "anchor").collect()
    assert {(r.k, r.t): r.anchor for r in found} == {x: a for x, a in expected.items() if x[1] != "a"}


def test_groups_of_an_axis_with_nulls(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice((None, float(rng.randrange(900))))) for k in range(3) for _ in range(200)]
    found = planning.axis_groups(spark.createDataFrame(rows, "k long, v double"), "k", "v", 9.0).collect()
    expected = []
    for k in range(3):
        run = []
        for v in sorted(v for x, v in rows if x == k and v is not None):
            if run and abs(v - sum(run) / len(run)) > 9 and v != run[-1]:
                expected.append((k, round(sum(run) / len(run), 6), len(run)))
                run = []
            run.append(v)
        expected.append((k, round(sum(run) / len(run), 6), len(run)))
    assert sorted((r.k, round(r.position, 6), r.members) for r in found) == sorted(expected)


def test_ranks_are_places_in_the_order(spark):
    values = random.Random(3).sample(range(10**6), 5000)
    found = folds.ranked(spark.createDataFrame([(str(v),) for v in values], "v string").repartition(9), ["v"]).collect()
    assert {r.v: r["rank"] for r in found} == {v: k for k, v in enumerate(sorted(map(str, values)))}
    assert folds.ranked(spark.createDataFrame([], "v string"), ["v"]).collect() == []


def test_scores_equal_a_newton_fit(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3)) * (1, 5, 0.2) + (0, 3, 1)
    y = (x @ (1.5, -0.3, 4.0) + rng.normal(size=600) > 3.2).astype(float)
    rows = [(k, k // 5, float(y[k]), *map(float, x[k])) for k in range(600)]
    found = {r.id: (r.held_out, r.score) for r in verifier.held_out_scores(spark.createDataFrame(rows, "id long, image long, label double, a double, b double, c double"), "label", "image", ["a", "b", "c"]).collect()}
    names = sorted({str(k // 5) for k in range(600)})
    held = np.array([names.index(str(k // 5)) % 4 == 0 for k in range(600)])
    assert all(found[k][0] == held[k] for k in range(600))
    own, label = x[~held], y[~held]
    mean, scale = own.mean(axis=0), own.std(axis=0)
    z = np.column_stack(((own - mean) / scale, np.ones(len(own))))
    w = np.where(label == 1, len(label) / (2 * label.sum()), len(label) / (2 * (1 - label).sum()))
    ridge, beta = np.diag([0.015] * 3 + [0.0]), np.zeros(4)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = z.T @ (w * (p - label)) / w.sum() + ridge @ beta
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + ridge, grad)
    logit = np.column_stack(((x - mean) / scale, np.ones(600))) @ beta + np.log(label.sum() / (len(label) - label.sum()))
    expected = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    assert max(abs(found[k][1] - expected[k]) for k in range(600)) < 2e-3
    assert ((expected > 0.5) == y)[held].mean() > 0.85
