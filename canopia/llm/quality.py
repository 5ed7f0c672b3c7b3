"""Quality classifier: supervised subword embeddings.

Hashed word and character n-gram vectors are averaged per document and feed a
softmax; both layers are learned by stochastic gradient descent in numpy on a
bounded sample of labelled rows (`max_train`, about that many, chosen by a hash
of the id). Scoring is exact for the learned model: the mean of vectors times
the output layer is the mean of per-bucket logits, so a document costs one
table lookup a feature, and no shuffle.

Defined results: an empty or null text scores by the bias alone; rows without
label, with a null label or with contradicting labels teach nothing; of several
texts of a labelled doc_id the one of the least hash teaches; without any label
(or with one class only) every score is 0.5 or that class's share; very long
texts are scored whole; repeated rows each give a row; other columns are never
read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.llm.common import is_held_out, table
from canopia.llm.features import Grams, sampled, scored, training_vectors

GRAMS = Grams(chars=(2, 4), words=(1, 2), bits=16, lower=False)
MAX_TRAIN = 4000
DIM, EPOCHS, RATE = 12, 5, 0.2


def train(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, float]:
    """Per-bucket logits for label 1 and the bias, from mean vectors and 0/1 labels."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim))
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    emb_seen, out_seen = np.full(1 << bits, 1e-6), np.full(2, 1e-6)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    own = np.sqrt(0.5 / np.maximum(share, 1e-3))  # the rarer class counts more, half-way to equal parts
    steps = [i for i in range(len(labels)) if len(vectors[i][0])]
    for epoch in range(epochs if steps else 0):
        lr = rate * (1 - epoch / epochs)
        for i in rng.permutation(steps):
            bucket, part = vectors[i]
            rows = emb[bucket]
            mean = part @ rows
            p = np.exp((z := mean @ out + bias) - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= own[labels[i]]
            back = out @ p
            out_seen += p * p
            step = lr * p / np.sqrt(out_seen)
            out -= np.outer(mean, step)
            bias -= 0.1 * step
            grad = np.outer(part, back)
            emb_seen[bucket] += (grad * grad).mean(axis=1)
            emb[bucket] = rows - lr * grad / np.sqrt(emb_seen[bucket])[:, None]
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float32)[:, None], float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, grams: Grams = GRAMS) -> tuple[np.ndarray, float]:
    """The model from docs (doc_id, text) and labels (doc_id, label 0 or 1), already limited to rows that may teach."""
    clear = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("most")).where("label = most").drop("most")
    n = clear.count()
    few = clear.where(sampled(min(1.0, max_train / max(n, 1)))).limit(2 * max_train)
    # few has at most 2 * max_train rows
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    _, y, vectors = training_vectors(rows, grams, "label")
    if len(set(y)) < 2:
        return np.zeros((1 << grams.bits, 1), np.float32), {(): 0.0, (0,): -20.0, (1,): 20.0}[tuple(set(y.tolist()))]
    return train(vectors, y, grams.bits)


def score(docs: DataFrame, model: tuple[np.ndarray, float], grams: Grams = GRAMS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, keep...): the probability of label 1, a row per row of docs."""
    weights, bias = model

    def finish(texts, total, n):
        return [1 / (1 + np.exp(-np.clip(total[:, 0] / np.maximum(n, 1) + bias, -700, 700)))]

    return scored(docs, finish, "score double", grams, weights, keep)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: quality of every document, learned from rows whose crc32 modulo 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~is_held_out(F.col("doc_id"), 3, 1)))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", is_held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
