"""Quality rules: an isolation forest over rule statistics.

One map-only pass counts, for every whole text, words, symbols, repeated lines
and windows and the like; base rules fail a text at once. Of the statistics'
shares forests of random splits are grown on a bounded sample of distinct rows
(`SAMPLE`), so a group of copies counts once: rows that few splits set apart
are anomalous. The score is 2 ** -(mean path length / expected length), from 0
to 1. A forest is grown for each of VIEWS, as a statistic in which good texts
differ much hides others. View and threshold come from all labelled rows:
scores are counted in bins by label, and the view and bin are taken that tell
good from bad best among those that keep KEEP of the good ones.

Defined results: a null text has no words; words are runs of anything but ASCII
white space; very long texts are counted whole, a piece at a time; a text of
fewer than three words has no window; rows without label or with contradicting
labels do not calibrate; without good and bad labelled rows that pass the base
rules the forest drops nothing; ties of views go to the first, of bins to the higher,
which keeps more;
repeated rows and rows without doc_id each give a row; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.llm.common import table, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
#: Bounds: distinct rows that the driver grows trees on, rows a tree, trees.
SAMPLE, ROWS, TREES = 16384, 256, 100
#: Share of labelled good rows that the threshold keeps at least, and bins of scores.
KEEP, BINS = 0.99, 4096
#: The shares a forest may split: those that `shares` returns.
SHARES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "line_length")
VIEWS = (SHARES, ("word_length", "symbols", "dup_lines", "repeats", "upper"), ("word_length", "symbols", "repeats", "upper"), ("word_length", "symbols", "repeats"), ("word_length", "symbols", "upper"))
MIN_WORDS, MAX_REPEATED = 50, 50
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20

SPACES = b" \t\n\x0b\x0c\r"
SPACE = re.compile(b"[ \t\n\x0b\x0c\r]")
CONTINUED = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in SYMBOLS)


def _pieces(text: bytes, size: int, cut) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        stop = cut(at + size) if at + size < len(text) else -1
        stop = len(text) if stop < 0 else stop + 1
        yield text[at:stop]
        at = stop


def word_ids(text: bytes, size: int = PIECE) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen, fresh, found = {}, count(), []
    for piece in _pieces(text, size, lambda at: m.start() if (m := SPACE.search(text, at)) else -1):
        words = piece.split()
        found.append(np.fromiter(map(seen.setdefault, words, fresh), np.int64, len(words)))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Words inside windows of that many words which occur twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n]
    for k in range(1, width):
        _, key = np.unique(key, return_inverse=True)
        key = key * (int(ids.max()) + 1) + ids[k : k + n]
    _, key, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[key] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_counts(text: bytes, size: int = PIECE) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier one."""
    seen, n = set(), 0
    for piece in _pieces(text, size, lambda at: text.find(b"\n", at)):
        lines = [x for x in (piece[:-1] if piece.endswith(b"\n") else piece).split(b"\n") if x.strip()]
        n += len(lines)
        seen.update(lines)
    return n, n - len(seen)


def _without(text: bytes, some: bytes) -> int:
    return len(text) - len(text.translate(None, some))


def counts_of(text: bytes | None, size: int = PIECE) -> tuple[int, ...]:
    """COUNTS of one text."""
    text = text or b""
    ids = word_ids(text, size)
    n_lines, n_dup = line_counts(text, size)
    chars = len(text) - _without(text, CONTINUED) - _without(text, SPACES)
    return len(ids), chars, _without(text, SYMBOLS), n_dup, repeated_words(ids), n_lines, _without(text, UPPER), _without(text, DIGITS), _without(text, MARKS)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS, base_failed), a row per row of docs."""

    def run(batches):
        for batch in batches:
            made = np.array([counts_of(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in made.T)], ["doc_id", *COUNTS])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    counted = narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def shares(n: np.ndarray) -> np.ndarray:
    """SHARES, from rows of COUNTS."""
    words, chars, symbols, dup, repeat, lines, upper, digits, marks = np.maximum(n.T, 0).astype(np.float64)
    per_word, per_char, per_line = (np.maximum(x, 1) for x in (words, chars, lines))
    return np.column_stack((chars / per_word, symbols / per_char, dup / per_line, repeat / per_word, upper / per_char, digits / per_char, marks / per_char, np.log1p(words / per_line)))


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.maximum(np.asarray(n, np.float64), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class Forest(NamedTuple):
    """Trees as complete binary heaps: what a node splits (-1: a leaf), where, and the path length that ends there."""

    feature: np.ndarray
    value: np.ndarray
    length: np.ndarray
    rows: int


def grow(x: np.ndarray, trees: int = TREES, rows: int = ROWS, seed: int = 5) -> Forest:
    """A forest over samples of the rows of x."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    depth = max(1, math.ceil(math.log2(max(rows, 2))))
    size = (1 << depth + 1) - 1
    forest = Forest(np.full((trees, size), -1, np.int32), np.zeros((trees, size)), np.zeros((trees, size)), rows)
    for t in range(trees):
        todo = [(0, 0, x[rng.choice(len(x), rows, replace=False)])] if rows else []
        while todo:
            node, level, part = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(high > low)
            if level == depth or not len(wide):
                forest.length[t, node] = level + _expected(len(part))
                continue
            k = int(rng.choice(wide))
            at = rng.uniform(low[k], high[k])
            left = part[:, k] <= at
            forest.feature[t, node], forest.value[t, node] = k, at
            todo += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]
    return forest


def anomaly(forest: Forest, x: np.ndarray) -> np.ndarray:
    """From 0 to 1, higher the fewer splits set a row apart; 0.5 without any row to learn from."""
    total = np.zeros(len(x))
    if not forest.rows:
        return total + 0.5
    row = np.arange(len(x))
    for feature, value, length in zip(forest.feature, forest.value, forest.length, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(int(math.log2(len(feature) + 1)) - 1):
            k = feature[node]
            node = np.where(k < 0, node, 2 * node + 1 + (x[row, np.maximum(k, 0)] > value[node]))
        total += length[node]
    return 2 ** -(total / len(forest.feature) / max(float(_expected(forest.rows)), 1.0))


def fit(stats: DataFrame, sample: int = SAMPLE, views=VIEWS) -> list[tuple[list[int], Forest]]:
    """For each view its columns and a forest of about `sample` distinct rows of statistics that pass the base rules."""
    passed = stats.where("NOT base_failed")
    spread = F.pmod(F.xxhash64(*COUNTS), F.lit(1 << 30))
    n = passed.agg(F.approx_count_distinct(F.xxhash64(*COUNTS))).first()[0]
    rate = min(1.0, sample / max(n, 1))
    # about `sample` rows come to the driver, twice as many at most
    rows = passed.where(spread < int(rate * (1 << 30))).select(*COUNTS).distinct().limit(2 * sample).collect()
    x = shares(np.array(sorted(tuple(r) for r in rows), np.int64).reshape(-1, len(COUNTS)))
    columns = [[SHARES.index(c) for c in view] for view in views]
    return [(c, grow(x[:, c])) for c in columns]


def scored(stats: DataFrame, forests: list[tuple[list[int], Forest]]) -> DataFrame:
    """stats with `bins`, the anomaly score of each view in BINS equal steps."""
    model = stats.sparkSession.sparkContext.broadcast(forests)
    columns = ["doc_id", *COUNTS, "base_failed"]

    def run(batches):
        for batch in batches:
            x = shares(np.column_stack([batch.column(k).to_numpy() for k in range(1, 1 + len(COUNTS))]))
            bins = np.column_stack([np.minimum((anomaly(f, x[:, c]) * BINS).astype(np.int32), BINS - 1) for c, f in model.value])
            at = np.arange(0, bins.size + 1, bins.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(bins.ravel()))], [*columns, "bins"])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "bins array<int>"])
    return stats.select(columns).mapInArrow(run, schema)


def calibrate(scores: DataFrame, labels: DataFrame, label: str = "quality", keep: float = KEEP) -> tuple[int, int]:
    """The view, and its highest bin that is kept, from all labelled rows that pass the base rules; labels are (doc_id, label 0 or 1)."""
    clear = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("good"), F.max(label).alias("most")).where("good = most")
    told = scores.where("NOT base_failed").select("doc_id", F.posexplode("bins").alias("view", "bin")).join(clear, "doc_id")
    best = (-1.0, 0, BINS - 1)
    counts: dict[int, np.ndarray] = {}
    for view, b, good, bad in told.groupBy("view", "bin").agg(F.sum("good"), F.sum(1 - F.col("good"))).collect():
        counts.setdefault(view, np.zeros((BINS, 2)))[b] = good, bad
    for view, n in sorted(counts.items()):
        if (n.sum(axis=0) > 0).all():
            kept = np.cumsum(n, axis=0) / n.sum(axis=0)
            gain = np.where(kept[:, 0] >= keep, kept[:, 0] - kept[:, 1], -1)
            most = int(BINS - 1 - np.argmax(gain[::-1]))
            best = max(best, (float(gain[most]), view, most), key=lambda x: x[0])
    return best[1:]


def judged(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, COUNTS, base_failed, score, kept) of every row of docs."""
    stats = written(statistics(docs))
    scores = written(scored(stats, fit(stats)))
    view, most = calibrate(scores, labels, label)
    own = F.col("bins")[view]
    return scores.select("doc_id", *COUNTS, "base_failed", (own / BINS).alias("score"), (~F.col("base_failed") & (own <= most)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: rule statistics and verdict of every document."""
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
