"""Hashed word and character n-grams of texts, in numpy over many texts at once, and linear scores from them.

A feature is a bucket; a text's vector is the mean over its features. Texts are
taken whole. One of over PIECE characters is worked on in pieces that overlap
where n-grams cross a cut, and each n-gram counts in the piece it starts in, so
the features are those of the whole text. Cuts lie at white space; only a word
that is itself longer than a piece makes its piece longer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopia.llm.common import cut, slices

PIECE = 1 << 19
BASE = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The hash of n-grams of one repeated word, whichever it is: repetition is learned once, not for each word.
REPEATED = np.uint64(0x5DEECE66D)


class Grams(NamedTuple):
    chars: tuple[int, ...]
    words: tuple[int, ...]
    bits: int
    lower: bool


def _bucket(h: np.ndarray, bits: int, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * MIX
    h ^= h >> np.uint64(32)
    h *= MIX
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def words(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each run without ASCII white space starts and ends in the code points (uint64), and its hash."""
    solid = ~((cp == 32) | ((cp >= 9) & (cp <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8), [0]))))
    first, last = edge[::2], edge[1::2]
    power = np.full(len(cp) + 1, BASE)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(cp * power[:-1])))
    back = np.full(len(cp) + 1, INVERSE)
    back[0] = 1
    np.cumprod(back, out=back)
    return first, last, (total[last] - total[first]) * back[first]


class _Piece(NamedTuple):
    """Part of a text: n-grams count that start in the first `own` characters; the rest only completes them."""

    owner: int
    text: str
    own: int


SPACE = re.compile("[\t\n\x0b\x0c\r ]")
SOLID = re.compile("[^\t\n\x0b\x0c\r ]+")


def _tail(text: str, at: int, grams: Grams) -> int:
    """Where the characters end that complete n-grams starting before `at`."""
    end = at + max(grams.chars, default=1) - 1
    seen = at
    for _ in range(max(grams.words, default=1) - 1):
        word = SOLID.search(text, seen)
        if not word:
            return len(text)
        seen = word.end()
    return min(len(text), max(end, seen))


def _pieces(texts: list[str | None], grams: Grams, size: int) -> Iterator[list[_Piece]]:
    """Pieces of the texts, about `size` characters at a time."""
    run, total = [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower() if grams.lower else text or ""
        at = 0
        while at < len(text):
            stop = len(text)
            if at + size < stop and (space := SPACE.search(text, at + size)):
                stop = space.start() + 1
            piece = _Piece(i, text[at : _tail(text, stop, grams)], stop - at)
            if total + len(piece.text) > size and run:
                yield run
                run, total = [], 0
            run.append(piece)
            total += len(piece.text)
            at = stop
    if run:
        yield run


def _bounded(low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.minimum(low, n)
    return low, np.clip(high, low, n)


def _streams(pieces: list[_Piece], grams: Grams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: buckets in text order, and where each piece's run starts and ends."""
    sizes = np.fromiter((len(p.text) for p in pieces), np.int64, len(pieces))
    own = np.fromiter((p.own for p in pieces), np.int64, len(pieces))
    start = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    end = start + sizes
    cp = np.frombuffer("\n".join(p.text for p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(cp), np.uint64)
    done = 0
    for n in sorted(grams.chars):
        h = h[: max(0, len(cp) - n + 1)].copy()
        for k in range(done, n):
            h *= BASE
            h += cp[k : k + len(h)]
        done = n
        yield _bucket(h, grams.bits, n), *_bounded(start, np.minimum(end - n + 1, start + own), len(h))
    if grams.words:
        first, _, word = words(cp)
        low, high, top = (np.searchsorted(first, x) for x in (start, end, start + own))
        for n in grams.words:
            h = word[: max(0, len(word) - n + 1)].copy()
            same = np.ones(len(h), bool)
            for k in range(1, n):
                h = h * MIX + word[k : k + len(h)]
                same &= word[k : k + len(h)] == word[: len(h)]
            h[same & (n > 1)] = REPEATED
            yield _bucket(h, grams.bits, 100 + n), *_bounded(low, np.minimum(high - n + 1, top), len(h))


def sums(texts: list[str | None], grams: Grams, weights: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of weights[bucket] over its features (weights: buckets by outputs), and their number."""
    out, n = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for pieces in _pieces(texts, grams, size):
        owner = [p.owner for p in pieces]
        for bucket, low, high in _streams(pieces, grams):
            np.add.at(n, owner, high - low)
            for k in range(weights.shape[1]):
                total = np.concatenate(([0.0], np.cumsum(weights[:, k].take(bucket), dtype=np.float64)))
                np.add.at(out[:, k], owner, total[high] - total[low])
    return out, n


def vector(text: str | None, grams: Grams, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets, ascending, and their shares of its features."""
    parts = [b[lo[k] : hi[k]] for pieces in _pieces([text], grams, size) for b, lo, hi in _streams(pieces, grams) for k in range(len(pieces))]
    bucket, count = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
    return bucket.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)


def training_vectors(docs: DataFrame, grams: Grams, label: str) -> tuple[list, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Ids, labels and vectors of the (bounded, already sampled) rows of docs (doc_id, text, label), by id.

    Vectors are made in parallel and written; the driver takes them a partition
    at a time, as bytes in the narrowest types, and keeps one copy.
    """
    narrow = np.min_scalar_type((1 << grams.bits) - 1)

    def run(batches):
        for batch in batches:
            rows = [vector(t, grams) for _, texts in slices(batch, 1) for t in texts]
            packed = [pa.array([r[0].astype(narrow).tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *packed], ["doc_id", "label", "buckets", "shares"])

    kind = docs.schema[label].dataType.simpleString()
    made = cut(docs.select(F.col("doc_id").cast("long"), "text", label).mapInArrow(run, f"doc_id long, label {kind}, buckets binary, shares binary"))
    rows = sorted(((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in made.toLocalIterator()), key=lambda r: r[0])
    pairs = [(np.frombuffer(b, narrow), np.frombuffer(s, np.float32)) for _, _, b, s in rows]
    return [r[0] for r in rows], np.array([r[1] for r in rows]), pairs


def sampled(rate: float | Column, seed: int = 7) -> Column:
    """True for about that share of ids, the same ones on every run."""
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * rate


def scored(docs: DataFrame, finish: Callable, columns: str, grams: Grams, weights: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of docs (doc_id, text, keep): doc_id, what `finish` makes of the texts, sums and counts (arrays in the order of `columns`), and keep.

    weights are broadcast: buckets by outputs, of a size that the model's parameters fix.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)
    kinds = dict(docs.dtypes)
    names = [c.split()[0] for c in columns.split(", ")]
    given = [f"_kept{k}" for k in range(len(keep))]

    def run(batches):
        for batch in batches:
            for start, texts in slices(batch, 1):
                part = batch.slice(start, len(texts))
                made = finish(texts, *sums(texts, grams, model.value))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, made), *part.columns[2:]], ["doc_id", *names, *given])

    schema = ", ".join(["doc_id long", columns, *(f"{n} {kinds[c]}" for n, c in zip(given, keep, strict=True))])
    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("_text"), *[F.col(c).alias(n) for n, c in zip(given, keep, strict=True)]).mapInArrow(run, schema)
    # a kept column of a name that is made here gives way
    return made.select("doc_id", *names, *[F.col(n).alias(c) for n, c in zip(given, keep, strict=True) if c not in ("doc_id", *names)])
