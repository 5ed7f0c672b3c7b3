"""Rule statistics against plain loops, the forest's verdict on planted and held-out rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopia.llm import rules
from canopia.llm.common import is_held_out, table

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    hit = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(hit)


def some_text(rng):
    alphabet = ["a", "b", "ß", "日本", "x#", "<|>", " ", " ", "𝄞", "z"]
    return "".join(rng.choice(alphabet) + rng.choice([" ", "\n", "\t", "\x0b", "\x0c", "\r", "\n\n", "  ", "\x1c"]) for _ in range(rng.randrange(60)))


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_counts_equal_a_plain_loop(size):
    rng = random.Random(size)
    texts = [None, "", " ", "\n\n", "a", "a a a", "a a a a", "a b c a b c", "x\nx\n\nx \nx", "   "] + [some_text(rng) for _ in range(300)]
    for text in texts:
        assert rules.counts_of(text.encode() if text else text if text is None else b"", size)[:5] == plain(text), repr(text)


def test_long_text_in_pieces():
    text = ("word%d " * 7 % tuple(range(7)) + "\n").encode() * 200_000
    n_words, chars, symbols, dup, repeat, n_lines, *_ = rules.counts_of(text)
    assert (n_words, chars, symbols, dup, repeat, n_lines) == (1_400_000, 7_000_000, 0, 199_999, 1_400_000, 200_000)


def test_path_lengths_equal_a_walk():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 3)), [[40.0, -40.0, 40.0]]])
    forest = rules.grow(x, trees=20, rows=401)
    got = rules.anomaly(forest, x)

    def walk(row, t):
        node = 0
        while forest.feature[t, node] >= 0:
            node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.value[t, node])
        return forest.length[t, node]

    expected = [2 ** -(np.mean([walk(r, t) for t in range(20)]) / float(rules._expected(401))) for r in x]
    assert np.allclose(got, expected)
    assert got.argmax() == 400


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n))


def planted(spark):
    rng = random.Random(9)
    good = [(k, words(rng, 120)) for k in range(500)]
    bad = [(1000 + k, " ".join(w + "###"[: 1 + k % 3] * (k % 5 + 1) for w in words(rng, 120).split())) for k in range(20)]
    short = [(2000, "too short"), (2001, None), (2002, ""), (2003, "a b c " * 40)]
    docs = spark.createDataFrame(good + bad + short + [(None, words(rng, 60)), (5, good[5][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 1000)) for k, _ in good[:300] + bad[:12]] + [(7, 0), (8, None)], "doc_id long, quality int")
    return docs, labels


def test_planted_rows(spark):
    docs, labels = planted(spark)
    docs = docs.withColumn("bins", F.lit("x")).withColumn("n_words", F.lit("y"))
    rows = rules.judged(docs, labels).collect()
    assert len(rows) == docs.count()
    kept = {}
    for r in rows:
        kept.setdefault(r.doc_id, []).append(r.kept)
    assert sum(x for k, v in kept.items() if k is not None and 1000 <= k < 1020 for x in v) <= 1
    assert sum(not x for k, v in kept.items() if k is not None and k < 500 for x in v) <= 10
    assert [kept[k] for k in (2000, 2001, 2002, 2003)] == [[False]] * 4
    assert len(kept[5]) == 2 and len(kept[None]) == 1


def test_without_labels_or_rows(spark):
    docs, labels = planted(spark)
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert rules.judged(docs, some).where("NOT base_failed AND NOT kept").isEmpty()
    assert rules.judged(docs.limit(0), labels).collect() == []
    assert rules.judged(docs.where("doc_id >= 2000"), labels).where("kept").isEmpty()


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = table(spark, sf_dir, "labels")
    held = is_held_out(F.col("doc_id"), 3, 1)
    found = rules.judged(table(spark, sf_dir, "documents"), labels.where(~held)).join(labels.where(held).select("doc_id", "quality"), "doc_id")
    told = {r.quality: r for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg(F.when(~F.col("base_failed"), F.col("kept").cast("int"))).alias("of_passed")).collect()}
    assert told[1].of_passed >= 0.97 and told[0].kept <= 0.1
