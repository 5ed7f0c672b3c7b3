"""The conversation trie against nodes made one by one."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from canopia.llm import trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return made


def brute(made):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
            if d:
                kids[tuple(seq[: d - 1])].add(tuple(seq[:d]))
        ends[tuple(seq)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def rows_of(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(*COLUMNS).collect())


def some(seed, n, words=("a", "b", "cc"), depth=7):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, depth)):
            rows.append((c, t, rng.choice(("user", None)), rng.choice(words)))
    return rows


@pytest.mark.parametrize(("turns_a_task", "fan"), [(1 << 20, 256), (60, 2), (60, 4), (7, 3)])
def test_nodes_equal_brute_force(spark, turns_a_task, fan):
    rows = some(3, 330)
    rows += [(2000 + k, t, "user", "same") for k in range(150) for t in range(4)]  # copies
    rows += [(7, None, "user", None), (7, None, "user", None), (8, 2, "b", "x"), (8, 2, "a", "y"), (8, 2, "a", "b")]  # ties, repeats, nulls
    rows += [(5000, t, "user", f"deep {t}") for t in range(300)] + [(5001, t, "user", f"deep {t}" if t < 250 else "other") for t in range(300)]
    rows += [(None, 0, "user", "nobody"), (-5, 0, "user", "negative"), (601, 0, "user", "no head"), (703, 1, None, "")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    made = sequences(rows)
    found = trie.trie(trie.paths(trie.rebuilt(trie.gathered(df))), turns_a_task, fan)
    assert rows_of(found) == brute(made)


def test_plain_conversations_and_clashing_columns(spark):
    rows = [(1, 0, "u", "hi"), (1, 1, "a", "yo"), (2, 0, "u", "hi"), (2, 1, "a", "yo"), (3, 0, "u", "hi")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", block string, own long, path long")
    found = trie.trie(trie.paths(trie.gathered(df)))
    assert rows_of(found) == brute({1: [("u", "hi"), ("a", "yo")], 2: [("u", "hi"), ("a", "yo")], 3: [("u", "hi")]})


def test_deep_sparse_conversations(spark):
    rng, made = random.Random(6), {}
    for c in range(200):
        old = made[rng.randrange(c)] if c else []
        made[c] = old[: rng.randrange(len(old) + 1)] + [("u", rng.choice("abcdefghij")) for _ in range(rng.randrange(0, 4))]
    rows = [(c, t, *x) for c, seq in made.items() for t, x in enumerate(seq)]
    made = {c: seq for c, seq in made.items() if seq}
    convs = trie.paths(trie.gathered(spark.createDataFrame(rows, SCHEMA)))
    for turns, fan in ((3, 2), (11, 4), (1 << 20, 256)):
        assert rows_of(trie.trie(convs, turns, fan)) == brute(made)


def test_no_conversations(spark):
    for rows in ([], [(None, 0, "u", "x")]):
        assert rows_of(trie.trie(trie.paths(trie.rebuilt(trie.gathered(spark.createDataFrame(rows, SCHEMA)))))) == []


def test_long_text_counts_code_points(spark):
    rows = [(1, 0, "u", "é" * 3_000_000), (2, 0, "u", "é" * 3_000_000)]
    found = rows_of(trie.trie(trie.paths(trie.gathered(spark.createDataFrame(rows, SCHEMA)))))
    assert found == brute({1: [rows[0][2:]], 2: [rows[1][2:]]})


def test_common_depths():
    paths = [[], [1], [1, 2], [1, 2], [1, 3, 4], [2]]
    values = np.array([x for p in paths for t in p for x in (t, -t)])
    assert trie.common_depths(values, np.array([len(p) for p in paths])).tolist() == [-1, 0, 1, 2, 1, 0]


def test_first_paths():
    assert trie._first_paths(np.array([-1, 0, 1, 2, 1, 3]), 4).tolist() == [0, 1, 4, 4, 5]


@pytest.mark.parametrize("seed", range(8))
def test_runs_cut_anywhere_give_the_same_nodes(seed):
    """Peeling parts of the sorted paths and then their chains, in plain Python, without Spark."""
    import pyarrow as pa

    rng = random.Random(seed)
    made = {}
    for c in range(90):  # sparse and deep: a start of an earlier one, and more
        old = made[rng.randrange(c)] if c else []
        made[c] = old[: rng.randrange(len(old) + 1)] + [("u", rng.choice("abcdefghij")) for _ in range(rng.randrange(0, 4))]
    names = {x: (k * 7919) % 101 - 50 for k, x in enumerate("abcdefghij")}
    rows = sorted(([x for _, t in seq for x in (names[t], names[t])], c) for c, seq in made.items())
    parts, at = [], 0
    while at < len(rows):
        step = rng.randrange(1, 9)
        parts.append(rows[at : at + step])
        at += step
    batch = lambda part: pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in part], pa.list_(pa.int64())), "chars": pa.array([[1] * (len(p) // 2) for p, _ in part], pa.list_(pa.int64())), "conv_id": pa.array([c for _, c in part], pa.int64())})
    first = [b for part in parts for b in trie._task(False, False)([batch(part)])]
    chains = sorted((r for b in first for r in b.to_pylist() if r["kind"] == trie.CHAIN), key=lambda r: (r["path"], r["conv_id"]))
    whole = pa.RecordBatch.from_pylist(chains, schema=trie.MADE)
    second = list(trie._task(True, True)([whole]))
    got = sorted((r["conv_id"], r["depth"], r["n"], r["kids"], r["leaves"], r["saved"]) for b in first + second for r in b.to_pylist() if r["kind"] == trie.NODE)
    assert got == sorted((r[0], r[1], r[3], r[4], r[5], r[6]) for r in brute(made))
