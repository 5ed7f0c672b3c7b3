"""The Merkle manifest against a tree built by a plain loop."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from canopia.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = {ord(a): ord(b) for a, b in zip(manifest.UPPER, manifest.LOWER, strict=True)}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes, fan):
    """(top, siblings of each node level by level, their slots)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + fan] for k in range(0, len(nodes), fan)]
        for p, k in zip(paths, at, strict=True):
            run = runs[k // fan]
            p.append((run[: k % fan], run[k % fan + 1 :]))
        at = [k // fan for k in at]
        nodes = [h(*r) for r in runs]
    return nodes[0], paths


def brute(rows, fan):
    groups = defaultdict(list)
    for r in rows:
        doc, source, lang, n, text = r
        leaf = h(*map(part, r))
        changed = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        low = h(*map(part, (doc, source, lang, n, None if text is None else text.translate(LOWER)))) if changed else leaf
        groups[lang].append((doc is not None, doc or 0, leaf, low))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])], fan) for g in names}
    root, upper = climb([trees[g][0] for g in names], fan)
    found = []
    for g, over in zip(names, upper, strict=True):
        for (known, doc, leaf, low), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            node = low
            for left, right in path + over:
                node = h(*left, node, *right)
            proof = h(*(x for side in path + over for x in side[0] + side[1]))
            found.append((doc if known else None, leaf, trees[g][0], root, proof, node, node == root))
    return sorted(found, key=str)


def some(seed, sizes):
    rng = random.Random(seed)
    rows = [(rng.randrange(10_000), rng.choice(("s", None, "")), lang, rng.choice((None, 3)), rng.choice((None, "", "Ünï CODE", "plain", "MIXED case"))) for lang, n in sizes for _ in range(n)]
    return rows + [(None, None, None, None, None), (None, "s", "x1", 1, "NULL id"), (7, "s", "x1", 1, "Tie"), (7, "s", "x1", 1, "Tie"), (7, "s", "x1", 1, "another")]


@pytest.mark.parametrize(("fan", "levels"), [(8, 4), (2, 2), (3, 1)])
def test_rows_equal_a_plain_tree(spark, fan, levels):
    rows = some(fan, [("en", 300), ("é", 9), ("a", 1), ("b", 8), ("Z", 2), (None, 65), ("", 3), *((f"l{k}", 2) for k in range(9))])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    which = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = manifest.manifest(manifest.tampered(docs, manifest.COLUMNS, "text", which), "lang", ["doc_id"], fan, levels).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.folded_root == r.root) for r in found]
    assert sorted(got, key=str) == brute(rows, fan)
    for r in found[:50]:
        assert h(*(x + y for x, y in zip(r.lefts, r.rights, strict=True))) == r.proof_sha256
        node = r.leaf
        for left, right in zip(r.lefts, r.rights, strict=True):
            node = h(left, node, right)
        assert node == r.root


def test_a_family_resumes_its_states():
    children = [h(str(k)) for k in range(8)]
    family = manifest.Family(children)
    assert family.hash == h(*children)
    for slot in range(8):
        other = h("other")
        assert family.fold(slot, other) == h(*children[:slot], other, *children[slot + 1 :])


def test_one_row_no_rows_long_text_and_clashing_columns(spark):
    which = F.col("doc_id") >= 0
    rows = [(3, "s", "en", 1, "AbC" * 2_000_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("leaf", F.lit("x")).withColumn("_at", F.lit(1))
    (r,) = manifest.manifest(manifest.tampered(docs, manifest.COLUMNS, "text", which), "lang", ["doc_id"]).collect()
    leaf = h(*map(part, rows[0]))
    assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, leaf, leaf, h(""))
    assert r.folded_root == h(*map(part, (3, "s", "en", 1, "abc" * 2_000_000)))
    empty = manifest.tampered(spark.createDataFrame([], SCHEMA), manifest.COLUMNS, "text", which)
    assert manifest.manifest(empty, "lang", ["doc_id"]).collect() == []
