import random

import numpy as np
import pytest
import xxhash

from canopia.llm import neighbours, passages, simhash
from canopia.llm.common import connected_components


def test_fingerprint_by_its_definition():
    for text in ("", None, " \t", "One", "one two three", "A b C d e f g " * 3, "été  x y z w"):
        words = [w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(values: list[int], tau: int) -> list[int]:
    """Smallest index reachable over pairs within tau bits."""
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= tau:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("heavy", [2048, 3])
def test_links_are_all_pairs(spark, heavy):
    """A dense cloud around a few centres, and random values; with few allowed on a key, crowded keys are split."""
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(values)[:4]:
        for _ in range(40):
            x = centre
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), heavy=heavy).collect()}
    assert got == want


def test_allocation_adds_up_and_is_least():
    import itertools

    cost = np.array([[1.0, 50.0, 400.0], [30.0, 40.0, 60.0], [5.0, 500.0, 900.0]])
    chosen = simhash.allocate(cost, 1)
    paid = lambda es: sum(cost[g, e] for g, e in enumerate(es) if e >= 0)
    assert sum(chosen) == 1 and paid(chosen) == min(paid(es) for es in itertools.product(range(-1, 3), repeat=3) if sum(es) == 1)


def test_components_on_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(9001, None), (9002, " "), (None, rows[0][1]), (None, "nobody else has this text at all"), (rows[1][0], rows[1][1])]
    found = [r.asDict() for r in simhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    known = sorted({(i, t) for i, t in rows if i is not None}, key=lambda x: x[0])
    roots = reachable([simhash.fingerprint(t) for _, t in known], 4)
    want = {i: known[r][0] for (i, _), r in zip(known, roots, strict=True)}
    assert len(found) == len(rows) and all(r["component_id"] == want[r["doc_id"]] for r in found if r["doc_id"] is not None)
    assert sorted((r["component_id"] is None) for r in found if r["doc_id"] is None) == [False, True]
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_connected_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1001), (1002, 1001), (7, 7)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_compact_windows_by_brute_force():
    rng = np.random.default_rng(3)
    sizes = [0, 3, 30, 7, 61]
    h = rng.integers(0, 40, sum(sizes)).astype(np.uint64)
    low = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    high = low + np.array(sizes)
    for span in (1, 2, 7, 12):
        got = set(zip(*(x.tolist() for x in passages.compact_windows(h, low, high, span)), strict=True))
        want = set()
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            for c in range(a, b):  # the leftmost minimum of everything in [left, right]
                left, right = c, c
                while left > a and h[left - 1] > h[c]:
                    left -= 1
                while right + 1 < b and h[right + 1] >= h[c]:
                    right += 1
                if right - left + 1 >= span:
                    want.add((left, c, right))
        assert got == want


def text(rng, n):
    return [f"w{rng.randrange(100000)}" for _ in range(n)]


def test_passages_are_found(spark):
    rng = random.Random(8)
    shared, other = text(rng, 60), text(rng, 80)
    docs = {i: text(rng, 70) + shared + text(rng, 50) for i in range(10, 18)}
    docs |= {i: text(rng, 200) for i in range(20, 40)}
    near = other.copy()
    near[20] = "changed"
    docs |= {50: text(rng, 30) + other, 51: near + text(rng, 90), 60: text(rng, 90), 62: text(rng, 40) + shared[:30] + text(rng, 40)}
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(61, " ".join(docs[60])), (61, " ".join(docs[60])), (70, None), (71, ""), (None, " ".join(docs[60]))]
    found = {(r.doc_id, r.rep_id): r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) == {(i, 10) for i in range(11, 18)} | {(51, 50), (61, 60)}
    for i in range(11, 18):
        r = found[i, 10]
        assert docs[i][r.start : r.end] == shared == docs[10][r.rep_start : r.rep_end] and r.similarity == 1
    assert found[51, 50].similarity >= 0.8 and (found[61, 60].start, found[61, 60].end) == (0, 90)
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_passages_connect_all_their_documents(spark, sf_dir):
    """Every 50-word run that documents share joins them, against brute force."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    up: dict[int, int] = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        up[root(r.doc_id)] = root(r.rep_id)
    own: dict[tuple, set] = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 49):
            own.setdefault(tuple(x.lower() for x in w[k : k + 50]), set()).add(i)
    assert any(len(s) > 1 for s in own.values())
    assert all(len({root(i) for i in s}) == 1 for s in own.values())


def brute(vectors, queries, k):
    x = {i: np.array(v, float) for i, v in vectors.items()}
    out = {}
    for q in queries:
        near = sorted((-float(x[q] @ v / np.sqrt((x[q] @ x[q]) * (v @ v))), i) for i, v in x.items() if i != q)
        out[q] = [i for _, i in near[:k]]
    return out


def test_neighbours_recall_and_ties(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    vectors = {i: (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist() for i in range(3000)}
    for i in range(3000, 3400):  # one vector with many copies, two of them queries
        vectors[i] = vectors[0]
    bad = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] + [1.0] * 15), (5200, [1.0]), (None, [1.0] * 16), (0, vectors[0])]
    rows = spark.createDataFrame([*vectors.items(), *bad], "vec_id long, embedding array<double>")
    found: dict[int, list] = {}
    for r in neighbours.search(rows, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append(r.id)
    want = brute(vectors, [i for i in vectors if i % 50 == 0], 5)
    assert set(found) == set(want)
    assert found[0] == [3000, 3001, 3002, 3003, 3004] and found[3000] == [0, 3001, 3002, 3003, 3004] and found[3350] == [0, 3000, 3001, 3002, 3003]
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_neighbours_of_tiny_tables(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 2, 4):
        rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<float>")
        found = neighbours.search(rows, F.col("id") % 50 == 0).orderBy("rank").collect()
        assert [r.id for r in found] == list(range(1, n))


def test_balanced_partitions_keep_their_size():
    x = neighbours._unit(np.random.default_rng(0).normal(size=(500, 8)))
    part = neighbours.balanced_partition(x, neighbours.neighbour_graph(x, 5), 7)
    assert np.bincount(part, minlength=7).max() <= np.ceil(1.1 * 500 / 7) + 1 and len(set(part)) == 7


def test_passage_with_a_phrase_that_stands_earlier_in_the_representative():
    """The shared run is aligned on its own diagonal, wherever else its shingles occur."""
    rng = np.random.default_rng(3)
    shared, other = rng.integers(1, 1 << 62, 60).astype(np.uint64), rng.integers(1, 1 << 62, 400).astype(np.uint64)
    whole = np.concatenate((other[:50], shared[28:31], other[50:90], shared[:9], other[90:120], shared[50:], other[120:200], shared, other[200:]))
    at = 50 + 3 + 40 + 9 + 30 + 10 + 80
    assert passages.matches(shared, whole, 46, 0.8) == [(0, 60, at, at + 60, 1.0)]
    assert passages.matches(np.concatenate((other[:20], shared)), np.concatenate((shared[30:31], whole, whole)), 46, 0.8)[0][:2] == (20, 80)
    ones = np.ones(3000, np.uint64)
    start, end, *_, score = passages.matches(ones, ones[:2000], 46, 0.8)[0]
    assert start == 0 and 2000 <= end <= 2000 + passages.GAP and score == 1


def test_passages_count_words_between_ascii_white_space(spark):
    """Other spaces stand inside words, before a shared passage and in it."""
    rng = random.Random(12)
    shared = text(rng, 52)
    for k, space in zip((5, 15, 25, 35, 45), "  　\u0085\x1c", strict=True):
        shared[k] = f"a{space}b{k}"
    odd = [f"une{c}fois{i}" for i, c in enumerate("  　\u0085\x1c\x1f" * 8)]
    docs = {1: text(rng, 70) + shared + text(rng, 50), 2: odd + shared + text(rng, 60), 3: odd[::-1] + text(rng, 7) + shared}
    found = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.rep_id) for r in found if docs[r.doc_id][r.start : r.end] == shared == docs[1][r.rep_start : r.rep_end]} == {(2, 1), (3, 1)}


def test_passages_of_documents_that_meet_unrelated_smaller_ones(spark):
    """Smaller documents hold every low-hash shingle of a passage in other contexts; near copies differ in their words."""
    rng = random.Random(21)
    shared, near = text(rng, 50), text(rng, 60)
    docs = {}
    for i in range(41):  # pieces of ten words, apart from each other
        docs[i] = text(rng, 60) + shared[i : i + 10] + text(rng, 60)
    docs |= {60: text(rng, 70) + shared + text(rng, 60), 61: text(rng, 90) + shared + text(rng, 55)}
    for i in range(70, 75):  # pieces of thirty words that two functions may well agree on
        docs[i] = text(rng, 60) + near[(i - 70) * 7 :][:30] + text(rng, 60)
    docs |= {i: text(rng, 40 + i) + near + text(rng, 60) for i in range(80, 100)}
    found = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.rep_id) for r in found} == {(61, 60)} | {(i, 80) for i in range(81, 100)}
    assert all(docs[r.doc_id][r.start : r.end] == docs[r.rep_id][r.rep_start : r.rep_end] == (shared if r.doc_id == 61 else near) for r in found)


def _broadcast_of_exploded(frame):
    """Whether the plan that ran broadcasts what it made of exploded rows."""
    lines = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            if any("Generate" in x for x in lines[i:below]):
                return True
    return False


def test_crowds_are_not_broadcast(spark):
    """A crowd's values make many rows each; what is kept of those rows is joined without a broadcast, and components stay those of all pairs."""
    import itertools

    crowd = [sum(1 << 5 * b for b in bits) for n in range(5) for bits in itertools.combinations(range(12), n)]
    rng = random.Random(8)
    values = spark.createDataFrame([(v,) for v in {*crowd, *(rng.getrandbits(62) | 1 << 61 for _ in range(50))}], "fp long").coalesce(1)
    found = simhash.bonds(values)
    assert len(found.collect()) < len(crowd) * 100
    joined = {(r.node, r.component) for r in connected_components(found).collect()}
    assert joined == {(r.node, r.component) for r in connected_components(simhash.links(values)).collect()}
    assert not _broadcast_of_exploded(found)
