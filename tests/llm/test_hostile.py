"""Hostile inputs: clashing column names, repeated words, shared openings, long literals, long chains of patterns."""

import random
import subprocess
import sys
import time

from pyspark.sql import functions as F

from canopia.llm import decontaminate, linededup, pii, quality, secrets

DOCS = "doc_id long, text string"
INNER = ("_id", "_same", "_keep", "_text", "_ID", "hits", "items", "score", "n_words", "keep", "same", "h1", "_kept0")


def test_clashing_names_come_back(spark):
    line = "x" * 50
    rows = [(k, f"{line}\nown {k}") for k in range(6)]
    docs = spark.createDataFrame(rows, DOCS)
    clash = docs.select("*", *[F.lit(n).alias(n if n != "_ID" else "other") for n in INNER])
    cut = {r.doc_id: r for r in linededup.apply_bitmaps(clash, linededup.bitmaps(clash)).collect()}
    plain = {r.doc_id: r for r in linededup.apply_bitmaps(docs, linededup.bitmaps(docs)).collect()}
    for k, r in cut.items():
        assert (r.text, r.n_lines, r.n_dropped) == (plain[k].text, plain[k].n_lines, plain[k].n_dropped)
        assert r["_id"] == "_id" and r["_same"] == "_same" and r["_keep"] == "_keep"
    items = spark.createDataFrame([(1, "own 3")], "item_id long, text string")
    for most in (1 << 20, 1):
        found = {r.doc_id: r for r in decontaminate.hits(clash, items, most_chars=most, keep=("_text", "_id", "_same", "hits", "text")).collect()}
        assert found[3]["hits"] == [1, 2] and not found[2]["hits"] and found[3]["_text"] == "_text" and found[3]["_same"] == "_same" and found[3]["text"] == rows[3][1]
    model = quality.fit(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"))
    scored = quality.score(clash, model, keep=("_text", "score", "hits")).collect()
    assert all(isinstance(r.score, float) and r["_text"] == "_text" and r.hits == "hits" for r in scored)


def test_repeated_words_and_shared_openings():
    bench = decontaminate.Benchmark([(1, "w " * 4000)])
    began = time.time()
    n, hit, items = bench.scan("w " * 20_000)
    assert (n, len(hit), items) == (20_000, 20_000, [1]) and time.time() - began < 1
    opening = " ".join(f"o{k}" for k in range(11))
    bench = decontaminate.Benchmark([(k, f"{opening} " + " ".join(f"x{k}y{j}" for j in range(9))) for k in range(5000)])
    began = time.time()
    assert bench.scan((" ".join(f"o{k}" for k in range(7)) + " ") * 2300)[1:] == ([], [])
    n, hit, items = bench.scan(f"{opening} x3y0 x3y1 " * 1000)
    assert (n, len(hit), items) == (13_000, 13_000, [3])
    assert time.time() - began < 1


def test_windows_of_random_items_equal_brute_force():
    rng = random.Random(8)
    for width in (1, 2, 3, 4, 7, 13):
        items = [(rng.randrange(40), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))) for _ in range(60)]
        bench = decontaminate.Benchmark(items, width)
        for _ in range(40):
            words = [rng.choice("abcd") for _ in range(rng.randrange(60))]
            hit, found = set(), set()
            for item, text in items:
                own = text.split()
                size = min(width, len(own))
                for window in {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else ():
                    for k in range(len(words) - size + 1):
                        if tuple(words[k : k + size]) == window:
                            hit.update(range(k, k + size))
                            found.add(item)
            assert bench.scan(" ".join(words)) == (len(words), sorted(hit), sorted(found))


def test_a_literal_of_twenty_megabytes():
    code = (
        "import resource, sys; sys.path.insert(0, '.'); from canopia.llm import secrets\n"
        "text = 'password = \"' + 'aB3\\\\\"x/+' * 2_800_000 + '\"'\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "found = secrets.spans(text)\n"
        "assert found[1] == [(12, len(text) - 1, 'literal')], found[1]\n"
        "assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_quoted_literals_as_before():
    texts = ['k = "a\\"b" + c', "k='x\\\\' y", 'k="open', 'k = "a\\\nb"', "k: 'it''s'", 'k = ""']
    found = [secrets.VALUE.match(t, t.index("=" if "=" in t else ":") + 1) for t in texts]
    assert [m and m.group(m.lastindex) if m and m.lastindex else m and m.group() for m in found] == ['a\\"b', "x\\\\", None, None, "it", ""]


def test_patterns_of_the_fourth_generation(spark):
    """Each word has a fifth of the instances of the one before, which alone makes it known."""
    names, sizes = ("hotline", "desk", "counter", "window"), (1500, 300, 60, 12)
    rows = [(i, f"words {names[0]}: +1 555 01{i:05d} and after") for i in range(sizes[0])]
    for g in range(1, len(names)):
        rows += [(10_000 * g + i, f"our {names[g - 1]}: 55{g}.0{i:03d}.12{i % 10} x. {names[g]}: 55{g}.0{i:03d}.12{i % 10} end") for i in range(sizes[g])]
    rows += [(90_000 + i, f"at {names[-1]}: 777.0{i:03d}.123 z") for i in range(5)] + [(99_000, "at nobody: 777.0001.124 z")]
    found = {r.doc_id: r.added for r in pii.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert all([s.kind for s in found[90_000 + i]] == ["phone"] for i in range(5)) and not found[99_000]


def test_long_words_before_a_span(spark):
    """A pattern is the whole word, however long."""
    word = "q" * 90 + "line"
    rows = [(i, f"words {word}: +1 555 01{i:05d} and after") for i in range(8)]
    rows += [(50, f"others {word}: 555 0199 123 today"), (51, f"others x{word}: 555 0199 124 today")]
    found = {r.doc_id: r.added for r in pii.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert [s.kind for s in found[50]] == ["phone"] and not found[51]
