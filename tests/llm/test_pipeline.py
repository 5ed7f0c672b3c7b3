import pytest

import corpus_pipeline
from canopia.llm import decontaminate, linededup, mixing, simhash

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def staged(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("staged")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_stages_follow_their_inputs(spark, sf_dir, staged):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
    rows = [{r.doc_id: r for r in s.collect()} for s in staged]
    assert all(s.columns == COLUMNS for s in staged[:-1]) and staged[-1].columns == [*COLUMNS, "epochs"]
    quality, lines, near, clean, mixed = rows
    assert set(lines) == set(quality)
    # line dedup by brute force
    keys: dict[str, set] = {}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, r in quality.items():
        for line in (r.text or "").split("\n"):
            keys.setdefault(key(line), set()).add(i)
    for i, r in quality.items():
        kept = [x for x in (r.text or "").split("\n") if not (len(key(x)) >= 40 and len(keys[key(x)]) >= 5 and i != max(keys[key(x)]))]
        assert lines[i].text == "\n".join(kept)
    # one document of each group of linked fingerprints, the smallest
    fps = {i: simhash.fingerprint(r.text) for i, r in lines.items()}
    groups: list[set] = []
    for i, f in fps.items():
        mine = [g for g in groups if any((f ^ fps[j]).bit_count() <= 4 for j in g)]
        groups = [g for g in groups if g not in mine] + [set().union({i}, *mine)]
    assert set(near) == {min(g) for g in groups}
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    windows = {w.strip() for r in bench for w, _ in decontaminate.windows(r.text)}
    for i, r in near.items():
        words = decontaminate.words_of(r.text)
        hit = {p for n in {w.count(" ") + 1 for w in windows} for k in range(len(words) - n + 1) if " ".join(words[k : k + n]) in windows for p in range(k, k + n)}
        assert (i in clean) == (not (hit and 20 * len(hit) >= len(words)))
    assert set(mixed) <= set(clean) and all(r.epochs >= 1 for r in mixed.values())
    total = sum(len((r.text or "").split()) for r in clean.values())
    taken = sum(len((r.text or "").split()) * r.epochs for r in mixed.values())
    assert 0 < taken <= mixing.PERCENT * total // 100


def test_run_writes_and_rereads(spark, sf_dir, staged):
    assert {(r.doc_id, r.epochs) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {(r.doc_id, r.epochs) for r in staged[-1].collect()}


def test_rows_without_id_and_repeated_rows(spark, sf_dir):
    rows = [(1, "some text that stands here", "en", "src1", 1), (1, "some text that stands here", "en", "src1", 1), (None, "some text that stands here", None, None, None), (None, "another text that nobody has", None, None, None), (None, "another text that nobody has", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()
    assert sorted((str(r.doc_id), r.text[:7]) for r in kept) == [("1", "some te"), ("None", "another")]
    assert corpus_pipeline.drop_contaminated(spark, docs, sf_dir).count() == 5
    assert corpus_pipeline.drop_lines(spark, docs, sf_dir).count() == 5
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0


def test_line_dedup_has_no_effect_without_repeats(spark):
    docs = spark.createDataFrame([(i, f"line {i} " * 10) for i in range(9)], "doc_id long, text string")
    assert linededup.bitmaps(docs).count() == 0
