"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts.

A window is a number of consecutive words of an item. Any window holds a whole
block of half that many words, counted from the item's start, so the automaton
is made of the items' blocks (over word numbers, a node a word; items shorter
than a window are a block of their own) and finds all places where a window may
occur. The few windows around such a place are looked up among the items'
distinct windows, by 64 bits and then word by word, so a block that many items
share or a text that repeats itself costs no more than others. The text is
scanned once, and the words' places in the original text give character spans.

The automaton is broadcast: about 200 bytes a benchmark word, and 100 for each
different word. A benchmark of over MOST_CHARS characters is not collected;
hashes of its windows are joined with those of the texts instead, with the same
result.

Defined results: a null text has no words; an item without words is no window;
repeated rows of a document each give a row; items with equal windows are all
reported; a null item_id is left out; very long texts are scanned whole; columns
other than the id, the text and those in `keep` are ignored; an empty table gives
an empty result, and an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.llm.common import cut, slices, table

WINDOW = 13
#: Share of a document's words, as 1 in so many, from which it is contaminated.
SHARE = 20
#: Benchmark characters up to which there is an automaton (under 1 GB of memory); beyond it, windows are joined.
MOST_CHARS = 32_000_000
#: Windows of a text that are hashed at once.
SLICE = 1 << 14
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower-case for A to Z, a space for other ASCII that is no letter or digit.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 0x30 or 0x39 < b < 0x61 or 0x7A < b < 0x80 else b for b in range(256))

SCHEMA = "doc_id long, n_words long, hits array<int>, items array<long>, char_spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[str]:
    # only spaces part words: other ASCII separators have become spaces, and no other character may part them
    return [w for w in (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).decode("utf-8", "surrogatepass").split(" ") if w]


def windows(text: str | None, width: int = WINDOW) -> list[tuple[str, int]]:
    """Distinct windows of an item, with their number of words."""
    words = words_of(text)
    runs = [words[i : i + width] for i in range(max(1, len(words) - width + 1))] if words else []
    return list(dict.fromkeys((f" {' '.join(run)} ", len(run)) for run in runs))


#: An odd factor and one that spreads word numbers over 64 bits.
FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _window_hashes(numbers: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    spread = numbers.astype(np.uint64) * SPREAD
    spread ^= spread >> np.uint64(29)
    out = np.zeros(len(starts), np.uint64)
    for k in range(width):
        out *= FACTOR
        out += spread[starts + k]
    return out


class Benchmark:
    """The items' words as numbers, the automaton of their blocks, and their distinct windows with the items that hold them."""

    def __init__(self, items: list[tuple[int, str | None]], width: int = WINDOW):
        self.width, self.half, self.number = width, (width + 1) // 2, {}
        self.ids = np.array([item for item, _ in items], np.int64)
        blocks: dict[tuple, set[int]] = {}
        runs, starts, owners, at = [], [], [], 0
        for k, (_, text) in enumerate(items):
            own = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            if not own:
                continue
            if len(own) < width:
                blocks.setdefault(own, set()).add(k)
                continue
            for p in range(0, len(own) - self.half + 1, self.half):
                blocks.setdefault(own[p : p + self.half], set())
            runs.append(np.array(own, np.int32))
            starts.append(np.arange(at, at + len(own) - width + 1))
            owners.append(np.full(len(own) - width + 1, k))
            at += len(own)
        self.flat = np.concatenate(runs) if runs else np.zeros(0, np.int32)
        start, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, owners))
        self.hashes, first, window = np.unique(_window_hashes(self.flat, start, width), return_index=True, return_inverse=True)
        self.place = start[first]
        held = np.unique(window.astype(np.int64) * max(1, len(items)) + owner)
        self.owner = held % max(1, len(items))
        self.upto = np.searchsorted(held // max(1, len(items)), np.arange(len(self.hashes) + 1))
        self.blocks = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, short in blocks.items():
            self.blocks.add_word(block, (len(block), tuple(short)))
        self.blocks.make_automaton()
        self.empty = not blocks

    def _windows(self, doc: np.ndarray, begins: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Starts in the text of windows around blocks that begin at these places, and the windows they are."""
        near = np.unique((np.array(begins, np.int64)[:, None] - np.arange(self.half)).ravel())
        near = near[(near >= 0) & (near <= len(doc) - self.width)]
        found = [(near[:0], near[:0])]
        for low in range(0, len(near), SLICE):
            part = near[low : low + SLICE]
            h = _window_hashes(doc, part, self.width)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            met = np.flatnonzero(self.hashes[at] == h)
            part, at, words = part[met], at[met], np.arange(self.width)
            same = (self.flat[self.place[at][:, None] + words] == doc[part[:, None] + words]).all(axis=1)
            found.append((part[same], at[same]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def scan(self, text: str | None) -> tuple[int, list[int], list[int]]:
        """Words of the text, the words hit (ascending) and the items with occurring windows."""
        words = words_of(text)
        n = len(words)
        if self.empty or not n:
            return n, [], []
        doc = tuple(map(self.number.get, words, repeat(0)))
        edge, items, begins = [], set(), []
        for last, (size, short) in self.blocks.iter(doc):
            if short:
                edge.append((last + 1 - size, last + 1))
                items.update(short)
            if size == self.half:
                begins.append(last + 1 - size)
        cover = np.zeros(n + 1, np.int64)
        for low, high in edge:
            cover[low] += 1
            cover[high] -= 1
        if begins and len(self.hashes):
            start, window = self._windows(np.array(doc, np.int32), begins)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + self.width, -1)
            for w in np.unique(window).tolist():
                items.update(self.owner[self.upto[w] : self.upto[w + 1]].tolist())
        if not items:
            return n, [], []
        return n, np.flatnonzero(np.cumsum(cover)[:-1] > 0).tolist(), np.unique(self.ids[sorted(items)]).tolist()


def char_spans(text: str, hits: list[int]) -> list[dict]:
    """Spans of code points in the original text, one for each run of words hit."""
    places = [m.span() for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    out: list[dict] = []
    for k, word in enumerate(hits):
        if k and hits[k - 1] == word - 1:
            out[-1]["end"] = places[word][1]
        else:
            out.append({"start": places[word][0], "end": places[word][1]})
    return out


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, most_chars: int = MOST_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of docs: n_words, hits (words hit), items, char_spans, and the columns `keep` of docs."""
    given = dict(zip((f"_kept{k}" for k in range(len(keep))), keep, strict=True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(n) for n, c in given.items()])
    return _named(_found(docs, rows, benchmark, item_col, item_text_col, width, most_chars, tuple(given)), given)


def _named(found: DataFrame, given: dict[str, str]) -> DataFrame:
    """The columns kept under their own names again, but for those of a name that is found here."""
    own = [c for c in found.columns if c not in given]
    return found.select(*own, *[F.col(n).alias(c) for n, c in given.items() if c not in own])


def _found(docs: DataFrame, rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, width: int, most_chars: int, keep: tuple[str, ...]) -> DataFrame:
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > most_chars:
        return _joined(rows, items, width, keep)
    known = docs.sparkSession.sparkContext.broadcast(Benchmark([(r["item"], r["text"]) for r in items.collect()], width))
    return _marked(rows, lambda text, _: known.value.scan(text), keep)


def _marked(rows: DataFrame, scan, keep: tuple[str, ...], found: tuple[str, ...] = ()) -> DataFrame:
    """rows (doc_id, _text, keep, found) with what `scan` makes of a text and of the values of the columns `found`."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([SCHEMA, *(f"`{c}` {kinds[c]}" for c in keep)])
    arrow = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    names = ["doc_id", "n_words", "hits", "items", "char_spans", *keep]

    def one(text, extra):
        n, hit, items = scan(text, extra)
        return n, hit, items, char_spans(text, hit) if hit else []

    def run(batches):
        for batch in batches:
            for start, texts in slices(batch, 1):
                part = batch.slice(start, len(texts))
                extra = zip(*(part.column(2 + len(keep) + k).to_pylist() for k in range(len(found))), strict=True) if found else [()] * len(texts)
                made = [one(t, x) for t, x in zip(texts, extra, strict=True)]
                own = [pa.array([r[k] for r in made], kind) for k, kind in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([part.column(0), *own, *part.columns[2 : 2 + len(keep)]], names)

    return rows.mapInArrow(run, schema)


def _joined(rows: DataFrame, items: DataFrame, width: int, keep: tuple[str, ...]) -> DataFrame:
    """The same for a benchmark of any size: hashes of windows are joined, and what they hit is brought back to the texts."""

    def of_items(batches):
        for batch in batches:
            found = [(item, n, *_digest(w)) for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w, n in windows(text, width)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(4)], ["item", "n", "h1", "h2"])

    theirs = cut(items.mapInArrow(of_items, "item long, n long, h1 long, h2 long").distinct())
    sizes = [r["n"] for r in theirs.select("n").distinct().collect()]  # at most `width` values

    def of_docs(batches):
        for batch in batches:
            for doc, same, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = words_of(text)
                for n in sizes:
                    for lo in range(0, max(0, len(words) - n + 1), SLICE):
                        own = range(lo, min(lo + SLICE, len(words) - n + 1))
                        h = [_digest(f" {' '.join(words[p : p + n])} ") for p in own]
                        columns = [[doc] * len(h), [same] * len(h), list(own), [n] * len(h), [x[0] for x in h], [x[1] for x in h]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "same", "at", "n", "h1", "h2"])

    marked = rows.withColumn("_same", F.xxhash64("_text"))
    ours = marked.select("doc_id", "_same", "_text").dropDuplicates(["doc_id", "_same"]).mapInArrow(of_docs, "doc_id long, same long, at long, n long, h1 long, h2 long")
    met = ours.join(theirs, ["n", "h1", "h2"]).groupBy(F.col("doc_id").alias("_id"), F.col("same").alias("_s")).agg(F.collect_set(F.struct("at", "n")).alias("_runs"), F.collect_set("item").alias("_items"))
    both = marked.join(met, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_same").eqNullSafe(F.col("_s")), "left")

    def scan(text, extra):
        runs, found = extra
        return len(words_of(text)), sorted({p for r in runs or () for p in range(r["at"], r["at"] + r["n"])}), sorted(found or ())

    return _marked(both.select("doc_id", "_text", *keep, "_runs", "_items"), scan, keep, ("_runs", "_items"))


def _digest(window: str) -> tuple[int, int]:
    found = hashlib.blake2b(window.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def is_contaminated(share: int = SHARE):
    n = F.size("hits")
    return (n > 0) & (share * n >= F.col("n_words"))


def item_digest():
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return F.sha2(F.array_join(ids, ",").cast("binary"), 256)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: hit words and contamination of every document."""
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), item_digest().alias("items_sha256"), is_contaminated().alias("contaminated"))


#: The query in DuckDB: words by position, windows as joined strings, hit words by range.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN its USING (doc_id)
"""
