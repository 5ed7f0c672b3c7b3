"""Substring dedup with compact windows.

Each text becomes hashes of its shingles of five words. For each of a few hash
functions, Cartesian trees over those hashes give compact windows: all
subsequences of at least `min_words` words between a window's ends and across
its centre have their min-hash at the centre. Windows whose min-hash other
documents have too are laid over each other: a unit is a run of places where the
centres of two functions stay the same. Documents that
share a unit's min-hashes form a group, so functions agree on one stretch of a
document, whatever else its shingles meet.

Every document of a group is compared with the group's smallest doc_id: near
its unit, diagonals are aligned on the representative's text and the shingles'
Jaccard similarity is taken. Documents whose unit lies in a passage found so are
settled. What is left of a group of up to CROWD documents is compared pair by
pair. A larger rest (documents that share a common line, each with a different
text around it) groups again by the exact runs of half a window around the unit,
of which a passage has at least one: up to CROWD documents of a run are compared
pair by pair, more of them with the smallest. So a passage that m documents
share costs about m comparisons, and so does a line that they share.

Equal texts are collapsed first and come back as members of their class.

Only windows, units and, for documents with collisions, texts are shuffled. Tables
of a few numbers a row are broadcast after a count and joined by shuffle beyond it.

Defined results: one row per repeated passage of a document and
representative: doc_id, rep_id, the passage in words (start, end exclusive) in
both, and similarity; texts of fewer than min_words words, null texts and rows
without doc_id give none; repeated rows count once, and different texts of one
doc_id each count, but not against each other; columns other than the id and the
text are ignored; very long texts are one row each, whole; an empty table gives
an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopia.llm.common import ASCII_LOWER, cut, slices, table, written
from canopia.llm.features import MIX, words

WIDTH, MIN_WORDS, SIMILARITY = 5, 50, 0.8
#: Hash functions, and how many must agree on a stretch before it is verified.
HASHES, ENOUGH = 4, 2
#: Windows that a worker lays over each other at once; a longer text makes a step of its own.
STEP = 1 << 19
#: Words between matching shingles that a passage may pass over.
GAP = 12
#: Rows up to which a table of a few numbers may be broadcast (under 100 bytes each).
MOST_BROADCAST = 500_000
#: Documents of a group that are compared pair by pair, and members that meet a copy of their representative.
CROWD, SHARE = 16, 256
#: Bytes of stretches that a worker sends at once.
FLUSH = 1 << 23
#: Places that windows of one min-hash may join to.
LONGEST = 512
#: Words of a cell in which passages of a text meet.
CELL = 64


def _lowered(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).decode("utf-8", "surrogatepass")


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _shingles(cp: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and the hash of every `width` consecutive words."""
    first, last, word = words(cp)
    h = word[: max(0, len(word) - width + 1)].copy()
    for k in range(1, width):
        h = h * MIX + word[k : k + len(h)]
    return first, last, h


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    x = (h ^ np.uint64(0xD6E8FEB86659FD93 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def centres(h: np.ndarray, low: np.ndarray, high: np.ndarray, span: int) -> np.ndarray:
    """Positions that are the (leftmost) minimum of some `span` consecutive hashes inside one text; texts are [low, high)."""
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(h))
    value, done = h, 1
    while done < span:
        step = min(done, span - done)
        a, b = value[: len(value) - step], value[step:]
        right = b < a
        best = np.where(right, best[step:], best[: len(best) - step])
        value = np.where(right, b, a)
        done += step
    inside = np.zeros(len(h) + 1, np.int64)
    ok = high - low >= span
    np.add.at(inside, low[ok], 1)
    np.add.at(inside, high[ok] - span + 1, -1)
    return np.unique(best[np.cumsum(inside)[:n] > 0])


def compact_windows(h: np.ndarray, low: np.ndarray, high: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) of all compact windows at least `span` wide, right inclusive.

    Only centres need the Cartesian tree: the nearest smaller hash on either
    side of a wide window is a centre itself, or the text ends there.
    """
    c = centres(h, low, high, span)
    text = np.searchsorted(low, c, side="right") - 1
    values, places, texts = h[c].tolist(), c.tolist(), text.tolist()
    left, right = low[text].tolist(), (high[text] - 1).tolist()
    stack: list[int] = []
    for i, v in enumerate(values):
        if stack and texts[stack[-1]] != texts[i]:
            stack.clear()
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    wide = right - left + 1 >= span
    return left[wide], c[wide], right[wide]


def _merged(key: np.ndarray, first: np.ndarray, last: np.ndarray, centre: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last place, centre and text of windows, adjoining ones of one min-hash made one (of up to LONGEST places): a repeated phrase makes few windows."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (first[1:] != last[:-1] + 1)
    run = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    part = (first - first[run]) // LONGEST
    new[1:] |= part[1:] != part[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(key)) - 1
    return first[begin], last[end], centre[end], text[begin]


def windows(docs: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS, hashes: int = HASHES) -> DataFrame:
    """(key, node, at) of the windows of docs (node, text): the min-hash, and packed in a long the function, the first and last place where `span` shingles have that centre, and the centre."""
    span = min_words - width + 1

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, texts in slices(batch, 1, 1 << 19):
                texts = [_lowered(t or "") for t in texts]
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
                cp = _code_points("\n".join(texts))
                first, _, h = _shingles(cp, width)
                low, top = np.searchsorted(first, begin), np.searchsorted(first, begin + sizes)
                low, high = np.minimum(low, len(h)), np.clip(top - width + 1, np.minimum(low, len(h)), len(h))
                for k in range(hashes):
                    x = _mixed(h, k)
                    left, c, right = compact_windows(x, low, high, span)
                    if len(c):
                        text = np.searchsorted(low, c, side="right") - 1
                        begin_at, end_at = np.maximum(left, c - span + 1), np.minimum(c, right - span + 1)
                        begin_at, end_at, c, text = _merged(x[c], begin_at, end_at, c, text)
                        at = (k << 60) | ((begin_at - low[text]) << 20) | ((end_at - begin_at) << 10) | (c - end_at)
                        yield pa.RecordBatch.from_arrays([pa.array(x[c].view(np.int64)), pa.array(ids[start + text]), pa.array(at)], ["key", "node", "at"])

    return docs.select("node", "text").mapInArrow(run, "key long, node long, at long")


def _laid(key: np.ndarray, at: np.ndarray, owner: np.ndarray, hashes: int, enough: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Key, owner and `at` of the units of packed windows: first and last place, and the outermost centres after the last place."""
    first = (owner << 40) | (at >> 20 & 0xFFFFFFFFFF)
    last = first + (at >> 10 & 0x3FF)
    centre = last + (at & 0x3FF)
    edge = np.unique(np.concatenate((first, last + 1)))
    index = np.full((hashes, len(edge)), -1)
    for k in range(hashes):
        own = np.flatnonzero(at >> 60 == k)
        if len(own):
            own = own[np.argsort(first[own])]
            here = own[np.maximum(np.searchsorted(first[own], edge, side="right") - 1, 0)]
            index[k] = np.where((first[here] <= edge) & (edge <= last[here]), here, -1)
    chosen = [list(c) for c in itertools.combinations(range(hashes), enough)]
    for which in chosen:
        own = index[which]
        turn = np.ones(len(edge), bool)
        turn[1:] = (own[:, 1:] != own[:, :-1]).any(axis=0)
        begin = np.flatnonzero(turn & (own >= 0).all(axis=0))
        turns = np.flatnonzero(turn)
        end = edge[turns[np.searchsorted(turns, begin, side="right")]] - 1 if len(begin) else begin
        mixed = np.full(len(begin), len(which), np.uint64)
        for k in own:
            mixed = (mixed ^ key[k[begin]]) * MIX
            mixed ^= mixed >> np.uint64(31)
        middle = centre[own[:, begin]]
        start = edge[begin]
        yield mixed, start >> 40, ((start & 0xFFFFFFFFFF) << 30) | ((end - start) << 20) | ((middle.min(axis=0) - end) << 10) | (middle.max(axis=0) - end)


def units(shared: DataFrame, hashes: int, enough: int) -> DataFrame:
    """(key, node, at) of the units of shared (node, windows: an array of key and at)."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            size = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            flat = lists.flatten()
            key, at = flat.field("key").to_numpy().view(np.uint64), flat.field("at").to_numpy()
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(size, size[lo] + STEP, side="right")) - 1)
                owner = np.repeat(np.arange(hi - lo), np.diff(size[lo : hi + 1]))
                for mixed, who, packed in _laid(key[size[lo] : size[hi]], at[size[lo] : size[hi]], owner, hashes, enough):
                    yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array(ids[lo + who]), pa.array(packed)], ["key", "node", "at"])
                lo = hi

    return shared.select("node", "windows").mapInArrow(run, "key long, node long, at long")


def stretches(packed: list[int], span: int) -> list[tuple[int, int]]:
    """Runs [left, right] of shingles within `span` of units; units that near each other share a run."""
    out: list[list[int]] = []
    for first, last in sorted((a >> 30, (a >> 30) + (a >> 20 & 0x3FF)) for a in packed):
        lo, hi = max(0, first - span), last + 2 * span - 1
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _run_lengths(same: np.ndarray) -> np.ndarray:
    """For every true value, how many stand together with it."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    out = np.zeros(len(same), np.int64)
    out[same] = np.repeat(edge[1::2] - edge[::2], edge[1::2] - edge[::2])
    return out


def _on_diagonals(region: np.ndarray, whole: np.ndarray, diagonals: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of region that equal whole on one of the diagonals, and those in whole; the longest run through a position wins."""
    longest, place = np.zeros(len(region), np.int64), np.zeros(len(region), np.int64)
    for d in diagonals:
        lo, hi = max(0, -d), min(len(region), len(whole) - d)
        runs = _run_lengths(region[lo:hi] == whole[lo + d : hi + d])
        better = np.flatnonzero(runs > longest[lo:hi]) + lo
        longest[better], place[better] = runs[better - lo], better + d
    mine = np.flatnonzero(longest)
    return mine, place[mine]


def _settled(region: np.ndarray, whole: np.ndarray, mine: np.ndarray, theirs: np.ndarray, span: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Passages among matched positions: runs with small gaps, or else their exact runs, that are long and similar enough."""
    step, jump = np.diff(mine), np.diff(theirs)
    out = []

    def settle(lo: int, hi: int, whole_runs: bool) -> None:
        s, e = mine[lo], mine[hi - 1] + 1
        a, b = theirs[lo:hi].min(), theirs[lo:hi].max() + 1
        if e - s < span or b - a < 1:
            return
        x, y = set(region[s:e].tolist()), set(whole[a:b].tolist())
        score = len(x & y) / len(x | y)
        if score >= similarity:
            out.append((int(s), int(e), int(a), int(b), score))
        elif not whole_runs:
            cuts = [lo, *(np.flatnonzero((step[lo : hi - 1] != 1) | (jump[lo : hi - 1] != 1)) + lo + 1).tolist(), hi]
            for i, j in zip(cuts, cuts[1:], strict=False):
                settle(i, j, True)

    cuts = [0, *(np.flatnonzero((step > GAP) | (np.abs(jump - step) > GAP)) + 1).tolist(), len(mine)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        settle(i, j, False)
    return out


def matches(region: np.ndarray, whole: np.ndarray, span: int, similarity: float, order: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """Passages of region (shingle hashes) found again in whole: start, end (exclusive, in shingles) in each, and Jaccard similarity.

    All occurrences in whole of the rarest shingle of every GAP matched ones
    propose diagonals; nearby diagonals are aligned together, the best supported
    first, and a passage that lies in one found before is not repeated. A
    passage passes over GAP words at most, so shorter chains hold none. order
    sorts whole, if that is known.
    """
    order = np.argsort(whole, kind="stable") if order is None else order
    begin = np.searchsorted(whole, region, sorter=order)
    count = np.searchsorted(whole, region, side="right", sorter=order) - begin
    known = np.flatnonzero(count)
    if len(known) < span * similarity / 2:
        return []
    ends = np.flatnonzero(np.concatenate(([True], np.diff(known) > GAP, [True])))
    if (known[ends[1:] - 1] - known[ends[:-1]] + 1).max() < span:
        return []
    anchors = known[centres(count[known], np.array([0]), np.array([len(known)]), min(GAP, len(known)))]
    many = count[anchors]
    at = np.repeat(anchors, many)
    diagonal = order[np.repeat(begin[anchors] - np.cumsum(many) + many, many) + np.arange(many.sum())] - at
    out: list[tuple[int, int, int, int, float]] = []
    while len(at):
        values, support = np.unique(diagonal, return_counts=True)
        best = values[np.argmax(support)]
        near = np.abs(diagonal - best) <= GAP
        mine, theirs = _on_diagonals(region, whole, values[np.abs(values - best) <= GAP].tolist())
        found = _settled(region, whole, mine, theirs, span, similarity) if len(mine) else []
        out += [x for x in found if not any(y[0] <= x[0] and x[1] <= y[1] for y in out)]
        done = near.copy()
        for s, e, *_ in found:
            done |= (at >= s) & (at < e)
        at, diagonal = at[~done], diagonal[~done]
    return sorted(out)


def _small(df: DataFrame) -> DataFrame:
    """df (a few numbers a row), marked for broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _grouped(df: DataFrame) -> DataFrame:
    """The rows of df (key, node, at) whose key several texts have, with the smallest as rep."""
    own = Window.partitionBy("key")
    return df.withColumns({"rep": F.min("node").over(own), "_last": F.max("node").over(own)}).where("rep < _last").drop("_last")


def _distinct_texts(rows: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2) of all texts long enough, and (h1, h2, first, node, n): each different text with its smallest doc_id.

    node is that doc_id; where it has several different texts, the others get
    numbers from 2^62 up, made from their hashes.
    """
    ids = rows.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.length("text").alias("n"))
    ids = cut(ids.where(F.col("n") >= 2 * min_words - 1).drop("n").distinct())
    first = ids.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    turn = F.row_number().over(Window.partitionBy("first").orderBy("h1", "h2"))
    other = F.col("h1").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return ids, cut(first.withColumn("node", F.when(turn == 1, F.col("first")).otherwise(other)))


def _asked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of a list column of structs, and the structs' rep, key and at."""
    flat = column.flatten()
    return np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy()))), *(flat.field(k).to_numpy() for k in ("rep", "key", "at"))


def compared(tried: DataFrame, texts: DataFrame, width: int, span: int, similarity: float) -> DataFrame:
    """Passages and open units of tried (node, rep, key, at); rows with node = rep name the representatives.

    A passage has node, rep, start, end, rep_start, rep_end and similarity; a
    unit that lies in none of its two texts' passages has node, rep, key and at.
    A text is read once for all its roles. A representative meets about SHARE
    members in a run of a task; one with more is sent again for each further
    run, so a hot one costs more runs, not a longer one.
    """
    asked = written(tried.groupBy("node").agg(F.collect_list(F.struct("rep", "key", "at")).alias("asked")))
    pairs = asked.select("node", F.explode(F.array_distinct(F.col("asked.rep"))).alias("rep"))
    hot = pairs.groupBy("rep").count().where(F.col("count") > SHARE).select("rep", F.ceil(F.col("count") / SHARE).cast("int").alias("runs"))
    sent = _texts_of(texts, asked).mapInArrow(_cut_out(width, span), "rep long, node long, lo array<long>, size array<long>, part binary, key binary, at binary")
    dealt = sent.join(_small(cut(hot)), "rep", "left").withColumn("runs", F.coalesce("runs", F.lit(1)))
    lead = F.col("node") == F.col("rep")
    run = F.when(lead, F.sequence(F.lit(0), F.col("runs") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("runs")).cast("int")))
    met = dealt.select(F.explode(run).alias("run"), "rep", (~lead).alias("member"), "node", "lo", "size", "part", "key", "at")
    met = met.repartition("rep", "run").sortWithinPartitions("rep", "run", "member").drop("run", "member")
    return cut(met.mapInArrow(_compare(width, span, similarity), "node long, rep long, start long, end long, rep_start long, rep_end long, similarity double, key long, at long"))


def _texts_of(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, text, and the other column of asked) of the texts in asked; few ids are broadcast first, so only their texts are shuffled."""
    few = texts.join(F.broadcast(asked.select("node")), "node", "left_semi") if asked.count() <= MOST_BROADCAST else texts
    return few.join(asked.hint("merge"), "node")


def _hashes(text: str, width: int) -> np.ndarray:
    return _shingles(_code_points(_lowered(text)), width)[2]


def _cut_out(width: int, span: int):
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["rep", "node", "lo", "size", "part", "key", "at"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            ends, reps, keys, ats = _asked(batch.column(2))
            for i, (node, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                node, h = node.as_py(), _hashes(text.as_py(), width)
                order = np.argsort(reps[ends[i] : ends[i + 1]], kind="stable") + ends[i]
                cuts = np.flatnonzero(np.diff(reps[order], prepend=reps[order[0]] - 1))
                for own in np.split(order, cuts[1:]):
                    rep = int(reps[own[0]])
                    if rep == node:
                        row = (rep, node, [0], [len(h)], h.tobytes(), b"", b"")
                    else:
                        at = ats[own]
                        runs = [(lo, h[lo : hi + 1]) for lo, hi in stretches(at.tolist(), span)]
                        row = (rep, node, [lo for lo, _ in runs], [len(x) for _, x in runs], b"".join(x.tobytes() for _, x in runs), keys[own].tobytes(), at.tobytes())
                    rows.append(row)
                    size += len(row[4]) + len(row[5]) + len(row[6])
                    if size >= FLUSH:
                        yield flush(rows)
                        rows, size = [], 0
        yield flush(rows)

    return run


def _open(at: np.ndarray, found: list[tuple], width: int) -> np.ndarray:
    """Which units' centres lie in none of the passages."""
    last = (at >> 30) + (at >> 20 & 0x3FF)
    low, high = last + (at >> 10 & 0x3FF), last + (at & 0x3FF)
    free = np.ones(len(at), bool)
    for start, end in {x[:2] for x in found}:
        free &= (low < start) | (high + width > end)
    return free


def _compare(width: int, span: int, similarity: float):
    names = ["node", "rep", "start", "end", "rep_start", "rep_end", "similarity", "key", "at"]
    kinds = [pa.float64() if n == "similarity" else pa.int64() for n in names]

    def run(batches):
        own, whole, order = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for rep, node, lo, size, part, key, at in zip(*(batch.column(k) for k in range(7)), strict=True):
                rep, node, h = rep.as_py(), node.as_py(), np.frombuffer(part.as_py(), np.uint64)
                if node == rep:
                    own, whole, order = rep, h, np.argsort(h, kind="stable")
                    continue
                if own != rep:
                    raise ValueError("a representative's text is missing")
                found, begin = [], 0
                for first, n in zip(lo.as_py(), size.as_py(), strict=True):
                    for s, e, a, b, score in matches(h[begin : begin + n], whole, span, similarity, order):
                        found.append((first + s, first + e + width - 1, a, b + width - 1, score))
                    begin += n
                out += [(node, rep, *x, None, None) for x in found]
                at = np.frombuffer(at.as_py(), np.int64)
                free = _open(at, found, width)
                out += [(node, rep, None, None, None, None, None, k, p) for k, p in zip(np.frombuffer(key.as_py(), np.int64)[free].tolist(), at[free].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return run


def exact_runs(crowded: DataFrame, texts: DataFrame, width: int, span: int, run_length: int) -> DataFrame:
    """(key, node, at) of every run of `run_length` shingles inside the windows of `span` that start at places of open units; the key is the run's hash."""

    def run(batches):
        for batch in batches:
            for node, text, units_ in zip(*(batch.column(k) for k in range(3)), strict=True):
                h = _hashes(text.as_py(), width)
                packed = units_.values.to_numpy()
                edge = np.zeros(len(h) + span + 2, np.int64)
                np.add.at(edge, packed >> 30, 1)
                np.add.at(edge, (packed >> 30) + (packed >> 20 & 0x3FF) + span - run_length + 1, -1)
                at = np.flatnonzero(np.cumsum(edge)[: max(0, len(h) - run_length + 1)] > 0)
                for lo in range(0, len(at), STEP):
                    own = at[lo : lo + STEP]
                    x = np.zeros(len(own), np.uint64)
                    for k in range(run_length):
                        x = x * MIX + h[own + k]
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(np.full(len(own), node.as_py(), np.int64)), pa.array(own << 30 | run_length - 1)], ["key", "node", "at"])

    by = cut(crowded.groupBy("node").agg(F.collect_set("at").alias("at")))
    return _texts_of(texts, by).select("node", "text", "at").mapInArrow(run, "key long, node long, at long")


def _by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of groups (key, node, at) of up to CROWD texts, and of larger ones, with the smallest text of each as rep."""
    grouped = _grouped(rows)
    sized = cut(grouped.join(grouped.groupBy("key").agg(F.countDistinct("node").alias("size")), "key"))
    return sized.where(F.col("size") <= CROWD).drop("size"), sized.where(F.col("size") > CROWD).drop("size")


def _all_pairs(few: DataFrame) -> DataFrame:
    """(node, rep, at) of every two texts of a group; groups have at most CROWD."""
    other = few.select("key", F.col("node").alias("rep")).distinct()
    return few.drop("rep").join(other, "key").where("rep < node").select("node", "rep", "at")


def links(texts: DataFrame, width: int, min_words: int, similarity: float, hashes: int, enough: int) -> DataFrame:
    """The passages (node, rep, start, end, rep_start, rep_end, similarity) of texts (node, text), all different."""
    span = min_words - width + 1
    shared = _grouped(windows(texts, width, min_words, hashes)).groupBy("node").agg(F.collect_list(F.struct("key", "at")).alias("windows"))
    first = compared(_grouped(units(shared, hashes, enough)), texts, width, span, similarity)
    few, crowded = _by_size(first.where("start IS NULL").select("key", "node", "at"))
    # a changed word takes `width` shingles, and a passage of the least length may have one: the longer run beside it
    run_length = max(1, (span - width) // 2)
    few_runs, large_runs = _by_size(exact_runs(crowded, texts, width, span, run_length))
    again = _all_pairs(few).unionByName(_all_pairs(few_runs)).unionByName(large_runs.where("node <> rep").select("node", "rep", "at"))
    again = cut(again.distinct().withColumn("key", F.lit(0).cast("long")))
    leads = again.select(F.col("rep").alias("node"), "rep", F.lit(0).cast("long").alias("at"), "key").distinct()
    second = compared(again.unionByName(leads), texts, width, span, similarity)
    names = ["node", "rep", "start", "end", "rep_start", "rep_end", "similarity"]
    return cut(first.where("start IS NOT NULL").select(*names).unionByName(second.where("start IS NOT NULL").select(*names)).distinct())


def _plain(found: DataFrame) -> DataFrame:
    """Passages without those that follow from two others: text and representative hold the stretch of a smaller representative, up to GAP words.

    Passages of a text meet only where they lie over the same cell of CELL words.
    """
    low, high = F.floor((F.col("start") - GAP) / CELL), F.floor((F.col("end") + GAP) / CELL)

    def of(name: str) -> DataFrame:
        return found.select(F.col("node").alias(f"{name}_node"), F.col("rep").alias(f"{name}_rep"), F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"), F.explode(F.sequence(low, high)).alias(f"{name}_cell"))

    mid, rep_mid = F.floor((F.col("start") + F.col("end")) / (2 * CELL)), F.floor((F.col("rep_start") + F.col("rep_end")) / (2 * CELL))
    placed = found.withColumns({"mid": mid, "rep_mid": rep_mid})
    ours = placed.join(of("a"), F.expr(f"node = a_node AND mid = a_cell AND a_rep < rep AND a_start <= start + {GAP} AND end <= a_end + {GAP}"))
    both = ours.join(of("b"), F.expr(f"rep = b_node AND rep_mid = b_cell AND a_rep = b_rep AND b_start <= rep_start + {GAP} AND rep_end <= b_end + {GAP}"), "left_semi")
    one = ["node", "rep", "start", "end", "rep_start"]
    return found.join(both.select(*one).distinct(), one, "left_anti")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, hashes: int = HASHES, enough: int = ENOUGH) -> DataFrame:
    """(doc_id, rep_id, start, end, rep_start, rep_end, similarity); positions count words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    ids, first = _distinct_texts(rows, min_words)
    lone = first.select("node", F.col("first").alias("_doc"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    own = (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_h1")) & (F.xxhash64(F.lit(1), "text") == F.col("_h2"))
    texts = rows.join(_small(lone), own).select("node", "text")
    found = _plain(links(texts, width, min_words, similarity, hashes, enough))
    names = first.where("node <> first").select("node", "first")
    for side, name in (("node", "doc_id"), ("rep", "rep_id")):
        found = found.join(_small(names.select(F.col("node").alias("_n"), F.col("first").alias("_f"))), F.col(side) == F.col("_n"), "left").withColumn(name, F.coalesce("_f", side)).drop("_n", "_f")
    passages = found.where("doc_id <> rep_id").select("doc_id", "rep_id", "start", "end", "rep_start", "rep_end", "similarity")
    # members of a class of equal texts: the whole text is the passage
    copied = cut(ids.join(first.where("n > 1").select("h1", "h2", "first"), ["h1", "h2"]).where("doc_id <> first"))
    size = F.size(F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), "[ \t\n\x0b\x0c\r]+")).cast("long")
    member = (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("h1")) & (F.xxhash64(F.lit(1), "text") == F.col("h2"))
    sized = rows.join(_small(copied.withColumnRenamed("doc_id", "_doc")), member).select("doc_id", F.col("first").alias("rep_id"), size.alias("end")).where(F.col("end") >= min_words).distinct()
    zero = F.lit(0).cast("long")
    return passages.unionByName(sized.select("doc_id", "rep_id", zero.alias("start"), "end", zero.alias("rep_start"), F.col("end").alias("rep_end"), F.lit(1.0).alias("similarity")))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: repeated passages of every document."""
    return repeated_passages(table(spark, sf_dir, "documents"))
