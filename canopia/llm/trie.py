"""Prefix trie of conversations by truncation peeling.

A turn is 128 bits of hash and a length, so texts never move. Conversations are
range-partitioned and sorted by their whole path of turn hashes: a prefix that a
third of them share spreads over many partitions, and copies lie side by side.
A task peels its partition from the greatest depth upwards: conversations that
end at the depth join the nodes that survive from below, equal prefixes are one
node, its figures are summed, the last turn is stripped, and what remains is
grouped again. A node is thus found and aggregated in the same step.

Only nodes on the path of a partition's first or last conversation may go on in
another partition. Each partition hands on those two paths with what the closed
subtrees beside them amount to, and the same peeling runs over them, FAN
partitions at a time, until one is left. No row is ever expanded into its
prefixes, and the number of Spark jobs does not follow the depth.

Defined results: rows without conv_id are no conversations; a null role or text
is an empty one; turns come in ascending order, null first, those of one number
by role and text, and repeated rows are turns of their own; turnless
conversations end at the root; an empty table has no node; other columns are
ignored. A conversation is one row of 24 bytes a turn, so one of many million
turns is the limit of a task, not its text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.llm.common import cut, table, written

#: Turns and conversations that a task peels; chains of how many partitions the next task merges.
TURNS, FAN = 1 << 20, 256
#: Characters of ids that a row hands on where the conversations that end at a node cross partitions.
CHUNK = 4096
#: Kinds of rows that a task returns.
NODE, CHAIN, IDS = 0, 1, 2
#: No conversation.
NOBODY = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()
#: Mark of a chain's end whose conversations may go on in another partition.
SPLIT = "split"

SUMS = ("n", "least", "kids", "leaves", "saved")
MADE = pa.schema(
    [("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.int64()), ("up", pa.binary()), ("own", pa.binary())]
    + [(c, pa.int64()) for c in ("n", "kids", "leaves", "saved")]
    + [("ends", pa.string()), ("ids", pa.string()), ("path", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64()))]
    + [(f"{c}_at", pa.list_(pa.int64())) for c in SUMS]
    + [("ends_at", pa.list_(pa.string()))]
)
SCHEMA = ", ".join(
    ["kind int, conv_id long, depth long, parent long, up binary, own binary, n long, kids long, leaves long, saved long, ends string, ids string, path array<long>, chars array<long>"]
    + [f"{c}_at array<long>" for c in SUMS]
    + ["ends_at array<string>"]
)


def gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, block, own): each conversation's turns in order as (a, b, chars), hashes and code points.

    block is conv_id - conv_id % 100, by which rows are partitioned; texts are
    compared only where several rows of a conversation have one turn number.
    """
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    hashes = [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "role", "text").alias("b"), F.length("text").cast("long").alias("chars")]
    tied = rows.groupBy("conv_id", "turn").count().where("count > 1").select(F.col("conv_id").alias("tied_id"), F.col("turn").alias("tied_turn"))
    tied = cut(tied)
    on = (F.col("conv_id") == F.col("tied_id")) & F.col("turn").eqNullSafe(F.col("tied_turn"))
    narrow = ["conv_id", "turn", "place", "a", "b", "chars"]
    if tied.isEmpty():
        placed = rows.select("conv_id", "turn", F.lit(0).alias("place"), *hashes)
    else:
        alone = rows.join(tied, on, "left_anti").select("conv_id", "turn", F.lit(0).alias("place"), *hashes)
        order = W.partitionBy("conv_id", "turn").orderBy("role", "text")
        placed = alone.unionByName(rows.join(tied, on, "left_semi").withColumn("place", F.row_number().over(order)).select("conv_id", "turn", "place", *hashes))
    block = F.col("conv_id") - F.col("conv_id") % 100
    spread = placed.select(block.alias("block"), *narrow).repartition("block")
    turn = F.struct("turn", "place", "a", "b", "chars")
    return spread.groupBy("block", "conv_id").agg(F.sort_array(F.collect_list(turn)).alias("own"))


def paths(convs: DataFrame, own: str = "own") -> DataFrame:
    """(conv_id, path, chars) of conversations (conv_id, own), own as in `gathered`."""
    return convs.select("conv_id", F.flatten(F.transform(own, lambda t: F.array(t["a"], t["b"]))).alias("path"), F.transform(own, lambda t: t["chars"]).alias("chars"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations whose first h turns are those of their block's first one; h is crc32 of the id modulo 6."""
    heads = convs.where("conv_id = block").select("block", F.slice("own", 1, 5).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    none = F.slice("own", 1, 0)
    whole = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return convs.join(heads, "block", "left").withColumn("h", h).select("conv_id", whole.alias("own"))


def common_depths(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many leading turns each path shares with the one before it (-1 for the first); two values a turn."""
    found = np.full(len(size), -1, np.int64)
    if len(size) < 2:
        return found
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    both = np.minimum(size[1:], size[:-1])
    row = np.repeat(np.arange(1, len(size)), both)
    at = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
    pairs = values.reshape(-1, 2)
    differs = np.flatnonzero((pairs[start[row] + at] != pairs[start[row - 1] + at]).any(axis=1))
    found[1:] = both
    rows, first = np.unique(row[differs], return_index=True)
    found[rows] = at[differs[first]]
    return found


def _first_paths(shared: np.ndarray, size: int) -> np.ndarray:
    """For each depth up to size the first path that shares that prefix with the last one."""
    found = np.zeros(size + 1, np.int64)
    short = np.flatnonzero(shared < size)
    np.maximum.at(found, np.maximum(shared[short], -1) + 1, short)  # a path that shares k turns with the one before starts depths beyond k
    return np.maximum.accumulate(found)


def _keys(path: np.ndarray) -> list[bytes]:
    """A key for each prefix of a path, the empty one first."""
    state, keys = hashlib.blake2b(digest_size=16), []
    for turn in path.reshape(-1, 2):
        keys.append(state.copy().digest())
        state.update(turn.tobytes())
    return [*keys, state.digest()]


class _Run:
    """Sorted paths with what is known of their prefixes, and the codes of ends: 0 none, 1 split, then digests."""

    def __init__(self, values, size, chars, extras, ends):
        self.values, self.size, self.chars, self.extras, self.ends = values, size, chars, extras, ends
        self.start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        self.shared = common_depths(values, size)

    def path(self, row: int) -> np.ndarray:
        return self.values[2 * self.start[row] : 2 * (self.start[row] + self.size[row])]


def peel(run: _Run, last: bool):
    """(closed nodes, chains): nodes as arrays, chains of the first and last path, none if last.

    extras of a run are arrays (row, depth, n, least, kids, leaves, saved,
    code): what ends at a prefix and what closed subtrees below it amount to.
    """
    n_rows = len(run.size)
    edges = [] if last else sorted({0, n_rows - 1})
    # an open node counts from its first path: those between it and the last one may have no figures left above
    place = {r: _first_paths(run.shared, int(run.size[r])) if r else np.zeros(run.size[r] + 1, np.int64) for r in edges}
    zero = [np.concatenate([place[r] for r in edges]) if edges else np.zeros(0, np.int64), np.array([d for r in edges for d in range(run.size[r] + 1)], np.int64)]
    pad = [np.zeros(len(zero[0]), np.int64)] * 6
    pad[1] = np.full(len(zero[0]), NOBODY)
    extras = [np.concatenate((x, y)).astype(np.int64) for x, y in zip(run.extras, [*zero, *pad], strict=True)]
    order = np.lexsort((extras[0], -extras[1]))
    extras = [x[order] for x in extras]
    bounds = np.searchsorted(-extras[1], np.arange(-int(run.size.max()), 2))
    chains = {r: np.zeros((run.size[r] + 1, 6), np.int64) for r in edges}
    for chain in chains.values():
        chain[:, 1] = NOBODY
    keys = {r: _keys(run.path(r)) for r in edges}
    made, pending = [], None
    for step, depth in enumerate(range(int(run.size.max()), -1, -1)):
        new = [x[bounds[step] : bounds[step + 1]] for x in extras]
        row, sums = new[0], new[2:]
        if pending is not None:
            row = np.concatenate((pending["row"], row))
            one = np.ones(len(pending["row"]), np.int64)
            below = [pending["n"], pending["least"], one, pending["leaves"], pending["saved"], 0 * one]
            sums = [np.concatenate(x) for x in zip(below, sums, strict=True)]
        if not len(row):
            continue
        order = np.argsort(row, kind="stable")
        row, sums = row[order], [x[order] for x in sums]
        first = np.concatenate(([True], (row[1:] != row[:-1]) & (run.shared[row[1:]] < depth)))
        at = np.flatnonzero(first)
        n, least, kids, leaves, saved, code = (f.reduceat(x, at) for f, x in zip((np.add, np.minimum, np.add, np.add, np.add, np.maximum), sums, strict=True))
        head, closed = row[at], np.ones(len(at), bool)
        side = np.full(len(at), -1)
        for r in edges:
            if run.size[r] >= depth:
                g = 0 if r == 0 else len(at) - 1
                if closed[g]:
                    chains[r][depth] = n[g], least[g], kids[g], leaves[g], saved[g], code[g]
                    closed[g], side[g] = False, r
        if pending is not None:
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(first) - 1
            group = group[: len(pending["row"])]
            pending["parent"] = np.where(closed[group], least[group], NOBODY)
            pending["up"] = [None if r < 0 else keys[r][depth] for r in side[group].tolist()]
            made.append(pending)
        leaves = np.where(kids == 0, 1, leaves)
        text = run.chars[run.start[head] + depth - 1] if depth else 0
        found = {"row": head, "n": n, "least": least, "kids": kids, "leaves": leaves, "saved": saved + (n - 1) * text, "code": code}
        pending = {k: v[closed] for k, v in found.items()} | {"depth": depth}
        pending = pending if len(pending["row"]) else None
    if pending is not None:
        made.append(pending | {"parent": np.full(len(pending["row"]), NOBODY), "up": [None] * len(pending["row"])})
    return made, chains


def _batch(rows: int, **columns) -> pa.RecordBatch:
    """A batch of so many rows of MADE, null in the columns not given."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in MADE], schema=MADE)


def _numbers(found: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in found]).astype(np.int64)


def _lists(found: list[pa.RecordBatch], name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and how many each row has."""
    values = np.concatenate([b.column(name).flatten().to_numpy(zero_copy_only=False) for b in found])
    return values, np.concatenate([pc.list_value_length(b.column(name)).to_numpy(zero_copy_only=False) for b in found]).astype(np.int64)


def _conversations(found: list[pa.RecordBatch], last: bool):
    """The run of sorted conversations, each distinct sequence once, and the ids of those at the edges."""
    values, size = _lists(found, "path")
    values, size = values.astype(np.int64), size // 2
    chars, ids = _lists(found, "chars")[0].astype(np.int64), _numbers(found, "conv_id")
    shared = common_depths(values, size)
    first = np.concatenate(([True], (shared[1:] != size[1:]) | (size[1:] != size[:-1])))
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(ids)))
    keep = np.repeat(first, size)
    said = [str(x) for x in ids.tolist()]
    edges = set() if last else {0, len(at) - 1}
    ends, code = [], np.ones(len(at), np.int64)
    for k, (s, c) in enumerate(zip(at.tolist(), count.tolist(), strict=True)):
        if k not in edges:
            code[k] = 2 + len(ends)
            ends.append(hashlib.sha256((said[s] if c == 1 else ",".join(said[s : s + c])).encode()).hexdigest())
    none = np.zeros(len(at), np.int64)
    run = _Run(values[np.repeat(keep, 2)], size[at], chars[keep], [np.arange(len(at)), size[at], count, ids[at], none, none, none, code], ends)
    return run, {k: (ids[at[k] : at[k] + count[k]].tolist(), said[at[k] : at[k] + count[k]]) for k in edges}, ids[at]


def _chains(found: list[pa.RecordBatch]):
    """The run of sorted chains."""
    values, size = _lists(found, "path")
    size = size // 2
    sums = [_lists(found, f"{c}_at")[0].astype(np.int64) for c in SUMS]
    said = [x for b in found for row in b.column("ends_at").to_pylist() for x in row]
    ends = sorted({x for x in said if x and x != SPLIT})
    codes = {x: k + 2 for k, x in enumerate(ends)} | {SPLIT: 1, None: 0}
    row = np.repeat(np.arange(len(size)), size + 1)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    return _Run(values.astype(np.int64), size, _lists(found, "chars")[0].astype(np.int64), [row, depth, *sums, np.array([codes[x] for x in said], np.int64)], ends), _numbers(found, "conv_id")


def _task(last: bool, chained: bool):
    def run(batches):
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        if chained:
            (paths, ids), edges = _chains(found), {}
        else:
            paths, edges, ids = _conversations(found, last)
        own = [_keys(paths.path(r)) for r in range(len(paths.size))] if chained else None
        say = np.array([EMPTY, None, *paths.ends], object)
        nodes, chains = peel(paths, last)
        for x in nodes:
            m, top = len(x["row"]), x["parent"] == NOBODY
            keys = [own[r][x["depth"]] for r in x["row"].tolist()] if chained else [None] * m
            yield _batch(m, kind=np.zeros(m, np.int32), conv_id=x["least"], depth=np.full(m, x["depth"]), parent=pa.array(x["parent"], mask=top), up=x["up"], own=keys, n=x["n"], kids=x["kids"], leaves=x["leaves"], saved=x["saved"], ends=say[x["code"]])
        for r, sums in chains.items():
            at = paths.start[r]
            ends = [SPLIT if c == 1 else None if c == 0 else say[c] for c in sums[:, 5].tolist()]
            lists = {f"{c}_at": [sums[:, k].tolist()] for k, c in enumerate(SUMS)}
            yield _batch(1, kind=[CHAIN], conv_id=[ids[r]], path=[paths.path(r).tolist()], chars=[paths.chars[at : at + paths.size[r]].tolist()], ends_at=[ends], **lists)
        for r, (numbers, said) in edges.items():
            key, step = _keys(paths.path(r))[-1], CHUNK // 20
            for s in range(0, len(said), step * 64):
                parts = range(s, min(len(said), s + step * 64), step)
                yield _batch(len(parts), kind=[IDS] * len(parts), own=[key] * len(parts), conv_id=[numbers[p] for p in parts], ids=[",".join(said[p : p + step]) for p in parts])

    return run


def _digests(batches):
    """Digests of joined ids; rows (own, conv_id, ids) come sorted."""
    key, state = None, None
    for batch in batches:
        own, said = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for k, ids in zip(own, said, strict=True):
            if k != key:
                if state is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["own", "digest"])
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["own", "digest"])


def trie(convs: DataFrame, turns_a_task: int = TURNS, fan: int = FAN) -> DataFrame:
    """A row per node of conversations (conv_id, path, chars): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    (conv_id, depth) is the node's key; its last turn is that conversation's
    turn number depth. saved_tokens counts code points.
    """
    spark = convs.sparkSession
    rows = cut(convs.select("path", "chars", "conv_id"))
    total = rows.agg(F.coalesce(F.sum(F.size("chars") + 1), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-total // turns_a_task))
    levels = []
    while not levels or parts > 1:
        parts = max(1, parts // fan) if levels else parts
        spread = rows.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
        levels.append(written(spread.mapInArrow(_task(parts == 1, bool(levels)), SCHEMA)))
        rows = levels[-1].where(F.col("kind") == CHAIN).select("path", "chars", "conv_id", *[f"{c}_at" for c in SUMS], "ends_at")
    columns = ["conv_id", "depth", "parent", "up", "own", "n", "kids", "leaves", "saved", "ends"]
    first, later = levels[0].where(F.col("kind") == NODE).select(columns), None
    if len(levels) > 1:
        for level in levels[1:]:
            some = level.where(F.col("kind") == NODE).select(columns)
            later = some if later is None else later.unionByName(some)
        ids = levels[0].where(F.col("kind") == IDS).select("own", "conv_id", "ids")
        digests = ids.repartition("own").sortWithinPartitions("own", "conv_id").mapInArrow(_digests, "own binary, digest string")
        # once open nodes: at most the depth of two paths a partition
        later = cut(later.join(digests, "own", "left").withColumn("ends", F.coalesce("ends", "digest")).select(columns))
        nodes = first.unionByName(later)
        known = later.select(F.col("own").alias("up"), F.col("conv_id").alias("upper"))
        below = nodes.where("up IS NOT NULL").join(known, "up").withColumn("parent", F.col("upper")).select(columns)
        first = nodes.where("up IS NULL").unionByName(below)
    return first.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the trie of all conversations, rebuilt with shared heads."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(paths(rebuilt(gathered(turns))))


#: crc32 of the ASCII text s, bit by bit.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(s[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""
#: The query in DuckDB.
ORACLE = f"""
WITH t AS (
    SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT *, conv_id - conv_id % 100 AS block, CAST({CRC32} % 6 AS INT) AS h FROM (SELECT *, CAST(conv_id AS VARCHAR) AS s FROM t)),
f AS (SELECT c.conv_id, coalesce(b.own, [])[1:c.h] || c.own[c.h + 1:] AS seq FROM c LEFT JOIN c b ON b.conv_id = c.block),
p AS (SELECT conv_id, d, seq[1:d] AS pre, seq[1:d - 1] AS up, len(seq) = d AS stops, CASE WHEN d > 0 THEN length(seq[d].t) ELSE 0 END AS chars FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM f)),
n AS (
    SELECT d, pre, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n, any_value(chars) AS chars,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (stops), '')) AS ends
    FROM p GROUP BY d, pre),
k AS (SELECT d - 1 AS d, up AS pre, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON k.d = n.d AND k.pre = n.pre),
u AS (SELECT e, pre[1:e] AS pre, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * chars) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM m) GROUP BY ALL)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n AS n_convs, CAST(m.kids AS BIGINT) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN u ON u.e = m.d AND u.pre = m.pre LEFT JOIN n q ON q.d = m.d - 1 AND q.pre = m.up
"""
