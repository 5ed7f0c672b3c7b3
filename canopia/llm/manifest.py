"""Merkle manifest of a dataset: a SHA-256 tree whose parents keep midstates.

Leaves are hashes of whole rows, made by Spark where the rows are. In each
group they are ranked by id without a global sort in one task: rows are
range-partitioned, and a partition's place is the count of what lies before it.
Runs of FAN nodes become their hash, LEVELS levels in one task, as blocks of
FAN ** LEVELS consecutive nodes stand alone; the tops of blocks are the nodes
of the next round, until one a group is left, and the groups' tops, ordered by
group, give the root the same way.

Proofs go down again. A parent hashes its children in order and retains a copy
of the hash state before each child slot. To fold a changed child, the copy at
its slot goes on with the replacement and the siblings to the right only. Of
the levels above a block one state and one run of right siblings a level are
retained, shared by all its leaves.

Defined results: a null column counts as `-`; null ids come first, rows of one
id by leaf; repeated rows are leaves of their own; a null group is a group, and
comes first; a group of one leaf has that leaf as its top, and a single group's
top is the root; long texts are hashed whole; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.llm.common import cut, table
from canopia.llm.trie import CRC32

FAN, LEVELS = 8, 4
#: Rows up to which a table of partition offsets or block tops is broadcast.
MOST_BROADCAST = 200_000
#: Rows that a task sorts when leaves are ranked.
SORTED = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def part(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[part(v) for v in values]).cast("binary"), 256)


def few(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, broadcast if a count finds it small."""
    return F.broadcast(df) if df.count() <= most else df


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `rank`, from 0, and `total` of each group; rows are cut, and read three times."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SORTED))
    asc = [F.col(c).asc_nulls_first() for c in [group, *order]]
    placed = cut(rows.repartitionByRange(parts, *asc).sortWithinPartitions(*asc).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    of_group = W.partitionBy(group)
    before = F.sum("_n").over(of_group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    # a row a partition, and one more for each group that ends inside it
    offsets = cut(counts.select(F.col("_part").alias("_p"), F.col(group).alias("_of"), (F.coalesce(before, F.lit(0)) - F.col("_from")).alias("_off"), F.sum("_n").over(of_group).alias("total")))
    on = (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_of"))
    return placed.join(few(offsets), on).withColumn("rank", F.col("_at") + F.col("_off")).drop("_at", "_part", "_p", "_of", "_off")


class Family:
    """A parent: the hash states before each child slot, the children, and the hash of all."""

    def __init__(self, children: list[str]):
        self.children, self.states = children, []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.hash = state.hexdigest()

    def fold(self, slot: int, child: str) -> str:
        """The hash with another child at the slot."""
        state = self.states[slot].copy()
        state.update("".join([child, *self.children[slot + 1 :]]).encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> str:
        return "".join(self.children[:slot] + self.children[slot + 1 :])


def families(nodes: list[str], total: int, fan: int, levels: int) -> list[list[Family]]:
    """The families of each level over a block's nodes; total is how many nodes the whole group has on the lowest level."""
    grown = []
    while total > 1 and len(grown) < levels:
        grown.append([Family(nodes[k : k + fan]) for k in range(0, len(nodes), fan)])
        nodes, total = [f.hash for f in grown[-1]], -(-total // fan)
    return grown


class Above:
    """The levels above a block: of each a retained state before its slot, the right siblings and all siblings."""

    def __init__(self, lefts: list[str], rights: list[str]):
        self.states, self.rights = [hashlib.sha256(x.encode()) for x in lefts], rights
        self.siblings = "".join(x + y for x, y in zip(lefts, rights, strict=True))

    def fold(self, child: str) -> str:
        for kept, right in zip(self.states, self.rights, strict=True):
            state = kept.copy()
            state.update((child + right).encode())
            child = state.hexdigest()
        return child


def _block(fan: int, levels: int) -> Column:
    return F.floor(F.col("rank") / F.lit(fan**levels)).cast("long").alias("_block")


def _texts(rows: list) -> pa.Array:
    return pa.array(rows, pa.list_(pa.string()))


def tops(nodes: DataFrame, group: str, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(group, rank, total, node) of the blocks' tops, from the same columns of a level's nodes."""
    kind = dict(nodes.dtypes)[group]

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("rank")
        hashes, total = block.column("node").to_pylist(), block.column("total")[0].as_py()
        grown = families(hashes, total, fan, levels)
        made = [[block.column("rank")[0].as_py() // fan**levels], [-(-total // fan**levels)], [grown[-1][0].hash if grown else hashes[0]]]
        return pa.table([block.column(group).slice(0, 1), *made], [group, "rank", "total", "node"])

    narrow = nodes.select(group, "rank", "total", "node", _block(fan, levels))
    return narrow.groupBy(group, "_block").applyInArrow(run, f"`{group}` {kind}, rank long, total long, node string")


def paths(nodes: DataFrame, above: DataFrame, group: str, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(group, rank, lefts, rights) of nodes (group, rank, total, node): each level's siblings on either side, up to the root.

    above is that of the next round's nodes, the tops of blocks.
    """
    kind = dict(nodes.dtypes)[group]

    def run(block: pa.Table, upper: pa.Table) -> pa.Table:
        block = block.sort_by("rank")
        lefts, rights = [], []
        if len(block):
            grown = families(block.column("node").to_pylist(), block.column("total")[0].as_py(), fan, levels)
            over_left, over_right = (upper.column(c)[0].as_py() for c in ("lefts", "rights"))
            for k in range(len(block)):
                own_left, own_right = [], []
                for level in grown:
                    family, slot = level[k // fan].children, k % fan
                    own_left.append("".join(family[:slot]))
                    own_right.append("".join(family[slot + 1 :]))
                    k //= fan
                lefts.append([*own_left, *over_left])
                rights.append([*own_right, *over_right])
        return pa.table([block.column(group), block.column("rank"), _texts(lefts), _texts(rights)], [group, "rank", "lefts", "rights"])

    left = nodes.select(group, "rank", "total", "node", _block(fan, levels)).groupBy(group, "_block")
    right = above.select(group, F.col("rank").alias("_block"), "lefts", "rights").groupBy(group, "_block")
    return left.cogroup(right).applyInArrow(run, f"`{group}` {kind}, rank long, lefts array<string>, rights array<string>")


def rounds(nodes: DataFrame, group: str, fan: int, levels: int) -> list[DataFrame]:
    """The nodes of every round, the lowest first, until each group has one."""
    found = [nodes]
    while not found[-1].where("total > 1").isEmpty():
        found.append(cut(tops(found[-1], group, fan, levels)))
    return found


def folded(leaves: DataFrame, above: DataFrame, group: str, fan: int, levels: int, proofs: bool) -> DataFrame:
    """leaves with proof_sha256 and folded_root, and with proofs lefts and rights; above is of the tops of their blocks."""
    columns = [c for c in leaves.columns if c != "_block"]
    kinds = dict(leaves.dtypes)
    names = ["proof_sha256", "folded_root", *(("lefts", "rights") if proofs else ())]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "proof_sha256 string, folded_root string", *(["lefts array<string>, rights array<string>"] if proofs else [])])

    def run(block: pa.Table, upper: pa.Table) -> pa.Table:
        block = block.sort_by("rank")
        digests, roots, lefts, rights = [], [], [], []
        if len(block):
            hashes, changed = block.column("leaf").to_pylist(), block.column("changed").to_pylist()
            grown = families(hashes, block.column("total")[0].as_py(), fan, levels)
            over_left, over_right = (upper.column(c)[0].as_py() for c in ("lefts", "rights"))
            over = Above(over_left, over_right)
            for k, (leaf, other) in enumerate(zip(hashes, changed, strict=True)):
                node, beside, own_left, own_right = other or leaf, [], [], []
                for level in grown:
                    family, slot = level[k // fan], k % fan
                    node = family.fold(slot, node)
                    beside.append(family.siblings(slot))
                    if proofs:
                        own_left.append("".join(family.children[:slot]))
                        own_right.append("".join(family.children[slot + 1 :]))
                    k //= fan
                digests.append(hashlib.sha256(("".join(beside) + over.siblings).encode()).hexdigest())
                roots.append(over.fold(node))
                lefts.append([*own_left, *over_left])
                rights.append([*own_right, *over_right])
        made = [pa.array(digests, pa.string()), pa.array(roots, pa.string()), *((_texts(lefts), _texts(rights)) if proofs else ())]
        return pa.table([*(block.column(c) for c in columns), *made], [*columns, *names])

    left = leaves.withColumn("_block", _block(fan, levels)).groupBy(group, "_block")
    right = above.select(group, F.col("rank").alias("_block"), "lefts", "rights").groupBy(group, "_block")
    return left.cogroup(right).applyInArrow(run, schema)


def manifest(leaves: DataFrame, group: str, order: list[str], fan: int = FAN, levels: int = LEVELS, proofs: bool = True) -> DataFrame:
    """A row per leaf of leaves (group, order..., leaf, changed): these columns, rank, total, subroot, root, proof_sha256, folded_root.

    leaf is a hash, changed the one that folds to folded_root (null: the leaf
    itself). proof_sha256 is of all siblings up to the root; with proofs, lefts
    and rights hold those on either side, a string of joined hashes a level.
    """
    leaves = cut(leaves.select(*dict.fromkeys([group, *order, "leaf", "changed"])))
    placed = cut(ranked(leaves, group, [*order, "leaf"]))
    low = rounds(placed.select(group, "rank", "total", F.col("leaf").alias("node")), group, fan, levels)
    # the groups' tops are the leaves of the upper tree, in which all are one group
    subroots = low[-1].select(F.col(group).alias("_g"), F.col("node").alias("leaf"), F.lit(0).alias("_all"))
    over = cut(ranked(subroots, "_all", ["_g"]))
    high = rounds(over.select("_all", "rank", "total", F.col("leaf").alias("node")), "_all", fan, levels)
    root = high[-1].select("node").first()
    none = F.array().cast("array<string>")
    down = high[-1].select("_all", "rank", none.alias("lefts"), none.alias("rights"))
    for nodes in high[-2::-1]:
        down = cut(paths(nodes, down, "_all", fan, levels))
    named = over.join(down.select("rank", "lefts", "rights"), "rank")
    down = cut(named.select(F.col("_g").alias(group), F.lit(0).cast("long").alias("rank"), "lefts", "rights"))
    for nodes in low[-2:0:-1]:
        down = cut(paths(nodes, down, group, fan, levels))
    found = folded(placed, down, group, fan, levels, proofs)
    subroot = few(over.select("_g", F.col("leaf").alias("subroot")))
    return found.join(subroot, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").withColumn("root", F.lit(root["node"] if root else None))


def tampered(docs: DataFrame, columns: list[str], text: str, which: Column) -> DataFrame:
    """docs with leaf and changed: the hash of the columns, and where `which` that of the text with A-Z lower-cased."""
    lower = F.translate(F.col(text).cast("string"), UPPER, LOWER)
    return docs.withColumns({"leaf": row_hash(*map(F.col, columns)), "changed": F.when(which, row_hash(*[lower if c == text else F.col(c) for c in columns]))})


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def query(spark, sf_dir: str) -> DataFrame:
    """op13: leaf, roots, proof and tampering check of every document."""
    which = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = tampered(table(spark, sf_dir, "documents").select(COLUMNS), COLUMNS, "text", which)
    found = manifest(leaves, "lang", ["doc_id"], proofs=False)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(low: int = 8, high: int = 3) -> str:
    """The query in DuckDB, for 8 ** low documents a language and 8 ** high languages."""
    part = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
    whole = " || ".join(part.format(c) for c in COLUMNS)
    changed = " || ".join(part.format(f"translate(text, '{UPPER}', '{LOWER}')" if c == "text" else c) for c in COLUMNS)
    steps = [
        f"d AS (SELECT *, CAST(doc_id AS VARCHAR) AS s, sha256({whole}) AS leaf, sha256({changed}) AS low FROM documents)",
        f"n0 AS (SELECT lang, doc_id, leaf, CASE WHEN {CRC32} % 3 = 0 THEN low ELSE leaf END AS fold, '' AS proof, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM d)",
        "t0 AS (SELECT lang AS g, i, h, count(*) OVER (PARTITION BY lang) AS n FROM n0)",
    ]

    def climb(leaves: str, tree: str, g: str, levels: int) -> None:
        for k in range(levels):
            steps.append(f"f{tree}{k} AS (SELECT g, i // 8 AS j, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {tree}{k} GROUP BY g, i // 8)")
            steps.append(f"{tree}{k + 1} AS (SELECT g, j AS i, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (n + 7) // 8 AS n FROM f{tree}{k})")
            slot = f"({leaves}{k}.i // {8**k} % 8)"
            side = f"hs[1:{slot}]", f"hs[{slot} + 2:]"
            steps.append(
                f"{leaves}{k + 1} AS (SELECT {leaves}{k}.* REPLACE (CASE WHEN n > 1 THEN sha256(array_to_string({side[0]} || [fold] || {side[1]}, '')) ELSE fold END AS fold,"
                f" CASE WHEN n > 1 THEN proof || array_to_string({side[0]} || {side[1]}, '') ELSE proof END AS proof) FROM {leaves}{k} JOIN f{tree}{k} f ON f.g IS NOT DISTINCT FROM {g} AND f.j = {leaves}{k}.i // {8 ** (k + 1)})"
            )

    climb("n", "t", "lang", low)
    steps.append(f"u AS (SELECT g AS lang, h AS subroot, ROW_NUMBER() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i FROM t{low})")
    steps.append("v0 AS (SELECT 0 AS g, i, subroot AS h, count(*) OVER () AS n FROM u)")
    steps.append(f"m0 AS (SELECT n{low}.* REPLACE (u.i AS i), subroot FROM n{low} JOIN u ON u.lang IS NOT DISTINCT FROM n{low}.lang)")
    climb("m", "v", "0", high)
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, v{high}.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = v{high}.h AS verified FROM m{high} JOIN v{high} ON true"


ORACLE = _oracle()
