"""SimHash near-duplicates: generalised pigeonhole over correlated bit groups.

64-bit fingerprints of word shingles are linked when they differ in few bits.
The bits that vary at all are grouped so that correlated bits share a
partition; a dynamic program gives each partition its own threshold from
estimated candidate counts, within a bound on the rows that a fingerprint costs;
a fingerprint probes the neighbours of its partition value up to that
threshold, and every candidate is verified on all 64 bits. The thresholds add
up to tau - partitions + 1, so no link is missed (thresholds of -1 leave a
partition out).

Components need no link twice. Where so many fingerprints share a key that
their pairs would cost more than that, each goes to all values within half of
tau of it, over the bits that vary among them: two fingerprints are within tau
exactly if they meet at such a value, and all that meet at one hang on the
smallest. So a crowd costs rows in proportion to its size.

Defined results: a null or blank text has fingerprint zero and is linked like
any other; repeated rows share a fingerprint; a row without doc_id joins the
component of its fingerprint but never names or bridges one (null if no other
row has it); very long texts count whole; columns other than the id and the text
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.llm.common import ASCII_LOWER, connected_components, cut, slices

BITS, SEED = 64, 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: Distinct fingerprints that may share a partition value before its remaining bits split it.
HEAVY = 2048
#: Values of a cell up to which their pairs are always joined, and cells up to which a table of them is broadcast.
LEAST_DENSE, MOST_BROADCAST = 128, 500_000
#: Index and probe rows a fingerprint may cost; bounds the shuffle. One partition per bit of tau and one more costs 2 (tau + 1).
MOST_ROWS = 64


def fingerprint(text: str | None, width: int = 4) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    starts = np.concatenate(([0], ends[:-1]))[: max(1, len(words) - width + 1)]
    ends = (ends - 1)[min(width, len(words)) - 1 :]
    ones, hashed = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        span = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        values = np.array([hashed(joined[s:e], SEED) for s, e in span], dtype=">u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp) with fp as a signed long, a row per row of docs."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, width) for _, run in slices(batch, 1) for t in run]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, over all of them, how often bits i and j are both set (64 by 64)."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy().astype(">i8"))
            for at in range(0, len(values), BLOCK):
                bits = np.unpackbits(values[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
                both += bits.T @ bits
            n += len(values)
        if n:
            i, j = np.indices((BITS, BITS))
            cells = [np.append(i.ravel() * BITS + j.ravel(), -1), np.append(both.ravel(), n).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], ["cell", "n"])

    # 4097 sums, whatever the input
    sums = dict(fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect())
    both = np.array([sums.get(c, 0) for c in range(BITS * BITS)], dtype=float).reshape(BITS, BITS)
    return sums.get(-1, 0), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits that vary in up to `parts` groups of equal size; each group grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = {b for b in range(BITS) if 0 < np.diag(both)[b] < n}, []
    for k in range(parts):
        size = len(free) // (parts - k)
        if not size:
            continue
        group = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        while len(group) < size:
            group.append(max(free - set(group), key=lambda b: (corr[b, group].sum(), -b)))
        groups.append(sorted(group))
        free -= set(group)
    return groups


def estimate(n: int, both: np.ndarray, groups: list[list[int]], repeated: list[float], most: int) -> np.ndarray:
    """Candidate pairs by group and threshold 0..most, from the bits' frequencies and the pairs known to share a value."""
    p = np.diag(both) / max(n, 1)
    out = np.zeros((len(groups), most + 1))
    for g, group in enumerate(groups):
        law = np.array([1.0])
        for b in group:
            differ = 2 * p[b] * (1 - p[b])
            law = np.convolve(law, [1 - differ, differ])
        out[g] = n * n / 2 * np.cumsum(law)[: most + 1] + repeated[g]
    return out


def allocate(cost: np.ndarray, total: int, rows: np.ndarray | None = None, most: int = 0) -> list[int]:
    """Thresholds from -1 up, one a group, that add up to `total` at least cost; cost[g, e], with -1 free.

    With rows[g, e], what a fingerprint then costs, their sum stays within `most`.
    """
    best: dict[tuple[int, int], tuple[float, list[int]]] = {(0, 0): (0.0, [])}
    for g, row in enumerate(cost):
        step: dict[tuple[int, int], tuple[float, list[int]]] = {}
        for ((used, spent), (paid, chosen)), e in itertools.product(best.items(), range(-1, len(row))):
            value = paid + (row[e] if e >= 0 else 0.0)
            at = used + e, spent + (int(rows[g, e]) if rows is not None and e >= 0 else 0)
            if (rows is None or at[1] <= most) and value < step.get(at, (math.inf, []))[0]:
                step[at] = (value, [*chosen, e])
        best = step
    return min((x for (used, _), x in best.items() if used == total), key=lambda x: x[0])[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def plan(fps: DataFrame, tau: int = 4) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use, chosen over 2 to tau + 1 partitions; none if no bit varies."""
    n, both = bit_statistics(fps)
    layouts = {m: groups for m in range(2, tau + 2) if len(groups := group_bits(n, both, m)) == m}
    if not layouts:  # so few bits vary that one partition holds them: its key is the same for all
        return [([], 0)] if n else []
    masks = [(m, g, _mask(bits)) for m, groups in layouts.items() for g, bits in enumerate(groups)]
    keys = fps.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for _, _, x in masks])).alias("k", "key"))
    counts = keys.groupBy("k", "key").count().groupBy("k").agg(F.sum(F.expr("count * (count - 1D) / 2")))
    repeated = dict(counts.collect())  # a row for each of 14 masks
    best = None
    for m, groups in layouts.items():
        most = tau - m + 1
        known = [repeated.get(k, 0.0) for k, (of, _, _) in enumerate(masks) if of == m]
        rows = np.array([[1 + sum(math.comb(len(b), i) for i in range(e + 1)) for e in range(most + 2)] for b in groups])
        cost = 2 * estimate(n, both, groups, known, most + 1) + n * rows
        try:
            chosen = allocate(cost, most, rows, max(MOST_ROWS, 2 * (tau + 1)))
        except ValueError:  # a layout of few partitions may have no plan within the bound; that of tau + 1, if there is one, always has
            continue
        paid = sum(cost[g, e] for g, e in enumerate(chosen) if e >= 0)
        if best is None or paid < best[0]:
            best = (paid, [(b, e) for b, e in zip(groups, chosen, strict=True) if e >= 0])
    return best[1] if best else [([], 0)]


def _candidates(fps: DataFrame, tau: int, heavy: int) -> tuple[DataFrame, DataFrame]:
    """Probe rows (g, key, block, a) and index rows (g, key, block, b) of distinct fps; keys of over `heavy` values are split by their other bits."""
    index, probe = [], []
    parts = plan(fps, tau)
    for g, (bits, e) in enumerate(parts):
        # the constant keeps partitions apart; a clash only costs a verification
        salt = _signed(0x9E3779B97F4A7C15 * (g + 1) % (1 << 64))
        own = f"(fp & {_mask(bits)}L ^ {salt}L)"
        index.append(f"struct({g} AS g, {own} AS key)")
        probe += [f"struct({g} AS g, {own} ^ {_mask(c)}L AS key)" for k in range(e + 1) for c in itertools.combinations(bits, k)]
    if not parts:
        index = probe = ["struct(0 AS g, 0L AS key)"]
    left = fps.select("fp", F.expr(f"explode(array({', '.join(probe)})) AS p")).select("p.g", "p.key", F.col("fp").alias("a"))
    right = fps.select("fp", F.expr(f"explode(array({', '.join(index)})) AS p")).select("p.g", "p.key", F.col("fp").alias("b"))
    crowded = cut(right.groupBy("g", "key").count().where(F.col("count") > heavy).select("g", "key", F.lit(True).alias("crowded")))
    if crowded.isEmpty():
        return left.withColumn("block", F.lit(0).cast("long")), right.withColumn("block", F.lit(0).cast("long"))
    return _split(left, "a", crowded, parts, tau), _split(right, "b", crowded, parts, tau)


def links(fps: DataFrame, tau: int = 4, heavy: int = HEAVY) -> DataFrame:
    """(a, b) with a < b for all pairs of distinct values fp that differ in 1 to tau bits."""
    left, right = _candidates(fps.select("fp").distinct(), tau, heavy)
    return _pairs(left, right, tau)


def _pairs(left: DataFrame, right: DataFrame, tau: int) -> DataFrame:
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau
    return left.drop("g").join(right.drop("g").hint("merge"), ["key", "block"]).where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def bonds(fps: DataFrame, tau: int = 4, heavy: int = HEAVY) -> DataFrame:
    """(a, b): links of distinct values fp, not all of them but enough to join what links join.

    A value of a dense cell makes a row for each of its neighbours half-way, up
    to 2,081 where all 64 bits vary; an odd tau compares all pairs of a cell.
    Rows that explode makes are merged: Spark would broadcast them at the size of
    the rows that they are made from, and the driver holds what is broadcast.
    """
    left, right = (x.drop("g") for x in _candidates(fps.select("fp").distinct(), tau, heavy))
    left, right = cut(left), cut(right)
    bits = F.expr("bit_count(bit_or(b) ^ bit_and(b))")
    cells = right.groupBy("key", "block").agg(F.count("*").alias("n"), bits.alias("vary"))
    half = tau // 2
    reach = sum((F.when(F.col("vary") >= i, F.expr(" * ".join([f"(vary - {j})" for j in range(i)])) / math.factorial(i)).otherwise(0) for i in range(1, half + 1)), F.lit(1))
    dense = cut(cells.where((F.col("n") > LEAST_DENSE) & (F.col("n") > reach)).select("key", "block"))
    if tau % 2 or dense.isEmpty():
        return _pairs(left.withColumn("g", F.lit(0)), right.withColumn("g", F.lit(0)), tau)
    held = F.broadcast if dense.count() <= MOST_BROADCAST else (lambda cells: cells.hint("merge"))
    few = held(dense)
    thin = [x.join(few, ["key", "block"], "left_anti").withColumn("g", F.lit(0)) for x in (left, right)]
    # probes may come from other keys: all that meet in a dense cell, each with the bits that vary there
    members = left.select("key", "block", F.col("a").alias("fp")).unionByName(right.select("key", "block", F.col("b").alias("fp"))).join(few, ["key", "block"])
    varying = members.groupBy("key", "block").agg(F.expr("bit_or(fp) ^ bit_and(fp)").alias("mask"))
    own = members.join(held(varying), ["key", "block"]).select("fp", "mask").distinct()
    spots = own.select("fp", F.explode(_within(F.col("fp"), F.col("mask"), half)).alias("spot"))
    least = spots.groupBy("spot").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("spot", "a")
    met = spots.join(least.hint("merge"), "spot").where("a < fp").select("a", F.col("fp").alias("b")).distinct()
    return _pairs(*thin, tau).unionByName(met).distinct()


def _within(fp, mask, most: int):
    """The value and all that differ from it in up to `most` bits of mask, as an array Column."""
    bits = F.filter(F.array(*[F.lit(_signed(1 << b)) for b in range(BITS)]), lambda b: b.bitwiseAND(mask) != 0)
    found = level = F.array(F.struct(F.lit(0).cast("long").alias("flip"), F.lit(0).alias("next")))
    for _ in range(most):
        level = F.flatten(F.transform(level, lambda x: F.transform(F.slice(bits, x["next"] + 1, F.lit(BITS)), lambda b, i: F.struct(x["flip"].bitwiseXOR(b).alias("flip"), (x["next"] + i + 1).alias("next")))))
        found = F.concat(found, level)
    return F.transform(found, lambda x: x["flip"].bitwiseXOR(fp))


def _split(rows: DataFrame, fp: str, crowded: DataFrame, parts, tau: int) -> DataFrame:
    """Rows of crowded keys become tau + 1 rows, one for each block of the bits outside the partition: two values within tau agree on one block."""
    blocks = []
    for bits, _ in parts:
        rest = [b for b in range(BITS) if b not in bits]
        blocks.append(F.array(*[F.xxhash64(F.lit(k), F.col(fp).bitwiseAND(F.lit(_mask(rest[k :: tau + 1])))) for k in range(tau + 1)]))
    own = F.element_at(F.array(*blocks), F.col("g") + 1)
    marked = rows.join(crowded, ["g", "key"], "left")
    return marked.select("g", "key", fp, F.explode(F.when(F.col("crowded"), own).otherwise(F.array(F.lit(0).cast("long")))).alias("block"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id), a row per row of docs; component_id is the smallest doc_id reachable by links."""
    marked = cut(fingerprints(docs, id_col, text_col, width))
    first = marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first"))
    first = cut(first)
    pairs = bonds(first, tau)
    ends = first.select(F.col("fp").alias("a"), F.col("first").alias("x")), first.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    edges = pairs.join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = connected_components(edges)
    of_fp = cut(first.join(labels, first["first"] == labels.node, "left").select("fp", F.coalesce("component", "first").alias("component_id")))
    return marked.join(of_fp, "fp", "left").select("doc_id", "fp", "component_id")


def keepers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, same, n): one document of each group of linked fingerprints, by id and hash of its text, and how many rows it has.

    The smallest doc_id is kept, and of its texts in the group the one of the
    least hash; texts of one doc_id that nothing links are groups of their own.
    Rows without doc_id come last.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    same = rows.select("doc_id", F.xxhash64("text").alias("same"), "text")

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, width) for _, run in slices(batch, 2) for t in run]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc_id", "same", "fp"])

    marked = cut(same.mapInArrow(run, "doc_id long, same long, fp long").groupBy("doc_id", "same").agg(F.min("fp").alias("fp"), F.count("*").alias("n")))
    labels = connected_components(bonds(marked, tau))
    grouped = marked.join(labels, marked.fp == labels.node, "left").withColumn("group", F.coalesce("component", "fp"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "same")
    return cut(grouped.groupBy("group").agg(F.min_by(F.struct("doc_id", "same", "n"), order).alias("k")).select("k.doc_id", "k.same", "k.n"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: fingerprint and component of every document."""
    from canopia.llm.common import table

    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
