"""Approximate nearest neighbours by learned partitions.

On a bounded sample: an exact neighbour graph, a balanced partitioning of that
graph (capacity-bound moves that keep neighbours together), and a small
classifier (one hidden layer, numpy) that learns the partitions of a vector's
neighbours. The number of partitions to visit is calibrated on held-out sample
vectors for a target recall. Every row is then indexed in its most probable
partition; a query visits its most probable ones, and all their rows are
reranked by exact cosine in double precision.

Equal vectors are collapsed first: k + 1 ids of a vector are all that any
result can need. Large partitions are dealt into blocks of bounded size, and so
are the queries that visit them, so a hot region costs more tasks, not a larger
one. The number of partitions follows the number of vectors.

Vectors of the most common length are routed by the model; each other length
makes a partition of its own, which its queries search whole.

Defined results: vectors that are null, zero, or with null or non-finite
components take no part, nor do rows without id; vectors of different lengths
are no neighbours; repeated rows (same id and vector) count once; each different
vector of one id is a query of its own, with ranks of its own, and no row of an
id is a neighbour of it, which may leave such a query one row short a further
vector; otherwise fewer rows than asked come back only if there are no more
candidates; ties go to the smaller id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.llm.common import cut, table

#: Vectors the model is fitted on (most of them train, the rest calibrate), and neighbours in its graph.
SAMPLE, GRAPH = 4096, 10
#: Vectors a partition should hold, the least number of partitions, and sample vectors that one needs to be learned: a larger table takes a larger sample.
ROWS, LEAST_PARTS, PER_PART = 4096, 8, 16
#: Vectors, and queries, that meet in one task, and queries of them that are compared at once.
BLOCK, STEP = 8192, 512
TARGET, HELD = 0.95, 0.2
#: Rows up to which the table of partitions may be broadcast (three numbers a row).
MOST_BROADCAST = 500_000


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part, each once."""
    flat = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return flat.where(fine).distinct()


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, largest component near 1: cosines keep every bit, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each row's k nearest others (fewer rows: all others), in blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    for at in range(0, len(x) if k > 0 else 0, 512):
        near = x[at : at + 512] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 512] = np.argsort(-near, axis=1, kind="stable")[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 3) -> np.ndarray:
    """A part for each node: recursive halving along the main axis of spread, then moves to where most neighbours are, within capacity."""
    part = np.zeros(len(x), np.int64)
    sizes = {0: parts}
    while any(v > 1 for v in sizes.values()):
        for p, share in list(sizes.items()):
            if share < 2:
                continue
            rows = np.flatnonzero(part == p)
            new, left = max(sizes) + 1, share // 2
            if len(rows) > 1:
                own = x[rows] - x[rows].mean(axis=0)
                axis = np.linalg.eigh(own.T @ own)[1][:, -1]
                order = rows[np.argsort(own @ axis, kind="stable")]
                part[order[len(rows) * (share - left) // share :]] = new
            sizes[p], sizes[new] = share - left, left
    room = int(np.ceil(slack * len(x) / parts))
    rng = np.random.default_rng(seed)
    both = [set(r.tolist()) for r in graph]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            both[j].add(i)
    both = [np.fromiter(s, np.int64, len(s)) for s in both]
    count = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)).tolist():
            ties = np.bincount(part[both[i]], minlength=parts)
            ties[(count >= room) & (np.arange(parts) != part[i])] = -1
            best = int(ties.argmax())
            if ties[best] > ties[part[i]]:
                count[part[i]] -= 1
                count[best] += 1
                part[i] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return part


class Router:
    """Softmax over partitions from one hidden layer; the model is a few small arrays."""

    def __init__(self, dim: int, parts: int, hidden: int = 96, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, (2 / dim) ** 0.5, (dim, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x * np.sqrt(x.shape[1]) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 2e-3, seed: int = 6) -> None:
        """Adam on cross-entropy against the share of a vector's neighbours in each partition."""
        rng = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        x = x * np.sqrt(x.shape[1])
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                h = np.maximum(x[rows] @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                e = np.exp(z - z.max(axis=1, keepdims=True))
                d = (e / e.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
                back = (d @ self.w[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + rate * 1e-3 * self.w[k]


def fit(sample: np.ndarray, parts: int, k: int) -> tuple[Router, int]:
    """The router, and how many partitions reach the target recall of k neighbours on held-out sample vectors."""
    x = _unit(sample)
    graph = neighbour_graph(x, max(GRAPH, k))
    part = balanced_partition(x, graph[:, :GRAPH], parts)
    share = np.zeros((len(x), parts))
    share[np.arange(len(x)), part] = 1.0
    for j in range(min(GRAPH, graph.shape[1])):
        share[np.arange(len(x)), part[graph[:, j]]] += 1.0
    share /= share.sum(axis=1, keepdims=True)
    held = np.arange(len(x)) < int(len(x) * HELD)
    router = Router(x.shape[1], parts)
    router.fit(x[~held], share[~held])
    chances = router.chances(x)
    home, order = chances.argmax(axis=1), np.argsort(-chances, axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")  # when a query visits each partition
    near = graph[held][:, :k]
    when = place[held][np.arange(held.sum())[:, None], home[near]]
    for visits in range(1, parts):
        if when.size and (when < visits).mean() >= TARGET:
            return router, visits
    return router, parts


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def search(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest found to every row that `is_query` (a Column over `id`) picks, against all rows."""
    spark = rows.sparkSession
    good = usable(rows, id_col, vec_col)
    firsts = W.partitionBy("vec").orderBy("id")
    index = good.withColumn("n", F.row_number().over(firsts)).where(F.col("n") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    index = cut(index)
    sizes = index.groupBy(F.size("vec").alias("dim")).count()
    common = sizes.orderBy(F.desc("count"), "dim").limit(1).collect()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    dim, n = common[0]["dim"], common[0]["count"]
    parts = int(max(LEAST_PARTS, n // ROWS))
    size = max(SAMPLE, PER_PART * parts)
    usual = index.where(F.size("vec") == dim).select("vec")
    sample = usual.where(F.pmod(F.xxhash64("vec", F.lit(11)), F.lit(1 << 30)) < F.lit(float(1 << 30) * min(1.0, size / n))).limit(2 * size).toArrow().column("vec").combine_chunks()
    if not len(sample):
        sample = usual.limit(size).toArrow().column("vec").combine_chunks()
    sample = _matrix(sample)
    router, visits = fit(sample[np.lexsort(sample.T[::-1])][np.random.default_rng(2).permutation(len(sample))], parts, k)
    model = spark.sparkContext.broadcast(router)

    def chances(column: pa.Array):
        """Row numbers of the usual length with their chances, and of the other rows with their lengths."""
        lengths = column.value_lengths().to_numpy()
        own, odd = np.flatnonzero(lengths == dim), np.flatnonzero(lengths != dim)
        return own, model.value.chances(_unit(_matrix(column.take(pa.array(own))))) if len(own) else np.zeros((0, parts)), odd, lengths[odd]

    def place(batches):
        for batch in batches:
            own, p, odd, lengths = chances(batch.column(0))
            home = np.zeros(len(batch), np.int32)
            home[own], home[odd] = p.argmax(axis=1) if len(own) else 0, -lengths
            yield pa.RecordBatch.from_arrays([pa.array(home), *batch.columns], ["part", "vec", "ids"])

    indexed = cut(index.select("vec", "ids").mapInArrow(place, "part int, vec array<double>, ids array<long>"))
    held = np.zeros(parts, np.int64)
    for r in indexed.where("part >= 0").groupBy("part").count().collect():  # a row a partition
        held[r["part"]] = r["count"]

    def route(batches):
        for batch in batches:
            own, p, odd, lengths = chances(batch.column(2))
            order = np.argsort(-p, axis=1, kind="stable")
            # more partitions where the most probable ones are too small for k results
            need = np.maximum(visits, (np.cumsum(held[order], axis=1) < k + 1).sum(axis=1) + 1)
            which = np.flatnonzero((np.arange(parts)[None, :] < need[:, None]).ravel())
            part, row = np.concatenate((order.ravel()[which], -lengths)), pa.array(np.concatenate((own[which // parts], odd)))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(c.take(row) for c in batch.columns)], ["part", "q1", "q2", "vec"])

    key = [F.xxhash64("vec").alias("q1"), F.xxhash64(F.lit(1), "vec").alias("q2")]
    asked = cut(good.where(is_query).select(*key, "id", "vec"))
    distinct = asked.groupBy("q1", "q2").agg(F.first("vec").alias("vec"))
    routed = cut(distinct.mapInArrow(route, "part int, q1 long, q2 long, vec array<double>"))
    blocks = [x.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"n_{c}")) for x, c in ((indexed, "b"), (routed, "q"))]
    dealt = cut(blocks[0].join(blocks[1], "part"))  # a row a partition
    few = F.broadcast(dealt) if dealt.count() <= MOST_BROADCAST else dealt
    left = indexed.join(few, "part").withColumn("b", F.pmod(F.xxhash64("vec"), "n_b").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)))
    right = routed.join(few, "part").withColumn("q", F.pmod("q1", "n_q").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)))
    left, right = left.select("part", "b", "q", "vec", "ids"), right.select("part", "b", "q", "q1", "q2", "vec")

    def compare(rows_: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows_) or not len(queries):
            return pd.DataFrame({"q1": [], "q2": [], "id": [], "score": []}).astype({"q1": "int64", "q2": "int64", "id": "int64"})
        x, y = _scaled(np.stack(rows_["vec"].to_numpy())), _scaled(np.stack(queries["vec"].to_numpy()))
        nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
        unit, ids = (x / nx[:, None]).T.copy(), rows_["ids"].to_numpy()
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        q1, q2, out = queries["q1"].to_numpy(), queries["q2"].to_numpy(), []
        for at in range(0, len(y), STEP):
            near = (y[at : at + STEP] / ny[at : at + STEP, None]) @ unit
            most = min(k + 1, near.shape[1])
            least = np.partition(near, near.shape[1] - most, axis=1)[:, near.shape[1] - most]
            q, c = np.nonzero(near >= least[:, None] - 1e-9)  # ties and rounding included
            q += at
            score = (y[q] * x[c]).sum(axis=1) / (ny[q] * nx[c])
            many = size[c]
            found = pd.DataFrame({"q1": np.repeat(q1[q], many), "q2": np.repeat(q2[q], many), "id": np.concatenate([ids[i] for i in c]), "score": np.repeat(score, many)})
            best = found.sort_values(["q1", "q2", "score", "id"], ascending=[True, True, False, True], kind="stable")
            out.append(best.groupby(["q1", "q2"], sort=False).head(k + 1))
        return pd.concat(out)

    by = ["part", "b", "q"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, "q1 long, q2 long, id long, score double")
    order = [F.desc("score"), F.asc("id")]
    top = found.withColumn("n", F.row_number().over(W.partitionBy("q1", "q2").orderBy(*order))).where(F.col("n") <= k + 1)
    answers = cut(top.groupBy("q1", "q2").agg(F.collect_list(F.struct("n", "id", "score")).alias("top")))
    own = F.filter(F.array_sort("top"), lambda t: t["id"] != F.col("query_id"))
    each = asked.select("q1", "q2", F.col("id").alias("query_id")).join(answers, ["q1", "q2"]).select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "t"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.id").alias("id"), F.col("t.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the 5 nearest vectors of every vector whose id is divisible by 50."""
    found = search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")
