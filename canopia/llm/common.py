"""What the training-data operators share: table access, lineage cuts, text slices and component labels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts list it.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes a to z for A to Z, everything else unchanged.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Text that one step of a worker handles at once, in characters; a longer text makes a step of its own.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder in use, set from the session's configuration if need be."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the cluster's checkpoint folder and returns it without lineage.

    The folder is the session's spark.checkpoint.dir; only where that is unset
    and the master is local (tests) a temporary one is taken.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder: like `cut`, for large tables of which a reader may want few columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from the columns (case aside)."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive runs of a text column with about `most` characters each, with the row they start at."""
    values = batch.column(column)
    start, size, run = 0, 0, []
    for i in range(len(values)):
        text = values[i].as_py()
        run.append(text)
        size += len(text or "")
        if size >= most:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run


def is_held_out(column, parts: int, rest: int):
    """True where crc32 of the id's decimal text leaves `rest` modulo `parts`; a null id is held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts == rest, F.lit(True))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), both long; component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the pointers
    to their roots by doubling and contracts the edges to the roots, so only
    local minima are left; both loops grow with the logarithm of the longest
    chain. Minima are partial aggregates, and joins against a hot node are plain
    equi-joins that the adaptive planner splits.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up"))
        hook, moved = cut(hook), True
        while moved:
            top = hook.select(F.col("a").alias("up"), F.col("up").alias("upper"))
            step = cut(hook.join(top, "up").select("a", F.col("upper").alias("up"), (F.col("upper") < F.col("up")).alias("moved")))
            hook, moved = step.select("a", "up"), not step.where("moved").isEmpty()
        if labels is None:
            labels = hook.select(F.col("a").alias("node"), F.col("up").alias("component"))
        else:
            labels = labels.join(hook, labels.component == hook.a, "left").select("node", F.coalesce("up", "component").alias("component"))
        labels = cut(labels)
        up_b = hook.select(F.col("a").alias("b"), F.col("up").alias("up_b"))
        apart = edges.join(hook, "a").join(up_b, "b").where("up <> up_b")
        edges = cut(apart.select(F.greatest("up", "up_b").alias("a"), F.least("up", "up_b").alias("b")).distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
