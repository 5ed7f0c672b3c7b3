"""Folds over the rows of a key in order, in one pass over sorted partitions with one state at a time: no row or task holds a key's rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.sources.shared import cut

_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def carried(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, columns: str, finish: Callable = lambda _: ()) -> DataFrame:
    """(key, columns): what step(state, row) and, after a key's last row, finish(state) return, as iterables of tuples.

    start() is the state of a key; the key comes back as it is.
    """
    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)
    schema = f"`{key}` {dict(rows.dtypes)[key]}, {columns}"

    def run(batches):
        last, state, made, kind = None, None, [], None

        def given(own, found):
            made.extend((own, *f) for f in found)

        def packed():
            arrays = [pa.array([m[0] for m in made], kind), *(pa.array([m[k] for m in made], _KINDS[t]) for k, t in enumerate(kinds, 1))]
            return pa.RecordBatch.from_arrays(arrays, [key, *names])

        for batch in batches:
            kind, made = batch.schema.field(key).type, []
            for row in batch.to_pylist():
                if state is None or row[key] != last:
                    if state is not None:
                        given(last, finish(state))
                    last, state = row[key], start()
                given(last, step(state, row))
            yield packed()
        if state is not None:
            made = []
            given(last, finish(state))
            yield packed()

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def ranked(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """rows with their place in the order, from 0, without sorting all in one task: partitions of a range are shifted by what lies before them."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(spread.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))  # a row a partition
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_from")).alias("_off"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_off")).drop("_at", "_part", "_off")
