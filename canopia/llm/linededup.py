"""Line dedup over range-partitioned line hashes.

Every long line becomes (hash, document, position). Rows are range-partitioned
on all three, so a line that a third of all documents hold spreads over many
partitions, and sorted by hash, then document from largest to smallest, then
position. A task streams its partition: a hash's first document is the one that
keeps its lines; the rows after it are dropped if enough documents share the
hash. Only the first and last hash of a partition can go on in another
partition; those few hashes (two a partition at most) are settled by a small
aggregate. The result is one compressed bitmap per document, never text.

Defined results: a null text is one empty line; a row without doc_id neither
counts nor loses lines; repeated rows with the same doc_id and text are one
document, get the same bitmap and stay; lines are compared by two 64-bit
hashes; very long texts are split whole; columns other than the id and the text
are ignored (or returned as they are); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.llm.common import SPACES, cut, table, unused

MIN_CHARS, MIN_DOCS = 40, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STREAMED = "h1 long, h2 long, doc_id long, same long, pos int, state int"


def line_key(line):
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, same, pos) of every line whose key is long enough; same tells texts of one doc_id apart."""
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("same"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_chars).select("doc_id", "same", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "same", "pos")


#: States of a streamed row: still open, to be dropped, or a mark that a document holds the hash.
OPEN, DROP, MARK = 0, 1, 2
#: Rows of one hash that a task holds.
MOST_HELD = 1 << 16
#: Bytes of bitmaps, and rows, up to which they are broadcast to the documents.
MOST_BYTES, MOST_ROWS = 1 << 25, 500_000


class _Run:
    """The rows of one hash in a partition, in order.

    Rows are held only until enough documents are seen, never those of the first
    document, which keeps its lines, and never more than MOST_HELD: beyond that
    they leave open, as those do whose hash goes on in another partition.
    """

    def __init__(self, first: bool, min_docs: int):
        self.first, self.min_docs = first, min_docs
        self.seen: list[np.ndarray] = []  # a row of each of the first min_docs documents
        self.held: list[np.ndarray] = []

    def feed(self, rows: np.ndarray):
        complete = len(self.seen) >= self.min_docs
        if not complete:
            new = np.concatenate(([True], rows[1:, 2] != rows[:-1, 2]))
            if self.seen and self.seen[-1][2] == rows[0, 2]:
                new[0] = False
            self.seen += list(rows[np.flatnonzero(new)[: self.min_docs - len(self.seen)]])
        if self.first:  # may go on from the partition before
            yield rows, OPEN
            return
        rows = rows[rows[:, 2] != self.seen[0][2]]
        if not complete:
            self.held.append(rows)
            if len(self.seen) < self.min_docs:
                if sum(map(len, self.held)) > MOST_HELD:
                    yield np.concatenate(self.held), OPEN
                    self.held, self.first = [], True
                return
            rows, self.held = np.concatenate(self.held), []
        yield rows, DROP

    def end(self, partition: bool):
        """What a hash that another partition may share leaves behind: its held rows and a few marks."""
        if self.held and partition:
            yield np.concatenate(self.held), OPEN
        if (self.first or partition) and self.seen:
            yield np.array(self.seen), MARK


def _stream(min_docs: int):
    def batch_of(rows: np.ndarray, state: int):
        columns = [pa.array(rows[:, k]) for k in range(4)] + [pa.array(rows[:, 4].astype(np.int32)), pa.array(np.full(len(rows), state, np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc_id", "same", "pos", "state"])

    def run(batches):
        open_run, last = None, None
        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)])
            if not len(rows):
                continue
            starts = np.concatenate(([0], np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1))
            ends = np.append(starts[1:], len(rows))
            # a hash inside the batch with fewer rows than min_docs drops nothing
            at_edge = np.zeros(len(starts), bool)
            at_edge[[0, -1]] = True
            for k in np.flatnonzero(at_edge | (ends - starts >= min_docs)).tolist():
                part = rows[starts[k] : ends[k]]
                if open_run is None or (last != part[0, :2]).any():
                    if open_run is not None:
                        yield from (batch_of(*x) for x in open_run.end(False))
                    open_run = _Run(open_run is None, min_docs)
                yield from (batch_of(*x) for x in open_run.feed(part) if len(x[0]))
                last = part[-1, :2]
        if open_run is not None:
            yield from (batch_of(*x) for x in open_run.end(True))

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, same, pos) of every line to drop; docs has doc_id and text."""
    spark = docs.sparkSession
    lines = cut(long_lines(docs, min_chars))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = ["h1", "h2", F.desc("doc_id"), "same", "pos"]
    streamed = cut(lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), STREAMED))
    # at most min_docs marks from the first and the last hash of each partition, and from hashes with over MOST_HELD rows
    marks = streamed.where(F.col("state") == MARK)
    verdict = marks.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    late = streamed.where(F.col("state") == OPEN).join(F.broadcast(verdict), ["h1", "h2"]).where("doc_id <> keeper")
    return streamed.where(F.col("state") == DROP).select("doc_id", "same", "pos").unionByName(late.select("doc_id", "same", "pos"))


def pack(positions) -> bytes:
    """Compressed bitmap with a bit for each line up to the last dropped one, in whole bytes; a set bit keeps the line."""
    keep = np.ones(-(-(max(positions) + 1) // 8) * 8, bool)
    keep[positions] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Keep flags of n_lines lines; lines beyond the bitmap stay."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, same, keep) for every document that loses lines; keep is the compressed bitmap."""

    def run(batches):
        for batch in batches:
            found = [pack(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "same", "keep"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    by_doc = dropped_lines(narrow, min_chars, min_docs).groupBy("doc_id", "same").agg(F.collect_set("pos").alias("pos"))
    return by_doc.mapInArrow(run, "doc_id long, same long, keep binary")


def apply_bitmaps(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text column cut to its kept lines, and n_lines and n_dropped; nothing else changes.

    Bitmaps of few bytes in all are broadcast, so texts stay where they are;
    beyond that both sides are shuffled.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    at = names.index(text_col)
    own, same, keep = unused(docs.columns, "_id", "_same", "_keep")
    maps = cut(maps.select(F.col("doc_id").alias(own), F.col("same").alias(same), F.col("keep").alias(keep)))
    size = maps.agg(F.coalesce(F.sum(F.length(keep)), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    maps = F.broadcast(maps) if size["bytes"] <= MOST_BYTES and size["rows"] <= MOST_ROWS else maps
    joined = docs.select(*names).join(maps, (docs[id_col].cast("long") == maps[own]) & (F.xxhash64(docs[text_col].cast("string")) == maps[same]), "left").select(*names, keep)
    schema = docs.select(*names, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema

    def one(text, bitmap):
        if bitmap is None:
            return text, (text or "").count("\n") + 1, 0
        lines = text.split("\n")
        keep = unpack(bitmap, len(lines))
        return "\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k), len(lines), int((~keep).sum())

    def run(batches):
        for batch in batches:
            done = [one(t.as_py(), b.as_py()) for t, b in zip(batch.column(at), batch.column(len(names)), strict=True)]
            columns = [*batch.columns[:-1], *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))]
            columns[at] = pa.array([d[0] for d in done], pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: lines, dropped lines and the digest of what stays, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = apply_bitmaps(docs, bitmaps(docs))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


#: The query in DuckDB.
ORACLE = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(keeper) FILTER (doc_id <> keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
"""
