"""The corpus pipeline: five stages over `documents`, each written as Parquet and read by the next.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame with
the columns of documents; the last adds `epochs`.

Defined results: rows without doc_id are judged like others, and come last in a
group of near copies; repeated rows stay but in the near-duplicate stage, which
returns one; different texts of one doc_id are different documents there; null
and empty texts are texts without words; very long ones are read whole; other
columns are dropped; an empty table passes every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopia.llm import decontaminate, linededup, mixing, quality, simhash
from canopia.llm.common import is_held_out, shared_folder, table

#: Rows up to which a table of ids is broadcast.
MOST_BROADCAST = 500_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught as in its query, gives a score of at least 0.5."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~is_held_out(F.col("doc_id"), 3, 1)))
    return quality.score(docs, model, keep=COLUMNS[1:]).where("score >= 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share."""
    docs = docs.select(*COLUMNS)
    kept = linededup.apply_bitmaps(docs, linededup.bitmaps(docs))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the smallest doc_id, once."""
    docs = docs.select(*COLUMNS)
    kept = simhash.keepers(docs).select(F.col("doc_id").alias("_id"), F.col("same").alias("_same"), "n")
    own = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_same"))
    single = docs.join(kept.where("n = 1"), own, "left_semi")
    repeated = kept.where("n > 1")
    repeated = F.broadcast(repeated) if repeated.count() <= MOST_BROADCAST else repeated
    return single.unionByName(docs.join(repeated, own, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth of the words."""
    docs = docs.select(*COLUMNS)
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.where(~decontaminate.is_contaminated()).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the epochs in which each is taken."""
    return mixing.mix(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: The classifier is learned by gradient descent: SQL cannot express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
