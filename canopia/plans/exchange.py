"""Documents written as JSON to the shared folder from the tables and read back, each with the same question in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from canopia.plans.garden import _of
from canopia.sources import documents, shared

c = F.col
HOURS, NOW = 720, "2024-01-25 00:00:00"


def _written(df):
    path = f"{shared.folder(df.sparkSession)}/documents-{uuid.uuid4().hex}"
    df.write.json(path)
    return path


def _inventory(plants, weeds, images):
    """A document for each of 25 entries; a third of the images carry their place in `meta`."""
    entry = lambda k: (k % 25).cast("string").alias("config_entry_id")
    place = F.struct("x", "y", F.lit(-1.0).alias("z"), F.lit(None).cast("string").alias("name"))
    nested = c("id") % 3 == 0
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at")
    parts = [
        plants.select(entry(c("id")), F.struct("id", c("crop").alias("name"), "x", "y", F.when(c("id") % 31 == 0, -1.0).otherwise(c("radius")).alias("radius")).alias("p")).groupBy("config_entry_id").agg(F.collect_list("p").alias("plants")),
        weeds.select(entry(c("id")), F.struct("id", "x", "y", F.when(c("id") % 4 != 0, c("radius")).alias("radius")).alias("w")).groupBy("config_entry_id").agg(F.collect_list("w").alias("weeds")),
        images.select(entry(c("id")), F.struct("id", at, F.when(c("id") % 2 == 0, c("processed")).alias("processed"), F.when(nested, place).alias("meta"), F.when(~nested, c("x")).alias("x"), F.when(~nested, c("y")).alias("y")).alias("i")).groupBy("config_entry_id").agg(F.collect_list("i").alias("images")),
    ]
    docs = parts[0].join(parts[1], "config_entry_id", "full").join(parts[2], "config_entry_id", "full")
    spark = plants.sparkSession
    found = documents.inventory(documents.documents(spark, _written(docs), documents.INVENTORY), HOURS, F.lit(NOW).cast("timestamp"))
    value = {"plants": c("radius"), "weeds": c("radius"), "images": c("x") + c("y") * 3 + c("z") + c("processed").cast("int") * 7}
    counted = [found[k].groupBy("config_entry_id").agg(F.count("*").alias("rows"), F.round(F.sum(v), 3).alias("total")).select("config_entry_id", F.lit(k).alias("kind"), "rows", "total") for k, v in value.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def _soil(points):
    place = F.struct("id", "x", "y", "z", F.when(c("id") % 5 != 0, F.lit("2024-01-01T00:00:00Z")).alias("updated_at"))
    bounds = F.create_map(F.lit("x"), F.array(F.lit(0.0), F.max("x")), F.lit("y"), F.array(F.min("y")))
    docs = points.groupBy((c("id") % 7).cast("string").alias("config_entry_id")).agg(F.collect_list(place).alias("points"), F.struct(bounds.alias("axis_bounds")).alias("motion"))
    rows, axes = documents.soil_points(documents.documents(points.sparkSession, _written(docs), documents.SOIL))
    own = rows.groupBy("config_entry_id").agg(F.count("*").alias("points"), F.count("updated_at").alias("dated"), F.round(F.sum("z"), 2).alias("sum_z"))
    return own.join(axes.select("config_entry_id", "axis", "high"), "config_entry_id")


def _bundle(training):
    samples = training.select(F.when(c("doc_id") % 10 != 0, c("doc_id").cast("string")).otherwise("").alias("detection_id"), F.when(c("doc_id") % 7 == 0, "ufo").otherwise(c("label")).alias("label"), F.create_map(F.lit("f1"), "f1").alias("features"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), "image_id")
    if samples.where("detection_id <> '' AND label <> 'ufo'").isEmpty():  # an import without usable samples is refused
        return training.limit(0).groupBy("label").agg(F.count("*").alias("samples"), F.sum("f1").alias("f1"), F.sum("image_id").alias("images"))
    path = f"{shared.folder(training.sparkSession)}/bundle-{uuid.uuid4().hex}"
    documents.export_training(samples, path)
    back = documents.import_training(training.sparkSession, path)
    return back.groupBy("label").agg(F.count("*").alias("samples"), F.sum(c("features")["f1"]).alias("f1"), F.sum("image_id").alias("images"))


PLANS = {
    "src1": (
        _of("plants", "weeds", "images")(_inventory),
        f"""
SELECT CAST(id % 25 AS VARCHAR) AS config_entry_id, 'plants' AS kind, count(*) AS rows, round(sum(radius), 3) AS total FROM plants WHERE id % 31 <> 0 GROUP BY 1
UNION ALL SELECT CAST(id % 25 AS VARCHAR), 'weeds', count(*), round(sum(CASE WHEN id % 4 <> 0 THEN radius ELSE 0 END), 3) FROM weeds GROUP BY 1
UNION ALL SELECT CAST(id % 25 AS VARCHAR), 'images', count(*), round(sum(x + y * 3 + CASE WHEN id % 3 = 0 THEN -1 ELSE 0 END + CASE WHEN id % 2 <> 0 OR processed THEN 7 ELSE 0 END), 3)
FROM images WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL '{HOURS}' HOUR GROUP BY 1""",
    ),
    "src4": (
        _of("soil_points")(_soil),
        "SELECT CAST(id % 7 AS VARCHAR) AS config_entry_id, count(*) AS points, count(*) FILTER (id % 5 <> 0) AS dated, round(sum(z), 2) AS sum_z, 'x' AS axis, max(x) AS high FROM soil_points GROUP BY id % 7",
    ),
    "snk11": (
        _of("training")(_bundle),
        "SELECT label, count(*) AS samples, sum(f1) AS f1, CAST(sum(image_id) AS BIGINT) AS images FROM training WHERE doc_id % 7 <> 0 AND doc_id % 10 <> 0 GROUP BY label",
    ),
}
