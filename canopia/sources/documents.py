"""JSON documents of the garden's devices as DataFrames, and back: inventories, soil points, devices, images, training bundles, settings."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hours that an inventory may look back, bytes of an image, labels of training samples.
LEAST_HOURS, MOST_HOURS, MOST_BYTES = 1, 720, 5 * 1024 * 1024
LABELS = ("weed", "crop", "soil", "debris", "other")

_PLACE = "x: double, y: double, z: double"
INVENTORY = (
    "config_entry_id string, plants array<struct<id: bigint, name: string, openfarm_slug: string, " + _PLACE + ", radius: double, plant_stage: string, planted_at: timestamp, spread_curve_id: bigint, height_mm: double>>, "
    "weeds array<struct<id: bigint, name: string, " + _PLACE + ", radius: double>>, "
    "images array<struct<id: bigint, created_at: timestamp, processed: boolean, meta: struct<" + _PLACE + ", name: string>, " + _PLACE + ", name: string>>, "
    "curves array<struct<id: bigint, name: string, data: map<string, double>>>"
)
SOIL = "config_entry_id string, points array<struct<id: bigint, name: string, " + _PLACE + ", updated_at: timestamp>>, motion struct<axis_bounds: map<string, array<double>>>"
BOTS = "bots array<struct<config_entry_id: string, device_id: string, name: string, integration_version: string, capabilities: array<string>>>"
IMAGES = "image_id long, content_type string, sha256 string, width int, height int, image_base64 string"
BUNDLE = "bundle_version int, samples array<struct<detection_id: string, label: string, features: map<string, double>, created_at: timestamp, image_id: bigint>>"


def documents(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """The documents below path, one a line or one a file; what is no JSON gives no row, and a field of another kind is null."""
    rows = spark.read.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("multiLine", not lines).json(path)
    fields = [c for c in rows.columns if c != "_broken"]
    # a broken record has none of its fields
    return rows.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in fields])).select(fields)


def inventory(docs: DataFrame, hours: int, now: Column) -> dict[str, DataFrame]:
    """src1: plants, weeds, images and curves of inventory documents, each with its config_entry_id.

    Images older than the hours (1 to 720) are left out; their place stands in
    `meta` or beside it, and one without `processed` is. A weed without radius has none.
    """
    if not LEAST_HOURS <= hours <= MOST_HOURS:
        raise ValueError(f"hours from {LEAST_HOURS} to {MOST_HOURS}")
    each = lambda name: docs.select("config_entry_id", F.explode(name).alias("r")).select("config_entry_id", "r.*").where("id IS NOT NULL")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    images = each("images").where(F.col("created_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    place = [F.coalesce(F.col(f"meta.{c}"), F.col(c), *([F.lit(0.0)] if c == "z" else [])).alias(c) for c in ("x", "y", "z")]
    images = images.select("config_entry_id", "id", "created_at", F.coalesce("processed", F.lit(True)).alias("processed"), *place, F.coalesce("meta.name", "name").alias("name")).where("x IS NOT NULL AND y IS NOT NULL")
    weeds = each("weeds")
    plants = each("plants").where("radius >= 0 AND (height_mm IS NULL OR height_mm >= 0)")
    return {
        "plants": plants.withColumn("z", zero("z")),
        "weeds": weeds.select("config_entry_id", "id", "name", "x", "y", zero("z"), zero("radius")).where("radius >= 0"),
        "images": images,
        "curves": each("curves"),
    }


def soil_points(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """src4: soil points, and the bounds of each axis as (config_entry_id, axis, low, high)."""
    points = docs.select("config_entry_id", F.explode("points").alias("r")).select("config_entry_id", "r.*").where("id IS NOT NULL")
    axes = docs.select("config_entry_id", F.explode("motion.axis_bounds").alias("axis", "b"))
    return points, axes.where(F.size("b") == 2).select("config_entry_id", "axis", F.get("b", F.lit(0)).alias("low"), F.get("b", F.lit(1)).alias("high"))


def devices(docs: DataFrame, capability: str | None = None) -> DataFrame:
    """src5: the devices, or those with a capability."""
    rows = docs.select(F.explode("bots").alias("r")).select("r.*").where("config_entry_id IS NOT NULL")
    return rows if capability is None else rows.where(F.array_contains("capabilities", capability))


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """src3: width and height of a JPEG from its frame header; segments are skipped by their lengths, pixels never read."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 3 < len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:  # padding
            at += 1
        elif kind in (0x01, 0xD8, 0xD9) or 0xD0 <= kind <= 0xD7:  # stands alone
            at += 2
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = (int.from_bytes(data[at + k : at + k + 2], "big") for k in (5, 7))
                return (width, height) if at + 9 <= len(data) and width and height else None
            if size < 2:
                return None
            at += 2 + size
    return None


def images(docs: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """src2: (image_id, content, width, height, error) of image documents: decoded and checked.

    error says what is wrong first: no base64, size, no JPEG, digest, dimensions;
    content is null then.
    """

    def run(batches):
        for batch in batches:
            found = [jpeg_size(c) if c else None for c in batch.column("content").to_pylist()]
            columns = [pa.array([f and f[k] for f in found], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "own_width", "own_height"])

    rows = docs.select("image_id", F.lower("sha256").alias("sha256"), "width", "height", F.try_to_binary("image_base64", F.lit("base64")).alias("content"))
    sized = rows.mapInArrow(run, "image_id long, sha256 string, width int, height int, content binary, own_width int, own_height int")
    c = F.col
    error = (
        F.when(c("content").isNull(), "no base64").when(~F.length("content").between(1, most_bytes), "size").when(F.hex(F.substring("content", 1, 2)) != "FFD8", "no JPEG")
        .when(~c("sha256").eqNullSafe(F.sha2("content", 256)), "digest").when(~(c("own_width").eqNullSafe(c("width")) & c("own_height").eqNullSafe(c("height"))), "dimensions")
    )
    marked = sized.withColumn("error", error)
    return marked.select("image_id", F.when(c("error").isNull(), c("content")).alias("content"), c("own_width").alias("width"), c("own_height").alias("height"), "error")


def export_training(samples: DataFrame, path: str) -> None:
    """snk11: samples (detection_id, label, features, created_at, image_id) as a bundle, one document a line."""
    samples.select(F.col("detection_id").cast("string"), "label", "features", "created_at", F.col("image_id").cast("long")).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def import_training(spark: SparkSession, path: str, known: DataFrame | None = None, replace: bool = False, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """snk11: the samples after an import: rows of the bundle with an id, a known label and features, over those known before.

    With replace, what was known goes. Of rows with one id the newest counts.
    Without any usable row it raises ValueError.
    """
    schema = BUNDLE.split("struct<")[1].removesuffix(">>").replace(": ", " ")
    rows = documents(spark, path, schema)
    usable = rows.where(F.col("label").isin(*labels) & F.col("features").isNotNull() & (F.length("detection_id") > 0))
    if usable.isEmpty():
        raise ValueError("the bundle has no usable labelled samples")
    newest = usable.groupBy("detection_id").agg(F.max_by(F.struct(*[c for c in usable.columns if c != "detection_id"]), F.struct(F.col("created_at"), F.xxhash64("label"))).alias("r")).select("detection_id", "r.*")
    if known is None or replace:
        return newest
    return known.select(newest.columns).join(newest, "detection_id", "left_anti").unionByName(newest)


class Settings:
    """snk4 to snk7: a document of settings for each entry, kept as JSON lines; each write is a version of its own, so a reader never sees half of one."""

    def __init__(self, spark: SparkSession, folder: str, defaults: dict, valid: Callable[[dict], bool] = lambda _: True):
        self.spark, self.folder, self.defaults, self.valid = spark, folder.rstrip("/"), defaults, valid

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [s.getPath() for s in files.listStatus(path)]
        return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p.toString()}/_SUCCESS")))

    def _stored(self) -> DataFrame | None:
        """(entry, settings as JSON text) of the newest whole version."""
        versions = self._versions()
        return self.spark.read.schema("entry string, settings string").json(f"{self.folder}/v={versions[-1]}") if versions else None

    def load(self, entry: str) -> dict:
        """The entry's settings over the defaults; the defaults if there are none, or if they cannot be read or are not valid."""
        rows = self._stored()
        found = rows.where(F.col("entry") == entry).select("settings").first() if rows is not None else None
        try:
            own = self.defaults | json.loads(found["settings"]) if found else dict(self.defaults)
        except (TypeError, ValueError):
            return dict(self.defaults)
        return own if set(own) == set(self.defaults) and self.valid(own) else dict(self.defaults)

    def save(self, entry: str, settings: dict) -> None:
        """Writes the entry's settings; unknown or refused ones raise ValueError and change nothing."""
        own = self.defaults | settings
        if set(own) != set(self.defaults) or not self.valid(own):
            raise ValueError("unknown or invalid settings")
        fresh = self.spark.createDataFrame([(entry, json.dumps(own))], "entry string, settings string")
        rows, versions = self._stored(), self._versions()
        every = fresh if rows is None else rows.where(F.col("entry") != entry).unionByName(fresh)
        every.coalesce(1).write.json(f"{self.folder}/v={versions[-1] + 1 if versions else 0}")
