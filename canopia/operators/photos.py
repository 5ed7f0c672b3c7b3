"""Photographs as rows: decoding, vegetation masks, islands of pixels and whose they are.

An image is a row (image_id, height, width, bgr), bgr three bytes a pixel; a
mask is a bit a pixel. Spark deals images to tasks, numpy works inside a task
on one image or one tile, and whatever is compared or summed across islands,
tiles or plants is a join or an aggregate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopia.functions import rasters as R

#: Limits of a photograph, millimetre thresholds, and the size at which an uncalibrated pixel counts as one.
MOST_BYTES, MOST_WIDTH, MOST_HEIGHT = 5 * 1024 * 1024, 1280, 960
LEAST_AREA_MM2, MOST_AREA_MM2, LINE_FACTOR = 12.0, 200_000.0, 20.0
OPEN_MM, CLOSE_MM, WEED_CLOSE_MM, PALE_GAP_MM = 3.0, 5.0, 2.0, 10.0
BASE_WIDTH, BASE_HEIGHT = 640, 480
#: Colours of leaves washed towards white.
PALE_SATURATION, PALE_VALUE, PALE_EXCESS = 5, 35, 2


def read_photos(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """img1: (path, height, width, bgr) of the JPEG files below path.

    Files that are too large, no JPEG or cannot be decoded give no row. Images
    beyond MOST_WIDTH by MOST_HEIGHT are shrunk, others stay as they are.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("length").between(2, most_bytes))
    jpeg = files.where(F.hex(F.substring("content", 1, 2)) == "FFD8").select(_plain(F.col("path")).alias("path"))
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").where("nChannels = 3")
    decoded = images.select(_plain(F.col("origin")).alias("path"), "height", "width", F.col("data").alias("bgr")).join(jpeg, "path", "left_semi")

    def run(batches):
        for batch in batches:
            rows = []
            for height, width, bgr in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                scale = min(1.0, MOST_WIDTH / width, MOST_HEIGHT / height)
                if scale < 1:
                    size = int(np.rint(height * scale)), int(np.rint(width * scale))
                    bgr = R.shrunk(np.frombuffer(bgr, np.uint8).reshape(height, width, 3), *size).tobytes()
                    height, width = size
                rows.append((height, width, bgr))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["path", "height", "width", "bgr"])

    return decoded.mapInArrow(run, "path string, height int, width int, bgr binary")


def _plain(path):
    return F.regexp_replace(path, "^file:/+", "/")


def rastered(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Images (image_id, height, width, bgr) of pixel rows (image_id, x, y, b, g, r); absent pixels are black, rows outside are left out."""

    def run(rows: pa.Table) -> pa.Table:
        image = np.zeros((height, width, 3), np.uint8)
        y, x = (rows.column(c).to_numpy() for c in ("y", "x"))
        image[y, x] = np.column_stack([rows.column(c).to_numpy() for c in "bgr"])
        return pa.table([rows.column("image_id").slice(0, 1), pa.array([height], pa.int32()), pa.array([width], pa.int32()), pa.array([image.tobytes()], pa.binary())], ["image_id", "height", "width", "bgr"])

    inside = pixels.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    narrow = inside.select(F.col("image_id").cast("long"), *[F.col(c).cast("int").alias(c) for c in ("x", "y", "b", "g", "r")])
    return narrow.groupBy("image_id").applyInArrow(run, "image_id long, height int, width int, bgr binary")


def scaled(images: DataFrame) -> DataFrame:
    """img2: images (height, width, ppm_x, ppm_y) with their thresholds in pixels; without a scale the size stands for it."""
    linear = (F.col("width") / BASE_WIDTH + F.col("height") / BASE_HEIGHT) / 2
    known = F.col("ppm_x").isNotNull() & F.col("ppm_y").isNotNull()
    mean = F.when(known, (F.col("ppm_x") + F.col("ppm_y")) / 2).otherwise(linear)
    area = F.when(known, F.col("ppm_x") * F.col("ppm_y")).otherwise(linear * linear)
    odd = lambda c: c + (c % 2 == 0).cast("int")
    own = images.withColumns({"mean_ppm": mean, "_area": area}).withColumn("min_area", F.greatest(F.lit(8), F.rint(LEAST_AREA_MM2 * F.col("_area")).cast("int")))
    return own.withColumns(
        {
            "max_area": F.rint(MOST_AREA_MM2 * F.col("_area")).cast("int"),
            "line_area": F.rint(F.col("min_area") * LINE_FACTOR).cast("int"),
            "open_kernel": odd(F.greatest(F.lit(3), F.rint(OPEN_MM * F.col("mean_ppm")).cast("int"))),
            "close_kernel": odd(F.greatest(F.lit(5), F.rint(CLOSE_MM * F.col("mean_ppm")).cast("int"))),
            "pale_reach": F.greatest(F.lit(1), F.rint(PALE_GAP_MM * F.col("mean_ppm")).cast("int")),
            "weed_close": F.greatest(F.lit(1), F.rint(WEED_CLOSE_MM * F.col("mean_ppm") / 2).cast("int")),
        }
    ).drop("_area")


def foliage(bgr: np.ndarray, open_kernel: int, close_kernel: int, pale_reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Strong leaves, pale ones recovered beside them, their cleaned union, and the excess-green threshold."""
    hue, saturation, value = R.hsv(bgr)
    b, g, r = (bgr[..., k].astype(np.int64) for k in range(3))
    excess = 2 * g - r - b
    least = max(10, min(32, R.otsu(np.clip(excess, 0, 255))))
    green = (hue >= 25) & (hue <= 100) & (saturation >= 35) & (value >= 25)
    strong = (green | ((g > r * 0.92) & (g > b * 0.92))) & (excess > least) & (saturation > 22) & (value > 20)
    pale = (hue >= 20) & (hue <= 105) & (saturation >= PALE_SATURATION) & (value >= PALE_VALUE) & (excess >= PALE_EXCESS) & (g >= r - 6) & (g >= b - 6) & ~strong
    labels, n = R.components(pale)
    anchored = np.zeros(n + 1, bool)
    anchored[np.unique(labels[R.dilate(strong, R.disc(pale_reach))])] = True
    anchored[0] = False
    recovered = anchored[labels]
    return strong, recovered, R.closed(R.opened(strong | recovered, R.square(open_kernel)), R.square(close_kernel)), least


def _mapped(images: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """image_id, height, width and what `work` makes of each image's pixels and columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                image_id, height, width, bgr, *more = (batch.column(i)[k].as_py() for i in range(batch.num_columns))
                made = work(np.frombuffer(bgr, np.uint8).reshape(height, width, 3), *more)
                yield pa.RecordBatch.from_pylist([dict(zip(names, (image_id, height, width, *made), strict=True))], schema=target)

    source = images.select(F.col("image_id").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), "bgr", *columns)
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    target = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return source.mapInArrow(run, schema)


def vegetation(images: DataFrame) -> DataFrame:
    """img3: masks `strong`, `pale` and `mask` of scaled images, and the threshold of excess green.

    Green pixels by hue and saturation or by dominance are strong. Paler ones
    come back as whole islands, where one touches the surroundings of strong
    leaves. The union is opened, then closed.
    """

    def work(bgr, open_kernel, close_kernel, pale_reach):
        *masks, least = foliage(bgr, open_kernel, close_kernel, pale_reach)
        return *map(R.pack, masks), least

    return _mapped(images, ["open_kernel", "close_kernel", "pale_reach"], work, "image_id long, height int, width int, strong binary, pale binary, mask binary, threshold int")


#: Colour settings of weed candidates when the user sets none.
WEED_COLOURS = {"hue_min": 25, "hue_max": 100, "saturation": 45, "excess": 20, "padding": 8, "recall_saturation": 15, "recall_excess": 2}


def weed_vegetation(images: DataFrame, colours: dict | None = None) -> DataFrame:
    """img4: the `mask` in which weeds are looked for: set colours, a wider band of hues, and the canopy, closed but not opened.

    images are scaled and have `canopy`, the mask of img3, or null.
    """
    c = WEED_COLOURS | (colours or {})

    def work(bgr, canopy, reach):
        hue, saturation, value = R.hsv(bgr)
        b, g, r = (bgr[..., k].astype(np.int64) for k in range(3))
        excess = 2 * g - r - b
        low, high = hue >= c["hue_min"], hue <= c["hue_max"]
        chosen = (low & high if c["hue_min"] <= c["hue_max"] else low | high) & (saturation >= c["saturation"]) & (excess >= c["excess"]) & (value > 20)
        wider = (hue >= max(0, c["hue_min"] - c["padding"])) & (hue <= min(179, c["hue_max"] + c["padding"])) & (g >= r - 4) & (g >= b - 4)
        found = chosen | (wider & (saturation >= c["recall_saturation"]) & (excess >= c["recall_excess"]) & (value > 20))
        if canopy is not None:
            found |= R.unpack(canopy, *found.shape)
        return (R.pack(R.closed(found, R.disc(reach))),)

    return _mapped(images, ["canopy", "weed_close"], work, "image_id long, height int, width int, mask binary")


def pixels_of(masks: DataFrame, name: str = "mask") -> DataFrame:
    """(image_id, y, x) of the set pixels of masks (image_id, height, width, name)."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                image_id, height, width, mask = (batch.column(i)[k].as_py() for i in range(4))
                y, x = np.nonzero(R.unpack(mask, height, width))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), image_id)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32))], ["image_id", "y", "x"])

    return masks.select(F.col("image_id").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), name).mapInArrow(run, "image_id long, y int, x int")


ISLANDS = "image_id long, label int, x0 int, y0 int, x1 int, y1 int, area int"


def islands(masks: DataFrame, gap_px: float | None = None) -> DataFrame:
    """img6: (image_id, label, x0, y0, x1, y1, area) of the connected islands of masks (image_id, height, width, mask).

    Pixels connect over edges and corners; labels count from 1 in the order of
    first pixels, and x1 and y1 are exclusive. With a gap, islands join whose
    edges are as near; only the mask's own pixels count for box and area.
    """

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                image_id, height, width, mask = (batch.column(i)[k].as_py() for i in range(4))
                own = R.unpack(mask, height, width)
                labels, n = R.components(own if gap_px is None else R.dilate(own, R.disc(max(1, int(np.rint(gap_px / 2))))))
                found = R.boxes(np.where(own, labels, 0), n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, image_id)), pa.array(np.arange(1, n + 1, dtype=np.int32)), *(pa.array(x) for x in found.T)], ["image_id", "label", "x0", "y0", "x1", "y1", "area"])

    return masks.select(F.col("image_id").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), "mask").mapInArrow(run, ISLANDS)


def valid(island_rows: DataFrame) -> DataFrame:
    """img8: islands (with min_area, max_area, line_area) of a plausible size that are no long thin line."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    thin = F.greatest(width, height) > 9 * F.greatest(F.lit(1), F.least(width, height))
    return island_rows.where(F.col("area").between(F.col("min_area"), F.col("max_area")) & ~(thin & (F.col("area") > F.col("line_area"))))


def near_islands(island_rows: DataFrame, gap_px: float) -> DataFrame:
    """Pairs (image_id, a, b, gap2) of islands a < b of an image whose boxes are at most gap_px apart; gap2 is the square.

    A box is dealt to the cells of side gap_px that it touches, grown by the gap
    on one side of the join, so that pairs meet in an equi-join; a pair counts
    in the first cell it shares.
    """
    side = max(1.0, gap_px)
    cell = lambda c, d: F.floor((F.col(c) + d) / side).cast("long")
    rows = island_rows.select("image_id", "label", "x0", "y0", "x1", "y1")

    def spread(df, grow):
        first = df.withColumns({"_cx0": cell("x0", -grow), "_cy0": cell("y0", -grow)})
        across = first.withColumn("_cx", F.explode(F.sequence("_cx0", cell("x1", grow))))
        return across.withColumn("_cy", F.explode(F.sequence("_cy0", cell("y1", grow))))

    left = spread(rows, gap_px)
    right = spread(rows, 0.0)
    right = right.select("image_id", "_cx", "_cy", F.col("_cx0").alias("o_cx0"), F.col("_cy0").alias("o_cy0"), *[F.col(c).alias(f"o_{c}") for c in ("label", "x0", "y0", "x1", "y1")])
    once = (F.col("_cx") == F.greatest("_cx0", "o_cx0")) & (F.col("_cy") == F.greatest("_cy0", "o_cy0"))
    apart = lambda a: F.greatest(F.lit(0), F.greatest(F.col(f"{a}0"), F.col(f"o_{a}0")) - F.least(F.col(f"{a}1"), F.col(f"o_{a}1")))
    gap2 = apart("x") * apart("x") + apart("y") * apart("y")
    pairs = left.join(right, ["image_id", "_cx", "_cy"]).where(once & (F.col("label") < F.col("o_label")))
    return pairs.select("image_id", F.col("label").alias("a"), F.col("o_label").alias("b"), gap2.cast("long").alias("gap2")).where(F.col("gap2") <= gap_px * gap_px)


def bounded_groups(island_rows: DataFrame, gap_px: float, span_px: float) -> DataFrame:
    """img7: (image_id, label, group): islands merged by rising gap of boxes while a group's box stays within span_px.

    Pairs of one gap merge in the order of their labels; groups count from 1 in
    the order of their first islands. Pairs are found by a join; the merging,
    where each step depends on the ones before, goes image by image.
    """
    pairs = near_islands(island_rows, gap_px).select(F.col("image_id").alias("near_id"), "a", "b", "gap2")
    boxes = island_rows.select("image_id", "label", "x0", "y0", "x1", "y1")

    def run(own: pa.Table, near: pa.Table) -> pa.Table:
        own = own.sort_by("label")
        label = own.column("label").to_pylist()
        box = dict(zip(label, zip(*(own.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1")), strict=True), strict=True))
        head = {k: k for k in label}

        def top(k):
            while head[k] != k:
                head[k] = k = head[head[k]]
            return k

        for _, a, b in sorted(zip(*(near.column(c).to_pylist() for c in ("gap2", "a", "b")), strict=True)):
            a, b = top(a), top(b)
            if a != b:
                whole = tuple(f(x, y) for f, x, y in zip((min, min, max, max), box[a], box[b], strict=True))
                if max(whole[2] - whole[0], whole[3] - whole[1]) <= span_px:
                    head[b], box[a] = a, whole
        number: dict[int, int] = {}
        group = [number.setdefault(top(k), len(number) + 1) for k in label]
        return pa.table([own.column("image_id"), own.column("label"), pa.array(group, pa.int32())], ["image_id", "label", "group"])

    return boxes.groupBy("image_id").cogroup(pairs.groupBy("near_id")).applyInArrow(run, "image_id long, label int, group int")


def group_boxes(island_rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The box, area and number of islands of each group of `bounded_groups`."""
    rows = island_rows.join(groups, ["image_id", "label"])
    return rows.groupBy("image_id", "group").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"), (F.sum, "area"))], F.count("*").alias("islands"))
