"""Grid runs of the camera: detection with repairs, verified frames, newest captures, scouting, relative blur, soil triplets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.operators import geometry, planning, store, transforms
from canopia.sources.shared import cut

_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _nearest(axis: str, value: str) -> Column:
    return F.array_min(F.transform(axis, lambda a: F.struct(F.abs(a - F.col(value)).alias("d"), a.alias("a"))))["a"]


def latest_grid_run(images: DataFrame, repairs: DataFrame, key: str = "entry", tolerance: float = 25.0, least: float = 0.6, window: int = 3600) -> DataFrame:
    """grd4: per key the newest hour of images that fills most of a grid, a row per cell to photograph (null if none is left).

    images: key, id, created_at, x, y, z, gantry. repairs: key, id, run_started_at;
    such images form no run, but fill cells of a run that starts within the window
    after the remembered time. A run has four images, two columns and two rows at
    least, and its cells are filled to `least`. Wanted are cells without an image,
    at the run's median height, and inner cells whose newest image shows the gantry.
    """
    dealt = store.time_clusters(images.join(repairs.select(key, "id"), [key, "id"], "left_anti"), key, window)
    dealt = dealt.withColumn("n", F.count("*").over(W.partitionBy(key, "anchor"))).where("n >= 4").withColumn("run", F.struct(key, "anchor"))
    dealt = cut(dealt)  # five branches read it

    def axis(value):
        return planning.axis_groups(dealt, "run", value, tolerance).groupBy("run").agg(F.array_sort(F.collect_list("position")).alias(f"{value}s"))

    axes = cut(axis("x").join(axis("y"), "run").where("size(xs) > 1 AND size(ys) > 1"))
    height = F.coalesce(F.median(F.when(~F.col("gantry"), F.col("z"))), F.median("z"))
    facts = dealt.groupBy("run").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("completed_at"), height.alias("height")).join(axes, "run")
    hour = lambda c: F.floor(F.unix_seconds(c) / window)
    late = repairs.join(images, [key, "id"]).withColumn("_h", F.explode(F.array(hour(F.col("run_started_at")), hour(F.col("run_started_at")) + 1)))
    starts = facts.select("run", F.col(f"run.{key}").alias(key), "started_at", "xs", "ys", hour(F.col("started_at")).alias("_h"))
    drift = F.col("started_at").cast("double") - F.col("run_started_at").cast("double")
    place = [_nearest("xs", "x").alias("cx"), _nearest("ys", "y").alias("cy")]
    what = ["run", "id", "created_at", "x", "y", "z", "gantry"]
    adopted = late.join(starts, [key, "_h"]).where(drift.between(0, window)).select(*what, *place)
    adopted = adopted.where((F.abs(F.col("x") - F.col("cx")) <= tolerance) & (F.abs(F.col("y") - F.col("cy")) <= tolerance))
    placed = dealt.join(axes, "run").select(*what, *place).unionByName(adopted)
    cells = cut(placed.groupBy("run", "cx", "cy").agg(F.max_by(F.struct("id", "z", "gantry"), F.struct("created_at", "id")).alias("i")))
    filled = facts.join(cells.groupBy("run").agg(F.count("*").alias("cells")), "run").withColumn("expected", F.size("xs") * F.size("ys"))
    whole = filled.withColumn("coverage", F.col("cells") / F.col("expected")).where(F.col("coverage") >= least)
    last = whole.withColumn("_n", F.row_number().over(W.partitionBy(f"run.{key}").orderBy(F.desc("run.anchor")))).where("_n = 1")
    spots = last.select("run", "height", "xs", "ys", F.explode("xs").alias("cx")).select("*", F.explode("ys").alias("cy")).join(cells, ["run", "cx", "cy"], "left")
    inner = (F.col("cx") > F.array_min("xs")) & (F.col("cx") < F.array_max("xs")) & (F.col("cy") > F.array_min("ys")) & (F.col("cy") < F.array_max("ys"))
    reason = F.when(F.col("i").isNull(), "missing").when(F.col("i.gantry") & inner, "gantry")
    targets = spots.select("run", F.col("cx").alias("x"), F.col("cy").alias("y"), F.coalesce("i.z", "height").alias("z"), reason.alias("reason"), F.col("i.id").alias("image_id")).where("reason IS NOT NULL")
    return last.select("run", "started_at", "completed_at", "expected", "coverage").join(targets, "run", "left").select(F.col(f"run.{key}").alias(key), "started_at", "completed_at", "expected", "coverage", "x", "y", "z", "reason", "image_id")


def match_frames(targets: DataFrame, frames: DataFrame, tolerance: float = 25.0) -> DataFrame:
    """grd3: run, target_index and image_id of the frames that a target accounts for.

    targets: run, target_index, x, y, z. frames: run, seq, image_id, x, y, z,
    declared. In order of seq a frame takes the target that it declares, else the
    nearest one within the tolerance, unless an earlier frame has it. Spark finds
    the candidates; the fold holds one run's. Targets may number many times what
    they are made from, so they are merged, never broadcast.
    """
    good = frames.where("image_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    named = good.where("declared IS NOT NULL").join(targets.select("run", F.col("target_index").alias("declared")).hint("merge"), ["run", "declared"])
    named = named.select("run", "seq", "image_id", F.col("declared").cast("long").alias("target_index"), F.lit(0.0).alias("distance"))
    cell = lambda c: F.floor(F.col(c) / tolerance)
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND]))
    around = targets.select("run", "target_index", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), (cell("x")).alias("_x"), cell("y").alias("_y"), steps.alias("d"))
    around = around.select("run", "target_index", "tx", "ty", "tz", (F.col("_x") + F.col("d.i")).alias("_x"), (F.col("_y") + F.col("d.j")).alias("_y"))
    gap = F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2 + (F.col("z") - F.col("tz")) ** 2)
    near = good.where("declared IS NULL").withColumns({"_x": cell("x"), "_y": cell("y")}).join(around.hint("merge"), ["run", "_x", "_y"]).withColumn("distance", gap).where(F.col("distance") <= tolerance)
    pairs = named.unionByName(near.select("run", "seq", "image_id", F.col("target_index").cast("long").alias("target_index"), "distance"))

    free = pairs.groupBy("run", "seq", "image_id").agg(F.array_sort(F.collect_list(F.struct("distance", "target_index"))).alias("t"))
    free = free.select("run", F.struct("seq", "image_id", F.transform("t", lambda t: t["target_index"]).alias("t")).alias("f"))
    start = F.array().cast("array<struct<target_index:bigint,image_id:bigint>>")

    def take(done, f):
        left = F.filter(f["t"], lambda t: ~F.exists(done, lambda d: d["target_index"] == t))
        pick = F.struct(F.get(left, F.lit(0)).alias("target_index"), f["image_id"].cast("bigint").alias("image_id"))
        return F.when(F.size(left) == 0, done).otherwise(F.concat(done, F.array(pick)))

    taken = free.groupBy("run").agg(F.array_sort(F.collect_list("f")).alias("f")).select("run", F.explode(F.aggregate("f", start, take)).alias("m"))
    return taken.select("run", "m.target_index", "m.image_id")


def newest_per_location(images: DataFrame, key: str = "entry", tolerance: float = 25.0) -> DataFrame:
    """grd8: per key the images (id, created_at, x, y) left when, newest first, one within the tolerance of a kept one goes.

    In each round the images that are the newest of their cell and the eight
    around it are kept for certain, and take away what they reach; no pairs of
    images are formed but with kept ones. Ties in time go to the larger id.
    """
    top = F.max_by(F.struct("id", "created_at"), F.struct("created_at", "id"))
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    left = images.where("x IS NOT NULL AND y IS NOT NULL").groupBy(key, "x", "y").agg(top.alias("i")).select(key, "i.id", "i.created_at", "x", "y")
    left = cut(left.withColumns({"cx": cell("x"), "cy": cell("y")}))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND])).alias("d")
    moved = [(F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy")]
    kept = left.limit(0)
    while not left.isEmpty():
        heads = left.groupBy(key, "cx", "cy").agg(F.max(F.struct("created_at", "id")).alias("h"))
        best = heads.select(key, "cx", "cy", "h", steps).select(key, "h", *moved).groupBy(key, "cx", "cy").agg(F.max("h").alias("h"))
        fresh = cut(left.join(best, [key, "cx", "cy"]).where("created_at = h.created_at AND id = h.id").drop("h"))
        reach = fresh.select(key, F.col("x").alias("o_x"), F.col("y").alias("o_y"), "cx", "cy", steps).select(key, "o_x", "o_y", *moved)
        gone = left.join(reach, [key, "cx", "cy"]).where(F.hypot(F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y")) <= tolerance).select(key, "x", "y").distinct()
        kept = kept.unionByName(fresh)
        left = cut(left.join(gone, [key, "x", "y"], "left_anti"))
    return kept.drop("cx", "cy")


def scout_cells(cells: DataFrame, blobs: DataFrame, plants: DataFrame, half_width: float, half_height: float, cal: transforms.Calibration, margin: float = 20.0, clear: float = 45.0, least_area: float = 0.004) -> DataFrame:
    """grd6: per cell (cell, x, y, issue) the weed candidates, and the plants wholly or partly in its frame.

    blobs: cell, blob, u, v, area_fraction. Blobs of usable frames and of some size
    count if no plant (id, x, y, radius) reaches them with its disc and `clear`. A
    plant with its margin is wholly framed from a coverage of 0.999 on. Blobs and
    plants that coincide are measured once and meet their rows afterwards.
    """
    gx, gy = transforms.blob_to_garden(F.col("u"), F.col("v"), F.col("x"), F.col("y"), half_width, half_height, cal)
    spots = blobs.where(F.col("area_fraction") >= least_area).join(cells.where("issue = 'usable'").select("cell", "x", "y"), "cell").select("cell", F.col("blob").alias("id"), gx.alias("x"), gy.alias("y"))
    discs = plants.groupBy("x", "y").agg((F.max("radius") + clear).alias("reach"))
    places = spots.select("x", "y").distinct().withColumn("id", F.struct("x", "y"))
    held = geometry.reached(places, discs, 100.0).select("id.x", "id.y")
    weeds = spots.join(held, ["x", "y"], "left_anti").groupBy("cell").agg(F.count("*").alias("candidates"), F.array_sort(F.collect_list(F.struct(F.round("x", 1).alias("x"), F.round("y", 1).alias("y")))).alias("points"))
    frames = cells.select(F.col("cell").alias("id"), (F.col("x") + cal.offset_x).alias("x"), (F.col("y") + cal.offset_y).alias("y"))
    wide = F.greatest(F.lit(1.0), F.col("radius") + margin)
    sized = plants.select("id", "x", "y", wide.alias("r"))
    far = sized.select("x", "y", "r").distinct().select("x", "y", (F.col("r") + math.hypot(half_width, half_height)).alias("reach"), F.struct("x", "y", "r").alias("tag"))
    near = geometry.reach_pairs(frames, far, 400.0).select(F.col("id").alias("cell"), "tag").join(cells.select("cell", "x", "y"), "cell")
    share = transforms.frame_coverage(F.col("tag.x"), F.col("tag.y"), F.col("tag.r"), F.col("x"), F.col("y"), half_width, half_height, cal)
    shown = near.select("cell", "tag.*", share.alias("share")).join(sized.hint("merge"), ["x", "y", "r"])
    seen = shown.groupBy("cell").agg(
        F.array_sort(F.collect_list(F.when(F.col("share") >= 0.999, F.col("id")))).alias("full"),
        F.array_sort(F.collect_list(F.when((F.col("share") > 0) & (F.col("share") < 0.999), F.col("id")))).alias("partial"),
    )
    return cells.select("cell", "issue").join(weeds, "cell", "left").join(seen, "cell", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def relative_blur(rows: DataFrame) -> DataFrame:
    """img19: a usable frame with far less detail than its usable neighbours becomes blurry.

    rows: run, cell_x, cell_y, image_id, issue, laplacian, edges, contrast, blur. At
    least two of the four adjacent cells must be usable; their medians are the measure.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("d")
    near = rows.where("issue = 'usable'").select("run", "cell_y", "cell_x", "laplacian", "edges", steps)
    near = near.select("run", (F.col("cell_y") + F.col("d.i")).alias("cell_y"), (F.col("cell_x") + F.col("d.j")).alias("cell_x"), "laplacian", "edges")
    about = near.groupBy("run", "cell_y", "cell_x").agg(F.count("*").alias("_n"), F.median("laplacian").alias("_l"), F.median("edges").alias("_e"))
    detail, edge = F.col("laplacian") / F.greatest(F.lit(1.0), F.col("_l")), F.col("edges") / F.greatest(F.lit(0.005), F.col("_e"))
    blurry = (F.col("issue") == "usable") & (F.col("_n") >= 2) & (F.col("_l") >= 25) & (F.col("laplacian") <= 80) & (detail <= 0.35) & (edge <= 0.65) & (F.col("contrast") >= 0.025)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.65 * (1 - detail / 0.35) + 0.35 * (1 - edge / 0.65)))
    blurry = F.coalesce(blurry, F.lit(False))
    changed = {"issue": F.when(blurry, "blurry").otherwise(F.col("issue")), "blur": F.when(blurry, F.greatest("blur", score)).otherwise(F.col("blur"))}
    return rows.join(about, ["run", "cell_y", "cell_x"], "left").withColumns(changed).drop("_n", "_l", "_e")


def quality_repairs(rows: DataFrame, attempted: DataFrame, retried: tuple[str, ...] = ("washed_out", "blurry", "leaf_obstruction")) -> DataFrame:
    """grd10: frames to photograph again: not usable, of an issue that is retried, and not attempted before."""
    return relative_blur(rows.join(attempted.select("image_id").distinct(), "image_id", "left_anti")).where(F.col("issue").isin(*retried))


def best_photo(rows: DataFrame, key: str) -> DataFrame:
    """img20: per key the image with the most clear plant and least cover; ties go to the larger id."""
    rank = F.struct(F.col("issue") == "usable", F.col("issue") != "washed_out", "clear", -F.col("obstruction"), "vegetation", "sharpness", "image_id")
    return rows.groupBy(key).agg(F.max_by("image_id", rank).alias("image_id"))


def soil_heights(triplets: DataFrame, slope: float, intercept: float, residual: float, direction: float = 1.0, limit: float = 8.0) -> DataFrame:
    """soi7: valid, reason, proposed_z, uncertainty and confidence per triplet from its stereo pairs.

    triplets: measurement_id, camera_z, z_spread and `pairs`, at most three structs
    (disparity, passes, coverage, support, lr_error, mad). The two closest distances
    count, all three if they agree within the limit.
    """
    ok = F.filter("pairs", lambda p: p["passes"])
    inverse = lambda p: slope * p["disparity"] + intercept
    found = F.array_sort(F.transform(F.filter(ok, lambda p: inverse(p) > 0), lambda p: F.struct((1 / inverse(p)).alias("d"), p["coverage"].alias("coverage"), p["support"].alias("support"), p["lr_error"].alias("lr_error"), p["mad"].alias("mad"))))
    rows = triplets.withColumns({"passing": F.size(ok), "c": found})
    at = lambda k: F.get("c", F.lit(k))["d"]
    three = F.size("c") == 3
    pick = F.when(three & (at(2) - at(0) <= limit), F.col("c")).when(three & (at(2) - at(1) < at(1) - at(0)), F.slice("c", 2, 2)).otherwise(F.slice("c", 1, 2))
    rows = rows.withColumn("a", pick)

    def median(name):
        v = F.array_sort(F.transform("a", lambda p: p[name]))
        return F.when(F.size("a") == 3, F.get(v, F.lit(1))).otherwise((F.get(v, F.lit(0)) + F.get(v, F.lit(1))) / 2)

    spread = F.array_max(F.transform("a", lambda p: p["d"])) - F.array_min(F.transform("a", lambda p: p["d"]))
    rows = rows.withColumns({"spread": spread, "uncertainty": F.greatest(F.lit(residual), spread / 2)})
    reason = (
        F.when(F.col("z_spread") > 1, "frames span too much in Z").when(F.col("passing") < 2, "fewer than two pairs passed").when(F.size("c") < 2, "pairs could not be converted")
        .when(F.col("spread") > limit, "pairs disagree").when(F.col("uncertainty") > 10, "too uncertain").otherwise("passed")
    )
    part = lambda v: F.greatest(F.lit(0.0), 1 - v)
    sure = (
        0.20 * F.least(F.lit(1.0), median("coverage") / 0.35) + 0.20 * F.least(F.lit(1.0), median("support") / 0.8) + 0.15 * part(median("lr_error") / 1.5)
        + 0.15 * part(median("mad") / 2.0) + 0.15 * part(F.col("spread") / limit) + 0.15 * max(0.0, 1 - residual / 5)
    )
    rows = rows.withColumn("reason", reason)
    valid = F.col("reason") == "passed"
    show = lambda v: F.when(valid, v)
    return rows.select("measurement_id", valid.alias("valid"), "reason", show(F.rint(F.col("camera_z") + direction * median("d"))).alias("proposed_z"), show(F.col("uncertainty")).alias("uncertainty"), show(F.least(F.lit(0.99), F.greatest(F.lit(0.0), sure))).alias("confidence"))


def soil_candidates(points: DataFrame, bed: tuple[float, float, float, float], baseline: float, reach: float = 200.0, spacing: float = 25.0, least: float = 0.0) -> DataFrame:
    """pln9: per point (id, x, y) the lattice places nearer than reach, and not nearer than least, on the bed, where a triplet along y fits."""
    k = math.ceil(reach / spacing)
    steps = [(i * spacing, j * spacing) for i in range(-k, k + 1) for j in range(-k, k + 1)]
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in steps if least <= math.hypot(i, j) < reach])).alias("o")
    y0, y1 = bed[1], bed[3]
    y = F.col("y")
    fits = ((y - baseline >= y0) & (y + baseline <= y1)) | (y + 2 * baseline <= y1) | (y - 2 * baseline >= y0)
    moved = points.select("id", "x", "y", offsets).select("id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.hypot("o.dx", "o.dy").alias("distance_mm"))
    return moved.where(F.col("x").between(bed[0], bed[2]) & y.between(y0, y1) & fits)
