"""pln2 to pln5: straight cuts through weeds, routes to them around protected plants, and the order of a run."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopia.operators import geometry
from canopia.operators import transforms as T
from canopia.operators import zones as Z
from canopia.sources.shared import cut

#: Fixed values, in millimetres but for the step in degrees and the points of a circle.
STEP, OVERHANG, LEAST_LENGTH, MOST_LENGTH, LEAST_PART = 5, 30.0, 100.0, 220.0, 20.0
MARGIN, NEAR, FREE = 25.0, 150.0, 10_000.0
TRANSIT_MARGIN, POINTS, SLACK = 40.0, 32, 1e-6
#: Figures are compared to a millionth, so that angles which differ by rounding only tie; the first one wins.
DIGITS = 6


def _approach(x: Column, y: Column, angle: Column, length: Column, xb: tuple, yb: tuple) -> Column:
    """struct(sx, sy, ex, ey) that ends at the point, coming along the angle, cut off at the bed's border; null below LEAST_PART."""
    ux, uy = F.cos(angle), F.sin(angle)
    room = lambda c, d, b: F.when(F.abs(d) < 1e-9, length).when(d > 0, (c - b[0]) / d).otherwise((c - b[1]) / d)
    free = F.least(length, room(x, ux, xb), room(y, uy, yb))
    ends = F.struct((x - ux * free).alias("sx"), (y - uy * free).alias("sy"), x.alias("ex"), y.alias("ey"))
    return F.when(free >= LEAST_PART, ends)


def _best(lines: DataFrame, near: DataFrame, zones: list, margin: float) -> DataFrame:
    """(id, sx, sy, ex, ey, degrees, clearance_mm) of the best line of each weed that no plant or zone forbids.

    The largest least clearance goes first, then the least sum of squares of
    what is missing to NEAR, then the longest, then the smallest angle.
    """
    free = lines.where("s IS NOT NULL").select("id", "degrees", "s.*")
    for zone in zones:
        if zone.enabled and zone.kind == "exclusion":
            free = free.where(~Z.touches_segment(zone, (F.col("sx"), F.col("sy")), (F.col("ex"), F.col("ey"))))
    apart = Z.segment_distance(F.col("px"), F.col("py"), F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey")) - F.col("pr") - margin
    seen = free.join(near, "id", "left").withColumn("c", F.when(F.col("px").isNotNull(), apart))
    short = F.greatest(F.lit(0.0), NEAR - F.col("c"))
    line = ["id", "degrees", "sx", "sy", "ex", "ey"]
    rows = seen.groupBy(*line).agg(F.coalesce(F.min("c"), F.lit(FREE)).alias("clearance_mm"), F.coalesce(F.sum(short * short), F.lit(0.0)).alias("penalty")).where("clearance_mm >= 0")
    length = F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"))
    order = F.struct(F.round("clearance_mm", DIGITS), -F.round("penalty", DIGITS), F.round(length, DIGITS), -F.col("degrees"))
    return rows.groupBy("id").agg(F.max_by(F.struct(*line[1:], "clearance_mm"), order).alias("b")).select("id", "b.*")


def cut_paths(weeds: DataFrame, plants: DataFrame, xb: tuple[float, float], yb: tuple[float, float], zones: list = (), margin: float = MARGIN) -> DataFrame:
    """pln2: a straight cut through each weed (id, x, y, radius): sx, sy, ex, ey, degrees, length_mm, clearance_mm, partial; weeds out of reach have no row.

    All angles are tried for a full cut; weeds that have none are approached
    from the open side up to their centre. Only plants (x, y, radius) join a
    weed that can have its least clearance or come within NEAR of a line.
    """
    length = F.least(F.lit(MOST_LENGTH), F.greatest(F.lit(LEAST_LENGTH), F.col("radius") * 2 + 2 * OVERHANG))
    part = F.greatest(F.lit(LEAST_PART), F.col("radius") + OVERHANG)
    rows = cut(weeds.select("id", "x", "y", "radius"))
    discs = plants.select("x", "y", "radius")
    edges = geometry.nearest_edges(rows.select("id", "x", "y"), discs)
    widest = discs.agg(F.coalesce(F.max("radius"), F.lit(0.0))).first()[0]
    most = F.greatest(length / 2, part)  # how far a line leaves the weed
    reach = F.greatest(F.col("edge") + 2 * most, most + NEAR + margin) + widest
    around = rows.join(edges, "id").select(F.col("id").alias("tag"), "x", "y", reach.alias("reach"))
    numbered = discs.withColumn("id", F.struct("x", "y", "radius"))
    near = geometry.reach_pairs(numbered.select("id", "x", "y"), around, 500.0).select(F.col("tag").alias("id"), F.col("id.x").alias("px"), F.col("id.y").alias("py"), F.col("id.radius").alias("pr"))
    near = cut(near)
    degrees = lambda end: F.explode(F.sequence(F.lit(0), F.lit(end - STEP), F.lit(STEP))).alias("degrees")
    angle = F.radians("degrees")
    full = rows.select("*", degrees(180)).withColumn("s", T.bounded_segment(F.col("x"), F.col("y"), F.col("radius"), angle, length, xb, yb))
    best = cut(_best(full, near, zones, margin).withColumn("partial", F.lit(False)))
    rest = rows.join(best.select("id"), "id", "left_anti").select("*", degrees(360)).withColumn("s", _approach(F.col("x"), F.col("y"), angle, part, xb, yb))
    some = _best(rest, near, zones, margin).withColumns({"degrees": F.col("degrees") % 180, "partial": F.lit(True)})
    both = best.unionByName(some)
    return both.withColumn("length_mm", F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")))


def _clear(a: np.ndarray, b: np.ndarray, circles: np.ndarray, first: bool) -> np.ndarray:
    """Which of the segments from a to each row of b keep off the circles; from a start inside one, only straight escapes do."""
    ok, live, step = np.zeros(len(b), bool), np.arange(len(b)), b - a
    size = (step * step).sum(axis=1)
    if len(b):  # a circle beside all of the segments' box meets none of them
        low, high, wide = np.minimum(a, b.min(axis=0)), np.maximum(a, b.max(axis=0)), circles[:, 2:]
        circles = circles[((circles[:, :2] + wide >= low) & (circles[:, :2] - wide <= high)).all(axis=1)]
    # the nearest circles stop most of the segments; only those that are left meet the others
    for cx, cy, r in circles[np.argsort(np.hypot(*(circles[:, :2] - a).T) - circles[:, 2], kind="stable")]:
        if not len(live):
            break
        from_a = a - (cx, cy)
        inside = math.hypot(*from_a)
        if first and inside < r - SLACK:
            free = (step @ from_a >= -SLACK) & (np.hypot(b[:, 0] - cx, b[:, 1] - cy) > inside + SLACK)
        else:
            t = np.clip(-(step @ from_a) / np.where(size > 1e-9, size, 1.0), 0, 1) * (size > 1e-9)
            free = np.hypot(from_a[0] + t * step[:, 0], from_a[1] + t * step[:, 1]) >= r - SLACK
        if not free.all():
            live, step, size, b = live[free], step[free], size[free], b[free]
    ok[live] = True
    return ok


def shortest(start: tuple, end: tuple, circles: np.ndarray, xb: tuple, yb: tuple) -> list[tuple[float, float]] | str:
    """pln3: the waypoints of the shortest way around the circles (x, y, radius), or why there is none.

    Ways go over POINTS places around each circle, far enough out for the chords
    between them; what is seen from a place is worked out when it is reached, the
    places that promise the shortest way first.
    """
    places = np.array([start, end], np.float64)
    if not all(xb[0] <= x <= xb[1] and yb[0] <= y <= yb[1] for x, y in places):
        return "an end is outside the bed"
    if any(math.hypot(end[0] - x, end[1] - y) < r for x, y, r in circles):
        return "the end is too near a protected plant"
    if _clear(places[0], places[1:], circles, True)[0]:
        return []
    turn = 2 * math.pi * np.arange(POINTS) / POINTS
    rings = [np.column_stack((x + np.cos(turn) * out, y + np.sin(turn) * out)) for x, y, r in circles for out in [r / math.cos(math.pi / POINTS) + 2.0]]
    ring = np.concatenate(rings)
    ring = ring[(ring[:, 0] >= xb[0]) & (ring[:, 0] <= xb[1]) & (ring[:, 1] >= yb[0]) & (ring[:, 1] <= yb[1])]
    for x, y, r in circles:
        ring = ring[np.hypot(ring[:, 0] - x, ring[:, 1] - y) >= r - SLACK]
    places = np.concatenate((places, ring))
    to_end = np.hypot(*(places - places[1]).T)
    # a hasty search finds some way; only places no further round than that can lie on the shortest
    hasty = _search(places, circles, to_end, 3.0, np.inf)
    if hasty is None:
        return "no way inside the bed keeps off the protected plants"
    return _search(places, circles, to_end, 1.0, hasty[0] + SLACK)[1]


def _search(places: np.ndarray, circles: np.ndarray, to_end: np.ndarray, haste: float, most: float) -> tuple[float, list] | None:
    """Length and waypoints of a way from the first place to the second, no longer than `most`; with haste 1 the shortest."""
    best, back, done = np.full(len(places), np.inf), np.full(len(places), -1), np.zeros(len(places), bool)
    best[0], queue = 0.0, [(0.0, 0)]
    best[1] = most + SLACK
    while queue:
        _, k = heapq.heappop(queue)
        if done[k]:
            continue
        done[k], far = True, best[k]
        if k == 1:
            way = []
            while (k := int(back[k])) > 0:
                way.append((float(places[k][0]), float(places[k][1])))
            return float(far), way[::-1]
        near = far + np.hypot(*(places - places[k]).T)
        if near[1] < best[1] and _clear(places[k], places[1:2], circles, k == 0)[0]:
            best[1], back[1] = near[1], k
            heapq.heappush(queue, (float(near[1]), 1))
        # what cannot lead to the end more shortly than a way already known is left out
        open_ = np.flatnonzero(~done & (near < best) & (near + to_end < best[1]))
        for j in open_[_clear(places[k], places[open_], circles, k == 0)].tolist():
            best[j], back[j] = near[j], k
            heapq.heappush(queue, (float(near[j] + haste * to_end[j]), j))
    return None


_ROUTES = "route_id long, reversed boolean, waypoints array<struct<x: double, y: double>>, length_mm double, error string"


def routes(trips: DataFrame, protected: DataFrame, margin: float = TRANSIT_MARGIN, end_margin: float | None = None) -> DataFrame:
    """pln3, pln4: (route_id, reversed, waypoints, length_mm, error) of trips (route_id, bed_id, x, y, sx, sy, ex, ey, x0, y0, x1, y1).

    A trip goes from (x, y) to the start of a cut, or if that cannot be reached
    to its other end; the bed is x0 to x1 and y0 to y1. protected holds the
    plants (bed_id, x, y, radius) of the beds, each bed's few. With end_margin, a
    circle around an end counts with that margin instead.
    """
    plants = protected.groupBy("bed_id").agg(F.collect_list(F.struct("x", "y", "radius")).alias("plants"))

    def one(t: dict) -> dict:
        start, why = (t["x"], t["y"]), []
        plants = np.array([(p["x"], p["y"], p["radius"]) for p in t["plants"] or ()], np.float64).reshape(-1, 3)
        for back, end in ((False, (t["sx"], t["sy"])), (True, (t["ex"], t["ey"]))):
            circles = plants + (0, 0, margin)
            if end_margin is not None:
                held = np.minimum(*(np.hypot(plants[:, 0] - p[0], plants[:, 1] - p[1]) for p in (start, end))) < circles[:, 2]
                circles[held, 2] = plants[held, 2] + end_margin
            way = shortest(start, end, circles, (t["x0"], t["x1"]), (t["y0"], t["y1"]))
            if not isinstance(way, str):
                stops = [start, *way, end]
                return {"route_id": t["route_id"], "reversed": back, "waypoints": [{"x": x, "y": y} for x, y in way], "length_mm": sum(math.dist(a, b) for a, b in zip(stops, stops[1:], strict=False)), "error": None}
            why.append(way)
        return {"route_id": t["route_id"], "reversed": None, "waypoints": None, "length_mm": None, "error": "; ".join(dict.fromkeys(why))}

    target = pa.schema([("route_id", pa.int64()), ("reversed", pa.bool_()), ("waypoints", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("length_mm", pa.float64()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(t) for t in batch.to_pylist()], schema=target)

    # a search is far dearer than its row: rows are dealt out evenly
    dealt = trips.join(plants, "bed_id", "left").withColumn("route_id", F.col("route_id").cast("long")).repartition(max(8, trips.sparkSession.sparkContext.defaultParallelism), "route_id")
    return dealt.mapInArrow(run, _ROUTES)


def ordered(paths: DataFrame, starts: DataFrame) -> DataFrame:
    """pln5: paths (run_id, id, sx, sy, ex, ey) of each run in the order of a chain to the nearest end: position, reversed.

    starts are (run_id, x, y). Each step depends on the one before, so a run,
    which one machine drives, is one task's; ties go to the smaller id.
    """

    def run(own: pa.Table, start: pa.Table) -> pa.Table:
        own = own.sort_by("id")
        ends = np.column_stack([own.column(c).to_numpy() for c in ("sx", "sy", "ex", "ey")]).astype(np.float64).reshape(-1, 4)
        at = np.array([start.column(c)[0].as_py() for c in ("x", "y")]) if len(start) else np.zeros(2)
        left, place, turned = np.ones(len(ends), bool), np.zeros(len(ends), np.int64), np.zeros(len(ends), bool)
        for k in range(len(ends)):
            near, far = (np.hypot(ends[:, i] - at[0], ends[:, i + 1] - at[1]) for i in (0, 2))
            j = int(np.argmin(np.where(left, np.minimum(near, far), np.inf)))
            place[j], turned[j], left[j] = k, far[j] < near[j], False
            at = ends[j, :2] if turned[j] else ends[j, 2:]
        return pa.table([own.column("run_id"), own.column("id"), pa.array(place), pa.array(turned)], ["run_id", "id", "position", "reversed"])

    narrow = paths.select(F.col("run_id").cast("long"), F.col("id").cast("long"), "sx", "sy", "ex", "ey")
    from_ = starts.select(F.col("run_id").cast("long").alias("start_run"), "x", "y")
    return narrow.groupBy("run_id").cogroup(from_.groupBy("start_run")).applyInArrow(run, "run_id long, id long, position long, reversed boolean")
