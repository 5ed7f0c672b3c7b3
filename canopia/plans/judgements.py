"""Which views count and what they add up to, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopia.operators import evidence, store
from canopia.plans.garden import _NEWEST, _PENDING, _of


def _choice(rows: str) -> str:
    """CTEs for the choice of views: `p` one row a plant, `chosen` its mode and measurements in order.

    Sectors are bits of one integer; a step of the recursion takes one view a plant.
    """
    return f"""
z AS (
    SELECT *, confidence * sqrt(greatest(0.05, image_quality) * greatest(0.05, segmentation_quality)) AS q,
           epoch(max(image_timestamp) OVER (PARTITION BY plant_id)) - epoch(image_timestamp) <= 21600 AND has_evidence AND segmentation_quality >= 0.12 AS useful
    FROM {rows}),
u AS (
    SELECT plant_id, measurement_id, fits, center_visible, center_visible AND NOT truncated AND coverage >= 0.98 AS complete,
           ROW_NUMBER() OVER (PARTITION BY plant_id ORDER BY q DESC, image_timestamp DESC, measurement_id) AS r,
           coalesce(list_sum(list_transform(range(CAST(round_even(coverage * 72, 0) AS BIGINT)), lambda k: CAST(1 AS HUGEINT) << CAST((first_sector + k) % 72 AS HUGEINT))), 0) AS b
    FROM z WHERE useful),
p AS (
    SELECT plant_id, bool_and(fits) AS fits, min(r) FILTER (complete) AS whole, min(r) FILTER (center_visible) AS centre,
           list({{'r': r, 'm': measurement_id, 'b': CAST(b AS HUGEINT)}} ORDER BY r) AS l
    FROM u GROUP BY plant_id),
g(plant_id, fits, rest, used, seen) AS (
    SELECT plant_id, fits, list_filter(l, lambda v: v.r <> centre), [l[centre].m], l[centre].b FROM p WHERE whole IS NULL AND centre IS NOT NULL
    UNION ALL
    SELECT plant_id, fits, list_filter(rest, lambda v: v.r <> -best.nr), list_append(used, best.m), seen | best.b
    FROM (
        SELECT *, list_max(list_transform(rest, lambda v: {{'n': bit_count(v.b & ~seen), 'nr': -v.r, 'm': v.m, 'b': v.b}})) AS best
        FROM g WHERE len(rest) > 0 AND (NOT fits OR bit_count(seen) < 36))
    WHERE NOT fits OR best.n > 0),
chosen AS (
    SELECT plant_id, 'single_complete' AS mode, [l[whole].m] AS used, 72 AS covered FROM p WHERE whole IS NOT NULL
    UNION ALL
    SELECT plant_id, CASE WHEN NOT fits THEN 'large_composite' WHEN bit_count(seen) >= 36 THEN 'partial_composite' ELSE 'insufficient_partial' END, used, bit_count(seen)
    FROM g QUALIFY ROW_NUMBER() OVER (PARTITION BY plant_id ORDER BY len(used) DESC) = 1)"""


def _judged(rows: str) -> str:
    """CTEs for one judgement a plant, `judged`, after the choice among `rows`."""
    return f"""{_choice(rows)},
a AS (
    SELECT r.*, list_position(used, measurement_id) AS pos, coalesce(len(used), 0) AS picked,
           ROW_NUMBER() OVER (PARTITION BY plant_id ORDER BY image_timestamp DESC, measurement_id DESC) AS age
    FROM {rows} r LEFT JOIN chosen USING (plant_id)),
o AS (SELECT * REPLACE (CASE WHEN picked > 0 THEN nullif(pos, 0) WHEN vegetation_absent AND center_visible THEN age END AS pos) FROM a),
k AS (
    SELECT *, CAST(least(1, greatest(0.05, confidence)) * least(1, greatest(0.05, visible_fraction))
           * exp(-0.6931471805599453 * greatest(0, (epoch(arg_min(image_timestamp, pos) OVER (PARTITION BY plant_id)) - epoch(image_timestamp)) / 86400) / 14) AS DECIMAL(20,12)) AS w
    FROM o WHERE pos IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN vegetation_absent THEN w ELSE -w END) OVER (PARTITION BY plant_id) > 0 AS side FROM k),
h AS (
    SELECT *, sum(w) OVER (PARTITION BY plant_id ORDER BY recommended_mm) AS run, sum(w) OVER (PARTITION BY plant_id) AS total
    FROM s WHERE vegetation_absent = side),
m AS (
    SELECT plant_id, any_value(side) AS side, count(*) AS agreeing, min(CASE WHEN 2 * run >= total THEN recommended_mm END) AS median,
           CAST(sum(CAST(confidence * CAST(w AS DOUBLE) AS DECIMAL(20,12))) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS mean_confidence,
           CAST(sum(CAST(visible_fraction * CAST(w AS DOUBLE) AS DECIMAL(20,12))) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS mean_visible
    FROM h GROUP BY plant_id),
st AS (SELECT * FROM o QUALIFY ROW_NUMBER() OVER (PARTITION BY plant_id ORDER BY pos NULLS LAST, age) = 1),
nn AS (SELECT plant_id, count(*) AS views, count(pos) AS n FROM o GROUP BY plant_id),
f1 AS (SELECT * FROM o WHERE fused_mm IS NOT NULL AND fusion_reliable QUALIFY ROW_NUMBER() OVER (PARTITION BY plant_id ORDER BY age) = 1),
fm AS (SELECT * FROM o WHERE fused_mm IS NOT NULL AND pos IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY plant_id ORDER BY pos) = 1),
judged AS (
    SELECT plant_id, st.measurement_id, st.image_timestamp, st.current_radius_mm AS current_mm, views,
           CASE WHEN n = 0 THEN false WHEN n = 1 THEN st.vegetation_absent ELSE m.side END AS absent,
           CASE WHEN n = 1 THEN 1 ELSE st.picked END AS used,
           n = 0 OR (n > 1 AND NOT m.side AND fm.fused_mm IS NOT NULL AND NOT fm.fusion_reliable) AS uncertain,
           CASE WHEN n = 0 THEN least(0.2, CASE WHEN st.confidence = 0 THEN 0.05 ELSE st.confidence END)
                WHEN n = 1 THEN coalesce(f1.fused_confidence, st.confidence)
                WHEN NOT m.side AND fm.fused_mm IS NOT NULL THEN fm.fused_confidence
                ELSE least(0.99, mean_confidence + least(0.08, 0.02 * (agreeing - 1))) END AS confidence,
           CASE WHEN n < 2 THEN st.visible_fraction ELSE least(1, mean_visible) END AS visible_fraction,
           CASE WHEN n = 0 THEN st.recommended_mm WHEN n = 1 THEN coalesce(f1.fused_mm, st.recommended_mm)
                WHEN m.side THEN 0 ELSE coalesce(fm.fused_mm, m.median) END AS radius_mm
    FROM st JOIN nn USING (plant_id) LEFT JOIN m USING (plant_id) LEFT JOIN f1 USING (plant_id) LEFT JOIN fm USING (plant_id))"""


_OPEN = _PENDING.replace("FROM measurements", "FROM viewings").replace("p AS", "pend AS", 1) + f",\nr0 AS (SELECT * FROM pend QUALIFY {_NEWEST})"
_DIGITS = ("confidence", "visible_fraction", "radius_mm")


def _rounded(rows, *names):
    return rows.select(*names, *[F.round(n, 6).alias(n) for n in _DIGITS])


PLANS = {
    "sel1": (
        _of("viewings")(lambda v: evidence.select_evidence(v).select("plant_id", "mode", F.array_join(F.transform("used", lambda m: m.cast("string")), ",").alias("used"), "covered")),
        f"""WITH RECURSIVE {_choice("viewings")}
SELECT plant_id, coalesce(mode, CASE WHEN bool_or(useful) THEN 'no_center' ELSE 'no_evidence' END) AS mode,
       coalesce(array_to_string(used, ','), '') AS used, CAST(coalesce(covered, 0) AS BIGINT) AS covered
FROM z LEFT JOIN chosen USING (plant_id) GROUP BY plant_id, mode, used, covered""",
    ),
    "agg1": (
        _of("viewings")(lambda v: _rounded(evidence.consolidate(v), "plant_id", "measurement_id", "absent", "views", "used", "uncertain")),
        f"""WITH RECURSIVE {_judged("viewings")}
SELECT plant_id, measurement_id, absent, views, CAST(used AS BIGINT) AS used, uncertain,
       round(confidence, 6) AS confidence, round(visible_fraction, 6) AS visible_fraction, round(radius_mm, 6) AS radius_mm
FROM judged""",
    ),
    "q32": (
        _of("viewings", "decisions")(lambda v, d: store.review_queue(v, d, 0.1, 5.0, 3.0, 100).select("plant_id", "measurement_id", "absent", "uncertain", *[F.round(n, 6).alias(n) for n in ("confidence", "radius_mm", "change_mm")])),
        f"""WITH RECURSIVE {_OPEN}, {_judged("r0")},
j AS (SELECT *, radius_mm - current_mm AS change_mm FROM judged),
k2 AS (
    SELECT * REPLACE (CASE WHEN NOT absent AND change_mm <> 0 AND abs(change_mm) < CASE WHEN change_mm > 0 THEN 5 ELSE 3 END THEN 0.05 ELSE confidence END AS confidence)
    FROM j)
SELECT plant_id, measurement_id, absent, uncertain, round(confidence, 6) AS confidence, round(radius_mm, 6) AS radius_mm, round(change_mm, 6) AS change_mm
FROM k2 WHERE confidence >= 0.1 ORDER BY image_timestamp DESC, measurement_id DESC LIMIT 100""",
    ),
    "q8": (
        _of("viewings", "decisions")(lambda v, d: store.measurement_rows(v, d).select("measurement_id", "plant_id", "judged", "absent", F.round("confidence", 6).alias("confidence"), F.round("radius_mm", 6).alias("radius_mm"))),
        f"""WITH RECURSIVE {_OPEN}, {_judged("r0")},
hd AS (SELECT measurement_id AS head, plant_id FROM pend QUALIFY ROW_NUMBER() OVER (PARTITION BY plant_id ORDER BY image_timestamp DESC, measurement_id DESC) = 1),
sh AS (SELECT head, absent, confidence, radius_mm FROM hd JOIN judged USING (plant_id))
SELECT v.measurement_id, v.plant_id, head IS NOT NULL AS judged, CASE WHEN head IS NULL THEN v.vegetation_absent ELSE sh.absent END AS absent,
       round(CASE WHEN head IS NULL THEN v.confidence ELSE sh.confidence END, 6) AS confidence,
       round(CASE WHEN head IS NULL THEN v.recommended_mm ELSE sh.radius_mm END, 6) AS radius_mm
FROM viewings v LEFT JOIN sh ON head = v.measurement_id""",
    ),
}
