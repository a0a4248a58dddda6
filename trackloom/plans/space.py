"""Queries on region boundaries, rasters and pixels, with their SQL.

Boundaries come from ``embeddings``: a vector is a region of plate ``label``, its numbers are the
centre and the coefficients of four boundary pieces.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import kinematics as kin
from trackloom.operators import pixels as px
from trackloom.operators import space as sp
from trackloom.plans.catalog import COND, OBS, STEPS, query
from trackloom.sources.tables import condition_of, conditions, kept, observations, table

BREAKS = [-math.pi, -math.pi / 2, 0.0, math.pi / 2, math.pi]
ANGLES = [-4.0, -3.0, -1.0, 0.0, 0.5, 2.0, 3.0, 4.0]
SAMPLES = 480
SIDE_MM = 3.2


def regions(spark, d) -> DataFrame:
    """``plate, region, cx, cy, breaks, coefs`` of every vector."""

    def e(i):
        return F.col("embedding")[i].cast("double")

    pieces = F.array(*[F.array(e(2 + 3 * k), e(3 + 3 * k), 20 + 10 * F.abs(e(4 + 3 * k))) for k in range(4)])
    return table(spark, d, "embeddings").select(
        F.col("label").alias("plate"), F.col("vec_id").alias("region"),
        (F.floor(e(0) * 1000) + 0.5).alias("cx"), (F.floor(e(1) * 1000) + 0.5).alias("cy"),
        F.array(*[F.lit(b) for b in BREAKS]).alias("breaks"), pieces.alias("coefs"),
    )


def _e(i: int) -> str:
    return f"CAST(embedding[{i + 1}] AS DOUBLE)"


REG = f"""rg AS (SELECT label AS plate, vec_id AS region, floor({_e(0)} * 1000) + 0.5 AS cx, floor({_e(1)} * 1000) + 0.5 AS cy,
 [{", ".join(f"[{_e(2 + 3 * k)}, {_e(3 + 3 * k)}, 20 + 10 * abs({_e(4 + 3 * k)})]" for k in range(4))}] AS coefs FROM embeddings)"""


def _spline(angle: str) -> str:
    """SQL of a piece's value by cases, one per piece."""
    left, right = BREAKS[:-1], BREAKS[1:-1] + [1e300]
    cases = " ".join(f"WHEN {angle} >= {a!r}::DOUBLE AND {angle} < {b!r}::DOUBLE THEN (coefs[{i}][1] * ({angle} - ({a!r}::DOUBLE)) + coefs[{i}][2]) * ({angle} - ({a!r}::DOUBLE)) + coefs[{i}][3]" for i, (a, b) in enumerate(zip(left, right), 1))
    last = f"({angle} - ({BREAKS[-1]!r}::DOUBLE))"
    return f"CASE {cases} ELSE (coefs[4][1] * {last} + coefs[4][2]) * {last} + coefs[4][3] END"


BOUNDARY = f"""{REG}, ba AS (SELECT plate, region, cx, cy, coefs, {-math.pi!r}::DOUBLE + k * {2 * math.pi / (SAMPLES - 1)!r}::DOUBLE AS angle FROM rg, (SELECT unnest(range(0, {SAMPLES})) AS k)),
br AS (SELECT plate, region, cx, cy, angle, {_spline("angle")} AS r FROM ba),
bp AS (SELECT plate, region, CAST(trunc(cx + r * cos(angle)) AS INTEGER) AS bx, CAST(trunc(cy + r * sin(angle)) AS INTEGER) AS "by" FROM br),
ln AS (SELECT plate, region, "by", min(bx) AS low, max(bx) AS high FROM bp GROUP BY plate, region, "by" HAVING max(bx) > min(bx))"""


def lines(spark, d) -> DataFrame:
    """Extents of regions on lines, made once for the session."""
    return kept(spark, d, "line-extents", ["embeddings"], lambda: sp.scan_lines(sp.boundary(regions(spark, d), SAMPLES)))


@query("geo01_spline", f"WITH {REG}, a AS (SELECT *, unnest([{', '.join(map(str, ANGLES))}]::DOUBLE[]) AS angle FROM rg) SELECT region, angle, round({_spline('angle')}, 8) AS radius FROM a")
def geo01(spark, d):
    r = regions(spark, d).withColumn("angle", F.explode(F.array(*[F.lit(a) for a in ANGLES])))
    return r.select("region", "angle", F.round(sp.spline(F.col("angle"), F.col("breaks"), F.col("coefs")), 8).alias("radius"))


@query("geo06_scan_lines", f"WITH {BOUNDARY} SELECT * FROM ln")
def geo06(spark, d):
    return lines(spark, d)


@query(
    "geo06_overlaps",
    f"""WITH {BOUNDARY}, fu AS (SELECT *, max(high) OVER (PARTITION BY plate, "by" ORDER BY low, high, region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM ln)
SELECT plate, count(*) FILTER (furthest > low) AS n_overlaps FROM fu GROUP BY plate""",
)
def geo06_overlaps(spark, d):
    return sp.line_overlaps(lines(spark, d))


@query("geo06_raster", f"""WITH {BOUNDARY}, pxl AS (SELECT plate, region, "by" AS py, unnest(range(low, high)) AS px FROM ln), w AS (SELECT plate, px, py, max(region) AS region FROM pxl GROUP BY plate, px, py)
SELECT plate, region, count(*) AS n_pixels, CAST(sum(px) AS BIGINT) AS sum_x, CAST(sum(py) AS BIGINT) AS sum_y FROM w GROUP BY plate, region""")
def geo06_raster(spark, d):
    """Pixels that each region has in the raster of its plate."""
    return sp.raster(lines(spark, d)).groupBy("plate", "region").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("px").alias("sum_x"), F.sum("py").alias("sum_y"))


@query("geo24_coverage", f"""WITH {BOUNDARY}, pxl AS (SELECT plate, "by" AS py, unnest(range(low, high)) AS px FROM ln), w AS (SELECT DISTINCT plate, px, py FROM pxl)
SELECT n_plates, count(*) AS n_pixels FROM (SELECT px, py, count(*) AS n_plates FROM w GROUP BY px, py) GROUP BY n_plates""")
def geo24(spark, d):
    """Pixels by the number of plates that have a region there."""
    return sp.raster(lines(spark, d)).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n_plates")).groupBy("n_plates").agg(F.count(F.lit(1)).alias("n_pixels"))


#: Positions of observations in the frame of the boundaries.
PIX = f"""{OBS}, oq AS (SELECT CAST(plate % 10 AS INTEGER) AS plate, ord, plate AS who, CAST(floor(x / 100) - 250 AS BIGINT) AS px, y * 4 - 200 AS py FROM obs)"""


def placed(spark, d) -> DataFrame:
    return observations(spark, d).select((F.col("plate") % 10).cast("int").alias("plate"), "ord", F.col("plate").alias("who"), (F.floor(F.col("x") / 100) - 250).alias("px"), (F.col("y") * 4 - 200).alias("py"))


@query(
    "trj05_raster_region",
    f"""WITH {PIX}, {BOUNDARY}, pxl AS (SELECT plate, region, "by" AS py, unnest(range(low, high)) AS px FROM ln), w AS (SELECT plate, px, py, max(region) AS region FROM pxl GROUP BY plate, px, py)
SELECT who, ord, coalesce(w.region, -1) AS region FROM oq LEFT JOIN w ON w.plate = oq.plate AND w.px = oq.px AND w.py = oq.py""",
)
def trj05(spark, d):
    """Region of each observation by its pixel of the plate's raster, from the extents of regions on lines."""
    at = placed(spark, d)
    hit = at.join(sp.raster_regions(at.select("plate", "px", "py").distinct(), lines(spark, d)), ["plate", "px", "py"], "left")
    return hit.select("who", "ord", F.coalesce("region", F.lit(-1).cast("long")).alias("region"))


#: Extents of what lies outside of regions, a pixel beyond them at most, and signed distances of visited pixels.
SIGNED = """mi AS (SELECT plate, "by", min(low) AS low, max(high) AS high FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY plate, "by" ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN max(high) OVER (PARTITION BY plate, "by" ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= low THEN 0 ELSE 1 END AS fresh FROM ln)) GROUP BY plate, "by", island),
fr AS (SELECT plate, min(low) AS l0, max(high) AS h0, min("by") AS b0, max("by") AS b1 FROM ln GROUP BY plate),
rw AS (SELECT plate, l0, h0, unnest(range(b0 - 1, b1 + 2)) AS "by" FROM fr),
ow AS (SELECT rw.plate, rw."by", l0, h0, low, high FROM rw LEFT JOIN mi ON mi.plate = rw.plate AND mi."by" = rw."by"),
ol AS (SELECT plate, "by", coalesce(lag(high) OVER (PARTITION BY plate, "by" ORDER BY low), l0 - 1) AS low, coalesce(low, h0 + 1) AS high FROM ow
  UNION ALL SELECT plate, "by", max(high), any_value(h0) + 1 FROM ow WHERE high IS NOT NULL GROUP BY plate, "by"),
so AS (SELECT plate, px, py, sqrt(min(greatest(low - px, px - (high - 1), 0) * greatest(low - px, px - (high - 1), 0) + ("by" - py) * ("by" - py))::DOUBLE) AS distance FROM dp JOIN ln USING (plate) GROUP BY plate, px, py),
sg AS (SELECT * FROM so WHERE distance > 0 UNION ALL
  SELECT plate, px, py, 1 - sqrt(min(greatest(low - px, px - (high - 1), 0) * greatest(low - px, px - (high - 1), 0) + ("by" - py) * ("by" - py))::DOUBLE) AS distance
  FROM (SELECT plate, px, py FROM so WHERE distance = 0) JOIN (SELECT * FROM ol WHERE low < high) USING (plate) GROUP BY plate, px, py)"""


@query("geo09_distance", f"WITH {PIX}, {BOUNDARY}, dp AS (SELECT DISTINCT plate, px, py FROM oq), {SIGNED} SELECT * FROM sg")
def geo09(spark, d):
    """Signed distance of every visited pixel to the edge of the regions of its plate."""
    return sp.region_distance(placed(spark, d).select("plate", "px", "py").distinct(), lines(spark, d))


@query(
    "geo11_nearest_region",
    f"""WITH {PIX}, {REG}, dp AS (SELECT DISTINCT plate, px, py FROM oq),
nr AS (SELECT dp.plate, px, py, region, px - cx AS dx, py - cy AS dy, row_number() OVER (PARTITION BY dp.plate, px, py ORDER BY (px - cx) * (px - cx) + (py - cy) * (py - cy), region) AS k FROM dp JOIN rg ON rg.plate = dp.plate)
SELECT plate, px, py, region, round(sqrt(dx * dx + dy * dy), 8) AS distance, round(atan2(dy, dx), 8) AS angle FROM nr WHERE k = 1""",
)
def geo11(spark, d):
    near = sp.nearest_region(placed(spark, d).select("plate", "px", "py").distinct(), regions(spark, d).select("plate", "region", "cx", "cy"))
    return near.withColumns({"distance": F.round("distance", 8), "angle": F.round("angle", 8)})


@query("geo14_mean_radius", f"WITH {BOUNDARY} SELECT plate, round(avg(r), 6) AS mean_radius FROM br GROUP BY plate")
def geo14(spark, d):
    """Mean radius of the regions of a plate over equal steps of angle."""
    step = 2 * math.pi / (SAMPLES - 1)
    r = regions(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1)))).withColumn("angle", F.lit(-math.pi) + F.col("k") * step)
    return r.groupBy("plate").agg(F.round(F.avg(sp.spline(F.col("angle"), F.col("breaks"), F.col("coefs"))), 6).alias("mean_radius"))


@query(
    "geo17_interregion_distance",
    f"""WITH {REG}, pr AS (SELECT a.plate, a.region AS src, (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) AS d2 FROM rg a JOIN rg b ON a.plate = b.plate AND a.region <> b.region), m AS (SELECT plate, src, 0.0324::DOUBLE * sqrt(min(d2)) AS mm FROM pr GROUP BY plate, src)
SELECT plate, count(*) AS n, round(avg(mm), 6) AS mean_mm, round(stddev_pop(mm), 6) AS std_mm, round(median(mm), 6) AS med_mm FROM m GROUP BY plate""",
)
def geo17(spark, d):
    """Distance to the nearest other region: mean, population deviation and median of a layout."""
    r = regions(spark, d)
    at = r.select("plate", "region", F.col("cx").alias("low"), (F.col("cx") + 1).alias("high"), F.col("cy").alias("by"))
    points = r.select("plate", F.col("region").alias("src"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    m = sp.nearest(points, at, ["region"], F.col("src") != F.col("_t_region")).select("plate", (F.lit(0.0324) * F.sqrt("d2")).alias("mm"))
    return m.groupBy("plate").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mm"), 6).alias("mean_mm"), F.round(F.stddev_pop("mm"), 6).alias("std_mm"), F.round(F.median("mm"), 6).alias("med_mm"))


def corners(spark, d) -> DataFrame:
    """Four points near the corners of a square of a thousand pixels for every vector."""
    c = table(spark, d, "embeddings").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    at = F.col("k") * 2
    return c.select(
        F.col("vec_id").alias("plate"), "k",
        (F.col("k") % 2 * 1000 + F.col("embedding")[at].cast("double") * 20).alias("x"),
        (F.floor(F.col("k") / 2) * 1000 + F.col("embedding")[at + 1].cast("double") * 20 + F.col("k")).alias("y"),
    )


CORNERS = """co AS (SELECT vec_id AS plate, k, k % 2 * 1000 + CAST(embedding[2 * k + 1] AS DOUBLE) * 20 AS x, k // 2 * 1000 + CAST(embedding[2 * k + 2] AS DOUBLE) * 20 + k AS y FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS k)),
cq AS (SELECT plate, array_agg(x ORDER BY y, x) AS xs, array_agg(y ORDER BY y, x) AS ys FROM co GROUP BY plate),
cv AS (SELECT plate, list_sum(xs) / 4 AS mx, list_sum(ys) / 4 AS my, ((xs[4] - xs[1]) + (ys[4] - ys[1]) + (xs[2] - xs[3]) - (ys[2] - ys[3])) / 4 AS v1x, ((ys[4] - ys[1]) - (xs[4] - xs[1]) + (ys[2] - ys[3]) + (xs[2] - xs[3])) / 4 AS v1y FROM cq),
cb AS (SELECT plate, mx - (v1x - v1y) / 2 AS x0, my - (v1y + v1x) / 2 AS y0, v1x, v1y FROM cv)"""


@query("geo03_square_basis", f"WITH {CORNERS} SELECT plate, round(x0, 6) AS x0, round(y0, 6) AS y0, round(v1x, 6) AS v1x, round(v1y, 6) AS v1y FROM cb")
def geo03(spark, d):
    return sp.square_basis(corners(spark, d)).select("plate", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "v1x", "v1y")])


@query(
    "geo04_millimetres",
    f"""WITH {CORNERS} SELECT plate, k, round({SIDE_MM} * ((x - x0) * v1x + (y - y0) * v1y) / (v1x * v1x + v1y * v1y), 6) AS mm_x, round({SIDE_MM} * ((y - y0) * v1x - (x - x0) * v1y) / (v1x * v1x + v1y * v1y), 6) AS mm_y FROM co JOIN cb USING (plate)""",
)
def geo04(spark, d):
    """The corners in millimetres of the fitted square."""
    c = corners(spark, d)
    u, v = sp.to_basis(F.col("x"), F.col("y"), SIDE_MM)
    return c.join(sp.square_basis(c), "plate").select("plate", "k", F.round(u, 6).alias("mm_x"), F.round(v, 6).alias("mm_y"))


@query(
    "geo05_square_quality",
    f"""WITH {CORNERS.split(",\\ncq")[0]}, pr AS (SELECT a.plate, a.k, b.x - a.x AS dx, b.y - a.y AS dy, row_number() OVER (PARTITION BY a.plate, a.k ORDER BY sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), b.y, b.x) AS n FROM co a JOIN co b ON a.plate = b.plate AND a.k <> b.k),
uw AS (SELECT p.plate, abs((p.dx * q.dx + p.dy * q.dy) / (sqrt(p.dx * p.dx + p.dy * p.dy) * sqrt(q.dx * q.dx + q.dy * q.dy))) AS c FROM pr p JOIN pr q ON p.plate = q.plate AND p.k = q.k AND p.n = 1 AND q.n = 2)
SELECT plate, round(sum(c), 6) AS quality FROM uw GROUP BY plate""",
)
def geo05(spark, d):
    return sp.square_quality(corners(spark, d).select("plate", "x", "y")).select("plate", F.round("quality", 6).alias("quality"))


PV = f"""{OBS}, pw AS (SELECT plate, ord, t, region, unnest([x // 2500, x // 2500 + 1]) AS px, y // 10 AS py FROM obs),
pi AS (SELECT *, ord - row_number() OVER (PARTITION BY plate, px, py ORDER BY ord) AS island FROM pw),
pv AS (SELECT plate, px, py, min(ord) AS first_ord, min(t) AS start, max(t) AS "end", count(*) AS n_frames FROM pi GROUP BY plate, px, py, island),
ph AS (SELECT *, CAST(coalesce(sum(n_frames) OVER (PARTITION BY plate, px, py ORDER BY first_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, row_number() OVER (PARTITION BY plate, px, py ORDER BY first_ord) AS nth FROM pv),
pm AS (SELECT least(before + i, 40) AS seen, least(n_frames - i, 40) AS "left", count(*) AS n FROM (SELECT before, n_frames, unnest(range(0, n_frames)) AS i FROM ph) GROUP BY 1, 2)"""


def pixel_rows(spark, d) -> DataFrame:
    return px.pixel_rows(observations(spark, d), 2500, 10)


def history(spark, d) -> DataFrame:
    return px.visit_history(px.pixel_visits(pixel_rows(spark, d)))


@query("trj08_pixel_rows", f"WITH {PV} SELECT plate, ord, region, px, py FROM pw")
def trj08(spark, d):
    return pixel_rows(spark, d).select("plate", "ord", "region", "px", "py")


@query("evt26_pixel_visits", f"WITH {PV} SELECT * FROM pv")
def evt26(spark, d):
    return px.pixel_visits(pixel_rows(spark, d))


@query("evt28_delay_matrix", f"WITH {PV} SELECT * FROM pm")
def evt28(spark, d):
    return px.delay_matrix(history(spark, d), 40)


@query("evt29_pixel_leaving", f"WITH {PV} SELECT seen, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (\"left\" = 1), 0) AS BIGINT) AS n_leaving, CAST(coalesce(sum(n) FILTER (\"left\" = 1), 0) AS BIGINT) / CAST(sum(n) AS BIGINT) AS p_leave FROM pm GROUP BY seen HAVING sum(n) > 30")
def evt29(spark, d):
    return px.pixel_leaving(px.delay_matrix(history(spark, d), 40), 30)


@query("evt30_pixel_history", f"WITH {PV} SELECT plate, px, py, first_ord, n_frames, before, nth FROM ph")
def evt30(spark, d):
    return history(spark, d).select("plate", "px", "py", "first_ord", "n_frames", "before", "nth")


@query("evt31_explored", f"WITH {PV}, q AS (SELECT plate, region, px, py, count(*) AS n FROM pw WHERE region >= 0 GROUP BY ALL) SELECT plate, region, count(*) AS n_pixels, CAST(sum(n) AS BIGINT) AS n_frames, count(*) FILTER (n = 1) AS n_once FROM q GROUP BY plate, region")
def evt31(spark, d):
    return px.explored(pixel_rows(spark, d))


@query(
    "evt32_depletion",
    f"""WITH {PV}, rn AS (SELECT plate, ord, row_number() OVER (PARTITION BY plate, px, py ORDER BY ord) AS k FROM pw), tk AS (SELECT plate, ord, sum(least(100, k * 30) - least(100, (k - 1) * 30)) AS taken FROM rn GROUP BY plate, ord)
SELECT plate, ord, CAST(sum(taken) OVER (PARTITION BY plate ORDER BY ord) AS BIGINT) AS taken_percent FROM tk""",
)
def evt32(spark, d):
    return px.depletion(pixel_rows(spark, d), 30)


@query("agg08_heatmap", f"WITH {PV} SELECT px, py, count(*) AS n, count(DISTINCT plate) AS n_plates, count(*) / (SELECT count(*) FROM pw) AS share FROM pw GROUP BY px, py")
def agg08(spark, d):
    return px.heatmap(pixel_rows(spark, d))


@query(
    "evt27_pixel_steps",
    f"""WITH {STEPS}, pw AS (SELECT plate, dist, dt, unnest([x // 2500, x // 2500 + 1]) AS px, y // 10 AS py FROM st)
SELECT plate, px, py, count(*) AS n, CAST(sum(dist) AS DOUBLE) / CAST(nullif(sum(dt), 0) AS DOUBLE) AS speed FROM pw GROUP BY plate, px, py""",
)
def evt27(spark, d):
    """Speed over all frames in which a pixel is covered; the step goes along with the row, so nothing is joined."""
    o = kin.steps(observations(spark, d))
    own = F.floor(F.col("x") / 2500).cast("long")
    rows = o.select("plate", "dist", "dt", F.explode(F.array(own, own + 1)).alias("px"), F.floor(F.col("y") / 10).cast("long").alias("py"))
    g = rows.groupBy("plate", "px", "py").agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("dist"), F.sum("dt").alias("dt"))
    return g.select("plate", "px", "py", "n", F.try_divide(F.col("dist").cast("double"), F.col("dt").cast("double")).alias("speed"))


@query("fil13_side_steps", f"WITH {STEPS} SELECT plate, region >= 0 AS inside, count(*) AS n, min(dist) AS least, max(dist) AS most FROM st WHERE dist <> 0 GROUP BY 1, 2")
def fil13(spark, d):
    """Steps inside and outside of regions, without those of no length."""
    s = kin.steps(observations(spark, d)).where("dist <> 0")
    return s.groupBy("plate", (F.col("region") >= 0).alias("inside")).agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("least"), F.max("dist").alias("most"))


@query("geo25_point_counts", f"WITH {CORNERS.split(',' + chr(10) + 'cq')[0]} SELECT CAST(trunc(x / 10) AS BIGINT) AS px, CAST(trunc(y / 10) AS BIGINT) AS py, count(*) AS n FROM co GROUP BY 1, 2")
def geo25(spark, d):
    """Reference points by cell of ten pixels."""
    return corners(spark, d).groupBy((F.col("x") / 10).cast("long").alias("px"), (F.col("y") / 10).cast("long").alias("py")).agg(F.count(F.lit(1)).alias("n"))


@query("agg11_condition_counts", f"WITH {OBS}, {COND} SELECT condition_id, layout, count(DISTINCT plate) AS n_plates, count(*) AS n_rows FROM obs JOIN cond ON condition_id = plate % 8 GROUP BY condition_id, layout")
def agg11(spark, d):
    """Plates and rows of each condition."""
    p = observations(spark, d).groupBy("plate").agg(F.count(F.lit(1)).alias("n")).withColumn("condition_id", condition_of(F.col("plate")))
    j = p.join(F.broadcast(conditions(spark).select("condition_id", "layout")), "condition_id")
    return j.groupBy("condition_id", "layout").agg(F.count(F.lit(1)).alias("n_plates"), F.sum("n").alias("n_rows"))


@query(
    "fil02_few_overlaps",
    f"""WITH {OBS}, {BOUNDARY}, fu AS (SELECT *, max(high) OVER (PARTITION BY plate, "by" ORDER BY low, high, region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM ln),
ov AS (SELECT plate, count(*) FILTER (furthest > low) / count(*) AS share FROM fu GROUP BY plate), p AS (SELECT plate, max(t) - min(t) AS video_us FROM obs GROUP BY plate)
SELECT p.plate, video_us FROM p WHERE CAST(p.plate % 10 AS INTEGER) NOT IN (SELECT plate FROM ov WHERE share > 0.26) AND video_us >= {20 * 86_400_000_000}""",
)
def fil02_overlaps(spark, d):
    """Plates of long recordings, without those on whose lines more than 26 in a hundred region extents overlap."""
    found = lines(spark, d)
    n = found.groupBy("plate").agg(F.count(F.lit(1)).alias("n"))
    bad = sp.line_overlaps(found).join(n, "plate").where(F.col("n_overlaps") / F.col("n") > 0.26).select(F.col("plate").alias("frame"))
    p = observations(spark, d).groupBy("plate").agg((F.max("t") - F.min("t")).alias("video_us")).where(F.col("video_us") >= 20 * 86_400_000_000)
    return p.withColumn("frame", (F.col("plate") % 10).cast("int")).join(bad, "frame", "left_anti").select("plate", "video_us")
