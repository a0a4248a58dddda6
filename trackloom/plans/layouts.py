"""Queries on ideal layouts, shapes and plates of controls, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.config import CONDITIONS, PATCHES
from trackloom.operators import events as ev
from trackloom.operators import layouts as lay
from trackloom.operators import raster as ra
from trackloom.operators import space as sp
from trackloom.plans.catalog import CENSORED, DAY, OBS, T0, VISITS, query
from trackloom.plans.reports import CHOICE, SUMS, _values
from trackloom.plans.space import BOUNDARY, CORNERS, PIX, REG, SIGNED, _spline, corners, lines, placed, regions
from trackloom.plans.streams import MARK
from trackloom.sources.tables import condition_of, observations, table
from trackloom.streaming import visits as st

#: Parameters of the ideal layouts: pixels between neighbours, size of the frame, radii of a region and of the arena.
SPACING = {"close": 90.0, "med": 140.0, "far": 250.0, "superfar": 400.0, "cluster": 70.0}
FRAME, RADIUS, ARENA = 1847, 42.114, 698.0

GRID = f"""gp(layout, n, side, s) AS (VALUES {", ".join(f"('{k}', {n}, {math.isqrt(n - 1) + 1}, {SPACING[k]!r}::DOUBLE)" for k, n in PATCHES.items())}),
gr AS (SELECT layout, region, (region % side + ((region // side) % 2) / 2) * s AS x, (region // side) * s * {math.sqrt(3) / 2!r}::DOUBLE AS y FROM (SELECT *, unnest(range(0, n)) AS region FROM gp)),
gf AS (SELECT layout, region, {FRAME / 2} - (x - avg(x) OVER (PARTITION BY layout)) AS cx, {FRAME / 2} + (y - avg(y) OVER (PARTITION BY layout)) * CASE layout WHEN 'superfar' THEN -1 ELSE 1 END AS cy FROM gr)"""


def grid(spark):
    return lay.triangular_grid(spark, PATCHES, SPACING)


#: The layout of a plate, and all plates that have rows.
LAYOUT_OF = "['close', 'med', 'far', 'superfar', 'cluster']"
PLATES = f"pt AS (SELECT DISTINCT user_id AS plate, {LAYOUT_OF}[user_id % 5 + 1] AS layout FROM events)"


def layout_of(plate):
    return F.get(F.array(*[F.lit(x) for x in ("close", "med", "far", "superfar", "cluster")]), (plate % 5).cast("int"))


def on_plates(spark, d, points):
    """``points`` of a layout for each plate of that layout."""
    plates = table(spark, d, "events").select(F.col("user_id").alias("plate")).distinct().withColumn("layout", layout_of(F.col("plate")))
    return plates.join(F.broadcast(points), "layout")  # as many points as the layouts have regions


@query("geo21_triangular_grid", f"WITH {GRID}, {PLATES} SELECT plate, layout, CAST(region AS INTEGER) AS region, round(x, 6) AS x, round(y, 6) AS y FROM gr JOIN pt USING (layout)")
def geo21(spark, d):
    """Grid points of each plate's layout."""
    return on_plates(spark, d, grid(spark)).select("plate", "layout", "region", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_C, _S = math.cos(math.radians(40)), math.sin(math.radians(40))


@query("geo22_rotated", f"WITH {PIX} SELECT who, ord, round(px * {_C!r}::DOUBLE - py * {_S!r}::DOUBLE, 6) AS x, round(px * {_S!r}::DOUBLE + py * {_C!r}::DOUBLE, 6) AS y FROM oq")
def geo22(spark, d):
    """Positions turned by 40 degrees about the origin."""
    x, y = lay.rotated(F.col("px"), F.col("py"), 40)
    return placed(spark, d).select("who", "ord", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("geo13_ideal_centres", f"WITH {GRID}, {PLATES} SELECT plate, layout, CAST(region AS INTEGER) AS region, round(cx, 6) AS cx, round(cy, 6) AS cy FROM gf JOIN pt USING (layout)")
def geo13(spark, d):
    """Centres of each plate's ideal regions in pixels of the frame."""
    at = on_plates(spark, d, lay.in_frame(grid(spark), FRAME))
    return at.select("plate", "layout", "region", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(
    "geo26_layout_check",
    f"""WITH {REG}, {GRID}, nd AS (SELECT a.plate, a.region, min((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d2 FROM rg a JOIN rg b ON a.plate = b.plate AND a.region <> b.region GROUP BY a.plate, a.region),
id AS (SELECT a.layout, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS want FROM gr a JOIN gr b ON a.layout = b.layout AND a.region <> b.region GROUP BY a.layout)
SELECT plate, layout, count(*) AS n, round(avg(sqrt(d2)), 6) AS mean, round(min(sqrt(d2)), 6) AS least, any_value(want) AS want, count(*) FILTER (sqrt(d2) < want) AS n_close FROM nd JOIN id ON layout = {LAYOUT_OF}[plate % 5 + 1] GROUP BY plate, layout""",
)
def geo26(spark, d):
    """Distances to the nearest other region on each plate, against the least distance of the plate's ideal layout."""

    def nearest(points):
        at = points.select("plate", "region", F.col("cx").alias("low"), (F.col("cx") + 1).alias("high"), F.col("cy").alias("by"))
        own = points.select("plate", F.col("region").alias("src"), F.col("cx").alias("px"), F.col("cy").alias("py"))
        return sp.nearest(own, at, ["region"], F.col("src") != F.col("_t_region")).select("plate", F.sqrt("d2").alias("d"))

    want = nearest(grid(spark).select(F.col("layout").alias("plate"), "region", F.col("x").alias("cx"), F.col("y").alias("cy"))).groupBy(F.col("plate").alias("layout")).agg(F.round(F.min("d"), 6).alias("want"))
    near = nearest(regions(spark, d).select("plate", "region", "cx", "cy")).withColumn("layout", layout_of(F.col("plate"))).join(F.broadcast(want), "layout")
    return near.groupBy("plate", "layout").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.min("d"), 6).alias("least"), F.first("want").alias("want"), F.count_if(F.col("d") < F.col("want")).alias("n_close")
    )


@query(
    "geo27_mixed_density",
    f"WITH {GRID}, {PLATES} SELECT plate, CAST(region AS INTEGER) AS region, CASE WHEN plate % 2 = 0 THEN '0.2' ELSE '1.25' END AS base, CASE WHEN (region + region // side) % 2 = 1 THEN '0.5' WHEN plate % 2 = 0 THEN '0.2' ELSE '1.25' END AS density FROM gr JOIN gp USING (layout) JOIN pt USING (layout) WHERE layout = 'med'",
)
def geo27(spark, d):
    """Densities on plates of the mixed layout: every other region, like a chessboard, has the second one."""
    side = math.isqrt(PATCHES["med"] - 1) + 1
    g = on_plates(spark, d, grid(spark).where("layout = 'med'")).withColumn("base", F.when(F.col("plate") % 2 == 0, F.lit("0.2")).otherwise(F.lit("1.25")))
    mask = (F.col("region") + F.floor(F.col("region") / side)) % 2 == 1
    return g.select("plate", "region", "base", F.when(mask, F.lit("0.5")).otherwise(F.col("base")).alias("density"))


SEEN = f"""{PIX}, {GRID}, sn AS (SELECT DISTINCT {LAYOUT_OF}[who % 5 + 1] AS layout, least(greatest(px * 2 + 900, 0), {FRAME - 1}) AS px, least(greatest(py * 4 + 900, 0), {FRAME - 1}) AS py FROM oq)"""


def seen(spark, d):
    """Distinct visited pixels, brought into the frame, with an ideal layout by plate."""
    names = F.array(*[F.lit(x) for x in ("close", "med", "far", "superfar", "cluster")])
    return placed(spark, d).select(
        F.get(names, (F.col("who") % 5).cast("int")).alias("layout"), lay.clamped(F.col("px") * 2 + 900, FRAME).alias("px"), lay.clamped(F.col("py") * 4 + 900, FRAME).alias("py")
    ).distinct()


@query(
    "geo19_ideal_raster",
    f"""WITH {SEEN}, ds AS (SELECT sn.layout, px, py, region, (px - cx) * (px - cx) + (py - cy) * (py - cy) AS d2 FROM sn JOIN gf ON gf.layout = sn.layout),
ne AS (SELECT *, row_number() OVER (PARTITION BY layout, px, py ORDER BY d2, region) AS k FROM ds)
SELECT layout, px, py, CAST(CASE WHEN sqrt((px - {FRAME / 2}) * (px - {FRAME / 2}) + (py - {FRAME / 2}) * (py - {FRAME / 2})) > {ARENA} THEN -2 WHEN d2 <= {RADIUS}::DOUBLE * {RADIUS}::DOUBLE THEN region ELSE -1 END AS INTEGER) AS region FROM ne WHERE k = 1""",
)
def geo19(spark, d):
    """Visited pixels, cut to the frame (the lookup's clamp), among the discs of the ideal layout."""
    return lay.disc_regions(seen(spark, d), lay.in_frame(grid(spark), FRAME), RADIUS, FRAME / 2, ARENA)


NEAR = f"""{PIX}, {REG}, {GRID}, dp AS (SELECT DISTINCT plate, px, py FROM oq),
nr AS (SELECT dp.plate, px, py, region, px - cx AS dx, py - cy AS dy, row_number() OVER (PARTITION BY dp.plate, px, py ORDER BY (px - cx) * (px - cx) + (py - cy) * (py - cy), region) AS k FROM dp JOIN rg ON rg.plate = dp.plate),
wp AS (SELECT plate, px, py, layout, CAST(least(greatest(round_even(gf.cx + sqrt(dx * dx + dy * dy) * cos(atan2(dy, dx)), 0), 0), {FRAME - 1}) AS BIGINT) AS wx, CAST(least(greatest(round_even(gf.cy + sqrt(dx * dx + dy * dy) * sin(atan2(dy, dx)), 0), 0), {FRAME - 1}) AS BIGINT) AS wy
  FROM (SELECT *, {LAYOUT_OF}[plate % 5 + 1] AS layout FROM nr WHERE k = 1) n JOIN gp USING (layout) JOIN gf USING (layout) WHERE gf.region = n.region % gp.n)"""


def warp(spark, d):
    near = sp.nearest_region(placed(spark, d).select("plate", "px", "py").distinct(), regions(spark, d).select("plate", "region", "cx", "cy"))
    names, counts = F.array(*map(F.lit, PATCHES)), F.array(*map(F.lit, PATCHES.values()))
    i = (F.col("plate") % 5).cast("int")
    near = near.withColumn("layout", F.get(names, i)).withColumn("region", (F.col("region") % F.get(counts, i)).cast("int"))
    return lay.warped(near, lay.in_frame(grid(spark), FRAME), FRAME)


@query("geo12_warped_pixels", f"WITH {NEAR} SELECT plate, px, py, layout, wx, wy FROM wp")
def geo12(spark, d):
    """Visited pixels in the ideal layout, by their nearest region, distance and angle."""
    return warp(spark, d).select("plate", "px", "py", "layout", "wx", "wy")


@query("agg08_warped_heatmap", f"WITH {NEAR}, n AS (SELECT plate, px, py, count(*) AS n FROM oq GROUP BY plate, px, py) SELECT layout, wx // 10 AS wx, wy // 10 AS wy, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT wp.plate) AS n_plates FROM wp JOIN n ON n.plate = wp.plate AND n.px = wp.px AND n.py = wp.py GROUP BY 1, 2, 3")
def agg08(spark, d):
    """Rows by cell of ten pixels of the ideal layout."""
    n = placed(spark, d).groupBy("plate", "px", "py").agg(F.count(F.lit(1)).alias("n"))
    w = warp(spark, d).join(n, ["plate", "px", "py"])
    return w.groupBy("layout", F.floor(F.col("wx") / 10).alias("wx"), F.floor(F.col("wy") / 10).alias("wy")).agg(F.sum("n").alias("n"), F.count_distinct("plate").alias("n_plates"))


EDGES4 = [(0, 1), (1, 3), (3, 2), (2, 0)]
CO = CORNERS.split(",\ncq")[0]


@query(
    "geo15_reference_edges",
    f"""WITH {CO}, ed AS (SELECT a.plate, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS len FROM co a JOIN co b ON a.plate = b.plate AND (a.k, b.k) IN ({", ".join(map(str, EDGES4))})),
me AS (SELECT plate % 8 AS g, avg(len) AS e FROM ed GROUP BY 1), mp AS (SELECT plate % 8 AS g, avg(x) AS mx, avg(y) AS my FROM co GROUP BY 1)
SELECT CAST(me.g AS INTEGER) AS condition_id, round(e, 6) AS mean_edge, round(mx, 6) AS mean_x, round(my, 6) AS mean_y FROM me JOIN mp USING (g)""",
)
def geo15(spark, d):
    """Mean length of the square's edges and mean position of its points, by condition."""
    p = corners(spark, d).groupBy("plate").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    length = sum((F.hypot(F.col("p")[a]["x"] - F.col("p")[b]["x"], F.col("p")[a]["y"] - F.col("p")[b]["y"]) for a, b in EDGES4), F.lit(0.0)) / 4
    mean = lambda c: sum((F.col("p")[i][c] for i in range(4)), F.lit(0.0)) / 4
    own = p.select(condition_of(F.col("plate")).alias("condition_id"), length.alias("e"), mean("x").alias("mx"), mean("y").alias("my"))
    return own.groupBy("condition_id").agg(F.round(F.avg("e"), 6).alias("mean_edge"), F.round(F.avg("mx"), 6).alias("mean_x"), F.round(F.avg("my"), 6).alias("mean_y"))


@query(
    "geo18_best_rotation",
    f"""WITH {CO}, ce AS (SELECT plate, k, x - avg(x) OVER (PARTITION BY plate) AS x, y - avg(y) OVER (PARTITION BY plate) AS y FROM co),
tk AS (SELECT unnest([0, 1, 2, 3]) AS k), pm AS (SELECT a.k AS p0, b.k AS p1, c.k AS p2, d.k AS p3 FROM tk a, tk b, tk c, tk d WHERE len(list_distinct([a.k, b.k, c.k, d.k])) = 4),
mt AS (SELECT plate, p0, p1, p2, x, y, (CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END) AS q FROM ce, pm),
sm AS (SELECT plate, p0, p1, p2, sum(x * (q % 2 * 1000 - 500) + y * (q // 2 * 1000 - 500)) AS along, sum(x * (q // 2 * 1000 - 500) - y * (q % 2 * 1000 - 500)) AS across, sum(x * x + y * y) AS own FROM mt GROUP BY ALL),
rs AS (SELECT plate, degrees(atan2(across, along)) AS deg, sqrt(greatest(own + 2000000 - 2 * sqrt(along * along + across * across), 0) / 4) AS rms FROM sm),
rk AS (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY round(rms, 5), round(abs(deg), 5), deg) AS r FROM rs)
SELECT plate, round(deg, 6) AS deg, round(rms, 6) AS rms FROM rk WHERE r = 1""",
)
def geo18(spark, d):
    """The turn about their middle that brings four points nearest to a square, in least squares over all matchings."""
    p = corners(spark, d).groupBy("plate").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    points = [(F.col("p")[i]["x"], F.col("p")[i]["y"]) for i in range(4)]
    square = [(i % 2 * 1000 - 500, i // 2 * 1000 - 500) for i in range(4)]
    best = sp.best_turn(points, square)
    return p.select("plate", best.alias("b")).select("plate", F.round("b.deg", 6).alias("deg"), F.round("b.rms", 6).alias("rms"))


@query(
    "geo08_arena",
    f"""WITH {CO}, di AS (SELECT plate, (sqrt(pow(max(x) FILTER (k = 3) - max(x) FILTER (k = 0), 2) + pow(max(y) FILTER (k = 3) - max(y) FILTER (k = 0), 2)) + sqrt(pow(max(x) FILTER (k = 2) - max(x) FILTER (k = 1), 2) + pow(max(y) FILTER (k = 2) - max(y) FILTER (k = 1), 2))) / 4 AS r, avg(x) AS mx, avg(y) AS my FROM co GROUP BY plate)
SELECT co.plate, k, round(r, 6) AS radius, sqrt(pow(x - mx, 2) + pow(y - my, 2)) <= r AS inside FROM co JOIN di USING (plate)""",
)
def geo08(spark, d):
    """The arena is the circle about the points' middle whose diameter is their mean diagonal; which points it holds."""
    p = corners(spark, d).groupBy("plate").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    far = lambda a, b: F.hypot(F.col("p")[a]["x"] - F.col("p")[b]["x"], F.col("p")[a]["y"] - F.col("p")[b]["y"])
    mean = lambda c: sum((F.col("p")[i][c] for i in range(4)), F.lit(0.0)) / 4
    q = p.select("plate", ((far(3, 0) + far(2, 1)) / 4).alias("r"), mean("x").alias("mx"), mean("y").alias("my"), F.explode("p").alias("q"))
    return q.select("plate", F.col("q.k").alias("k"), F.round("r", 6).alias("radius"), (F.hypot(F.col("q.x") - F.col("mx"), F.col("q.y") - F.col("my")) <= F.col("r")).alias("inside"))


@query(
    "geo02_inside_nearest",
    f"""WITH {PIX}, {REG}, dp AS (SELECT DISTINCT plate, px, py FROM oq), nr AS (SELECT dp.plate, px, py, region, coefs, px - cx AS dx, py - cy AS dy, row_number() OVER (PARTITION BY dp.plate, px, py ORDER BY (px - cx) * (px - cx) + (py - cy) * (py - cy), region) AS k FROM dp JOIN rg ON rg.plate = dp.plate),
na AS (SELECT *, atan2(dy, dx) AS angle FROM nr WHERE k = 1) SELECT plate, px, py, region, sqrt(dx * dx + dy * dy) < {_spline("angle")} AS inside FROM na""",
)
def geo02(spark, d):
    """Whether a visited pixel lies within the boundary of its nearest region, by angle and radius."""
    r = regions(spark, d)
    near = sp.nearest_region(placed(spark, d).select("plate", "px", "py").distinct(), r.select("plate", "region", "cx", "cy"))
    both = near.join(r.select("plate", "region", "breaks", "coefs"), ["plate", "region"])
    return both.select("plate", "px", "py", "region", (F.col("distance") < sp.spline(F.col("angle"), F.col("breaks"), F.col("coefs"))).alias("inside"))


@query(
    "geo10_region_distance",
    f"""WITH {PIX}, {BOUNDARY}, rk AS (SELECT plate, region, row_number() OVER (PARTITION BY plate ORDER BY region) - 1 AS code FROM rg), pd AS (SELECT DISTINCT oq.plate, o.region AS code, px, py FROM oq JOIN obs o ON o.plate = oq.who AND o.ord = oq.ord WHERE o.region >= 0)
SELECT pd.plate, CAST(code AS INTEGER) AS code, px, py, round(sqrt(min(greatest(low - px, px - (high - 1), 0) * greatest(low - px, px - (high - 1), 0) + ("by" - py) * ("by" - py))::DOUBLE), 6) AS distance
FROM pd JOIN rk USING (plate, code) JOIN ln ON ln.plate = pd.plate AND ln.region = rk.region GROUP BY pd.plate, code, px, py""",
)
def geo10(spark, d):
    """Distance of pixels to one region, that which the row stands for; 0 inside of it."""
    o = observations(spark, d).where("region >= 0").select(F.col("plate").alias("who"), "ord", F.col("region").alias("code"))
    keyed = lambda plate, code: (plate.cast("long") * 1000 + code).alias("plate")
    points = placed(spark, d).join(o, ["who", "ord"]).select(keyed(F.col("plate"), F.col("code")), "px", "py").distinct()
    rank = regions(spark, d).select("plate", "region").withColumn("code", F.row_number().over(Window.partitionBy("plate").orderBy("region")) - 1).where("code < 1000")
    targets = lines(spark, d).join(rank, ["plate", "region"]).select(keyed(F.col("plate"), F.col("code")), "low", "high", "by")
    near = sp.nearest(points, targets, [])
    return near.select(F.floor(F.col("plate") / 1000).cast("int").alias("plate"), (F.col("plate") % 1000).cast("int").alias("code"), "px", "py", F.round(F.sqrt("d2"), 6).alias("distance"))


RINGS = [-50, -10, 0, 10, 50, 200, 1000]


@query(
    "agg09_distance_profile",
    f"""WITH {PIX}, {BOUNDARY}, dp AS (SELECT DISTINCT plate, px, py FROM oq), {SIGNED}, n AS (SELECT plate, px, py, count(*) AS n FROM oq GROUP BY plate, px, py)
SELECT sg.plate, CAST(len(list_filter({RINGS}, lambda e: e < distance)) AS BIGINT) AS ring, count(*) AS n_pixels, CAST(sum(n) AS BIGINT) AS n_frames, CAST(sum(n) AS BIGINT) / count(*) AS frames_per_pixel FROM sg JOIN n ON n.plate = sg.plate AND n.px = sg.px AND n.py = sg.py GROUP BY 1, 2""",
)
def agg09(spark, d):
    """Frames by signed distance to the edge of regions: all, and for a pixel that was visited."""
    at = placed(spark, d)
    n = at.groupBy("plate", "px", "py").agg(F.count(F.lit(1)).alias("n"))
    far = sp.region_distance(n.select("plate", "px", "py"), lines(spark, d)).join(n, ["plate", "px", "py"])
    ring = F.size(F.filter(F.array(*map(F.lit, RINGS)), lambda e: e < F.col("distance"))).cast("long")
    return far.groupBy("plate", ring.alias("ring")).agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("n").alias("n_frames"), (F.sum("n") / F.count(F.lit(1))).alias("frames_per_pixel"))


CELL = 8
#: Extents of regions in cells of eight pixels, and all cells of their plates.
CELLS = f"""{BOUNDARY.replace("ln AS (", "fine AS (")},
ln AS (SELECT DISTINCT plate, CAST(floor("by" / {CELL}.0) AS BIGINT) AS "by", CAST(floor(low / {CELL}.0) AS BIGINT) AS low, CAST(floor((high - 1) / {CELL}.0) AS BIGINT) + 1 AS high FROM fine),
dp AS (SELECT plate, px, unnest(range(y0 - 1, y1 + 2)) AS py FROM (SELECT plate, y0, y1, unnest(range(x0 - 1, x1 + 1)) AS px FROM (SELECT plate, min(low) AS x0, max(high) AS x1, min("by") AS y0, max("by") AS y1 FROM ln GROUP BY plate))), {SIGNED}"""


def cell_distances(spark, d):
    return ra.distance_raster(ra.coarse_lines(lines(spark, d), CELL))


@query("geo09_whole_raster", f"WITH {CELLS} SELECT plate, px, py, distance FROM sg")
def geo09_whole(spark, d):
    """Signed distance of every cell of a plate, visited or not, to the edge of its regions."""
    return cell_distances(spark, d)


@query(
    "agg09_time_per_pixel",
    f"""WITH {PIX}, {CELLS}, n AS (SELECT plate, CAST(floor(px / {CELL}.0) AS BIGINT) AS px, CAST(floor(py / {CELL}.0) AS BIGINT) AS py, count(*) AS n FROM oq GROUP BY 1, 2, 3)
SELECT plate, CAST(len(list_filter([-4, -1, 0, 1, 4, 16], lambda e: e < distance)) AS BIGINT) AS ring, count(*) AS n_pixels, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_frames, coalesce(sum(n), 0) / count(*) AS frames_per_pixel FROM sg LEFT JOIN n USING (plate, px, py) GROUP BY 1, 2""",
)
def agg09_time(spark, d):
    """Frames for each cell at a distance to the edge of regions, over all cells."""
    at = lambda c: F.floor(F.col(c) / CELL).cast("long").alias(c)
    return ra.time_per_pixel(placed(spark, d).select("plate", at("px"), at("py")), cell_distances(spark, d), [-4, -1, 0, 1, 4, 16])


RASTER = f"""{PIX}, {BOUNDARY}, pxl AS (SELECT plate, region, "by" AS py, unnest(range(low, high)) AS px FROM ln), w AS (SELECT plate, px, py, max(region) AS region FROM pxl GROUP BY plate, px, py)"""


@query("fil12_inside_rows", f"WITH {RASTER} SELECT who, ord, w.region FROM oq JOIN w ON w.plate = oq.plate AND w.px = oq.px AND w.py = oq.py")
def fil12(spark, d):
    """Rows whose pixel lies in a region."""
    at = placed(spark, d)
    return at.join(sp.raster_regions(at.select("plate", "px", "py").distinct(), lines(spark, d)), ["plate", "px", "py"]).select("who", "ord", "region")


@query("geo20_clamped_lookup", f"WITH {RASTER}, q AS (SELECT who, ord, plate, least(greatest(px, -20), 20) AS px, least(greatest(py, -20), 20) AS py FROM oq) SELECT who, ord, coalesce(w.region, -1) AS region FROM q LEFT JOIN w ON w.plate = q.plate AND w.px = q.px AND w.py = q.py")
def geo20(spark, d):
    """Regions of pixels cut to a small frame."""
    cut = lambda c: F.least(F.greatest(F.col(c), F.lit(-20)), F.lit(20)).alias(c)
    at = placed(spark, d).select("who", "ord", "plate", cut("px"), cut("py"))
    hit = at.join(sp.raster_regions(at.select("plate", "px", "py").distinct(), lines(spark, d)), ["plate", "px", "py"], "left")
    return hit.select("who", "ord", F.coalesce("region", F.lit(-1).cast("long")).alias("region"))


#: Silhouettes: a row's pixels, as many and as far apart as its numbers say; every fifth row has none. In SQL, offsets of pixels by place.
OFFSETS = "(i * (1 + y % 7)) % 11 AS dx, (i * (2 + ord % 5)) % 13 AS dy"
SHAPES = f"""{RASTER}, sh AS (SELECT who, ord, plate, px, py, (py + 200) // 4 AS y FROM oq WHERE ord % 5 <> 0),
si AS (SELECT who, ord, plate, px + dx AS px, py + dy AS py, min(i) AS i FROM (SELECT *, {OFFSETS} FROM (SELECT *, unnest(range(0, 3 + y % 15)) AS i FROM sh)) GROUP BY 1, 2, 3, 4, 5),
sp AS (SELECT who, ord, plate, 5 + i AS pos, px, py FROM si UNION ALL
  SELECT who, ord, plate, pos, CASE WHEN pos <= 2 THEN x0 ELSE x1 END, CASE WHEN pos % 2 = 1 THEN y0 ELSE y1 END FROM (SELECT who, ord, plate, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM si GROUP BY 1, 2, 3), (SELECT unnest([1, 2, 3, 4]) AS pos)),
fo AS (SELECT who, ord, list(coalesce(w.region, -1) ORDER BY pos) AS fd FROM sp LEFT JOIN w ON w.plate = sp.plate AND w.px = sp.px AND w.py = sp.py GROUP BY who, ord),
fc AS (SELECT who, ord, fd[5:] AS own, list_filter(fd[1:4], lambda r: r >= 0) AS co, list_filter(fd[5:], lambda r: r >= 0) AS ins FROM fo)"""
SIZES = f"""{OBS}, sz AS (SELECT plate, ord, t, count(*) AS size FROM (SELECT DISTINCT plate, ord, t, dx, dy FROM (SELECT plate, ord, t, {OFFSETS} FROM (SELECT *, unnest(range(0, 3 + y % 15)) AS i FROM obs WHERE ord % 5 <> 0))) GROUP BY plate, ord, t)"""


def silhouette(px, py, y, order):
    """Distinct pixels of a row's shape, in order, about its position."""
    shift = lambda i: F.struct((px + (i * (1 + y % 7)) % 11).cast("long").alias("px"), (py + (i * (2 + order % 5)) % 13).cast("long").alias("py"))
    pixels = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), 2 + y % 15), shift))
    return F.when(order % 5 == 0, F.array().cast("array<struct<px:bigint,py:bigint>>")).otherwise(pixels)


def shapes(spark, d):
    """The silhouette of each row: 3 to 17 pixels, or none."""
    y = ((F.col("py") + 200) / 4).cast("long")
    return placed(spark, d).select("who", "ord", "plate", silhouette(F.col("px"), F.col("py"), y, F.col("ord")).alias("pixels"))


def sizes(spark, d):
    """Rows with a silhouette, and how many pixels it has."""
    o = observations(spark, d).withColumn("size", F.size(silhouette(F.lit(0), F.lit(0), F.col("y"), F.col("ord"))).cast("long"))
    return o.where("size > 0")


@query("trj06_shape_regions", f"WITH {SHAPES} SELECT oq.who, oq.ord, CAST(coalesce(CASE WHEN len(co) >= 2 THEN co[2] WHEN len(co) = 1 THEN coalesce(ins[1], -1) END, -1) AS BIGINT) AS region FROM oq LEFT JOIN fc USING (who, ord)")
def trj06(spark, d):
    """Region of each row by its shape: corners of its box first, then its pixels."""
    s = shapes(spark, d)
    hit = s.select("who", "ord").join(lay.looked_up(s, lines(spark, d), ["who", "ord"]), ["who", "ord"], "left")
    return hit.select("who", "ord", F.coalesce(lay.shape_region(F.col("found")), F.lit(-1).cast("long")).alias("region"))


@query("trj07_pixels_inside", f"WITH {SHAPES} SELECT who, ord, CAST(CASE WHEN len(co) = 4 THEN len(own) ELSE len(ins) END AS BIGINT) AS n_inside FROM fc")
def trj07(spark, d):
    """Pixels of each shape that lie inside."""
    return lay.looked_up(shapes(spark, d), lines(spark, d), ["who", "ord"]).select("who", "ord", lay.pixels_inside(F.col("found")).alias("n_inside"))


@query("trj08_silhouette_pixels", f"WITH {SHAPES} SELECT si.who, si.ord, si.px, si.py, coalesce(w.region, -1) AS region FROM si LEFT JOIN w ON w.plate = si.plate AND w.px = si.px AND w.py = si.py")
def trj08_silhouettes(spark, d):
    """A row for each pixel of a row's silhouette, with the region that it lies in."""
    at = shapes(spark, d).select("who", "ord", "plate", F.explode("pixels").alias("p")).select("who", "ord", "plate", "p.px", "p.py")
    hit = at.join(sp.raster_regions(at.select("plate", "px", "py").distinct(), lines(spark, d)), ["plate", "px", "py"], "left")
    return hit.select("who", "ord", "px", "py", F.coalesce("region", F.lit(-1).cast("long")).alias("region"))


CONTROL = "[" + ", ".join(f"'{x}'" for x in CONDITIONS["0"]) + "]"
REPLICAS = f"""{OBS}, rp AS (SELECT plate AS parent, plate * 10 + i AS replica, {CONTROL}[i + 1] AS layout, [{", ".join(map(str, CONDITIONS["0"].values()))}][i + 1] AS condition_id FROM (SELECT DISTINCT plate FROM obs WHERE plate % 8 = 0), (SELECT unnest(range(0, {len(CONDITIONS["0"])})) AS i))"""


def replicas(spark, d):
    """Each control plate once for every layout, under a condition without density; the layouts are five literals, so nothing is crossed."""
    kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("layout"), F.lit(c).alias("condition_id")) for i, (n, c) in enumerate(CONDITIONS["0"].items())])
    p = observations(spark, d).where("plate % 8 = 0").select(F.col("plate").alias("parent")).distinct()
    return p.select("parent", F.explode(kinds).alias("k")).select("parent", (F.col("parent") * 10 + F.col("k.i")).alias("replica"), "k.layout", "k.condition_id")


@query("src14_control_replicas", f"WITH {REPLICAS} SELECT parent, replica, layout, CAST(condition_id AS INTEGER) AS condition_id FROM rp")
def src14(spark, d):
    return replicas(spark, d)


@query("src08_rows_of_parents", f"WITH {REPLICAS}, n AS (SELECT plate, count(*) AS n_rows, max(t) AS last_t FROM obs GROUP BY plate) SELECT replica, parent, n_rows, last_t FROM rp JOIN n ON n.plate = parent")
def src08(spark, d):
    """A replica's rows are those of its parent plate, found by its number."""
    n = observations(spark, d).groupBy(F.col("plate").alias("parent")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("t").alias("last_t"))
    return replicas(spark, d).join(n, "parent").select("replica", "parent", "n_rows", "last_t")


@query("jon10_controls_by_layout", f"WITH {REPLICAS}, {GRID} SELECT replica, layout, CAST(region AS INTEGER) AS region, round(cx, 6) AS cx, round(cy, 6) AS cy FROM rp JOIN gf USING (layout)")
def jon10(spark, d):
    """Regions of each replica: those of its layout."""
    g = lay.in_frame(grid(spark), FRAME)
    return replicas(spark, d).join(F.broadcast(g), "layout").select("replica", "layout", "region", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(
    "evt11_weighted_speeds",
    f"""WITH {OBS}, ws AS (SELECT plate, track, region >= 0 AS ins, CAST(floor(sqrt(CAST((x - lag(x) OVER w) * (x - lag(x) OVER w) + 10000 * (y - lag(y) OVER w) * (y - lag(y) OVER w) AS DOUBLE)) * 10 + 0.5) AS BIGINT) AS dd, t - lag(t) OVER w AS dt FROM obs WINDOW w AS (PARTITION BY plate, track ORDER BY ord)),
tr AS (SELECT plate, track, CAST(sum(dd) FILTER (ins) AS DOUBLE) / nullif(sum(dt) FILTER (ins), 0) AS vi, sum(dt) FILTER (ins) AS wi, CAST(sum(dd) FILTER (NOT ins) AS DOUBLE) / nullif(sum(dt) FILTER (NOT ins), 0) AS vo, sum(dt) FILTER (NOT ins) AS wo FROM ws GROUP BY plate, track),
pl AS (SELECT plate, sum(vi * wi) / nullif(sum(wi), 0) AS vi, sum(vo * wo) / nullif(sum(wo), 0) AS vo, count(*) - 1 AS n_holes FROM tr GROUP BY plate), fr AS (SELECT plate, count(*) / count(DISTINCT t // 60000000) - 1 AS double_share, max(t) - min(t) AS video_us FROM obs GROUP BY plate)
SELECT plate, round(vi, 12) AS speed_in, round(vo, 12) AS speed_out, n_holes, double_share, video_us FROM pl JOIN fr USING (plate)""",
)
def evt11(spark, d):
    """Speeds of tracks weighted by their time, tracking holes, share of frames (minutes here) that come twice, length of the recording."""
    o = observations(spark, d)
    order = Window.partitionBy("plate", "track").orderBy("ord")
    dx, dy = F.col("x") - F.lag("x").over(order), (F.col("y") - F.lag("y").over(order)) * 100
    s = o.withColumns({"dd": F.floor(F.sqrt((dx * dx + dy * dy).cast("double")) * 10 + 0.5).cast("long"), "dt": F.col("t") - F.lag("t").over(order), "ins": F.col("region") >= 0})
    side = lambda flag, c: F.sum(F.when(flag, F.col(c)))
    tr = s.groupBy("plate", "track").agg(*[side(F.col("ins") if k == "i" else ~F.col("ins"), c).alias(f"{c}_{k}") for k in "io" for c in ("dd", "dt")])
    for k in "io":
        tr = tr.withColumn(f"v_{k}", F.try_divide(F.col(f"dd_{k}").cast("double"), F.col(f"dt_{k}")))
    mean = lambda k: F.try_divide(F.sum(F.col(f"v_{k}") * F.col(f"dt_{k}")), F.sum(f"dt_{k}"))
    pl = tr.groupBy("plate").agg(F.round(mean("i"), 12).alias("speed_in"), F.round(mean("o"), 12).alias("speed_out"), (F.count(F.lit(1)) - 1).alias("n_holes"))
    fr = o.groupBy("plate").agg((F.count(F.lit(1)) / F.count_distinct(F.floor(F.col("t") / 60_000_000)) - 1).alias("double_share"), (F.max("t") - F.min("t")).alias("video_us"))
    return pl.join(fr, "plate")


@query(
    "agg02_furthest",
    f"""WITH {OBS}, q AS (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM obs WINDOW w AS (PARTITION BY plate ORDER BY ord)), p AS (SELECT plate, max(CAST(floor(sqrt(CAST((x - x0) * (x - x0) + 10000 * (y - y0) * (y - y0) AS DOUBLE)) + 0.5) AS BIGINT)) FILTER (region >= 0) AS far FROM q GROUP BY plate)
SELECT CAST(plate % 8 AS INTEGER) AS condition_id, count(far) AS n_plates, CAST(sum(far) AS BIGINT) / count(far) AS mean_furthest FROM p GROUP BY 1""",
)
def agg02(spark, d):
    """How far from its start a plate's furthest region row lies, mean by condition."""
    w = Window.partitionBy("plate").orderBy("ord")
    dx, dy = F.col("x") - F.first("x").over(w), F.col("y") - F.first("y").over(w)
    q = observations(spark, d).withColumn("far", F.floor(F.sqrt((dx * dx + dy * dy * 10000).cast("double")) + 0.5).cast("long"))
    p = q.groupBy("plate").agg(F.max(F.when(F.col("region") >= 0, F.col("far"))).alias("far"))
    return p.groupBy(condition_of(F.col("plate")).alias("condition_id")).agg(F.count("far").alias("n_plates"), (F.sum("far") / F.count("far")).alias("mean_furthest"))


@query(
    "mod04_optimal_by_condition",
    f"""WITH {VISITS}, n AS (SELECT plate, lead(start_t) OVER (PARTITION BY plate ORDER BY start_t, end_t, region) - end_t AS gap FROM v), tv AS (SELECT CAST(plate % 8 AS INTEGER) AS condition_id, CAST(sum(gap) AS BIGINT) / count(gap) / 3.6e9 AS travel FROM n GROUP BY 1),
ra AS (SELECT condition_id, travel, dur, 100.0::DOUBLE * (1 - exp(-dur / 100.0::DOUBLE)) / (dur + travel) AS rate FROM tv, (SELECT unnest(range(1, 401)) AS dur))
SELECT condition_id, round(any_value(travel), 6) AS travel_h, arg_max(dur, rate) AS best_h, round(max(rate), 9) AS best_rate FROM ra GROUP BY condition_id""",
)
def mod04(spark, d):
    """The best length of a visit for the mean travel of each condition, in hours."""
    order = Window.partitionBy("plate").orderBy("start", "end", "region")
    n = ev.visits(observations(spark, d)).select(condition_of(F.col("plate")).alias("condition_id"), (F.lead("start").over(order) - F.col("end")).alias("gap"))
    tv = n.groupBy("condition_id").agg((F.sum("gap") / F.count("gap") / 3.6e9).alias("travel"))
    g = tv.withColumn("dur", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(400).cast("long"))))
    rate = 100.0 * (1 - F.exp(-F.col("dur") / 100.0)) / (F.col("dur") + F.col("travel"))
    return g.withColumn("rate", rate).groupBy("condition_id").agg(F.round(F.first("travel"), 6).alias("travel_h"), F.max_by("dur", "rate").alias("best_h"), F.round(F.max("rate"), 9).alias("best_rate"))


@query(
    "mod08_experimental_means",
    f"""WITH {CENSORED}, {CHOICE["cut"]}, {SUMS} SELECT CAST(condition_id AS INTEGER) AS condition_id, count(*) AS n_plates, round(avg(visit_us) / 3.6e9, 6) AS in_hours, round(avg(transit_us) / 3.6e9, 6) AS out_hours, round(avg(n_visits), 6) AS visits, round(avg(n_regions), 6) AS regions FROM pm GROUP BY 1""",
)
def mod08(spark, d):
    """What walks are compared with: time in and out, visits and regions of cut recordings, by condition."""
    v = _values(spark, d, "cut")
    hours = lambda c: F.round(F.avg(c) / 3.6e9, 6)
    return v.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n_plates"), hours("visit_us").alias("in_hours"), hours("transit_us").alias("out_hours"), F.round(F.avg("n_visits"), 6).alias("visits"), F.round(F.avg("n_regions"), 6).alias("regions"))


ENDS = [T0 + k * DAY for k in (5, 10, 20, 30)]


@query("trj13_sizes_until", f"WITH {SIZES}, m AS (SELECT plate, e, count(*) AS n, CAST(sum(size) AS BIGINT) AS s FROM sz, (SELECT unnest({ENDS}) AS e) WHERE t <= e GROUP BY plate, e) SELECT plate, e AS end_t, n, round(s / n / (first_value(s / n) OVER (PARTITION BY plate ORDER BY e)), 9) AS relative FROM m")
def trj13(spark, d):
    """Mean size of silhouettes up to several end times over that up to the first: one pass gives sums between ends, which add up."""
    o = sizes(spark, d).select("plate", "size", F.size(F.filter(F.array(*map(F.lit, ENDS)), lambda e: e < F.col("t"))).alias("k")).where(F.col("k") < len(ENDS))
    g = o.groupBy("plate", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    g = g.groupBy("plate").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("n", "s")))).alias("m"))
    up_to = [F.struct(F.lit(e).alias("end_t"), *[sum((F.coalesce(F.col("m")[i][c], F.lit(0)) for i in range(j + 1)), F.lit(0)).cast("long").alias(c) for c in ("n", "s")]) for j, e in enumerate(ENDS)]
    rows = g.select("plate", F.explode(F.array(*up_to)).alias("x")).select("plate", "x.*").where("n > 0").withColumn("mean", F.col("s") / F.col("n"))
    return rows.select("plate", "end_t", "n", F.round(F.try_divide("mean", F.first("mean").over(Window.partitionBy("plate").orderBy("end_t"))), 9).alias("relative"))


@query(
    "fil19_odd_sizes",
    f"""WITH {SIZES}, q AS (SELECT plate, t, size / avg(size) FILTER (ord <= 20) OVER (PARTITION BY plate) AS ratio FROM sz), b AS (SELECT plate, (t - {T0}) // {5 * DAY} AS bin, count(*) FILTER (ratio < 0.5 OR ratio > 1.5) AS n_odd, count(*) AS n FROM q GROUP BY 1, 2)
SELECT plate, bin, CAST(sum(n_odd) OVER w AS BIGINT) AS n_odd, CAST(sum(n) OVER w AS BIGINT) AS n FROM b WINDOW w AS (PARTITION BY plate ORDER BY bin)""",
)
def fil19(spark, d):
    """Silhouettes whose size is far from the mean of the first twenty rows, counted up to the end of each span of five days."""
    ratio = F.try_divide(F.col("size").cast("double"), F.avg(F.when(F.col("ord") <= 20, F.col("size"))).over(Window.partitionBy("plate")))
    b = sizes(spark, d).withColumn("ratio", ratio).groupBy("plate", F.floor((F.col("t") - T0) / (5 * DAY)).alias("bin")).agg(F.count_if((F.col("ratio") < 0.5) | (F.col("ratio") > 1.5)).alias("n_odd"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("plate").orderBy("bin")
    return b.select("plate", "bin", F.sum("n_odd").over(w).alias("n_odd"), F.sum("n").over(w).alias("n"))


@query("srt07_first_seen", f"WITH {OBS}, f AS (SELECT plate, region, min(ord) AS first_ord FROM obs GROUP BY plate, region) SELECT *, row_number() OVER (PARTITION BY plate ORDER BY first_ord) AS nth, row_number() OVER (PARTITION BY plate ORDER BY region) AS nth_sorted FROM f")
def srt07(spark, d):
    """Distinct regions of a plate in order of their first row, and sorted."""
    f = observations(spark, d).groupBy("plate", "region").agg(F.min("ord").alias("first_ord"))
    p = Window.partitionBy("plate")
    return f.withColumns({"nth": F.row_number().over(p.orderBy("first_ord")), "nth_sorted": F.row_number().over(p.orderBy("region"))})


@query(
    "str01_running_totals",
    f"""WITH {OBS}, b AS (SELECT plate, t // {DAY} * {DAY} AS start, count(*) AS n, count(*) FILTER (region >= 0) AS n_inside FROM obs WHERE (t // {DAY} + 1) * {DAY} <= {MARK} GROUP BY 1, 2)
SELECT plate, start, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(n_inside) OVER w AS BIGINT) AS n_inside FROM b WINDOW w AS (PARTITION BY plate ORDER BY start)""",
)
def str01(spark, d):
    """Totals up to each day: the stream gives what each closed day adds, and days add up."""
    days = st.drain(st.window_counts(st.read_events(spark, d), "1 day"), "str01")
    w = Window.partitionBy("plate").orderBy("start")
    return days.select("plate", "start", F.sum("n").over(w).alias("n"), F.sum("n_inside").over(w).alias("n_inside"))
