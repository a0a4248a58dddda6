"""Queries on durations, delays, ranks and curves of visits, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.config import CONFIG
from trackloom.functions.stats import bin_index
from trackloom.operators import curves as cv
from trackloom.operators import events as ev
from trackloom.operators import kinematics as kin
from trackloom.plans.catalog import CENSORED, COND, DAY, FILLED, OBS, RUNS, STEPS, T0, VISITS, query
from trackloom.sources.tables import condition_of, conditions, observations

HOUR = 3_600_000_000
THRESHOLDS = [HOUR, DAY, 2 * DAY, 10 * DAY]
CLOCK_EDGES = [0, 6, 24, 72, 168, 720]
COUNT_EDGES = [0.0, 1.0, 2.0, 4.0, 8.0, 16.0]
SPENT_EDGES = [0.0, 1.0 * DAY, 2.0 * DAY, 4.0 * DAY, 8.0 * DAY]
RADII = [1000, 5000, 10000, 20000]


@query(
    "evt13_thresholds",
    f"""WITH {VISITS}, g AS (SELECT *, abs(start_t - lag(end_t) OVER (PARTITION BY plate, region ORDER BY start_t, end_t)) AS gap FROM v), th AS (SELECT unnest({THRESHOLDS}) AS threshold),
i AS (SELECT plate, region, threshold, start_t, end_t, sum(CASE WHEN gap < threshold THEN 0 ELSE 1 END) OVER (PARTITION BY threshold, plate, region ORDER BY start_t, end_t ROWS UNBOUNDED PRECEDING) AS island FROM g, th),
m AS (SELECT plate, threshold, max(end_t) - min(start_t) AS dur FROM i GROUP BY plate, region, threshold, island)
SELECT plate, threshold, count(*) AS n_visits, CAST(sum(dur) AS BIGINT) AS total_us FROM m GROUP BY plate, threshold""",
)
def evt13(spark, d):
    return cv.threshold_totals(ev.visits(observations(spark, d)), THRESHOLDS)


STAYS = f"""lo AS (SELECT plate, max(start_t) AS last_out FROM r WHERE region < 0 GROUP BY plate),
s0 AS (SELECT *, end_t // {HOUR} - start_t // {HOUR} AS u, row_number() OVER w AS rn, lead(start_t) OVER w AS nx FROM r WHERE region >= 0 WINDOW w AS (PARTITION BY plate, region ORDER BY start_t, end_t)),
s1 AS (SELECT *, CASE WHEN rn > 1 THEN u WHEN u > 0 THEN u + 1 ELSE 0 END AS units FROM s0),
s2 AS (SELECT *, sum(units) OVER (PARTITION BY plate, region ORDER BY start_t, end_t ROWS UNBOUNDED PRECEDING) - units AS begun FROM s1),
pt AS (SELECT plate, units, begun, unnest(range(0, CAST(units AS BIGINT))) AS i FROM s2 LEFT JOIN lo USING (plate) WHERE nx IS NOT NULL OR end_t <= last_out),
pb AS (SELECT plate, units - i AS delay, len(list_filter({CLOCK_EDGES}, lambda e: e <= begun + i)) - 1 AS bin FROM pt WHERE begun + i < {CLOCK_EDGES[-1]}),
db AS (SELECT plate, CAST(bin AS BIGINT) AS bin, count(*) AS n_points, count(*) FILTER (delay = 1) AS n_leaving, CAST(sum(delay) AS BIGINT) AS sum_delay FROM pb GROUP BY plate, bin)"""


@query("evt15_delays", f"WITH {RUNS}, {STAYS} SELECT * FROM db")
def evt15(spark, d):
    return cv.delay_bins(cv.stays(ev.runs(observations(spark, d)), HOUR), CLOCK_EDGES)


@query("sta10_leaving_probability", f"WITH {RUNS}, {STAYS} SELECT bin, count(*) AS n_plates, round(avg(n_leaving / n_points), 9) AS p_leave FROM db GROUP BY bin HAVING count(*) > 3")
def sta10(spark, d):
    return cv.leaving_probability(cv.delay_bins(cv.stays(ev.runs(observations(spark, d)), HOUR), CLOCK_EDGES), 3)


@query(
    "evt18_durations",
    f"WITH {VISITS} SELECT plate, start_t AS start, round_even(CAST((end_t - start_t) AS DOUBLE) / 1000000 * 10000, 0) / 10000 AS plain_s, round_even((CAST((end_t - start_t) AS DOUBLE) / 1000000 + {CONFIG.frame_s}) * 10000, 0) / 10000 AS dur_s FROM v",
)
def evt18(spark, d):
    """Durations in seconds without and with one frame added."""
    long_ = F.col("end") - F.col("start")
    return ev.visits(observations(spark, d)).select("plate", "start", cv.seconds(long_).alias("plain_s"), cv.seconds(long_, CONFIG.frame_s).alias("dur_s"))


@query(
    "evt19_previous_transit",
    f"""WITH {CENSORED}, b AS (SELECT *, lag(s) OVER w AS bs, lag(e) OVER w AS be, lag(region) OVER w AS br, lag(uncensored) OVER w AS bu, row_number() OVER (PARTITION BY plate, region ORDER BY s, e) AS visit_rank FROM c WINDOW w AS (PARTITION BY plate ORDER BY s, e, region))
SELECT plate, region, s AS start2, visit_rank, e - s AS visit_us2, be - bs AS transit_us2 FROM b WHERE region >= 0 AND uncensored AND br < 0 AND be = s AND bu""",
)
def evt19(spark, d):
    return cv.before_visits(ev.censored(ev.filled_events(observations(spark, d))))


@query(
    "evt20_kind_runs",
    f"""WITH {FILLED}, k0 AS (SELECT *, region >= 0 AS vis, CASE WHEN lag(region >= 0) OVER w = (region >= 0) THEN 0 ELSE 1 END AS ch FROM f WINDOW w AS (PARTITION BY plate ORDER BY s, e, region)),
k1 AS (SELECT *, sum(ch) OVER (PARTITION BY plate ORDER BY s, e, region ROWS UNBOUNDED PRECEDING) AS run FROM k0),
k2 AS (SELECT plate, run, bool_or(vis) AS vis, min(s) AS start2, CAST(sum(e - s) AS BIGINT) AS us, count(*) AS n_events FROM k1 GROUP BY plate, run),
k3 AS (SELECT *, lag(us) OVER (PARTITION BY plate ORDER BY run) AS transit_us2 FROM k2)
SELECT plate, start2, us AS visit_us2, transit_us2, n_events FROM k3 WHERE vis AND transit_us2 IS NOT NULL""",
)
def evt20(spark, d):
    return cv.kind_runs(ev.filled_events(observations(spark, d)))


@query(
    "evt21_entry_speed",
    f"""WITH {STEPS}, {VISITS.removeprefix(OBS + ",")}, n AS (SELECT plate, t, arg_min(CAST(dist AS DOUBLE) / CAST(greatest(coalesce(dt, 828170), 1000) AS DOUBLE), ord) AS speed FROM st GROUP BY plate, t)
SELECT v.plate, region, start_t AS start, end_t - start_t AS dur, speed FROM v JOIN n ON n.plate = v.plate AND n.t = v.start_t""",
)
def evt21(spark, d):
    """Length of each visit and the speed at the very stamp of its start (equal stamps: the first row)."""
    o = observations(spark, d)
    at = kin.speeds(o, 828_170).groupBy("plate", F.col("t").alias("start")).agg(F.min_by("speed", "ord").alias("speed"))
    return ev.visits(o).join(at, ["plate", "start"]).select("plate", "region", "start", (F.col("end") - F.col("start")).alias("dur"), "speed")


TN = f"""tn AS (SELECT plate, region, row_number() OVER w AS n, CAST(sum(end_t - start_t) OVER (PARTITION BY plate, region ORDER BY start_t, end_t) AS BIGINT) AS spent_us FROM v WINDOW w AS (PARTITION BY plate, region ORDER BY start_t, end_t)),
tb AS (SELECT *, CAST(greatest(len(list_filter({COUNT_EDGES}, lambda e: e < n)) - 1, 0) AS BIGINT) AS bin, greatest(len(list_filter({COUNT_EDGES}, lambda e: e < n - 1)) - 1, 0) AS bin0 FROM tn)"""


@query("evt23_time_vs_visits", f"WITH {VISITS}, {TN} SELECT plate, region, n, spent_us, bin FROM tb WHERE bin = 0 OR bin <> bin0")
def evt23(spark, d):
    return cv.time_against_visits(ev.visits(observations(spark, d)), COUNT_EDGES)


@query(
    "evt23_pooled",
    f"""WITH {VISITS}, {TN} SELECT CAST(plate % 8 AS INTEGER) AS condition_id, bin, count(*) AS n, CAST(sum(spent_us) AS BIGINT) / count(*) AS mean_us FROM tb WHERE bin = 0 OR bin <> bin0 GROUP BY plate % 8, bin HAVING count(*) > 3""",
)
def evt23_pooled(spark, d):
    """Mean time by condition and bin of visits, for bins of more than three values."""
    t = cv.time_against_visits(ev.visits(observations(spark, d)), COUNT_EDGES).withColumn("condition_id", condition_of(F.col("plate")))
    return t.groupBy("condition_id", "bin").agg(F.count(F.lit(1)).alias("n"), (F.sum("spent_us") / F.count(F.lit(1))).alias("mean_us")).where("n > 3")


@query(
    "evt24_duration_vs_spent",
    f"""WITH {VISITS}, sp AS (SELECT end_t - start_t AS dur, coalesce(sum(end_t - start_t) OVER (PARTITION BY plate, region ORDER BY start_t, end_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM v),
sb AS (SELECT dur, CAST(greatest(len(list_filter({SPENT_EDGES}, lambda e: e < spent)) - 1, 0) AS BIGINT) AS bin FROM sp)
SELECT bin, count(*) AS n, CAST(sum(dur) AS BIGINT) / count(*) AS mean_us FROM sb GROUP BY bin""",
)
def evt24(spark, d):
    r = ev.ranked(ev.visits(observations(spark, d))).withColumn("bin", bin_index(F.col("spent_before"), SPENT_EDGES))
    return r.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), (F.sum("dur") / F.count(F.lit(1))).alias("mean_us"))


@query(
    "evt33_first_passage",
    f"""WITH {OBS}, e0 AS (SELECT *, last_value(CASE WHEN region >= 0 THEN ord END IGNORE NULLS) OVER (PARTITION BY plate ORDER BY ord) AS ex FROM obs),
e1 AS (SELECT a.plate, a.ex, a.t - b.t AS delay, (a.x - b.x) * (a.x - b.x) + 10000 * (a.y - b.y) * (a.y - b.y) AS d2 FROM e0 a JOIN obs b ON a.plate = b.plate AND a.ex = b.ord WHERE a.region < 0),
e2 AS (SELECT plate, ex, radius, min(delay) FILTER (d2 >= radius * radius) AS delay FROM e1, (SELECT unnest({RADII})::BIGINT AS radius) GROUP BY plate, ex, radius)
SELECT radius, count(*) AS n_transits, count(delay) AS n_passed, CAST(coalesce(sum(delay), 0) AS BIGINT) AS delay_us FROM e2 GROUP BY radius""",
)
def evt33(spark, d):
    return cv.first_passage(observations(spark, d), RADII)


@query(
    "evt33_uncut_passage",
    f"""WITH {OBS}, e0 AS (SELECT *, t - lag(t) OVER w AS pause, last_value(CASE WHEN region >= 0 THEN ord END IGNORE NULLS) OVER w AS ex,
  first_value(CASE WHEN region >= 0 THEN ord END IGNORE NULLS) OVER (PARTITION BY plate ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM obs WINDOW w AS (PARTITION BY plate ORDER BY ord)),
e1 AS (SELECT a.plate, a.ex, a.ord, a.t, max(a.pause > {2 * DAY}) OVER (PARTITION BY a.plate, a.ex ORDER BY a.ord) AS cut, a.t - b.t AS delay, (a.x - b.x) * (a.x - b.x) + 10000 * (a.y - b.y) * (a.y - b.y) AS d2, n.region = b.region AS back, n.t AS back_t
  FROM e0 a JOIN obs b ON a.plate = b.plate AND a.ex = b.ord LEFT JOIN obs n ON n.plate = a.plate AND n.ord = a.nx WHERE a.region < 0),
e2 AS (SELECT plate, ex, radius, coalesce(bool_and(back) AND NOT bool_or(cut) AND min(back_t) - max(t) <= {2 * DAY}, false) AS whole, min(delay) FILTER (NOT cut AND d2 >= radius * radius) AS delay FROM e1, (SELECT unnest({RADII})::BIGINT AS radius) GROUP BY plate, ex, radius)
SELECT radius, count(*) FILTER (whole OR delay IS NOT NULL) AS n_transits, count(delay) AS n_passed, CAST(coalesce(sum(delay), 0) AS BIGINT) AS delay_us FROM e2 GROUP BY radius""",
)
def evt33_uncut(spark, d):
    return cv.first_passage_uncut(observations(spark, d), RADII, 2 * DAY)


@query(
    "evt34_border_steps",
    f"""WITH {STEPS}, en AS (SELECT plate, ord FROM (SELECT *, lag(region) OVER (PARTITION BY plate ORDER BY ord) AS prev, max(ord) OVER (PARTITION BY plate) AS most FROM st) WHERE region >= 0 AND prev < 0 AND ord > 3 AND ord + 3 <= most)
SELECT st.ord - en.ord AS "offset", count(*) AS n, CAST(sum(dist) AS BIGINT) / count(*) AS mean_dist FROM en JOIN st ON st.plate = en.plate AND st.ord BETWEEN en.ord - 3 AND en.ord + 3 GROUP BY 1""",
)
def evt34(spark, d):
    return cv.around_entries(kin.steps(observations(spark, d)), 3)


BORDER_US, BORDER_BINS = 2 * DAY, 3


@query(
    "evt34_border_windows",
    f"""WITH {STEPS}, w0 AS (SELECT *, region >= 0 AS ins, lag(region >= 0) OVER (PARTITION BY plate ORDER BY ord) AS was, min(t) OVER (PARTITION BY plate) AS t0, max(t) OVER (PARTITION BY plate) AS t1 FROM st),
eg AS (SELECT plate, ord, t AS stamp, ins AS entry FROM w0 WHERE was IS NOT NULL AND was <> ins AND t - {BORDER_US * BORDER_BINS} >= t0 AND t + {BORDER_US * BORDER_BINS} <= t1),
bn AS (SELECT eg.plate, eg.ord, entry, CAST(floor((t - stamp) / {BORDER_US}) AS BIGINT) AS bin, count(*) AS n, sum(dist) AS dist, sum(dt) AS dt FROM eg JOIN st ON st.plate = eg.plate AND t >= stamp - {BORDER_US * BORDER_BINS} AND t < stamp + {BORDER_US * BORDER_BINS} GROUP BY 1, 2, 3, 4),
fb AS (SELECT *, count(*) OVER (PARTITION BY plate, ord) AS k FROM bn)
SELECT entry, bin, count(*) AS n_windows, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(dist) AS DOUBLE) / CAST(sum(dt) AS DOUBLE) AS speed FROM fb WHERE k = {2 * BORDER_BINS} GROUP BY entry, bin""",
)
def evt34_windows(spark, d):
    """Speed around entries and exits by time from them, for windows without an empty bin."""
    w = cv.border_windows(kin.steps(observations(spark, d)), BORDER_US, BORDER_BINS)
    g = w.groupBy("entry", "bin").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_rows"), F.sum("dist").alias("dist"), F.sum("dt").alias("dt"))
    return g.select("entry", "bin", "n_windows", "n_rows", F.try_divide(F.col("dist").cast("double"), F.col("dt").cast("double")).alias("speed"))


@query(
    "evt35_visit_speed",
    f"WITH {STEPS} SELECT plate, CAST(sum(dist) AS BIGINT) AS dist, CAST(sum(dist) AS DOUBLE) / CAST(nullif(sum(dt), 0) AS DOUBLE) AS speed, CAST(sum(dt) AS DOUBLE) / CAST(nullif(sum(dist), 0) AS DOUBLE) AS pace FROM st WHERE region >= 0 GROUP BY plate",
)
def evt35(spark, d):
    """Way, speed and inverse speed of a plate inside regions."""
    s = kin.steps(observations(spark, d)).where("region >= 0").groupBy("plate").agg(F.sum("dist").alias("dist"), F.sum("dt").alias("dt"))
    return s.select("plate", "dist", F.try_divide(F.col("dist").cast("double"), F.col("dt").cast("double")).alias("speed"), F.try_divide(F.col("dt").cast("double"), F.col("dist").cast("double")).alias("pace"))


@query(
    "evt36_mixed_density",
    f"""WITH {VISITS}, b AS (SELECT plate, count(DISTINCT region % 2) AS k FROM v GROUP BY plate)
SELECT v.plate, CASE WHEN region % 2 = 0 THEN '0.2' ELSE '0.5' END AS density, count(*) AS n_visits, CAST(sum(end_t - start_t) AS BIGINT) AS visit_us, k > 1 AS met_both FROM v JOIN b ON b.plate = v.plate GROUP BY ALL""",
)
def evt36(spark, d):
    """Visits by density of the region, of which every second one has more; whether a plate met both."""
    v = ev.visits(observations(spark, d)).withColumn("density", F.when(F.col("region") % 2 == 0, "0.2").otherwise("0.5"))
    s = v.groupBy("plate", "density").agg(F.count(F.lit(1)).alias("n_visits"), F.sum(F.col("end") - F.col("start")).alias("visit_us"))
    return s.withColumn("met_both", F.count(F.lit(1)).over(Window.partitionBy("plate")) > 1)


@query(
    "evt37_visits_in_time",
    f"""WITH {VISITS}, p AS (SELECT plate, (start_t - {T0}) // {5 * DAY} AS bin, CAST(sum(end_t - start_t) AS BIGINT) / count(*) AS m FROM v GROUP BY 1, 2)
SELECT CAST(plate % 8 AS INTEGER) AS condition_id, bin, count(*) AS n_plates, round(avg(m), 3) AS mean_us FROM p GROUP BY 1, 2""",
)
def evt37(spark, d):
    """Mean length of visits by part of the recording: by plate first, then by condition."""
    v = ev.visits(observations(spark, d)).withColumn("bin", F.floor((F.col("start") - T0) / (5 * DAY)).cast("long"))
    p = v.groupBy("plate", "bin").agg((F.sum(F.col("end") - F.col("start")) / F.count(F.lit(1))).alias("m"))
    return p.groupBy(condition_of(F.col("plate")).alias("condition_id"), "bin").agg(F.count(F.lit(1)).alias("n_plates"), F.round(F.avg("m"), 3).alias("mean_us"))


@query(
    "evt38_region_map",
    f"""WITH {VISITS}, k AS (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY start_t, end_t, region) AS pos FROM v),
p AS (SELECT plate, region, count(*) AS n, CAST(sum(end_t - start_t) AS BIGINT) AS us, CAST(sum(pos) AS BIGINT) / count(*) AS pos, min(start_t) AS found FROM k GROUP BY plate, region)
SELECT region, CAST(sum(n) AS BIGINT) AS n_visits, CAST(sum(us) AS BIGINT) AS total_us, CAST(sum(us) AS BIGINT) / CAST(sum(n) AS BIGINT) AS mean_us, round(median(pos), 6) AS med_pos, min(found) AS found FROM p GROUP BY region""",
)
def evt38(spark, d):
    """Visits of each region, and the median over plates of the mean position of its visits."""
    k = ev.visits(observations(spark, d)).withColumn("pos", F.row_number().over(Window.partitionBy("plate").orderBy("start", "end", "region")))
    p = k.groupBy("plate", "region").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("us"), (F.sum("pos") / F.count(F.lit(1))).alias("pos"), F.min("start").alias("found")
    )
    return p.groupBy("region").agg(
        F.sum("n").alias("n_visits"), F.sum("us").alias("total_us"), (F.sum("us") / F.sum("n")).alias("mean_us"), F.round(F.median("pos"), 6).alias("med_pos"), F.min("found").alias("found")
    )


@query(
    "evt40_timeline",
    f"""WITH {FILLED}, dd AS (SELECT plate, region >= 0 AS vis, unnest(range((s // 2 - {T0}) // {DAY}, (e // 2 - {T0}) // {DAY} + 1)) AS day FROM f)
SELECT plate, day, count(*) FILTER (vis) AS n_visits, count(*) FILTER (NOT vis) AS n_transits FROM dd GROUP BY plate, day""",
)
def evt40(spark, d):
    """Timeline of a plate by day: visits and transits that touch it."""
    f = ev.filled_events(observations(spark, d))

    def day(c):
        return F.floor((F.floor(F.col(c) / 2) - T0) / DAY)

    e = f.select("plate", (F.col("region") >= 0).alias("vis"), F.explode(F.sequence(day("start2"), day("end2"))).alias("day"))
    return e.groupBy("plate", "day").agg(F.count_if("vis").alias("n_visits"), F.count_if(~F.col("vis")).alias("n_transits"))


@query(
    "evt40_codes",
    f"""WITH {CENSORED}, sp AS (SELECT plate, unnest(range((min(t) - {T0}) // {DAY}, (max(t) - {T0}) // {DAY} + 1)) AS day FROM obs GROUP BY plate), ro AS (SELECT DISTINCT plate, (t - {T0}) // {DAY} AS day FROM obs),
dd AS (SELECT plate, region >= 0 AS vis, uncensored, unnest(range((s // 2 - {T0}) // {DAY}, (e // 2 - {T0}) // {DAY} + 1)) AS day FROM c), ev AS (SELECT plate, day, bool_or(vis) AS vis, bool_or(vis AND NOT uncensored) AS cens FROM dd GROUP BY plate, day)
SELECT sp.plate, sp.day, CASE WHEN ro.day IS NULL THEN -2 WHEN cens THEN -3 WHEN vis THEN 1 ELSE 0 END AS code FROM sp LEFT JOIN ro ON ro.plate = sp.plate AND ro.day = sp.day LEFT JOIN ev ON ev.plate = sp.plate AND ev.day = sp.day""",
)
def evt40_codes(spark, d):
    """Timeline of a plate by day: -2 without rows (a hole that events may fill), -3 with a censored visit, 1 with a visit, 0 else."""
    o = observations(spark, d).select("plate", F.floor((F.col("t") - T0) / DAY).alias("day"))
    span = o.groupBy("plate").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("plate", F.explode(F.sequence("a", "b")).alias("day"))
    day = lambda c: F.floor((F.floor(F.col(c) / 2) - T0) / DAY)
    e = ev.censored(ev.filled_events(observations(spark, d))).withColumn("day", F.explode(F.sequence(day("start2"), day("end2"))))
    e = e.groupBy("plate", "day").agg(F.max(F.col("region") >= 0).alias("vis"), F.max((F.col("region") >= 0) & ~F.col("uncensored")).alias("cens"))
    j = span.join(o.distinct().withColumn("rows", F.lit(True)), ["plate", "day"], "left").join(e, ["plate", "day"], "left")
    code = F.when(F.col("rows").isNull(), -2).when(F.col("cens"), -3).when(F.col("vis"), 1).otherwise(0)
    return j.select("plate", "day", code.alias("code"))


@query(
    "evt43_neighbour_moves",
    f"""WITH {VISITS}, ce AS (SELECT region, CAST(sum(x) AS BIGINT) / count(*) AS cx, CAST(sum(y) AS BIGINT) / count(*) AS cy FROM obs WHERE region >= 0 GROUP BY region),
nd AS (SELECT a.region AS src, b.region AS dst, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d FROM ce a JOIN ce b ON a.region <> b.region),
nn AS (SELECT src, dst FROM (SELECT *, min(d) OVER (PARTITION BY src) AS least FROM nd) WHERE d <= 1.3 * least),
mv AS (SELECT region AS src, lead(region) OVER (PARTITION BY plate ORDER BY start_t, end_t, region) AS dst FROM v), n AS (SELECT src, dst, count(*) AS n FROM mv WHERE dst IS NOT NULL AND dst <> src GROUP BY src, dst)
SELECT n.src, CAST(sum(n) AS BIGINT) AS n_moves, CAST(sum(CASE WHEN nn.src IS NULL THEN 0 ELSE n END) AS BIGINT) AS n_near FROM n LEFT JOIN nn ON nn.src = n.src AND nn.dst = n.dst GROUP BY n.src""",
)
def evt43(spark, d):
    """Moves to another region, and those of them to a nearest neighbour."""
    o = observations(spark, d)
    centres = o.where("region >= 0").groupBy("region").agg((F.sum("x") / F.count(F.lit(1))).alias("cx"), (F.sum("y") / F.count(F.lit(1))).alias("cy"))
    near = cv.neighbours(centres, CONFIG.neighbour_factor).select("src", "dst", F.lit(True).alias("near"))
    moves = ev.transitions(ev.visits(o)).where("src <> dst").join(near, ["src", "dst"], "left")
    return moves.groupBy("src").agg(F.sum("n").alias("n_moves"), F.sum(F.when(F.col("near"), F.col("n")).otherwise(0)).alias("n_near"))


@query(
    "evt44_sequence",
    f"WITH {VISITS} SELECT plate, row_number() OVER (PARTITION BY plate ORDER BY start_t, end_t, region) AS pos, region, row_number() OVER (PARTITION BY plate, region ORDER BY start_t, end_t) AS nth FROM v",
)
def evt44(spark, d):
    """Regions of a plate in order of visit, and the place of the visit among those to its region."""
    order, here = Window.partitionBy("plate").orderBy("start", "end", "region"), Window.partitionBy("plate", "region").orderBy("start", "end")
    return ev.visits(observations(spark, d)).select("plate", F.row_number().over(order).cast("long").alias("pos"), "region", F.row_number().over(here).cast("long").alias("nth"))


@query(
    "evt10_track_table",
    f"""WITH {STEPS} SELECT plate, track, min(t) AS first_us, max(t) AS last_us, count(*) AS n_rows, arg_min(region, ord) AS first_region, arg_max(region, ord) AS last_region,
 arg_min(x, ord) AS first_x, arg_max(x, ord) AS last_x, CAST(sum(CASE WHEN switched THEN 0 ELSE dist END) AS BIGINT) AS way FROM st GROUP BY plate, track""",
)
def evt10(spark, d):
    """One row per track: times, ends, rows and way."""
    return kin.steps(observations(spark, d)).groupBy("plate", "track").agg(
        F.min("t").alias("first_us"), F.max("t").alias("last_us"), F.count(F.lit(1)).alias("n_rows"),
        F.min_by("region", "ord").alias("first_region"), F.max_by("region", "ord").alias("last_region"),
        F.min_by("x", "ord").alias("first_x"), F.max_by("x", "ord").alias("last_x"),
        F.sum(F.when(F.col("switched"), 0).otherwise(F.col("dist"))).alias("way"),
    )


@query("fil03_pool_members", f"WITH {OBS}, {COND} SELECT plate, min(condition_id) AS condition_id, count(*) AS n_rows FROM obs JOIN cond ON condition_id = plate % 8 WHERE layout = 'med' GROUP BY plate")
def fil03(spark, d):
    """Plates whose condition has the medium layout."""
    c = conditions(spark).where("layout = 'med'").select("condition_id")
    o = observations(spark, d).withColumn("condition_id", condition_of(F.col("plate"))).join(F.broadcast(c), "condition_id")
    return o.groupBy("plate").agg(F.min("condition_id").alias("condition_id"), F.count(F.lit(1)).alias("n_rows"))


@query("fil05_long_visits", f"WITH {VISITS} SELECT plate, region, start_t AS start, end_t AS \"end\" FROM v WHERE end_t >= start_t AND end_t - start_t >= {DAY} AND start_t BETWEEN {T0 + DAY} AND {T0 + 20 * DAY} AND start_t <= {T0 + 19 * DAY}")
def fil05(spark, d):
    """Visits of a day or more that start within the cut and before an end time; none of negative length."""
    long_ = (F.col("end") >= F.col("start")) & (F.col("end") - F.col("start") >= DAY)
    return ev.visits(observations(spark, d)).where(long_ & F.col("start").between(T0 + DAY, T0 + 20 * DAY) & (F.col("start") <= T0 + 19 * DAY)).select("plate", "region", "start", "end")


@query("fil08_first_region", f"WITH {VISITS}, q AS (SELECT *, first_value(region) OVER (PARTITION BY plate ORDER BY start_t, end_t, region) AS fr FROM v) SELECT plate, region, count(*) AS n_visits, CAST(sum(end_t - start_t) AS BIGINT) AS visit_us FROM q WHERE region = fr GROUP BY plate, region")
def fil08(spark, d):
    """Visits to the region that a plate found first."""
    v = ev.visits(observations(spark, d)).withColumn("first", F.first("region").over(Window.partitionBy("plate").orderBy("start", "end", "region")))
    return v.where("region = first").groupBy("plate", "region").agg(F.count(F.lit(1)).alias("n_visits"), F.sum(F.col("end") - F.col("start")).alias("visit_us"))


@query("fil10_first_uncensored", f"WITH {CENSORED}, fk AS (SELECT *, row_number() OVER (PARTITION BY plate, region ORDER BY s, e) AS k FROM c WHERE region >= 0) SELECT plate, region, s AS start2, k AS visit_rank, patch_uncensored FROM fk WHERE k <= 2 AND uncensored")
def fil10(spark, d):
    """Uncensored ones among the first two visits to each region; ranks count censored visits."""
    c = ev.censored(ev.filled_events(observations(spark, d))).where("region >= 0")
    c = c.withColumn("visit_rank", F.row_number().over(Window.partitionBy("plate", "region").orderBy("start2", "end2")).cast("long"))
    return c.where("visit_rank <= 2 and uncensored").select("plate", "region", "start2", "visit_rank", "patch_uncensored")


@query("trj11_interframe", f"WITH {STEPS} SELECT dt // {HOUR} AS bin, count(*) AS n FROM st WHERE dt IS NOT NULL GROUP BY 1")
def trj11(spark, d):
    """Histogram of times between rows, by hour."""
    return kin.steps(observations(spark, d)).where("dt is not null").groupBy(F.floor(F.col("dt") / HOUR).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("trj12_initial_position", f"WITH {OBS} SELECT plate, t, x, y, region FROM obs WHERE ord = 1")
def trj12(spark, d):
    return observations(spark, d).groupBy("plate").agg(F.min_by(F.struct("t", "x", "y", "region"), "ord").alias("p")).select("plate", "p.*")


@query(
    "trj11_time_per_frame",
    f"""WITH {OBS}, q AS (SELECT plate, t - lag(t) OVER w AS dt, (ord + ord // 50) - lag(ord + ord // 50) OVER w AS df FROM obs WINDOW w AS (PARTITION BY plate ORDER BY ord))
SELECT plate, count(*) AS n, round(avg(dt / df), 3) AS mean_us FROM q WHERE df > 0 GROUP BY plate""",
)
def trj11_frames(spark, d):
    """Mean time of a frame between rows, where frames are missing at times; steps without a new frame don't count."""
    w = Window.partitionBy("plate").orderBy("ord")
    frame = F.col("ord") + F.floor(F.col("ord") / 50)
    q = observations(spark, d).select("plate", (F.col("t") - F.lag("t").over(w)).alias("dt"), (frame - F.lag(frame).over(w)).alias("df")).where("df > 0")
    return q.groupBy("plate").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.try_divide("dt", "df")), 3).alias("mean_us"))
