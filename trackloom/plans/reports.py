"""The report catalogue and aggregates over several conditions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.config import CONFIG
from trackloom.functions.stats import bin_index
from trackloom.functions import stats
from trackloom.operators import curves as cv
from trackloom.operators import events as ev
from trackloom.operators import reports as rp
from trackloom.plans.catalog import CENSORED, COND, DAY, MERGED, RUNS, STEPS, T0, VISITS, query
from trackloom.plans.curves import CLOCK_EDGES, HOUR, STAYS, THRESHOLDS
from trackloom.plans.space import PV, history
from trackloom.sources.tables import condition_of, conditions, observations, pools

CUT = (T0 + DAY, CONFIG.cut_us)
LONG_US = DAY // 4
CURVES = [["close 0.2", "med 0.2"], ["0.5"], ["far"], ["all"]]

SOFT = f"s BETWEEN {2 * CUT[0]} AND {2 * (CUT[0] + CUT[1])}"
CHOICE = {
    "all": "se AS (SELECT plate, s, e, region FROM c)",
    "uncensored": "se AS (SELECT plate, s, e, region FROM c WHERE uncensored)",
    "long": f"se AS (SELECT plate, s, e, region FROM c WHERE uncensored AND region >= 0 AND e - s >= {2 * LONG_US} AND {SOFT})",
    "first": "se AS (SELECT plate, s, e, region FROM c WHERE region >= 0 QUALIFY row_number() OVER (PARTITION BY plate, region ORDER BY s, e) = 1)",
    "first_of_plate": "se AS (SELECT plate, s, e, region FROM c WHERE region >= 0 QUALIFY row_number() OVER (PARTITION BY plate ORDER BY s, e, region) = 1)",
    "first_region": f"sf AS (SELECT *, first_value(region) OVER (PARTITION BY plate ORDER BY s, e, region) AS fr FROM c WHERE region >= 0), se AS (SELECT plate, s, e, region FROM sf WHERE region = fr AND {SOFT})",
    "cut": f"""sl AS (SELECT plate, greatest(s, {2 * CUT[0]}) AS s, e, region FROM c WHERE e > {2 * CUT[0]}),
sx AS (SELECT *, e - s AS dur, sum(e - s) OVER (PARTITION BY plate ORDER BY s, e, region ROWS UNBOUNDED PRECEDING) AS so, sum(e - s) OVER (PARTITION BY plate) AS whole FROM sl),
se AS (SELECT plate, s, CAST(e - greatest(0, so - {2 * CUT[1]}) AS BIGINT) AS e, region FROM sx WHERE whole >= {2 * CUT[1]} AND so - dur < {2 * CUT[1]})""",
}
SUMS = """pm AS (SELECT plate, CAST(plate % 8 AS INTEGER) AS condition_id, CAST(coalesce(sum(e - s) FILTER (region >= 0), 0) AS DOUBLE) / 2 AS visit_us, CAST(coalesce(sum(e - s) FILTER (region < 0), 0) AS DOUBLE) / 2 AS transit_us,
 count(*) FILTER (region >= 0) AS n_visits, count(DISTINCT region) FILTER (region >= 0) AS n_regions FROM se GROUP BY plate)"""
VIDEO = f"rc AS (SELECT plate, max(t) - min(t) AS video_us, count(*) / count(DISTINCT t // {HOUR}) - 1 AS double_rate FROM obs GROUP BY plate)"

#: name: (choice of events, numerator, denominator); both are expressions that Spark and the SQL share.
REPORTS = {
    "rep10_number_of_visits": ("all", "n_visits", "1"),
    "rep11_visits_per_patch": ("all", "n_visits", "n_patches"),
    "rep12_visits_per_visited_patch": ("cut", "n_visits", "n_regions"),
    "rep13_total_visit_time": ("cut", "visit_us / 60000000.0", "n_regions"),
    "rep14_visit_duration": ("uncensored", "visit_us / 60000000.0", "n_visits"),
    "rep15_long_visit_duration": ("long", "visit_us / 60000000.0", "n_visits"),
    "rep16_first_visit_patch": ("first", "visit_us / 60000000.0", "n_visits"),
    "rep17_first_visit_video": ("first_of_plate", "visit_us / 60000000.0", "n_visits"),
    "rep18_first_patch_time": ("first_region", "visit_us / 60000000.0", "1"),
    "rep21_visit_rate": ("all", "n_visits", "transit_us / 3600000000.0"),
    "rep27_visited_patches": ("all", "n_regions", "1"),
    "rep28_share_of_patches": ("all", "n_regions", "n_patches"),
    "rep31_total_event_time": ("all", "(visit_us + transit_us) / 60000000.0", "1"),
    "rep32_transit_duration": ("all", "transit_us / 60000000.0", "n_visits"),
    "rep26_share_of_time": ("all", "visit_us", "video_us"),
    "rep30_total_video_time": ("all", "video_us / 60000000.0", "1"),
    "rep05_double_frames": ("all", "double_rate", "1"),
}


def _values(spark, d, choice):
    o = observations(spark, d)
    sums = rp.plate_sums(rp.select_events(o, choice, CUT, LONG_US))
    return sums.join(F.broadcast(conditions(spark).select("condition_id", "n_patches")), "condition_id")


def _register(name: str, choice: str, top: str, below: str) -> None:
    recorded = "video" in top + below or "double" in top
    sql = f"""WITH {CENSORED}, {CHOICE[choice]}, {SUMS}, {VIDEO}, {COND}
SELECT condition_id, count(CAST({top} AS DOUBLE) / nullif({below}, 0)) AS n_plates, round(avg(CAST({top} AS DOUBLE) / nullif({below}, 0)), 6) AS mean FROM pm JOIN cond USING (condition_id) JOIN rc USING (plate) GROUP BY condition_id"""

    def run(spark, d):
        values = _values(spark, d, choice)
        if recorded:
            values = values.join(rp.recording(observations(spark, d), HOUR).select("plate", "video_us", "double_rate"), "plate")
        return rp.mean_by(values, ["condition_id"], F.try_divide(F.expr(top).cast("double"), F.expr(below).cast("double")))

    run.__doc__ = f"Mean by condition of {top} over {below}, events: {choice}."
    query(name, sql)(run)


for _name, _parts in REPORTS.items():
    _register(_name, *_parts)


@query(
    "rep_curves_visits",
    f"""WITH {CENSORED}, {CHOICE["all"]}, {SUMS}, {COND}, pl AS (SELECT unnest(['all', density, layout, layout || ' ' || density]) AS pool, condition_id FROM cond),
cu AS (SELECT * FROM (VALUES {", ".join(f"('{'+'.join(c)}', '{n}')" for c in CURVES for n in c)}) x(curve, pool)), me AS (SELECT DISTINCT curve, condition_id FROM cu JOIN pl USING (pool))
SELECT curve, count(*) AS n_plates, round(avg(CAST(n_visits AS DOUBLE)), 6) AS mean FROM pm JOIN me USING (condition_id) GROUP BY curve""",
)
def rep_curves(spark, d):
    """Visits by curve; a curve is a list of names of conditions or pools."""
    return rp.mean_by_curve(_values(spark, d, "all"), rp.curve_members(pools(spark), CURVES), F.col("n_visits").cast("double"))


@query(
    "rep02_average_speed",
    f"""WITH {STEPS}, sd AS (SELECT plate, CAST(sum(dist) FILTER (region >= 0) AS DOUBLE) / nullif(sum(dt) FILTER (region >= 0), 0) AS si, CAST(sum(dist) FILTER (region < 0) AS DOUBLE) / nullif(sum(dt) FILTER (region < 0), 0) AS so FROM st GROUP BY plate)
SELECT CAST(plate % 8 AS INTEGER) AS condition_id, round(avg(si), 12) AS speed_in, round(avg(so), 12) AS speed_out FROM sd GROUP BY 1""",
)
def rep02(spark, d):
    """Mean speed inside and outside of regions by condition."""
    r = rp.recording(observations(spark, d), HOUR)
    side = [F.round(F.avg(F.try_divide(F.col(f"dist_{s}").cast("double"), F.col(f"dt_{s}").cast("double"))), 12).alias(f"speed_{s}") for s in ("in", "out")]
    return r.groupBy(condition_of(F.col("plate")).alias("condition_id")).agg(*side)


@query(
    "rep01_merged_duration",
    f"""WITH {VISITS}, g AS (SELECT *, abs(start_t - lag(end_t) OVER (PARTITION BY plate, region ORDER BY start_t, end_t)) AS gap FROM v), th AS (SELECT unnest({THRESHOLDS}) AS threshold),
pp AS (SELECT plate, threshold, CAST(sum(end_t - start_t) + coalesce(sum(gap) FILTER (gap < threshold), 0) AS DOUBLE) / count(*) FILTER (NOT coalesce(gap < threshold, false)) AS dur FROM g, th GROUP BY plate, threshold)
SELECT CAST(plate % 8 AS INTEGER) AS condition_id, threshold, count(dur) AS n_plates, round(avg(dur), 3) AS mean FROM pp GROUP BY 1, 2""",
)
def rep01(spark, d):
    """Mean length of visits merged at each gap threshold."""
    t = cv.threshold_totals(ev.visits(observations(spark, d)), THRESHOLDS).withColumn("condition_id", condition_of(F.col("plate")))
    out = t.withColumn("dur", F.col("total_us").cast("double") / F.col("n_visits"))
    return out.groupBy("condition_id", "threshold").agg(F.count("dur").alias("n_plates"), F.round(F.avg("dur"), 3).alias("mean"))


@query("rep04_merged_distribution", f"WITH {VISITS}, {MERGED}, mm AS (SELECT max(end_t) - min(start_t) AS dur FROM m1 GROUP BY plate, region, island) SELECT dur // {DAY} AS day, count(*) AS n FROM mm GROUP BY 1")
def rep04(spark, d):
    """Merged visits by length in days."""
    return ev.merged_visits(ev.visits(observations(spark, d))).groupBy(F.floor((F.col("end") - F.col("start")) / DAY).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "rep07_leaving_distribution",
    f"""WITH {VISITS}, {MERGED}, l0 AS (SELECT plate, region, island, start_t, end_t, start_t // 1000000 AS ss, end_t // 1000000 AS ee, CASE WHEN near THEN last_end // 1000000 END AS pe FROM m1),
l1 AS (SELECT *, first_value(ss) OVER w AS f, coalesce(ss - pe + 1, 0) AS o, lead(ss) OVER w AS ns FROM l0 WINDOW w AS (PARTITION BY plate, region, island ORDER BY start_t, end_t)),
l2 AS (SELECT *, CAST(sum(o) OVER (PARTITION BY plate, region, island ORDER BY start_t, end_t) AS BIGINT) AS oo FROM l1)
SELECT (CASE WHEN ns IS NOT NULL THEN ee - f + 1 - oo ELSE ee - f + 1 END) // 86400 AS day, count(*) AS n FROM l2 GROUP BY 1""",
)
def rep07(spark, d):
    """Leaving events by day on the in-region clock."""
    return ev.leaving_times(ev.visits(observations(spark, d))).groupBy(F.floor(F.col("leaving_s") / 86400).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("rep09_leaving_by_condition", f"WITH {RUNS}, {STAYS} SELECT CAST(plate % 8 AS INTEGER) AS condition_id, bin, count(*) AS n_plates, round(avg(n_leaving / n_points), 9) AS p_leave FROM db GROUP BY 1, bin HAVING count(*) > 2")
def rep09(spark, d):
    """Leaving probability by condition and time in the region."""
    b = cv.delay_bins(cv.stays(ev.runs(observations(spark, d)), HOUR), CLOCK_EDGES).withColumn("share", F.col("n_leaving") / F.col("n_points"))
    return b.groupBy(condition_of(F.col("plate")).alias("condition_id"), "bin").agg(F.count(F.lit(1)).alias("n_plates"), F.round(F.avg("share"), 9).alias("p_leave")).where("n_plates > 2")


TRANSIT_EDGES = [0.0, 1e9, 1e10, 5e10, 1e11, 5e11]


@query(
    "rep22_visit_vs_transit",
    f"""WITH {CENSORED}, b AS (SELECT *, lag(s) OVER w AS bs, lag(e) OVER w AS be, lag(region) OVER w AS br, lag(uncensored) OVER w AS bu, row_number() OVER (PARTITION BY plate, region ORDER BY s, e) AS visit_rank FROM c WINDOW w AS (PARTITION BY plate ORDER BY s, e, region)),
z AS (SELECT e - s AS vus, CAST(greatest(len(list_filter({TRANSIT_EDGES}, lambda q: q < be - bs)) - 1, 0) AS BIGINT) AS bin FROM b WHERE region >= 0 AND uncensored AND br < 0 AND be = s AND bu)
SELECT bin, count(*) AS n, CAST(sum(vus) AS BIGINT) / count(*) AS mean_us2 FROM z GROUP BY bin""",
)
def rep22(spark, d):
    """Mean visit by length of the transit before it."""
    b = cv.before_visits(ev.censored(ev.filled_events(observations(spark, d)))).withColumn("bin", bin_index(F.col("transit_us2"), TRANSIT_EDGES))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), (F.sum("visit_us2") / F.count(F.lit(1))).alias("mean_us2"))


@query("rep23_visit_vs_start", f"WITH {VISITS} SELECT (start_t - {T0}) // {2 * DAY} AS bin, count(*) AS n, CAST(sum(end_t - start_t) AS BIGINT) / count(*) AS mean_us FROM v GROUP BY 1")
def rep23(spark, d):
    """Mean visit by time of its start."""
    return ev.visits(observations(spark, d)).groupBy(F.floor((F.col("start") - T0) / (2 * DAY)).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("end") - F.col("start")) / F.count(F.lit(1))).alias("mean_us")
    )


@query("rep25_pixel_visits", f"WITH {PV}, pa AS (SELECT CAST(plate % 8 AS INTEGER) AS condition_id, plate, CAST(sum(n_frames) AS BIGINT) / count(*) AS m FROM pv GROUP BY plate) SELECT condition_id, count(*) AS n_plates, round(avg(m), 9) AS mean FROM pa GROUP BY 1")
def rep25(spark, d):
    """Mean frames of a pixel visit, by plate and then by condition."""
    p = history(spark, d).groupBy("plate").agg((F.sum("n_frames") / F.count(F.lit(1))).alias("m"))
    return p.groupBy(condition_of(F.col("plate")).alias("condition_id")).agg(F.count(F.lit(1)).alias("n_plates"), F.round(F.avg("m"), 9).alias("mean"))


@query(
    "agg06_transit_properties",
    f"""WITH {VISITS}, n AS (SELECT *, lead(region) OVER (PARTITION BY plate ORDER BY start_t, end_t, region) AS nx FROM v)
SELECT CAST(plate % 8 AS INTEGER) AS condition_id, count(nx) AS n_moves, count(*) FILTER (nx = region) / count(nx) AS p_revisit, count(*) FILTER (nx <> region) / count(nx) AS p_cross, CAST(count(*) AS DOUBLE) / CAST(sum(end_t - start_t) AS BIGINT) AS leave_rate, round(quantile_cont(end_t - start_t, 0.15), 3) AS p15_visit FROM n GROUP BY 1""",
)
def agg06(spark, d):
    """Revisits and moves, rate of leaving and the 15th percentile of visits, by condition."""
    n = ev.visits(observations(spark, d)).withColumns({"nx": F.lead("region").over(Window.partitionBy("plate").orderBy("start", "end", "region")), "dur": F.col("end") - F.col("start")})
    n = n.withColumn("condition_id", condition_of(F.col("plate")))
    shares = n.groupBy("condition_id").agg(
        F.count("nx").alias("n_moves"), (F.count_if(F.col("nx") == F.col("region")) / F.count("nx")).alias("p_revisit"),
        (F.count_if(F.col("nx") != F.col("region")) / F.count("nx")).alias("p_cross"), (F.count(F.lit(1)).cast("double") / F.sum("dur")).alias("leave_rate"),
    )
    p = stats.exact_percentiles(n, "condition_id", "dur", [0.15])
    return shares.join(p, "condition_id").select(*shares.columns, F.round("p0", 3).alias("p15_visit"))


@query(
    "agg12_travel_parameters",
    f"""WITH {CENSORED}, {CHOICE["cut"]}, {SUMS}, {COND}, pl AS (SELECT unnest(['all', density, layout, layout || ' ' || density]) AS pool, condition_id FROM cond)
SELECT pool, count(*) AS n_plates, round(avg(transit_us / nullif(n_regions, 0) / 3600000000.0), 6) AS out_hours, round(avg(n_visits / nullif(n_regions, 0)), 6) AS visits_per_region FROM pm JOIN pl USING (condition_id) GROUP BY pool""",
)
def agg12(spark, d):
    """Time out and visits per visited region of a cut recording, by pool."""
    v = _values(spark, d, "cut").join(F.broadcast(pools(spark)), "condition_id")
    return v.groupBy("pool").agg(
        F.count(F.lit(1)).alias("n_plates"),
        F.round(F.avg(F.try_divide(F.col("transit_us"), F.col("n_regions")) / 3_600_000_000.0), 6).alias("out_hours"),
        F.round(F.avg(F.try_divide(F.col("n_visits").cast("double"), F.col("n_regions"))), 6).alias("visits_per_region"),
    )


@query(
    "agg16_cumulated_by_rank",
    f"""WITH {VISITS}, rk AS (SELECT end_t - start_t AS dur, row_number() OVER (PARTITION BY plate, region ORDER BY start_t, end_t) AS k FROM v), mk AS (SELECT k, count(*) AS n, CAST(sum(dur) AS BIGINT) / count(*) AS m FROM rk GROUP BY k HAVING count(*) > 20)
SELECT k AS visit_rank, n, round(sum(m) OVER (ORDER BY k), 3) AS cumulated_us FROM mk""",
)
def agg16(spark, d):
    """Mean visit by rank, summed over ranks with more than 20 visits; one row per rank meets in the last window."""
    m = ev.ranked(ev.visits(observations(spark, d))).groupBy("visit_rank").agg(F.count(F.lit(1)).alias("n"), (F.sum("dur") / F.count(F.lit(1))).alias("m")).where("n > 20")
    return m.select("visit_rank", "n", F.round(F.sum("m").over(Window.orderBy("visit_rank")), 3).alias("cumulated_us"))


@query(
    "agg17_equal_weights",
    f"""WITH {VISITS}, p AS (SELECT plate, (start_t - {T0}) // {5 * DAY} AS bin, CAST(sum(end_t - start_t) AS BIGINT) / count(*) AS m FROM v GROUP BY 1, 2), cm AS (SELECT plate % 8 AS condition_id, bin, avg(m) AS m FROM p GROUP BY 1, 2)
SELECT bin, count(*) AS n_conditions, round(avg(m), 3) AS mean_us FROM cm GROUP BY bin HAVING count(*) > 1""",
)
def agg17(spark, d):
    """A curve in which each condition weighs the same; bins of one condition alone are dropped."""
    v = ev.visits(observations(spark, d)).withColumn("bin", F.floor((F.col("start") - T0) / (5 * DAY)).cast("long"))
    p = v.groupBy("plate", "bin").agg((F.sum(F.col("end") - F.col("start")) / F.count(F.lit(1))).alias("m"))
    c = p.groupBy(condition_of(F.col("plate")).alias("condition_id"), "bin").agg(F.avg("m").alias("m"))
    return c.groupBy("bin").agg(F.count(F.lit(1)).alias("n_conditions"), F.round(F.avg("m"), 3).alias("mean_us")).where("n_conditions > 1")
