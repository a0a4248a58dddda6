"""Queries over the event tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.config import CONFIG, CONDITIONS, PATCHES
from trackloom.functions import stats
from trackloom.operators import curves as cv
from trackloom.operators import events as ev
from trackloom.operators import kinematics as kin
from trackloom.operators import orbits
from trackloom.sources.tables import condition_of, conditions, micros, observations, pools, table

DAY = 86_400_000_000
FRAME_US = 828_170
T0 = 1_704_067_200_000_000
EDGES = [T0 + d * DAY for d in (1, 2, 3, 5, 8, 13, 21)]
VALUE_EDGES = [0.0, 5000.0, 10000.0, 20000.0, 40000.0]

#: Common table expressions of the SQL: observations, runs, visits, tracks, filled events.
OBS = """obs AS (
  SELECT user_id AS plate, CAST(user_id * 100000 + day(ts) // 5 AS BIGINT) AS track, epoch_us(ts) AS t,
         CASE event_type WHEN 'view' THEN -1 WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END AS region,
         CAST(round_even(value * 100, 0) AS BIGINT) AS x, CAST(json_extract_string(props, '$.k') AS BIGINT) AS y,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord
  FROM events)"""


def _runs(name: str, key: str) -> str:
    return f"""{name}0 AS (
  SELECT *, lag(region) OVER w AS prev, lag(t) OVER w AS before, min(ord) OVER (PARTITION BY {key}) AS first_ord FROM obs WINDOW w AS (PARTITION BY {key} ORDER BY ord)),
{name}1 AS (SELECT *, sum(CASE WHEN region IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY ord) AS run FROM {name}0),
{name} AS (
  SELECT plate, {"track, " if key == "track" else ""}run, min(region) AS region, coalesce(arg_min(before, ord), min(t)) AS start_t, max(t) AS end_t, CASE WHEN min(ord) = min(first_ord) THEN NULL ELSE arg_min(prev, ord) END AS prev
  FROM {name}1 GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY plate, " + ("track, " if key == "track" else "") + "run")


RUNS = f"{OBS},\n{_runs('r', 'plate')}"
VISITS = RUNS + ",\nv AS (SELECT plate, start_t, end_t, region FROM r WHERE region >= 0 AND NOT (start_t = 0 AND end_t = 0))"
TRACKS = (
    OBS
    + """,
te AS (SELECT plate, track, min(t) AS t0, max(t) AS t1, arg_min(region, ord) AS r0, arg_max(region, ord) AS r1, count(*) AS n_rows FROM obs GROUP BY plate, track),
g AS (SELECT *, lead(t0) OVER (PARTITION BY plate ORDER BY t0, track) AS nt0, lead(r0) OVER (PARTITION BY plate ORDER BY t0, track) AS nr0 FROM te)"""
)
FILLED = (
    TRACKS
    + ",\n"
    + _runs("q", "track")
    + f""",
f0 AS (
  SELECT plate, start_t * 2 AS s, end_t * 2 AS e, region FROM q
  UNION ALL SELECT plate, start_t * 2, start_t * 2, -1 FROM q WHERE region >= 0 AND prev >= 0
  UNION ALL SELECT plate, t1 * 2, nt0 * 2, r1 FROM g WHERE nt0 IS NOT NULL AND r1 = nr0
  UNION ALL SELECT plate, t1 * 2, t1 + nt0, r1 FROM g WHERE r1 <> nr0 AND nt0 - t1 <= {CONFIG.gap_fill_us}
  UNION ALL SELECT plate, t1 + nt0, nt0 * 2, nr0 FROM g WHERE r1 <> nr0 AND nt0 - t1 <= {CONFIG.gap_fill_us}),
f1 AS (SELECT *, CASE WHEN lag(e) OVER w = s AND lag(region) OVER w = region THEN 0 ELSE 1 END AS fresh FROM f0 WINDOW w AS (PARTITION BY plate ORDER BY s, e, region)),
f2 AS (SELECT *, sum(fresh) OVER (PARTITION BY plate ORDER BY s, e, region ROWS UNBOUNDED PRECEDING) AS island FROM f1),
f AS (SELECT plate, min(s) AS s, max(e) AS e, min(region) AS region FROM f2 GROUP BY plate, island)"""
)
CENSORED = (
    FILLED
    + """,
c0 AS (
  SELECT *, EXISTS (SELECT 1 FROM f b WHERE b.plate = f.plate AND b.e = f.s AND (b.region >= 0) <> (f.region >= 0))
    AND EXISTS (SELECT 1 FROM f b WHERE b.plate = f.plate AND b.s = f.e AND (b.region >= 0) <> (f.region >= 0)) AS uncensored FROM f),
c AS (SELECT *, region >= 0 AND bool_and(uncensored) OVER (PARTITION BY plate, region) AS patch_uncensored FROM c0)"""
)
STEPS = (
    OBS
    + f""",
st AS (
  SELECT *, coalesce(CAST(floor(sqrt(CAST((x - lag(x) OVER w) * (x - lag(x) OVER w) + 10000 * (y - lag(y) OVER w) * (y - lag(y) OVER w) AS DOUBLE)) * 10 + 0.5) AS BIGINT), 0) AS dist,
         t - lag(t) OVER w AS dt, coalesce(track <> lag(track) OVER w, false) AS switched
  FROM obs WINDOW w AS (PARTITION BY plate ORDER BY ord))"""
)
COND = "cond(condition_id, density, layout, n_patches) AS (VALUES " + ", ".join(
    f"({i}, '{d}', '{lay}', {PATCHES[lay]})" for d, by in CONDITIONS.items() for lay, i in by.items()
) + ")"

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        REGISTRY[name] = (f, sql)
        return f

    return add


@query("visit_totals", f"WITH {VISITS} SELECT plate, count(*) AS n_visits, CAST(sum(end_t - start_t) AS BIGINT) AS visit_us FROM v GROUP BY plate")
def visit_totals(spark, d):
    """Number and total time of visits by plate."""
    return ev.visits(observations(spark, d)).groupBy("plate").agg(F.count(F.lit(1)).alias("n_visits"), F.sum(F.col("end") - F.col("start")).alias("visit_us"))


@query("evt01_visits", f"WITH {VISITS} SELECT plate, start_t AS start, end_t AS \"end\", region FROM v")
def evt01(spark, d):
    return ev.visits(observations(spark, d))


@query("evt01_jumps", f"WITH {RUNS} SELECT plate, count(*) FILTER (region >= 0 AND prev >= 0) AS n_jumps FROM r GROUP BY plate")
def evt01_jumps(spark, d):
    return ev.jumps(observations(spark, d))


@query("evt02_run_lengths", f"WITH {RUNS}, n AS (SELECT plate, region, count(*) AS n_runs FROM r GROUP BY plate, region) SELECT * FROM n")
def evt02(spark, d):
    return ev.runs(observations(spark, d)).groupBy("plate", "region").agg(F.count(F.lit(1)).alias("n_runs"))


@query(
    "evt03_track_summary",
    f"WITH {OBS}, {_runs('r', 'track')} SELECT plate, track, CAST(coalesce(sum(end_t - start_t) FILTER (region >= 0), 0) AS BIGINT) AS visit_us, count(*) FILTER (region >= 0) AS n_visits, count(DISTINCT region) FILTER (region >= 0) AS n_regions FROM r GROUP BY plate, track",
)
def evt03(spark, d):
    """Visits of each track: total time, number, distinct regions."""
    inside = F.col("region") >= 0
    return ev.runs(observations(spark, d), "track").groupBy("plate", "track").agg(
        F.coalesce(F.sum(F.when(inside, F.col("end") - F.col("start"))), F.lit(0)).alias("visit_us"),
        F.count_if(inside).alias("n_visits"),
        F.count_distinct(F.when(inside, F.col("region"))).alias("n_regions"),
    )


@query(
    "evt04_side_speeds",
    f"""WITH {OBS}, s AS (SELECT plate, track, region >= 0 AS inside, CAST(floor(sqrt(CAST((x - lag(x) OVER w) * (x - lag(x) OVER w) + 10000 * (y - lag(y) OVER w) * (y - lag(y) OVER w) AS DOUBLE)) * 10 + 0.5) AS BIGINT) AS d, t - lag(t) OVER w AS dt FROM obs WINDOW w AS (PARTITION BY track ORDER BY ord))
SELECT plate, track, CAST(sum(d) FILTER (inside) AS DOUBLE) / CAST(greatest(1, sum(dt) FILTER (inside)) AS DOUBLE) AS speed_in, CAST(sum(d) FILTER (NOT inside) AS DOUBLE) / CAST(greatest(1, sum(dt) FILTER (NOT inside)) AS DOUBLE) AS speed_out FROM s GROUP BY plate, track""",
)
def evt04(spark, d):
    return kin.side_speeds(observations(spark, d))


@query("evt07_filled_events", f"WITH {FILLED} SELECT plate, s AS start2, e AS end2, region FROM f")
def evt07(spark, d):
    return ev.filled_events(observations(spark, d))


@query(
    "evt08_gap_quality",
    f"""WITH {TRACKS}, h AS (SELECT plate, nt0 - t1 AS gap, coalesce(r1 <> nr0, false) AS bad FROM g)
SELECT plate, count(gap) AS n_gaps, count(*) FILTER (bad) AS n_bad, CAST(coalesce(sum(gap) FILTER (bad), 0) AS BIGINT) AS bad_us, count(*) FILTER (bad AND gap >= {CONFIG.long_gap_us}) AS n_long_bad, CAST(coalesce(sum(gap) FILTER (bad AND gap >= {CONFIG.long_gap_us}), 0) AS BIGINT) AS long_bad_us FROM h GROUP BY plate""",
)
def evt08(spark, d):
    return ev.gap_quality(observations(spark, d))


@query("evt09_censoring", f"WITH {CENSORED} SELECT plate, s AS start2, e AS end2, region, uncensored, patch_uncensored FROM c")
def evt09(spark, d):
    return ev.censored(ev.filled_events(observations(spark, d)))


@query(
    "evt11_plate_table",
    f"""WITH {FILLED}, o AS (SELECT plate, max(t) - min(t) AS video_us, count(*) AS n_rows, count(DISTINCT track) - 1 AS n_gaps FROM obs GROUP BY plate)
SELECT o.plate, video_us, n_rows, n_gaps, CAST(coalesce(sum(e - s) FILTER (region >= 0), 0) AS BIGINT) AS visit_us2, CAST(coalesce(sum(e - s) FILTER (region < 0), 0) AS BIGINT) AS transit_us2, count(*) FILTER (region >= 0) AS n_visits
FROM o JOIN f USING (plate) GROUP BY o.plate, video_us, n_rows, n_gaps""",
)
def evt11(spark, d):
    """One row per plate: recording time, rows, gaps, visit and transit time of the filled events."""
    o = observations(spark, d)
    base = o.groupBy("plate").agg((F.max("t") - F.min("t")).alias("video_us"), F.count(F.lit(1)).alias("n_rows"), (F.count_distinct("track") - 1).alias("n_gaps"))
    inside, long_ = F.col("region") >= 0, F.col("end2") - F.col("start2")
    sums = ev.filled_events(o).groupBy("plate").agg(
        F.coalesce(F.sum(F.when(inside, long_)), F.lit(0)).alias("visit_us2"),
        F.coalesce(F.sum(F.when(~inside, long_)), F.lit(0)).alias("transit_us2"),
        F.count_if(inside).alias("n_visits"),
    )
    return base.join(sums, "plate")


MERGED = f"""m0 AS (SELECT *, abs(start_t - lag(end_t) OVER w) < {CONFIG.merge_gap_us} AS near, lag(end_t) OVER w AS last_end FROM v WINDOW w AS (PARTITION BY plate, region ORDER BY start_t, end_t)),
m1 AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY plate, region ORDER BY start_t, end_t ROWS UNBOUNDED PRECEDING) AS island FROM m0)"""


@query(
    "evt12_merged_visits",
    f"""WITH {VISITS}, {MERGED} SELECT plate, region, min(start_t) AS start, max(end_t) AS "end", count(*) FILTER (near) AS n_excursions, CAST(coalesce(sum(start_t - last_end) FILTER (near), 0) AS BIGINT) AS out_us FROM m1 GROUP BY plate, region, island""",
)
def evt12(spark, d):
    return ev.merged_visits(ev.visits(observations(spark, d)))


@query(
    "evt14_leaving_times",
    f"""WITH {VISITS}, {MERGED}, l0 AS (SELECT plate, region, island, start_t, end_t, start_t // 1000000 AS s, end_t // 1000000 AS e, CASE WHEN near THEN last_end // 1000000 END AS pe FROM m1),
l1 AS (SELECT *, first_value(s) OVER w AS f, coalesce(s - pe + 1, 0) AS o, lead(s) OVER w AS ns FROM l0 WINDOW w AS (PARTITION BY plate, region, island ORDER BY start_t, end_t)),
l2 AS (SELECT *, CAST(sum(o) OVER (PARTITION BY plate, region, island ORDER BY start_t, end_t) AS BIGINT) AS oo FROM l1)
SELECT plate, region, start_t AS start, CASE WHEN ns IS NOT NULL THEN e - f + 1 - oo ELSE e - f + 1 END AS leaving_s FROM l2""",
)
def evt14(spark, d):
    return ev.leaving_times(ev.visits(observations(spark, d)))


@query(
    "evt16_transit_kinds",
    f"""WITH {FILLED}, k AS (SELECT *, last_value(CASE WHEN region >= 0 THEN region END IGNORE NULLS) OVER (PARTITION BY plate ORDER BY s, e, region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf,
 first_value(CASE WHEN region >= 0 THEN region END IGNORE NULLS) OVER (PARTITION BY plate ORDER BY s, e, region ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cm FROM f)
SELECT plate, s AS start2, e AS end2, CASE WHEN lf IS NULL OR cm IS NULL THEN 'edge' WHEN lf = cm THEN 'same' ELSE 'cross' END AS kind FROM k WHERE region = -1""",
)
def evt16(spark, d):
    return ev.transit_kinds(ev.filled_events(observations(spark, d)))


@query(
    "evt17_hard_cut",
    f"""WITH {RUNS}, l AS (SELECT plate, greatest(start_t, {T0 + DAY}) AS s, end_t AS e, region FROM r WHERE end_t > {T0 + DAY}),
x AS (SELECT *, e - s AS dur, sum(e - s) OVER (PARTITION BY plate ORDER BY s, e, region ROWS UNBOUNDED PRECEDING) AS so, sum(e - s) OVER (PARTITION BY plate) AS whole FROM l)
SELECT plate, s AS start, CAST(e - greatest(0, so - {CONFIG.cut_us}) AS BIGINT) AS "end", region FROM x WHERE whole >= {CONFIG.cut_us} AND so - dur < {CONFIG.cut_us}""",
)
def evt17(spark, d):
    return ev.hard_cut(ev.runs(observations(spark, d)).select("plate", "start", "end", "region"), T0 + DAY, CONFIG.cut_us)


@query(
    "evt22_visit_ranks",
    f"""WITH {VISITS} SELECT plate, region, start_t AS start, end_t - start_t AS dur, row_number() OVER h AS visit_rank,
 CAST(coalesce(sum(end_t - start_t) OVER (PARTITION BY plate, region ORDER BY start_t, end_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_before,
 lag(region) OVER p AS prev_region, start_t - lag(end_t) OVER p AS pause FROM v WINDOW h AS (PARTITION BY plate, region ORDER BY start_t, end_t), p AS (PARTITION BY plate ORDER BY start_t, end_t, region)""",
)
def evt22(spark, d):
    return ev.ranked(ev.visits(observations(spark, d)))


@query(
    "evt25_discovery",
    f"WITH {VISITS}, fst AS (SELECT plate, region, min(start_t) AS found FROM v GROUP BY plate, region), ed AS (SELECT unnest({EDGES}) AS edge) SELECT plate, edge, count(*) AS n_found FROM fst JOIN ed ON edge >= found GROUP BY plate, edge",
)
def evt25(spark, d):
    return ev.discovery(ev.visits(observations(spark, d)), EDGES)


@query("evt39_overlaps", """WITH iv AS (SELECT o_custkey AS plate, epoch_us(o_orderdate) AS s, max(epoch_us(l_shipdate)) AS e, o_orderkey AS region FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderdate, o_orderkey),
n AS (SELECT *, lead(s) OVER (PARTITION BY plate ORDER BY s, e, region) AS nx FROM iv)
SELECT plate, count(*) FILTER (e > nx) AS n_overlaps, count(*) FILTER (e < s) AS n_negative FROM n GROUP BY plate""")
def evt39(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    last = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(micros(F.col("l_shipdate"))).alias("end"))
    iv = o.join(last, "o_orderkey").select(F.col("o_custkey").alias("plate"), micros(F.col("o_orderdate")).alias("start"), "end", F.col("o_orderkey").alias("region"))
    return ev.overlaps(iv)


@query("evt41_visited_regions", f"WITH {VISITS} SELECT plate, count(DISTINCT region) AS n_regions FROM v GROUP BY plate")
def evt41(spark, d):
    return ev.visits(observations(spark, d)).groupBy("plate").agg(F.count_distinct("region").alias("n_regions"))


@query(
    "evt42_transitions",
    f"""WITH {VISITS}, mv AS (SELECT region AS src, lead(region) OVER (PARTITION BY plate ORDER BY start_t, end_t, region) AS dst FROM v), n AS (SELECT src, dst, count(*) AS n FROM mv WHERE dst IS NOT NULL GROUP BY src, dst)
SELECT src, dst, n, n / sum(n) OVER (PARTITION BY src) AS p FROM n""",
)
def evt42(spark, d):
    return ev.transitions(ev.visits(observations(spark, d)))


@query(
    "trj01_clock_repair",
    f"""WITH {OBS}, b AS (SELECT plate, ord, CASE WHEN ord % 17 = 0 THEN t - {DAY} ELSE t END AS t FROM obs), s AS (SELECT *, t - lag(t) OVER w AS step FROM b WINDOW w AS (PARTITION BY plate ORDER BY ord)),
m AS (SELECT *, coalesce(bool_or(step < 0) OVER (PARTITION BY plate), false) AS reset FROM s)
SELECT plate, ord, CAST(CASE WHEN reset THEN sum(CASE WHEN step < 0 THEN {FRAME_US} ELSE coalesce(step, 0) END) OVER (PARTITION BY plate ORDER BY ord) ELSE t END AS BIGINT) AS t, reset FROM m""",
)
def trj01(spark, d):
    """Clock repair on observations of which every 17th is set back a day."""
    o = observations(spark, d).withColumn("t", F.when(F.col("ord") % 17 == 0, F.col("t") - DAY).otherwise(F.col("t")))
    return kin.repair_clock(o, FRAME_US).select("plate", "ord", "t", "reset")


@query("trj02_steps", f"WITH {STEPS} SELECT plate, ord, dist, dt, switched FROM st")
def trj02(spark, d):
    return kin.steps(observations(spark, d)).select("plate", "ord", "dist", "dt", "switched")


@query("trj03_speeds", f"WITH {STEPS} SELECT plate, ord, CAST(dist AS DOUBLE) / CAST(greatest(coalesce(dt, {FRAME_US}), 1000) AS DOUBLE) AS speed FROM st")
def trj03(spark, d):
    return kin.speeds(observations(spark, d), FRAME_US).select("plate", "ord", "speed")


@query("trj10_coverage", f"WITH {STEPS} SELECT plate, count(*) / max(ord) AS coverage, sum(dt) / count(dt) AS mean_dt, count(*) FILTER (switched) AS n_switches FROM st GROUP BY plate")
def trj10(spark, d):
    return kin.coverage(observations(spark, d))


@query(
    "trj04_smoothing",
    f"""WITH RECURSIVE {OBS}, sw AS (SELECT *, CASE WHEN track <> lag(track) OVER (PARTITION BY plate ORDER BY ord) THEN 1 ELSE 0 END AS switched FROM obs),
nx AS (SELECT a.plate, a.ord, min(b.ord) AS nxt FROM obs a JOIN obs b ON a.plate = b.plate AND b.ord > a.ord AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) > 4000 * 4000 GROUP BY a.plate, a.ord),
k AS (SELECT DISTINCT plate, CAST(1 AS BIGINT) AS ord FROM obs UNION ALL SELECT nx.plate, nx.nxt FROM k JOIN nx ON k.plate = nx.plate AND k.ord = nx.ord),
c AS (SELECT k.plate, k.ord, o.x, o.y, lead(k.ord) OVER w AS b, lead(o.x) OVER w AS bx, lead(o.y) OVER w AS bty FROM k JOIN obs o ON o.plate = k.plate AND o.ord = k.ord WINDOW w AS (PARTITION BY k.plate ORDER BY k.ord)),
r AS (SELECT o.plate, o.ord, CAST(o.x AS DOUBLE) AS x, CAST(o.y AS DOUBLE) AS y, c.ord AS a, c.x AS ax, c.y AS ay, b, bx, bty, coalesce((SELECT sum(s.switched) FROM sw s WHERE s.plate = o.plate AND s.ord > c.ord AND s.ord < c.b), 0) > 0 AS cut
  FROM obs o ASOF JOIN c ON o.plate = c.plate AND o.ord >= c.ord)
SELECT plate, ord, CASE WHEN ord = a OR b IS NULL OR cut THEN x ELSE ax + (ord - a) / (b - a) * (bx - ax) END AS sx, CASE WHEN ord = a OR b IS NULL OR cut THEN y ELSE ay + (ord - a) / (b - a) * (bty - ay) END AS sy, ord <> a AND NOT cut AS is_smoothed FROM r""",
)
def trj04(spark, d):
    """Smoothed positions; in SQL, the rows kept are what the first row of a plate leads to, from each row to the next far one."""
    return kin.smooth(observations(spark, d), 4000.0)


@query("trj04_kept_orbits", REGISTRY["trj04_smoothing"][1].split("\nc AS (")[0].rstrip(",") + "\nSELECT plate, ord FROM k")
def trj04_orbits(spark, d):
    """The rows that smoothing keeps, found in parallel within plates."""
    return orbits.kept_orbit(observations(spark, d), 4000.0, 32).where("kept").select("plate", "ord")


@query(
    "fil02_plate_quality",
    f"""WITH {TRACKS}, h AS (SELECT plate, coalesce(sum(nt0 - t1) FILTER (r1 <> nr0), 0) AS bad_us FROM g GROUP BY plate), o AS (SELECT plate, max(t) - min(t) AS video_us, count(*) AS n_rows FROM obs GROUP BY plate)
SELECT plate, video_us, n_rows FROM o JOIN h USING (plate) WHERE video_us >= {25 * DAY} AND bad_us <= {5 * DAY}""",
)
def fil02(spark, d):
    """Plates of long recordings with little time in gaps between different regions."""
    o = observations(spark, d)
    base = o.groupBy("plate").agg((F.max("t") - F.min("t")).alias("video_us"), F.count(F.lit(1)).alias("n_rows"))
    good = ev.gap_quality(o).where(F.col("bad_us") <= 5 * DAY).select("plate")
    return base.where(F.col("video_us") >= 25 * DAY).join(good, "plate", "left_semi")


@query("fil09_first_visits", f"WITH {VISITS} SELECT plate, region, min(start_t) AS start FROM v GROUP BY plate, region")
def fil09(spark, d):
    return ev.visits(observations(spark, d)).groupBy("plate", "region").agg(F.min("start").alias("start"))


@query("win05_trailing_share", f"WITH {OBS} SELECT plate, ord, sum(CASE WHEN region >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY plate ORDER BY ord RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) / 10 AS share FROM obs")
def win05(spark, d):
    return kin.trailing_share(observations(spark, d), 10)


@query(
    "jon05_interval_join",
    f"""WITH {VISITS}, iv AS (SELECT row_number() OVER (PARTITION BY plate ORDER BY start_t, end_t, region) AS k, * FROM v) SELECT iv.plate, k, count(*) AS n_obs, CAST(sum(x) AS BIGINT) AS sum_x FROM iv JOIN obs o ON o.plate = iv.plate AND o.t BETWEEN start_t AND end_t GROUP BY iv.plate, k""",
)
def jon05(spark, d):
    """Observations within each visit: equal plates and shared time buckets, then the exact range."""
    o = observations(spark, d).select("plate", "t", "x").withColumn("bucket", F.floor(F.col("t") / DAY))
    order = Window.partitionBy("plate").orderBy("start", "end", "region")
    v = ev.visits(observations(spark, d)).withColumn("k", F.row_number().over(order).cast("long"))
    v = v.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / DAY), F.floor(F.col("end") / DAY)))).drop("region")
    hits = v.join(o, ["plate", "bucket"]).where(F.col("t").between(F.col("start"), F.col("end")))
    return hits.groupBy("plate", "k").agg(F.count(F.lit(1)).alias("n_obs"), F.sum("x").alias("sum_x"))


@query(
    "jon06_nearest_time",
    f"""WITH {OBS}, q AS (SELECT DISTINCT plate, unnest({EDGES}) AS stamp FROM obs), c AS (SELECT q.plate, stamp, o.ord, abs(o.t - stamp) AS gap FROM q JOIN obs o ON o.plate = q.plate)
SELECT plate, stamp, arg_min(ord, gap * 1000000 + ord) AS ord, min(gap) AS gap FROM c GROUP BY plate, stamp""",
)
def jon06(spark, d):
    """The observation nearest to each of a few times, the earlier of ties: one pass over sorted stamps of both."""
    o = observations(spark, d).select("plate", "t", "ord")
    q = o.select("plate").distinct().withColumn("t", F.explode(F.array(*[F.lit(e) for e in EDGES]))).withColumn("ord", F.lit(None).cast("long"))
    both = o.unionByName(q).withColumn("seen", F.when(F.col("ord").isNotNull(), F.struct("t", "ord")))
    order = Window.partitionBy("plate").orderBy("t", F.col("ord").asc_nulls_last())
    back = F.last("seen", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    turned = Window.partitionBy("plate").orderBy(F.desc("t"), F.col("ord").desc_nulls_first())
    on = F.last("seen", True).over(turned.rowsBetween(Window.unboundedPreceding, -1))
    near = both.withColumns({"b": back, "n": on}).where("ord is null")
    low, high = F.col("t") - F.col("b.t"), F.col("n.t") - F.col("t")
    pick = low.isNotNull() & (high.isNull() | (low <= high))
    # equal stamps: the first of them stands for the time
    first = o.groupBy("plate", F.col("t").alias("_t")).agg(F.min("ord").alias("ord"))
    hit = near.select("plate", F.col("t").alias("stamp"), F.when(pick, F.col("b.t")).otherwise(F.col("n.t")).alias("_t"), F.when(pick, low).otherwise(high).alias("gap"))
    return hit.join(first, ["plate", "_t"]).select("plate", "stamp", "ord", "gap")


@query(
    "agg01_condition_means",
    f"""WITH {VISITS}, {COND}, p AS (SELECT plate, sum(end_t - start_t) AS us, count(*) AS n, count(DISTINCT region) AS k FROM v GROUP BY plate)
SELECT condition_id, count(*) AS n_plates, CAST(sum(n) AS BIGINT) / count(*) AS mean_visits, sum(k / n_patches) / count(*) AS mean_share FROM p JOIN cond ON condition_id = plate % 8 GROUP BY condition_id""",
)
def agg01(spark, d):
    """Two levels: a value by plate first, then means by condition."""
    per_plate = ev.visits(observations(spark, d)).groupBy("plate").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("region").alias("k"))
    c = F.broadcast(conditions(spark))
    joined = per_plate.withColumn("condition_id", condition_of(F.col("plate"))).join(c, "condition_id")
    return joined.groupBy("condition_id").agg(
        F.count(F.lit(1)).alias("n_plates"), (F.sum("n") / F.count(F.lit(1))).alias("mean_visits"), (F.sum(F.col("k") / F.col("n_patches")) / F.count(F.lit(1))).alias("mean_share")
    )


@query(
    "agg15_pools",
    f"""WITH {VISITS}, {COND}, pl AS (SELECT unnest(['all', density, layout, layout || ' ' || density]) AS pool, condition_id FROM cond), p AS (SELECT plate, count(*) AS n FROM v GROUP BY plate)
SELECT pool, count(*) AS n_plates, CAST(sum(n) AS BIGINT) AS n_visits FROM p JOIN pl ON condition_id = plate % 8 GROUP BY pool""",
)
def agg15(spark, d):
    """A plate counts in every pool that holds its condition."""
    per_plate = ev.visits(observations(spark, d)).groupBy("plate").agg(F.count(F.lit(1)).alias("n"))
    joined = per_plate.withColumn("condition_id", condition_of(F.col("plate"))).join(F.broadcast(pools(spark)), "condition_id")
    return joined.groupBy("pool").agg(F.count(F.lit(1)).alias("n_plates"), F.sum("n").alias("n_visits"))


@query("bin01_binned_means", f"WITH {OBS}, b AS (SELECT greatest(len(list_filter({VALUE_EDGES}, lambda e: e < x)) - 1, 0) AS bin, y FROM obs) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, sum(y) / count(y) AS mean_y FROM b GROUP BY bin")
def bin01(spark, d):
    return stats.binned_means(observations(spark, d), "x", "y", VALUE_EDGES)


@query("bin05_histogram", f"WITH {OBS} SELECT CAST(floor(x / 2500) AS BIGINT) AS bin, count(*) AS n FROM obs GROUP BY 1")
def bin05(spark, d):
    return stats.histogram(observations(spark, d), "x", 2500)


@query("bin08_clamped_matrix", f"WITH {OBS} SELECT least(x, 30000) AS a, least(y, 30000) AS b, count(*) AS n FROM obs GROUP BY 1, 2")
def bin08(spark, d):
    return stats.clamped_matrix(observations(spark, d), "x", "y", 30000)


@query("sta05_percentiles", f"WITH {VISITS} SELECT region, round(quantile_cont(end_t - start_t, 0.15), 3) AS p15, round(median(end_t - start_t), 3) AS med FROM v GROUP BY region")
def sta05(spark, d):
    v = ev.visits(observations(spark, d)).withColumn("dur", F.col("end") - F.col("start"))
    return stats.exact_percentiles(v, "region", "dur", [0.15, 0.5]).select("region", F.round("p0", 3).alias("p15"), F.round("p1", 3).alias("med"))


@query("sta03_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(pow(corr(l_quantity, l_extendedprice), 2), 6) AS r2 FROM lineitem GROUP BY l_returnflag")
def sta03(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
        F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"),
        F.round(F.pow(F.corr("l_quantity", "l_extendedprice"), 2), 6).alias("r2"),
    )


@query("set_distinct_regions", f"WITH {OBS} SELECT DISTINCT plate, region FROM obs WHERE region >= 0 EXCEPT SELECT plate, region FROM obs WHERE ord = 1")
def set04(spark, d):
    """Regions of a plate other than the one of its first row."""
    o = observations(spark, d)
    return o.where("region >= 0").select("plate", "region").subtract(o.where("ord = 1").select("plate", "region"))


@query(
    "geo16_nearest_neighbours",
    f"""WITH pt AS (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS cx, avg(CAST(embedding[2] AS DOUBLE)) AS cy FROM embeddings GROUP BY label),
ds AS (SELECT a.label AS src, b.label AS dst, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS dist FROM pt a JOIN pt b ON a.label <> b.label),
m AS (SELECT *, min(dist) OVER (PARTITION BY src) AS least FROM ds)
SELECT src, dst, round(dist, 6) AS dist FROM m WHERE dist <= {CONFIG.neighbour_factor} * least""",
)
def geo16(spark, d):
    """Region centres within 1.3 times the nearest one's distance; centres are one row per region."""
    pt = table(spark, d, "embeddings").groupBy(F.col("label").alias("region")).agg(
        F.avg(F.col("embedding")[0].cast("double")).alias("cx"), F.avg(F.col("embedding")[1].cast("double")).alias("cy")
    )
    return cv.neighbours(pt, CONFIG.neighbour_factor).select("src", "dst", F.round("d", 6).alias("dist"))


@query(
    "mod03_optimal_visit",
    f"""WITH {VISITS}, n AS (SELECT plate, lead(start_t) OVER (PARTITION BY plate ORDER BY start_t, end_t, region) - end_t AS gap FROM v), tv AS (SELECT plate, CAST(sum(gap) AS BIGINT) / count(gap) / 3.6e9 AS travel FROM n GROUP BY plate HAVING count(gap) > 0),
ir AS (SELECT plate, tau, dur, tau * (1 - exp(-dur / tau)) / (dur + travel) AS rate FROM tv, (SELECT unnest(range(1, 401)) AS dur), (VALUES (50.0::DOUBLE), (100.0::DOUBLE), (200.0::DOUBLE)) x(tau))
SELECT plate, tau, arg_max(dur, rate) AS best_h, round(max(rate), 9) AS best_rate FROM ir GROUP BY plate, tau""",
)
def mod03(spark, d):
    """Visit length, in hours, with the highest mean intake under exponential depletion for each plate's mean travel, by a grid of lengths."""
    order = Window.partitionBy("plate").orderBy("start", "end", "region")
    gaps = ev.visits(observations(spark, d)).select("plate", (F.lead("start").over(order) - F.col("end")).alias("gap")).where("gap is not null")
    travel = gaps.groupBy("plate").agg((F.sum("gap") / F.count("gap") / 3.6e9).alias("travel"))
    grid = travel.withColumn("dur", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(400).cast("long")))).withColumn("tau", F.explode(F.array(F.lit(50.0), F.lit(100.0), F.lit(200.0))))
    rate = F.col("tau") * (1 - F.exp(-F.col("dur") / F.col("tau"))) / (F.col("dur") + F.col("travel"))
    return grid.withColumn("rate", rate).groupBy("plate", "tau").agg(F.max_by("dur", "rate").alias("best_h"), F.round(F.max("rate"), 9).alias("best_rate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
