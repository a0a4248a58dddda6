"""Queries on models, tests and dimension joins, with their SQL where results aren't random."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import resampling, stats
from trackloom.operators import events as ev
from trackloom.operators import kinematics as kin
from trackloom.operators import models as md
from trackloom.plans.catalog import COND, FRAME_US, OBS, STEPS, VISITS, query
from trackloom.plans.intervals import splits
from trackloom.sources.tables import condition_of, conditions, observations, table


@query(
    "mod01_stay_lengths",
    f"""WITH {VISITS}, g AS (SELECT CAST(plate % 8 AS INTEGER) AS condition_id, (end_t - start_t) // 3600000000 AS spent, tau, thr FROM v, (SELECT unnest([50.0, 100.0, 200.0]::DOUBLE[]) AS tau), (SELECT unnest([0.05, 0.1, 0.5]::DOUBLE[]) AS thr))
SELECT condition_id, tau, thr, count(*) AS n, round(avg(exp(-spent / tau)), 9) AS rate, CAST(sum(greatest(0, CAST(trunc(-tau * ln(thr) - spent) AS BIGINT))) AS BIGINT) AS stay_h FROM g GROUP BY condition_id, tau, thr""",
)
def mod01(spark, d):
    """Feeding rate at the end of observed visits, in hours, and how much longer each would stay until the rate falls to a threshold."""
    g = ev.visits(observations(spark, d)).select(condition_of(F.col("plate")).alias("condition_id"), F.floor((F.col("end") - F.col("start")) / 3_600_000_000).cast("long").alias("spent"))
    for name, values in (("tau", [50.0, 100.0, 200.0]), ("thr", [0.05, 0.1, 0.5])):
        g = g.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    rate, stay = md.feeding_rate(F.col("spent"), F.col("tau")), md.stay_length(F.col("tau"), F.col("thr"), F.col("spent"))
    return g.groupBy("condition_id", "tau", "thr").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(rate), 9).alias("rate"), F.sum(stay).alias("stay_h"))


SCALES = [1.0, 3.0, 10.0, 30.0, 100.0]
STEPS_OF_FIT = 3


def _fit_sql() -> str:
    """Gauss-Newton steps written out, one after another, from the best of a few scales."""
    out = """t0 AS (SELECT g, arg_min(a, {'l': l, 's': s}) AS a, arg_min(b, {'l': l, 's': s}) AS b, arg_min(s, {'l': l, 's': s}) AS s FROM (
  SELECT g, s, count(*) AS n, regr_slope(y, e) AS b, regr_intercept(y, e) AS a, round(regr_syy(y, e) - regr_slope(y, e) * regr_sxy(y, e), 9) AS l, regr_syy(y, e) AS syy FROM (SELECT g, t, y, s, -exp(-t / s) AS e FROM pt, (SELECT unnest([%s]::DOUBLE[]) AS s)) GROUP BY g, s) WHERE n >= 4 AND syy > 0 AND b IS NOT NULL GROUP BY g)""" % ", ".join(map(str, SCALES))
    for k in range(STEPS_OF_FIT):
        det = lambda a: f"({a[0]} * ({a[4]} * {a[8]} - {a[5]} * {a[7]}) + {a[1]} * ({a[5]} * {a[6]} - {a[3]} * {a[8]}) + {a[2]} * ({a[3]} * {a[7]} - {a[4]} * {a[6]}))"
        m = ["m00 * 1.001", "m01", "m02", "m01", "m11 * 1.001", "m12", "m02", "m12", "m22 * 1.001"]
        move = [det([f"v{i // 3}" if i % 3 == c else m[i] for i in range(9)]) + " / nullif(" + det(m) + ", 0)" for c in range(3)]
        out += f""",
j{k} AS (SELECT g, a, b, s, -exp(-t / s) AS d1, -b * exp(-t / s) * t / (s * s) AS d2, y - (a - b * exp(-t / s)) AS f FROM pt JOIN t{k} USING (g)),
n{k} AS (SELECT g, any_value(a) AS a, any_value(b) AS b, any_value(s) AS s, count(*)::DOUBLE AS m00, sum(d1) AS m01, sum(d2) AS m02, sum(d1 * d1) AS m11, sum(d1 * d2) AS m12, sum(d2 * d2) AS m22, sum(f) AS v0, sum(d1 * f) AS v1, sum(d2 * f) AS v2 FROM j{k} GROUP BY g),
t{k + 1} AS (SELECT g, CAST(m00 AS BIGINT) AS n, a + coalesce({move[0]}, 0) AS a, b + coalesce({move[1]}, 0) AS b, least(greatest(s + coalesce({move[2]}, 0), s / 3), s * 3) AS s FROM n{k})"""
    return out


@query(
    "mod06_recovery",
    f"""WITH {STEPS}, le AS (SELECT *, last_value(CASE WHEN region >= 0 THEN t END IGNORE NULLS) OVER (PARTITION BY plate ORDER BY ord ROWS UNBOUNDED PRECEDING) AS gone FROM st),
pt AS (SELECT CAST(plate % 8 AS INTEGER) AS g, (t - gone) / 3.6e9 AS t, dist / greatest(coalesce(dt, {FRAME_US}), 3600000000) * 3.6e6 AS y FROM le WHERE region = -1 AND gone IS NOT NULL),
{_fit_sql()} SELECT g AS condition_id, n, round(a - b, 2) AS low, round(a, 2) AS high, round(s, 3) AS scale_h FROM t{STEPS_OF_FIT}""",
)
def mod06(spark, d):
    """How speed outside recovers with the hours since the last row inside, fitted by condition."""
    o = kin.speeds(md.since_exit(observations(spark, d)), FRAME_US, 3_600_000_000).where("region = -1 and since_us is not null")
    p = o.select(condition_of(F.col("plate")).alias("condition_id"), (F.col("since_us") / 3.6e9).alias("t"), (F.col("speed") * 3.6e6).alias("y"))
    f = md.recovery_fit(p, "condition_id", "t", "y", SCALES, STEPS_OF_FIT)
    return f.select("condition_id", "n", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), F.round("scale", 3).alias("scale_h"))


EXCHANGE = 6


@query(
    "jon11_exchanged_behaviour",
    f"""WITH RECURSIVE {VISITS}, w AS (SELECT CAST(plate % 8 AS INTEGER) AS g, region, row_number() OVER o AS nth, least(row_number() OVER o, 4) AS rank, end_t - start_t AS stay, lead(region) OVER o AS dst, lead(start_t) OVER o - end_t AS travel FROM v WINDOW o AS (PARTITION BY plate ORDER BY start_t, end_t, region)),
sh AS (SELECT g, rank, region, dst, n / al AS p FROM (SELECT g, rank, region, dst, count(*) AS n, sum(count(*)) OVER (PARTITION BY g, rank, region) AS al FROM w GROUP BY g, rank, region, dst) WHERE dst IS NOT NULL),
it AS (SELECT g, 1 AS k, region, count(*) / sum(count(*)) OVER (PARTITION BY g) AS m FROM w WHERE nth = 1 GROUP BY g, region
  UNION ALL SELECT it.g, any_value(it.k) + 1, sh.dst, sum(m * p) FROM it JOIN sh ON sh.g = it.g AND sh.region = it.region AND sh.rank = least(it.k, 4) WHERE it.k < {EXCHANGE} GROUP BY it.g, sh.dst),
se AS (SELECT g, region, sum(m) AS m FROM it GROUP BY g, region), fl AS (SELECT it.g, it.region, sh.dst, sum(m * p) AS m FROM it JOIN sh ON sh.g = it.g AND sh.region = it.region AND sh.rank = least(it.k, 4) WHERE it.k < {EXCHANGE} GROUP BY ALL),
sy AS (SELECT g, region, avg(stay) AS us FROM w GROUP BY g, region), tr AS (SELECT g, region, dst, avg(travel) AS us FROM w WHERE dst IS NOT NULL GROUP BY ALL),
a AS (SELECT se.g AS moves_of, sy.g AS stays_of, sum(m * us) AS stay_us FROM se JOIN sy USING (region) GROUP BY 1, 2), b AS (SELECT fl.g AS moves_of, tr.g AS stays_of, sum(m * us) AS travel_us FROM fl JOIN tr USING (region, dst) GROUP BY 1, 2),
c AS (SELECT g AS moves_of, sum(m) AS visits FROM se GROUP BY g)
SELECT moves_of, stays_of, round(visits, 9) AS visits, round(stay_us, 0) AS stay_us, round(coalesce(travel_us, 0), 0) AS travel_us FROM a LEFT JOIN b USING (moves_of, stays_of) JOIN c USING (moves_of)""",
)
def jon11(spark, d):
    """Expected visits and times of plates that move like one condition and stay like another, over their first visits."""
    v = ev.visits(observations(spark, d)).withColumn("condition_id", condition_of(F.col("plate")))
    x = md.exchanged_behaviour(v, "condition_id", 4, EXCHANGE)
    return x.select("moves_of", "stays_of", F.round("visits", 9).alias("visits"), F.round("stay_us", 0).alias("stay_us"), F.round("travel_us", 0).alias("travel_us"))


@query(
    "mod12_revisit_shares",
    f"""WITH {VISITS}, mv AS (SELECT region AS src, lead(region) OVER (PARTITION BY plate ORDER BY start_t, end_t, region) AS dst FROM v), n AS (SELECT src, dst, count(*) AS n FROM mv WHERE dst IS NOT NULL GROUP BY src, dst),
p AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM n), o AS (SELECT *, sum(CASE WHEN src <> dst THEN p ELSE 0 END) OVER (PARTITION BY src) AS o, bool_or(src = dst) OVER (PARTITION BY src) AS slf FROM p)
SELECT src, dst, round(CASE WHEN o = 0 OR NOT slf THEN p WHEN src = dst THEN 0.25 ELSE p * 0.75 / o END, 9) AS p_new FROM o""",
)
def mod12(spark, d):
    """Transition shares with a quarter of moves back to the same region."""
    return md.with_revisits(ev.transitions(ev.visits(observations(spark, d))), 0.25).select("src", "dst", F.round("p_new", 9).alias("p_new"))


@query(
    "mod02_intake_rates",
    f"""WITH {VISITS}, st AS (SELECT CAST(plate % 8 AS INTEGER) AS grp, tau, (end_t - start_t) / 1e6 AS dur_s FROM v, (SELECT unnest([3600.0, 86400.0, 864000.0]::DOUBLE[]) AS tau))
SELECT grp AS condition_id, tau, count(*) AS n, round(sum(tau * (1 - exp(-dur_s / tau))) / (sum(dur_s) + count(*) * 600.0), 9) AS rate FROM st GROUP BY grp, tau""",
)
def mod02(spark, d):
    """Intake rate that the observed stays of a condition give, for several rates of depletion."""
    stays = ev.visits(observations(spark, d)).select(condition_of(F.col("plate")).alias("grp"), ((F.col("end") - F.col("start")) / 1e6).alias("dur_s"))
    return md.intake_rates(stays, [3600.0, 86400.0, 864000.0], 600.0).select(F.col("grp").alias("condition_id"), "tau", "n", F.round("rate", 9).alias("rate"))


@query(
    "mod05_turns",
    f"""WITH {OBS}, w1 AS (SELECT plate, track, ord, x - lag(x) OVER w AS dx, (y - lag(y) OVER w) * 100 AS dy FROM obs WINDOW w AS (PARTITION BY plate, track ORDER BY ord)),
w2 AS (SELECT *, lag(dx) OVER w AS px, lag(dy) OVER w AS py FROM w1 WINDOW w AS (PARTITION BY plate, track ORDER BY ord))
SELECT plate, CAST(floor(degrees(atan2((px * dy - py * dx)::DOUBLE, (px * dx + py * dy)::DOUBLE)) / 30) AS BIGINT) AS bin, count(*) AS n, CAST(sum(floor(sqrt((dx * dx + dy * dy)::DOUBLE) + 0.5)) AS BIGINT) AS sum_step
FROM w2 WHERE (dx <> 0 OR dy <> 0) AND (px <> 0 OR py <> 0) GROUP BY 1, 2""",
)
def mod05(spark, d):
    """Turning angles and steps of the observed ways, which a correlated walk would be made of."""
    return md.turns(observations(spark, d), 30)


@query(
    "mod11_moves",
    f"""WITH {VISITS}, mv AS (SELECT plate, region AS src, end_t - start_t AS stay, lead(region) OVER w AS dst, lead(start_t) OVER w - end_t AS travel, row_number() OVER w AS rank FROM v WINDOW w AS (PARTITION BY plate ORDER BY start_t, end_t, region)),
n AS (SELECT least(rank, 4) AS rank, src, dst, count(*) AS n, CAST(sum(stay) AS BIGINT) AS stay_us, CAST(sum(travel) AS BIGINT) AS travel_us FROM mv WHERE dst IS NOT NULL GROUP BY 1, 2, 3)
SELECT *, n / sum(n) OVER (PARTITION BY rank, src) AS p FROM n""",
)
def mod11(spark, d):
    """Shares, stays and travels of moves by rank of the visit (the fourth and later as one), which a Markov chain of visits takes."""
    order = Window.partitionBy("plate").orderBy("start", "end", "region")
    mv = ev.visits(observations(spark, d)).select(
        F.least(F.row_number().over(order), F.lit(4)).cast("long").alias("rank"), F.col("region").alias("src"), F.lead("region").over(order).alias("dst"),
        (F.col("end") - F.col("start")).alias("stay"), (F.lead("start").over(order) - F.col("end")).alias("travel"),
    ).where("dst is not null")
    n = mv.groupBy("rank", "src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum("stay").alias("stay_us"), F.sum("travel").alias("travel_us"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("rank", "src")))


@query(
    "sta08_normality",
    """WITH a AS (SELECT l_returnflag AS g, avg(l_quantity) AS m FROM lineitem GROUP BY 1),
q AS (SELECT g, count(*)::DOUBLE AS n, avg(pow(l_quantity - m, 2)) AS m2, avg(pow(l_quantity - m, 3)) AS m3, avg(pow(l_quantity - m, 4)) AS m4 FROM lineitem JOIN a ON g = l_returnflag GROUP BY g),
h AS (SELECT g, n, m3 / pow(m2, 1.5) * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
 (m4 / (m2 * m2) - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rt FROM q),
k AS (SELECT *, 6 + 8 / rt * (2 / rt + sqrt(1 + 4 / (rt * rt))) AS a FROM h),
z AS (SELECT g, n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * cbrt((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM k)
SELECT g AS l_returnflag, CAST(n AS BIGINT) AS n, round(z1 * z1 + z2 * z2, 3) AS k2 FROM z""",
)
def sta08(spark, d):
    """Normality of quantities by return flag."""
    return stats.normality(stats.moments(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")).select("l_returnflag", "n", F.round("k2", 3).alias("k2"))


@query(
    "sta09_equal_means",
    f"""WITH {OBS}, g AS (SELECT region, count(y) AS n, avg(y) AS m, var_samp(y) AS v FROM obs WHERE region >= 0 GROUP BY region), w AS (SELECT *, n / v AS w FROM g), c AS (SELECT sum(w * m) / sum(w) AS mu FROM w),
t AS (SELECT n - 1.0::DOUBLE AS nu, (m - mu) * sqrt(w) AS t FROM w, c), q AS (SELECT 48 * (nu - 0.5) * (nu - 0.5) AS b, sqrt((nu - 0.5) * ln(1 + t * t / nu)) AS c FROM t),
z AS (SELECT c + (c ** 3 + 3 * c) / b - (4 * c ** 7 + 33 * c ** 5 + 240 * c ** 3 + 855 * c) / (10 * b * b + 8 * b * c ** 4 + 1000 * b) AS z FROM q),
st AS (SELECT count(*) AS k, sum(z * z) AS x, sqrt(sum(z * z) / 2) AS y FROM z)
SELECT k, round(x, 6) AS statistic, CASE WHEN k = 4 THEN round(CASE WHEN y < 4 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * i + 1) * ln(y) - lgamma(i + 1)) / (2 * i + 1)))
  ELSE exp(-y * y) / (y * sqrt(pi())) * (1 - 1 / (2 * y * y) + 3 / (4 * pow(y, 4))) END + sqrt(2 * x / pi()) * exp(-x / 2), 7) END AS p FROM st""",
)
def sta09(spark, d):
    """Whether the four regions have equal means, and how likely a statistic as large is if they have."""
    e = stats.equal_means(observations(spark, d).where("region >= 0"), "region", "y")
    return e.select("k", F.round("statistic", 6).alias("statistic"), F.round("p", 7).alias("p"))


@query(
    "sta12_boxes",
    f"""WITH RECURSIVE {VISITS}, vd AS (SELECT region, end_t - start_t AS dur FROM v), {splits("vd", ["region"], "dur", 200, "(1 + 0.5 * (total - 1))")},
md AS (SELECT region, r, max(v) FILTER (off < floor(1 + 0.5 * (total - 1)) AND floor(1 + 0.5 * (total - 1)) <= off + n) AS a, max(v) FILTER (off < ceil(1 + 0.5 * (total - 1)) AND ceil(1 + 0.5 * (total - 1)) <= off + n) AS b FROM lf GROUP BY region, r),
nt AS (SELECT region, quantile_cont(a + (b - a) / 2, 0.025) AS notch_low, quantile_cont(a + (b - a) / 2, 0.975) AS notch_high FROM md GROUP BY region),
q AS (SELECT region, quantile_cont(dur, 0.25) AS q1, quantile_cont(dur, 0.5) AS q2, quantile_cont(dur, 0.75) AS q3 FROM vd GROUP BY region)
SELECT vd.region, count(*) AS n, round(q1, 3) AS q1, round(q2, 3) AS q2, round(q3, 3) AS q3, min(dur) FILTER (dur BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(dur) FILTER (dur BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
 round(any_value(notch_low), 3) AS notch_low, round(any_value(notch_high), 3) AS notch_high
FROM vd JOIN q ON q.region = vd.region JOIN nt ON nt.region = vd.region GROUP BY vd.region, q1, q2, q3""",
)
def sta12(spark, d):
    """Box of visit lengths by region, with the notch of 200 resampled medians."""
    v = ev.visits(observations(spark, d)).select("region", (F.col("end") - F.col("start")).alias("dur"))
    b = stats.box(v, "region", "dur").join(resampling.notches(v, ["region"], "dur", 200), "region")
    return b.select("region", "n", *[F.round(c, 3).alias(c) for c in ("q1", "q2", "q3")], "low", "high", *[F.round(c, 3).alias(c) for c in ("notch_low", "notch_high")])


@query("bin02_equal_counts", f"WITH {OBS}, b AS (SELECT plate % 8 AS g, x, y, (row_number() OVER (PARTITION BY plate % 8 ORDER BY x, plate, ord) - 1) // 200 AS bin FROM obs) SELECT CAST(g AS INTEGER) AS condition_id, bin, count(*) AS n, min(x) AS low, max(x) AS high, CAST(sum(y) AS BIGINT) AS sum_y FROM b GROUP BY 1, 2")
def bin02(spark, d):
    """Bins of 200 rows in order of x by condition."""
    return stats.equal_count_bins(observations(spark, d).withColumn("condition_id", condition_of(F.col("plate"))), "condition_id", "x", "y", ["plate", "ord"], 200)


@query("bin05_survival", f"WITH {OBS}, h AS (SELECT CAST(floor(x / 2500) AS BIGINT) AS bin, count(*) AS n FROM obs GROUP BY 1) SELECT bin, CAST(sum(n) OVER (ORDER BY bin DESC) AS BIGINT) AS n_from, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS n_to FROM h")
def bin05(spark, d):
    """Cumulated histogram from both ends; one row per bin meets in the last window."""
    h = stats.histogram(observations(spark, d), "x", 2500)
    return h.select("bin", F.sum("n").over(Window.orderBy(F.desc("bin"))).alias("n_from"), F.sum("n").over(Window.orderBy("bin")).alias("n_to"))


@query("jon01_dimensions", "SELECT r_name, n_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
def jon01(spark, d):
    """Customers by nation and region; dimension sides go out by size, as the planner decides."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("b"))
    j = c.join(n, "n_nationkey").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.sum("n").alias("n_customers"), F.round(F.sum("b"), 2).alias("balance"))


@query("jon02_without_orders", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def jon02(spark, d):
    """Customers without a large order."""
    large = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(large, "c_custkey", "left_anti")


@query("jon03_late_orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def jon03(spark, d):
    """Orders with a line of many items."""
    many = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(many, "o_orderkey", "left_semi")


@query("jon12_condition_names", f"WITH {OBS}, {COND}, n AS (SELECT layout || ' ' || density AS name, condition_id FROM cond) SELECT name, count(*) AS n_rows, count(DISTINCT plate) AS n_plates FROM obs JOIN n ON condition_id = plate % 8 GROUP BY name")
def jon12(spark, d):
    """Rows by name of the condition, made of layout and density."""
    c = conditions(spark).select("condition_id", F.concat_ws(" ", "layout", "density").alias("name"))
    o = observations(spark, d).groupBy("plate").agg(F.count(F.lit(1)).alias("n")).withColumn("condition_id", condition_of(F.col("plate")))
    return o.join(F.broadcast(c), "condition_id").groupBy("name").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_plates"))


@query(
    "mod11_expected_visits",
    f"""WITH RECURSIVE {VISITS}, w AS (SELECT CAST(plate % 8 AS INTEGER) AS g, region, row_number() OVER o AS nth, least(row_number() OVER o, 4) AS rank, lead(region) OVER o AS dst FROM v WINDOW o AS (PARTITION BY plate ORDER BY start_t, end_t, region)),
sh AS (SELECT g, rank, region, dst, n / al AS p FROM (SELECT g, rank, region, dst, count(*) AS n, sum(count(*)) OVER (PARTITION BY g, rank, region) AS al FROM w GROUP BY g, rank, region, dst) WHERE dst IS NOT NULL),
it AS (SELECT g, 1 AS k, region, count(*) / sum(count(*)) OVER (PARTITION BY g) AS m FROM w WHERE nth = 1 GROUP BY g, region
  UNION ALL SELECT it.g, any_value(it.k) + 1, sh.dst, sum(m * p) FROM it JOIN sh ON sh.g = it.g AND sh.region = it.region AND sh.rank = least(it.k, 4) WHERE it.k < {EXCHANGE} GROUP BY it.g, sh.dst)
SELECT g AS condition_id, CAST(k AS INTEGER) AS k, region, round(m, 9) AS m FROM it""",
)
def mod11_expected(spark, d):
    """The expected share of plates that make their k-th visit, by region, of the chain that each condition's moves by rank make."""
    v = ev.visits(observations(spark, d)).withColumn("condition_id", condition_of(F.col("plate")))
    return md.expected_visits(v, "condition_id", 4, EXCHANGE).select("condition_id", "k", "region", F.round("m", 9).alias("m"))


LAGS = [1, 2, 4, 8]


@query(
    "mod05_walk_spread",
    f"""WITH {OBS}, s AS (SELECT plate % 8 AS g, plate, track, ord, x, y * 100 AS y, x - lag(x) OVER w AS dx, (y - lag(y) OVER w) * 100 AS dy, {", ".join(f"pow(lead(x, {n}) OVER w - x, 2) + pow((lead(y, {n}) OVER w - y) * 100, 2) AS r{n}" for n in LAGS)} FROM obs WINDOW w AS (PARTITION BY plate, track ORDER BY ord)),
t AS (SELECT *, lag(dx) OVER w AS px, lag(dy) OVER w AS py, (dx * dx + dy * dy)::DOUBLE AS l2 FROM s WINDOW w AS (PARTITION BY plate, track ORDER BY ord)),
m AS (SELECT CAST(g AS INTEGER) AS condition_id, avg(sqrt(l2)) AS l, avg(l2) AS q, avg(CASE WHEN l2 > 0 AND px * px + py * py > 0 THEN (px * dx + py * dy)::DOUBLE / sqrt((px * px + py * py)::DOUBLE * l2) END) AS c, {", ".join(f"avg(r{n}) AS r{n}" for n in LAGS)} FROM t GROUP BY g),
u AS (SELECT condition_id, l, q, c, unnest({LAGS}::BIGINT[]) AS n, unnest([{", ".join(f"r{n}" for n in LAGS)}]) AS r FROM m)
SELECT condition_id, n, round((n * q + 2 * l * l * c / (1 - c) * (n - (1 - pow(c, n)) / (1 - c))) / 1e6, 6) AS expected, round(r / 1e6, 6) AS observed FROM u""",
)
def mod05_spread(spark, d):
    """How far a correlated walk with each condition's steps and turns is expected to come, and how far its ways did."""
    o = observations(spark, d).withColumn("condition_id", condition_of(F.col("plate")))
    w = md.walk_spread(o, "condition_id", LAGS)
    return w.select("condition_id", "n", F.round(F.col("expected") / 1e6, 6).alias("expected"), F.round(F.col("observed") / 1e6, 6).alias("observed"))


@query(
    "mod02_null_revisits",
    f"""WITH {VISITS}, mv AS (SELECT CAST(plate % 8 AS INTEGER) AS condition_id, region, lead(region) OVER w AS dst, lead(start_t) OVER w - end_t AS travel FROM v WINDOW w AS (PARTITION BY plate ORDER BY start_t, end_t, region)),
o AS (SELECT condition_id, count(*) FILTER (region = dst) / count(*) AS p, coalesce(sum(travel) FILTER (region = dst), 0)::DOUBLE / count(*) / 3.6e9 AS b, coalesce(sum(travel) FILTER (region <> dst), 0)::DOUBLE / count(*) / 3.6e9 AS a FROM mv WHERE dst IS NOT NULL GROUP BY condition_id)
SELECT condition_id, tau, thr, round(p, 9) AS p_back, round(-tau * ln(thr), 6) AS stay_h, round((1 - p) * tau * (1 - thr) / ((1 - p) * (-tau * ln(thr)) + b + a), 9) AS rate FROM o, (SELECT unnest([50.0, 200.0]::DOUBLE[]) AS tau), (SELECT unnest([0.05, 0.5]::DOUBLE[]) AS thr)""",
)
def mod02_revisits(spark, d):
    """Expected intake with the returns and travels of each condition, in hours."""
    v = ev.visits(observations(spark, d)).withColumn("condition_id", condition_of(F.col("plate")))
    m = md.null_revisits(v, "condition_id", [50.0, 200.0], [0.05, 0.5])
    return m.select("condition_id", "tau", "thr", F.round("p_back", 9).alias("p_back"), F.round("stay", 6).alias("stay_h"), F.round("rate", 9).alias("rate"))
