"""Queries on means with intervals, bins and picks, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import resampling, stats
from trackloom.operators import curves as cv
from trackloom.operators import events as ev
from trackloom.operators import reports as rp
from trackloom.plans.catalog import CENSORED, COND, DAY, OBS, RUNS, T0, VISITS, query
from trackloom.plans.curves import CLOCK_EDGES, HOUR, STAYS
from trackloom.sources.tables import condition_of, conditions, observations, stored, table

WIDTH = 7000.0


def _draw(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(',', {', '.join(parts)})), 1, 8))::BIGINT / {float(1 << 32)!r}::DOUBLE)"


def _means(source: str, keys: str, value: str, row: list[str], resamples: int) -> str:
    """SQL of resampled means ``rm`` and of their intervals ``iv``, from a table of rows."""
    w = "CASE WHEN r = 0 THEN 1 ELSE " + " + ".join(f"CAST(u >= {p!r}::DOUBLE AS INTEGER)" for p in stats.POISSON) + " END"
    return f"""rs AS (SELECT *, {_draw('r', *row)} AS u FROM {source}, (SELECT unnest(range(0, {resamples + 1})) AS r) WHERE {value} IS NOT NULL),
rm AS (SELECT {keys}, r, sum({w}) AS n, sum(({w}) * {value}) / nullif(sum({w}), 0) AS m FROM rs GROUP BY {keys}, r),
iv AS (SELECT {keys}, CAST(max(n) FILTER (r = 0) AS BIGINT) AS n, max(m) FILTER (r = 0) AS mean, quantile_cont(m, 0.025) FILTER (r > 0) AS lo, quantile_cont(m, 0.975) FILTER (r > 0) AS hi FROM rm GROUP BY {keys})"""


def splits(source: str, keys: list[str], value: str, resamples: int, place: str | None = None) -> str:
    """SQL of resamples by nested binomial splits: ``ce`` (distinct values with counts) and the leaves ``lf`` (keys, r, v, n, off, total).

    With ``place``, an expression of ``total``, only branches that hold the places about it are followed.
    """
    own = ", ".join(keys)
    on = " AND ".join(f"cu.{k} = nd.{k}" for k in keys)
    digest = f"md5(concat_ws(',', {', '.join('nd.' + k for k in keys)}, r, l, j))"
    u, v = (f"(('0x' || substr({digest}, {at}, 8))::BIGINT / {float(1 << 32)!r}::DOUBLE)" for at in (1, 9))
    few = f"""list_reduce(range(1, least(n, {resampling.MOST_STEPS}) + 1), lambda s, i: {{'mass': CASE WHEN s.below < u THEN s.mass * (n - i + 1) / i * (q / (1 - q)) ELSE s.mass END,
      'below': CASE WHEN s.below < u THEN s.below + s.mass * (n - i + 1) / i * (q / (1 - q)) ELSE s.below END, 'k': CASE WHEN s.below < u THEN i ELSE s.k END}}, {{'mass': pow(1 - q, n), 'below': pow(1 - q, n), 'k': 0::BIGINT}}).k"""
    x = f"""CAST(CASE WHEN mid = hi THEN n WHEN n * q <= {resampling.SMALL_MEAN} THEN CASE WHEN p <= 0.5 THEN {few} ELSE n - {few} END
      ELSE greatest(0, least(n, floor(n * p + sqrt(n * p * (1 - p)) * (sqrt(-2 * ln(1 - u)) * cos({2 * math.pi!r}::DOUBLE * v)) + 0.5))) END AS BIGINT)"""
    holds = "" if place is None else f" AND ((ch.off < floor({place}) AND floor({place}) <= ch.off + ch.n) OR (ch.off < ceil({place}) AND ceil({place}) <= ch.off + ch.n))"
    return f"""ce AS (SELECT {own}, {value} AS v, count(*) AS c FROM {source} WHERE {value} IS NOT NULL GROUP BY {own}, {value}),
cu AS (SELECT {own}, v, c, row_number() OVER (PARTITION BY {own} ORDER BY v) - 1 AS k, CAST(sum(c) OVER (PARTITION BY {own} ORDER BY v ROWS UNBOUNDED PRECEDING) - c AS BIGINT) AS before FROM ce),
tt AS (SELECT {own}, CAST(sum(c) AS BIGINT) AS n, count(*) AS m FROM ce GROUP BY {own}), de AS (SELECT CAST(ceil(log2(max(m))) AS BIGINT) AS depth FROM tt),
nd AS (SELECT {own}, r, 0::BIGINT AS l, 0::BIGINT AS j, n, 0::BIGINT AS lo, n AS hi, 0::BIGINT AS off, n AS total FROM tt, (SELECT unnest(range(1, {resamples + 1})) AS r)
  UNION ALL SELECT {own}, r, l + 1, ch.j, ch.n, ch.lo, ch.hi, ch.off, total FROM (
    SELECT {own}, r, l, total, unnest([{{'j': 2 * j, 'n': x, 'lo': lo, 'hi': mid, 'off': off}}, {{'j': 2 * j + 1, 'n': n - x, 'lo': mid, 'hi': hi, 'off': off + x}}]) AS ch FROM (
      SELECT *, {x} AS x FROM (SELECT *, least(p, 1 - p) AS q FROM (SELECT *, (mid - lo) / (hi - lo) AS p FROM (
        SELECT nd.*, coalesce(cu.before, hi) AS mid, {u} AS u, {v} AS v FROM nd CROSS JOIN de LEFT JOIN cu ON {on} AND cu.k = j * (1::BIGINT << (depth - l)) + (1::BIGINT << (depth - l - 1)) WHERE l < depth))))) WHERE ch.n > 0{holds}),
lf AS (SELECT {", ".join("nd." + k for k in keys)}, r, cu.v, nd.n, off, total FROM nd JOIN de ON l = depth JOIN cu ON {on} AND cu.k = nd.j)"""


def exact_means(source: str, keys: list[str], value: str, resamples: int) -> str:
    own = ", ".join(keys)
    return f"""{splits(source, keys, value, resamples)},
rm AS (SELECT {own}, r, sum(n) AS n, sum(n * v) / sum(n) AS m FROM (SELECT {own}, r, v, n FROM lf UNION ALL SELECT {own}, 0, v, c FROM ce) GROUP BY {own}, r),
iv AS (SELECT {own}, CAST(max(n) FILTER (r = 0) AS BIGINT) AS n, max(m) FILTER (r = 0) AS mean, quantile_cont(m, 0.025) FILTER (r > 0) AS lo, quantile_cont(m, 0.975) FILTER (r > 0) AS hi FROM rm GROUP BY {own})"""


def _rounded(df, keys, digits=6):
    return df.select(*keys, "n", *[F.round(c, digits).alias(c) for c in ("mean", "lo", "hi")])


ROUNDED = "n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi"
PLATES = f"{VISITS}, pn AS (SELECT plate, CAST(plate % 8 AS INTEGER) AS condition_id, count(*) AS n_visits FROM v GROUP BY plate)"


def _plates(spark, d):
    return ev.visits(observations(spark, d)).groupBy("plate").agg(condition_of(F.first("plate")).alias("condition_id"), F.count(F.lit(1)).alias("n_visits"))


@query(
    "sta01_exact_sizes",
    f"WITH RECURSIVE {PLATES}, {splits('pn', ['condition_id'], 'n_visits', 200)} SELECT condition_id, r, v AS n_visits, CAST(n AS BIGINT) AS n FROM lf",
)
def sta01_exact(spark, d):
    """How often each of 200 resamples has each number of visits, by condition; each resample is as large as its condition."""
    c = resampling.resample_counts(_plates(spark, d), ["condition_id"], "n_visits", 200)
    return c.select("condition_id", F.col("r").cast("long").alias("r"), "n_visits", "n")


@query("sta01_exact_intervals", f"WITH RECURSIVE {PLATES}, {exact_means('pn', ['condition_id'], 'n_visits', 1000)} SELECT condition_id, {ROUNDED} FROM iv")
def sta01_sized(spark, d):
    """Mean visits of a condition with an interval of 1000 resamples of exactly its size."""
    return _rounded(resampling.exact_intervals(_plates(spark, d), ["condition_id"], "n_visits", 1000), ["condition_id"])


@query("sta01_bootstrap", f"WITH {PLATES}, {_means('pn', 'condition_id', 'n_visits', ['plate'], 1000)} SELECT condition_id, {ROUNDED} FROM iv")
def sta01(spark, d):
    """Mean visits of a condition with an interval of 1000 resamples."""
    return _rounded(stats.intervals(_plates(spark, d), ["condition_id"], "n_visits", ["plate"], 1000), ["condition_id"])


@query(
    "agg01_intervals",
    f"""WITH {VISITS}, {COND}, pm AS (SELECT plate, condition_id, unnest(['nb_of_visits', 'proportion_of_visited_patches', 'total_visit_time']) AS measure,
  unnest([CAST(n AS DOUBLE), k / n_patches, us / 60000000.0]) AS value
  FROM (SELECT plate, count(*) AS n, count(DISTINCT region) AS k, CAST(sum(end_t - start_t) AS BIGINT) AS us FROM v GROUP BY plate) JOIN cond ON condition_id = plate % 8),
{_means('pm', 'measure, condition_id', 'value', ['measure', 'plate'], 1000)} SELECT measure, condition_id, n, round(mean, 4) AS mean, round(lo, 4) AS lo, round(hi, 4) AS hi FROM iv""",
)
def agg01(spark, d):
    """Measures by plate, then their means by condition with intervals; times in minutes."""
    p = ev.visits(observations(spark, d)).groupBy("plate").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("region").alias("k"), F.sum(F.col("end") - F.col("start")).alias("us"))
    p = p.withColumn("condition_id", condition_of(F.col("plate"))).join(F.broadcast(conditions(spark)), "condition_id")
    values = {"nb_of_visits": F.col("n").cast("double"), "proportion_of_visited_patches": F.col("k") / F.col("n_patches"), "total_visit_time": F.col("us") / 60_000_000.0}
    long = p.select("plate", "condition_id", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in values.items()])).alias("m")).select("plate", "condition_id", "m.*")
    return _rounded(stats.intervals(long, ["measure", "condition_id"], "value", ["measure", "plate"], 1000), ["measure", "condition_id"], 4)


@query(
    "bin01_fixed_width",
    f"""WITH RECURSIVE {OBS}, en AS (SELECT min(x) AS lo_x, max(x) AS hi_x FROM obs), nb AS (SELECT *, CAST(greatest(0, ceil((hi_x - (lo_x - 1) - 2 * {WIDTH}) / {WIDTH})) AS BIGINT) AS last_bin FROM en),
ab AS (SELECT bin, CASE WHEN bin = last_bin THEN (lo_x - 1 + bin * {WIDTH} + hi_x) / 2 ELSE lo_x - 1 + bin * {WIDTH} + {WIDTH} / 2 END AS middle FROM nb, (SELECT unnest(range(0, (SELECT last_bin + 1 FROM nb))) AS bin)),
bx AS (SELECT plate, ord, y, CAST(least(ceil((x - (lo_x - 1)) / {WIDTH}) - 1, last_bin) AS BIGINT) AS bin FROM obs, nb),
{exact_means('bx', ['bin'], 'y', 100)} SELECT ab.bin, middle, coalesce(n, 0) AS n, round(coalesce(mean, 0), 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ab LEFT JOIN iv ON iv.bin = ab.bin""",
)
def bin01(spark, d):
    """Bins of equal width with their middles, means and intervals of 100 resamples."""
    b = stats.fixed_width_bins(observations(spark, d), "x", "y", WIDTH)
    return _rounded(b, ["bin", "middle"])


@query(
    "sta10_leaving_intervals",
    f"WITH {RUNS}, {STAYS}, lp AS (SELECT plate, bin, n_leaving / n_points AS p FROM db), {_means('lp', 'bin', 'p', ['bin', 'plate'], 50)} SELECT bin, {ROUNDED} FROM iv WHERE n > 3",
)
def sta10(spark, d):
    """Probability of leaving by bin of time spent, mean over plates with intervals of 50 resamples; bins of more than three plates."""
    p = cv.delay_bins(cv.stays(ev.runs(observations(spark, d)), HOUR), CLOCK_EDGES).select("plate", "bin", (F.col("n_leaving") / F.col("n_points")).alias("p"))
    return _rounded(stats.intervals(p, ["bin"], "p", ["bin", "plate"], 50), ["bin"]).where("n > 3")


def _picks(source: str, group: str, value: str, order: str, picks: int, resamples: int) -> str:
    return f"""pl AS (SELECT {group}, {value}, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS k FROM {source}),
dr AS (SELECT {group}, r, CAST(floor({_draw('r', 'i', group)} * n) + 1 AS BIGINT) AS k FROM (SELECT {group}, count(*) AS n FROM {source} GROUP BY {group}), (SELECT unnest(range(1, {resamples + 1})) AS r), (SELECT unnest(range(1, {picks + 1})) AS i)),
pm AS (SELECT dr.{group}, r, CAST(sum({value}) AS BIGINT) / count(*) AS m FROM dr JOIN pl ON pl.{group} = dr.{group} AND pl.k = dr.k GROUP BY dr.{group}, r)"""


DURS = f"{VISITS}, vd AS (SELECT CAST(plate % 8 AS INTEGER) AS condition_id, plate, start_t, region, end_t - start_t AS dur FROM v)"


def _durations(spark, d):
    return ev.visits(observations(spark, d)).select(condition_of(F.col("plate")).alias("condition_id"), "plate", "start", "region", (F.col("end") - F.col("start")).alias("dur"))


@query("sta02_random_picks", f"WITH {DURS}, {_picks('vd', 'condition_id', 'dur', 'plate, start_t, region, dur', 100, 1)} SELECT condition_id, round(m, 3) AS mean_us FROM pm")
def sta02(spark, d):
    """Mean of 100 random visits of each condition."""
    p = stats.picked_means(_durations(spark, d), "condition_id", "dur", ["plate", "start", "region", "dur"], 100, 1)
    return p.select("condition_id", F.round("m", 3).alias("mean_us"))


@query(
    "sta11_effect_ratios",
    f"""WITH {DURS}, {_picks('vd', 'condition_id', 'dur', 'plate, start_t, region, dur', 100, 200)}, ra AS (SELECT a.condition_id, a.m / b.m AS q FROM pm a JOIN pm b ON a.r = b.r AND b.condition_id = 0)
SELECT condition_id, round(avg(q), 6) AS ratio, round(quantile_cont(q, 0.025), 6) AS lo, round(quantile_cont(q, 0.975), 6) AS hi FROM ra GROUP BY condition_id""",
)
def sta11(spark, d):
    """Mean of 100 picks of each condition over that of the first condition, 200 times: mean ratio and its interval."""
    m = stats.picked_means(_durations(spark, d), "condition_id", "dur", ["plate", "start", "region", "dur"], 100, 200)
    base = m.where("condition_id = 0").select("r", F.col("m").alias("base"))
    q = F.col("m") / F.col("base")
    r = m.join(base, "r").withColumn("q", q)
    return r.groupBy("condition_id").agg(F.round(F.avg("q"), 6).alias("ratio"), F.round(F.percentile("q", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("q", F.lit(0.975)), 6).alias("hi"))


@query(
    "sta03_log_log",
    """WITH p AS (SELECT l_returnflag, log10(l_quantity::DOUBLE) AS x, log10(l_extendedprice::DOUBLE) AS y FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0), f AS (SELECT l_returnflag, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM p GROUP BY l_returnflag)
SELECT l_returnflag, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(pow(10, intercept + slope), 3) AS at_10 FROM f""",
)
def sta03(spark, d):
    """A line through logarithms, and what it predicts at 10."""
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    f = stats.log_fit(li, "l_returnflag", "x", "y")
    return f.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round(F.pow(F.lit(10.0), F.col("intercept") + F.col("slope")), 3).alias("at_10"))


@query(
    "bin04_time_bins",
    f"""WITH {VISITS}, en AS (SELECT min(start_t) AS a, max(start_t) AS b FROM v), eg AS (SELECT i, a + i * (b - a) // 10 AS lo, a + (i + 1) * (b - a) // 10 AS hi FROM en, (SELECT unnest(range(0, 10)) AS i))
SELECT i AS bin, lo AS start, count(*) AS n, CAST(sum(end_t - start_t) AS BIGINT) AS visit_us FROM v JOIN eg ON start_t >= lo AND (start_t < hi OR i = 9) GROUP BY i, lo""",
)
def bin04(spark, d):
    """Visits in ten equal spans of the recordings, by their start; edges are whole, and the last bin has both of its."""
    v = ev.visits(observations(spark, d))
    a, b = v.agg(F.min("start"), F.max("start")).first()
    edges = [a + i * (b - a) // 10 for i in range(10)] if a is not None else [0]
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("start"))) - 1
    g = v.groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("visit_us"))
    return g.select("bin", F.element_at(F.array(*map(F.lit, edges)), (F.col("bin") + 1).cast("int")).alias("start"), "n", "visit_us")


@query(
    "bin06_pooled_ranks",
    f"""WITH RECURSIVE {VISITS}, rk AS (SELECT row_number() OVER (PARTITION BY plate, region ORDER BY start_t, end_t) AS k FROM v), n AS (SELECT k, count(*) AS n FROM rk GROUP BY k),
st(k, first, n, filled) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), true UNION ALL
  SELECT n.k, CASE WHEN st.filled THEN n.k ELSE st.first END, CASE WHEN st.filled THEN n.n ELSE st.n + n.n END, CASE WHEN st.filled THEN n.n ELSE st.n + n.n END > 40 FROM st JOIN n ON n.k = st.k + 1)
SELECT first, k AS last, n FROM st WHERE filled AND k > 0""",
)
def bin06(spark, d):
    """Visit ranks pooled until a pool has more than 40 visits."""
    ranks = ev.ranked(ev.visits(observations(spark, d))).groupBy("visit_rank").agg(F.count(F.lit(1)).alias("n"))
    return stats.pooled_ranks(ranks, "visit_rank", "n", 40)


FOOD = [100, 1000, 10_000, 20_000, 40_000, 60_000]


@query("bin07_right_edges", f"WITH {OBS} SELECT CAST(len(list_filter({FOOD}, lambda e: e < x)) AS BIGINT) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS sum_y FROM obs WHERE x <= {FOOD[-1]} GROUP BY 1")
def bin07(spark, d):
    """Bins that hold their right edge; values beyond the last edge are left out."""
    o = observations(spark, d).where(F.col("x") <= FOOD[-1])
    below = F.size(F.filter(F.array(*map(F.lit, FOOD)), lambda e: e < F.col("x"))).cast("long")
    return o.groupBy(below.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y"))


@query("fil16_without_nan", f"WITH {OBS}, q AS (SELECT plate, CASE WHEN ord % 7 = 0 THEN 'NaN'::DOUBLE WHEN ord % 11 = 0 THEN NULL ELSE x END AS x FROM obs) SELECT plate, count(*) FILTER (NOT isnan(x)) AS n, round(avg(x) FILTER (NOT isnan(x)), 6) AS mean FROM q GROUP BY plate")
def fil16(spark, d):
    """Means that leave out what isn't a number."""
    x = F.when(F.col("ord") % 7 == 0, F.lit(float("nan"))).when(F.col("ord") % 11 != 0, F.col("x").cast("double"))
    o = observations(spark, d).select("plate", F.nanvl(x, F.lit(None).cast("double")).alias("x"))
    return o.groupBy("plate").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


@query("fil18_time_slice", f"WITH {OBS} SELECT plate, ord, x, y FROM obs WHERE t BETWEEN {T0 + 3 * DAY} AND {T0 + 9 * DAY}")
def fil18(spark, d):
    return observations(spark, d).where(F.col("t").between(T0 + 3 * DAY, T0 + 9 * DAY)).select("plate", "ord", "x", "y")


@query("fil20_condition_names", f"WITH {COND}, {OBS} SELECT DISTINCT plate, condition_id, layout || ' ' || density AS name, layout, density FROM obs JOIN cond ON condition_id = plate % 8")
def fil20(spark, d):
    """Layout and density of each plate, read back from its condition's name: longer words before those that they contain."""
    plates = observations(spark, d).select("plate").distinct().withColumn("condition_id", condition_of(F.col("plate")))
    names = plates.join(F.broadcast(conditions(spark)), "condition_id").select("plate", "condition_id", F.concat_ws(" ", "layout", "density").alias("name"))

    def first(words):
        out = F.lit(None).cast("string")
        for w in reversed(words):
            out = F.when(F.contains("name", F.lit(w)), F.lit(w)).otherwise(out)
        return out

    layout = first(["superfar", "close", "med", "far", "cluster"])
    density = first(["0.2+0.5", "0.5+1.25", "1.25", "0.2", "0.5", "0"])
    return names.select("plate", "condition_id", "name", layout.alias("layout"), density.alias("density"))


@query(
    "jon13_counts_of_plates",
    f"""WITH {OBS}, p AS (SELECT DISTINCT plate FROM obs), e AS (SELECT o_custkey AS plate, count(*) AS n FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1) SELECT p.plate, coalesce(n, 0) AS n_eggs, n IS NULL AS missing FROM p LEFT JOIN e ON e.plate = p.plate""",
)
def jon13(spark, d):
    """Counts from another table for each plate, and which plates it misses."""
    p = observations(spark, d).select("plate").distinct()
    e = table(spark, d, "orders").where("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("plate")).agg(F.count(F.lit(1)).alias("n"))
    return p.join(e, "plate", "left").select("plate", F.coalesce("n", F.lit(0)).alias("n_eggs"), F.col("n").isNull().alias("missing"))


@query(
    "agg10_counts_with_intervals",
    f"""WITH {OBS}, e AS (SELECT o_custkey AS plate, CAST(o_custkey % 8 AS INTEGER) AS condition_id, count(*) AS n_eggs FROM orders WHERE o_custkey IN (SELECT plate FROM obs) GROUP BY 1, 2), {_means('e', 'condition_id', 'n_eggs', ['plate'], 1000)} SELECT condition_id, {ROUNDED} FROM iv""",
)
def agg10(spark, d):
    """Mean count of plates by condition, with intervals."""
    plates = observations(spark, d).select(F.col("plate").alias("o_custkey")).distinct()
    e = table(spark, d, "orders").join(plates, "o_custkey", "left_semi").groupBy(F.col("o_custkey").alias("plate")).agg(F.count(F.lit(1)).alias("n_eggs"))
    return _rounded(stats.intervals(e.withColumn("condition_id", condition_of(F.col("plate"))), ["condition_id"], "n_eggs", ["plate"], 1000), ["condition_id"])


@query(
    "agg07_value_lists",
    f"""WITH {VISITS}, n AS (SELECT *, row_number() OVER w AS pos, lead(region) OVER w AS nx, lead(start_t) OVER w - end_t AS gap FROM v WINDOW w AS (PARTITION BY plate ORDER BY start_t, end_t, region)), e AS (SELECT * FROM n WHERE start_t <= {T0 + 20 * DAY})
SELECT 'visits' AS kind, plate, pos, end_t - start_t AS value FROM e
UNION ALL SELECT 'first_visit', plate, pos, end_t - start_t FROM e WHERE pos = 1
UNION ALL SELECT 'same_transits', plate, pos, gap FROM e WHERE nx = region
UNION ALL SELECT 'cross_transits', plate, pos, gap FROM e WHERE nx <> region
UNION ALL SELECT 'patch_sequence', plate, pos, region FROM e""",
)
def agg07(spark, d):
    """Lists of values before an end time, in their order: visits, the first of a plate, transits back and across, regions."""
    order = Window.partitionBy("plate").orderBy("start", "end", "region")
    v = ev.visits(observations(spark, d)).withColumns({"pos": F.row_number().over(order).cast("long"), "nx": F.lead("region").over(order), "gap": F.lead("start").over(order) - F.col("end")})
    v = v.where(F.col("start") <= T0 + 20 * DAY)
    long, item = F.col("end") - F.col("start"), lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("value"))
    lists = F.array(
        item("visits", long), F.when(F.col("pos") == 1, item("first_visit", long)), F.when(F.col("nx") == F.col("region"), item("same_transits", F.col("gap"))),
        F.when(F.col("nx") != F.col("region"), item("cross_transits", F.col("gap"))), item("patch_sequence", F.col("region")),
    )
    return v.select("plate", "pos", F.explode(F.filter(lists, lambda x: x.isNotNull())).alias("x")).select("x.kind", "plate", "pos", "x.value")


#: Modes of first visits: what ``first_visits`` takes, in doubled microseconds.
FIRST = {
    "all": {},
    "uncensored": {"uncensored_first": True},
    "first_region": {"first_region_only": True, "cut2": (2 * T0, 2 * (T0 + 20 * DAY))},
    "long": {"uncensored_first": True, "least2": 2 * DAY},
}


def _first_sql(i: int, name: str, mode: dict) -> str:
    a, b = mode.get("cut2", (-(1 << 62), 1 << 62))
    return f"""fa{i} AS (SELECT *, first_value(uncensored) OVER (PARTITION BY plate, region ORDER BY s, e) AS ok FROM c WHERE region >= 0),
fb{i} AS (SELECT *, first_value(region) OVER (PARTITION BY plate ORDER BY s, e, region) AS one FROM fa{i} WHERE {"ok AND " if mode.get("uncensored_first") else ""}e - s >= {mode.get("least2", 0)}),
fc{i} AS (SELECT *, row_number() OVER (PARTITION BY plate, region ORDER BY s, e) AS k FROM fb{i} WHERE {"region = one AND " if mode.get("first_region_only") else ""}s BETWEEN {a} AND {b}),
fd{i} AS (SELECT '{name}' AS mode, plate, CAST(plate % 8 AS INTEGER) AS condition_id, avg((e - s) / 120000000.0) AS minutes FROM fc{i} WHERE k = 1 GROUP BY plate)"""


@query(
    "agg05_first_visits",
    f"""WITH {CENSORED}, {", ".join(_first_sql(i, n, m) for i, (n, m) in enumerate(FIRST.items()))}, fv AS ({" UNION ALL ".join(f"SELECT * FROM fd{i}" for i in range(len(FIRST)))}),
{_means('fv', 'mode, condition_id', 'minutes', ['mode', 'plate'], 200)} SELECT mode, condition_id, n, round(mean, 4) AS mean, round(lo, 4) AS lo, round(hi, 4) AS hi FROM iv""",
)
def agg05(spark, d):
    """Mean first visit to a region in minutes, by plate and then by condition with intervals, in several modes."""
    c = stored(ev.censored(ev.filled_events(observations(spark, d))), "censored-events")
    rows = None
    for name, mode in FIRST.items():
        v = rp.first_visits(c, **mode).groupBy("plate").agg(F.avg(F.col("dur2") / 120_000_000.0).alias("minutes"))
        v = v.select(F.lit(name).alias("mode"), "plate", condition_of(F.col("plate")).alias("condition_id"), "minutes")
        rows = v if rows is None else rows.unionByName(v)
    return _rounded(stats.intervals(rows, ["mode", "condition_id"], "minutes", ["mode", "plate"], 200), ["mode", "condition_id"], 4)
