"""Bins, histograms, regressions, percentiles and bootstrap intervals."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.sources.tables import stored


def bin_index(x: Column, edges: list[float]) -> Column:
    """Bins (e_i, e_i+1]; the first edge belongs to the first bin, values beyond the last to the last."""
    below = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < x.cast("double")))
    return F.greatest(below - 1, F.lit(0)).cast("long")


def binned_means(df: DataFrame, x: str, y: str, edges: list[float]) -> DataFrame:
    b = df.withColumn("bin", bin_index(F.col(x), edges))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), (F.sum(y) / F.count(y)).alias("mean_y"))


def histogram(df: DataFrame, x: str, width: int) -> DataFrame:
    """Counts by bins of equal width."""
    return df.groupBy(F.floor(F.col(x) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def clamped_matrix(df: DataFrame, x: str, y: str, most: int) -> DataFrame:
    """Counts by both values, each cut at ``most``."""
    return df.groupBy(F.least(F.col(x), F.lit(most)).alias("a"), F.least(F.col(y), F.lit(most)).alias("b")).agg(F.count(F.lit(1)).alias("n"))


#: Shares of resamples that take a row at most 0, 1, 2, ... times: a Poisson variable of mean 1.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: 32 bits of their MD5, which any SQL engine can compute."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("long") / float(1 << 32)


def digest(*parts: Column) -> Column:
    """The MD5 of the parts, whose first eight digits ``draw`` reads as a number."""
    return F.md5(F.concat_ws(",", *[p.cast("string") for p in parts]))


def resampled_means(df: DataFrame, keys: list[str], value: str, row: list[str], resamples: int) -> DataFrame:
    """``keys, r, n, m``: the mean of each group (r = 0) and of ``resamples`` resamples of it.

    A row, named by the columns ``row``, enters a resample a Poisson(1) number of times by a draw of
    its own, so tasks give partial sums for each resample and no group comes together. Resamples vary
    a little in size, as the mean of what is drawn allows for. Null values and NaN don't count.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = known.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples)))).withColumn("_u", digest(F.col("r"), *[F.col(c) for c in row]))
    w = F.when(F.col("r") == 0, 1)
    for k, p in enumerate(POISSON):
        # the draw is below p if its eight digits come before those of the least number that isn't
        w = w.when(F.col("_u") < f"{math.ceil(p * (1 << 32)):08x}", k)
    taken = rows.withColumn("_w", w.otherwise(len(POISSON)).cast("long"))
    sums = taken.groupBy(*keys, "r").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col(value)).alias("_s"))
    return sums.select(*keys, "r", "n", F.try_divide(F.col("_s"), F.col("n")).alias("m"))


def intervals(df: DataFrame, keys: list[str], value: str, row: list[str], resamples: int = 1000) -> DataFrame:
    """``keys, n, mean, lo, hi``: means of groups and the 2.5 and 97.5 percentiles of the means of resamples."""
    drawn = F.when(F.col("r") > 0, F.col("m"))
    return resampled_means(df, keys, value, row, resamples).groupBy(*keys).agg(
        F.max(F.when(F.col("r") == 0, F.col("n"))).alias("n"),
        F.max(F.when(F.col("r") == 0, F.col("m"))).alias("mean"),
        F.percentile(drawn, F.lit(0.025)).alias("lo"),
        F.percentile(drawn, F.lit(0.975)).alias("hi"),
    )


def picked_means(df: DataFrame, group: str, value: str, order: list[str], picks: int, resamples: int) -> DataFrame:
    """``group, r, m``: means of ``picks`` values of a group drawn with replacement, ``resamples`` times.

    Draws name places in the group's order, so only as many rows as draws meet the values. Places are found
    in ranges of the first column of the order, so no group comes together.
    """
    places = spread_rank(df, [group], order).withColumnRenamed("_rank", "_k")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    draws = sizes.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(picks))))
    draws = draws.select(group, "r", (F.floor(draw(F.col("r"), F.col("_i"), F.col(group)) * F.col("_n")) + 1).alias("_k"))
    return draws.join(places, [group, "_k"]).groupBy(group, "r").agg((F.sum(value) / F.count(F.lit(1))).alias("m"))


def last_bin(least: float, most: float, width: float) -> int:
    """The last bin's number; bins begin at one below the least value, and the last one takes what is left, up to twice the width."""
    return max(0, math.ceil((most - (least - 1) - 2 * width) / width))


def fixed_width_bins(df: DataFrame, x: str, y: str, width: float, resamples: int = 100) -> DataFrame:
    """``bin, middle, n, mean, lo, hi`` of every bin of equal width; an empty bin has mean 0 and no interval.

    The last bin's middle lies between its edge and the greatest value. Intervals are those of resamples of
    exactly a bin's size (``resampling.exact_intervals``), drawn by distinct values.
    """
    from trackloom.functions.resampling import exact_intervals

    spark = df.sparkSession
    ends = df.agg(F.min(x), F.max(x)).first()
    if ends[0] is None:
        return spark.createDataFrame([], "bin long, middle double, n long, mean double, lo double, hi double")
    least, most = float(ends[0]), float(ends[1])
    last = last_bin(least, most, width)
    left = F.lit(least - 1) + F.col("bin") * F.lit(float(width))
    all_bins = spark.range(last + 1).select(F.col("id").alias("bin")).withColumn("middle", F.when(F.col("bin") == last, (left + F.lit(most)) / 2).otherwise(left + F.lit(width / 2)))
    place = F.least(F.ceil((F.col(x) - F.lit(least - 1)) / F.lit(width)) - 1, F.lit(last)).cast("long")
    found = exact_intervals(df.withColumn("bin", place), ["bin"], y, resamples)
    return all_bins.join(found, "bin", "left").select("bin", "middle", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"), "lo", "hi")


def log_fit(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """``group, slope, intercept`` of the line through log10 x and log10 y; values that aren't positive don't count."""
    p = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(group, F.log10(x).alias("_x"), F.log10(y).alias("_y"))
    return p.groupBy(group).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"))


def pooled_ranks(counts: DataFrame, rank: str, n: str, least: int) -> DataFrame:
    """``first, last, n``: ranks in order, pooled until a pool has more than ``least`` values; what is left at the end is dropped.

    One row per rank is in play, folded in order.
    """
    ranks = counts.agg(F.sort_array(F.collect_list(F.struct(F.col(rank).cast("long").alias("k"), F.col(n).cast("long").alias("n")))).alias("_all"))
    pool = "array<struct<first:bigint,last:bigint,n:bigint>>"
    start = F.struct(F.lit(None).cast("long").alias("first"), F.lit(0).cast("long").alias("n"), F.array().cast(pool).alias("out"))

    def step(s: Column, r: Column) -> Column:
        first, total = F.coalesce(s["first"], r["k"]), s["n"] + r["n"]
        full = total > least
        done = F.concat(s["out"], F.array(F.struct(first.alias("first"), r["k"].alias("last"), total.alias("n"))))
        return F.struct(F.when(~full, first).alias("first"), F.when(full, F.lit(0).cast("long")).otherwise(total).alias("n"), F.when(full, done).otherwise(s["out"]).alias("out"))

    return ranks.select(F.explode(F.aggregate("_all", start, step, lambda s: s["out"])).alias("p")).select("p.*")


def spread_rank(df: DataFrame, keys: list[str], order: list[str], parts: int = 64, weight: str | None = None) -> DataFrame:
    """Add ``_rank`` (from 1) of each row within ``keys`` by ``order``, without a task that holds a whole group.

    Rows are dealt to ranges of the first column of the order by approximate quantiles of each group, a
    bounded sketch; counts of ranges give the rank where each begins, and each range is ranked on its own.
    With ``weight``, ``_before`` is the sum of that column over the rows that come earlier.
    """
    at = [i / parts for i in range(1, parts)]
    # written down: the sketch depends on the order in which parts come in, and both uses must see the same cuts
    cuts = stored(df.groupBy(*keys).agg(F.percentile_approx(order[0], at, 1000).alias("_cuts")), "rank-cuts")
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    on = reduce(lambda a, b: a & b, same)
    dealt = df.alias("d").join(cuts.alias("c"), on).select("d.*", F.size(F.filter(F.col("_cuts"), lambda e: e < F.col(f"d.{order[0]}"))).alias("_range"))
    heavy = F.col(weight).cast("long") if weight else F.lit(0).cast("long")
    sizes = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(heavy).alias("_w"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_heavier"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    ranked = dealt.withColumn("_k", F.row_number().over(within))
    if weight:
        ranked = ranked.withColumn("_s", F.coalesce(F.sum(heavy).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = ranked.alias("d").join(starts.alias("c"), [*same, F.col("d._range") == F.col("c._range")])
    sums = [(F.col("_heavier") + F.col("_s")).cast("long").alias("_before")] if weight else []
    return joined.select(*[F.col(f"d.{c}") for c in df.columns], (F.col("_earlier") + F.col("_k")).cast("long").alias("_rank"), *sums)


def exact_percentiles(df: DataFrame, key: str, value: str, shares: list[float], parts: int = 64) -> DataFrame:
    """``key, p0, p1, ...``: linear percentiles of few large groups: values are ranked in ranges, and two of them interpolate each."""
    rows = df.where(F.col(value).isNotNull()).select(key, value)
    ranked = spread_rank(rows, [key], [value], parts)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    joined = ranked.alias("d").join(sizes.alias("c"), F.col(f"d.{key}").eqNullSafe(F.col(f"c.{key}"))).select(F.col(f"d.{key}"), F.col(f"d.{value}").alias("_v"), "_rank", "_n")
    place = [1 + s * (F.col("_n") - 1) for s in shares]
    picks = []
    for i, p in enumerate(place):
        picks += [F.max(F.when(F.col("_rank") == F.floor(p), F.col("_v"))).alias(f"_a{i}"), F.max(F.when(F.col("_rank") == F.ceil(p), F.col("_v"))).alias(f"_b{i}")]
    got = joined.groupBy(key).agg(F.first("_n").alias("_n"), *picks)
    between = [(F.col(f"_a{i}") + (p - F.floor(p)) * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(f"p{i}") for i, p in enumerate(place)]
    return got.select(key, *between)


def moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """``n, mean, m2, m3, m4`` by group: central moments about the group's mean, in two passes."""
    mean = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.avg(value).alias("mean"))
    d = df.join(mean, group).withColumn("_d", F.col(value) - F.col("mean"))
    return d.groupBy(group).agg(F.count("_d").alias("n"), F.first("mean").alias("mean"), *[F.avg(F.pow("_d", F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)])


def normality(m: DataFrame) -> DataFrame:
    """D'Agostino and Pearson's K squared and its p by group; groups of fewer than 8 values, or of one value, have none."""
    n, skew, kurt = F.col("n").cast("double"), F.col("m3") / F.pow("m2", F.lit(1.5)), F.col("m4") / (F.col("m2") * F.col("m2"))
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    spread = F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    x = (kurt - 3 * (n - 1) / (n + 1)) / spread
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    below = 1 + x * F.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - F.signum(below) * F.cbrt((1 - 2 / a) / F.abs(below))) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    usable = (F.col("n") >= 8) & (F.col("m2") > 0)
    return m.withColumn("k2", F.when(usable, k2)).withColumn("p", F.exp(-F.col("k2") / 2))


def equal_means(df: DataFrame, group: str, value: str) -> DataFrame:
    """Alexander and Govern's test of equal means under unequal variances: one row ``k, statistic, p``; p is of four groups alone."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("n > 1 and v > 0")
    g = g.withColumn("w", F.col("n") / F.col("v"))
    common = g.agg((F.sum(F.col("w") * F.col("m")) / F.sum("w"))).scalar()
    t = (F.col("m") - common) * F.sqrt("w")
    nu = F.col("n") - 1.0
    a = nu - 0.5
    b = 48 * a * a
    c = F.sqrt(a * F.log(1 + t * t / nu))
    z = c + (c**3 + 3 * c) / b - (4 * c**7 + 33 * c**5 + 240 * c**3 + 855 * c) / (10 * b * b + 8 * b * c**4 + 1000 * b)
    out = g.agg(F.count(F.lit(1)).alias("k"), F.sum(z * z).alias("statistic"))
    return out.withColumn("p", F.when(F.col("k") == 4, chi2_tail_3(F.col("statistic"))))


def erfc(z: Column) -> Column:
    """The complementary error function of a number that isn't negative: its series up to 4, then its asymptotic form; to about 1e-9."""
    sign = lambda i: F.when(i % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    start = F.struct(z.alias("term"), F.lit(0.0).alias("sum"))
    # term i is z ** (2 i + 1) / i!
    series = F.aggregate(
        F.sequence(F.lit(0), F.lit(79)),
        start,
        lambda s, i: F.struct((s["term"] * z * z / (i + 1)).alias("term"), (s["sum"] + sign(i) * s["term"] / (2 * i + 1)).alias("sum")),
        lambda s: 1 - s["sum"] * (2 / math.sqrt(math.pi)),
    )
    far = F.exp(-z * z) / (z * math.sqrt(math.pi)) * (1 - 1 / (2 * z * z) + 3 / (4 * z * z * z * z))
    return F.when(z < 4, series).otherwise(far)


def chi2_tail_3(x: Column) -> Column:
    """Probability that a chi-squared variable of three degrees of freedom exceeds ``x``."""
    return erfc(F.sqrt(x / 2)) + F.sqrt(2 * x / math.pi) * F.exp(-x / 2)


def box(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whisker ends (the furthest values within 1.5 times the box) and counts by group; ``resampling.notches`` gives the notch."""
    q = exact_percentiles(df, group, value, [0.25, 0.5, 0.75]).select(F.col(group), F.array("p0", "p1", "p2").alias("q"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = F.col(value).between(F.col("q")[0] - reach, F.col("q")[2] + reach)
    return df.join(q, group).groupBy(group).agg(
        F.first("q").alias("q"), F.count(value).alias("n"), F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high")
    ).select(group, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "low", "high")


def equal_count_bins(df: DataFrame, group: str, x: str, y: str, tie: list[str], size: int) -> DataFrame:
    """Bins of ``size`` rows in order of x (then ``tie``) within a group: ``group, bin, n, low, high, sum_y``."""
    b = spread_rank(df, [group], [x, *tie]).withColumn("bin", F.floor((F.col("_rank") - 1) / size).cast("long"))
    return b.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.sum(y).alias("sum_y"))
