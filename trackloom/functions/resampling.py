"""Resamples of exactly as many values as there are, by counts: nested binomial splits over distinct values."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.stats import spread_rank
from trackloom.sources.tables import stored

#: Up to this mean a binomial number is drawn by inversion, in at most so many steps; beyond it as a rounded normal one.
SMALL_MEAN, MOST_STEPS = 30, 120


def uniforms(*parts: Column) -> tuple[Column, Column]:
    """Two numbers in [0, 1) that depend on the parts alone: 32 bits each of their MD5, which any SQL engine can compute."""
    text = F.md5(F.concat_ws(",", *[p.cast("string") for p in parts]))
    return tuple(F.conv(F.substring(text, at, 8), 16, 10).cast("long") / float(1 << 32) for at in (1, 9))


def binomial(n: Column, p: Column, u: Column, v: Column) -> Column:
    """A binomial number of ``n`` trials (one or more) at ``p``, drawn from two uniform numbers.

    Where the mean of hits or of misses is at most SMALL_MEAN it is the inverse of the distribution at ``u``, exactly;
    beyond that a normal number of the same mean and variance is rounded and cut to 0 to n.
    """
    rare = F.least(p, 1 - p)
    odds = rare / (1 - rare)
    none = F.pow(1 - rare, n)
    # the share of the next number, the share of those up to k, and k
    start = F.struct((none * n / 1 * odds).alias("next"), none.alias("below"), F.lit(0).cast("long").alias("k"), odds.alias("odds"))

    def step(s: Column, i: Column) -> Column:
        more = s["below"] < u
        return F.struct(
            (s["next"] * (n - i) / (i + 1) * s["odds"]).alias("next"),
            F.when(more, s["below"] + s["next"]).otherwise(s["below"]).alias("below"),
            F.when(more, i).otherwise(s["k"]).alias("k"),
            s["odds"].alias("odds"),
        )

    # beyond ten standard deviations there is nothing that 32 bits could draw
    steps = F.least(n, F.ceil(n * rare + 10 * F.sqrt(n * rare)) + 12, F.lit(MOST_STEPS)).cast("long")
    few = F.aggregate(F.sequence(F.lit(1).cast("long"), steps), start, step, lambda s: s["k"])
    z = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
    many = F.floor(n * p + F.sqrt(n * p * (1 - p)) * z + 0.5)
    return F.when(n * rare <= SMALL_MEAN, F.when(p <= 0.5, few).otherwise(n - few)).otherwise(F.greatest(F.lit(0), F.least(n, many))).cast("long")


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _leaves(df: DataFrame, keys: list[str], value: str, resamples: int, follow) -> tuple[DataFrame, DataFrame]:
    """Distinct values with counts, and the leaves of all resamples: ``keys, r, value, n, off, total``.

    The distinct values of a group stand in order as leaves of a tree. A resample of a group of N rows
    begins with N draws at the root; each node passes a binomial share of its draws to its left half,
    by the rows that lie there, and the rest to the right. So counts add up to N in each resample, a
    level is one join on the cumulated counts at the middles of nodes, and work grows with distinct values, not
    rows. Nodes without draws end, and so do those that ``follow`` (of draws before, draws and total) turns down.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    cells = stored(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")), "resampled-values")
    ranked = stored(spread_rank(cells, keys, [value], weight="_c"), "resampled-ranks")
    totals = ranked.groupBy(*keys).agg(F.max("_rank").alias("_m"), F.sum("_c").alias("total"))
    depth = math.ceil(math.log2(max(1, totals.agg(F.max("_m")).first()[0] or 1)))
    zero = F.lit(0).cast("long")
    nodes = totals.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r"), zero.alias("j"), F.col("total").alias("n"), zero.alias("lo"), F.col("total").alias("hi"), zero.alias("off"), "total")
    for level in range(depth):
        width = 1 << (depth - level)
        d, c = nodes.alias("d"), ranked.alias("c")
        met = d.join(c, _same(keys, "d", "c") & (F.col("c._rank") - 1 == F.col("d.j") * width + width // 2), "left").select("d.*", F.coalesce("c._before", "d.hi").alias("mid"))
        u, v = uniforms(*[F.col(k) for k in keys], F.col("r"), F.lit(level), F.col("j"))
        met = met.withColumns({"p": (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo")), "u": u, "v": v})
        split = met.withColumn("x", F.when(F.col("mid") == F.col("hi"), F.col("n")).otherwise(binomial(F.col("n"), F.col("p"), F.col("u"), F.col("v"))))
        made = [("j", F.col("j") * 2, F.col("j") * 2 + 1), ("n", F.col("x"), F.col("n") - F.col("x")), ("lo", F.col("lo"), F.col("mid")), ("hi", F.col("mid"), F.col("hi")), ("off", F.col("off"), F.col("off") + F.col("x"))]
        halves = F.array(*[F.struct(*[m[side].cast("long").alias(m[0]) for m in made]) for side in (1, 2)])
        nodes = split.select(*keys, "r", "total", F.explode(halves).alias("h")).select(*keys, "r", "total", "h.*").where(F.col("n") > 0)
        if follow is not None:
            nodes = nodes.where(follow(F.col("off"), F.col("n"), F.col("total")))
    d, c = nodes.alias("d"), ranked.alias("c")
    found = d.join(c, _same(keys, "d", "c") & (F.col("c._rank") - 1 == F.col("d.j"))).select(*[F.col(f"d.{k}") for k in keys], "d.r", F.col(f"c.{value}").alias(value), "d.n", "d.off", "d.total")
    return cells, found


def resample_counts(df: DataFrame, keys: list[str], value: str, resamples: int) -> DataFrame:
    """``keys, r, value, n``: how often each of ``resamples`` resamples with replacement has each distinct value; n adds up to a group's size.

    Null values and NaN don't count. The draws depend on group, resample and place alone, so reruns agree.
    """
    return _leaves(df, keys, value, resamples, None)[1].select(*keys, "r", value, "n")


def exact_means(df: DataFrame, keys: list[str], value: str, resamples: int) -> DataFrame:
    """``keys, r, n, m``: the mean of each group (r = 0) and of ``resamples`` resamples of exactly its size."""
    cells, leaves = _leaves(df, keys, value, resamples, None)
    own = cells.select(*keys, F.lit(0).alias("r"), value, F.col("_c").alias("n"))
    both = own.unionByName(leaves.select(*keys, "r", value, "n"))
    return both.groupBy(*keys, "r").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col(value)) / F.sum("n")).alias("m"))


def exact_intervals(df: DataFrame, keys: list[str], value: str, resamples: int = 1000) -> DataFrame:
    """``keys, n, mean, lo, hi``: means of groups and the 2.5 and 97.5 percentiles of the means of resamples of their size."""
    drawn = F.when(F.col("r") > 0, F.col("m"))
    return exact_means(df, keys, value, resamples).groupBy(*keys).agg(
        F.max(F.when(F.col("r") == 0, F.col("n"))).alias("n"), F.max(F.when(F.col("r") == 0, F.col("m"))).alias("mean"),
        F.percentile(drawn, F.lit(0.025)).alias("lo"), F.percentile(drawn, F.lit(0.975)).alias("hi"),
    )


def resampled_quantiles(df: DataFrame, keys: list[str], value: str, resamples: int, share: float = 0.5) -> DataFrame:
    """``keys, r, m``: a linear quantile (the median) of each resample.

    Only the branches of the tree that hold the two places about the quantile are followed, so a resample
    costs as many draws as the tree has levels, however many values there are.
    """
    place = lambda total: 1 + F.lit(share) * (total - 1)
    holds = lambda at, off, n: (off < at) & (at <= off + n)
    follow = lambda off, n, total: holds(F.floor(place(total)), off, n) | holds(F.ceil(place(total)), off, n)
    leaves = _leaves(df, keys, value, resamples, follow)[1]
    at = place(F.col("total"))
    low = F.max(F.when(holds(F.floor(at), F.col("off"), F.col("n")), F.col(value)))
    high = F.max(F.when(holds(F.ceil(at), F.col("off"), F.col("n")), F.col(value)))
    part = F.max(at - F.floor(at))
    return leaves.groupBy(*keys, "r").agg((low + part * (high - low)).alias("m"))


def notches(df: DataFrame, keys: list[str], value: str, resamples: int = 1000) -> DataFrame:
    """``keys, notch_low, notch_high``: the 2.5 and 97.5 percentiles of the medians of resamples."""
    m = resampled_quantiles(df, keys, value, resamples)
    return m.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("notch_low"), F.percentile("m", F.lit(0.975)).alias("notch_high"))
