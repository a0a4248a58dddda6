"""Resamples by counts: exact sizes, moments of the draws, medians without repeated rows; ranks in ranges."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trackloom.functions import resampling as rs
from trackloom.functions import stats


def test_sizes_and_moments(spark):
    """Counts of each resample add up to the group's size; a value's count has the mean and variance of a binomial one."""
    rng = random.Random(1)
    rows = [("a", float(rng.choice([1, 1, 1, 2, 5, 8, 13]))) for _ in range(400)] + [("b", float(i)) for i in range(37)] + [(None, 4.0)] * 5 + [("a", None), ("b", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = rs.resample_counts(df, ["g"], "v", 300).collect()
    sizes = Counter()
    counts = defaultdict(list)
    for r in got:
        sizes[r.g, r.r] += r.n
        counts[r.g, r.v].append(r.n)
    assert {(g, n) for (g, _), n in sizes.items()} == {("a", 400), ("b", 37), (None, 5)} and len(sizes) == 900
    own = Counter((g, v) for g, v in rows if v is not None and not math.isnan(v))
    for (g, v), c in own.items():
        n = {"a": 400, "b": 37, None: 5}[g]
        drawn = counts[g, v] + [0] * (300 - len(counts[g, v]))
        mean, p = sum(drawn) / 300, c / n
        var = sum((x - mean) ** 2 for x in drawn) / 299
        want = n * p * (1 - p)
        assert abs(mean - n * p) <= 5 * math.sqrt(want / 300) + 1e-9
        assert want == 0 and var == 0 or 0.6 * want < var < 1.5 * want
    assert rs.resample_counts(df, ["g"], "v", 300).exceptAll(rs.resample_counts(df, ["g"], "v", 300)).isEmpty()


@pytest.mark.parametrize("n,p", [(1, 0.3), (20, 0.5), (1000, 0.01), (1000, 0.99), (5000, 0.4), (7, 0.0), (7, 1.0)])
def test_binomial(spark, n, p):
    u, v = rs.uniforms(F.col("id"))
    r = spark.range(4000).select(rs.binomial(F.lit(n).cast("long"), F.lit(p), u, v).alias("k")).agg(F.avg("k").alias("m"), F.var_samp("k").alias("v"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    want = n * p * (1 - p)
    assert abs(r.m - n * p) <= 5 * math.sqrt(want / 4000) + 1e-9 and 0.85 * want - 1e-9 <= r.v <= 1.15 * want + 0.2 * (want > 0)
    assert 0 <= r.lo and r.hi <= n


def test_medians(spark):
    """The quantile of a resample is that of its values written out."""
    rng = random.Random(2)
    df = spark.createDataFrame([(g, rng.randrange(50)) for g in (1, 2) for _ in range(60 + g)], "g int, v long")
    drawn = defaultdict(list)
    for r in rs.resample_counts(df, ["g"], "v", 40).collect():
        drawn[r.g, r.r] += [r.v] * r.n
    for share in (0.5, 0.1):
        got = {(r.g, r.r): r.m for r in rs.resampled_quantiles(df, ["g"], "v", 40, share).collect()}
        assert set(got) == set(drawn)
        for key, values in drawn.items():
            values.sort()
            at = share * (len(values) - 1)
            a, b = values[math.floor(at)], values[math.ceil(at)]
            assert math.isclose(got[key], a + (at - math.floor(at)) * (b - a))


def test_intervals_of_few(spark):
    one = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("b", 1.0), ("c", None)], "g string, v double")
    got = {r.g: (r.n, r["mean"], r.lo, r.hi) for r in rs.exact_intervals(one, ["g"], "v", 20).collect()}
    assert got == {"a": (1, 3.0, 3.0, 3.0), "b": (2, 1.0, 1.0, 1.0)}
    assert rs.exact_intervals(one.limit(0), ["g"], "v", 20).count() == 0


@pytest.mark.parametrize("keys", [["a"], ["a", "b"], ["a", "b", "c"]])
def test_ranks_in_ranges(spark, keys):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), rng.choice("xy"), rng.randrange(2), rng.randrange(9), i, rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, c int, v int, i int, w int")
    got = stats.spread_rank(df, keys, ["v", "i"], parts=4, weight="w").collect()
    assert len(got) == 300
    groups = defaultdict(list)
    for r in got:
        groups[tuple(r[k] for k in keys)].append(r)
    for own in groups.values():
        own.sort(key=lambda r: (r.v, r.i))
        assert [r._rank for r in own] == list(range(1, len(own) + 1))
        assert [r._before for r in own] == [sum(x.w for x in own[:k]) for k in range(len(own))]


def test_ranges_are_cut_once(spark):
    """Ranks and the counts before them rest on the same cuts, though a sketch of quantiles may differ from run to run."""
    df = spark.createDataFrame([("a", float(i % 97), i) for i in range(500)], "g string, v double, i int")
    assert "percentile_approx" not in stats.spread_rank(df, ["g"], ["v", "i"], parts=4)._jdf.queryExecution().toString()


def test_a_row_is_digested_once_a_resample(spark):
    """The digest that decides how often a row enters a resample is taken once, not for each number of times; the numbers stay those of ``draw``."""
    df = spark.createDataFrame([("a", float(i), i) for i in range(30)], "g string, v double, i int")
    out = stats.resampled_means(df, ["g"], "v", ["i"], 20)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    u = df.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("u", stats.draw(F.col("r"), F.col("i"))).collect()
    n, s = Counter(), Counter()
    for row in u:
        w = 1 if row.r == 0 else sum(row.u >= p for p in stats.POISSON)
        n[row.r] += w
        s[row.r] += w * row.v
    assert {(r.r, r.n): r.m for r in out.collect()} == {(r, n[r]): s[r] / n[r] for r in n}
