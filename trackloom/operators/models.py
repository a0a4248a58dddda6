"""Models of foraging: intake, recovery, transition shares, turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.sources.tables import stored


def feeding_rate(t: Column, tau: Column) -> Column:
    return F.exp(-t / tau)


def stay_length(tau: Column, threshold: Column, spent: Column) -> Column:
    """Whole time until the rate falls to ``threshold``, less the time already spent; never negative."""
    return F.greatest(F.lit(0).cast("long"), (-tau * F.log(threshold) - spent).cast("long"))


def recovered_speed(t: Column, low: float, high: float, scale: float) -> Column:
    """Speed that recovers exponentially from ``low`` to ``high``."""
    return high - (high - low) * F.exp(-t / scale)


def with_revisits(transitions: DataFrame, p_stay: float) -> DataFrame:
    """Transition shares with ``p_stay`` for returns to the same region, the rest of a row scaled to what is left.

    A row of returns only keeps its shares, as nothing else could be scaled.
    """
    row = Window.partitionBy("src")
    other = F.sum(F.when(F.col("src") != F.col("dst"), F.col("p")).otherwise(0.0)).over(row)
    scaled = F.when(F.col("src") == F.col("dst"), F.lit(p_stay)).otherwise(F.col("p") * (1 - p_stay) / F.col("_other"))
    has_self = F.max((F.col("src") == F.col("dst")).cast("int")).over(row) == 1
    t = transitions.withColumns({"_other": other, "_self": has_self})
    return t.withColumn("p_new", F.when((F.col("_other") == 0) | ~F.col("_self"), F.col("p")).otherwise(scaled)).drop("_other", "_self")


def recovery_fit(points: DataFrame, group: str, t: str, y: str, scales: list[float], steps: int = 5, damping: float = 1e-3) -> DataFrame:
    """``group, n, low, high, scale``: least-squares parameters of ``recovered_speed`` for the points (t, y) of each group.

    For a given scale the model is a straight line in exp(-t / scale), so the best of ``scales`` starts the search. Each
    Gauss-Newton step is one aggregate of the normal equations by group, whose three unknowns are solved in closed
    form (a little damping keeps them solvable; a scale changes by a factor of three at most in a step). Points
    never leave the executors. Groups of fewer than four points, or without spread in y, have no row.
    """
    p = stored(points.select(F.col(group).alias("_g"), F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_y")).where("_t is not null and _y is not null"), "recovery-points")
    tried = p.withColumn("s", F.explode(F.array(*[F.lit(float(v)) for v in scales]))).withColumn("_e", -F.exp(-F.col("_t") / F.col("s")))
    line = tried.groupBy("_g", "s").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_e").alias("b"), F.regr_intercept("_y", "_e").alias("a"), F.regr_syy("_y", "_e").alias("_syy"), F.regr_sxy("_y", "_e").alias("_sxy"))
    line = line.where("n >= 4 and b is not null and _syy > 0").withColumn("_left", F.round(F.col("_syy") - F.col("b") * F.col("_sxy"), 9))
    theta = line.groupBy("_g").agg(F.min_by(F.struct("n", "a", "b", "s"), F.struct("_left", "s")).alias("p")).select("_g", "p.*")
    for _ in range(steps):
        d = p.join(theta.drop("n"), "_g")
        e = F.exp(-F.col("_t") / F.col("s"))
        grad = [F.lit(1.0), -e, -F.col("b") * e * F.col("_t") / (F.col("s") * F.col("s"))]
        off = F.col("_y") - (F.col("a") - F.col("b") * e)
        sums = [F.sum(grad[i] * grad[j]).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)] + [F.sum(grad[i] * off).alias(f"v{i}") for i in range(3)]
        q = d.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("s").alias("s"), *sums)
        m = [[F.col(f"m{min(i, j)}{max(i, j)}") * (1 + damping if i == j else 1.0) for j in range(3)] for i in range(3)]
        v = [F.col(f"v{i}") for i in range(3)]
        whole = _determinant(m)
        move = [F.coalesce(F.try_divide(_determinant([[v[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]), whole), F.lit(0.0)) for k in range(3)]
        s = F.col("s")
        theta = q.select("_g", "n", (F.col("a") + move[0]).alias("a"), (F.col("b") + move[1]).alias("b"), F.least(F.greatest(s + move[2], s / 3), s * 3).alias("s"))
    return theta.select(F.col("_g").alias(group), "n", (F.col("a") - F.col("b")).alias("low"), F.col("a").alias("high"), F.col("s").alias("scale"))


def _determinant(m: list[list[Column]]) -> Column:
    return sum((m[0][i] * (m[1][(i + 1) % 3] * m[2][(i + 2) % 3] - m[1][(i + 2) % 3] * m[2][(i + 1) % 3]) for i in (1, 2)), m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]))


def since_exit(obs: DataFrame) -> DataFrame:
    """Add ``since_us``: the time since the plate's last row inside of a region, null before the first."""
    order = Window.partitionBy("plate").orderBy("ord")
    return obs.withColumn("since_us", F.col("t") - F.last(F.when(F.col("region") >= 0, F.col("t")), True).over(order))


def _moves(visits: DataFrame, group: str, ranks: int) -> DataFrame:
    order = Window.partitionBy("plate").orderBy("start", "end", "region")
    v = visits.select("plate", F.col(group).alias("g"), "region", F.row_number().over(order).alias("_n"), (F.col("end") - F.col("start")).alias("stay"), F.lead("region").over(order).alias("dst"), (F.lead("start").over(order) - F.col("end")).alias("travel"))
    return stored(v.withColumn("rank", F.least("_n", F.lit(ranks))), "exchange-visits")


def _chain(v: DataFrame, ranks: int, length: int) -> tuple[DataFrame, DataFrame]:
    """Expected visits ``g, k, region, m`` and moves ``g, k, region, dst, m`` of the chain that starts as the groups' plates do."""
    made = v.groupBy("g", "rank", "region").agg(F.count(F.lit(1)).alias("_all"))
    moves = v.where("dst is not null").groupBy("g", "rank", "region", "dst").agg(F.count(F.lit(1)).alias("_n"))
    share = stored(moves.join(made, ["g", "rank", "region"]).select("g", "rank", "region", "dst", (F.col("_n") / F.col("_all")).alias("p")), "exchange-shares")
    first = v.where("_n = 1").groupBy("g", "region").agg(F.count(F.lit(1)).alias("m"))
    now = first.join(first.groupBy("g").agg(F.sum("m").alias("_all")), "g").select("g", "region", (F.col("m") / F.col("_all")).alias("m"))
    seen, flows = [], []
    for k in range(1, length + 1):
        now = stored(now, "exchange-expected")
        seen.append(now.select("g", F.lit(k).alias("k"), "region", "m"))
        if k == length and flows:
            break
        step = now.join(share.where(F.col("rank") == min(k, ranks)), ["g", "region"]).select("g", "region", "dst", (F.col("m") * F.col("p")).alias("m"))
        flows.append(step.select("g", F.lit(k).alias("k"), "region", "dst", "m"))
        now = step.groupBy("g", F.col("dst").alias("region")).agg(F.sum("m").alias("m"))
    return reduce(DataFrame.unionByName, seen), reduce(DataFrame.unionByName, flows)


def expected_visits(visits: DataFrame, group: str, ranks: int = 4, length: int = 8) -> DataFrame:
    """``group, k, region, m``: the share of plates that are expected to make their k-th visit, and to which region.

    A Markov chain of visits in expected values: the first visits are the group's own, moves from then on have the
    shares that they had at that rank (``ranks`` and later as one), and plates whose visits end drop out. The k-th
    distribution is the one before times a sparse matrix, a join and a sum.
    """
    return _chain(_moves(visits, group, ranks), ranks, length)[0].withColumnRenamed("g", group)


def walk_spread(obs: DataFrame, group: str, lags: list[int]) -> DataFrame:
    """``group, n, expected, observed``: mean squared displacement after n steps, of a correlated walk and of the ways themselves.

    A walk with independent step lengths of mean l and mean square q, and independent turns of mean cosine c, has
    n q + 2 l l c / (1 - c) (n - (1 - c ** n) / (1 - c)), or n q + l l n (n - 1) if it never turns. These means are one aggregate over the steps of tracks;
    steps of no length don't turn. Observed displacements are those of rows n apart on a track.
    """
    order = Window.partitionBy("plate", "track").orderBy("ord")
    y = F.col("y") * 100
    way = obs.withColumns({"_dx": F.col("x") - F.lag("x").over(order), "_dy": y - F.lag(y).over(order)})
    way = way.withColumns({"_px": F.lag("_dx").over(order), "_py": F.lag("_dy").over(order), "_l2": (F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")).cast("double")})
    before = (F.col("_px") * F.col("_px") + F.col("_py") * F.col("_py")).cast("double")
    cos = F.try_divide((F.col("_px") * F.col("_dx") + F.col("_py") * F.col("_dy")).cast("double"), F.sqrt(before * F.col("_l2")))
    far = [(F.pow(F.lead("x", n).over(order) - F.col("x"), F.lit(2)) + F.pow(F.lead(y, n).over(order) - y, F.lit(2))).alias(f"_r{n}") for n in lags]
    rows = way.select(group, F.sqrt("_l2").alias("_l"), "_l2", cos.alias("_c"), *far)
    means = rows.groupBy(group).agg(F.avg("_l").alias("l"), F.avg("_l2").alias("q"), F.avg("_c").alias("c"), *[F.avg(f"_r{n}").alias(f"_r{n}") for n in lags])
    n, c = F.col("v.n"), F.col("c")
    out = means.withColumn("v", F.explode(F.array(*[F.struct(F.lit(k).alias("n"), F.col(f"_r{k}").alias("r")) for k in lags])))
    turned = F.when(F.abs(1 - c) < 1e-9, n * (n - 1) / 2).otherwise(F.try_divide(c, 1 - c) * (n - F.try_divide(1 - F.pow(c, n), 1 - c)))
    expected = n * F.col("q") + 2 * F.col("l") * F.col("l") * turned
    return out.select(group, F.col("v.n").cast("long").alias("n"), expected.alias("expected"), F.col("v.r").alias("observed"))


def exchanged_behaviour(visits: DataFrame, group: str, ranks: int = 4, length: int = 8) -> DataFrame:
    """``moves_of, stays_of, visits, stay_us, travel_us``: what plates are expected to do that move like one group and stay like another.

    ``visits`` has plate, ``group``, start, end, region. Shares of moves by rank of the visit (``ranks`` and later as
    one) are a sparse matrix; the expected number of visits to each region at the next rank is the current one
    times that matrix, a join and a sum, for ``length`` visits from the first on. Plates whose visits end take no
    further part, by the share that ended. Mean stays by region and mean travels by move of the other
    group turn expected visits and moves into times; regions or moves that it doesn't have take no time. All
    ordered pairs of groups are given, each with itself as well; nothing is drawn.
    """
    v = _moves(visits, group, ranks)
    seen, flows = _chain(v, ranks, length)
    at = seen.groupBy(F.col("g").alias("moves_of"), "region").agg(F.sum("m").alias("m"))
    went = flows.groupBy(F.col("g").alias("moves_of"), "region", "dst").agg(F.sum("m").alias("m"))
    stays = v.groupBy(F.col("g").alias("stays_of"), "region").agg(F.avg("stay").alias("us"))
    travels = v.where("dst is not null").groupBy(F.col("g").alias("stays_of"), "region", "dst").agg(F.avg("travel").alias("us"))
    pairs = [F.col("moves_of"), F.col("stays_of")]
    stay = at.join(stays, "region").groupBy(*pairs).agg(F.sum(F.col("m") * F.col("us")).alias("stay_us"))
    travel = went.join(travels, ["region", "dst"]).groupBy(*pairs).agg(F.sum(F.col("m") * F.col("us")).alias("travel_us"))
    total = at.groupBy("moves_of").agg(F.sum("m").alias("visits"))
    out = stay.join(travel, ["moves_of", "stays_of"], "left").join(total, "moves_of")
    return out.select("moves_of", "stays_of", "visits", "stay_us", F.coalesce("travel_us", F.lit(0.0)).alias("travel_us"))


def intake_rates(stays: DataFrame, taus: list[float], travel_s: float) -> DataFrame:
    """Mean intake of observed stays (``dur_s`` seconds) under exponential depletion, by ``grp``: a whole stay's intake in closed form."""
    grid = stays.withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    gain = F.col("tau") * (1 - F.exp(-F.col("dur_s") / F.col("tau")))
    sums = grid.groupBy("grp", "tau").agg(F.count(F.lit(1)).alias("n"), F.sum(gain).alias("gain"), F.sum("dur_s").alias("dur_s"))
    return sums.select("grp", "tau", "n", (F.col("gain") / (F.col("dur_s") + F.col("n") * travel_s)).alias("rate"))


def null_revisits(visits: DataFrame, group: str, taus: list[float], thresholds: list[float], unit_us: float = 3.6e9) -> DataFrame:
    """``group, tau, thr, p_back, stay, rate``: expected intake of a forager that leaves at a threshold and at times returns to the region it left.

    A region's rate falls as exp(-t / tau) and the forager stays until it is ``thr``, so a return at once finds nothing
    to stay for. The share of such returns and the mean travels back and across are the group's own; then a visit
    gains tau (1 - thr) in -tau ln(thr) where it isn't a return, and intake over time is the ratio of expected values. Times
    are in units of ``unit_us``. Groups without moves have no row.
    """
    order = Window.partitionBy("plate").orderBy("start", "end", "region")
    moves = visits.select(group, "region", F.lead("region").over(order).alias("dst"), (F.lead("start").over(order) - F.col("end")).alias("travel")).where("dst is not null")
    back = F.col("region") == F.col("dst")
    own = moves.groupBy(group).agg(
        (F.count_if(back) / F.count(F.lit(1))).alias("p_back"),
        (F.coalesce(F.sum(F.when(back, F.col("travel"))), F.lit(0)) / F.count(F.lit(1)) / unit_us).alias("_back"),
        (F.coalesce(F.sum(F.when(~back, F.col("travel"))), F.lit(0)) / F.count(F.lit(1)) / unit_us).alias("_across"),
    )
    g = own.withColumn("tau", F.explode(F.array(*map(F.lit, taus)))).withColumn("thr", F.explode(F.array(*map(F.lit, thresholds))))
    stay, fresh = -F.col("tau") * F.log("thr"), 1 - F.col("p_back")
    rate = F.try_divide(fresh * F.col("tau") * (1 - F.col("thr")), fresh * stay + F.col("_back") + F.col("_across"))
    return g.select(group, "tau", "thr", "p_back", stay.alias("stay"), rate.alias("rate"))


def turns(obs: DataFrame, width_deg: int) -> DataFrame:
    """Turning angles of observed ways by plate: counts and mean step by bins of ``width_deg`` degrees in (-180, 180]."""
    order = Window.partitionBy("plate", "track").orderBy("ord")
    way = obs.withColumns({"_dx": F.col("x") - F.lag("x").over(order), "_dy": (F.col("y") - F.lag("y").over(order)) * 100})
    way = way.withColumns({"_px": F.lag("_dx").over(order), "_py": F.lag("_dy").over(order)})
    way = way.where("(_dx <> 0 or _dy <> 0) and (_px <> 0 or _py <> 0)")
    cross, dot = F.col("_px") * F.col("_dy") - F.col("_py") * F.col("_dx"), F.col("_px") * F.col("_dx") + F.col("_py") * F.col("_dy")
    deg = F.degrees(F.atan2(cross.cast("double"), dot.cast("double")))
    step = F.floor(F.sqrt((F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")).cast("double")) + 0.5).cast("long")
    bins = way.withColumns({"bin": F.floor(deg / width_deg).cast("long"), "step": step})
    return bins.groupBy("plate", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("sum_step"))
