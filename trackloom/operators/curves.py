"""Curves over visits: gap thresholds, delays before leaving, first passage, speeds at borders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.stats import bin_index
from trackloom.operators import space as sp


def threshold_totals(v: DataFrame, thresholds_us: list[int]) -> DataFrame:
    """Number and time of visits merged at each gap threshold: ``plate, threshold, n_visits, total_us``.

    Visits of a plate to one region are disjoint, so a merged total is the sum of the stays and of the
    gaps below the threshold: one window serves all thresholds and no list of visits is built.
    """
    order = Window.partitionBy("plate", "region").orderBy("start", "end")
    g = v.select("plate", (F.col("end") - F.col("start")).alias("dur"), F.abs(F.col("start") - F.lag("end").over(order)).alias("gap"))
    long = g.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds_us])))
    near = F.coalesce(F.col("gap") < F.col("threshold"), F.lit(False))
    return long.groupBy("plate", "threshold").agg(
        F.count_if(~near).alias("n_visits"), (F.sum("dur") + F.coalesce(F.sum(F.when(near, F.col("gap"))), F.lit(0))).alias("total_us")
    )


def stays(events: DataFrame, unit_us: int, least: int = 0) -> DataFrame:
    """Stays on the in-region clock in whole units: ``plate, region, begun, units``.

    The first stay in a region counts one unit more, and not at all if it has ``least`` units or
    fewer. The last stay counts only if it ends before the plate's last transit starts.
    """
    v = events.where("region >= 0")
    last = events.where("region < 0").groupBy("plate").agg(F.max("start").alias("last_out"))
    here = Window.partitionBy("plate", "region").orderBy("start", "end")
    units = F.floor(F.col("end") / unit_us) - F.floor(F.col("start") / unit_us)
    s = v.select("plate", "region", "start", "end", units.cast("long").alias("units"))
    s = s.withColumns({"is_first": F.row_number().over(here) == 1, "is_last": F.lead("start").over(here).isNull()})
    s = s.withColumn("units", F.when(~F.col("is_first"), F.col("units")).when(F.col("units") > least, F.col("units") + 1).otherwise(0))
    s = s.withColumn("begun", F.sum("units").over(here) - F.col("units")).join(last, "plate", "left")
    return s.where("not is_last or end <= last_out").select("plate", "region", "begun", "units")


def delay_bins(s: DataFrame, edges: list[int]) -> DataFrame:
    """Points, leavings and summed delays by plate and bin [edge, next edge) of time in the region.

    A stay of n units stands for n points with delays n to 1. Their numbers in a bin follow from the
    overlap of two ranges, so no point is ever made.
    """
    ranges = F.array(*[F.struct(F.lit(i).cast("long").alias("bin"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    e = s.where("units > 0").withColumn("r", F.explode(F.filter(ranges, lambda r: (r["a"] < F.col("begun") + F.col("units")) & (r["b"] > F.col("begun")))))
    low = F.greatest(F.col("r.a"), F.col("begun")) - F.col("begun")
    high = F.least(F.col("r.b"), F.col("begun") + F.col("units")) - F.col("begun")
    e = e.select("plate", F.col("r.bin").alias("bin"), "units", low.alias("low"), high.alias("high"))
    n = F.col("high") - F.col("low")
    doubled = n * (2 * F.col("units") - F.col("low") - F.col("high") + 1)
    return e.groupBy("plate", "bin").agg(
        F.sum(n).alias("n_points"), F.count_if(F.col("high") == F.col("units")).alias("n_leaving"), F.floor(F.sum(doubled) / 2).cast("long").alias("sum_delay")
    )


def leaving_probability(by_plate: DataFrame, least_plates: int) -> DataFrame:
    """Mean over plates of the share of points at which the region is left, for bins that enough plates reach."""
    share = by_plate.withColumn("share", F.col("n_leaving") / F.col("n_points"))
    out = share.groupBy("bin").agg(F.count(F.lit(1)).alias("n_plates"), F.round(F.avg("share"), 9).alias("p_leave"))
    return out.where(F.col("n_plates") > least_plates)


def before_visits(censored: DataFrame) -> DataFrame:
    """Uncensored visits and the uncensored transit right before them.

    ``visit_rank`` counts all visits to the region, censored ones too.
    """
    order = Window.partitionBy("plate").orderBy("start2", "end2", "region")
    here = Window.partitionBy("plate", "region").orderBy("start2", "end2")
    before = F.lag(F.struct("start2", "end2", "region", "uncensored")).over(order)
    e = censored.withColumns({"b": before, "visit_rank": F.row_number().over(here).cast("long")})
    touching = (F.col("b.region") < 0) & (F.col("b.end2") == F.col("start2")) & F.col("b.uncensored")
    kept = e.where((F.col("region") >= 0) & F.col("uncensored") & touching)
    return kept.select("plate", "region", "start2", "visit_rank", (F.col("end2") - F.col("start2")).alias("visit_us2"), (F.col("b.end2") - F.col("b.start2")).alias("transit_us2"))


def kind_runs(events: DataFrame) -> DataFrame:
    """Visits and transits that follow each other without a change of kind, as one; breaks stay inside.

    Each run of visits carries the time of the run of transits before it.
    """
    order = Window.partitionBy("plate").orderBy("start2", "end2", "region")
    e = events.withColumn("is_visit", F.col("region") >= 0)
    changed = F.when(F.lag("is_visit").over(order) == F.col("is_visit"), 0).otherwise(1)
    e = e.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order))
    r = e.groupBy("plate", "run").agg(
        F.first("is_visit").alias("is_visit"), F.min("start2").alias("start2"), F.sum(F.col("end2") - F.col("start2")).alias("time_us2"), F.count(F.lit(1)).alias("n_events")
    )
    r = r.withColumn("transit_us2", F.lag("time_us2").over(Window.partitionBy("plate").orderBy("run")))
    return r.where("is_visit and transit_us2 is not null").select("plate", "start2", F.col("time_us2").alias("visit_us2"), "transit_us2", "n_events")


def time_against_visits(v: DataFrame, edges: list[float]) -> DataFrame:
    """Time spent in a region when its number of visits enters a bin; each visit while in the lowest."""
    here = Window.partitionBy("plate", "region").orderBy("start", "end")
    s = v.select("plate", "region", F.row_number().over(here).cast("long").alias("n"), F.sum(F.col("end") - F.col("start")).over(here).alias("spent_us"))
    s = s.withColumn("bin", bin_index(F.col("n"), edges))
    return s.where((F.col("bin") == 0) | (F.col("bin") != bin_index(F.col("n") - 1, edges)))


def first_passage(obs: DataFrame, radii: list[int]) -> DataFrame:
    """Delays from leaving a region until a row is at least a radius from the last inside position.

    ``radius, n_transits, n_passed, delay_us`` over transits that follow a visit. Exits and outside
    rows are rows of one ordered table, so the exit is carried forward and nothing is joined.
    """
    order = Window.partitionBy("plate").orderBy("ord")
    inside = F.col("region") >= 0
    o = obs.withColumn("left", F.last(F.when(inside, F.struct("ord", "t", "x", "y")), True).over(order)).where(~inside & F.col("left").isNotNull())
    dx, dy = F.col("x") - F.col("left.x"), (F.col("y") - F.col("left.y")) * 100
    o = o.select("plate", F.col("left.ord").alias("exit"), (F.col("t") - F.col("left.t")).alias("delay"), (dx * dx + dy * dy).alias("d2"))
    passed = [F.min(F.when(F.col("d2") >= r * r, F.col("delay"))).alias(f"r{i}") for i, r in enumerate(radii)]
    transits = o.groupBy("plate", "exit").agg(*passed)
    long = transits.select(F.explode(F.array(*[F.struct(F.lit(r).cast("long").alias("radius"), F.col(f"r{i}").alias("delay")) for i, r in enumerate(radii)])).alias("p"))
    return long.groupBy(F.col("p.radius").alias("radius")).agg(
        F.count(F.lit(1)).alias("n_transits"), F.count("p.delay").alias("n_passed"), F.coalesce(F.sum("p.delay"), F.lit(0)).alias("delay_us")
    )


def first_passage_uncut(obs: DataFrame, radii: list[int], jump_us: int) -> DataFrame:
    """As ``first_passage``, for transits cut at their first pause of more than ``jump_us``: ``radius, n_transits, n_passed, delay_us``.

    A transit that goes on without such a pause until the plate returns to the same region counts at
    every radius; any other one only at radii that it reached before it was cut.
    """
    order = Window.partitionBy("plate").orderBy("ord")
    inside = F.col("region") >= 0
    last = F.last(F.when(inside, F.struct("ord", "t", "x", "y", "region")), True).over(order)
    back = Window.partitionBy("plate").orderBy(F.desc("ord"))
    after = F.last(F.when(inside, F.struct("t", "region")), True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    o = obs.withColumns({"left": last, "next": after, "pause": F.col("t") - F.lag("t").over(order)}).where(~inside & F.col("left").isNotNull())
    here = Window.partitionBy("plate", "left").orderBy("ord")
    o = o.withColumn("cut", F.max(F.col("pause") > jump_us).over(here))
    dx, dy = F.col("x") - F.col("left.x"), (F.col("y") - F.col("left.y")) * 100
    far = (dx * dx + dy * dy).alias("d2")
    o = o.select("plate", F.col("left.ord").alias("exit"), "ord", "t", "cut", (F.col("t") - F.col("left.t")).alias("delay"), far, (F.col("next.region") == F.col("left.region")).alias("back"), F.col("next.t").alias("back_t"))
    passed = [F.min(F.when(~F.col("cut") & (F.col("d2") >= r * r), F.col("delay"))).alias(f"r{i}") for i, r in enumerate(radii)]
    whole = F.coalesce(F.first("back") & ~F.max("cut") & (F.first("back_t") - F.max("t") <= jump_us), F.lit(False)).alias("whole")
    transits = o.groupBy("plate", "exit").agg(whole, *passed)
    long = transits.select("whole", F.explode(F.array(*[F.struct(F.lit(r).cast("long").alias("radius"), F.col(f"r{i}").alias("delay")) for i, r in enumerate(radii)])).alias("p"))
    return long.groupBy(F.col("p.radius").alias("radius")).agg(
        F.count_if(F.col("whole") | F.col("p.delay").isNotNull()).alias("n_transits"), F.count("p.delay").alias("n_passed"), F.coalesce(F.sum("p.delay"), F.lit(0)).alias("delay_us")
    )


def around_entries(steps: DataFrame, reach: int) -> DataFrame:
    """Mean step at each offset around the first inside row of a visit; windows with missing rows don't count."""
    order = Window.partitionBy("plate").orderBy("ord")
    at = {f"o{k}": F.lead("dist", k).over(order) if k >= 0 else F.lag("dist", -k).over(order) for k in range(-reach, reach + 1)}
    s = steps.withColumns(at | {"prev": F.lag("region").over(order)}).where("region >= 0 and prev < 0")
    s = s.where(F.col(f"o{reach}").isNotNull() & F.col(f"o{-reach}").isNotNull())
    long = s.select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("offset"), F.col(f"o{k}").alias("dist")) for k in range(-reach, reach + 1)])).alias("p"))
    return long.groupBy(F.col("p.offset").alias("offset")).agg(F.count(F.lit(1)).alias("n"), (F.sum("p.dist") / F.count(F.lit(1))).alias("mean_dist"))


def neighbours(centres: DataFrame, factor: float) -> DataFrame:
    """Pairs of regions no farther apart than ``factor`` times the nearest: ``src, dst, d``; one row per region in.

    Regions meet in cells of about the space that one has: first each finds its nearest, then all within reach.
    """
    ends = centres.agg(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy"), F.count(F.lit(1))).first()
    cell = max(ends[0] or 0.0, ends[1] or 0.0) / math.sqrt(max(1, ends[2])) or 1.0
    at = centres.select(F.lit(0).alias("plate"), "region", "cx", "cy")
    points = at.select("plate", F.col("region").alias("src"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    near = sp.nearest(points, at.withColumns({"low": F.col("cx"), "high": F.col("cx") + 1, "by": F.col("cy")}), ["region", "cx", "cy"], F.col("src") != F.col("_t_region"), cell)
    # the distance anew, from the coordinates as they are
    near = near.select("plate", "src", "px", "py", (factor * F.hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy"))).alias("reach"))
    met = sp.within(near, at.withColumnRenamed("region", "dst"), "reach").where("src <> dst")
    return met.select("src", "dst", "d")


def seconds(us: Column, extra: float = 0.0) -> Column:
    """Microseconds as seconds rounded to four places, half to even, as durations are reported."""
    return F.rint((us / 1_000_000 + extra) * 10_000) / 10_000


def border_windows(obs: DataFrame, bin_us: int, bins: int) -> DataFrame:
    """Steps in a time window around entries and exits: ``plate, stamp, entry, bin, n, dist, dt``.

    Bins of ``bin_us`` count from the first row of the new side, ``bins`` before and after. Windows in
    which a bin has no row are dropped, as are those that reach beyond the recording. Rows meet borders
    by plate and bin-wide buckets of time, and then by the exact range.
    """
    order = Window.partitionBy("plate").orderBy("ord")
    whole = Window.partitionBy("plate")
    o = obs.withColumns({"_in": F.col("region") >= 0, "_first": F.min("t").over(whole), "_last": F.max("t").over(whole)})
    reach = bin_us * bins
    edge = o.withColumn("_was", F.lag("_in").over(order)).where(F.col("_was").isNotNull() & (F.col("_was") != F.col("_in")))
    edge = edge.where((F.col("t") - reach >= F.col("_first")) & (F.col("t") + reach <= F.col("_last")))
    span = F.sequence(F.floor((F.col("t") - reach) / reach), F.floor((F.col("t") + reach) / reach))
    edge = edge.select("plate", F.col("ord").alias("_edge"), F.col("t").alias("stamp"), F.col("_in").alias("entry"), F.explode(span).alias("_bucket"))
    rows = obs.select("plate", "t", "dist", "dt", F.floor(F.col("t") / reach).alias("_bucket"))
    met = edge.join(rows, ["plate", "_bucket"]).where((F.col("t") >= F.col("stamp") - reach) & (F.col("t") < F.col("stamp") + reach))
    g = met.groupBy("plate", "_edge", "stamp", "entry", F.floor((F.col("t") - F.col("stamp")) / bin_us).cast("long").alias("bin"))
    g = g.agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("dist"), F.sum("dt").alias("dt"))
    full = F.count(F.lit(1)).over(Window.partitionBy("plate", "_edge")) == 2 * bins
    return g.withColumn("_full", full).where("_full").drop("_full", "_edge")
