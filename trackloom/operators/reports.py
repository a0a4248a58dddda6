"""Reports: a measure by plate over a choice of events, then its mean by condition or by curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import events as ev
from trackloom.operators import kinematics as kin
from trackloom.sources.tables import condition_of

SELECTIONS = ("all", "uncensored", "cut", "first", "first_of_plate", "first_region", "long")


def select_events(obs: DataFrame, choice: str, cut: tuple[int, int], long_us: int) -> DataFrame:
    """Filled events ``plate, start2, end2, region`` (doubled microseconds) of one choice.

    all; uncensored; cut (from ``cut[0]`` until ``cut[1]`` are spent); first (first visit to each
    region); first_of_plate; first_region (visits to the region found first that start before the
    cut's end); long (uncensored visits of ``long_us`` or more that start before the cut's end).
    """
    events = ev.filled_events(obs)
    order = Window.partitionBy("plate").orderBy("start2", "end2", "region")
    soft = F.col("start2").between(2 * cut[0], 2 * (cut[0] + cut[1]))
    if choice == "uncensored":
        return ev.censored(events).where("uncensored").select("plate", "start2", "end2", "region")
    if choice == "long":
        return ev.censored(events).where(F.col("uncensored") & (F.col("region") >= 0) & (F.col("end2") - F.col("start2") >= 2 * long_us) & soft).select("plate", "start2", "end2", "region")
    if choice == "cut":
        plain = events.select("plate", F.col("start2").alias("start"), F.col("end2").alias("end"), "region")
        return ev.hard_cut(plain, 2 * cut[0], 2 * cut[1]).select("plate", F.col("start").alias("start2"), F.col("end").alias("end2"), "region")
    if choice == "first":
        here = Window.partitionBy("plate", "region").orderBy("start2", "end2")
        return events.where("region >= 0").withColumn("k", F.row_number().over(here)).where("k = 1").drop("k")
    if choice == "first_of_plate":
        return events.where("region >= 0").withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
    if choice == "first_region":
        return events.where("region >= 0").withColumn("r", F.first("region").over(order)).where((F.col("region") == F.col("r")) & soft).drop("r")
    return events


def first_visits(censored: DataFrame, uncensored_first: bool = False, first_region_only: bool = False, cut2: tuple[int, int] | None = None, least2: int = 0) -> DataFrame:
    """First visits to regions, ``plate, region, dur2`` (doubled microseconds), from events with their censoring.

    ``uncensored_first`` leaves out regions whose first visit is censored; then visits shorter than
    ``least2`` go; ``first_region_only`` keeps the region that is found first among the rest; ``cut2``
    keeps visits that start in it; of what is left the first visit to each region counts.
    """
    here, order = Window.partitionBy("plate", "region").orderBy("start2", "end2"), Window.partitionBy("plate").orderBy("start2", "end2", "region")
    v = censored.where("region >= 0")
    if uncensored_first:
        v = v.withColumn("_ok", F.first("uncensored").over(here)).where("_ok")
    v = v.where(F.col("end2") - F.col("start2") >= least2)
    if first_region_only:
        v = v.withColumn("_one", F.first("region").over(order)).where("region = _one")
    if cut2:
        v = v.where(F.col("start2").between(*cut2))
    v = v.withColumn("_k", F.row_number().over(here)).where("_k = 1")
    return v.select("plate", "region", (F.col("end2") - F.col("start2")).alias("dur2"))


def plate_sums(events: DataFrame) -> DataFrame:
    """``plate, condition_id, visit_us, transit_us, n_visits, n_regions`` of chosen events; times in whole microseconds."""
    is_visit, dur = F.col("region") >= 0, F.col("end2") - F.col("start2")
    return events.groupBy("plate").agg(
        condition_of(F.first("plate")).alias("condition_id"),
        (F.coalesce(F.sum(F.when(is_visit, dur)), F.lit(0)) / 2).alias("visit_us"),
        (F.coalesce(F.sum(F.when(~is_visit, dur)), F.lit(0)) / 2).alias("transit_us"),
        F.count_if(is_visit).alias("n_visits"),
        F.count_distinct(F.when(is_visit, F.col("region"))).alias("n_regions"),
    )


def recording(obs: DataFrame, frame_us: int) -> DataFrame:
    """``plate, video_us, double_rate, way and time inside and outside`` of recordings."""
    s, is_in = kin.steps(obs), F.col("region") >= 0
    r = s.groupBy("plate").agg(
        (F.max("t") - F.min("t")).alias("video_us"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.floor(F.col("t") / frame_us)).alias("n_frames"),
        *[F.sum(F.when(side, F.col(c))).alias(f"{c}_{name}") for name, side in (("in", is_in), ("out", ~is_in)) for c in ("dist", "dt")],
    )
    return r.withColumn("double_rate", F.col("n_rows") / F.col("n_frames") - 1)


def mean_by(values: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Number of plates with a value and their mean; plates whose denominator is zero have none."""
    return values.withColumn("_v", value).groupBy(*keys).agg(F.count("_v").alias("n_plates"), F.round(F.avg("_v"), 6).alias("mean"))


def mean_by_curve(values: DataFrame, members: DataFrame, value: Column) -> DataFrame:
    """Means by curve; ``members`` has (curve, condition_id), a row per pair, and a condition may be in several."""
    return mean_by(values.join(members, "condition_id"), ["curve"], value)


def curve_members(pools: DataFrame, curves: list[list[str]]) -> DataFrame:
    """Conditions of each curve, of which each is a list of pool names: ``curve, condition_id``."""
    names = F.array(*[F.struct(F.lit("+".join(c)).alias("curve"), F.array(*map(F.lit, c)).alias("names")) for c in curves])
    found = pools.withColumn("c", F.explode(names)).where(F.array_contains("c.names", F.col("pool")))
    return found.select("c.curve", "condition_id").distinct()
