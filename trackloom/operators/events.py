"""Event algebra: region timelines to visits and transits, gaps, censoring, ranks, cuts, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.config import CONFIG


def runs(obs: DataFrame, key: str = "plate") -> DataFrame:
    """Maximal runs of one region within ``key``: ``plate, key, run, region, start, end, first``.

    A run after the first starts at the stamp of the row before it, and ends at its own last row; so
    an entry is stamped outside and an exit inside.
    """
    order = Window.partitionBy("plate", key).orderBy("ord") if key != "plate" else Window.partitionBy("plate").orderBy("ord")
    changed = obs.withColumns({"prev": F.lag("region").over(order), "before": F.lag("t").over(order)})
    changed = changed.withColumn("run", F.sum(F.when(F.col("region").eqNullSafe(F.col("prev")), 0).otherwise(1)).over(order))
    keys = ["plate"] if key == "plate" else ["plate", key]
    return changed.groupBy(*keys, "run").agg(
        F.first("region").alias("region"),
        F.coalesce(F.min_by("before", "ord"), F.min("t")).alias("start"),
        F.max("t").alias("end"),
        F.min_by("prev", "ord").alias("prev"),
    )


def visits(obs: DataFrame) -> DataFrame:
    """``plate, start, end, region`` of visits to regions; visits of no extent at time zero aren't kept."""
    return runs(obs).where("region >= 0 and not (start = 0 and end = 0)").select("plate", "start", "end", "region")


def jumps(obs: DataFrame) -> DataFrame:
    """Changes from region to region without an outside row, by plate."""
    return runs(obs).groupBy("plate").agg(F.count_if((F.col("region") >= 0) & (F.col("prev") >= 0)).alias("n_jumps"))


def track_ends(obs: DataFrame) -> DataFrame:
    """First and last time and region of each track, in order of first time."""
    ends = obs.groupBy("plate", "track").agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("region", "ord").alias("r0"), F.max_by("region", "ord").alias("r1"), F.count(F.lit(1)).alias("n_rows")
    )
    order = Window.partitionBy("plate").orderBy("t0", "track")
    return ends.withColumns({"next_t0": F.lead("t0").over(order), "next_r0": F.lead("r0").over(order)})


def gap_quality(obs: DataFrame, long_us: int = CONFIG.long_gap_us) -> DataFrame:
    """Gaps between tracks, those with other regions on both sides, and the long ones of these."""
    g = track_ends(obs).withColumns({"gap": F.col("next_t0") - F.col("t1"), "bad": F.coalesce(F.col("r1") != F.col("next_r0"), F.lit(False))})
    long_ = F.col("bad") & (F.col("gap") >= long_us)
    return g.groupBy("plate").agg(
        F.count("gap").alias("n_gaps"),
        F.count_if("bad").alias("n_bad"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("gap"))), F.lit(0)).alias("bad_us"),
        F.count_if(long_).alias("n_long_bad"),
        F.coalesce(F.sum(F.when(long_, F.col("gap"))), F.lit(0)).alias("long_bad_us"),
    )


def filled_events(obs: DataFrame, fill_us: int = CONFIG.gap_fill_us) -> DataFrame:
    """Visits and transits (region -1) of a plate with short gaps filled and touching equals fused.

    Times are doubled, as a gap between different regions is split at its middle; a longer one is
    left as a break. Between visits of a track that touch without an outside row stands a transit of
    no length. ``plate, start2, end2, region``.
    """
    own = runs(obs, "track")
    events = own.select("plate", (F.col("start") * 2).alias("start2"), (F.col("end") * 2).alias("end2"), "region")
    empty = own.where("region >= 0 and prev >= 0").select("plate", (F.col("start") * 2).alias("start2"), (F.col("start") * 2).alias("end2"), F.lit(-1).alias("region"))
    gaps = track_ends(obs).where("next_t0 is not null")
    same = gaps.where("r1 = next_r0").select("plate", (F.col("t1") * 2).alias("start2"), (F.col("next_t0") * 2).alias("end2"), F.col("r1").alias("region"))
    short = gaps.where((F.col("r1") != F.col("next_r0")) & (F.col("next_t0") - F.col("t1") <= fill_us))
    middle = F.col("t1") + F.col("next_t0")
    halves = short.select(
        "plate",
        F.explode(
            F.array(
                F.struct((F.col("t1") * 2).alias("start2"), middle.alias("end2"), F.col("r1").alias("region")),
                F.struct(middle.alias("start2"), (F.col("next_t0") * 2).alias("end2"), F.col("next_r0").alias("region")),
            )
        ).alias("e"),
    ).select("plate", "e.*")
    everything = events.unionByName(empty).unionByName(same).unionByName(halves)
    order = Window.partitionBy("plate").orderBy("start2", "end2", "region")
    touching = (F.lag("end2").over(order) == F.col("start2")) & (F.lag("region").over(order) == F.col("region"))
    islands = everything.withColumn("fresh", F.when(touching, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(order))
    return islands.groupBy("plate", "island").agg(F.min("start2").alias("start2"), F.max("end2").alias("end2"), F.first("region").alias("region")).drop("island")


def censored(events: DataFrame) -> DataFrame:
    """Add ``uncensored``: both ends of an event are, to the stamp, ends of events of the other kind.

    Also ``patch_uncensored``: no visit of the region of that plate is censored.
    """
    e = events.withColumns({"_id": F.row_number().over(Window.partitionBy("plate").orderBy("start2", "end2", "region")), "_visit": F.col("region") >= 0})
    both = e.withColumn("_end", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("_stamp", F.when(F.col("_end"), F.col("end2")).otherwise(F.col("start2")))
    # at a stamp: whether events of each kind end there, and whether they start there
    here = Window.partitionBy("plate", "_stamp")
    has = lambda kind, end: F.max(((F.col("_visit") == kind) & (F.col("_end") == end)).cast("int")).over(here)
    met = F.when(F.col("_visit"), F.when(F.col("_end"), has(False, False)).otherwise(has(False, True))).otherwise(F.when(F.col("_end"), has(True, False)).otherwise(has(True, True)))
    out = both.withColumn("_met", met).groupBy("plate", "_id").agg(
        F.first("start2").alias("start2"), F.first("end2").alias("end2"), F.first("region").alias("region"), (F.min("_met") == 1).alias("uncensored")
    )
    whole = F.min(F.col("uncensored").cast("int")).over(Window.partitionBy("plate", "region")) == 1
    return out.withColumn("patch_uncensored", whole & (F.col("region") >= 0)).select("plate", "start2", "end2", "region", "uncensored", "patch_uncensored")


def merged_visits(v: DataFrame, gap_us: int = CONFIG.merge_gap_us) -> DataFrame:
    """Visits of a plate to one region, merged while the next starts less than ``gap_us`` after the last end."""
    order = Window.partitionBy("plate", "region").orderBy("start", "end")
    apart = F.abs(F.col("start") - F.lag("end").over(order)) < gap_us
    islands = v.withColumn("fresh", F.when(apart, 0).otherwise(1)).withColumn("last", F.when(apart, F.lag("end").over(order)))
    islands = islands.withColumn("island", F.sum("fresh").over(order))
    out_time = F.coalesce(F.sum(F.when(F.col("last").isNotNull(), F.col("start") - F.col("last"))), F.lit(0))
    return islands.groupBy("plate", "region", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("last").alias("n_excursions"), out_time.alias("out_us")
    ).drop("island")


def leaving_times(v: DataFrame, gap_us: int = CONFIG.merge_gap_us) -> DataFrame:
    """Leaving events on the in-region clock of each merged visit, in seconds from 1 as the code counts them."""
    order = Window.partitionBy("plate", "region").orderBy("start", "end")
    apart = F.abs(F.col("start") - F.lag("end").over(order)) < gap_us
    s = v.withColumns({"s": F.floor(F.col("start") / 1_000_000).cast("long"), "e": F.floor(F.col("end") / 1_000_000).cast("long")})
    s = s.withColumn("fresh", F.when(apart, 0).otherwise(1)).withColumn("prev_e", F.when(apart, F.lag("e").over(order)))
    s = s.withColumn("island", F.sum("fresh").over(order))
    inner = Window.partitionBy("plate", "region", "island").orderBy("start", "end")
    s = s.withColumns({"first": F.first("s").over(inner), "out": F.coalesce(F.col("s") - F.col("prev_e") + 1, F.lit(0)), "next_s": F.lead("s").over(inner)})
    earlier = F.sum("out").over(inner)
    leaving = F.when(F.col("next_s").isNotNull(), F.col("e") - F.col("first") + 1 - earlier).otherwise(F.col("e") - F.col("first") + 1)
    return s.select("plate", "region", "start", leaving.alias("leaving_s"))


def ranked(v: DataFrame) -> DataFrame:
    """Rank of each visit to its region, time and visits spent there before, previous region and pause."""
    here = Window.partitionBy("plate", "region").orderBy("start", "end")
    plate = Window.partitionBy("plate").orderBy("start", "end", "region")
    d = v.withColumn("dur", F.col("end") - F.col("start"))
    return d.select(
        "plate", "region", "start", "dur",
        F.row_number().over(here).cast("long").alias("visit_rank"),
        F.coalesce(F.sum("dur").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("spent_before"),
        F.lag("region").over(plate).alias("prev_region"),
        (F.col("start") - F.lag("end").over(plate)).alias("pause"),
    )


def hard_cut(events: DataFrame, start_us: int, length_us: int) -> DataFrame:
    """Events from ``start_us`` on until their durations add up to ``length_us``; the last is trimmed.

    Plates whose events never reach the length have no rows.
    """
    later = events.where(F.col("end") > start_us).withColumn("start", F.greatest("start", F.lit(start_us)))
    order = Window.partitionBy("plate").orderBy("start", "end", "region")
    d = later.withColumn("dur", F.col("end") - F.col("start"))
    d = d.withColumns({"so_far": F.sum("dur").over(order.rowsBetween(Window.unboundedPreceding, 0)), "whole": F.sum("dur").over(Window.partitionBy("plate"))})
    kept = d.where((F.col("whole") >= length_us) & (F.col("so_far") - F.col("dur") < length_us))
    return kept.select("plate", "start", (F.col("end") - F.greatest(F.lit(0), F.col("so_far") - length_us)).alias("end"), "region")


def transit_kinds(events: DataFrame) -> DataFrame:
    """Transits by whether the visits around them are to one region or two; leading ones have no kind."""
    order = Window.partitionBy("plate").orderBy("start2", "end2", "region")
    back = Window.partitionBy("plate").orderBy(F.desc("start2"), F.desc("end2"), F.desc("region"))
    seen = F.when(F.col("region") >= 0, F.col("region"))
    before = (Window.unboundedPreceding, -1)
    e = events.withColumns({"left": F.last(seen, True).over(order.rowsBetween(*before)), "came": F.last(seen, True).over(back.rowsBetween(*before))})
    kind = F.when(F.col("left").isNull() | F.col("came").isNull(), F.lit("edge")).when(F.col("left") == F.col("came"), F.lit("same")).otherwise("cross")
    return e.where("region = -1").select("plate", "start2", "end2", kind.alias("kind"))


def transitions(v: DataFrame) -> DataFrame:
    """``src, dst, n, p``: moves between consecutive visits, shares of a source's moves."""
    order = Window.partitionBy("plate").orderBy("start", "end", "region")
    moves = v.select(F.col("region").alias("src"), F.lead("region").over(order).alias("dst")).where("dst is not null")
    counts = moves.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("src")))


def overlaps(v: DataFrame) -> DataFrame:
    """Events that end after the next one of the plate starts, and events of negative length."""
    order = Window.partitionBy("plate").orderBy("start", "end", "region")
    e = v.withColumn("next", F.lead("start").over(order))
    return e.groupBy("plate").agg(F.count_if(F.col("end") > F.col("next")).alias("n_overlaps"), F.count_if(F.col("end") < F.col("start")).alias("n_negative"))


def discovery(v: DataFrame, edges: list[int]) -> DataFrame:
    """Regions that a plate has found up to each edge."""
    first = v.groupBy("plate", "region").agg(F.min("start").alias("found"))
    at = first.withColumn("edge", F.explode(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e >= F.col("found"))))
    return at.groupBy("plate", "edge").agg(F.count(F.lit(1)).alias("n_found"))
