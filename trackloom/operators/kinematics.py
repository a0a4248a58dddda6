"""Clock repair, steps, speeds and trailing windows over observations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_frame() -> WindowSpec:
    """A plate's rows in order; made on demand, as a window needs a session."""
    return Window.partitionBy("plate").orderBy("ord")


def repair_clock(obs: DataFrame, frame_us: int) -> DataFrame:
    """Rebuild times by plate where they are missing at the start or run backwards.

    A missing first time makes time the frame number times the frame length. If any step is negative,
    negative steps become one frame and time is summed up anew from 0.
    """
    whole = Window.partitionBy("plate")
    first = F.first("t").over(by_frame())
    o = obs.withColumn("t", F.when(first.isNull(), F.col("ord") * frame_us).otherwise(F.col("t")))
    o = o.withColumn("step", F.col("t") - F.lag("t").over(by_frame()))
    o = o.withColumn("reset", F.coalesce(F.max(F.col("step") < 0).over(whole), F.lit(False)))
    fixed = F.when(F.col("step") < 0, F.lit(frame_us)).otherwise(F.coalesce("step", F.lit(0)))
    summed = F.sum(fixed).over(by_frame())
    return o.withColumn("t", F.when(F.col("reset"), summed).otherwise(F.col("t"))).drop("step")


def steps(obs: DataFrame) -> DataFrame:
    """Add ``dist`` to the row before in thousandths (0 for the first), ``dt`` and the track switch."""
    dx, dy = F.col("x") - F.lag("x").over(by_frame()), F.col("y") * 100 - F.lag(F.col("y") * 100).over(by_frame())
    dist = F.floor(F.sqrt((dx * dx + dy * dy).cast("double")) * 10 + 0.5).cast("long")
    return obs.withColumns(
        {"dist": F.coalesce(dist, F.lit(0)), "dt": F.col("t") - F.lag("t").over(by_frame()), "switched": F.coalesce(F.col("track") != F.lag("track").over(by_frame()), F.lit(False))}
    )


def speeds(obs: DataFrame, frame_us: int, least_us: int = 1000) -> DataFrame:
    """Add ``speed``: step over elapsed time, at least a millisecond, one frame for the first row."""
    s = steps(obs)
    return s.withColumn("speed", F.col("dist").cast("double") / F.greatest(F.coalesce("dt", F.lit(frame_us)), F.lit(least_us)).cast("double"))


def side_speeds(obs: DataFrame) -> DataFrame:
    """Average speed of a track inside and outside of regions: sums of steps over sums of time."""
    order = Window.partitionBy("plate", "track").orderBy("ord")
    dx, dy = F.col("x") - F.lag("x").over(order), (F.col("y") - F.lag("y").over(order)) * 100
    s = obs.withColumns({"d": F.floor(F.sqrt((dx * dx + dy * dy).cast("double")) * 10 + 0.5).cast("long"), "dt": F.col("t") - F.lag("t").over(order), "inside": F.col("region") >= 0})

    def side(flag):
        d, t = F.sum(F.when(flag, F.col("d"))), F.sum(F.when(flag, F.col("dt")))
        return d.cast("double") / F.greatest(F.lit(1), t).cast("double")

    return s.groupBy("plate", "track").agg(side(F.col("inside")).alias("speed_in"), side(~F.col("inside")).alias("speed_out"))


def trailing_share(obs: DataFrame, frames: int) -> DataFrame:
    """Share of the last ``frames`` frames that lie inside a region; missing frames count as outside."""
    last = Window.partitionBy("plate").orderBy("ord").rangeBetween(-(frames - 1), 0)
    return obs.select("plate", "ord", (F.sum(F.when(F.col("region") >= 0, 1).otherwise(0)).over(last) / F.lit(frames)).alias("share"))


def coverage(obs: DataFrame) -> DataFrame:
    """Rows of a plate over its last frame number, and the mean time between rows."""
    s = steps(obs)
    return s.groupBy("plate").agg(
        (F.count(F.lit(1)) / F.max("ord")).alias("coverage"), (F.sum("dt") / F.count("dt")).alias("mean_dt"), F.count_if("switched").alias("n_switches")
    )


def kept_rows(obs: DataFrame, radius: float) -> DataFrame:
    """Add ``kept``: whether a row is farther than ``radius`` from the plate's last kept row; its first row is kept.

    Keeping depends on what was kept, so rows are read in order, an Arrow batch at a time, with the
    last kept position carried on; a plate is never in memory as a whole.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            plate, x, y = b.column("plate").to_pylist(), b.column("x").to_numpy().astype(float), b.column("y").to_numpy().astype(float)
            kept = np.zeros(len(plate), bool)
            i = 0
            while i < len(plate):
                if last is None or last[0] != plate[i]:
                    kept[i], last = True, (plate[i], x[i], y[i])
                    i += 1
                    continue
                part = slice(i, i + 256)
                far = (x[part] - last[1]) ** 2 + (y[part] - last[2]) ** 2 > radius * radius
                stop = next((k for k, p in enumerate(plate[part]) if p != last[0]), len(far))
                k = int(far[:stop].argmax()) if far[:stop].any() else stop
                i += k
                if k < stop:
                    kept[i], last = True, (plate[i], x[i], y[i])
                    i += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept)], names=[*b.schema.names, "kept"])

    rows = obs.repartition("plate").sortWithinPartitions("plate", "ord")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(scan, f"{kinds}, kept boolean")


def smooth(obs: DataFrame, radius: float, kept: DataFrame | None = None) -> DataFrame:
    """Keep a row if it is farther than ``radius`` from the last kept row; interpolate the rest between kept rows.

    ``kept`` (plate, ord, kept) says which rows these are, if they have been found in another way
    (``orbits.kept_orbit``, for plates that are too long for a task). Between two kept rows with a track switch strictly between them, rows stay as they are and don't
    count as smoothed. Rows after the last kept one stay, too, but do count.
    """
    rows = obs.select("plate", "track", "ord", "x", "y")
    k = kept_rows(rows, radius) if kept is None else rows.join(kept, ["plate", "ord"])
    switched = F.coalesce((F.col("track") != F.lag("track").over(by_frame())).cast("int"), F.lit(0))
    k = k.withColumn("_switched", switched).withColumn("_switches", F.sum("_switched").over(by_frame()))
    at = F.when(F.col("kept"), F.struct("ord", "x", "y", "_switches", "_switched"))
    back = Window.partitionBy("plate").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    k = k.withColumns({"_a": F.last(at, True).over(by_frame().rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_b": F.last(at, True).over(back)})
    cut = F.col("_b._switches") - F.col("_b._switched") > F.col("_a._switches")
    moved = ~F.col("kept") & F.col("_b").isNotNull() & ~F.coalesce(cut, F.lit(False))
    share = (F.col("ord") - F.col("_a.ord")) / (F.col("_b.ord") - F.col("_a.ord"))
    line = lambda c: F.when(moved, F.col(f"_a.{c}") + share * (F.col(f"_b.{c}") - F.col(f"_a.{c}"))).otherwise(F.col(c).cast("double"))
    flag = ~F.col("kept") & ~F.coalesce(cut, F.lit(False))
    return k.select("plate", "ord", line("x").alias("sx"), line("y").alias("sy"), flag.alias("is_smoothed"))
