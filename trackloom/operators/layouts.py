"""Ideal layouts of regions, and what observed pixels and shapes become in them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import space as sp


def triangular_grid(spark: SparkSession, counts: dict[str, int], spacing: dict[str, float]) -> DataFrame:
    """``layout, region, x, y``: so many points of a triangular grid for each layout, row by row of the smallest square that holds them."""
    rows = spark.createDataFrame([(name, n, math.isqrt(n - 1) + 1, spacing[name]) for name, n in counts.items()], "layout string, n int, side int, s double")
    k = rows.withColumn("region", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    i, j = F.floor(F.col("region") / F.col("side")), F.col("region") % F.col("side")
    return k.select("layout", "region", ((j + (i % 2) / 2) * F.col("s")).alias("x"), (i * F.col("s") * (math.sqrt(3) / 2)).alias("y"))


def rotated(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return x * c - y * s, x * s + y * c


def in_frame(grid: DataFrame, frame: int, turned: tuple[str, ...] = ("superfar",)) -> DataFrame:
    """Grid points in pixels of a square frame, about its middle: x is mirrored, and so is y for the layouts in ``turned``."""
    mean = grid.groupBy("layout").agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    g = grid.join(mean, "layout")
    dy = F.col("y") - F.col("_my")
    return g.select("layout", "region", (frame / 2 - (F.col("x") - F.col("_mx"))).alias("cx"), (frame / 2 + F.when(F.col("layout").isin(*turned), -dy).otherwise(dy)).alias("cy"))


def clamped(x: Column, frame: int) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(frame - 1))


def disc_regions(points: DataFrame, centres: DataFrame, radius: float, middle: float, arena: float) -> DataFrame:
    """Regions of distinct points (layout, px, py) among equal discs: -1 in none, -2 outside of the arena around ``middle``."""
    at = centres.select(F.col("layout").alias("plate"), "region", F.col("cx").alias("low"), (F.col("cx") + 1).alias("high"), F.col("cy").alias("by"))
    near = sp.nearest(points.withColumnRenamed("layout", "plate"), at, ["region"])
    outside = F.hypot(F.col("px") - middle, F.col("py") - middle) > arena
    region = F.when(outside, -2).when(F.col("d2") <= radius * radius, F.col("region")).otherwise(-1)
    return near.select(F.col("plate").alias("layout"), "px", "py", region.cast("int").alias("region"))


def warped(near: DataFrame, centres: DataFrame, frame: int) -> DataFrame:
    """Where pixels stand in the ideal layout: as far from their region's ideal centre, at the same angle; whole and within the frame."""
    j = near.join(centres, ["layout", "region"])
    x, y = F.col("cx") + F.col("distance") * F.cos("angle"), F.col("cy") + F.col("distance") * F.sin("angle")
    return j.select("plate", "px", "py", "layout", "region", clamped(F.rint(x), frame).cast("long").alias("wx"), clamped(F.rint(y), frame).cast("long").alias("wy"))


def looked_up(shapes: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, found``: regions (or -1) of a shape's four box corners and then of its pixels, in order.

    ``shapes`` has ``keys``, ``plate`` and ``pixels array<struct<px, py>>``; shapes without pixels have no row.
    """
    xs, ys = F.transform("pixels", lambda p: p["px"]), F.transform("pixels", lambda p: p["py"])
    ends = [(F.array_min(xs), F.array_min(ys)), (F.array_min(xs), F.array_max(ys)), (F.array_max(xs), F.array_min(ys)), (F.array_max(xs), F.array_max(ys))]
    corners = F.array(*[F.struct(x.alias("px"), y.alias("py")) for x, y in ends])
    at = shapes.where(F.size("pixels") > 0).select(*keys, "plate", F.posexplode(F.concat(corners, F.col("pixels"))).alias("pos", "p")).select(*keys, "plate", "pos", "p.px", "p.py")
    hit = at.join(sp.raster_regions(at.select("plate", "px", "py").distinct(), lines), ["plate", "px", "py"], "left")
    one = F.struct("pos", F.coalesce("region", F.lit(-1).cast("long")).alias("region"))
    return hit.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["region"]).alias("found"))


def shape_region(found: Column) -> Column:
    """The second corner inside decides; with one corner inside the first pixel inside does; else the shape is outside."""
    corners = F.filter(F.slice(found, 1, 4), lambda r: r >= 0)
    own = F.filter(F.slice(found, F.lit(5), F.size(found)), lambda r: r >= 0)
    return F.when(F.size(corners) >= 2, F.get(corners, F.lit(1))).when(F.size(corners) == 1, F.coalesce(F.get(own, F.lit(0)), F.lit(-1).cast("long"))).otherwise(F.lit(-1).cast("long"))


def pixels_inside(found: Column) -> Column:
    """How many pixels of a shape lie inside: all of them if its four corners do."""
    own = F.slice(found, F.lit(5), F.size(found))
    return F.when(F.forall(F.slice(found, 1, 4), lambda r: r >= 0), F.size(own)).otherwise(F.size(F.filter(own, lambda r: r >= 0))).cast("long")
