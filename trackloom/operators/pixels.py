"""Pixel-level events: which pixels are covered when, for how long, and how often before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pixel_rows(obs: DataFrame, size_x: int, size_y: int) -> DataFrame:
    """The pixels that an observation covers, its own and the one to the right: ``plate, ord, t, region, px, py``."""
    own = F.floor(F.col("x") / size_x).cast("long")
    return obs.select("plate", "ord", "t", "region", F.explode(F.array(own, own + 1)).alias("px"), F.floor(F.col("y") / size_y).cast("long").alias("py"))


def pixel_visits(pixels: DataFrame) -> DataFrame:
    """Islands of consecutive frames in which a pixel is covered: ``plate, px, py, first_ord, start, end, n_frames``."""
    order = Window.partitionBy("plate", "px", "py").orderBy("ord")
    p = pixels.withColumn("island", F.col("ord") - F.row_number().over(order))
    return p.groupBy("plate", "px", "py", "island").agg(
        F.min("ord").alias("first_ord"), F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("n_frames")
    ).drop("island")


def visit_history(visits: DataFrame) -> DataFrame:
    """Each visit of a pixel with the frames it was covered before and the number of that visit."""
    order = Window.partitionBy("plate", "px", "py").orderBy("first_ord")
    before = F.coalesce(F.sum("n_frames").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return visits.withColumns({"before": before, "nth": F.row_number().over(order).cast("long")})


def delay_matrix(history: DataFrame, most: int, skip_first: bool = False) -> DataFrame:
    """Counts of frames by frames covered before and frames left, each cut at ``most``: ``seen, left, n``.

    Visits are counted by their two numbers first, so the expansion to frames is one per distinct
    pair and not one per visit.
    """
    h = history.where("nth > 1") if skip_first else history
    shapes = h.groupBy("before", "n_frames").agg(F.count(F.lit(1)).alias("n"))
    e = shapes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)))
    return e.groupBy(F.least(F.col("before") + F.col("i"), F.lit(most)).alias("seen"), F.least(F.col("n_frames") - F.col("i"), F.lit(most)).alias("left")).agg(F.sum("n").alias("n"))


def pixel_leaving(matrix: DataFrame, least: int) -> DataFrame:
    """Share of frames with one frame left by frames seen, for those with more than ``least`` frames."""
    rows = matrix.groupBy("seen").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("left") == 1, F.col("n"))), F.lit(0)).alias("n_leaving"))
    return rows.where(F.col("n") > least).withColumn("p_leave", F.col("n_leaving") / F.col("n"))


def depletion(pixels: DataFrame, rate_percent: int) -> DataFrame:
    """Value left of a plate's pixels over frames: each cover takes ``rate_percent`` of a pixel until none is left.

    ``plate, ord, taken_percent`` is the sum of what has been taken up to that frame.
    """
    order = Window.partitionBy("plate", "px", "py").orderBy("ord")
    gone = F.least(F.lit(100), F.row_number().over(order) * rate_percent)
    earlier = F.least(F.lit(100), (F.row_number().over(order) - 1) * rate_percent)
    step = pixels.withColumn("taken", gone - earlier).groupBy("plate", "ord").agg(F.sum("taken").alias("taken"))
    return step.select("plate", "ord", F.sum("taken").over(Window.partitionBy("plate").orderBy("ord")).alias("taken_percent"))


def explored(pixels: DataFrame) -> DataFrame:
    """Pixels of a region that a plate covers, and those that it covers for the first time, by region."""
    first = pixels.where("region >= 0").groupBy("plate", "region", "px", "py").agg(F.count(F.lit(1)).alias("n"))
    return first.groupBy("plate", "region").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("n").alias("n_frames"), F.count_if(F.col("n") == 1).alias("n_once"))


def heatmap(pixels: DataFrame) -> DataFrame:
    """Share of all covers by pixel over all plates, and the number of plates that cover it."""
    per_plate = pixels.groupBy("px", "py", "plate").agg(F.count(F.lit(1)).alias("n"))
    cells = per_plate.groupBy("px", "py").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_plates"))
    return cells.withColumn("share", F.col("n") / pixels.agg(F.count(F.lit(1))).scalar())
