"""Distances over whole rasters by two passes: along lines, then across them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.space import merged_lines
from trackloom.sources.tables import ship_package, stored

#: Columns of a band: the second pass takes all lines of so many columns at a time.
BAND = 256


def coarse_lines(lines: DataFrame, cell: int) -> DataFrame:
    """Extents on a raster whose pixels are squares of ``cell`` pixels: those that an extent touches."""
    at = lambda c: F.floor(c / F.lit(cell)).cast("long")
    return lines.select("plate", at(F.col("by")).alias("by"), at(F.col("low")).alias("low"), (at(F.col("high") - 1) + 1).alias("high")).distinct()


def _along(flags: np.ndarray, far: int) -> np.ndarray:
    """Distance of each place to the nearest set one on its line, ``far`` if there is none."""
    at = np.arange(len(flags))
    before = np.maximum.accumulate(np.where(flags, at, -far))
    after = np.minimum.accumulate(np.where(flags, at, 2 * far)[::-1])[::-1]
    return np.minimum(np.minimum(at - before, after - at), far)


def _across(along: np.ndarray) -> np.ndarray:
    """Squared distances from distances along lines (rows), for all columns at once.

    Over a column, line q gives each line y the value (y - q)^2 + along^2. The lower envelope of these
    parabolas is found line by line: a new one takes over where it meets the last one that stays, and
    those that it hides go.
    """
    n, m = along.shape
    f = along.astype(float) ** 2
    cols = np.arange(m)
    who, start = np.zeros((n, m), np.int64), np.full((n + 1, m), np.inf)
    start[0] = -np.inf
    top = np.zeros(m, np.int64)
    for q in range(1, n):
        meet, todo = np.empty(m), cols
        while len(todo):
            v = who[top[todo], todo]
            meet[todo] = (f[q, todo] + q * q - f[v, todo] - v * v) / (2.0 * (q - v))
            todo = todo[meet[todo] <= start[top[todo], todo]]
            top[todo] -= 1
        top += 1
        who[top, cols] = q
        start[top, cols] = meet
        start[np.minimum(top + 1, n), cols] = np.inf
    out, top = np.empty((n, m)), np.zeros(m, np.int64)
    for y in range(n):
        todo = cols
        while len(todo):
            todo = todo[start[top[todo] + 1, todo] < y]
            top[todo] += 1
        v = who[top, cols]
        out[y] = (y - v) ** 2 + f[v, cols]
    return out


def _bands(band: int):
    """Distances along a line to the nearest pixel inside and outside of regions, cut into bands of columns."""

    def run(parts):
        for part in parts:
            rows = []
            for plate, by, x0, x1, far, lows, highs in part.itertuples(index=False):
                flags = np.zeros(x1 - x0, bool)
                for low, high in zip(lows if lows is not None else [], highs if highs is not None else []):
                    flags[low - x0 : high - x0] = True
                inner, outer = _along(flags, far).astype("<i4"), _along(~flags, far).astype("<i4")
                for k, at in enumerate(range(0, len(flags), band)):
                    rows.append((plate, k, by, x0 + at, inner[at : at + band].tobytes(), outer[at : at + band].tobytes()))
            yield pd.DataFrame(rows, columns=["plate", "band", "by", "x", "inner", "outer"])

    return run


def _columns(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("by")
    inner, outer = (np.stack([np.frombuffer(b, "<i4") for b in pdf[c]]) for c in ("inner", "outer"))
    to_region, to_outside = _across(inner), _across(outer)
    distance = np.where(to_region > 0, np.sqrt(to_region), 1 - np.sqrt(to_outside))
    n, m = distance.shape
    return pd.DataFrame({
        "plate": np.full(n * m, pdf["plate"].iloc[0]),
        "px": np.tile(pdf["x"].iloc[0] + np.arange(m), n),
        "py": np.repeat(pdf["by"].to_numpy(), m),
        "distance": distance.ravel(),
    })


def distance_raster(lines: DataFrame, margin: int = 1, band: int = BAND) -> DataFrame:
    """Signed distance of *every* pixel of a plate, up to ``margin`` pixels beyond its regions: ``plate, px, py, distance``.

    ``lines`` has extents ``plate, by, low, high`` with pixels low <= x < high. Outside it is the distance to
    the nearest region pixel, inside one less the distance to the nearest pixel outside. Distances along
    lines come from each line alone; bands of columns then meet all lines of their plate. Both passes are
    linear in the pixels, and a task holds one band of one plate. Plates without regions have no rows.
    """
    ship_package(lines.sparkSession)
    merged = stored(merged_lines(lines), "raster-lines")
    frame = merged.groupBy("plate").agg(F.min("low").alias("x0"), F.max("high").alias("x1"), F.min("by").alias("y0"), F.max("by").alias("y1"))
    edge = max(1, margin)
    frame = frame.select("plate", (F.col("x0") - edge).cast("long").alias("x0"), (F.col("x1") + edge).cast("long").alias("x1"), (F.col("y0") - edge).alias("y0"), (F.col("y1") + edge).alias("y1"))
    far = (F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0") + 1).cast("long").alias("far")
    rows = frame.select("plate", "x0", "x1", far, F.explode(F.sequence(F.col("y0").cast("long"), F.col("y1").cast("long"))).alias("by"))
    own = merged.groupBy("plate", F.col("by").cast("long").alias("by")).agg(F.sort_array(F.collect_list(F.struct(F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")))).alias("own"))
    laid = rows.join(own, ["plate", "by"], "left").select("plate", "by", "x0", "x1", "far", F.col("own.low").alias("lows"), F.col("own.high").alias("highs"))
    kind = laid.schema["plate"].dataType.simpleString()
    cut = laid.mapInPandas(_bands(band), f"plate {kind}, band int, by long, x long, inner binary, outer binary")
    return cut.groupBy("plate", "band").applyInPandas(_columns, f"plate {kind}, px long, py long, distance double")


def time_per_pixel(visits: DataFrame, distances: DataFrame, edges: list[float]) -> DataFrame:
    """``plate, ring, n_pixels, n_frames, frames_per_pixel``: rows (plate, px, py) by the ring of distance that they lie in, for all its pixels, visited or not."""
    ring = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col("distance"))).cast("long")
    n = visits.groupBy("plate", "px", "py").agg(F.count(F.lit(1)).alias("_n"))
    both = distances.join(n, ["plate", "px", "py"], "left").groupBy("plate", ring.alias("ring"))
    out = both.agg(F.count(F.lit(1)).alias("n_pixels"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_frames"))
    return out.withColumn("frames_per_pixel", F.col("n_frames") / F.col("n_pixels"))
