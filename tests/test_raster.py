"""Distances over whole rasters, best turns, and windows that read a plate once."""

import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import kinematics as kin
from trackloom.operators import raster as ra
from trackloom.operators import space as sp


@pytest.mark.parametrize("seed,band", [(1, 4), (2, 256)])
def test_signed_distance_of_every_pixel(spark, seed, band):
    rng = random.Random(seed)
    rows = [(p, rng.randrange(-8, 9), *(lambda a: (a, a + rng.randint(1, 6)))(rng.randrange(-15, 16))) for p in (1, 2) for _ in range(12)]
    df = spark.createDataFrame(rows, "plate int, by int, low int, high int")
    got = {(r.plate, r.px, r.py): r.distance for r in ra.distance_raster(df, margin=3, band=band).collect()}
    for p in (1, 2):
        own = {(x, y) for q, y, a, b in rows if q == p for x in range(a, b)}
        x0, x1, y0, y1 = min(x for x, _ in own), max(x for x, _ in own), min(y for _, y in own), max(y for _, y in own)
        frame = [(x, y) for x in range(x0 - 3, x1 + 4) for y in range(y0 - 3, y1 + 4)]
        assert {(x, y) for q, x, y in got if q == p} == set(frame)
        out = [c for c in frame if c not in own]
        for x, y in frame:
            near = min(math.hypot(x - u, y - v) for u, v in own)
            want = near if near else 1 - min(math.hypot(x - u, y - v) for u, v in out)
            assert math.isclose(got[p, x, y], want, abs_tol=1e-9)
    assert ra.distance_raster(df.limit(0)).count() == 0


def test_envelope_of_long_columns():
    rng = np.random.default_rng(3)
    along = rng.integers(0, 60, (300, 5))
    y = np.arange(300)
    want = ((y[:, None, None] - y[None, :, None]) ** 2 + along[None].astype(float) ** 2).min(axis=1)
    assert np.array_equal(ra._across(along), want)


def test_time_per_pixel(spark):
    far = ra.distance_raster(spark.createDataFrame([(1, 0, 0, 2)], "plate int, by int, low int, high int"))
    seen = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, -1, 0), (1, 99, 99)], "plate int, px long, py long")
    got = {r.ring: (r.n_pixels, r.n_frames, r.frames_per_pixel) for r in ra.time_per_pixel(seen, far, [-1, 0, 1]).collect()}
    assert got == {1: (2, 2, 1.0), 2: (6, 1, 1 / 6), 3: (4, 0, 0.0)}


@pytest.mark.parametrize("deg", [-30.0, 0.0, 7.25, 44.0])
def test_best_turn(spark, deg):
    """A square turned back, with its corners in another order, wherever it stands."""
    square = [(-500, -500), (500, -500), (-500, 500), (500, 500)]
    c, s = math.cos(math.radians(-deg)), math.sin(math.radians(-deg))
    pts = [(90 + x * c - y * s, -40 + x * s + y * c) for x, y in (square[i] for i in (2, 0, 3, 1))]
    r = spark.range(1).select(sp.best_turn([(F.lit(x), F.lit(y)) for x, y in pts], square).alias("b")).first().b
    assert abs(r.deg - deg) < 1e-6 and r.rms < 1e-3


def plain_smooth(x, y, track, radius):
    kept = [0]
    for i in range(1, len(x)):
        if math.hypot(x[i] - x[kept[-1]], y[i] - y[kept[-1]]) > radius:
            kept.append(i)
    return kept


def test_smoothing_of_a_long_plate(spark):
    """200,000 rows of one plate in one pass; quadratic windows would take hours."""
    n = 200_000
    obs = spark.range(n).select(F.lit(1).alias("plate"), F.lit(1).alias("track"), (F.col("id") + 1).alias("ord"), F.pmod(F.xxhash64("id"), F.lit(3000)).alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3000)).alias("y"))
    at = time.time()
    got = kin.smooth(obs, 3000.0).agg(F.count_if("is_smoothed").alias("n")).first().n
    assert time.time() - at < 60
    rows = obs.orderBy("ord").select("x", "y").toPandas()
    kept = plain_smooth(rows.x.tolist(), rows.y.tolist(), None, 3000.0)
    assert got == n - len(kept)


def test_no_window_looks_ahead_without_end():
    """Spark evaluates such a frame anew for each row; the reversed order gives the same in one pass."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "trackloom")
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "Window.unboundedFollowing)" not in f.read().replace("(Window.unboundedPreceding, Window.unboundedFollowing)", ""), name
