"""Kept rows by pointer doubling against a plain walk."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from trackloom.operators import kinematics as kin
from trackloom.operators import orbits


def plain(points, radius):
    kept = [0]
    for i in range(1, len(points)):
        if math.dist(points[i], points[kept[-1]]) > radius:
            kept.append(i)
    return {i + 1 for i in kept}


def walk(rng, n, step):
    x = y = 0
    out = []
    for _ in range(n):
        x, y = x + rng.randint(-step, step), y + rng.randint(-step, step)
        out.append((x, y))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 8, 1000])
def test_orbits(spark, chunk):
    rng = random.Random(chunk)
    plates = {1: walk(rng, 60, 4), 2: walk(rng, 1, 1), 3: [(0, 0)] * 40, 4: [(0, 0)] * 30 + [(100, 0)] * 20, 5: walk(rng, 90, 1)}
    rows = [(p, i + 1, x, y) for p, pts in plates.items() for i, (x, y) in enumerate(pts)]
    got = orbits.kept_orbit(spark.createDataFrame(rows, "plate long, ord long, x long, y long"), 6.0, chunk).collect()
    assert len(got) == len(rows)
    for p, pts in plates.items():
        assert {r.ord for r in got if r.plate == p and r.kept} == plain(pts, 6.0)
    empty = spark.createDataFrame([], "plate long, ord long, x long, y long")
    assert orbits.kept_orbit(empty, 6.0, chunk).count() == 0


def test_a_long_plate(spark):
    """200,000 rows of one plate, mostly at rest: many tasks, and the same smoothing as in one pass."""
    n = 200_000
    at = F.col("id")
    obs = spark.range(n).select(F.lit(1).cast("long").alias("plate"), F.lit(1).alias("track"), (at + 1).alias("ord"), (F.pmod(F.xxhash64("id"), F.lit(7)) + F.floor(at / 5000) * 9).alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)).alias("y"))
    began = time.time()
    kept = orbits.kept_orbit(obs, 12.0)
    n_kept = kept.where("kept").count()
    assert time.time() - began < 90
    points = [(r.x, r.y) for r in obs.orderBy("ord").select("x", "y").collect()]
    assert n_kept == len(plain(points, 12.0)) > 5
    assert kin.smooth(obs, 12.0, kept).exceptAll(kin.smooth(obs, 12.0)).isEmpty()


def test_many_short_plates(spark):
    """9,000 plates of 67 rows in chunks of 32: a call of Python for each chunk took more than a minute."""
    n = 67
    rows = spark.range(9000 * n).select(F.floor(F.col("id") / n).alias("plate"), (F.col("id") % n + 1).alias("ord"), F.pmod(F.xxhash64("id"), F.lit(100)).alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)).alias("y"))
    began = time.time()
    kept = orbits.kept_orbit(rows, 60.0, 32).where("kept").groupBy("plate").agg(F.collect_set("ord").alias("kept")).where("plate % 300 = 0").collect()
    assert time.time() - began < 60
    points = {p: [(r.x, r.y) for r in rows.where(f"plate = {p}").orderBy("ord").collect()] for p in (0, 300, 8700)}
    got = {r.plate: set(r.kept) for r in kept}
    assert len(got) == 30 and all(got[p] == plain(pts, 60.0) for p, pts in points.items())


def test_chunks_across_batches(spark):
    """Chunks of which a batch of rows holds a part only, or several; plates without a number keep their first row, as in SQL."""
    rng = random.Random(5)
    plates = {"a": walk(rng, 200, 3), "b": [(0, 0)] * 150 + [(9, 0)] * 3, None: walk(rng, 5, 9), "c": walk(rng, 31, 9)}
    rows = [(p, i + 1, x, y) for p, pts in plates.items() for i, (x, y) in enumerate(pts)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 7)
    try:
        got = orbits.kept_orbit(spark.createDataFrame(rows, "plate string, ord long, x long, y long"), 6.0, 16).where("kept").collect()
    finally:
        spark.conf.set(size, before)
    for p, pts in plates.items():
        assert sorted(r.ord for r in got if r.plate == p) == (sorted(plain(pts, 6.0)) if p else [1])
