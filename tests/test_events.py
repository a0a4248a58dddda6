import numpy as np
import random
"""Hand-made cases of the event algebra, kinematics and statistics."""

import pytest
from pyspark.sql import functions as F

from trackloom.functions import stats
from trackloom.operators import events as ev
from trackloom.operators import kinematics as kin


def obs(spark, times, regions, plate=1, tracks=None, xs=None):
    rows = [(plate, (tracks or [0] * len(times))[i], i + 1, t, r, (xs or [0] * len(times))[i], 0) for i, (t, r) in enumerate(zip(times, regions))]
    return spark.createDataFrame(rows, "plate long, track long, ord long, t long, region int, x long, y long")


@pytest.mark.parametrize(
    "times,regions,visits,jumps",
    [
        ([0, 1, 2, 3, 4], [-1, -1, 3, 3, -1], [(1, 3, 3)], 0),  # entry stamped outside, exit inside
        ([0, 1, 2], [2, 2, -1], [(0, 1, 2)], 0),  # starts inside
        ([0, 1, 2, 3], [0, 0, 1, 1], [(0, 1, 0), (1, 3, 1)], 1),  # from region to region
        ([0, 1], [-1, -1], [], 0),
    ],
)
def test_visits(spark, times, regions, visits, jumps):
    o = obs(spark, times, regions)
    assert sorted((r.start, r.end, r.region) for r in ev.visits(o).collect()) == visits
    assert ev.jumps(o).first().n_jumps == jumps


def filled(spark, end, start, a, b, limit):
    o = obs(spark, [0, end, start, start + 5], [a, a, b, b], tracks=[1, 1, 2, 2])
    return sorted((r.start2 / 2, r.end2 / 2, r.region) for r in ev.filled_events(o, limit).collect())


def test_gaps(spark):
    assert filled(spark, 10, 40, 2, 2, 60) == [(0, 45, 2)]
    assert filled(spark, 10, 40, 2, -1, 60) == [(0, 25, 2), (25, 45, -1)]
    assert filled(spark, 10, 100, 2, -1, 60) == [(0, 10, 2), (100, 105, -1)]


def test_censoring(spark):
    rows = [(1, 0, 5, 0), (1, 5, 9, -1), (1, 9, 12, 1)]
    e = spark.createDataFrame(rows, "plate long, start2 long, end2 long, region int")
    got = {(r.start2, r.end2): r.uncensored for r in ev.censored(e).collect()}
    assert got == {(0, 5): False, (5, 9): True, (9, 12): False}


def test_leaving_times(spark):
    second = 1_000_000
    v = spark.createDataFrame([(1, 10 * second, 20 * second, 3), (1, 22 * second, 27 * second, 3), (1, 32 * second, 40 * second, 3)], "plate long, start long, end long, region int")
    got = [r.leaving_s for r in ev.leaving_times(v, 60 * second).orderBy("start").collect()]
    assert got == [11, 15, 31]  # the in-region clock leaves out pauses, but not at the last leaving
    merged = ev.merged_visits(v, 60 * second).first()
    assert (merged.start, merged.end, merged.n_excursions, merged.out_us) == (10 * second, 40 * second, 2, 7 * second)
    assert ev.merged_visits(v, second).count() == 3


def test_hard_cut(spark):
    e = spark.createDataFrame([(1, 0, 4, -1), (1, 4, 9, 0), (1, 9, 20, -1), (2, 0, 3, 0)], "plate long, start long, end long, region int")
    assert sorted((r.plate, r.start, r.end, r.region) for r in ev.hard_cut(e, 0, 10).collect()) == [(1, 0, 4, -1), (1, 4, 9, 0), (1, 9, 10, -1)]


def test_clock(spark):
    o = obs(spark, [5, 6, 2, 3], [-1] * 4)
    assert [r.t for r in kin.repair_clock(o, 10).orderBy("ord").collect()] == [0, 1, 11, 12]
    missing = o.withColumn("t", F.lit(None).cast("long"))
    assert [r.t for r in kin.repair_clock(missing, 10).orderBy("ord").collect()] == [10, 20, 30, 40]


def test_smoothing(spark):
    o = obs(spark, [0, 1, 2, 3], [-1] * 4, xs=[0, 4, 3, 100])
    got = [(r.sx, r.is_smoothed) for r in kin.smooth(o, 10.0).orderBy("ord").collect()]
    assert [round(x, 3) for x, _ in got] == [0, 33.333, 66.667, 100] and [s for _, s in got] == [False, True, True, False]


def plain_smoothing(rows, radius):
    """Rows of a plate in order, (track, x, y): what is kept, then each gap between kept rows."""
    kept = [0]
    for i in range(1, len(rows)):
        if (rows[i][1] - rows[kept[-1]][1]) ** 2 + (rows[i][2] - rows[kept[-1]][2]) ** 2 > radius**2:
            kept.append(i)
    switches = [i for i in range(1, len(rows)) if rows[i][0] != rows[i - 1][0]]
    out = [[x, y, i not in kept] for i, (_, x, y) in enumerate(rows)]
    for a, b in zip(kept, kept[1:]):
        if any(a < i < b for i in switches):
            for i in range(a, b):
                out[i][2] = False
        else:
            for i in range(a + 1, b):
                out[i][:2] = [rows[a][k] + (i - a) / (b - a) * (rows[b][k] - rows[a][k]) for k in (1, 2)]
    return out


def test_smoothing_of_switches(spark):
    """Random ways with track switches within gaps, next to kept rows and at the end, over several batches."""
    rng = random.Random(4)
    plates = {}
    for plate in range(5):
        rows, track, x, y = [], 0, 0, 0
        for _ in range([1, 2, 40, 400, 3000][plate]):
            track += rng.random() < 0.15
            x, y = x + rng.randint(-4, 4), y + rng.randint(-4, 4)
            rows.append((track, x, y))
        plates[plate] = rows
    data = [(p, t, i + 1, x, y) for p, rows in plates.items() for i, (t, x, y) in enumerate(rows)]
    rng.shuffle(data)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = kin.smooth(spark.createDataFrame(data, "plate long, track long, ord long, x long, y long"), 9.0).orderBy("plate", "ord").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(p, *row) for p, rows in plates.items() for row in plain_smoothing(rows, 9.0)]
    assert len(got) == len(want)
    for r, (p, x, y, flag) in zip(got, want):
        assert (r.plate, r.is_smoothed) == (p, flag) and abs(r.sx - x) < 1e-9 and abs(r.sy - y) < 1e-9


def test_bins(spark):
    df = spark.createDataFrame([(50,), (100,), (250,)], "x long")
    assert [r.b for r in df.select("x", stats.bin_index(F.col("x"), [0, 100, 200]).alias("b")).orderBy("x").collect()] == [0, 0, 2]


def test_spread_ranks(spark):
    """Ranks and percentiles as if each group were sorted as a whole, with ties and null groups."""
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randint(0, 60), i) for i in range(900)] + [(3, None, 901)]
    df = spark.createDataFrame(rows, "g int, v int, id long")
    got = {r.id: r["_rank"] for r in stats.spread_rank(df.where("v is not null"), ["g"], ["v", "id"], 8).collect()}
    for g in (1, 2, None):
        own = sorted((v, i) for h, v, i in rows if h == g and v is not None)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    p = {r.g: (r.p0, r.p1) for r in stats.exact_percentiles(df, "g", "v", [0.15, 1.0], 8).collect()}
    assert set(p) == {1, 2, None}
    for g, found in p.items():
        assert found == pytest.approx(tuple(np.percentile([v for h, v, _ in rows if h == g and v is not None], [15, 100])))


def test_empty(spark):
    o = obs(spark, [], [])
    for df in (ev.visits(o), ev.filled_events(o), ev.censored(ev.filled_events(o)), kin.speeds(o, 10), kin.smooth(o, 1.0)):
        assert df.count() == 0
