"""File sources, streams over several triggers, and invariants of simulations and tests."""

import time

import pytest
from pyspark.sql import functions as F

from trackloom.functions import stats
from trackloom.operators import curves as cv
from trackloom.sources import files
from trackloom.sources.tables import shared_folder
from trackloom.streaming import visits as st
from trackloom.streaming.stateful import SHARES


def test_trajectories(spark, tmp_path):
    for name, ids in (("b", [1, 2]), ("a", [1]), ("control_c", [7])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "traj.csv").write_text("id_conservative,frame,time,x,y\n" + "".join(f"{i},0,,1.5,2\n" for i in ids))
    got = files.read_trajectories(spark, str(tmp_path), "traj.csv", with_controls=False)
    assert sorted(r.track for r in got.collect()) == [1, 100001, 100002]
    assert files.read_trajectories(spark, str(tmp_path), "traj.csv").count() == 4


def test_quarantine(spark):
    plates, regions = spark.createDataFrame([(1,), (2,)], "plate long"), spark.createDataFrame([(1, 0), (1, 1)], "plate long, region long")
    good, bad = files.split_rejected(plates, regions)
    assert [r.plate for r in good.collect()] == [1] and [(r.plate, r.reason) for r in bad.collect()] == [(2, "no regions")]


@pytest.mark.parametrize("text,want", [("[[1. 2.5]  [3 4]]", [[1, 2.5], [3, 4]]), ("[[np.float64(1.5), 2], [ 3.,4 ]]", [[1.5, 2], [3, 4]]), ("no array", None), (None, None)])
def test_number_array(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(files.number_array(F.col("t")).alias("a")).first().a
    assert got == want


def test_paths_and_pixels(spark):
    df = spark.createDataFrame([(r"C:\data\p1", 7)], "p string, i long")
    row, col = files.unravel(F.col("i"), F.lit(3))
    r = df.select(files.rebase_path(F.col("p"), "C:/data", "/mnt").alias("p"), row.alias("r"), col.alias("c")).first()
    assert (r.p, r.r, r.c) == ("/mnt/p1", 2, 1)


def test_visits_over_triggers(spark, tmp_path):
    """Three triggers; a row that comes late by less than the delay cuts the visit that it lies in."""
    rows = [(0, -1), (10, 3), (30, 3), (20, 2), (60, -1), (70, 2), (80, 1), (200, 1)]
    kind = "plate long, t long, event_id long, region int"
    for part in (rows[:3], rows[3:5], rows[5:]):
        df = spark.createDataFrame([(1, (1000 + t) * 1_000_000, t, r) for t, r in part] + [(1, None, 0, None)], kind).withColumn("ts", F.timestamp_micros("t"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(kind + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = st.drain(st.closed_visits(stream, "60 seconds"), "test").collect()
    assert sorted((r.start // 1_000_000 - 1000, r.end // 1_000_000 - 1000, r.region) for r in got) == [(0, 10, 3), (10, 20, 2), (20, 30, 3), (60, 70, 2)]


def test_plates_of_closed_visits_share_state(spark, tmp_path):
    """5,000 plates in three triggers, of negative numbers and none as well: fewer states than plates, and each plate's visits are its own."""
    kind = "plate long, t long, event_id long, region int"
    rows = [(p, (1000 + 10 * k + ((p or 0) + k) % 7) * 1_000_000, k, ((p or 0) * 5 + k * k) % 4 - 1) for p in [*range(-20, 4980), None] for k in range(9)]
    for k in range(3):
        own = [r for r in rows if r[2] // 3 == k] + [(1, 2000_000_000, 99, 1)] * (k == 2)
        spark.createDataFrame(own[::-1], kind).withColumn("ts", F.timestamp_micros("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(kind + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = st.drain(st.closed_visits(stream, "60 seconds"), "test").collect()
    want = []
    for p in [*range(-20, 4980), None]:
        taken = sorted(r[1:] for r in rows if r[0] == p) if p in (None, -20, 4979) else [r[1:] for r in rows[(p + 20) * 9 : (p + 20) * 9 + 9]]
        start = last = None
        for t, _, region in taken:
            if last is None:
                start = t
            elif region != last[1]:
                want += [(p, start, last[0], last[1])] * (last[1] >= 0)
                start = last[0]
            last = t, region
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    folder = shared_folder(spark)
    marks = [m for m in spark.sparkContext._jvm.java.io.File(folder.removeprefix("file://")).list() if m.startswith("test-marks")]
    counts = [spark.read.format("statestore").load(f"{folder}/{m}").select("key").distinct().count() for m in marks]
    assert 4000 < max(counts) <= SHARES + 1


def test_clock_of_files(spark, tmp_path):
    for name, times in (("a", ["", "", ""]), ("b", ["5", "6", "2", "3"])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "traj.csv").write_text("id_conservative,frame,time,x,y\n" + "".join(f"1,{k},{t},0,0\n" for k, t in enumerate(times)))
    rows = files.read_trajectories(spark, str(tmp_path), "traj.csv", frame_s=0.5).orderBy("folder", "frame").collect()
    assert [r.time for r in rows] == [0.0, 0.5, 1.0, 0.0, 1.0, 1.5, 2.5]


def test_stage_tables(spark, tmp_path):
    (tmp_path / "stage.csv").write_text("folder,n,Unnamed: 0\np1,3,0\n")
    assert [tuple(r) for r in files.read_stage(spark, str(tmp_path / "stage.csv"), "folder string, n int, `Unnamed: 0` int").collect()] == [("p1", 3)]
    (tmp_path / "eggs").mkdir()
    (tmp_path / "eggs" / "e.csv").write_text("folder,n\np1, 12\np2,?\n")
    assert sorted(map(tuple, files.read_counts(spark, str(tmp_path / "eggs")).collect())) == [("p1", 12), ("p2", None)]


def test_cached(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "c"), make).count() == 3
    assert len(made) == 1


def test_work_tables_go(spark):
    from trackloom.sources import tables

    one = tables.stored(spark.range(4), "test")
    assert one.count() == 4
    tables.drop_work_tables(spark)
    assert not spark.sparkContext._jvm.java.io.File(one.inputFiles()[0].removeprefix("file://")).exists()


def test_sinks(spark, tmp_path):
    from trackloom.operators import space as sp

    lines = spark.createDataFrame([(1, 0, 5, 10, 12), (2, 3, 6, 0, 1)], "plate long, region long, by int, low int, high int")
    files.write_raster(lines, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r")).where("plate = 1")
    assert sorted((r.px, r.py, r.region) for r in sp.raster(back).collect()) == [(10, 5, 0), (11, 5, 0)]
    files.write_results(spark.createDataFrame([(1, [1.5, 2.0])], "g int, m array<double>"), str(tmp_path / "s"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == [("1", "[1.5,2.0]")]


def test_write_table(spark, tmp_path):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    files.write_table(df, str(tmp_path / "t"), ["g"])
    assert spark.read.parquet(str(tmp_path / "t")).where("g = 1").count() == 5


def test_delays(spark):
    hour = 3_600_000_000
    runs = spark.createDataFrame([(1, 0, 2 * hour, 0), (1, 2 * hour, 5 * hour, -1), (1, 5 * hour, 6 * hour, 0), (1, 6 * hour, 7 * hour, -1)], "plate long, start long, end long, region int")
    s = sorted((r.begun, r.units) for r in cv.stays(runs, hour).collect())
    assert s == [(0, 3), (3, 1)]
    b = {r.bin: (r.n_points, r.n_leaving, r.sum_delay) for r in cv.delay_bins(cv.stays(runs, hour), [0, 2, 10]).collect()}
    assert b == {0: (2, 0, 5), 1: (2, 2, 2)}


def test_bootstrap(spark):
    df = spark.createDataFrame([(g, k, 4.0 if g == 0 else float(k % 5)) for g in (0, 1) for k in range(200)] + [(1, 999, None), (1, 998, float("nan"))], "g long, k long, v double")
    got = {r.g: r for r in stats.intervals(df, ["g"], "v", ["k"], 200).collect()}
    assert (got[0]["mean"], got[0].lo, got[0].hi) == (4.0, 4.0, 4.0)
    assert got[1].n == 200 and got[1]["mean"] == 2.0 and 1.7 < got[1].lo < 2.0 < got[1].hi < 2.3
    again = {r.g: r for r in stats.intervals(df.repartition(3), ["g"], "v", ["k"], 200).collect()}
    assert again == got
    assert stats.intervals(df.limit(0), ["g"], "v", ["k"], 20).count() == 0
    means = stats.resampled_means(df.where("g = 1"), ["g"], "v", ["k"], 400).where("r > 0").agg(F.stddev("m"), F.avg("n")).first()
    # values 0 to 4: standard error sqrt(2 / 200); resamples have 200 rows on average
    assert abs(means[0] - 0.1) < 0.015 and abs(means[1] - 200) < 3


def test_fixed_width_bins(spark):
    assert stats.last_bin(1, 10, 3) == 2 and stats.last_bin(5, 5, 10) == 0
    df = spark.createDataFrame([(1, 1, 2.0), (2, 3, 4.0), (3, 10, 8.0), (4, 10, None)], "k int, x int, y double")
    got = [(r.bin, r.middle, r.n, r["mean"]) for r in stats.fixed_width_bins(df, "x", "y", 3.0, 10).orderBy("bin").collect()]
    assert got == [(0, 1.5, 2, 3.0), (1, 4.5, 0, 0.0), (2, 8.0, 1, 8.0)]
    assert stats.fixed_width_bins(df.limit(0), "x", "y", 3.0).count() == 0


def test_pooled_ranks(spark):
    counts = spark.createDataFrame([(1, 50), (2, 30), (3, 10), (4, 1), (5, 45), (6, 3)], "k int, n int")
    assert [tuple(r) for r in stats.pooled_ranks(counts, "k", "n", 40).orderBy("first").collect()] == [(1, 1, 50), (2, 4, 41), (5, 5, 45)]


def test_tests(spark):
    for x, p in ((0.0, 1.0), (7.814728, 0.05), (16.26624, 0.001), (40.0, 1.0655e-08)):
        assert abs(spark.range(1).select(stats.chi2_tail_3(F.lit(x))).first()[0] - p) < 1e-8
    few = spark.createDataFrame([("a", float(i)) for i in range(7)] + [("b", 1.0)] * 20, "g string, v double")
    assert {r.g: r.k2 for r in stats.normality(stats.moments(few, "g", "v")).collect()} == {"a": None, "b": None}
    same = spark.createDataFrame([(g, float(i)) for g in "abcd" for i in range(10)], "g string, v double")
    r = stats.equal_means(same, "g", "v").first()
    assert r.k == 4 and abs(r.statistic) < 1e-12 and abs(r.p - 1) < 1e-6
    assert stats.equal_means(same.where("g <> 'a'"), "g", "v").first().p is None

def test_stream_of_part_files(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for folder in (sf_dir, str(tmp_path)):
        assert st.drain(st.read_events(spark, folder), "parts").count() == table.count() > 0


def test_recovery_fit(spark):
    """Exact points give their parameters back; noisy ones those of a plain Gauss-Newton search."""
    import math
    import random

    import numpy as np

    from trackloom.operators import models as md

    rng = random.Random(6)
    rows, want = [], {"a": (0.05, 0.25, 30.0), "b": (1.0, 4.0, 8.0)}
    for g, (low, high, scale) in want.items():
        for _ in range(200):
            t = rng.uniform(0, 120)
            rows.append((g, t, high - (high - low) * math.exp(-t / scale), rng.gauss(0, 0.05 * high)))
    df = spark.createDataFrame(rows + [("few", 1.0, 1.0, 0.0), ("a", None, 3.0, 0.0)], "g string, t double, y double, e double")
    got = {r.g: (r.n, r.low, r.high, r.scale) for r in md.recovery_fit(df, "g", "t", "y", [3.0, 10.0, 40.0], 8).collect()}
    assert set(got) == {"a", "b"}
    for g, p in want.items():
        assert got[g][0] == 200 and np.allclose(got[g][1:], p, rtol=1e-3)
    noisy = {r.g: (r.low, r.high, r.scale) for r in md.recovery_fit(df.withColumn("z", F.col("y") + F.col("e")), "g", "t", "z", [3.0, 10.0, 40.0], 30).collect()}
    for g, p in want.items():
        t, z = (np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] + r[3] for r in rows if r[0] == g]))
        a, b, s = p[1], p[1] - p[0], p[2]
        for _ in range(100):
            e = np.exp(-t / s)
            j = np.stack([np.ones_like(t), -e, -b * e * t / s**2], axis=1)
            a, b, s = np.array([a, b, s]) + np.linalg.lstsq(j, z - (a - b * e), rcond=None)[0]
        assert np.allclose(noisy[g], (a - b, a, s), rtol=1e-3)


def test_exchanged_behaviour(spark):
    """Expected visits of a chain that is worked out by hand, with the stays of another group."""
    from trackloom.operators import models as md

    rows = [(1, "a", 0, 10, 0), (1, "a", 15, 25, 1), (2, "a", 0, 10, 0), (3, "b", 0, 100, 1), (3, "b", 130, 190, 0), (3, "b", 200, 230, 1)]
    v = spark.createDataFrame(rows, "plate long, g string, start long, end long, region int")
    got = {(r.moves_of, r.stays_of): (r.visits, r.stay_us, r.travel_us) for r in md.exchanged_behaviour(v, "g", 4, 5).collect()}
    # a: all begin in 0, half go on to 1; b: 1, then 0, then 1
    assert got["a", "a"] == (1.5, 10 + 0.5 * 10, 0.5 * 5)
    assert got["a", "b"] == (1.5, 60 + 0.5 * 65, 0.5 * 10)
    assert got["b", "a"] == (3.0, 10 + 10 + 10, 5.0)
    assert got["b", "b"] == (3.0, 65 + 60 + 65, 30 + 10)


def test_walk_spread(spark):
    """A straight way and a square one, worked out by hand; y counts a hundredfold."""
    from trackloom.operators import models as md

    straight = [("a", 1, 1, i + 1, 3 * i, 0) for i in range(6)]
    square = [("b", 2, 2, i + 1, x, y) for i, (x, y) in enumerate([(0, 0), (100, 0), (100, 1), (0, 1), (0, 0), (100, 0)])]
    rows = spark.createDataFrame(straight + square + [("c", 3, 3, 1, 5, 5)], "g string, plate long, track long, ord long, x long, y long")
    got = {(r.g, r.n): (r.expected, r.observed) for r in md.walk_spread(rows, "g", [1, 2]).collect()}
    assert got["a", 1] == (9.0, 9.0) and abs(got["a", 2][0] - 36.0) < 1e-6 and got["a", 2][1] == 36.0
    assert got["b", 1] == (10_000.0, 10_000.0) and abs(got["b", 2][0] - 20_000.0) < 1e-6 and got["b", 2][1] == 20_000.0
    assert got["c", 1] == (None, None)


def test_expected_visits(spark):
    from trackloom.operators import models as md

    rows = [(1, "a", 0, 10, 0), (1, "a", 15, 25, 1), (2, "a", 0, 10, 0), (3, "b", 0, 5, 2)]
    v = spark.createDataFrame(rows, "plate long, g string, start long, end long, region int")
    assert {tuple(r) for r in md.expected_visits(v, "g", 4, 3).collect()} == {("a", 1, 0, 1.0), ("a", 2, 1, 0.5), ("b", 1, 2, 1.0)}


def test_null_revisits(spark):
    import math

    from trackloom.operators import models as md

    rows = [(1, "a", 0, 10, 0), (1, "a", 14, 20, 0), (1, "a", 26, 30, 1), (2, "b", 0, 5, 2)]
    v = spark.createDataFrame(rows, "plate long, g string, start long, end long, region int")
    (r,) = md.null_revisits(v, "g", [10.0], [0.5], 1.0).collect()
    stay = 10 * math.log(2)
    assert (r.g, r.p_back) == ("a", 0.5) and math.isclose(r.stay, stay) and math.isclose(r.rate, 0.5 * 5 / (0.5 * stay + 2 + 3))


def test_plates_share_files(spark, sf_dir):
    """Trajectories of many plates lie in few files, so that files don't grow in number with plates."""
    from trackloom.plans.files import trajectories
    from trackloom.sources.tables import observations

    path = spark._jvm.org.apache.hadoop.fs.Path(trajectories(spark, sf_dir))
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    assert all(f.isFile() for f in listed) and len(listed) <= 10 < observations(spark, sf_dir).select("plate").distinct().count()


def test_track_numbers_beyond_an_int(spark, tmp_path, monkeypatch):
    """Places of files times the numbers of a file leave the range of an int with some 21,000 files."""
    monkeypatch.setattr(files, "TRACKS_A_FILE", 2_000_000_000)
    for k in range(3):
        (tmp_path / f"p{k}.csv").write_text(f"id_conservative,frame,time,x,y\n{k},0,0.0,1.0,1.0\n")
    got = sorted(r.track for r in files.read_trajectories(spark, str(tmp_path)).collect())
    assert got == [0, 2_000_000_001, 4_000_000_002]
