"""Streams that keep state: stitching over gaps with late rows and a restart, and clocks repaired as rows come."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackloom.operators import events as ev
from trackloom.operators import kinematics as kin
from trackloom.streaming import stateful

HOUR = 3_600_000_000
START = datetime(2024, 1, 1)
SCHEMA = "plate long, track long, ts timestamp, t long, event_id long, region int"


def row(plate, track, hours, region, event_id):
    ts = START + timedelta(hours=hours)
    return plate, track, ts, int((ts - datetime(1970, 1, 1)).total_seconds() * 1_000_000), event_id, region


def run(spark, stream_of, folders, out, marks, schema):
    """A trigger for each folder of new files; the query is stopped and started again from its checkpoint between them."""
    source = str(folders)
    stream = stream_of(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source))
    with stateful.state_store(spark):
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def batch(spark, rows):
    obs = spark.createDataFrame(rows, SCHEMA).selectExpr("plate", "track", "t", "region", "row_number() over (partition by plate order by t, event_id) as ord")
    return sorted((r.plate, r.start2, r.end2, r.region) for r in ev.filled_events(obs).collect())


def test_stitching_with_late_rows_and_restarts(spark, tmp_path):
    first = [row(1, 10, h, r, h) for h, r in [(0, -1), (1, 0), (2, 0), (3, 1), (4, 1)]] + [row(2, 20, h, 2, 100 + h) for h in range(5)]
    # track 11 begins 2 hours after track 10 in another region, track 12 three hours later in the same one; hour 7.5 comes late
    second = [row(1, 11, h, r, 10 + int(h)) for h, r in [(6, 0), (7, 0), (8, -1)]] + [row(1, 12, 11, -1, 30), row(2, 21, 9, 2, 200)]
    third = [row(1, 11, 7.5, 0, 19), row(1, 12, 12, 3, 31), row(2, 21, 16, 1, 201), row(2, 22, 30, 1, 202)]
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    for k, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / str(k)))
        got = run(spark, lambda s: stateful.stitched_events(s, delay="6 hours", fill_us=6 * HOUR, patience_us=1000 * HOUR), source, out, marks, stateful.EVENT)
    seen = sorted(map(tuple, got.collect()))
    everything = first + second + third
    want = batch(spark, everything)
    mark = max(r[3] for r in everything) - 6 * HOUR
    passed = batch(spark, [r for r in everything if r[3] <= mark])
    # all but those that a later row may still change: the last before the open run, and what starts with that
    obs = spark.createDataFrame([r for r in everything if r[3] <= mark], SCHEMA).selectExpr("plate", "track", "t", "region", "row_number() over (partition by plate order by t, event_id) as ord")
    bound = {r.plate: 2 * r.start for r in ev.runs(obs, "track").groupBy("plate").agg(F.max("start").alias("start")).collect()}
    assert seen == [e for plate in (1, 2) for e in [x for x in passed if x[0] == plate and x[1] < bound[plate]][:-1]]
    assert set(seen) <= set(want)
    assert (1, 2 * row(1, 0, 4, 0, 0)[3], row(1, 0, 4, 0, 0)[3] + row(1, 0, 6, 0, 0)[3], 1) not in seen  # fused with the visit before
    assert any(e - s > 0 and r == 0 for p, s, e, r in seen if p == 1)


def test_a_timer_ends_what_nothing_followed(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    batches = [[row(1, 10, h, 0, h) for h in range(3)] + [row(2, 20, 0, 1, 50)], [row(2, 20, 100, 1, 51)], [row(1, 10, 200, 0, 60), row(2, 20, 201, 1, 61)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / str(k)))
        got = run(spark, lambda s: stateful.stitched_events(s, delay="1 hour", patience_us=10 * HOUR), source, out, marks, stateful.EVENT)
        closed = {(r.plate, r.start2, r.end2) for r in got.collect()}
        own = (1, 2 * row(1, 0, 0, 0, 0)[3], 2 * row(1, 0, 2, 0, 0)[3])
        assert (own in closed) == (k > 0)
    waiting = spark.read.format("statestore").option("path", marks).option("stateVarName", "run").load()
    # both plates have been over by the timer at some time; what is left waits for the watermark
    assert {r.key.plate for r in waiting.collect()} <= {1, 2}


@pytest.mark.parametrize("parts", [1, 3])
def test_repaired_clock(spark, tmp_path, parts):
    times = [None, 5, 6, 2, 3, 9, 8, 8, None, 20, 1, 2]
    rows = [(7, 1, START, None if t is None else t * 1_000_000, i, 0) for i, t in enumerate(times)] + [(8, 1, START, 100 * i, 100 + i, 0) for i in range(9)]
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    for k in range(parts):
        own = [r for r in rows if r[4] % 100 * parts // len(times) == k] if parts > 1 else rows
        spark.createDataFrame(own[::-1], SCHEMA).coalesce(1).write.parquet(str(source / str(k)))
        got = run(spark, lambda s: stateful.repaired_clock(s, 500_000), source, out, marks, stateful.CLOCK)
    found = {(r.plate, r.event_id): (r.ord, r.t, r.n_resets) for r in got.collect()}
    assert [found[8, 100 + i] for i in range(9)] == [(i + 1, 100 * i, 0) for i in range(9)]
    assert [found[7, i][1] for i in range(12)] == [0, 500_000, 1_500_000, 2_000_000, 3_000_000, 9_000_000, 9_500_000, 9_500_000, 10_000_000, 21_500_000, 22_000_000, 23_000_000]
    state = spark.read.format("statestore").option("path", marks).option("stateVarName", "clock").load()
    assert {r.key.plate: (r.value.ord, r.value.t, r.value.n_resets) for r in state.collect()} == {7: (12, 23_000_000, 3), 8: (9, 800, 0)}


def test_clock_in_the_stream_is_that_of_the_batch(spark, tmp_path):
    rows = [(1, 1, START, t, i, 0) for i, t in enumerate([10, 20, 5, 6, 30, 2, 3])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    got = run(spark, lambda s: stateful.repaired_clock(s, 7), tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks"), stateful.CLOCK)
    obs = spark.createDataFrame(rows, SCHEMA).withColumn("ord", F.col("event_id") + 1)
    want = {r.ord: r.t for r in kin.repair_clock(obs, 7).collect()}
    assert {r.ord: r.t for r in got.collect()} == want


def test_plates_share_state(spark, tmp_path):
    """5,000 plates, of negative numbers and none as well: at most ``SHARES`` states and calls, and each plate's events are its own."""
    rows = []
    for p in [*range(-20, 4980), None]:
        n = p or 0
        rows += [row(p, 10, h + n % 7 / 8, (h + n) % 3 - 1 if h % 2 else n % 2, h) for h in range(3)] + [row(p, 11, 5 + h + n % 5 / 8, n % 4 - 1, 10 + h) for h in range(2)] + [row(p, 11, 9, 3, 20)]
    rows.append(row(1, 12, 40, 2, 99))
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    spark.createDataFrame(rows + rows[:50], SCHEMA).coalesce(2).write.parquet(str(tmp_path / "in"))
    got = run(spark, lambda s: stateful.stitched_events(s, delay="6 hours", fill_us=2 * HOUR, patience_us=1000 * HOUR), tmp_path / "in", out, marks, stateful.EVENT)
    obs = spark.createDataFrame([r for r in rows if r[5] != 2 or r[4] != 99], SCHEMA).selectExpr("plate", "track", "t", "region", "row_number() over (partition by plate order by t, event_id) as ord")
    bound = {r.plate: 2 * r.start for r in ev.runs(obs, "track").groupBy("plate").agg(F.max("start").alias("start")).collect()}
    want: dict = {}
    for r in sorted((r.plate, r.start2, r.end2, r.region) for r in ev.filled_events(obs, 2 * HOUR).where("plate is not null").collect()):
        want.setdefault(r[0], []).append(r)
    seen = sorted(map(tuple, got.where("plate is not null").collect()))
    assert seen == [e for p in want for e in [x for x in want[p] if x[1] < bound[p]][:-1]]
    # rows without a plate are like those of plate 0
    assert sorted(tuple(r)[1:] for r in got.where("plate is null").collect()) == [e[1:] for e in seen if e[0] == 0]
    states = spark.read.format("statestore").option("path", marks).option("stateVarName", "run").load()
    assert 4000 < states.select("key.plate").distinct().count() <= stateful.SHARES + 1
