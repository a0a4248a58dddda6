"""Streams of observations: visits as they close, windows and sessions with watermarks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.config import REGIONS
from trackloom.sources.tables import track_of, work_folder
from trackloom.streaming.stateful import shared, state_store

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
VISIT = "plate long, start long, end long, region int"
STATE = "last binary, waiting binary"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """New event files of a folder as a stream: ``plate, track, ts, t, event_id, region, value``.

    The table is one file, or a folder of part files, which the filter on leaf names would all leave out.
    """
    reader = spark.readStream.schema(EVENTS)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    parts = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    raw = reader.parquet(f"{folder}/{name}") if parts else reader.option("pathGlobFilter", name).parquet(folder)
    region = F.lit(None).cast("int")
    for kind, code in REGIONS.items():
        region = F.when(F.col("event_type") == kind, F.lit(code)).otherwise(region)
    ts = F.col("ts").cast("timestamp")
    return raw.select(F.col("user_id").alias("plate"), track_of(F.col("user_id"), F.col("ts")).alias("track"), ts.alias("ts"), F.unix_micros(ts).alias("t"), "event_id", region.alias("region"), "value")


def closed_visits(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Visits of each plate, emitted when a row of another region closes them: ``plate, start, end, region``.

    Rows may come out of order by up to ``delay``: they wait in the state until the watermark has passed
    them and are taken in order of time then, so a late row joins the visit that it belongs to, and a
    visit that a gap had cut is one. Rows older than the watermark are dropped. State is the last time,
    the last region and the start of the open run of each plate, and what waits; plates share it by their
    remainder (``stateful.shared``) and it holds their numbers as bytes. A visit starts at the stamp of the
    row before it, as in the batch operator.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # of each plate: plate, last time, last region, start of the open run; and of each row that waits: plate, t, event_id, region
        last, waiting = (np.frombuffer(b, np.int64).reshape(-1, 4) for b in (state.get if state.exists else (b"", b"")))
        rows = np.concatenate([waiting, *(b[["own", "t", "event_id", "region"]].to_numpy(np.int64) for b in batches)])
        mark = state.getCurrentWatermarkMs() * 1000
        ready, later = rows[rows[:, 1] <= mark], rows[rows[:, 1] > mark]
        if len(last) and len(ready):
            at = np.minimum(np.searchsorted(last[:, 0], ready[:, 0]), len(last) - 1)
            ready = ready[(last[at, 0] != ready[:, 0]) | (ready[:, 1] >= last[at, 1])]
        out = pd.DataFrame(columns=["plate", "start", "end", "region"])
        if len(ready):
            ready = ready[np.lexsort(ready[:, [2, 1, 0]].T)]
            plates, first = np.unique(ready[:, 0], return_index=True)
            # before its rows each plate has the last one taken, or its first row once more
            heads = np.column_stack([plates, ready[first, 1], ready[first, 3], ready[first, 1]])
            heads[np.isin(plates, last[:, 0])] = last[np.isin(last[:, 0], plates)]
            taken = np.concatenate([heads[:, :3], ready[:, [0, 1, 3]]])
            taken = taken[np.argsort(taken[:, 0], kind="stable")]
            plate, t, region = taken.T
            same = plate[1:] == plate[:-1]
            change = np.flatnonzero(same & (region[1:] != region[:-1]))  # the last row of each run that ends here
            number = np.searchsorted(plates, plate[change])
            start = np.concatenate([t[:0], heads[number[:1], 3], np.where(number[1:] == number[:-1], t[change[:-1]], heads[number[1:], 3])])
            closed = region[change] >= 0
            out = pd.DataFrame({"plate": plate[change], "start": start, "end": t[change], "region": region[change].astype(np.int32)})[closed]
            heads[number, 3] = t[change]  # in order, so that a plate's last change counts
            ends = np.flatnonzero(np.append(~same, True))
            heads[:, 1:3] = taken[ends, 1:]
            last = np.concatenate([last[~np.isin(last[:, 0], plates)], heads])
            last = last[np.argsort(last[:, 0])]
        state.update((last.tobytes(), later.tobytes()))
        if len(later):
            state.setTimeoutTimestamp(int(later[:, 1].min() // 1000) + 1)
        yield out if key[0] >= 0 else out.assign(plate=pd.array([None] * len(out), "Int64"))

    known = stream.where("region is not null and t is not null").select("plate", "ts", "t", "event_id", "region")
    grouped = shared(known).withWatermark("ts", delay).groupBy("plate")
    return grouped.applyInPandasWithState(step, VISIT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def window_counts(stream: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows and rows inside regions by plate and window, once the watermark has passed the window's end."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = stream.withWatermark("ts", late).groupBy("plate", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("region") >= 0).alias("n_inside"))
    return g.select("plate", F.unix_micros(F.col("w.start")).alias("start"), "n", "n_inside")


def sessions(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a plate in one region: rows less than ``gap`` apart; emitted when the watermark has passed them."""
    s = F.session_window("ts", gap)
    g = stream.where("region >= 0").withWatermark("ts", late).groupBy("plate", "region", s.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("plate", "region", F.unix_micros(F.col("w.start")).alias("start"), F.unix_micros(F.col("w.end")).alias("end"), "n")


def drain(stream: DataFrame, name: str, timers: bool = False) -> DataFrame:
    """Run a stream over all that is there, with its checkpoint and output in the work folder, and read the output.

    The stream runs here and now, while the query is built. With ``timers`` its state is in RocksDB, which they need.
    """
    spark = stream.sparkSession
    out, marks = work_folder(spark, name), work_folder(spark, f"{name}-marks")
    with state_store(spark) if timers else nullcontext():
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
