"""Streams with state and timers of their own: events stitched over gaps, clocks repaired as rows come."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from trackloom.config import CONFIG

EVENT = "plate long, start2 long, end2 long, region int"
CLOCK = "plate long, event_id long, ord long, t long, n_resets long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Plates that leave the same remainder by this prime share a state and a call of Python, so that calls don't grow with plates.
SHARES = 4099
#: Rows of a value of the state, which holds them as bytes.
BLOCK = 1 << 16


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and several states need, for streams that start within."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def shared(rows: DataFrame) -> DataFrame:
    """``plate`` becomes the number of its share (-1 for rows without a plate), ``own`` is the plate itself."""
    return rows.withColumns({"own": F.coalesce("plate", F.lit(0)).cast("long"), "plate": F.coalesce(F.pmod("plate", F.lit(SHARES)), F.lit(-1)).cast("long"), "event_id": F.coalesce("event_id", F.lit(2**63 - 1))})


def _stitcher(fill_us: int, patience_us: int) -> StatefulProcessor:
    """Made in a function, so that it goes to executors by value and they need no package."""

    class Stitcher(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            # numbers of all plates of the share, as bytes:
            # rows that the watermark hasn't passed: plate, t, event_id, track, region
            self.waiting = handle.getListState("waiting", "numbers binary")
            # the last row taken of a plate and the run that it belongs to: plate, t, track, region, start
            self.run = handle.getListState("run", "numbers binary")
            # closed events that may still change places, and a plate's last event in order, which may still grow: plate, start2, end2, region
            self.closed = handle.getListState("closed", "numbers binary")
            self.grown = handle.getListState("grown", "numbers binary")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            came = [part[["own", "t", "event_id", "track", "region"]].to_numpy(np.int64) for part in rows]
            yield self._advance(key, np.concatenate(came), timerValues.getCurrentWatermarkInMs() * 1000)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield self._advance(key, np.empty((0, 5), np.int64), timerValues.getCurrentWatermarkInMs() * 1000)

        def _load(self, state, width: int) -> np.ndarray:
            return np.concatenate([np.empty((0, width), np.int64), *(np.frombuffer(r[0], np.int64).reshape(-1, width) for r in state.get())])

        def _put(self, state, numbers, width: int) -> None:
            numbers = np.array(numbers, np.int64).reshape(-1, width)
            state.put([(numbers[a : a + BLOCK].tobytes(),) for a in range(0, len(numbers), BLOCK)]) if len(numbers) else state.clear()

        def _advance(self, key, came: np.ndarray, mark: int) -> pd.DataFrame:
            """Take the rows up to ``mark`` of each plate in order of time, and end what nothing followed for so long."""
            waiting = np.concatenate([self._load(self.waiting, 5), came])
            passed = waiting[:, 1] <= mark
            if passed.any():
                self._put(self.waiting, waiting[~passed], 5)
            elif len(came):
                self.waiting.appendList([(came[a : a + BLOCK].tobytes(),) for a in range(0, len(came), BLOCK)])
            ready, waiting = waiting[passed], waiting[~passed]
            ready = ready[np.lexsort(ready.T[::-1])]
            fresh = np.ones(len(ready), bool)  # rows that repeat count once
            fresh[1:] = (ready[1:] != ready[:-1]).any(axis=1)
            rows: dict[int, list] = {}
            for plate, t, _, track, region in ready[fresh].tolist():
                rows.setdefault(plate, []).append((t, track, region))
            runs = {r[0]: tuple(r[1:]) for r in self._load(self.run, 5).tolist()}
            due = [plate for plate, run in runs.items() if plate not in rows and mark >= run[0] + patience_us]
            out: list[tuple] = []
            if rows or due:
                closed: dict[int, list] = {}
                for plate, *e in self._load(self.closed, 4).tolist():
                    closed.setdefault(plate, []).append(tuple(e))
                grown = {r[0]: tuple(r[1:]) for r in self._load(self.grown, 4).tolist()}
                for plate in [*rows, *due]:
                    ended, run, left, last = self._of_plate(rows.get(plate, []), runs.pop(plate, None), closed.pop(plate, []), grown.pop(plate, None), mark)
                    out += [(plate, *e) for e in ended]
                    if run:
                        runs[plate] = run
                    if left:
                        closed[plate] = left
                    if last:
                        grown[plate] = last
                self._put(self.run, [(plate, *r) for plate, r in runs.items()], 5)
                self._put(self.closed, [(plate, *e) for plate, left in closed.items() for e in left], 4)
                self._put(self.grown, [(plate, *e) for plate, e in grown.items()], 4)
            if len(waiting):
                self.handle.registerTimer(int(waiting[:, 1].min()) // 1000 + 1)
            if runs:
                self.handle.registerTimer((min(r[0] for r in runs.values()) + patience_us) // 1000 + 1)
            found = pd.DataFrame(out, columns=["plate", "start2", "end2", "region"]).astype({"plate": "int64", "start2": "int64", "end2": "int64", "region": "int32"})
            return found if key[0] >= 0 else found.assign(plate=pd.array([None] * len(found), "Int64"))

        def _of_plate(self, rows: list[tuple], run: tuple | None, closed: list[tuple], grown: tuple | None, mark: int) -> tuple:
            """What one plate's rows end, and its run, closed events and last event after them."""
            out: list[tuple] = []

            def settle(bound: int | None) -> None:
                """Pass on closed events that no later one can come before, fusing what touches."""
                nonlocal closed, grown
                for e in sorted(e for e in closed if bound is None or e[0] < bound):
                    if grown and grown[1] == e[0] and grown[2] == e[2]:
                        grown = (grown[0], e[1], e[2])
                    else:
                        if grown:
                            out.append(grown)
                        grown = e
                closed = [] if bound is None else [e for e in closed if e[0] >= bound]

            def end() -> None:
                nonlocal run, grown
                if run:
                    closed.append((run[3] * 2, run[0] * 2, run[2]))
                settle(None)
                if grown:
                    out.append(grown)
                run = grown = None

            for t, track, region in rows:
                if run and t < run[0]:
                    continue  # older than what was taken: the watermark has dropped its like already
                if run and t - run[0] > patience_us:
                    end()
                if not run:
                    run = (t, track, region, t)
                elif track == run[1] and region == run[2]:
                    run = (t, track, region, run[3])
                else:
                    last = run[0]
                    closed.append((run[3] * 2, last * 2, run[2]))
                    start = last
                    if track == run[1]:
                        if region >= 0 and run[2] >= 0:
                            closed.append((last * 2, last * 2, -1))
                    else:
                        start = t
                        if region == run[2]:
                            closed.append((last * 2, t * 2, region))
                        elif t - last <= fill_us:
                            closed += [(last * 2, last + t, run[2]), (last + t, t * 2, region)]
                    run = (t, track, region, start)
                    settle(start * 2)
            if run and mark >= run[0] + patience_us:
                end()
            return out, run, closed, grown

        def close(self) -> None:
            pass

    return Stitcher()


def stitched_events(stream: DataFrame, delay: str = "1 hour", fill_us: int = CONFIG.gap_fill_us, patience_us: int = 4 * CONFIG.gap_fill_us) -> DataFrame:
    """Visits and transits of a plate with gaps between its tracks filled, as ``operators.events.filled_events`` gives them, from a stream.

    A gap between two tracks is filled if both sides are in one region, and split at its middle if they are in two
    and the gap is at most ``fill_us``; equal events that touch are fused. Times are doubled. Tracks of a plate must not
    overlap in time. Rows wait until the watermark has passed them and are taken in order of time then, so late ones (by
    less than ``delay``) count as if they had come in time; rows that repeat count once, rows without a time or region not at all.

    An event is emitted when a later one can no longer touch it. A plate without rows for more than ``patience_us`` is
    over: a timer emits what is open and clears its state, and rows that come later begin anew. State is the
    open run, a few closed events and the rows that wait. Plates of one remainder by ``SHARES`` keep it together.
    """
    known = stream.where("region is not null and t is not null and track is not null").select("plate", "ts", "t", "event_id", "track", "region")
    grouped = shared(known).withWatermark("ts", delay).groupBy("plate")
    return grouped.transformWithStateInPandas(_stitcher(fill_us, patience_us), EVENT, "Append", "EventTime")


def _clock(frame_us: int) -> StatefulProcessor:
    class Clock(StatefulProcessor):
        def init(self, handle) -> None:
            self.clock = handle.getValueState("clock", "ord long, raw long, t long, n_resets long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            came = sorted((int(e), None if pd.isna(t) else int(t)) for part in rows for e, t in zip(part["event_id"], part["t"]))
            order, raw, t, resets = self.clock.get() if self.clock.exists() else (0, None, 0, 0)
            out = []
            for event_id, now in came:
                step = now - raw if now is not None and raw is not None else frame_us if order else 0
                if step < 0:
                    step, resets = frame_us, resets + 1
                order, t = order + 1, t + step
                raw = now if now is not None else raw + step if raw is not None else None
                out.append((int(key[0]), event_id, order, t, resets))
            self.clock.update((order, raw, t, resets))
            yield pd.DataFrame(out, columns=["plate", "event_id", "ord", "t", "n_resets"])

        def close(self) -> None:
            pass

    return Clock()


def repaired_clock(stream: DataFrame, frame_us: int) -> DataFrame:
    """``plate, event_id, ord, t, n_resets``: time since the plate's first row, on a clock that never runs back.

    A step back of the recorded clock counts as one frame, and all later rows are shifted by what it takes, as the state
    carries the repaired time; nothing is read twice. A row without a time follows the one before by one frame.
    Rows of a plate come in order of ``event_id`` from one trigger to the next, and are sorted by it within a trigger.
    """
    rows = stream.select("plate", "event_id", "t")
    return rows.groupBy("plate").transformWithStateInPandas(_clock(frame_us), CLOCK, "Append", "None")
