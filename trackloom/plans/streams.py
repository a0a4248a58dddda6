"""Queries that run as streams; their SQL is that of the same rows in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.config import CONFIG
from trackloom.plans.catalog import DAY, FILLED, FRAME_US, OBS, RUNS, query
from trackloom.streaming import stateful
from trackloom.streaming import visits as st

HOUR = 3_600_000_000
MARK = f"(SELECT max(t) - {HOUR} FROM obs)"
COUNTS = "count(*) AS n, count(*) FILTER (region >= 0) AS n_inside"


@query(
    "str03_closed_visits",
    f"""WITH {RUNS.replace("FROM obs WINDOW", "FROM (SELECT * FROM obs WHERE t <= " + MARK + ") WINDOW")}, la AS (SELECT *, max(run) OVER (PARTITION BY plate) AS most FROM r) SELECT plate, start_t AS start, end_t AS "end", region FROM la WHERE region >= 0 AND run < most""",
)
def str03(spark, d):
    """Visits that a later row has closed, of the rows that the watermark has passed."""
    return st.drain(st.closed_visits(st.read_events(spark, d)), "str03")


@query("str05_tumbling", f"WITH {OBS} SELECT plate, t // {DAY} * {DAY} AS start, {COUNTS} FROM obs WHERE (t // {DAY} + 1) * {DAY} <= {MARK} GROUP BY 1, 2")
def str05(spark, d):
    """Rows by day, for days that the watermark has passed."""
    return st.drain(st.window_counts(st.read_events(spark, d), "1 day"), "str05")


@query("str06_sliding", f"WITH {OBS}, ws AS (SELECT plate, region, unnest([t // {DAY} * {DAY}, (t // {DAY} - 1) * {DAY}]) AS start FROM obs) SELECT plate, start, {COUNTS} FROM ws WHERE start + {2 * DAY} <= {MARK} GROUP BY 1, 2")
def str06(spark, d):
    """Rows in windows of two days that start every day."""
    return st.drain(st.window_counts(st.read_events(spark, d), "2 days", "1 day"), "str06")


@query(
    "str04_sessions",
    f"""WITH {OBS}, i0 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY plate, region ORDER BY t) < {DAY} THEN 0 ELSE 1 END AS fresh FROM obs WHERE region >= 0),
i1 AS (SELECT *, sum(fresh) OVER (PARTITION BY plate, region ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM i0)
SELECT plate, region, min(t) AS start, max(t) + {DAY} AS "end", count(*) AS n FROM i1 GROUP BY plate, region, island HAVING max(t) + {DAY} <= (SELECT max(t) - {HOUR} FROM obs WHERE region >= 0)""",
)
def str04(spark, d):
    """Sessions with gaps of less than a day."""
    return st.drain(st.sessions(st.read_events(spark, d), "1 day"), "str04")


PATIENCE = 2 * DAY
#: Stretches of a plate's rows that the watermark has passed, cut where it was silent for longer, are plates of their own to the SQL of filled events.
STRETCHES = FILLED.replace("obs AS (", "raw AS (", 1).replace(
    ",\nte AS",
    f""",
mark AS (SELECT max(t) - {HOUR} AS passed FROM raw),
cut AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY plate ORDER BY ord) > {PATIENCE} THEN 1 ELSE 0 END AS fresh FROM raw WHERE t <= (SELECT passed FROM mark)),
obs AS (SELECT plate * 1000 + sum(fresh) OVER (PARTITION BY plate ORDER BY ord) AS plate, track * 1000 + sum(fresh) OVER (PARTITION BY plate ORDER BY ord) AS track, t, region, ord FROM cut),
te AS""",
    1,
)


@query(
    "str07_stitched_events",
    f"""WITH {STRETCHES}, open_run AS (SELECT plate, max(start_t) * 2 AS bound, max(end_t) AS last_t FROM q GROUP BY plate),
live AS (SELECT plate, bound FROM open_run o JOIN mark ON last_t + {PATIENCE} > passed WHERE NOT EXISTS (SELECT 1 FROM open_run n WHERE n.plate = o.plate + 1)),
held AS (SELECT plate, max(island) FILTER (s < bound) AS most FROM f2 JOIN live USING (plate) GROUP BY plate),
w AS (SELECT plate, island, min(s) AS s, max(e) AS e, min(region) AS region FROM f2 GROUP BY plate, island)
SELECT CAST(plate // 1000 AS BIGINT) AS plate, s AS start2, e AS end2, region FROM w LEFT JOIN (SELECT plate, coalesce(most, 0) AS most FROM held) h USING (plate) WHERE most IS NULL OR island < most""",
)
def str07(spark, d):
    """Events with gaps between tracks filled, of the rows that the watermark has passed; open ones are left out unless nothing followed for two days."""
    return st.drain(stateful.stitched_events(st.read_events(spark, d), fill_us=CONFIG.gap_fill_us, patience_us=PATIENCE), "str07", timers=True)


@query(
    "str02_repaired_clock",
    f"""WITH {OBS}, b AS (SELECT o.plate, event_id, ord, CASE WHEN event_id % 17 = 0 THEN t - {DAY} ELSE t END AS t FROM obs o JOIN events e ON o.plate = user_id AND o.t = epoch_us(ts)),
s AS (SELECT *, t - lag(t) OVER (PARTITION BY plate ORDER BY ord) AS step FROM b)
SELECT plate, event_id, ord, CAST(sum(CASE WHEN step < 0 THEN {FRAME_US} ELSE coalesce(step, 0) END) OVER w AS BIGINT) AS t, CAST(sum(CASE WHEN step < 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_resets FROM s WINDOW w AS (PARTITION BY plate ORDER BY ord)""",
)
def str02(spark, d):
    """Repaired clocks of a stream in which every 17th event is set back a day."""
    back = F.when(F.col("event_id") % 17 == 0, F.col("t") - DAY).otherwise(F.col("t"))
    return st.drain(stateful.repaired_clock(st.read_events(spark, d).withColumn("t", back), FRAME_US), "str02", timers=True)
