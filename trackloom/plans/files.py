"""Queries that go through files: tables derived from the given ones are written, and read back by the readers.

Files lie in the work folder of the session. Their SQL is that of the rows that went in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import events as ev
from trackloom.operators import space as sp
from trackloom.plans.catalog import DAY, FRAME_US, OBS, T0, VISITS, query
from trackloom.plans.intervals import PLATES, _plates
from trackloom.plans.space import BOUNDARY, lines
from trackloom.sources import files
from trackloom.sources.tables import condition_of, observations, table, work_folder


def trajectories(spark, d) -> str:
    """A folder with CSV files that hold the trajectories of many plates each, by their paths: tracks numbered within the plate, seconds that jump back a day at every 17th row."""
    o = observations(spark, d)
    t = F.when(F.col("ord") % 17 == 0, F.col("t") - DAY).otherwise(F.col("t"))
    rows = o.select("plate", (F.col("track") % 100_000).alias("id_conservative"), (F.col("ord") - 1).alias("frame"), ((t - T0) / 1e6).alias("time"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    path = work_folder(spark, "trajectories")
    own = F.concat(F.lit("/plate="), F.col("plate").cast("string"), F.lit("/traj.csv"))
    rows.withColumn("folder", own).drop("plate").write.option("header", True).csv(path)
    return path


TRACK = "CAST(track % 100000 + 100000 * (dense_rank() OVER (ORDER BY CAST(plate AS VARCHAR)) - 1) AS BIGINT)"


def _plate():
    return F.regexp_extract("folder", r"plate=(\d+)", 1).cast("long").alias("plate")


@query("src01_trajectories", f"WITH {OBS} SELECT plate, {TRACK} AS track, ord - 1 AS frame, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM obs")
def src01(spark, d):
    """Files of all plates as one table, with track numbers that are unique over files."""
    return files.read_trajectories(spark, trajectories(spark, d), shared=True).select(_plate(), "track", "frame", "x", "y")


@query(
    "src02_repaired_files",
    f"""WITH {OBS}, b AS (SELECT plate, ord, (CASE WHEN ord % 17 = 0 THEN t - {DAY} ELSE t END - {T0}) / 1e6 AS t FROM obs), s AS (SELECT *, t - lag(t) OVER (PARTITION BY plate ORDER BY ord) AS step FROM b),
m AS (SELECT *, coalesce(bool_or(step < 0) OVER (PARTITION BY plate), false) AS back, sum(CASE WHEN step < 0 THEN {FRAME_US / 1e6} ELSE coalesce(step, 0) END) OVER (PARTITION BY plate ORDER BY ord) AS total FROM s)
SELECT plate, ord - 1 AS frame, round(CASE WHEN back THEN total ELSE t END, 3) AS time FROM m""",
)
def src02(spark, d):
    """Clocks of the files of all plates, repaired file by file."""
    rows = files.read_trajectories(spark, trajectories(spark, d), frame_s=FRAME_US / 1e6, shared=True)
    return rows.select(_plate(), "frame", F.round("time", 3).alias("time"))


@query("src04_number_arrays", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings")
def src04(spark, d):
    """Numbers printed as nested arrays, with blanks and type names, and read again."""
    e = lambda i: F.format_string("%.17g", F.col("embedding")[i].cast("double"))
    text = F.concat(F.lit("[["), e(0), F.lit("  np.float64("), e(1), F.lit(")]  [ "), e(2), F.lit(", "), e(3), F.lit(" ]]"))
    a = files.number_array(F.col("text"))
    rows = table(spark, d, "embeddings").select("vec_id", text.alias("text")).select("vec_id", a.alias("a"))
    return rows.select("vec_id", *[F.col("a")[i // 2][i % 2].alias(c) for i, c in enumerate("abcd")])


@query("src05_rejected_plates", f"WITH {VISITS} SELECT c_custkey AS plate, CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.plate = c_custkey) THEN NULL ELSE 'no regions' END AS reason FROM customer")
def src05(spark, d):
    """Plates of one table that another has regions for, and the rest with a reason."""
    plates = table(spark, d, "customer").select(F.col("c_custkey").alias("plate"))
    good, bad = files.split_rejected(plates, ev.visits(observations(spark, d)).select("plate", "region"))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


@query("src07_unravelled", "SELECT l_orderkey, l_linenumber, l_partkey // 37 AS py, l_partkey % 37 AS px FROM lineitem")
def src07(spark, d):
    """Rows and columns of linear pixel numbers."""
    row, column = files.unravel(F.col("l_partkey"), F.lit(37))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", row.alias("py"), column.alias("px"))


def visits_as_csv(spark, d) -> str:
    path = work_folder(spark, "stage")
    v = ev.visits(observations(spark, d)).withColumn("_c0", F.monotonically_increasing_id())
    v.select("_c0", "plate", "start", "end", "region").write.option("header", True).csv(path)
    return path


@query("src09_stage_table", f"WITH {VISITS} SELECT plate, start_t AS start, end_t AS \"end\", region FROM v")
def src09(spark, d):
    """A stage's CSV table under its schema."""
    return files.read_stage(spark, visits_as_csv(spark, d), "_c0 long, plate long, start long, `end` long, region int")


@query("fil15_named_columns", f"WITH {VISITS} SELECT plate, count(*) AS n, min(start_t) AS first FROM v GROUP BY plate")
def fil15(spark, d):
    """Columns of a CSV table that stand for an index are left out, whatever its header calls them."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(visits_as_csv(spark, d)).withColumnRenamed("_c0", "Unnamed: 0")
    v = files.named_columns(rows)
    return v.groupBy(*[c for c in v.columns if c not in ("start", "end", "region")]).agg(F.count(F.lit(1)).alias("n"), F.min("start").cast("long").alias("first")).select(F.col("plate").cast("long").alias("plate"), "n", "first")


@query("src10_stage_sink", f"WITH {PLATES} SELECT plate, condition_id, n_visits FROM pn")
def src10(spark, d):
    """A stage's table, written with a folder for each condition, and read back."""
    path = work_folder(spark, "sink")
    files.write_table(_plates(spark, d), path, ["condition_id"])
    return spark.read.schema("plate long, n_visits long, condition_id int").parquet(path).select("plate", "condition_id", "n_visits")


@query("src11_cached_table", f"WITH {PLATES} SELECT condition_id, count(*) AS n, CAST(sum(n_visits) AS BIGINT) AS n_visits FROM pn GROUP BY condition_id")
def src11(spark, d):
    """A table that is made when it isn't there, and only read the next time."""
    path = work_folder(spark, "cache")
    files.cached(spark, path, lambda: _plates(spark, d))
    again = files.cached(spark, path, lambda: _plates(spark, d).limit(0))
    return again.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_visits").alias("n_visits"))


@query("src12_raster_sink", f"""WITH {BOUNDARY}, pxl AS (SELECT DISTINCT plate, "by" AS py, unnest(range(low, high)) AS px FROM ln) SELECT plate, count(*) AS n_pixels, CAST(sum(px) AS BIGINT) AS sum_x FROM pxl GROUP BY plate""")
def src12(spark, d):
    """Rasters of plates, written as extents with a folder for each plate, read back and made into pixels."""
    path = work_folder(spark, "raster")
    files.write_raster(lines(spark, d), path)
    r = sp.raster(spark.read.parquet(path))
    return r.groupBy(F.col("plate").cast("int").alias("plate")).agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("px").alias("sum_x"))


@query("src13_result_sink", f"WITH {PLATES} SELECT condition_id, count(*) AS n, list_sort(list(n_visits)) AS n_visits FROM pn GROUP BY condition_id")
def src13(spark, d):
    """A small result as CSV with lists as JSON text, and what a reader makes of it."""
    path = work_folder(spark, "result")
    files.write_results(_plates(spark, d).groupBy("condition_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("n_visits")).alias("n_visits")), path)
    rows = spark.read.schema("condition_id int, n long, n_visits string").option("header", True).option("escape", '"').csv(path)
    return rows.withColumn("n_visits", F.from_json("n_visits", "array<long>"))


@query("src15_rebased_paths", f"WITH {OBS} SELECT DISTINCT plate, CASE WHEN plate % 3 = 0 THEN 'D:/other/p' ELSE '/mnt/plates/p' END || plate || '/traj.csv' AS path FROM obs")
def src15(spark, d):
    """Paths of plates brought from one root to another; a third lie elsewhere and keep their root."""
    plates = observations(spark, d).select("plate").distinct()
    root = F.when(F.col("plate") % 3 == 0, F.lit("D:\\other")).otherwise(F.lit("C:\\data"))
    path = F.concat(root, F.lit("\\p"), F.col("plate").cast("string"), F.lit("\\traj.csv"))
    return plates.select("plate", files.rebase_path(path, "C:/data", "/mnt/plates").alias("path"))


@query("src18_counts", "SELECT 'p' || o_custkey AS folder, CASE WHEN count(*) % 4 = 0 THEN NULL ELSE count(*) END AS n_eggs FROM orders GROUP BY o_custkey")
def src18(spark, d):
    """Counts from CSV files below a folder, some of which aren't numbers."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    text = F.when(F.col("n") % 4 == 0, F.lit("?")).otherwise(F.concat(F.lit(" "), F.col("n").cast("string")))
    path = work_folder(spark, "counts")
    rows = n.select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("folder"), text.alias("n"), condition_of(F.col("o_custkey")).alias("part"))
    rows.write.partitionBy("part").option("header", True).csv(path)
    return files.read_counts(spark, path)
