"""Trajectory files: discovery, union with unique track numbers, text arrays, pixel numbers, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRAJECTORY = "id_conservative long, frame long, time double, x double, y double"
TRACKS_A_FILE = 100_000


def read_trajectories(spark: SparkSession, root: str, name: str = "*.csv", with_controls: bool = True, frame_s: float | None = None, shared: bool = False) -> DataFrame:
    """All files called ``name`` below ``root`` as one table with ``folder`` and a track number unique over files.

    ``track`` is the file's own number plus 100,000 times the file's place among the sorted paths.
    Only the list of paths is ranked, one row a file; rows get their place by a join. With ``frame_s``
    clocks are repaired by file: a missing first time makes time the frame times this length, and where
    time runs backwards the step is one frame and time is summed up anew. ``shared`` files hold many
    trajectories each and name the path of a row's own in a last column ``folder``: as many plates as there are would be too many files.
    """
    schema = f"{TRAJECTORY}, folder string" if shared else TRAJECTORY
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).csv(root)
    if not shared:
        rows = rows.withColumn("folder", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"))
    if not with_controls:
        rows = rows.where(~F.col("folder").contains("control_"))
    place = rows.select("folder").distinct().withColumn("place", F.row_number().over(Window.orderBy("folder")).cast("long") - 1)
    out = rows.join(place, "folder").withColumn("track", F.col("id_conservative") + TRACKS_A_FILE * F.col("place")).drop("place")
    if frame_s is None:
        return out
    order = Window.partitionBy("folder").orderBy("frame", "track")
    t = F.when(F.first("time").over(order).isNull(), F.col("frame") * frame_s).otherwise(F.col("time"))
    out = out.withColumn("_t", t).withColumn("_step", F.col("_t") - F.lag("_t").over(order))
    fixed = F.when(F.col("_step") < 0, F.lit(frame_s)).otherwise(F.coalesce("_step", F.lit(0.0)))
    back = F.coalesce(F.max(F.col("_step") < 0).over(Window.partitionBy("folder")), F.lit(False))
    out = out.withColumns({"_sum": F.sum(fixed).over(order), "_back": back})
    return out.withColumn("time", F.when(F.col("_back"), F.col("_sum")).otherwise(F.col("_t"))).drop("_t", "_step", "_sum", "_back")


def split_rejected(plates: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plates with regions, and those without with a reason; nothing is moved."""
    known = regions.select("plate").distinct()
    return plates.join(known, "plate", "left_semi"), plates.join(known, "plate", "left_anti").withColumn("reason", F.lit("no regions"))


def number_array(text: Column) -> Column:
    """Nested arrays of numbers printed with blanks or ``np.float64(...)`` as ``array<array<double>>``; null if malformed."""
    t = F.regexp_replace(text, r"np\.float64\(([^)]*)\)", "$1")
    t = F.regexp_replace(F.trim(t), r"\s*,\s*|\s+", ",")
    t = F.regexp_replace(F.regexp_replace(t, r"\[,+", "["), r",+\]", "]")
    return F.from_json(F.regexp_replace(t, r"(\d)\.(?=[,\]])", "$1.0"), "array<array<double>>")


def unravel(index: Column, n_columns: Column) -> tuple[Column, Column]:
    """Row and column of a linear pixel number."""
    return F.floor(index / n_columns).cast("long"), (index % n_columns).cast("long")


def rebase_path(path: Column, old: str, new: str) -> Column:
    """A path with another root and forward slashes; a path outside of ``old`` keeps its root."""
    flat = F.translate(path, "\\", "/")
    return F.when(F.startswith(flat, F.lit(old)), F.concat(F.lit(new), F.substr(flat, F.lit(len(old) + 1)))).otherwise(flat)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, one folder per value of ``by``; rows of a value are brought together first, hot values split by AQE."""
    out = df.hint("rebalance", *by) if by else df
    (out.write.partitionBy(*by) if by else out.write).mode("overwrite").parquet(path)


def read_stage(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stage's CSV table under a stated schema; columns of the files that have no name of their own are left out."""
    return named_columns(spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path))


def named_columns(df: DataFrame) -> DataFrame:
    """Without columns that stand for an index: no name, a colon in it, or a place as Spark or pandas calls it."""
    import re

    return df.select(*[F.col(f"`{c}`") for c in df.columns if c and ":" not in c and not re.fullmatch(r"_c\d+", c)])


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts of eggs by plate, ``folder, n_eggs``; files below ``path``, values that aren't numbers are null."""
    rows = spark.read.schema("folder string, n string").option("header", True).option("recursiveFileLookup", True).csv(path)
    return rows.select("folder", F.expr("try_cast(trim(n) AS BIGINT)").alias("n_eggs"))


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; if there is none, what ``make()`` gives is written there first.

    A table counts once its writer has committed it, so a run that was cut off is made again.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_raster(lines: DataFrame, path: str) -> None:
    """Rasters of plates as the extents of regions on their lines, a folder a plate; ``operators.space.raster`` makes pixels of them."""
    write_table(lines.select("plate", "by", "low", "high", "region"), path, ["plate"])


def write_results(df: DataFrame, path: str) -> None:
    """A small result as CSV with a header, one folder; arrays and structs become JSON text."""
    plain = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*plain).write.mode("overwrite").option("header", True).csv(path)
