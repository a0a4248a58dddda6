"""Readers and the adapters from the event tables to observations."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.config import CONDITIONS, PATCHES, REGIONS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def track_of(plate: Column, ts: Column) -> Column:
    """Tracks of a plate: stretches of days."""
    return (plate * 100000 + F.floor(F.dayofmonth(ts) / 5)).cast("long")


#: Bytes of input for each bucket of a table that is laid out by plate, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 128 << 20, 8
#: What sessions of this process have laid down, by application, input and name: the table's name (or its schema) and its folder.
_laid: dict[tuple, tuple] = {}
#: Names of catalogued tables by their folder.
_tables: dict[str, str] = {}


def _files_of(spark: SparkSession, path: str) -> tuple[tuple[tuple[str, int, int], ...], int]:
    """Names, lengths and times of the files of a table, and their bytes together."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    files = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))
    return files, sum(f[1] for f in files)


def laid_out(df: DataFrame, name: str, by: str, order: list[str], buckets: int) -> tuple[str, str]:
    """Write ``df`` in buckets of ``by``, each one file in the given order, as a table; its name and folder.

    Reading it needs no exchange for windows, joins and aggregates by ``by``, and no sort in that order.
    The setting by which Spark trusts the order of files is set for the session.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    table_name = path.rsplit("/", 1)[-1].replace("-", "_")
    laid = df.repartition(buckets, by).sortWithinPartitions(*order)  # a task a bucket, so a file a bucket
    laid.write.format("parquet").option("path", path).bucketBy(buckets, by).sortBy(*order).saveAsTable(table_name)
    _tables[path] = table_name
    return table_name, path


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``plate, track, t, region, x, y, ord`` from ``events``: times in microseconds, x in hundredths.

    ``ord`` is the total order (time, event) of a plate. The rows are laid down once for a session and a
    state of the input's files, in buckets by plate and in order, so that all queries read them without an
    exchange or a sort by plate; ``drop_work_tables`` ends that.
    """
    files, size = _files_of(spark, f"{sf_dir}/events.parquet")
    key = spark.sparkContext.applicationId, sf_dir, files, "observations"
    if key not in _laid or _laid[key][1] not in _made.get(key[0], {}):
        with owned_by("observations"):
            _laid[key] = laid_out(_observations(spark, sf_dir), "observations", "plate", ["plate", "ord"], max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))
    return spark.table(_laid[key][0])


def kept(spark: SparkSession, sf_dir: str, name: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make()`` gives for these source tables, written once for a session and a state of their files."""
    files = tuple(_files_of(spark, f"{sf_dir}/{t}.parquet")[0] for t in sources)
    key = spark.sparkContext.applicationId, sf_dir, files, name
    if key not in _laid or _laid[key][1] not in _made.get(key[0], {}):
        df = make()
        with owned_by("observations"):
            path = work_folder(spark, name)
        df.write.parquet(path)
        _laid[key] = df.schema, path
    schema, path = _laid[key]
    return spark.read.schema(schema).parquet(path)


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.lit(None).cast("int")
    for kind, code in REGIONS.items():
        region = F.when(F.col("event_type") == kind, F.lit(code)).otherwise(region)
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("plate"),
        track_of(F.col("user_id"), F.col("ts")).alias("track"),
        F.col("event_id"),
        micros(F.col("ts")).alias("t"),
        region.alias("region"),
        F.rint(F.col("value") * 100).cast("long").alias("x"),
        F.get_json_object("props", "$.k").cast("long").alias("y"),
    )
    order = Window.partitionBy("plate").orderBy("t", "event_id")
    return raw.withColumn("ord", F.row_number().over(order).cast("long")).drop("event_id")


def conditions(spark: SparkSession) -> DataFrame:
    """``condition_id, density, layout, n_patches``; 21 rows."""
    rows = [(i, density, layout, PATCHES[layout]) for density, by in CONDITIONS.items() for layout, i in by.items()]
    return spark.createDataFrame(rows, "condition_id int, density string, layout string, n_patches int")


def condition_of(plate: Column) -> Column:
    return (plate % 8).cast("int")


def pools(spark: SparkSession) -> DataFrame:
    """``pool, condition_id``: a condition is in all, in its density, in its layout and in itself."""
    c = conditions(spark)
    names = F.array(F.lit("all"), F.col("density"), F.col("layout"), F.concat_ws(" ", "layout", "density"))
    return c.select(F.explode(names).alias("pool"), "condition_id")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows to the work folder and read them back: the lineage ends there.

    A lost executor then costs a re-read, not a recomputation, and later steps know sizes exactly.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Without that setting a session on a local master has a temporary folder of its own, one for all its
    work. On a cluster each executor would write to its own disk, so there it is an error.
    """
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None) or _own_folders.get(app)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-trackloom-")
    return found.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for work tables and stream checkpoints, noted with the owner that is at work."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    _made.setdefault(app, {})[path] = _owners[-1] if _owners else None
    return path


#: Folders of local sessions by application; work folders that this process has named, with their owners; owners at work.
_own_folders: dict[str, str] = {}
_made: dict[str, dict[str, str | None]] = {}
_owners: list[str] = []


@contextmanager
def owned_by(owner: str) -> Iterator[None]:
    """Work folders that are named within belong to ``owner``, who can be dropped apart from others."""
    _owners.append(owner)
    try:
        yield
    finally:
        _owners.pop()


def drop_work_tables(spark: SparkSession, owner: str | None = None, still_read: DataFrame | None = None) -> None:
    """Delete this session's work folders, once the results that were read from them are written: those of one owner, or all.

    Folders that hold a file that ``still_read`` reads stay.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    made = _made.get(spark.sparkContext.applicationId, {})
    needed = still_read.inputFiles() if still_read is not None else []
    for path in [p for p, o in made.items() if owner is None or o == owner]:
        if any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in needed):
            continue
        if path in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")  # its files are the folder's
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        del made[path]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors unless their Python path has it already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_trackloom_sent", False):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="spark-trackloom-pkg-"), "trackloom")
    shutil.make_archive(base, "zip", root, "trackloom")
    spark.sparkContext.addPyFile(base + ".zip")
    spark.sparkContext._trackloom_sent = True
