"""Tables laid out by plate: plans without exchanges and sorts, and when they are made anew."""

from pyspark.sql import functions as F

from trackloom.plans import catalog
from trackloom.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_by_plate_need_no_exchange(spark, sf_dir):
    for name in ("evt12_merged_visits", "trj03_speeds", "evt02_run_lengths", "trj02_steps"):
        assert "Exchange" not in plan(catalog.queries()[name](spark, sf_dir)), name
    assert "Sort" not in plan(catalog.queries()["trj03_speeds"](spark, sf_dir))


def test_rows_are_those_of_the_source(spark, sf_dir):
    laid, plain = tables.observations(spark, sf_dir), tables._observations(spark, sf_dir)
    assert laid.schema.names == plain.select(laid.columns).schema.names and laid.count() == plain.count()
    assert laid.exceptAll(plain.select(laid.columns)).isEmpty()


def test_made_anew_when_files_change_or_folders_go(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path)
    events.limit(50).write.parquet(f"{folder}/events.parquet")
    first = tables.observations(spark, folder)
    assert first.count() == 50 and tables.observations(spark, folder).inputFiles() == first.inputFiles()
    events.limit(70).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    assert tables.observations(spark, folder).count() == 70
    tables.drop_work_tables(spark, "observations")
    assert tables.observations(spark, folder).count() == 70
    assert tables.observations(spark, sf_dir).count() == events.count()


def test_buckets_hold_a_plate_in_one_file(spark, sf_dir):
    laid = tables.observations(spark, sf_dir).withColumn("file", F.input_file_name())
    assert laid.groupBy("plate").agg(F.count_distinct("file").alias("n")).where("n <> 1").isEmpty()
