from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from floorspark.operators import ingest, views
from floorspark.session import folder_names, new_folder, shared_folder
from floorspark.sources import storage
from floorspark.sources.bindings import BINDINGS, with_clause
from floorspark.sources.tables import Tables
from tests.checks import DATA, connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, f"{DATA}/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect("0.001")


@pytest.mark.parametrize("name", list(BINDINGS))
def test_bindings_agree_in_both_engines(tables, duck, name):
    """The floor tables are the same rows wherever they are derived."""
    mine = tables.table(name)
    theirs = ", ".join(
        f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {c}" if t in ("timestamp", "timestamp_ntz") else c for c, t in mine.dtypes
    )
    seconds = lambda c: F.substring(F.col(c).cast("string"), 1, 19).alias(c)
    left = spark_rows(mine.select(*[seconds(c) if t in ("timestamp", "timestamp_ntz") else F.col(c) for c, t in mine.dtypes]))
    right = sql_rows(duck, f"{with_clause([name])} select {theirs} from {name}")
    assert left[1] == right[1] and left[1]


def test_a_day_scan_reads_one_folder(tables):
    path = new_folder(tables.spark, "jobs")
    storage.write_days(tables.jobs, path)
    jobs = storage.read_floor(tables.spark, path, "jobs")
    assert jobs.count() == 1500
    day = jobs.where(F.col("job_date") == "1996-01-05")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*job_date", plan)
    pruned = views.published_jobs(jobs, tables.published_day)
    pruned.collect()
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*job_date[^\]]*[Ss]ubquery", plan)


def test_bucketed_jobs_and_counts_join_without_a_shuffle(tables):
    spark = tables.spark
    storage.save_bucketed(tables.jobs, "bucketed_jobs", new_folder(spark, "jobs"), "id", 4)
    storage.save_bucketed(tables.counts, "bucketed_counts", new_folder(spark, "counts"), "job_id", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        summary = views.job_summary(spark.table("bucketed_jobs"), spark.table("bucketed_counts"))
        plan = summary._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        rows = spark_rows(summary)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == spark_rows(views.job_summary(tables.jobs, tables.counts))


def test_requests_from_json_lines(tables):
    spark, folder = tables.spark, new_folder(tables.spark, "requests")
    tables.requests.drop("role").write.json(f"{folder}/in")
    requests = storage.read_requests(spark, f"{folder}/in")
    assert spark_rows(ingest.extracted_rows(requests)) == spark_rows(ingest.extracted_rows(tables.requests))
    storage.write_extraction(ingest.extracted_rows(requests), ingest.parse_failures(requests), folder)
    assert spark.read.schema("req_id long, raw string").json(f"{folder}/parse_failed").count() == 49
    assert storage.read_requests(spark, f"{folder}/in", stream=True).isStreaming


def test_old_files_lack_new_columns(tables):
    path = new_folder(tables.spark, "counts")
    tables.counts.drop("still_making", "comment").write.parquet(path)
    tables.counts.write.mode("append").parquet(path)
    both = storage.read_floor(tables.spark, path, "counts")
    assert both.count() == 2 * tables.counts.count()
    assert both.where("comment is not null").count() == tables.counts.where("comment is not null").count()


def test_configured_folder_is_used(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert configured.rstrip("/") in shared_folder(spark)


def files_of(spark, path):
    """Folder names with the files in each."""
    return {day: folder_names(spark, f"{path}/{day}") for day in folder_names(spark, path) if day.startswith("job_date=")}


def test_only_changed_days_are_written(tables):
    spark, path = tables.spark, new_folder(tables.spark, "jobs")
    storage.write_days(tables.jobs, path)
    before, jobs = files_of(spark, path), storage.read_floor(spark, path, "jobs")
    lonely = tables.jobs.groupBy("job_date").count().where("count = 1").orderBy("job_date").first()["job_date"]
    others = [r["id"] for r in tables.jobs.where(F.col("job_date") != lonely).orderBy("id").limit(3).collect()]
    target = tables.jobs.where(F.col("id") == others[0]).first()["job_date"]
    # One job leaves its day empty, one is changed in place, one is new, one is deleted.
    alone = tables.jobs.where(F.col("job_date") == lonely).withColumn("job_date", F.lit(target))
    edited = tables.jobs.where(F.col("id") == others[1]).withColumn("grade", F.lit("edited"))
    new = tables.jobs.where(F.col("id") == others[0]).withColumns({"id": F.lit(-5).cast("long"), "job_date": F.lit("2031-05-05").cast("date")})
    gone = tables.jobs.where(F.col("id") == others[2])
    changed = alone.unionByName(edited).unionByName(new)
    expected = tables.jobs.join(changed.select("id").unionByName(gone.select("id")), "id", "left_anti").unionByName(changed)
    days = storage.upsert_days(spark, path, "jobs", changed, gone=gone)
    after = files_of(spark, path)
    names = {f"job_date={d}" for d in days}
    assert {d for d in before | after if before.get(d) != after.get(d)} == names and len(names) <= 5 < len(before)
    assert f"job_date={lonely}" not in after and "job_date=2031-05-05" in after
    rows = lambda df: spark_rows(df.select("id", "job_date", "grade", "planned_qty"))
    assert rows(storage.read_floor(spark, path, "jobs")) == rows(expected) and jobs.schema == storage.read_floor(spark, path, "jobs").schema
    assert storage.upsert_days(spark, path, "jobs", changed.limit(0)) == [] and files_of(spark, path) == after


def test_counts_of_all_layouts_in_one_table(tables):
    spark, path = tables.spark, new_folder(tables.spark, "counts")
    tables.counts_v0.write.parquet(f"{path}/a")
    tables.counts_v1.write.parquet(f"{path}/b")
    tables.counts.drop("still_making", "comment").where("job_id % 2 = 0").write.parquet(f"{path}/c")
    tables.counts.where("job_id % 2 = 1").write.mode("append").parquet(f"{path}/c")
    both = storage.read_counts(spark, path)
    per = {r["layout"]: r["count"] for r in both.groupBy("layout").count().collect()}
    assert per == {"v0": tables.counts_v0.count(), "v1": tables.counts_v1.count(), "v2": tables.counts.count()}
    nulls = both.where("layout = 'v0' and trolley_count is null").count() + both.where("layout = 'v2' and trolley_count is not null").count()
    assert nulls == 0 and both.where("counted_total is null").count() == 0
    assert both.where("layout = 'v2' and still_making is not null").where("job_id % 2 = 0").count() == 0


def test_stored_folders_can_be_removed(spark):
    from floorspark import session

    kept, session._MADE[:] = list(session._MADE), []
    rows = session.stored(spark.range(3), "short-lived")
    assert rows.count() == 3
    folder = session._MADE[0]
    session.remove_stored(spark)
    assert folder_names(spark, folder) == [] and session._MADE == []
    session._MADE[:] = kept
