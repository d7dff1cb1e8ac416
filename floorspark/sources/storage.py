"""Stored layouts that let day scans skip files and job joins skip shuffles."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspark.functions import formulas as fx
from floorspark.plans.skew import lookup_join
from floorspark.session import folder_names, remove_folder, stored
from floorspark.sources.schemas import FLOOR, REQUESTS

# Tables read by day lie by day.
DAY_TABLES = ("jobs", "chat_messages")


def write_days(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a table in one folder per day.

    Rebalancing gathers each day's rows into few files and splits a crowded day
    over several.
    """
    rows.hint("rebalance", "job_date").write.mode(mode).partitionBy("job_date").parquet(path)


def upsert_days(
    spark: SparkSession, path: str, name: str, changed: DataFrame, key: str = "id", gone: DataFrame | None = None
) -> list[dt.date]:
    """Write changed rows into a table that lies by day, and only the days they touch.

    ``changed`` holds whole rows, one per key; a row may move to another day.
    ``gone`` names, by ``key``, rows to delete. Days are touched where such a row lay
    or will lie; their folders are replaced, a day that loses its last row loses its
    folder, and no other file is written or read beyond its keys. Returns the touched
    days. The new rows are stored before any folder is replaced, so a run that is
    lost can simply be repeated.
    """
    table = read_floor(spark, path, name)
    keys = changed.select(key)
    keys = (keys if gone is None else keys.unionByName(gone.select(key))).distinct()
    lying = lookup_join(table.select(key, "job_date"), keys, [key], "left_semi")
    days = [r["job_date"] for r in lying.select("job_date").unionByName(changed.select("job_date")).distinct().collect()]
    if not days:
        return []
    if None in days:
        raise ValueError("a row without job_date has no folder")
    left = lookup_join(table.where(F.col("job_date").isin(days)), keys, [key], "left_anti")
    new = stored(left.unionByName(changed.select(*left.columns)), "changed-days")
    filled = {r["job_date"] for r in new.select("job_date").distinct().collect()}
    by_day = new.hint("rebalance", "job_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    by_day.partitionBy("job_date").parquet(path)
    for day in days:
        if day not in filled:
            remove_folder(spark, f"{path}/job_date={day}")
    return sorted(days)


#: Columns that only a retired layout of counts has.
LAYOUTS = {"v0": "trolley_count", "v1": "trolley_entries"}


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts from a folder of folders, each saved in one of the layouts counts have
    had, as one table with all columns, ``layout`` and ``counted_total``.

    A folder's layout shows in its columns, not in its values: a null trolley count
    of the first layout is not the second one.
    """
    parts = []
    for name in folder_names(spark, path):
        rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}")
        layout = next((v for v, column in LAYOUTS.items() if column in rows.columns), "v2")
        total = {"v0": fx.counted_total_v0, "v1": fx.counted_total_v1, "v2": fx.counted_total}[layout]()
        parts.append(rows.withColumns({"layout": F.lit(layout), "counted_total": total.cast("long")}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_floor(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A floor table read with its fixed schema."""
    return spark.read.schema(FLOOR[name]).parquet(path)


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Extraction requests from JSON lines, in batch or as they arrive."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(REQUESTS).json(path)


def write_extraction(rows: DataFrame, failures: DataFrame, path: str, mode: str = "append") -> None:
    """Keep extracted rows and, beside them, the texts that could not be parsed."""
    rows.write.mode(mode).parquet(f"{path}/rows")
    failures.write.mode(mode).json(f"{path}/parse_failed")


def save_bucketed(rows: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    """Save a table bucketed and sorted by its join key.

    Jobs and counts saved with the same number of buckets join without a
    shuffle. Rows are first gathered by bucket, so each bucket is one file.
    """
    (
        rows.repartition(buckets, key)
        .write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )
