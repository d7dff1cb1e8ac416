"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Days and epochs are compared in UTC. The adaptive settings let Spark split a hot
# join key at run time even when a later step could have reused its partitioning.
# The last one merges a busy job's bursts before they are shuffled.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


#: Folders made by this process.
_MADE: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every operator relies on."""
    for key, value in SESSION_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, app: str = "floorspark", **settings: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in {**SESSION_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and stream output.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder, because there every task sees the same disk.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="floorspark-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows written to a table in the shared folder and read back.

    Cuts the lineage and fixes values that a second evaluation could change.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, name)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own inside the shared folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(folder)
    return folder


def remove_stored(spark: SparkSession) -> None:
    """Remove what this process stored in the shared folder.

    Call it once the results are written elsewhere: tables, logs and streams in
    folders of the caller's own stay.
    """
    while _MADE:
        remove_folder(spark, _MADE.pop())


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder of any store Spark reads; none if it is absent."""
    files, at = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    files, at = _hadoop(spark, path)
    files.delete(at, True)
