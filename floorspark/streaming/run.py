"""Starting streams and keeping what they write."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from floorspark.operators.changes import latest
from floorspark.operators.quality import write_checked
from floorspark.plans.skew import lookup_join
from floorspark.session import folder_names, new_folder, remove_folder

# Fixed value: how often the floor page polls for messages.
POLL_SECONDS = 12


def run(writer: DataStreamWriter, folder: str, continuous: bool = False, every: str = f"{POLL_SECONDS} seconds"):
    """Start a stream with its checkpoint in ``folder``.

    ``continuous`` keeps it polling; otherwise it takes what is there and ends.
    """
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    if continuous:
        return writer.trigger(processingTime=every).start()
    stream = writer.trigger(availableNow=True).start()
    stream.awaitTermination()
    return stream


def collect_rows(rows: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Append a finished stream's rows to files and read them back as a table."""
    spark = rows.sparkSession
    folder = folder or new_folder(spark, name)
    run(rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows"), folder)
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


class ChangeLog:
    """Rows a stream writes per micro-batch, the newest of each key being current.

    A batch that runs again after a failure overwrites its own rows, so every
    batch counts once. A log in a named folder goes on where it ended.

    A log with a ``key`` settles itself. After every SETTLE_EVERY batches the newest
    row of each key in them is written to one table, after as many of those to one
    of the next level, and so on: a row is rewritten once per level, and a level has
    SETTLE_EVERY tables. What a settled table stands for is removed when the next one
    of its level is complete, so neither listing nor disk grow with the stream's age.

    ``ended`` names a boolean column: a row where it is true ends its key for good,
    whatever arrives later. ``checks`` names conditions that stored rows should not
    meet; they are counted while the rows are written.
    """

    SETTLE_EVERY = 20

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        columns: str,
        key: str | list[str] | None = None,
        order_by: tuple[str, ...] = ("batch",),
        ended: str | None = None,
        checks: dict[str, Column] | None = None,
    ):
        self.spark, self.folder, self.columns, self.key = spark, folder, columns, key
        self.order_by, self.ended, self.checks = order_by, ended, checks or {}
        empty = spark.createDataFrame([], columns)
        empty.write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")
        empty.withColumn("batch", F.lit(-1).cast("long")).write.mode("overwrite").parquet(f"{folder}/settled/level=0/upto=-1")

    @classmethod
    def create(cls, spark: SparkSession, name: str, columns: str, folder: str | None = None, **how) -> ChangeLog:
        """A log in ``folder``, or in a new one of its own."""
        return cls(spark, folder or new_folder(spark, name), columns, **how)

    def _batches(self) -> DataFrame:
        return self.spark.read.schema(f"{self.columns}, batch long").parquet(f"{self.folder}/rows")

    def _numbers(self, path: str) -> list[int]:
        names = (n.partition("=")[2] for n in folder_names(self.spark, f"{self.folder}/{path}"))
        return [int(n) for n in names if n.lstrip("-").isdigit()]

    def _settled(self, before: int | None) -> tuple[list[tuple[int, int]], int]:
        """The largest settled tables that cover the batches from 0 on one after the
        other, as (level, last batch), and the first batch they leave."""
        there = {(level, upto) for level in self._numbers("settled") for upto in self._numbers(f"settled/level={level}")}
        top, chosen, start = max(level for level, _ in there), [], 0
        while True:
            spans = ((level, start + self.SETTLE_EVERY**level) for level in range(top, 0, -1))
            fits = [(level, end) for level, end in spans if (level, end - 1) in there and (before is None or end <= before)]
            if not fits:
                return chosen, start
            chosen.append((fits[0][0], fits[0][1] - 1))
            start = fits[0][1]

    def rows(self, before: int | None = None, batch: int | None = None) -> DataFrame:
        """Logged rows with their batch number; of settled batches the newest of
        each key. Older or single batches prune files."""
        if batch is not None:
            return self._batches().where(F.col("batch") == batch)
        chosen, start = self._settled(before)
        logged = self._batches().where(F.col("batch") >= start)
        if before is not None:
            logged = logged.where(F.col("batch") < before)
        for level, upto in chosen:
            logged = logged.unionByName(self._table(level, upto))
        return logged

    def _table(self, level: int, upto: int) -> DataFrame:
        return self.spark.read.schema(f"{self.columns}, batch long").parquet(f"{self.folder}/settled/level={level}/upto={upto}")

    def _rank(self, order_by: tuple[str, ...]) -> tuple[str, ...]:
        return (self.ended, *order_by) if self.ended else order_by

    def settle(self, batch: int) -> None:
        """Let one table stand for the last batches up to this one, on every level
        that is full with it."""
        level, span = 1, self.SETTLE_EVERY
        while (batch + 1) % span == 0:
            step = span // self.SETTLE_EVERY
            if level == 1:
                rows = self._batches().where(F.col("batch").between(batch - span + 1, batch))
            else:
                ends = range(batch - span + step, batch + 1, step)
                rows = reduce(DataFrame.unionByName, [self._table(level - 1, end) for end in ends])
            newest = latest(rows, self.key, *self._rank(self.order_by))
            newest.write.mode("overwrite").parquet(f"{self.folder}/settled/level={level}/upto={batch}")
            # The table before this one is complete and read: what it stands for goes.
            old, name = ("rows", "batch") if level == 1 else (f"settled/level={level - 1}", "upto")
            for number in self._numbers(old):
                if 0 <= number <= batch - span:
                    remove_folder(self.spark, f"{self.folder}/{old}/{name}={number}")
            level, span = level + 1, span * self.SETTLE_EVERY

    def write(self, rows: DataFrame, batch: int) -> None:
        """Store a batch's rows, its checks counted on the way."""
        path = f"{self.folder}/rows/batch={batch}"
        if not self.checks:
            rows.write.mode("overwrite").parquet(path)
            return
        found = write_checked(rows, self.checks, lambda seen: seen.write.mode("overwrite").parquet(path))
        counted = self.spark.createDataFrame(list(found.items()), "check_name string, rows long")
        counted.write.mode("overwrite").parquet(f"{self.folder}/checked/batch={batch}")

    def violations(self) -> DataFrame:
        """Per batch and check, how many stored rows met its condition."""
        return self.spark.read.schema("check_name string, rows long, batch long").parquet(f"{self.folder}/checked")

    def follow(
        self, stream: DataFrame, change: Callable[[DataFrame, int], DataFrame], mode: str = "append", **options
    ) -> ChangeLog:
        """Log what ``change`` makes of each micro-batch."""
        self._start(stream, change, mode, **options)
        return self

    def _start(self, stream: DataFrame, change: Callable[[DataFrame, int], DataFrame], mode: str = "append", **options):
        names = [c.split()[0] for c in self.columns.split(", ")]

        def on_batch(rows: DataFrame, batch: int) -> None:
            rows.persist()  # read once, however often it is used below
            self.write(change(rows, batch).select(*names), batch)
            rows.unpersist()
            if self.key and (batch + 1) % self.SETTLE_EVERY == 0:
                self.settle(batch)

        return run(stream.writeStream.outputMode(mode).foreachBatch(on_batch), self.folder, **options)

    def _newest(self, key: str | list[str], before: int | None, only: DataFrame | None, order_by: tuple[str, ...]) -> DataFrame:
        logged = self.rows(before)
        if only is not None:
            logged = logged.join(only, key, "left_semi")
        return latest(logged, key, *self._rank(order_by)).drop("batch")

    def newest(
        self,
        key: str | list[str],
        before: int | None = None,
        only: DataFrame | None = None,
        order_by: tuple[str, ...] = ("batch",),
    ) -> DataFrame:
        """The last logged row of each key, or of the keys in ``only``, without
        those that ended."""
        return self._alive(self._newest(key, before, only, order_by))

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows.where(~F.coalesce(self.ended, F.lit(False))).drop(self.ended) if self.ended else rows

    def ended_keys(self, before: int | None = None) -> DataFrame:
        """The keys that ended."""
        return self.rows(before).where(self.ended).select(self.key).distinct()

    def current(
        self,
        base: DataFrame,
        key: str,
        before: int | None = None,
        only: DataFrame | None = None,
        order_by: tuple[str, ...] = ("batch",),
    ) -> DataFrame:
        """The base table with logged rows in place of the ones they replace.

        By default every logged row replaces an older one. Ordered by a time
        stamp, a late row loses against newer logged or base rows.
        """
        changed = self._newest(key, before, only, order_by)
        if only is not None:
            base = base.join(only, key, "left_semi")
        if self.ended:
            base = base.withColumn(self.ended, F.lit(False))
        base = base.select(*changed.columns)
        if order_by == ("batch",):
            return self._alive(lookup_join(base, changed.select(key), [key], "left_anti").unionByName(changed))
        return self._alive(latest(base.unionByName(changed), key, *self._rank(order_by)))
