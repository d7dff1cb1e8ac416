"""Readers for the stored tables and the floor tables derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspark.session import tune
from floorspark.sources.bindings import BINDINGS, inputs
from floorspark.sources.schemas import SOURCES


class Tables:
    """Tables of one data folder, each a lazy DataFrame: ``tables.jobs``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in SOURCES:
                df = self.spark.read.schema(SOURCES[name]).parquet(self.path(name))
            else:
                df = self.derive(name)
            self._known[name] = df
        return self._known[name]

    def derive(self, name: str, **replaced: DataFrame) -> DataFrame:
        """Run a binding, with its inputs read from storage unless given."""
        bound = {source: replaced.get(source, None) for source in inputs(name)}
        for source, df in bound.items():
            if df is None:
                bound[source] = self.table(source)
        return self.spark.sql(BINDINGS[name], **bound)

    def stream(self, name: str) -> DataFrame:
        """A stored table read as a stream.

        The pattern matches the table's own name only; a stream takes a single
        file by pattern but not by path.
        """
        return self.spark.readStream.schema(SOURCES[name]).parquet(f"{self.folder}/{name}.parque[t]")

    def __getattr__(self, name: str) -> DataFrame:
        if name in SOURCES or name in BINDINGS:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def counts_v1(self) -> DataFrame:
        """Second retired layout of counts: a list of trolley entries per job.

        Lists are null or empty for some jobs, and some entries are null.
        """
        key = F.col("o_orderkey")
        entries = F.transform(
            F.sequence(F.lit(1), F.greatest(key % 6, F.lit(1))),
            lambda i: F.when((key + i) % 7 != 0, ((key * i) % 40).cast("int")),
        )
        return self.orders.select(
            key.alias("job_id"),
            F.when(key % 6 == 0, F.array().cast("array<int>"))
            .when(key % 13 != 0, entries)
            .alias("trolley_entries"),
            F.when(key % 7 == 0, (key % 90).cast("int")).alias("manual_total_override"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        """Extraction requests with the caller's bearer token."""
        claim = F.concat(F.lit('{"sub":"u","role":"'), F.col("role"), F.lit('"}'))
        payload = F.rtrim(F.base64(F.encode(claim, "UTF-8")), F.lit("="))
        token = F.concat(F.lit("bearer h."), F.translate(payload, "+/", "-_"), F.lit(".s"))
        broken = F.when(F.col("req_id") % 2 == 0, F.lit("Bearer h")).otherwise(F.lit("Bearer h.%%%.s"))
        return self.envelopes.withColumn("authorization", F.coalesce(token, broken))
