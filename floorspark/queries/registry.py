"""Registry of queries by inventory id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorspark.sources.bindings import with_clause
from floorspark.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(name: str, uses: str = "", sql: str | None = None, recursive: bool = False):
    """Register a query; ``uses`` names the bindings its check reads."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        oracle = None
        if sql is not None:
            body = sql.strip()
            head = with_clause(uses.split(), recursive) if uses else "with recursive " if recursive else ""
            if body.startswith("with "):
                body = body[5:]
                head = f"{head},\n" if uses else head or "with "
            oracle = f"{head}\n{body}"
        QUERIES[name] = Query(name, build, oracle)
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and timestamps as epoch seconds, for comparing."""
    columns = []
    for field in df.schema.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            value = value.cast("double")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.unix_timestamp(value.cast("timestamp"))
        columns.append(value.alias(field.name))
    return df.select(*columns)
