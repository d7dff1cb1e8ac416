"""Joins that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _copied(name: str, kind: T.DataType) -> Column:
    """The same value as a new expression, which no longer counts as the
    column its table is partitioned by."""
    value = F.col(name)
    if isinstance(kind, T.StringType):
        return F.concat(value, F.lit(""))
    if isinstance(kind, T.BinaryType):
        return F.concat(value, F.lit(b""))
    if isinstance(kind, T.DateType):
        return F.date_add(value, 0)
    if isinstance(kind, T.TimestampType):
        return value + F.expr("interval 0 seconds")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return (value + F.lit(0).cast(kind)).cast(kind)
    if isinstance(kind, T.IntegralType):
        return value.bitwiseOR(F.lit(0).cast(kind))
    return value


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join many rows to a table that was grouped by the same keys.

    Spark splits a hot key at run time only where the join itself shuffles both
    sides. A grouped table already lies by its keys and would skip that shuffle,
    which leaves all rows of a hot key to one task. Its few rows are therefore
    shuffled once more, and adaptive execution can split the many.
    """
    kinds = {f.name: f.dataType for f in table.schema.fields}
    moved = table.select(*[_copied(c, kinds[c]).alias(c) if c in keys else F.col(c) for c in table.columns])
    return rows.join(moved, keys, how)
