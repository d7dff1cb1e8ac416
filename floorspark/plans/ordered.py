"""Running values over ordered groups of any size.

A window partitioned by a group key sorts each group inside one task. Groups are
therefore cut into slices, each slice is sorted and scanned on its own, and what
the slices before it add up to is joined in. Sums must be of whole numbers or
decimals, so that the cuts cannot change a digit.

Slices are range partitions of group and order: Spark samples the rows and cuts
where they are, so a group is spread over as many slices as its share of the rows
asks for, however its order values lie and however many of them are equal. The
partitioned rows are stored once, because both the slices' totals and the rows
must see the same cuts; pass keys, order and values only, and join the rest to the
result. An order that never repeats, such as an arrival number, may instead be cut
by a fixed function of it: then nothing runs while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorspark.session import stored

SLICE = "_slice"
#: Place in the order of all rows, as stored with range partitions.
PLACE = "_place"

_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def number_slice(value: Column, width: int, then: Column | None = None, then_width: int = 1 << 16) -> Column:
    """Slices of ``width`` along a number or null; nulls come last, cut by
    ``then``, which orders them."""
    last = F.floor(then / then_width) if then is not None else F.lit(0).cast("long")
    return F.struct(
        value.isNull().alias("last"),
        F.when(value.isNull(), last).otherwise(F.floor(value / width)).cast("long").alias("slice"),
    )


def _join_values(how: str, before: Column, here: Column) -> Column:
    if how == "sum":
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    return (F.least if how == "min" else F.greatest)(before, here)


class OrderedGroups:
    """Rows in groups ``keys``, ordered by ``order`` inside each group.

    ``order`` must identify a row within its group. Without ``cut`` slices are
    range partitions, and the rows are stored. A ``cut`` names each row's slice
    and must not fall along the order; its slices should hold some ten thousand
    rows of a group at most.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[Column], cut: Column | None = None):
        self.keys, self.order, self._part = keys, order, [*keys, SLICE]
        self._ranged = cut is None
        if not self._ranged:
            self._rows = rows.withColumn(SLICE, cut)
            return
        along = [*[F.col(k).asc() for k in keys], *order]
        ranged = rows.repartitionByRange(*along).sortWithinPartitions(*along)
        placed = ranged.withColumns({SLICE: F.spark_partition_id(), PLACE: F.monotonically_increasing_id()})
        self._rows = stored(placed, "ordered")
        self.order = [F.col(PLACE).asc()]

    def _with(self, rows: DataFrame) -> OrderedGroups:
        more = object.__new__(OrderedGroups)
        more.__dict__.update(self.__dict__, _rows=rows)
        return more

    @property
    def rows(self) -> DataFrame:
        return self._rows.drop(SLICE, PLACE)

    def select_more(self, **columns: Column) -> OrderedGroups:
        """Add row-wise columns."""
        return self._with(self._rows.withColumns(columns))

    def _carry(self, how: dict[str, tuple[str, Column]], later: bool = False) -> DataFrame:
        """Per slice, the aggregate over the slices before it (or of the next one)."""
        totals = self._rows.groupBy(*self._part).agg(
            *[_AGGREGATES[kind](value).alias(name) for name, (kind, value) in how.items()]
        )
        window = Window.partitionBy(*self.keys).orderBy(SLICE)
        if later:
            carried = [F.lead(name).over(window).alias(f"_carry_{name}") for name in how]
        else:
            before = window.rowsBetween(Window.unboundedPreceding, -1)
            carried = [_AGGREGATES[kind](name).over(before).alias(f"_carry_{name}") for name, (kind, _) in how.items()]
        return totals.select(*self._part, *carried)

    def _attach(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        renamed = carried.withColumnsRenamed({k: f"_key_{k}" for k in self._part})
        match = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in self._part]
        return rows.join(renamed, match, "left").drop(*[f"_key_{k}" for k in self._part])

    def running(self, inclusive: bool = True, **columns: tuple[str, Column]) -> OrderedGroups:
        """Add running aggregates, given as ``name=("sum"|"min"|"max", value)``."""
        window = Window.partitionBy(*self._part).orderBy(*self.order)
        window = window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        rows = self._attach(self._rows, self._carry(columns)).withColumns(
            {name: _AGGREGATES[kind](value).over(window) for name, (kind, value) in columns.items()}
        )
        rows = rows.withColumns(
            {n: _join_values(kind, F.col(f"_carry_{n}"), F.col(n)) for n, (kind, _) in columns.items()}
        ).drop(*[f"_carry_{n}" for n in columns])
        return self._with(rows)

    def numbered(self, name: str) -> OrderedGroups:
        """Add the 1-based position in the group.

        In range partitions the stored places give it: rows are neither shuffled
        nor sorted again, only the first place of each group and slice joins them.
        """
        if not self._ranged:
            return self.running(**{name: ("sum", F.lit(1).cast("long"))})
        slices = self._rows.groupBy(*self._part).agg(F.count("*").alias("_rows"), F.min(PLACE).alias("_first"))
        before = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        earlier = F.coalesce(F.sum("_rows").over(before), F.lit(0))
        shifts = slices.select(*self._part, (F.col("_first") - earlier - 1).alias("_shift"))
        rows = self._attach(self._rows, shifts)
        return self._with(rows.withColumn(name, F.col(PLACE) - F.col("_shift")).drop("_shift"))

    def following(self, name: str, value: Column) -> OrderedGroups:
        """Add ``value`` of the next row; ``value`` must not fall along the order."""
        window = Window.partitionBy(*self._part).orderBy(*self.order)
        rows = self._attach(self._rows, self._carry({name: ("min", value)}, later=True))
        rows = rows.withColumn(name, F.coalesce(F.lead(value).over(window), F.col(f"_carry_{name}"))).drop(f"_carry_{name}")
        return self._with(rows)
