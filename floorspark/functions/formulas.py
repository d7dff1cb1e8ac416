"""Count, tonnage and temperature formulas as columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CHANGEOVER_MS = 420_000
MS_PER_HOUR = 3_600_000
HALF = Decimal("0.5")
THOUSANDTH = Decimal("0.001")
TEMPERATURE_BANDS = [(900, "#8a2a1e"), (1200, "#d9432e"), (1400, "#ff8a1e"), (1550, "#ffb84d")]
HOTTEST_BAND = "#fff2d0"
GOOD_FIT, FAIR_FIT = 0.9, 0.6


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def or_zero(value: Column | str) -> Column:
    """Null, NaN and zero all count as zero."""
    return F.coalesce(F.nanvl(col(value).cast("double"), F.lit(0.0)), F.lit(0.0))


def group_product(
    a_cores: Column | str = "group_a_cores",
    a_trolleys: Column | str = "group_a_trolleys",
    b_cores: Column | str = "group_b_cores",
    b_trolleys: Column | str = "group_b_trolleys",
) -> Column:
    """Cores times loads, summed over the two boxes; a missing factor is zero."""
    zero = F.lit(0)
    return F.coalesce(col(a_cores), zero) * F.coalesce(col(a_trolleys), zero) + F.coalesce(
        col(b_cores), zero
    ) * F.coalesce(col(b_trolleys), zero)


def counted_total(override: Column | str = "manual_total_override", product: Column | None = None) -> Column:
    """A typed total wins, even zero; otherwise the boxes decide."""
    return F.coalesce(col(override), group_product() if product is None else product)


def counted_total_v0(override: str = "manual_total_override") -> Column:
    zero = F.lit(0)
    product = F.coalesce(F.col("cores_per_trolley"), zero) * F.coalesce(F.col("trolley_count"), zero)
    return F.coalesce(F.col(override), product)


def entries_total(entries: Column | str) -> Column:
    """Sum of list entries; null entries are skipped, null or empty lists give 0."""
    total = F.aggregate(col(entries), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.coalesce(total, F.lit(0))


def entries_count(entries: Column | str) -> Column:
    """List length, null entries included; a null list gives 0."""
    return F.when(col(entries).isNull(), F.lit(0)).otherwise(F.size(col(entries)))


def counted_total_v1(override: str = "manual_total_override", entries: str = "trolley_entries") -> Column:
    return F.coalesce(F.col(override), entries_total(entries))


def effective_qty(total: Column | str, is_doubles: Column | str = "is_doubles") -> Column:
    """Moulds used: two cores share one when the job runs doubles."""
    # Wide enough for any int, narrow enough for the tonnage product to stay exact.
    exact = col(total).cast("decimal(11,1)")
    return F.when(col(is_doubles), exact * HALF).otherwise(exact)


def tonnage(total: Column | str, weight: Column | str = "weight_kg", is_doubles: Column | str = "is_doubles") -> Column:
    """Cast weight in tonnes, rounded half up to three places."""
    weight = F.coalesce(col(weight), F.lit(0).cast("decimal(18,3)"))
    return F.round(effective_qty(total, is_doubles) * weight * THOUSANDTH, 3)


def planned_tonnage() -> Column:
    """Planned weight in tonnes, unrounded."""
    qty = or_zero("planned_qty")
    return F.when(F.col("is_doubles"), qty / 2).otherwise(qty) * or_zero("weight_kg") / 1000


def rebuilt_override(total: Column | str = "total_cores") -> Column:
    """The typed total as far as the view still shows it: a total that equals
    the box product reads as not typed."""
    product = group_product()
    return F.when(~col(total).eqNullSafe(product), col(total))


def is_open(done: Column | str = "is_done") -> Column:
    """Not done; an unknown flag counts as not done."""
    return ~F.coalesce(col(done), F.lit(False))


def not_blank(value: Column | str) -> Column:
    return col(value).isNotNull() & (col(value) != "")


def dipping_or_false(value: Column | str) -> Column:
    return F.coalesce(col(value), F.lit(False))


def redness(r: Column | str = "r", b: Column | str = "b") -> Column:
    return (col(r) - col(b)) / (col(r) + col(b) + F.lit(1e-6))


def nearest(value: Column | str) -> Column:
    """Round half towards positive infinity."""
    return F.floor(col(value) + 0.5)


def temperature(idx: Column | str, a: Column | str = "a", b: Column | str = "b", n: Column | str = "n") -> Column:
    """Calibrated temperature; null below two points."""
    return F.when(col(n) >= 2, col(a) * col(idx) + col(b))


def temperature_band(value: Column | str) -> Column:
    bands = F.when(col(value).isNull(), F.lit(None).cast("string"))
    for limit, colour in TEMPERATURE_BANDS:
        bands = bands.when(col(value) < limit, colour)
    return bands.otherwise(HOTTEST_BAND)


def fit_tier(r2: Column | str = "r2") -> Column:
    """Quality word of a fit; no fit reads as not calibrated."""
    return (
        F.when(col(r2).isNull(), "uncalibrated")
        .when(col(r2) > GOOD_FIT, "good")
        .when(col(r2) > FAIR_FIT, "fair")
        .otherwise("poor")
    )
