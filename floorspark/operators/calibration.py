"""Colour sampling, calibration fits and temperature estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspark.functions import formulas as fx
from floorspark.plans.ordered import OrderedGroups, number_slice
from floorspark.plans.skew import lookup_join

# Fixed values.
HALF_BOX = 12
MIN_POINTS = 2
TINY = 1e-9


def centre_box(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of the sample box in the middle of each frame."""
    cx, cy = width // 2, height // 2
    return pixels.where(
        F.col("x").between(cx - HALF_BOX, cx + HALF_BOX - 1) & F.col("y").between(cy - HALF_BOX, cy + HALF_BOX - 1)
    )


def frame_index(pixels: DataFrame, *extra: str) -> DataFrame:
    """Mean colour of each frame and its redness index."""
    means = pixels.groupBy("frame_id", "device", *extra).agg(*[F.avg(c).alias(c) for c in "rgb"])
    return means.withColumn("idx", fx.redness())


def _line(n: Column, spread_x: Column, spread_xy: Column, spread_y: Column, mean_x: Column, mean_y: Column) -> dict:
    """Least-squares line from centred sums; null where no line is defined."""
    usable = (n >= MIN_POINTS) & (F.abs(n * spread_x) >= TINY)
    slope = spread_xy / spread_x
    explained = F.when(spread_y > TINY, spread_xy * spread_xy / (spread_x * spread_y)).otherwise(1.0)
    return {
        "a": F.when(usable, slope),
        "b": F.when(usable, mean_y - slope * mean_x),
        "r2": F.when(usable, explained),
    }


def fit(points: DataFrame) -> DataFrame:
    """Line temp = a*idx + b per device, with its r2, in one pass of partial sums.

    No line below two points or when all indices coincide; constant
    temperatures count as a perfect fit.
    """
    n, spread = F.col("n"), F.col("n") * F.col("n") * F.col("_var_x")
    usable = (n >= MIN_POINTS) & (spread >= TINY)
    return (
        points.groupBy("device")
        .agg(
            F.count("*").alias("n"),
            F.var_pop("idx").alias("_var_x"),
            F.var_pop("temp").alias("_var_y"),
            F.regr_slope("temp", "idx").alias("_a"),
            F.regr_intercept("temp", "idx").alias("_b"),
            F.regr_r2("temp", "idx").alias("_r2"),
        )
        .select(
            "device",
            "n",
            F.when(usable, F.col("_a")).alias("a"),
            F.when(usable, F.col("_b")).alias("b"),
            F.when(usable, F.when(n * F.col("_var_y") > TINY, F.col("_r2")).otherwise(1.0)).alias("r2"),
        )
    )


def fit_history(points: DataFrame) -> DataFrame:
    """The fit after each added point, in arrival order ``seq``.

    Values are taken relative to the device's overall means before they are
    summed, and as decimals, which keeps long running sums exact.
    """
    means = points.groupBy("device").agg(F.avg("idx").alias("_mx"), F.avg("temp").alias("_my"))
    centred = lookup_join(points, means, ["device"]).withColumns(
        {"_x": F.col("idx") - F.col("_mx"), "_y": F.col("temp") - F.col("_my")}
    )
    x, y = F.col("_x"), F.col("_y")
    exact = lambda value: value.try_cast("decimal(28,15)")
    running = (
        OrderedGroups(centred, ["device"], [F.col("seq").asc()], number_slice(F.col("seq"), 1 << 16))
        .running(
            n=("sum", F.lit(1).cast("long")),
            _sx=("sum", exact(x)),
            _sy=("sum", exact(y)),
            _sxx=("sum", exact(x * x)),
            _sxy=("sum", exact(x * y)),
            _syy=("sum", exact(y * y)),
        )
        .rows
    )
    running = running.withColumns({c: F.col(c).cast("double") for c in ("_sx", "_sy", "_sxx", "_sxy", "_syy")})
    n, sx, sy = F.col("n"), F.col("_sx"), F.col("_sy")
    line = _line(
        n,
        F.col("_sxx") - sx * sx / n,
        F.col("_sxy") - sx * sy / n,
        F.col("_syy") - sy * sy / n,
        F.col("_mx") + sx / n,
        F.col("_my") + sy / n,
    )
    return running.withColumns(line).select("device", "seq", "n", "a", "b", "r2")


_SUMS = {"sx": "x", "sy": "y", "sxx": "x * x", "sxy": "x * y", "syy": "y * y"}
#: What a version of a device's fit keeps; versions merge by adding their sums.
VERSION_COLUMNS = "device long, seq long, added_at timestamp, n long, ox double, oy double, " + ", ".join(
    f"{c} decimal(38,15)" for c in _SUMS
)


def fit_versions(points: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The sums behind a device's fit after each of ``points``, in order of ``seq``.

    ``points`` has device, seq, idx, temp and added_at. ``before`` holds the last
    version of the devices known so far; their sums are carried on. Values count
    from the device's first point and as decimals, so that sums add up exactly,
    however the points are dealt into batches.
    """
    first = points.groupBy("device").agg(F.min_by(F.struct("idx", "temp"), "seq").alias("_first"))
    origins = first.select("device", F.col("_first.idx").cast("double").alias("ox"), F.col("_first.temp").cast("double").alias("oy"))
    earlier = ["n", "ox", "oy", *_SUMS]
    if before is not None:
        known = before.select("device", *[F.col(c).alias(f"_{c}") for c in earlier])
        origins = origins.join(known, "device", "left").select(
            "device", F.coalesce("_ox", "ox").alias("ox"), F.coalesce("_oy", "oy").alias("oy"), *[f"_{c}" for c in ("n", *_SUMS)]
        )
    placed = lookup_join(points, origins, ["device"]).withColumns({"x": F.col("idx") - F.col("ox"), "y": F.col("temp") - F.col("oy")})
    running = (
        OrderedGroups(placed, ["device"], [F.col("seq").asc()], number_slice(F.col("seq"), 1 << 16))
        .running(n=("sum", F.lit(1).cast("long")), **{c: ("sum", F.expr(f"try_cast({e} as decimal(28,15))")) for c, e in _SUMS.items()})
        .rows
    )
    if before is not None:
        zero = F.lit(0)
        running = running.withColumns({c: (F.col(c) + F.coalesce(f"_{c}", zero)).cast("long" if c == "n" else "decimal(38,15)") for c in ("n", *_SUMS)})
    return running.select(*[F.col(c).cast(kind).alias(c) for c, kind in (x.split() for x in VERSION_COLUMNS.split(", "))])


def version_fits(versions: DataFrame) -> DataFrame:
    """The line of each version: device, seq, added_at, n, a, b and r2."""
    n, sx, sy = F.col("n"), F.col("sx").cast("double"), F.col("sy").cast("double")
    sxx, sxy, syy = (F.col(c).cast("double") for c in ("sxx", "sxy", "syy"))
    line = _line(n, sxx - sx * sx / n, sxy - sx * sy / n, syy - sy * sy / n, F.col("ox") + sx / n, F.col("oy") + sy / n)
    return versions.select("device", "seq", "added_at", "n", *[value.alias(c) for c, value in line.items()])


def as_of(frames: DataFrame, versions: DataFrame, at: str) -> DataFrame:
    """Frames with the newest version of their device that was there at their time.

    ``versions`` has device, seq, added_at and more columns, which the frames get;
    null where the device had none. Frames and versions are ordered together and the
    latest version runs along, in slices, so no device has to fit into one task.
    """
    extra = [c for c in versions.columns if c not in ("device", "seq", "added_at")]
    rank = F.struct("added_at", "seq", *extra)
    time = lambda c: F.col(c).cast("timestamp").alias("_at")
    empty = F.lit(None).cast(versions.select(rank.alias("v")).schema["v"].dataType)
    whole = frames.select(F.struct(*frames.columns).alias("_frame"))
    shape = whole.schema["_frame"].dataType
    events = versions.select("device", time("added_at"), F.lit(0).alias("_kind"), F.col("seq").cast("long").alias("_id"), rank.alias("_version"), F.lit(None).cast(shape).alias("_frame"))
    shown = frames.select("device", time(at), F.lit(1).alias("_kind"), F.col("frame_id").cast("long").alias("_id"), empty.alias("_version"), F.struct(*frames.columns).cast(shape).alias("_frame"))
    order = [F.col("_at").asc(), F.col("_kind").asc(), F.col("_id").asc()]
    found = OrderedGroups(events.unionByName(shown), ["device"], order).running(_newest=("max", F.col("_version"))).rows
    return found.where("_kind = 1").select("_frame.*", *[F.col(f"_newest.{c}").alias(c) for c in extra])


def estimates(frames: DataFrame, fits: DataFrame) -> DataFrame:
    """Frames with their device's temperature, colour band and fit quality."""
    lines = fits.select("device", F.col("n").alias("points"), F.col("a").alias("_a"), F.col("b").alias("_b"), "r2")
    return _scored(lookup_join(frames, lines, ["device"]))


def estimates_as_of(frames: DataFrame, versions: DataFrame, at: str) -> DataFrame:
    """Frames scored with the fit their device had at the time ``at``."""
    named = {"n": "points", "a": "_a", "b": "_b"}
    return _scored(as_of(frames, versions.withColumnsRenamed(named), at))


def _scored(frames: DataFrame) -> DataFrame:
    estimated = frames.withColumn("estimate", fx.temperature("idx", "_a", "_b", "points"))
    return estimated.withColumns(
        {
            "temperature": fx.nearest("estimate"),
            "band": fx.temperature_band("estimate"),
            "tier": fx.fit_tier("r2"),
        }
    ).drop("_a", "_b")
