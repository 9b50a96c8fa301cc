"""Preparation of brightness series in long form: (target, t, f) rows, t in days, f the flux.

All window operators partition by target, so one shuffle serves a chain of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from dimstar.functions.isolation import apply_isolated
from dimstar.functions.rules import ensure_odd, tidy
from dimstar.functions.runtime import materialize, ship_code


def _all():
    return Window.partitionBy("target")


def _by_time():
    return Window.partitionBy("target").orderBy("t")


def finite_points(df: DataFrame) -> DataFrame:
    """Rows whose time and flux are finite numbers."""
    return df.withColumns({"t": tidy(F.col("t")), "f": tidy(F.col("f"))}).filter("t is not null and f is not null")


def first_occurrences(df: DataFrame, order: str) -> DataFrame:
    """One row per (target, t): the first by `order`."""
    w = Window.partitionBy("target", "t").orderBy(order)
    return df.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def trailing_span(df: DataFrame, days: float = 27.4, least: int = 200) -> DataFrame:
    """The last `days` of each series, if at least `least` points remain; else the whole series."""
    late = F.col("t") >= F.max("t").over(_all()) - days
    marked = df.withColumn("late", late)
    n_late = F.count_if(F.col("late")).over(_all())
    return marked.withColumn("n_late", n_late).filter(F.col("late") | (F.col("n_late") < least)).drop("late", "n_late")


def normalize(df: DataFrame) -> DataFrame:
    """f becomes (f - median) / population deviation; series without a spread are dropped."""
    stats = df.withColumns({"med": F.median("f").over(_all()), "sd": F.stddev_pop("f").over(_all())})
    return stats.filter("sd > 0").withColumn("f", (F.col("f") - F.col("med")) / F.col("sd")).drop("med", "sd")


def robust_clip(df: DataFrame, width: float = 12.0) -> DataFrame:
    """f limited to median +- width * 1.4826 * (MAD + 1e-12)."""
    centred = df.withColumn("med", F.median("f").over(_all()))
    limits = centred.withColumn("room", width * 1.4826 * (F.median(F.abs(F.col("f") - F.col("med"))).over(_all()) + 1e-12))
    low, high = F.col("med") - F.col("room"), F.col("med") + F.col("room")
    return limits.withColumn("f", F.greatest(low, F.least(high, F.col("f")))).drop("med", "room")


def sigma_clip(df: DataFrame, width: float = 7.0) -> DataFrame:
    """Rows strictly within width population deviations of the median; a constant series loses all."""
    stats = df.withColumns({"med": F.median("f").over(_all()), "sd": F.stddev_pop("f").over(_all())})
    return stats.filter(F.abs(F.col("f") - F.col("med")) < width * F.col("sd")).drop("med", "sd")


def _sliding_medians(values: np.ndarray, there: np.ndarray, half: int) -> list[float | None]:
    """The median of the values that are there among those up to `half` places away, for each place; NaN counts as the largest value."""
    width, n = 2 * half + 1, len(values)
    out: list[float | None] = [None] * n
    clean = there & ~np.isnan(values)
    inner = np.zeros(n, bool)
    if n >= width:
        inner[half : n - half] = np.lib.stride_tricks.sliding_window_view(clean, width).all(1)
        frames = np.lib.stride_tricks.sliding_window_view(values, width)
        places = np.flatnonzero(inner)
        step = max(1, 2_000_000 // width)
        for i in range(0, len(places), step):
            for place, level in zip(places[i : i + step].tolist(), np.median(frames[places[i : i + step] - half], 1).tolist()):
                out[place] = level
    for place in np.flatnonzero(~inner).tolist():
        near = slice(max(0, place - half), place + half + 1)
        found = np.sort(values[near][there[near]])
        if len(found):
            out[place] = float((found[(len(found) - 1) // 2] + found[len(found) // 2]) / 2)
    return out


def _placed(df: DataFrame, ranged: bool) -> DataFrame:
    """`df` with _place, the 0-based position of each point by (t, f) in its series, and _n, the points of the series.

    With `ranged`, points are dealt to ranges of (target, t, f), and the sizes of the ranges before give the offset of each: no task
    sorts a whole series. Else one window does.
    """
    if not ranged:
        return df.withColumns({"_place": F.row_number().over(_all().orderBy("t", "f")) - 1, "_n": F.count(F.lit(1)).over(_all())})
    dealt = materialize(df.repartitionByRange("target", "t", "f").withColumn("_part", F.spark_partition_id()), "series-ranges")
    sizes = dealt.groupBy("target", "_part").agg(F.count(F.lit(1)).alias("_inside"))  # a row for each range of a series
    before = _all().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("target").alias("_own"), F.col("_part").alias("_range"), F.coalesce(F.sum("_inside").over(before), F.lit(0)).alias("_before"), F.sum("_inside").over(_all()).alias("_n")
    )
    rows = dealt.join(sizes, F.col("target").eqNullSafe(F.col("_own")) & (F.col("_part") == F.col("_range")))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("target", "_part").orderBy("t", "f")) - 1
    return rows.withColumn("_place", place).drop("_part", "_own", "_range", "_before")


def moving_median(df: DataFrame, window: int = 101, out: str = "trend", block: int = 8192, ranged: bool = False, isolate: bool = False) -> DataFrame:
    """The median of the `window` (made odd) points around each, cut off at the ends of the series.

    A long series is many groups: blocks of `block` points, with the points of half a window on either side added; with `ranged`, its
    points are numbered over ranges, too. With `isolate`, the result has the column error: a block that fails is one row with the
    target and the error's text.
    """
    ship_code(df.sparkSession)
    half, kept = ensure_odd(window) // 2, df.drop(out)
    names = kept.columns
    rows = _placed(kept, ranged)
    last = F.floor((F.col("_n") - 1) / block)
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_place") - half) / block)), F.least(last, F.floor((F.col("_place") + half) / block)))
    dealt = rows.withColumn("_block", F.explode(near))

    def medians(group: pa.Table) -> pa.Table:
        group = group.sort_by("_place")
        f = group.column("f").cast(pa.float64())
        levels = _sliding_medians(f.to_numpy(), np.array(f.is_valid()), half)
        own = group.column("_place").to_numpy() // block == group.column("_block")[0].as_py()
        found = group.select(names).append_column(out, pa.array(levels, pa.float64()))
        return found.filter(pa.array(own))

    schema = StructType([*kept.schema.fields, StructField(out, DoubleType())])
    return apply_isolated(dealt.groupBy("target", "_block"), ["target"], medians, schema, isolate)


def filled_gaps(df: DataFrame, share: float = 0.9) -> DataFrame:
    """f without missing values where a series has too few: below a `share` of finite values, the others become their median (0 if there are none)."""
    f = tidy(F.col("f"))
    known = F.count(f).over(_all()) / F.count(F.lit(1)).over(_all())
    level = F.coalesce(F.median(f).over(_all()), F.lit(0.0))
    return df.withColumns({"_known": known, "_level": level}).withColumn("f", F.when((F.col("_known") < share) & f.isNull(), F.col("_level")).otherwise(F.col("f"))).drop("_known", "_level")


def detrend(df: DataFrame, window: int = 101, clip: float = 8.0, ranged: bool = False, isolate: bool = False, fill: float | None = None) -> DataFrame:
    """f minus its moving median, divided by the population deviation (1 if that is 0), limited to +-clip.

    With `fill`, series with a smaller share of finite values have the others filled first (see `filled_gaps`). `ranged` and `isolate`
    as in `moving_median`; the deviation is that of the finite values.
    """
    rows = df if fill is None else filled_gaps(df, fill)
    flat = moving_median(rows, window, ranged=ranged, isolate=isolate).withColumn("f", F.col("f") - F.col("trend"))
    scaled = flat.withColumn("sd", F.stddev_pop(tidy(F.col("f"))).over(_all()))
    f = F.col("f") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return scaled.withColumn("f", F.when(f.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), f)))).drop("trend", "sd")


def detrend_reflected(df: DataFrame, share: float = 0.05, block: int = 8192, ranged: bool = False, isolate: bool = False) -> DataFrame:
    """f minus a moving median as wide as a share of the series (at least 11, odd), mirrored at its ends, over the deviation.

    Points go to blocks of `block` places, or of one width if that is more, together with half a width on either side; at the ends of
    the series the places beyond are mirror images of those inside. So no task holds a long series, whatever its width.
    """
    ship_code(df.sparkSession)
    rows = _placed(df.select("target", "t", "f"), ranged)
    rows = rows.withColumn("_half", F.expr(f"greatest(11, cast({share}D * _n as bigint) | 1) div 2"))
    rows = rows.withColumn("_size", F.greatest(F.lit(block), 2 * F.col("_half") + 1))
    # the images of a place in a series mirrored again and again; series of fewer than half a width have several
    images = F.concat(*(F.array(F.col("_place") + 2 * k * F.col("_n"), -F.col("_place") - 1 + 2 * k * F.col("_n")) for k in range(-3, 4)))
    reach = F.filter(images, lambda q: (q >= -F.col("_half")) & (q < F.col("_n") + F.col("_half")))
    seen = rows.withColumn("_at", F.explode(reach))
    last = F.floor((F.col("_n") - 1) / F.col("_size"))
    first_block = F.greatest(F.lit(0), F.floor((F.col("_at") - F.col("_half")) / F.col("_size")))
    last_block = F.least(last, F.floor((F.col("_at") + F.col("_half")) / F.col("_size")))
    dealt = seen.filter(first_block <= last_block).withColumn("_block", F.explode(F.sequence(first_block, last_block)))

    def flat(group: pa.Table) -> pa.Table:
        group = group.sort_by("_at")
        at, f = group.column("_at").to_numpy(), group.column("f").to_numpy().astype(float)
        n, half, size, own = (group.column(c)[0].as_py() for c in ("_n", "_half", "_size", "_block"))
        levels = pd.Series(f).rolling(2 * half + 1).median().to_numpy()
        low, high = own * size, min(n, (own + 1) * size)
        mine = np.searchsorted(at, low) + np.arange(high - low)
        return group.select(["target", "t"]).take(mine).append_column("f", pa.array(f[mine] - levels[mine + half]))

    schema = StructType([df.schema["target"], StructField("t", DoubleType()), StructField("f", DoubleType())])
    found = apply_isolated(dealt.withColumn("t", F.col("t").cast("double")).groupBy("target", "_block"), ["target"], flat, schema, isolate)
    scaled = found.withColumn("_sd", F.stddev_pop("f").over(_all()))
    return scaled.withColumn("f", F.col("f") / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)).drop("_sd")


def numbered(df: DataFrame) -> DataFrame:
    """`df` with i (0-based position by time) and n (points of the series)."""
    return df.withColumns({"i": F.row_number().over(_by_time()) - 1, "n": F.count(F.lit(1)).over(_all())})


def decimate(df: DataFrame, length: int) -> DataFrame:
    """(target, j, t, f): `length` points of each series, at positions j * (n - 1) / (length - 1), rounded down.

    A point knows which j select it, so nothing is joined: those with floor(j * (n - 1) / (length - 1)) = i.
    """
    rows = numbered(df)
    step = (F.col("n") - 1).cast("double") / (length - 1)
    at = lambda j: F.floor(j.cast("double") * (F.col("n") - 1) / (length - 1))
    first = F.greatest(F.lit(0), F.floor(F.try_divide(F.col("i").cast("double"), step)).cast("int") - 1)
    last = F.least(F.lit(length - 1), F.ceil(F.try_divide(F.col("i") + F.lit(1.0), step)).cast("int") + 1)
    near = F.filter(F.sequence(F.coalesce(first, F.lit(0)), F.coalesce(last, F.lit(length - 1))), lambda j: at(j) == F.col("i"))
    return rows.select("target", F.explode(near).alias("j"), "t", "f")


def interpolate(df: DataFrame, length: int, extra: list[str] | None = None) -> DataFrame:
    """(target, j, t, f): each series at `length` equally spaced times from its first to its last point, linearly.

    Each pair of neighbours makes the grid points between them: no join of grid and points.
    """
    nxt = {"t1": F.lead("t").over(_by_time()), "f1": F.lead("f").over(_by_time()), "lo": F.min("t").over(_all()), "hi": F.max("t").over(_all())}
    rows = df.withColumns(nxt).withColumn("step", (F.col("hi") - F.col("lo")) / (length - 1)).filter("step > 0")
    place = lambda t: (t - F.col("lo")) / F.col("step")
    tick = lambda j: F.col("lo") + j * F.col("step")
    first = F.greatest(F.lit(0), F.floor(place(F.col("t"))).cast("int") - 1)
    last = F.least(F.lit(length - 1), F.ceil(place(F.coalesce("t1", "t"))).cast("int") + 1)
    # the last grid point is the last point's, whatever its time rounds to
    inner = lambda j: (tick(j) >= F.col("t")) & (tick(j) < F.col("t1")) & (j < length - 1)
    ours = lambda j: F.when(F.col("t1").isNull(), j == length - 1).otherwise(inner(j))
    spread = rows.withColumn("j", F.explode(F.filter(F.sequence(first, last), ours)))
    at = tick(F.col("j"))
    slope = F.try_divide(F.col("f1") - F.col("f"), F.col("t1") - F.col("t"))
    f = F.when(F.col("t1").isNull(), F.col("f")).otherwise(F.col("f") + slope * (at - F.col("t")))
    return spread.select("target", *(extra or []), "j", at.alias("t"), f.alias("f"))


def series_status(df: DataFrame, least: int = 200, length: int = 2001) -> DataFrame:
    """(target, status, n_points, tspan_days, median_dt_days): why a series can't be used, or ok. The first reason counts.

    bad_resample_time: the steps of `length` equal ones over its span vanish in single precision. bad_resample: it can't have that
    many, as `length` is below two.
    """
    rows = df.withColumns({"t": tidy(F.col("t")), "f": tidy(F.col("f"))})
    gaps = rows.withColumn("gap", F.when(F.col("f").isNotNull(), F.col("t") - F.lag("t").over(_by_time())))
    stats = gaps.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("t").isNotNull(), F.col("f"))).alias("n_points"),
        (F.max("t") - F.min("t")).alias("tspan_days"),
        F.median("gap").alias("median_dt_days"),
        F.stddev_pop("f").alias("sd"),
    )
    status = (
        F.when(F.col("n_rows") == 0, "no_lc")
        .when(F.col("n_points") == 0, "all_nan")
        .when(F.col("n_points") < least, "too_short")
        .when(F.coalesce(F.col("tspan_days"), F.lit(0.0)) <= 0, "bad_time")
        .when(F.coalesce(F.col("sd"), F.lit(0.0)) <= 0, "bad_std")
        .when(F.lit(length < 2), "bad_resample")
        .when((F.col("tspan_days") / max(1, length - 1)).cast("float") <= 0, "bad_resample_time")
        .otherwise("ok")
    )
    return stats.select("target", status.alias("status"), "n_points", "tspan_days", "median_dt_days")


def padded(df: DataFrame, column: str, length: int) -> DataFrame:
    """An array column cut or filled with NULL to `length`."""
    fill = F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(0), F.lit(length) - F.size(column)))
    return df.withColumn(column, F.slice(F.concat(F.col(column).cast("array<double>"), fill), 1, length))


def synthetic_times(df: DataFrame, column: str, days: float = 27.4) -> DataFrame:
    """(series columns, i, t, f) of packed series: times i * days / n, without the end point."""
    keep = [c for c in df.columns if c != column]
    points = df.select(*keep, F.size(column).alias("n"), F.posexplode(column).alias("i", "f"))
    return points.withColumn("t", F.col("i") * days / F.col("n")).drop("n")
