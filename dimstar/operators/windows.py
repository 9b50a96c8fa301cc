"""Folded windows for the classifier, injected dips, window statistics, and a classifier that scores windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from dimstar.functions.isolation import error_text, with_error
from dimstar.functions.rules import phase, seeded_uniform
from dimstar.functions.runtime import ship_code
from dimstar.operators.window_net import WindowNet

LENGTH = 301


def folded_windows(df: DataFrame, length: int = LENGTH, circular: bool = True, least: int = 10) -> DataFrame:
    """(target, k, w): the series folded on each candidate (period, t0), interpolated at `length` phases from -0.5 to 0.5.

    df: (target, k, t, f, period, t0). With `circular`, points are repeated one turn before and after, so that the ends join up;
    otherwise the ends keep the level of the first and last point. Candidates with fewer than `least` points have no window.
    """
    rows = df.filter("period > 0").withColumn("x", phase(F.col("t"), F.col("period"), F.col("t0")))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("target", "k"))).filter(F.col("n") >= least)
    # equal phases count as one point, with their mean
    points = rows.groupBy("target", "k", "x").agg(F.avg("f").alias("f"))
    ends = Window.partitionBy("target", "k").orderBy("x")
    back = Window.partitionBy("target", "k").orderBy(F.desc("x"))
    if circular:
        points = points.withColumns({"first": F.row_number().over(ends) == 1, "last": F.row_number().over(back) == 1})
        turn = F.array(F.lit(0), F.when(F.col("first"), F.lit(1)), F.when(F.col("last"), F.lit(-1)))
        points = points.select("target", "k", "f", "x", F.explode(F.filter(turn, lambda d: d.isNotNull())).alias("d"))
        points = points.select("target", "k", (F.col("x") + F.col("d")).alias("x"), "f")
    order = Window.partitionBy("target", "k").orderBy("x")
    nxt = points.withColumns({"x1": F.lead("x").over(order), "f1": F.lead("f").over(order), "is_first": F.row_number().over(order) == 1})
    step = 1.0 / (length - 1)
    tick = lambda j: -0.5 + j * F.lit(step)
    low = F.when(F.col("is_first"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor((F.col("x") + 0.5) / step).cast("int") - 1))
    high = F.least(F.lit(length - 1), F.ceil((F.coalesce("x1", F.lit(0.5)) + 0.5) / step).cast("int") + 1)
    mine = lambda j: ((tick(j) >= F.col("x")) | F.col("is_first")) & (F.col("x1").isNull() | (tick(j) < F.col("x1")))
    filled = nxt.filter(low <= high).withColumn("j", F.explode(F.filter(F.sequence(low, high), mine)))
    share = F.try_divide(tick(F.col("j")) - F.col("x"), F.col("x1") - F.col("x"))
    level = F.when(F.col("x1").isNull() | (tick(F.col("j")) < F.col("x")), F.col("f")).otherwise(F.col("f") + share * (F.col("f1") - F.col("f")))
    packed = filled.groupBy("target", "k").agg(F.array_sort(F.collect_list(F.struct("j", level.alias("v")))).alias("w"))
    return packed.select("target", "k", F.col("w.v").alias("w"))


def valid_window(w: Column, length: int = LENGTH) -> Column:
    return (F.size(w) == length) & F.forall(w, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once for a row and not once for each element that a lambda in the body visits."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _moments(w: Column, body) -> Column:
    """body of a struct (n, mean, var) of the values that are there."""
    there = F.filter(w, lambda x: x.isNotNull())
    total = F.aggregate(there, F.lit(0.0), lambda a, x: a + x)
    first = F.struct(F.size(there).alias("n"), F.try_divide(total, F.size(there)).alias("mean"))

    def second(m: Column) -> Column:
        squares = F.aggregate(there, F.lit(0.0), lambda a, x: a + (x - m["mean"]) * (x - m["mean"]))
        return _let(F.struct(m["n"].alias("n"), m["mean"].alias("mean"), F.try_divide(squares, m["n"]).alias("var")), body)

    return _let(first, second)


def zscored(w: Column) -> Column:
    """The window minus its mean, over its population deviation (1 if that is 0); missing values become 0."""
    sd = lambda m: F.when(m["var"] > 0, F.sqrt(m["var"])).otherwise(1.0)
    scale = lambda m: F.struct(m["mean"].alias("mean"), sd(m).alias("sd"))
    return _moments(w, lambda m: _let(scale(m), lambda k: F.transform(w, lambda x: F.coalesce((x - k["mean"]) / k["sd"], F.lit(0.0)))))


def window_stats(df: DataFrame, column: str = "w") -> DataFrame:
    """`df` with missing (the share of missing values) and deviation (population, of the others)."""
    w = F.col(column)
    return df.withColumns({"missing": _moments(w, lambda m: 1 - F.try_divide(m["n"], F.size(w))), "deviation": _moments(w, lambda m: F.sqrt(m["var"]))})


def with_box(w: Column, depth: float = 8.0, half_width: float = 0.03) -> Column:
    """The window with a box of `depth` population deviations (of 1 if there is none) around phase 0: a winner with it should score otherwise."""
    sd = lambda m: F.when(m["var"] > 0, F.sqrt(m["var"])).otherwise(1.0)
    boxed = lambda k: F.transform(w, lambda x, i: F.when(F.abs(i / F.size(w) - 0.5) <= half_width, x - depth * k).otherwise(x))
    return _moments(w, lambda m: _let(sd(m), boxed))


def inject_dips(df: DataFrame) -> DataFrame:
    """`df` (target, t, f, period, t0, duration, mult) with boxes of mult population deviations taken off f; mult NULL: unchanged."""
    sd = F.stddev_pop("f").over(Window.partitionBy("target"))
    away = F.abs(phase(F.col("t"), F.col("period"), F.col("t0")) * F.col("period"))
    return df.withColumn("sd", sd).withColumn("f", F.when(away <= F.col("duration") / 2, F.col("f") - F.col("mult") * F.col("sd")).otherwise(F.col("f"))).drop("sd")


def augmentations(series: DataFrame, copies: int = 6, share: float = 0.5, seed: int = 42, shortest: float = 0.5, longest: float = 13.7) -> DataFrame:
    """(target, aug, y, period, t0, duration, mult): `copies` samples per series, about `share` of them with an injected dip.

    Periods are log-uniform, durations 1 to 8 % of the period within 1 to 12 hours, depths 2 to 10 deviations. All numbers depend on
    target, copy and seed alone. Samples without a dip have NULL parameters.
    """
    rows = series.select("target").distinct().select("target", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("aug"))
    u = lambda i: seeded_uniform(seed + i, "target", "aug")
    ratio = float(np.log(longest / shortest))
    rows = rows.withColumn("y", (u(0) < share).cast("int")).withColumn("period", F.when(F.col("y") == 1, shortest * F.exp(u(1) * ratio)))
    length = F.greatest(F.lit(1 / 24), F.least(F.lit(0.5), (0.01 + 0.07 * u(2)) * F.col("period")))
    return rows.withColumns({"t0": u(3) * F.col("period"), "duration": F.when(F.col("y") == 1, length), "mult": F.when(F.col("y") == 1, 2 + 8 * u(4))})


def recovery_error(found: Column, injected: Column) -> Column:
    return F.try_divide(F.abs(found - injected), injected)


def train_windows(
    df: DataFrame, column: str = "w", label: str = "y", key: str = "target", max_rows: int = 5_000, seed: int = 7, on_best: Callable[[WindowNet], None] | None = None
) -> WindowNet:
    """A network fitted on at most `max_rows` labelled windows (the smallest seeded hashes), held-out rows of its report included.

    `on_best` is called with the network after each better epoch, for example to write it with `save_network`.
    """
    rows = df.select(F.col(column).cast("array<double>").alias("w"), F.col(label).alias("y"), seeded_uniform(seed, key).alias("u"))
    found = rows.orderBy("u").limit(max_rows).collect()
    return WindowNet(seed=seed).trained(np.array([r["w"] for r in found], float), np.array([r["y"] for r in found], float), seed=seed, on_best=on_best)


def score_windows(df: DataFrame, net: WindowNet, column: str = "w", isolate: bool = False) -> DataFrame:
    """`df` with score_dip and score_bump, the network's scores of each window and of its negative. Missing windows have none.

    With `isolate`, the column error is added: a row whose scoring raises has the error's text and no scores.
    """
    ship_code(df.sparkSession)

    names = [*df.columns, "score_dip", "score_bump", *(["error"] if isolate else [])]

    def both(windows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        there = np.array(windows.is_valid())
        dip, bump = np.full(len(windows), np.nan), np.full(len(windows), np.nan)
        if there.any():
            rows = np.array(windows.drop_null().to_pylist(), float)
            dip[there], bump[there] = net.score(rows), net.score(-rows)
        return dip, bump

    def one_by_one(windows: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
        dip, bump, errors = np.full(len(windows), np.nan), np.full(len(windows), np.nan), [None] * len(windows)
        for i in range(len(windows)):
            try:
                dip[i : i + 1], bump[i : i + 1] = both(windows.slice(i, 1))
            except Exception as error:  # this row's own result
                errors[i] = error_text(error)
        return dip, bump, errors

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, errors = batch.column(column), [None] * batch.num_rows
            try:
                dip, bump = both(windows)
            except Exception:
                if not isolate:
                    raise
                dip, bump, errors = one_by_one(windows)
            more = [pa.array(dip, from_pandas=True), pa.array(bump, from_pandas=True), *([pa.array(errors, pa.string())] if isolate else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    fields = [*df.schema.fields, StructField("score_dip", DoubleType()), StructField("score_bump", DoubleType())]
    return df.mapInArrow(score, with_error(StructType(fields)) if isolate else StructType(fields))
