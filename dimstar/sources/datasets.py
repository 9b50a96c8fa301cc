"""Data sets to train on, trained networks, and catalogs kept after the first reading. All are Parquet tables in any store."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimstar.functions.runtime import materialize
from dimstar.operators.batch import not_done
from dimstar.operators.series import decimate, finite_points, normalize, series_status
from dimstar.operators.window_net import WindowNet
from dimstar.sources.readers import background, exists


def read_through(spark: SparkSession, path: str, fetch: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`; if there is none, what `fetch` gives is written there first. Whoever wants it fresh deletes the table."""
    if not exists(spark, f"{path}/_SUCCESS"):
        fetch().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def literal_rows(spark: SparkSession, records: list[dict[str, Any]], schema: str) -> DataFrame:
    """A short list of records (targets to try, candidates to vet) as a relation; keys that a record lacks are NULL."""
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in records], schema)


def build_dataset(points: DataFrame, targets: DataFrame, label: int, max_samples: int, length: int = 2001, least: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(target, label, x) of the usable series among the first `max_samples` targets, and (target, status) of the others.

    points: (target, t, f); targets: (target, place), taken by place, then target; null and repeated targets count once or not at all.
    x is the normalised series at `length` positions, picked by index. A target without points has the status no_lc.
    """
    each = targets.filter("target is not null").groupBy("target").agg(F.min("place").alias("place"))
    wanted = each.orderBy(F.col("place").asc_nulls_last(), "target").limit(max_samples).select("target")
    rows = points.join(wanted, "target", "left_semi").select("target", "t", "f")
    status = wanted.join(series_status(rows, least).select("target", "status"), "target", "left")
    status = status.withColumn("status", F.coalesce("status", F.lit("no_lc")))
    usable = rows.join(status.filter("status = 'ok'").select("target"), "target", "left_semi")
    packed = decimate(normalize(finite_points(usable)), length).groupBy("target").agg(F.sort_array(F.collect_list(F.struct("j", "f"))).alias("x"))
    return packed.select("target", F.lit(label).alias("label"), F.col("x.f").alias("x")), status.filter("status <> 'ok'")


def record_attempts(attempts: DataFrame, path: str) -> None:
    """Add (target, ok) of the targets just tried; earlier attempts stay, so a run that broke off goes on after them."""
    attempts.select("target", F.col("ok").cast("boolean").alias("ok")).write.mode("append").parquet(path)


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """(target, ok), one row per target tried so far: ok if any attempt was. Empty before the first run."""
    if not exists(spark, path):
        return spark.createDataFrame([], "target string, ok boolean")
    return spark.read.parquet(path).groupBy("target").agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok"))


def probe_in_waves(
    targets: DataFrame, attempt: Callable[[DataFrame], DataFrame], path: str, want: int = 1500, limit: int = 8000, least: int = 25, spare: float = 1.5
) -> DataFrame:
    """(target, place) of the first `want` targets that succeed, in order of (place, target), of which at most `limit` are tried.

    targets: (target, place). `attempt` takes a wave of them and returns (target, ok); a target that it doesn't return has failed. Each
    wave has as many untried targets as the share of successes so far lets expect to be enough, times `spare`, and at least `least`. What
    was tried is added to the table at `path` after each wave, so a run that broke off goes on after its last one. Null targets are
    left out, of repeated ones the first counts.
    """
    spark = targets.sparkSession
    each = materialize(targets.filter("target is not null").groupBy("target").agg(F.min("place").alias("place")), "probe-targets")
    order = (F.col("place").asc_nulls_last(), "target")
    kind = each.schema["target"].dataType
    while True:
        tried = read_attempts(spark, path).withColumn("target", F.col("target").cast(kind))
        n, good = tried.agg(F.count(F.lit(1)), F.count_if("ok")).first()
        if good >= want or n >= limit:
            break
        wave = math.ceil(spare * (want - good) / max(good / n if n else 1.0, 0.02))
        todo = materialize(not_done(each, tried, ["target"]).orderBy(*order).limit(min(limit - n, max(least, wave))), "probe-wave")
        if not todo.limit(1).count():
            break
        ok = attempt(todo).groupBy("target").agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok"))
        record_attempts(todo.join(ok, "target", "left").select(F.col("target").cast("string").alias("target"), F.coalesce("ok", F.lit(False)).alias("ok")), path)
    found = read_attempts(spark, path).filter("ok").select(F.col("target").cast(kind).alias("target"))
    return each.join(found, "target", "left_semi").orderBy(*order).limit(want)


def write_bundle(samples: DataFrame, constants: dict[str, Any], path: str) -> None:
    """Samples with a label, divided by it, and beside them one row with the constants of the run."""
    samples.write.mode("overwrite").partitionBy("label").parquet(f"{path}/samples")
    spark = samples.sparkSession
    one = spark.range(1).select(*(F.lit(value).alias(name) for name, value in constants.items()))
    one.coalesce(1).write.mode("overwrite").parquet(f"{path}/constants")


def read_bundle(spark: SparkSession, path: str, column: str = "w", size: str = "window_len") -> tuple[DataFrame, DataFrame]:
    """Samples and constants of a bundle. Reading a sample whose label isn't 0 or 1, or whose `column` hasn't the size that the constants state, fails."""
    constants = spark.read.parquet(f"{path}/constants")
    wanted = constants.select(F.col(size).alias("_size")).limit(1)
    rows = spark.read.parquet(f"{path}/samples").crossJoin(F.broadcast(wanted))  # one row
    right = F.coalesce(F.col("label").isin(0, 1) & (F.size(column) == F.col("_size")), F.lit(False))
    checked = F.when(right, F.col(column)).otherwise(F.raise_error(F.lit(f"{path}: a sample with another label or size")))
    return rows.withColumn(column, checked).drop("_size"), constants


def read_backgrounds(spark: SparkSession, path: str) -> DataFrame:
    """The samples without a signal: those with label 0 (see `readers.background`), or all of a table that has no label."""
    rows = spark.read.parquet(path)
    return background(rows) if "label" in rows.columns else rows


def save_network(spark: SparkSession, net: WindowNet, path: str) -> None:
    """A row (name, shape, numbers) for each array of weights, and one for each figure of the report."""
    rows = [(k, list(w.shape), w.ravel().astype(float).tolist()) for k, w in net.weights.items()]
    rows += [(f"report.{k}", [], [float(value)]) for k, value in net.report.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> WindowNet:
    """The network that `save_network` wrote: about 80,000 weights, whatever it was trained on."""
    rows = {r["name"]: np.array(r["numbers"]).reshape(tuple(r["shape"])) for r in spark.read.parquet(path).collect()}
    net = WindowNet(weights={k: w for k, w in rows.items() if not k.startswith("report.")})
    net.report = {k.removeprefix("report."): float(w) for k, w in rows.items() if k.startswith("report.")}
    return net
