"""Sweeps over unbounded input: micro-batches, state, and tables that a repeated batch doesn't write twice."""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from dimstar.functions.runtime import materialize, ship_code
from dimstar.operators.target_sweep import sweep_targets
from dimstar.operators.windows import WindowNet


def events_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_per_batch(write: Callable[[DataFrame, str], None], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch goes to its own folder of `path`, so a repeated batch replaces what it wrote."""

    def sink(batch: DataFrame, number: int) -> None:
        write(batch, f"{path}/batch={number}")

    return sink


def keyed_state(spark: SparkSession) -> None:
    """Keep the state of the session's new streams in RocksDB, which state by key needs. A stream goes on with the store it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def sweep(stream: DataFrame, process: Callable[[DataFrame], DataFrame], results: str, state: str, keys: list[str], seconds: float | None = None) -> bool:
    """Process what is there, batch by batch, and stop; says whether all was done within `seconds`.

    Of each key the first row is processed; the keys are in the stream's state store, so a batch's work doesn't grow with the batches
    before it, and a target isn't processed again in a later run with the same `state`. Offsets are committed after a batch's results
    are written; a failed run goes on with the same batch and state, and replaces what it wrote.
    """

    def sink(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return _run(stream.dropDuplicates(keys), sink, state, seconds)


def _run(stream: DataFrame, sink: Callable[[DataFrame, int], None], state: str, seconds: float | None) -> bool:
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    done = query.awaitTermination(seconds) if seconds else (query.awaitTermination() or True)
    if not done:
        query.stop()
    return bool(done)


class _Collector(StatefulProcessor):
    """The points of a target until there are as many as its rows say; then they leave, and the target is done for good."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", "t double, f double")
        self.progress = handle.getValueState("progress", "n long, done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, done = self.progress.get() if self.progress.exists() else (0, False)
        wanted = 0
        for part in rows:
            if done or not len(part):
                continue
            missing = part[["t", "f"]].astype(object).where(part[["t", "f"]].notna(), None)
            self.points.appendList(list(missing.itertuples(index=False, name=None)))
            n, wanted = n + len(part), max(wanted, int(part["expected"].max()))
        if done:
            return
        if n < wanted:
            self.progress.update((n, False))
            return
        for chunk in _chunks(self.points.get(), 10_000):
            yield pd.DataFrame(chunk, columns=["t", "f"]).astype(float).assign(target=key[0])[["target", "t", "f"]]
        self.points.clear()
        self.progress.update((n, True))

    def close(self) -> None:
        pass


def _chunks(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    while chunk := list(itertools.islice(rows, size)):
        yield chunk


def complete_targets(stream: DataFrame) -> DataFrame:
    """(target, t, f) of the targets of `stream` (target, t, f, expected) that have become complete: as many rows as `expected` says.

    Points wait in the state store, keyed by target; a list there is appended to, not rewritten. What comes after a target is complete
    is left out. Rows with a null target or `expected` are left out, too.
    """
    ship_code(stream.sparkSession)
    keyed_state(stream.sparkSession)
    rows = stream.filter("target is not null and expected is not null").select(F.col("target").cast("string").alias("target"), F.col("t").cast("double").alias("t"), F.col("f").cast("double").alias("f"), F.col("expected").cast("long").alias("expected"))
    return rows.groupBy("target").transformWithStateInPandas(_Collector(), "target string, t double, f double", "append", "none")


def collect_targets(stream: DataFrame, results: str, state: str, seconds: float | None = None) -> bool:
    """Write the points of each target of `stream` to a folder of `results` once they are complete, each target once."""
    return _run(complete_targets(stream), lambda batch, number: batch.write.mode("overwrite").parquet(f"{results}/batch={number}"), state, seconds)


def sweep_stream(stream: DataFrame, net: WindowNet, results: str, state: str, seconds: float | None = None, **options) -> bool:
    """`sweep_targets` over a stream of points (target, t, f, expected): a target is swept in the batch that completes it.

    Results go to a folder of `results` for each batch with complete targets. Each target is swept once, also over several runs with the
    same `state`. `options` are those of `sweep_targets`. Says whether all was done within `seconds`.
    """

    def sink(batch: DataFrame, number: int) -> None:
        points = materialize(batch, "sweep-batch")  # read again and again below
        if points.limit(1).count():
            sweep_targets(points, net, **options).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return _run(complete_targets(stream), sink, state, seconds)


def progress(df: DataFrame) -> DataFrame:
    """`df` (done, total, elapsed seconds) with rate (targets a second) and eta_s (seconds left at that rate)."""
    rate = F.col("done") / F.greatest(F.col("elapsed"), F.lit(1.0))
    return df.withColumns({"rate": rate, "eta_s": (F.col("total") - F.col("done")) / F.greatest(rate, F.lit(1e-9))})


def windowed_levels(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count and mean flux per target and event-time window; rows later than `late` are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = stream.withWatermark("ts", late).groupBy(window, "target").agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("level"))
    return grouped.select(F.col("window.start").alias("start"), "target", "n", "level")


class _Streaks(StatefulProcessor):
    """The failures in a row that end a group's rows so far, and the longest run of its newest batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "streak int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        streak = self.streak.get()[0] if self.streak.exists() else 0
        # a number and a flag of each row of the batch
        seq, bad = (np.concatenate(x) for x in zip(*((p["seq"].to_numpy(), p["failed"].to_numpy(bool)) for p in rows)))
        longest = streak
        for failed in bad[np.argsort(seq, kind="stable")]:
            streak = streak + 1 if failed else 0
            longest = max(longest, streak)
        self.streak.update((int(streak),))
        yield pd.DataFrame({"key": [key[0]], "streak": [streak], "longest": [longest]})

    def close(self) -> None:
        pass


def failure_runs(stream: DataFrame, group: str = "source", failed: str = "failed", mode: str = "update") -> DataFrame:
    """(key, streak, longest) per batch and group: the failures in a row that end it, and the longest run in it.

    The counter is kept by group in the state store, so it runs on across batches. Rows of a batch count in the order of seq; rows
    without a group or flag are left out.
    """
    ship_code(stream.sparkSession)
    keyed_state(stream.sparkSession)
    rows = stream.select(F.col(group).cast("string").alias("key"), "seq", F.col(failed).alias("failed")).filter("key is not null and failed is not null")
    return rows.groupBy("key").transformWithStateInPandas(_Streaks(), "key string, streak int, longest int", mode, "none")


def failure_alarm(stream: DataFrame, group: str = "source", failed: str = "failed", limit: int = 6) -> DataFrame:
    """(key, streak, alarm): as `failure_runs`, and whether `limit` failures in a row were reached."""
    runs = failure_runs(stream, group, failed)
    return runs.select("key", "streak", (F.col("longest") >= limit).alias("alarm"))


class StopOnFailures(StreamingQueryListener):
    """Ends a stream whose observed `longest` run of failures reaches `limit`."""

    def __init__(self, spark: SparkSession, limit: int, name: str = "failures"):
        self.spark, self.limit, self.name, self.reached = spark, limit, name, False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None and (seen["longest"] or 0) >= self.limit and not self.reached:
            self.reached = True
            query = self.spark.streams.get(str(event.progress.id))
            if query is not None:
                threading.Thread(target=query.stop, daemon=True).start()  # the listener's own thread mustn't wait for it

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watch_failures(stream: DataFrame, results: str, state: str, limit: int = 6, seconds: float | None = None, **options) -> bool:
    """Write `failure_runs` of a stream to `results` until it has run `seconds`, or for as long as it goes; the stream is stopped once
    `limit` failures in a row were seen in any group. Says whether that happened.

    The batch in which it happens is written as a whole; the next run with the same `state` goes on with the streak.
    """
    spark = stream.sparkSession
    listener = StopOnFailures(spark, limit)
    spark.streams.addListener(listener)
    try:
        runs = failure_runs(stream, mode="append", **options).observe(listener.name, F.max("longest").alias("longest"))
        query = runs.writeStream.format("parquet").option("path", results).option("checkpointLocation", state).start()
        query.awaitTermination(seconds) if seconds else query.awaitTermination()
        if query.isActive:
            query.stop()
    finally:
        spark.streams.removeListener(listener)
    return listener.reached
