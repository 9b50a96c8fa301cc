"""The sweep over targets: from raw points to one result row per target, failures included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimstar.functions.isolation import failures, successes
from dimstar.functions.rules import failure_label
from dimstar.functions.runtime import materialize
from dimstar.operators import search, selection, series, vetting, windows

LENGTH = 2001

#: A series with a smaller share of finite values has the others filled before its trend is removed.
FINITE = 0.98


def prepared(points: DataFrame, least: int = 200, length: int = LENGTH, window: int = 101, isolate: bool = False) -> DataFrame:
    """(target, t, f): finite points, one for each time, the last 27.4 days, limited, normalised, at equal steps, without the slow trend.

    With `isolate`, the result has the column error, and a target whose trend can't be removed has a row with the error's text.
    """
    clean = series.trailing_span(series.first_occurrences(series.finite_points(points), "f"), least=least)
    even = series.interpolate(series.normalize(series.robust_clip(clean)), length)
    return series.detrend(even.select("target", "t", "f"), window, isolate=isolate, fill=FINITE)


def training_passes(periods: int = 2000, durations: int = 25) -> list[dict]:
    """The grid of the search that makes windows to train on: one pass, without the shortest periods."""
    low, high = 0.5, 13.7
    return [{"name": "training", "periods": search.log_grid(low, high, periods), "durations": search.legal_durations(1 / 24, 0.5, durations, low)}]


def searched_windows(flat: DataFrame, copies: int = 6, share: float = 0.5, seed: int = 42, passes: list[dict] | None = None, least: int = 200) -> DataFrame:
    """Windows to train on: (target, aug, y, w, bls_period, bls_t0, bls_duration, bls_depth, bls_power, p_injected, recovery_error).

    Of each series `copies` are drawn; about a `share` of them has a dip put in (y = 1). Each copy is searched, folded on its strongest
    box, whatever was put in, and scaled, so that a network sees the peaks that it will have to judge. recovery_error is the relative
    error of the period found against the one put in, NULL without a dip. Copies without a box or a valid window are left out. Copies
    without a dip are equal, so they are searched once for each series.
    """
    drawn = materialize(windows.augmentations(flat, copies, share, seed), "windows-drawn")
    dips = flat.join(drawn.filter("y = 1"), "target").withColumn("target", F.concat_ws("#", "target", "aug"))
    plain = flat.join(drawn.filter("y = 0").select("target").distinct(), "target", "left_semi")
    made = windows.inject_dips(dips).select("target", "t", "f").unionByName(plain.withColumn("target", F.concat_ws("#", "target", F.lit("0"))).select("target", "t", "f"))
    made = materialize(made, "windows-copies")
    found = search.box_search_series(made, passes or training_passes(), top=1, least=least)
    found = materialize(found.withColumnRenamed("target", "copy"), "windows-boxes")
    folded = windows.folded_windows(made.join(found.select(F.col("copy").alias("target"), "k", "period", "t0"), "target"))
    fine = folded.filter(windows.valid_window(F.col("w"))).select(F.col("target").alias("copy"), windows.zscored(F.col("w")).alias("w"))
    boxes = found.select("copy", *(F.col(c).alias(f"bls_{c}") for c in ("period", "t0", "duration", "depth", "power")))
    which = F.concat_ws("#", "target", F.when(F.col("y") == 1, F.col("aug")).otherwise(0))
    rows = drawn.select("target", "aug", "y", F.col("period").alias("p_injected"), which.alias("copy")).join(fine.join(boxes, "copy"), "copy")
    error = F.when(F.col("y") == 1, windows.recovery_error(F.col("bls_period"), F.col("p_injected")))
    return rows.select("target", "aug", "y", "w", "bls_period", "bls_t0", "bls_duration", "bls_depth", "bls_power", "p_injected", error.alias("recovery_error"))


def trained_on(flat: DataFrame, copies: int = 6, seed: int = 42, passes: list[dict] | None = None, least: int = 200) -> windows.WindowNet:
    """A network trained on `searched_windows` of these series."""
    rows = searched_windows(flat, copies, seed=seed, passes=passes, least=least).withColumn("target", F.concat_ws("#", "target", "aug"))
    return windows.train_windows(materialize(rows.select("target", "y", "w"), "windows-labelled"))


def _signed(flipped: Column, w: Column) -> Column:
    return F.when(flipped, F.transform(w, lambda x: -x)).otherwise(w)


def scored_candidates(flat: DataFrame, found: DataFrame, net: windows.WindowNet, isolate: bool = False) -> DataFrame:
    """The deep enough candidates with a valid window: raw (the window as folded), both scores, the larger one and its sign."""
    deep = selection.deep_enough(found)
    folded = windows.folded_windows(flat.join(deep.select("target", "k", "period", "t0"), "target"))
    valid = folded.filter(windows.valid_window(F.col("w"))).select("target", "k", F.col("w").alias("raw"), windows.zscored(F.col("w")).alias("w"))
    scored = windows.score_windows(windows.window_stats(valid), net, isolate=isolate)
    return deep.join(selection.polarity(scored).drop("w"), ["target", "k"])


def _without(parts: list[DataFrame]) -> DataFrame:
    """(target, error) of the targets that failed in any part, the first part's text counting."""
    rows = None
    for i, part in enumerate(parts):
        part = part.withColumn("step", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("target").agg(F.min(F.struct("step", "error")).alias("first")).select("target", F.col("first.error").alias("error"))


def fetch_states(targets: DataFrame, status: DataFrame) -> DataFrame:
    """The status of each wanted target: that of its series or, if it has no points, why.

    `targets` has target and, if known, listed (a search found products of it) and fetch_error (the text of a failed download). Without
    points, a target is error:... with a text, download_none if it was listed, else no_lc.
    """
    there = targets.columns
    listed = F.max(F.coalesce(F.col("listed"), F.lit(False))) if "listed" in there else F.lit(False)
    text = F.min("fetch_error") if "fetch_error" in there else F.lit(None).cast("string")
    wanted = targets.filter("target is not null").groupBy("target").agg(F.count(F.lit(1)).alias("n"), listed.alias("listed"), text.alias("fetch_error")).drop("n")
    why = (
        F.when(F.col("fetch_error").isNotNull(), F.concat(F.lit("error:"), F.substring(F.trim(F.translate("fetch_error", "\n", " ")), 1, 120)))
        .when(F.col("listed"), "download_none")
        .otherwise("no_lc")
    )
    return wanted.join(status, "target", "left").withColumn("status", F.coalesce("status", why)).drop("listed", "fetch_error")


def sweep_targets(
    points: DataFrame, net: windows.WindowNet | None = None, *, targets: DataFrame | None = None, passes: list[dict] | None = None, top: int = 24, least: int = 200,
    training: list[dict] | None = None,
) -> DataFrame:
    """One row per target of `points` (target, t, f), and of `targets` (target, see `fetch_states`) if given.

    A series that can't be used has its status and label download_fail; one without a candidate that could be scored has score_fail.
    Else: the search's candidates are folded, scored with both signs and chosen from; the winner is scored once more with a box in
    its window, and its shape is checked. A target for which removing the trend, the search or the scoring raises is a row with
    score_fail and the text in `error`; all others stay as they are. Without `net`, one is trained on searched copies of the usable
    series (`training` is the grid of their search).
    """
    status = series.series_status(points, least)
    if targets is not None:
        status = fetch_states(targets, status)
    status = materialize(status, "sweep-status")
    usable = points.join(status.filter("status = 'ok'").select("target"), "target", "left_semi").select("target", "t", "f")
    ready = materialize(prepared(usable, least, isolate=True), "sweep-series")
    unready = materialize(failures(ready), "sweep-unready")
    flat = successes(ready, unready)
    net = net or trained_on(flat, passes=training, least=least)
    tried = materialize(search.box_search_series(flat, passes or search.two_pass_plan(), top, least, isolate=True), "sweep-candidates")
    unsearched = materialize(failures(tried), "sweep-unsearched")
    rated = materialize(scored_candidates(flat, successes(tried, unsearched), net, isolate=True), "sweep-rated")
    failed = materialize(_without([unready, unsearched, failures(rated)]), "sweep-failed")
    scored = materialize(successes(rated, failed), "sweep-scored")
    spans = flat.groupBy("target").agg((F.max("t") - F.min("t")).alias("tspan"))
    lists = scored.select("target", "k", "period", "power", F.col("score_used").alias("cnn")).join(spans, "target")
    # written before it is joined: a filter inferred from the join would repeat the rules' expressions many times
    chosen = materialize(selection.select_candidates(lists).select("target", "k", "mode"), "sweep-chosen")
    winners = materialize(scored.join(chosen, ["target", "k"]), "sweep-winners")

    # the same network has scored the winner's own window
    boxed = winners.select("target", windows.zscored(windows.with_box(_signed(F.col("polarity_flipped"), F.col("raw")))).alias("w"))
    again = windows.score_windows(boxed, net, isolate=True).select("target", F.col("score_dip").alias("score_injected"))
    places = flat.join(winners.select("target", "period", "t0", "duration"), "target")
    phases = vetting.min_abs_phase(vetting.folded(places))
    shapes = vetting.morphology(places)  # of the series as it is, whatever the sign of the winner

    rows = status.join(winners.drop("raw"), "target", "left").join(again, "target", "left").join(phases, "target", "left").join(failed, "target", "left")
    score = F.col("score_used")
    rows = rows.withColumns({"score": score, "label": failure_label(F.col("status"), score), "score_delta_injected": F.col("score_injected") - score})
    # fixed values: the columns of a results table, and error
    return vetting.morphology_or_default(rows, shapes, vetting.ephemeris_errors(places)).select(
        "target", "score", "label", F.col("status").alias("download_status"), "tspan_days", "median_dt_days",
        F.col("period").alias("bls_period"), F.col("t0").alias("bls_t0"), F.col("duration").alias("bls_duration"), F.col("depth").alias("bls_depth"),
        F.col("power").alias("bls_power"), "mode", "polarity_flipped", "score_dip", "score_bump", "score_used", "score_injected", "score_delta_injected",
        F.col("missing").alias("w_nan_frac"), F.col("deviation").alias("w_std"), "min_abs_phase",
        *vetting.SHAPE_COLUMNS, "error",
    )
