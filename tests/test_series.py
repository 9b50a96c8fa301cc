"""Series operators against numpy from the definitions, and search against injected dips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimstar.operators import evaluation, order_stats, search, series, windows


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    return {name: (np.sort(rng.uniform(0, 27.4, n)), rng.normal(0, 1, n)) for name, n in (("a", 300), ("b", 251), ("c", 12))}


def frame(spark, points):
    return spark.createDataFrame([(k, float(t), float(f)) for k, (ts, fs) in points.items() for t, f in zip(ts, fs)], "target string, t double, f double")


def of(df, target, *columns):
    rows = df.filter(F.col("target") == target).orderBy("t").collect()
    return [np.array([r[c] for r in rows], float) for c in columns]


def test_moving_median_over_blocks(spark):
    rng = np.random.default_rng(6)
    f = [None if u < 0.1 else float("nan") if u < 0.13 else float(x) for u, x in zip(rng.random(70), rng.normal(0, 1, 70))]
    f[20:32] = [None] * 12
    rows = [("a", float(i), x, f"n{i}") for i, x in enumerate(f)] + [("b", 1.0, 5.0, "one"), (None, 1.0, 2.0, "no target")]
    df = spark.createDataFrame(rows, "target string, t double, f double, note string").withColumn("trend", F.lit("old"))
    found = series.moving_median(df, 7, block=16)
    got = {(r["target"], r["t"]): r for r in found.collect()}
    assert found.columns == ["target", "t", "f", "note", "trend"] and len(got) == 72 and got[("b", 1.0)]["trend"] == 5.0 and got[(None, 1.0)]["trend"] == 2.0
    for i in range(70):
        near = sorted((x for x in f[max(0, i - 3) : i + 4] if x is not None), key=lambda x: (x != x, x))
        want = (near[(len(near) - 1) // 2] + near[len(near) // 2]) / 2 if near else None
        row = got[("a", float(i))]
        assert row["note"] == f"n{i}" and (row["trend"] is None if want is None else row["trend"] == pytest.approx(want, nan_ok=True))
    assert series.moving_median(df.limit(0)).count() == 0


def test_moving_median(spark, points):
    got = of(series.moving_median(frame(spark, points), 20), "a", "trend")[0]
    f = points["a"][1]
    assert got == pytest.approx([np.median(f[max(0, i - 10) : i + 11]) for i in range(len(f))])


def test_reflected_detrend(spark, points):
    got = of(series.detrend_reflected(frame(spark, points)), "b", "f")[0]
    f = points["b"][1]
    k = max(11, int(0.05 * len(f)) | 1)
    padded = np.concatenate([f[: k // 2][::-1], f, f[-(k // 2) :][::-1]])
    rest = f - np.array([np.median(padded[i : i + k]) for i in range(len(f))])
    assert got == pytest.approx(rest / rest.std())


@pytest.mark.parametrize("ranged", [False, True])
def test_reflected_detrend_in_blocks(spark, ranged):
    """Series of all lengths, also shorter than half a width, in blocks of a few points, against mirrored padding."""
    rng = np.random.default_rng(9)
    series_of = {f"s{n}": (np.sort(rng.uniform(0, 9, n)), rng.normal(0, 1, n)) for n in (1, 2, 3, 5, 6, 11, 12, 40, 700)}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = series.detrend_reflected(frame(spark, series_of), block=13, ranged=ranged).collect()
        level = series.moving_median(frame(spark, series_of), 7, block=13, ranged=ranged).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(found) == len(level) == sum(len(t) for t, _ in series_of.values())
    for name, (_, f) in series_of.items():
        half = max(11, int(0.05 * len(f)) | 1) // 2
        padded = np.pad(f, half, mode="symmetric")
        rest = f - np.array([np.median(padded[i : i + 2 * half + 1]) for i in range(len(f))])
        got = [r.f for r in sorted((r for r in found if r.target == name), key=lambda r: r.t)]
        assert got == pytest.approx(rest / (rest.std() or 1))
        trend = [r.trend for r in sorted((r for r in level if r.target == name), key=lambda r: r.t)]
        assert trend == pytest.approx([np.median(f[max(0, i - 3) : i + 4]) for i in range(len(f))])


def test_missing_values_are_filled(spark):
    rows = [("few", float(i), None if i % 10 == 0 else float(i % 7)) for i in range(100)] + [("most", float(i), None if i == 5 else float(i % 7)) for i in range(100)]
    rows += [("none", float(i), float("nan")) for i in range(20)]
    df = spark.createDataFrame(rows, "target string, t double, f double")
    got = {(r.target, r.t): r.f for r in series.filled_gaps(df, 0.98).collect()}
    level = float(np.median([i % 7 for i in range(100) if i % 10]))
    assert all(got["few", float(i)] == (level if i % 10 == 0 else i % 7) for i in range(100)) and got["most", 5.0] is None and got["none", 3.0] == 0.0
    flat = series.detrend(df, 5, fill=0.98).collect()
    assert all(r.f is not None for r in flat if r.target == "few") and len(flat) == 220


def test_interpolation(spark, points):
    df = series.interpolate(frame(spark, points), 57)
    t, f = of(df, "a", "t", "f")
    assert len(t) == 57 and f == pytest.approx(np.interp(np.linspace(*points["a"][0][[0, -1]], 57), *points["a"]))


def test_decimation(spark, points):
    f = of(series.decimate(frame(spark, points), 40), "b", "f")[0]
    n = len(points["b"][1])
    assert f == pytest.approx([points["b"][1][int(j * (n - 1) / 39)] for j in range(40)])
    assert series.decimate(frame(spark, {"c": points["c"]}), 30).count() == 30


def test_status_and_cleaning(spark):
    rows = [("few", 0.0, 1.0), ("flat", 0.0, 1.0), ("flat", 1.0, 1.0), ("nan", 0.0, float("nan")), ("nan", 1.0, None), ("good", 0.0, 1.0), ("good", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "target string, t double, f double")
    status = {r["target"]: r["status"] for r in series.series_status(df, 2).collect()}
    assert status == {"few": "too_short", "flat": "bad_std", "nan": "all_nan", "good": "ok"}
    assert series.finite_points(df).count() == 5
    assert series.sigma_clip(df.filter("target = 'flat'")).count() == 0


def test_padding(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0],)], "w array<double>")
    assert [r["w"] for r in series.padded(df, "w", 2).collect()] == [[1.0, 2.0], [1.0, None]]


def test_box_search_forms_agree(spark, points):
    periods, durations = search.log_grid(0.6, 9.0, 15), [0.1, 0.2, 0.4]
    got = search.box_search(frame(spark, {"a": points["a"]}), periods, durations).orderBy("period").collect()
    want = search.best_boxes(*points["a"], periods, durations)
    assert np.array([[r[c] for c in ("period", "t0", "duration", "depth", "power")] for r in got]) == pytest.approx(want, rel=1e-6)


def boxes(df):
    return {(r["target"], r["k"]): tuple(r[c] for c in ("period", "t0", "duration", "depth", "power")) for r in df.collect()}


def test_long_series_are_searched_in_blocks(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(3, 23, 20_000))
    f = rng.normal(0, 1, 20_000) - 2.0 * ((t - 0.4) % 2.5 < 0.15)
    long = {"long": (t, f), "short": (t[::40], f[::40])}
    passes = [{"periods": search.log_grid(0.5, 6.0, 40), "durations": [0.08, 0.15, 0.3]}, {"periods": [7.0, 9.0, 50.0], "durations": [0.5]}]
    # 20 blocks, with a median found over ranges, against one task a series
    got = boxes(search.box_search_series(frame(spark, long), passes, top=10, block=900, chunks=3))
    whole = boxes(search.box_search_series(frame(spark, long), passes, top=10, chunks=1))
    assert got == whole and len(got) == 20
    rows = np.concatenate([search.best_boxes(t, f, [p for p in x["periods"] if p <= np.ptp(t) / 2], x["durations"]) for x in passes])
    assert got["long", 1] == tuple(rows[rows[:, 4].argmax()])
    definition = search.box_search(frame(spark, long), passes[0]["periods"], passes[0]["durations"])
    assert {(r.target, r.period): tuple(r)[2:] for r in definition.collect()}[("long", got["long", 1][0])] == got["long", 1][1:]


def test_a_failing_search_is_one_row(spark, points, monkeypatch):
    passes = [{"periods": search.log_grid(0.6, 9.0, 15), "durations": [0.1, 0.2]}]
    fine = boxes(search.box_search_series(frame(spark, points), passes, top=5))

    def broken(dt, y, period, width):
        if len(y) == 251:
            raise RuntimeError("no such\nperiod " + "x" * 500)
        return sums(dt, y, period, width)

    sums = search.bin_sums
    monkeypatch.setattr(search, "bin_sums", broken)
    for block in (50_000, 260):  # 300 points are two blocks of the second
        found = search.box_search_series(frame(spark, points), passes, top=5, block=block, isolate=True)
        assert found.columns == ["target", "k", *search.BOX, "error"]
        bad = found.filter("error is not null").collect()
        assert [(r.target, r.k) for r in bad] == [("b", None)] and bad[0].error.startswith("RuntimeError: no such period x") and len(bad[0].error) == 120
        assert boxes(found.filter("error is null")) == {k: x for k, x in fine.items() if k[0] != "b"}
    with pytest.raises(Exception, match="no such"):
        search.box_search_series(frame(spark, points), passes, top=5).collect()


@pytest.mark.parametrize("by", [None, "g"])
def test_percentiles_over_ranges(spark, by):
    rng = np.random.default_rng(8)
    rows = [("a", float(round(x, 1))) for x in rng.normal(0, 2, 3000)] + [("b", 1.0), ("c", 2.0), ("c", None), (None, 3.0), (None, 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["g"] if by else None: (r["n"], r["p0"], r["p1"], r["p2"]) for r in order_stats.exact_percentiles(df, "x", [0.05, 0.5, 1.0], by).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for g in {r[0] for r in rows if r[1] is not None} if by else [None]:
        values = [x for k, x in rows if x is not None and (not by or k == g)]
        assert found[g] == pytest.approx((len(values), *np.quantile(values, [0.05, 0.5, 1.0])))
    assert order_stats.exact_percentiles(df.limit(0), "x", [0.5], by).count() == 0


def test_injected_period_is_found(spark):
    rng = np.random.default_rng(11)
    t = np.arange(2001) * 27.4 / 2001
    period, t0 = 3.17, 1.1
    base = spark.createDataFrame([("x", float(a), float(b)) for a, b in zip(t, rng.normal(0, 1, 2001))], "target string, t double, f double")
    dipped = windows.inject_dips(base.withColumns({"period": F.lit(period), "t0": F.lit(t0), "duration": F.lit(0.15), "mult": F.lit(4.0)}))
    passes = [{"periods": search.log_grid(0.6, 13.7, 1200), "durations": search.legal_durations(0.05, 0.4, 6, 0.6)}]
    best = search.box_search_series(dipped, passes, top=3).orderBy("k").first()
    ratio = best["period"] / period
    assert abs(ratio - round(ratio)) / ratio < 0.02 or abs(1 / ratio - round(1 / ratio)) * ratio < 0.02
    shifted = search.box_search_series(dipped.withColumn("t", F.col("t") + 100), passes, top=1).first()
    assert shifted["period"] == pytest.approx(best["period"]) and shifted["t0"] == pytest.approx(best["t0"] + 100, abs=1e-6)
    assert search.box_search_series(base.limit(100), passes).count() == 0


def test_folded_window(spark, points):
    t, f = points["a"]
    df = frame(spark, {"a": points["a"]}).withColumns({"k": F.lit(1), "period": F.lit(3.0), "t0": F.lit(0.5)})
    phase = (t - 0.5 + 1.5) % 3.0 / 3.0 - 0.5
    order = np.argsort(phase)
    x, y = phase[order], f[order]
    grid = np.linspace(-0.5, 0.5, 301)
    got = windows.folded_windows(df).first()["w"]
    assert got == pytest.approx(np.interp(grid, np.concatenate([[x[-1] - 1], x, [x[0] + 1]]), np.concatenate([[y[-1]], y, [y[0]]])), abs=1e-9)
    open_ = windows.folded_windows(df, circular=False).first()["w"]
    assert open_ == pytest.approx(np.interp(grid, x, y), abs=1e-9)


def test_scores_of_windows(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        w = rng.normal(0, 1, 61)
        if i % 2:
            w[26:35] -= 6
        rows.append((str(i), [float(x) for x in w], i % 2))
    df = spark.createDataFrame(rows, "target string, w array<double>, y int").withColumn("w", windows.zscored(F.col("w")))
    net = windows.train_windows(df.filter("cast(target as int) < 300"))
    held = windows.score_windows(df.filter("cast(target as int) >= 300"), net)
    right = held.filter((F.col("score_dip") >= 0.5) == (F.col("y") == 1)).count()
    assert right >= 90
    auc = evaluation.roc_auc(evaluation.score_curve(held.select("y", F.col("score_dip").alias("score")))).first()["auc"]
    assert auc > 0.95


def test_augmentation_draws(spark):
    df = spark.createDataFrame([(str(i), 0.0, 0.0) for i in range(500)], "target string, t double, f double")
    rows = windows.augmentations(df).collect()
    dips = [r for r in rows if r["y"] == 1]
    assert len(rows) == 3000 and 1350 < len(dips) < 1650
    assert all(0.5 <= r["period"] <= 13.7 and 0 <= r["t0"] <= r["period"] and 1 / 24 <= r["duration"] <= 0.5 and 2 <= r["mult"] <= 10 for r in dips)
    assert np.mean(np.log([r["period"] for r in dips])) == pytest.approx(np.log(0.5 * 13.7) / 2, abs=0.1)
    assert rows == windows.augmentations(df.repartition(7)).orderBy("target", "aug").collect() or sorted(rows) == sorted(windows.augmentations(df.repartition(7)).collect())
