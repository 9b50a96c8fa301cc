"""The composed sweep: a known dip is found, and targets that fail become rows."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from dimstar.operators import search, series, target_sweep, windows
from dimstar.streaming import sweep


def test_one_row_per_target(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 27.4, 1500))
    dip = rng.normal(0, 0.2, 1500) - 2.0 * ((t - 0.4) % 2.5 < 0.15)
    rows = [("dip", x, y) for x, y in zip(t.tolist(), dip.tolist())] + [("noise", x, y) for x, y in zip(t.tolist(), rng.normal(0, 1, 1500).tolist())]
    rows += [("short", float(i), 1.0 * i) for i in range(20)] + [("flat", float(i) / 20, 3.0) for i in range(500)] + [("noise", None, 1.0), ("noise", 2.0, float("nan"))]
    points = spark.createDataFrame(rows, "target string, t double, f double")
    wanted = spark.createDataFrame([(x,) for x in ("dip", "noise", "short", "flat", "gone")], "target string")

    class Middle:
        """Scores a window by how low its middle is."""

        def score(self, x):
            return 1 / (1 + np.exp(x[:, 147:154].mean(1)))

    passes = [{"periods": search.log_grid(1.0, 6.0, 150), "durations": [0.08, 0.15, 0.3]}]
    found = {r.target: r for r in target_sweep.sweep_targets(points, Middle(), targets=wanted, passes=passes, top=6).collect()}
    assert {k: (r.download_status, r.label if r.score is None else None) for k, r in found.items()} == {
        "dip": ("ok", None), "noise": ("ok", found["noise"].label if found["noise"].score is None else None), "short": ("too_short", "download_fail"),
        "flat": ("bad_std", "download_fail"), "gone": ("no_lc", "download_fail"),
    }
    r = found["dip"]
    ratio = r.bls_period / 2.5
    assert min(abs(ratio - x) for x in (0.5, 1, 2)) < 0.02 and r.bls_depth >= 0.5 and 0 <= r.score <= 1 and not r.polarity_flipped
    assert r.score_delta_injected == pytest.approx(r.score_injected - r.score) and r.min_abs_phase < 0.01 and r.morph_n_flags >= 0
    assert found["gone"].morph_n_flags == -1 and found["short"].bls_period is None
    assert found["dip"].error is None
    assert target_sweep.sweep_targets(points.limit(0), passes=passes, net=object()).count() == 0


PASSES = [{"periods": search.log_grid(1.0, 6.0, 60), "durations": [0.08, 0.15, 0.3]}]


def middle(bad: float | None = None):
    """A network that scores a window by how low its middle is; one whose first value is `bad`, or its negative, fails."""

    class Middle:
        def score(self, x):
            if bad is not None and np.isclose(np.abs(x[:, 0]), abs(bad)).any():
                raise ArithmeticError("no score\nfor this window")
            return 1 / (1 + np.exp(x[:, 147:154].mean(1)))

    return Middle()


def light_curves(spark, names, points=700, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k, name in enumerate(names):
        t = np.sort(rng.uniform(0, 27.4, points))
        f = rng.normal(0, 0.2, points) - 2.0 * ((t - 0.4) % (2.5 + 0.4 * k) < 0.15)
        rows += [(name, float(a), float(b)) for a, b in zip(t, f)]
    return spark.createDataFrame(rows, "target string, t double, f double")


def swept(df):
    return {r.target: r.asDict() for r in df.collect()}


def alike(a, b):
    """Rows that agree but for the last places: sums of doubles depend on the order of tasks."""
    return all(x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-6, abs=1e-9)) for x, y in ((a[c], b[c]) for c in a)) and set(a) == set(b)


def test_targets_that_fail_are_rows(spark, monkeypatch):
    """In removing the trend, in the search and in the scoring: each a row with its text, and all others as they are."""
    points = light_curves(spark, "abcd")
    options = {"passes": PASSES, "top": 4}
    fine = swept(target_sweep.sweep_targets(points, middle(), **options))
    assert all(r["error"] is None and r["score"] is not None for r in fine.values())
    medians, sums = series._sliding_medians, search.bin_sums
    flat = target_sweep.prepared(points)
    of_b = np.array([r.f for r in flat.filter("target = 'b'").collect()])
    total = np.rint((of_b - np.median(of_b)) * search.SCALE).sum()
    first = {}
    for r in target_sweep.scored_candidates(flat, search.box_search_series(flat, **options), middle()).filter("target = 'c'").collect():
        first[r.k] = r.raw
    rows = spark.createDataFrame([(k, w) for k, w in first.items()], "k int, w array<double>").select(windows.zscored(F.col("w")).alias("w")).collect()

    def bad_medians(values, there, half):
        if len(values) == 2001 and np.isclose(values[-1], ends["a"]):
            raise ValueError("no trend")
        return medians(values, there, half)

    even = series.interpolate(series.normalize(series.robust_clip(series.trailing_span(series.first_occurrences(series.finite_points(points), "f")))), 2001)
    ends = {r.target: r.f for r in even.groupBy("target").agg(F.max_by("f", "j").alias("f")).collect()}

    def bad_sums(dt, y, period, width):
        if abs(y.sum() - total) < 3000:
            raise RuntimeError("no boxes")
        return sums(dt, y, period, width)

    monkeypatch.setattr(series, "_sliding_medians", bad_medians)
    monkeypatch.setattr(search, "bin_sums", bad_sums)
    found = swept(target_sweep.sweep_targets(points, middle(rows[0].w[0]), **options))
    assert {k: r["error"] for k, r in found.items()} == {"a": "ValueError: no trend", "b": "RuntimeError: no boxes", "c": "ArithmeticError: no score for this window", "d": None}
    assert all(found[k]["label"] == "score_fail" and found[k]["download_status"] == "ok" and found[k]["score"] is None for k in "abc")
    assert alike(found["d"], fine["d"])


def test_states_of_fetches(spark):
    wanted = spark.createDataFrame([("a", True, None), ("gone", False, None), ("gone", None, None), ("none", True, None), ("bad", True, "HTTP\n404 " + "x" * 300), (None, True, None)], "target string, listed boolean, fetch_error string")
    found = target_sweep.fetch_states(wanted, series.series_status(light_curves(spark, "ab")))
    states = {r.target: r.status for r in found.collect()}
    assert states == {"a": "ok", "gone": "no_lc", "none": "download_none", "bad": ("error:HTTP 404 " + "x" * 300)[:126]}
    narrow = spark.createDataFrame([("n", i * 1e-46, float(i % 3)) for i in range(300)], "target string, t double, f double")
    assert series.series_status(narrow).first().status == "bad_resample_time"
    assert {r.status for r in series.series_status(light_curves(spark, "a"), length=1).collect()} == {"bad_resample"}


def test_windows_of_searched_copies(spark):
    flat = target_sweep.prepared(light_curves(spark, "abc")).cache()
    passes = [{"periods": search.log_grid(0.5, 13.7, 300), "durations": search.legal_durations(1 / 24, 0.5, 6, 0.5)}]
    rows = target_sweep.searched_windows(flat, copies=4, passes=passes).collect()
    assert len(rows) == 12 and {r.y for r in rows} == {0, 1} and all(len(r.w) == 301 for r in rows)
    for r in rows:
        if r.y:
            assert r.recovery_error == pytest.approx(abs(r.bls_period - r.p_injected) / r.p_injected)
        else:
            assert r.recovery_error is None and r.p_injected is None
    # copies without a dip are the series itself, folded on its own strongest box
    own = {r.target: r for r in search.box_search_series(flat, passes, top=1).collect()}
    for r in rows:
        if r.y == 0:
            assert (r.bls_period, r.bls_t0, r.bls_power) == (own[r.target].period, own[r.target].t0, own[r.target].power)
    deep = [r.recovery_error for r in rows if r.y]
    assert min(deep) < 0.01


def test_the_streamed_sweep_is_the_batch_sweep(spark, tmp_path):
    """Points of five targets over three files and two runs; each target is swept once, in the batch that completes it."""
    points = light_curves(spark, "abcde", points=320).cache()
    sized = points.withColumn("expected", F.lit(320).cast("long")).withColumn("part", F.pmod(F.xxhash64("target", "t"), F.lit(3)))

    def put(name, rows):
        rows.select("target", "t", "f", "expected").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = sweep.events_stream(spark, f"{tmp_path}/in/*", "target string, t double, f double, expected long")
        return sweep.sweep_stream(stream, middle(), f"{tmp_path}/out", f"{tmp_path}/state", passes=PASSES, top=4)

    put("1", sized.filter("part = 0 or target = 'a'"))
    put("2", sized.filter("part = 1 and target != 'a' or target = 'b' and part = 2"))
    assert run()
    assert {r.target for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a", "b"}
    put("3", sized.filter("part = 2 and target not in ('a', 'b')").unionByName(sized.filter("target = 'a'")))  # a again: late rows of a finished target
    put("4", sized.filter("false"))
    assert run() and run()
    found = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    streamed, batch = swept(found), swept(target_sweep.sweep_targets(points, middle(), passes=PASSES, top=4))
    assert found.count() == 5 and set(streamed) == set(batch) and all(alike(streamed[k], batch[k]) for k in batch)


def test_a_stream_stops_itself(spark, tmp_path):
    def put(name, flags, start):
        spark.createDataFrame([("s", start + i, f) for i, f in enumerate(flags)] + [("other", start, False)], "source string, seq int, failed boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    put("a", [False, True, True], 0)
    put("b", [True, True, True, False], 3)
    put("c", [False, False], 7)
    stream = lambda: spark.readStream.schema("source string, seq int, failed boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    assert sweep.watch_failures(stream(), f"{tmp_path}/out", f"{tmp_path}/state", limit=5, seconds=90)
    runs = spark.read.parquet(f"{tmp_path}/out").filter("key = 's'").collect()
    assert max(r.longest for r in runs) == 5
    assert not sweep.watch_failures(stream(), f"{tmp_path}/out2", f"{tmp_path}/state2", limit=6, seconds=15)
