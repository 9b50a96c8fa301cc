"""Data sets, bundles, stored networks, and the classifier's arithmetic."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimstar.functions import runtime
from dimstar.operators import batch, window_net
from dimstar.operators.window_net import WindowNet, rank_auc, split_rows
from dimstar.sources import datasets
from dimstar.streaming import sweep


def test_failed_side(spark):
    rows = [("a", i / 10, 1.0 + (i % 3)) for i in range(50)] + [("b", i / 10, 2.0 + (i % 2)) for i in range(5)] + [("c", i / 10, 1.0 * i) for i in range(60)]
    points = spark.createDataFrame(rows, "target string, t double, f double")
    targets = spark.createDataFrame([("a", 1), ("b", 2), ("none", 3), ("c", 4), (None, 0), ("a", 9)], "target string, place int")
    samples, failed = datasets.build_dataset(points, targets, 1, 3, length=21, least=40)
    [only] = samples.collect()
    level = np.array([1.0 + (i % 3) for i in range(50)])
    level = level / np.median(level)
    want = [1.0 + (int(j * 49 / 20) % 3) for j in range(21)]
    got = np.array(only["x"])
    assert only["target"] == "a" and only["label"] == 1 and len(got) == 21
    assert np.corrcoef(got, want)[0, 1] == pytest.approx(1.0)
    assert {(r["target"], r["status"]) for r in failed.collect()} == {("b", "too_short"), ("none", "no_lc")}
    assert datasets.build_dataset(points.limit(0), targets.limit(0), 0, 5)[0].count() == 0


def test_read_through_fetches_once(spark, tmp_path):
    asked = []
    fetch = lambda: asked.append(1) or spark.range(3)
    assert [datasets.read_through(spark, f"{tmp_path}/t", fetch).count() for _ in range(2)] == [3, 3] and len(asked) == 1


def test_attempts_add_up(spark, tmp_path):
    path = f"{tmp_path}/a"
    assert datasets.read_attempts(spark, path).count() == 0
    for rows in ([("x", False), ("y", True)], [("x", True), ("z", None)]):
        datasets.record_attempts(spark.createDataFrame(rows, "target string, ok boolean"), path)
    assert {(r["target"], r["ok"]) for r in datasets.read_attempts(spark, path).collect()} == {("x", True), ("y", True), ("z", False)}


def test_probing_in_waves(spark, tmp_path):
    """As one after the other would: the first ones that succeed, and after a break only what wasn't tried."""
    targets = spark.createDataFrame([(f"t{k}", k) for k in range(300)] + [("t5", 400), (None, 1)], "target string, place int")
    good = {f"t{k}" for k in range(300) if k % 3 == 0}
    waves = []

    def attempt(wave):
        names = [r.target for r in wave.collect()]
        waves.append(names)
        return spark.createDataFrame([(n, n in good) for n in names if not n.endswith("1")], "target string, ok boolean")  # some aren't returned

    def probe(path, **options):
        return [r.target for r in datasets.probe_in_waves(targets, attempt, f"{tmp_path}/{path}", least=7, **options).orderBy("place").collect()]

    wanted = [f"t{k}" for k in range(300) if k % 3 == 0 and k % 10 != 1]
    assert probe("a", want=20) == wanted[:20] and len(waves) > 1
    tried = [n for w in waves for n in w]
    assert len(tried) == len(set(tried)) < 150
    waves.clear()
    assert probe("a", want=20) == wanted[:20] and not waves
    assert probe("a", want=30) == wanted[:30] and not {n for w in waves for n in w} & set(tried)
    assert probe("b", want=1000, limit=50) == [n for n in wanted if int(n[1:]) < 50]
    assert probe("c", want=1000) == wanted and probe("d", want=0) == []


def test_bundle_round_trip(spark, tmp_path):
    rows = datasets.literal_rows(spark, [{"target": "a", "label": 0, "w": [1.0, 2.0]}, {"target": "b", "label": 1, "w": [3.0, None]}], "target string, label int, w array<double>, note string")
    datasets.write_bundle(rows, {"window_len": 2, "seed": 42}, f"{tmp_path}/b")
    samples, constants = datasets.read_bundle(spark, f"{tmp_path}/b")
    assert {(r["target"], tuple(r["w"]), r["note"]) for r in samples.collect()} == {("a", (1.0, 2.0), None), ("b", (3.0, None), None)}
    assert constants.first().asDict() == {"window_len": 2, "seed": 42}
    assert [r["target"] for r in datasets.read_backgrounds(spark, f"{tmp_path}/b/samples").collect()] == ["a"]
    for bad in (rows.withColumn("label", F.lit(2)), rows.withColumn("w", F.array(F.lit(1.0))), rows.withColumn("w", F.lit(None).cast("array<double>"))):
        datasets.write_bundle(bad, {"window_len": 2}, f"{tmp_path}/c")
        with pytest.raises(Exception, match="another label or size"):
            datasets.read_bundle(spark, f"{tmp_path}/c")[0].collect()


def test_gradients_by_differences(monkeypatch):
    monkeypatch.setattr(window_net, "BLOCK_DROPOUT", (0.0, 0.0, 0.0))
    monkeypatch.setattr(window_net, "DENSE_DROPOUT", (0.0, 0.0))
    rng = np.random.default_rng(0)
    net, x, y, weight = WindowNet((3, 4, 5), (6, 4), seed=1), rng.normal(size=(4, 13)), np.array([0, 1, 1, 0.0]), np.array([1.0, 2.0, 1.0, 0.5])

    def loss():
        z = net._run(x, rng)[0].astype(float)
        return np.mean(weight * (np.log1p(np.exp(z)) - y * z))

    for name, g in net.gradients(x, y, weight, rng).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, h, ends = net.weights[name][at], 3e-3, []
        for by in (h, -h):
            net.weights[name][at] = kept + by
            ends.append(loss())
        net.weights[name][at] = kept
        assert g[at] == pytest.approx((ends[0] - ends[1]) / (2 * h), rel=0.1, abs=1e-4), name


def test_auc_and_split():
    score, y = np.array([0.1, 0.4, 0.4, 0.9]), np.array([0, 0, 1, 1])
    pairs = [(a > b) + 0.5 * (a == b) for a in score[y == 1] for b in score[y == 0]]
    assert rank_auc(score, y) == pytest.approx(np.mean(pairs)) and np.isnan(rank_auc(score, np.zeros(4)))
    rest, taken = split_rows(np.array([0] * 50 + [1] * 10), np.random.default_rng(1))
    assert len(taken) == 12 and (taken >= 50).sum() == 2 and sorted([*rest, *taken]) == list(range(60))


def test_network_is_stored(spark, tmp_path):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 31)), np.arange(200) % 2
    x[y == 1, 12:19] -= 4
    net = WindowNet((6, 8, 8), (8, 6)).trained(x, y.astype(float), epochs=40)
    assert net.report["test_auc"] > 0.9 and net.report["epochs"] <= 40
    best = []
    again = WindowNet((6, 8, 8), (8, 6)).trained(x, y.astype(float), epochs=40, on_best=lambda n: best.append(dict(n.weights)))
    assert 1 <= len(best) <= 40 and all(np.array_equal(best[-1][k], w) for k, w in again.weights.items())
    datasets.save_network(spark, net, f"{tmp_path}/n")
    back = datasets.load_network(spark, f"{tmp_path}/n")
    assert np.array_equal(back.score(x), net.score(x)) and back.report == net.report
    assert len(net.score(x[:0])) == 0 and WindowNet().trained(x[:0], y[:0]).report == {}


def test_candidate_lines(spark):
    rows = spark.createDataFrame([("TIC 12", 2.5, 0.25, 0.1, 0.9, 3), ("TIC 7", None, 1.0, 0.2, None, None)], "target string, bls_period double, bls_t0 double, bls_duration double, score double, sector int")
    lines = [r["line"] for r in batch.candidate_lines(rows, 5).orderBy("line").collect()]
    assert lines[0] == '{"tic": 12, "period": 2.5000, "t0": 0.2500, "dur": 0.1000, "score": 0.9000, "sector": 3},'
    assert lines[1] == '{"tic": 7, "period": 0.0000, "t0": 1.0000, "dur": 0.2000, "score": 0.0000, "sector": 0},'


def test_progress(spark):
    rows = spark.createDataFrame([(10, 100, 5.0), (0, 10, 0.2), (10, 10, 4.0)], "done int, total int, elapsed double")
    got = [(r["rate"], r["eta_s"]) for r in sweep.progress(rows).collect()]
    assert got[0] == pytest.approx((2.0, 45.0)) and got[1] == pytest.approx((0.0, 1e10)) and got[2] == pytest.approx((2.5, 0.0))


def test_tables_of_a_run_are_removed(spark):
    with runtime.run_folder(spark) as folder:
        kept = runtime.materialize(spark.range(5), "kept")
        assert kept.count() == 5 and Path(folder.removeprefix("file:")).is_dir()
        outer = folder
    assert not Path(outer.removeprefix("file:")).exists()
    table = runtime.materialize(spark.range(3), "kept")
    assert table.count() == 3 and outer not in table.inputFiles()[0]
    with pytest.raises(ZeroDivisionError), runtime.run_folder(spark) as folder:
        runtime.materialize(spark.range(5), "kept")
        1 / 0
    assert not Path(folder.removeprefix("file:")).exists()
