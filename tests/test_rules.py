"""Expression rules on literal rows with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimstar.functions import rules
from dimstar.operators import batch, selection, vetting, windows
from dimstar.operators.search import legal_durations, log_grid, merged_passes, split_periods, two_pass_plan


def one(spark, expression, schema="x double", row=(None,)):
    return spark.createDataFrame([row], schema).select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize("score,label", [(0.895, "high_confidence_planet"), (0.88, "likely_planet"), (0.86, "candidate"), (0.8599, "reject"), (None, "reject")])
def test_labels(spark, score, label):
    assert one(spark, rules.score_label(F.col("x")), row=(score,)) == label


def test_nan_is_missing(spark):
    for bad in (float("nan"), float("inf"), float("-inf"), None):
        assert one(spark, rules.tidy(F.col("x")), row=(bad,)) is None
        assert one(spark, rules.score_label(rules.tidy(F.col("x"))), row=(bad,)) == "reject"


@pytest.mark.parametrize("p,true,want", [(2.0, 4.0, (True, 2, "divisor")), (8.0, 4.0, (True, 2, "multiple")), (4.0, 4.0, (True, 1, "fundamental")), (12.0, 4.0, (True, 3, "multiple")), (4.084, 4.0, (False, None, None)), (4.08, 4.0, (False, None, None)), (4.079, 4.0, (True, 1, "fundamental")), (4.0, 0.0, (False, None, None)), (None, 4.0, (False, None, None))])
def test_harmonics(spark, p, true, want):
    m = one(spark, rules.harmonic_match(F.col("p"), F.col("t")), "p double, t double", (p, true))
    assert (m["matched"], m["k"], m["kind"]) == want


def test_phase_and_parity(spark):
    rows = spark.createDataFrame([(t,) for t in (-3.0, -1.0, 0.0, 0.5, 1.0, 2.5)], "t double")
    got = rows.select("t", rules.phase(F.col("t"), F.lit(2.0), F.lit(0.0)).alias("p"), rules.odd(rules.transit_number(F.col("t"), F.lit(2.0), F.lit(0.0))).alias("o")).collect()
    assert {r["t"]: r["p"] for r in got} == {-3.0: -0.5, -1.0: -0.5, 0.0: 0.0, 0.5: 0.25, 1.0: -0.5, 2.5: 0.25}
    assert {r["t"]: r["o"] for r in got} == {-3.0: True, -1.0: False, 0.0: False, 0.5: False, 1.0: True, 2.5: True}


@pytest.mark.parametrize("text,want", [("TIC 123456", 123456), ("tic-1234567 x", 1234567), ("0000000123456789", 123456789), ("obs 12345678", 12345678), ("1234", None), ("none", None), (None, None)])
def test_cascade_id(spark, text, want):
    assert one(spark, rules.cascade_id(F.col("x")), "x string", (text,)) == want


@pytest.mark.parametrize("text,want", [("TIC 42", 42), ("  77 ", 77), ("a77", None), ("", None)])
def test_simple_id(spark, text, want):
    assert one(spark, rules.simple_id(F.col("x")), "x string", (text,)) == want


def test_names(spark):
    assert one(spark, rules.normalize_target(F.col("x")), "x string", (" toi-700 ",)) == "TOI 700"
    assert one(spark, rules.target_number(F.col("x")), "x string", ("TIC 12",)) == 12


TIERS = [
    (dict(polarity_flipped=True), "bump"), (dict(polarity_flipped=None), "bump"), (dict(), "A"), (dict(morph_secondary_dip=-0.31), "C"),
    (dict(morph_duty_cycle=0.25), "C"), (dict(morph_v_score=1.21), "C"), (dict(morph_flags="SECONDARY_DIP=-1", morph_n_flags=1), "C"),
    (dict(bls_duration=0.499), "C"), (dict(morph_duty_cycle=0.15, morph_n_flags=1), "D"), (dict(morph_duty_cycle=0.15), "A*"),
    (dict(morph_duty_cycle=0.20), "B"), (dict(morph_n_flags=1), "B"), (dict(morph_n_flags=1, morph_flags="HIGH_DUTY"), "A"),
]


@pytest.mark.parametrize("values,tier", TIERS)
def test_tiers(spark, values, tier):
    row = dict(morph_secondary_dip=None, morph_duty_cycle=None, morph_v_score=None, bls_duration=None, morph_flags=None, morph_n_flags=None, polarity_flipped=False) | values
    df = spark.createDataFrame([tuple(row.values())], "morph_secondary_dip double, morph_duty_cycle double, morph_v_score double, bls_duration double, morph_flags string, morph_n_flags int, polarity_flipped boolean")
    assert batch.tier_rule(df).first()["tier"] == tier


def test_histogram_edges(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.5, 1.0, 2.0, 5.0, 14.0, 14.1, None)], "bls_period double")
    assert [r["n"] for r in batch.period_histogram(df).collect()] == [1, 1, 1, 1, 1]


def test_no_consistent_targets_is_empty(spark):
    df = spark.createDataFrame([("a", 1, 0.9, False, 0, 1.0), ("a", 2, 0.9, False, 0, 2.0), (None, 1, 0.9, False, None, 1.0)], "target string, sector int, score double, polarity_flipped boolean, morph_n_flags int, bls_period double")
    assert batch.multi_sector(df).count() == 0


def test_grids():
    assert log_grid(1, 8, 4) == pytest.approx([1, 2, 4, 8])
    assert max(legal_durations(0.02, 0.5, 25, 0.1)) < 0.098 and len(legal_durations(1, 2, 1, 0.1)) == 3
    assert split_periods(100, [(1, 10), (10, 100)], [10, 70]) == [50, 70]
    assert split_periods(1000, [(1, 10), (10, 10**10)], [400, 600]) == [400, 600]
    assert split_periods(1000, [(1, 10**8), (10**8, 10**10)], [100, 300]) == [700, 300]
    short, normal = two_pass_plan()
    assert len(short["periods"]) + len(normal["periods"]) == 3000 and len(short["durations"]) == 12 and len(normal["durations"]) == 25


def kept_apart(found: np.ndarray, top: int, apart: float = 0.002) -> np.ndarray:
    """Rows by falling power, without those whose period is within `apart` (relative) of a kept one's, up to `top`."""
    kept: list[np.ndarray] = []
    for row in found[np.lexsort((found[:, 0], -found[:, 4]))]:
        if all(abs(row[0] - k[0]) / max(k[0], 1e-12) > apart for k in kept):
            kept.append(row)
            if len(kept) == top:
                break
    return np.array(kept).reshape(-1, 5)


def test_merge_keeps_apart(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(p), 0.0, 0.1, 1.0, float(w)) for p, w in zip(np.repeat(rng.uniform(1, 2, 40), 2) * rng.uniform(0.999, 1.001, 80), rng.integers(1, 20, 80))]
    df = spark.createDataFrame(rows, "target string, period double, t0 double, duration double, depth double, power double")
    got = [r["period"] for r in merged_passes([df.filter("period < 1.5"), df.filter("period >= 1.5")], top=24).orderBy("k").collect()]
    want = kept_apart(np.array([[p, t, d, h, w] for _, p, t, d, h, w in rows]), 24)[:, 0].tolist()
    assert got == want


def chosen(spark, rows, tspan=27.4):
    df = spark.createDataFrame([("t", k, p, float(w), c, tspan) for k, (p, w, c) in enumerate(rows, 1)], "target string, k int, period double, power double, cnn double, tspan double")
    r = selection.select_candidates(df).first()
    return r["k"], r["mode"]


@pytest.mark.parametrize("rows,want", [
    ([(3.0, 10, 0.96), (5.0, 99, 0.97)], (2, "high_cnn_override")),
    ([(3.0, 10, 0.90), (5.17, 99, 0.895)], (2, "cnn_qualified_combined")),
    ([(0.07, 50, 0.96), (0.3511, 40, 0.95)], (2, "high_cnn_override+floor_guard")),
    ([(2.0, 10, 0.96), (4.0, 60, 0.951)], (2, "high_cnn_override+alias_promote_longer")),
    ([(2.0, 10, 0.90), (4.0, 9.9, 0.895)], (1, "cnn_qualified_combined+alias_promote_longer+short_alias_guard")),
    ([(5.0, 10, 0.90), (2.5, 9, 0.88)], (2, "cnn_qualified_combined+short_alias_guard")),
    ([(12.0, 10, 0.90), (3.1, 9, 0.5)], (2, "cnn_qualified_combined+transit_ceil_guard")),
])
def test_selection_branches(spark, rows, want):
    assert chosen(spark, rows) == want


def test_polarity_ties_go_to_the_dip(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.4, 0.6)], "score_dip double, score_bump double")
    assert [(r["polarity_flipped"], r["score_used"]) for r in selection.polarity(df).collect()] == [(False, 0.5), (True, 0.6)]


def curve(spark, kind):
    """Folded curves of known shapes: 200 points a bin of noise-free levels."""
    rows = []
    for i in range(4000):
        t = i / 4000 * 40
        period = 1.0 if kind == "rotation" else 2.0
        p = ((t + period / 2) % period) / period - 0.5
        f = {
            "box": -2.0 if abs(p) <= 0.025 else 0.0,
            "v": -3.0 * max(0.0, 1 - abs(p) / 0.1),
            "two": -3.0 if abs(p) <= 0.025 else -1.5 if abs(abs(p) - 0.5) <= 0.02 else 0.0,
            "rotation": -math.cos(2 * math.pi * p),
        }[kind] + 0.01 * math.sin(i * 12.9898)
        rows.append((kind, t, f, period, 0.0, {"v": 0.4, "rotation": 0.35}.get(kind, 0.1)))
    df = spark.createDataFrame(rows, "target string, t double, f double, period double, t0 double, duration double")
    return vetting.morphology(df).first()


def test_shapes(spark):
    box, v, two, rotation = (curve(spark, k) for k in ("box", "v", "two", "rotation"))
    assert not box["is_strong_fp"] and box["v_score"] < 1.0
    assert v["v_flag"] and v["grazing_flag"]
    assert two["two_dip_flag"] and two["is_strong_fp"] and two["secondary_depth"] == pytest.approx(-1.5, abs=0.02)
    assert rotation["high_duty_flag"] and rotation["is_strong_fp"]


def test_shapes_that_cannot_be_measured(spark):
    """Broken ephemerides become rows of their own and leave the others as they are; uneven depths are flagged if asked for."""
    rows = []
    for i in range(4000):
        t = i / 100
        p = ((t + 1.0) % 2.0) / 2.0 - 0.5
        f = -(0.2 + 3.0 * (math.floor(t / 2.0 + 0.5) % 5 == 0)) if abs(p) <= 0.025 else 0.01 * math.sin(i * 12.9898)
        rows += [("fine", t, f, 2.0, 0.0, 0.1), ("zero", t, f, 0.0, 0.0, 0.1), ("nan", t, f, float("nan"), 0.0, 0.1), ("late", t, f, 2.0, float("inf"), 0.1), ("flat", t, f, 2.0, 0.0, None)]
    df = spark.createDataFrame(rows, "target string, t double, f double, period double, t0 double, duration double")
    results = spark.createDataFrame([(t,) for t in ("fine", "zero", "nan", "late", "flat", "none")], "target string")
    plain = vetting.morphology(df)
    found = {r["target"]: r for r in vetting.morphology_or_default(results, plain, vetting.ephemeris_errors(df)).collect()}
    assert {t: r["morph_flags"] for t, r in found.items() if t != "fine"} == {
        "zero": "morph_error:bad_period", "nan": "morph_error:bad_period", "late": "morph_error:bad_t0", "flat": "morph_error:bad_duration", "none": "morph_unavailable"
    }
    assert all(r["morph_n_flags"] == -1 and r["morph_is_strong_fp"] is False and r["morph_v_score"] is None for t, r in found.items() if t != "fine")
    alone = vetting.morphology(df.filter("target = 'fine'")).first()
    assert plain.collect() == [alone] and found["fine"]["morph_n_flags"] == alone["n_flags"] and found["fine"]["morph_depth_cv"] is None
    uneven = vetting.morphology(df, with_depth_cv=True).first()
    assert uneven["depth_cv"] > 0.8 and uneven["depth_cv_flag"] and "DEPTH_CV=" in uneven["flag_summary"] and uneven["n_flags"] == alone["n_flags"] + 1


def test_windows(spark):
    w = spark.createDataFrame([([1.0, 2.0, None, 3.0],), ([2.0, 2.0],), ([],)], "w array<double>")
    got = [r["z"] for r in w.select(windows.zscored(F.col("w")).alias("z")).collect()]
    assert got[0] == pytest.approx([-1.224744871, 0.0, 0.0, 1.224744871]) and got[1] == [0.0, 0.0] and got[2] == []
    boxed = w.select(windows.with_box(F.array(*map(F.lit, [0.0] * 101))).alias("b")).first()["b"]
    assert [i for i, x in enumerate(boxed) if x] == [48, 49, 50, 51, 52, 53] and boxed[50] == -8.0  # abs(i / 101 - 0.5) <= 0.03, deviation 1
    waves = [math.sin(i) for i in range(301)]
    mean = sum(waves) / 301
    sd = (sum((x - mean) ** 2 for x in waves) / 301) ** 0.5
    got = w.select(windows.with_box(F.array(*map(F.lit, waves))).alias("b")).first()["b"]
    assert got == pytest.approx([x - 8 * sd if abs(i / 301 - 0.5) <= 0.03 else x for i, x in enumerate(waves)])
