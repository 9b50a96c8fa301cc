"""Folding on an ephemeris (period, t0, duration), binned curves, vetting measurements and shape checks.

Input rows are (target, t, f, period, t0, duration); an ephemeris belongs to its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from dimstar.functions.rules import duty_cycle, joined_flags, odd, percent, phase, tidy, transit_number

_EPHEMERIS = ["target", "period", "t0", "duration"]

# Limits of the shape checks (hard ones mark a false positive) and of the vetting flags.
V_SCORE, ASYMMETRY, SECONDARY, DEPTH_CV, DUTY, GRAZING = 1.5, 0.60, -0.80, 0.80, 0.30, 0.50
CEILING = 0.499

# The shape columns of a results table, and what they hold.
SHAPE_COLUMNS = {
    "morph_v_score": "v_score", "morph_asymmetry": "asymmetry", "morph_secondary_dip": "secondary_depth", "morph_depth_cv": "depth_cv",
    "morph_duty_cycle": "duty_cycle", "morph_grazing_ratio": "grazing_ratio", "morph_grazing_flag": "grazing_flag",
    "morph_n_flags": "n_flags", "morph_is_strong_fp": "is_strong_fp", "morph_flags": "flag_summary",
}


def folded(df: DataFrame) -> DataFrame:
    """`df` with phase, transit (its number) and dur_phase; rows without a positive period are dropped."""
    cols = {
        "phase": phase(F.col("t"), F.col("period"), F.col("t0")),
        "transit": transit_number(F.col("t"), F.col("period"), F.col("t0")),
        "dur_phase": duty_cycle(F.col("duration"), F.col("period")),
    }
    return df.filter("period > 0").withColumns(cols)


def binned(df: DataFrame, bins: int = 200, low: float = -0.5, high: float = 0.5) -> DataFrame:
    """(ephemeris, bin, center, level, n): medians of left-closed phase bins with two or more points."""
    width = (high - low) / bins
    b = F.floor((F.col("phase") - low) / width).cast("int")
    counted = df.withColumn("bin", b).filter((F.col("bin") >= 0) & (F.col("bin") < bins))
    grouped = counted.groupBy(*_EPHEMERIS, "bin").agg(F.median("f").alias("level"), F.count(F.lit(1)).alias("n"))
    return grouped.filter("n >= 2").select(*_EPHEMERIS, "bin", (low + (F.col("bin") + 0.5) * width).alias("center"), "level", "n")


def odd_even_depths(df: DataFrame) -> DataFrame:
    """Per target: medians over odd and over even transits of each transit's median, with 3 or more points within 1.5 half durations."""
    near = df.filter(F.abs("phase") < 1.5 * F.col("dur_phase") / 2)
    each = near.groupBy(*_EPHEMERIS, "transit").agg(F.median("f").alias("depth"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    is_odd = odd(F.col("transit"))
    return each.groupBy(*_EPHEMERIS).agg(
        F.median(F.when(is_odd, F.col("depth"))).alias("odd_depth"),
        F.median(F.when(~is_odd, F.col("depth"))).alias("even_depth"),
        F.count_if(is_odd).alias("n_odd"),
        F.count_if(~is_odd).alias("n_even"),
    )


def phase05_level(df: DataFrame, half_width: float = 0.05) -> DataFrame:
    """Per target: the median half a period away from the transit, of 3 or more points."""
    far = F.abs(F.abs("phase") - 0.5) < half_width
    found = df.groupBy(*_EPHEMERIS).agg(F.median(F.when(far, F.col("f"))).alias("level"), F.count_if(far).alias("n_far"), F.countDistinct("transit").alias("n_transits"))
    return found.select(*_EPHEMERIS, F.when(F.col("n_far") >= 3, F.col("level")).alias("phase05_level"), "n_transits")


def dip_centroid(df: DataFrame, bins: int = 200) -> DataFrame:
    """Per target: the center of the lowest bin (the first of equal ones), with more than 5 bins."""
    found = binned(df, bins).groupBy(*_EPHEMERIS).agg(F.min_by("center", F.struct("level", "bin")).alias("center"), F.count(F.lit(1)).alias("n"))
    return found.select(*_EPHEMERIS, F.when(F.col("n") > 5, F.col("center")).alias("dip_centroid"))


def depth_consistency(df: DataFrame) -> DataFrame:
    """Per target: population deviation over mean size of the transits' median depths, of 4 or more transits and a mean beyond 0.05."""
    near = df.filter(F.abs("phase") < 1.5 * F.col("dur_phase") / 2)
    each = near.groupBy(*_EPHEMERIS, "transit").agg(F.median("f").alias("depth"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    found = each.groupBy(*_EPHEMERIS).agg(F.avg("depth").alias("m"), F.stddev_pop("depth").alias("s"), F.count(F.lit(1)).alias("n"))
    return found.select(*_EPHEMERIS, F.when((F.col("n") >= 4) & (F.abs("m") > 0.05), F.col("s") / F.abs("m")).alias("depth_cv"))


def vetting_flags(df: DataFrame) -> DataFrame:
    """`df` with odd_even_ratio, duty_cycle and flags, from odd_depth, even_depth, phase05_level, dip_centroid and the ephemeris."""
    ratio = F.when(F.abs("odd_depth") > 0, F.abs(F.col("even_depth") / F.col("odd_depth")))
    duty = duty_cycle(F.col("duration"), F.col("period"))
    # fixed values: the texts of the flags
    flags = joined_flags(
        F.when((ratio < 0.6) | (ratio > 1.7), F.format_string("ODD/EVEN DEPTH RATIO=%.2f ⚠ possible EB", ratio)),
        F.when(F.col("phase05_level") < -0.3, F.format_string("SECONDARY DIP at phase 0.5 (%.3fσ) ⚠ possible EB", F.col("phase05_level"))),
        F.when(F.col("duration") >= CEILING, "DURATION AT SEARCH CEILING"),
        F.when(duty > 0.25, F.concat(F.lit("HIGH DUTY CYCLE="), percent(duty), F.lit(" ⚠ likely stellar rotation or EB (transit duration is "), percent(duty, 0), F.lit(" of orbit)")))
        .when(duty > 0.15, F.concat(F.lit("ELEVATED DUTY CYCLE="), percent(duty), F.lit(" — verify transit shape"))),
        F.when(F.abs("dip_centroid") > 0.15, F.format_string("DIP CENTROID OFFSET=%+.3f phase units ⚠ possible non-transit morphology (rotation / EB / artifact)", F.col("dip_centroid"))),
    )
    return df.withColumns({"odd_even_ratio": ratio, "duty_cycle": duty, "flags": flags})


def vetted(df: DataFrame, bins: int = 200) -> DataFrame:
    """One row per target: all vetting measurements and flags. The joins share the target's partitioning."""
    rows = folded(df)
    key = _EPHEMERIS
    parts = phase05_level(rows).join(odd_even_depths(rows), key, "left").join(dip_centroid(rows, bins), key, "left")
    return vetting_flags(parts)


def predicted_transits(df: DataFrame) -> DataFrame:
    """(ephemeris, n, time) of the transits within each target's observed span."""
    span = df.filter("period > 0").groupBy(*_EPHEMERIS).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    first, last = F.ceil((F.col("lo") - F.col("t0")) / F.col("period")), F.floor((F.col("hi") - F.col("t0")) / F.col("period"))
    return span.filter(first <= last).select(*_EPHEMERIS, F.explode(F.sequence(first, last)).alias("n")).withColumn("time", F.col("t0") + F.col("n") * F.col("period"))


def zoom_panel(df: DataFrame, bins: int = 60) -> DataFrame:
    """The binned curve within max(4 durations, 0.08) of phase 0."""
    return binned(df.filter(F.abs("phase") <= F.greatest(4 * F.col("dur_phase"), F.lit(0.08))), bins)


def parity_panels(df: DataFrame, bins: int = 50) -> DataFrame:
    """Binned curves of odd and of even transits (column odd), within min(1.5 zooms, 0.4) of phase 0."""
    near = F.least(1.5 * F.greatest(4 * F.col("dur_phase"), F.lit(0.08)), F.lit(0.4))
    rows = df.filter(F.abs("phase") <= near).withColumn("odd", odd(F.col("transit")))
    side = lambda is_odd: binned(rows.filter(F.col("odd") == is_odd), bins).withColumn("odd", F.lit(is_odd))
    return side(True).unionByName(side(False))


def shape_scores(bins: DataFrame) -> DataFrame:
    """Per target, from its binned curve: v_score, asymmetry, secondary_depth, grazing_ratio, duty_cycle. Two aggregations.

    v_score is the residual of a flat box over that of a V: over 1, the V fits better. Only bins with a level take part.
    """
    c, x, d = F.col("center"), F.col("level"), F.col("duration") / F.col("period")
    inside, half = F.abs(c) <= d / 2, d / 2
    group = Window.partitionBy(*_EPHEMERIS)
    med = lambda cond: F.median(F.when(cond, x)).over(group)
    central = (c >= -0.01) & (c <= 0.01)
    marked = bins.withColumns(
        {
            "box": med(inside),
            "v": F.coalesce(med(central), F.min(x).over(group)),
            "n_in": F.count_if(inside).over(group),
        }
    )
    box_model = F.when(inside, F.col("box")).otherwise(0.0)
    v_model = F.when(inside, F.col("v") * F.greatest(F.lit(0.0), 1 - F.abs(c) / half)).otherwise(0.0)
    before = (c >= -1.5 * d) & (c < -d / 2)
    after = (c > d / 2) & (c <= 1.5 * d)
    right, left = (c >= 0.40) & (c <= 0.50), (c >= -0.50) & (c <= -0.40)
    core, edge = F.abs(c) < 0.20 * d, (F.abs(c) >= 0.30 * d) & (F.abs(c) < 0.55 * d)
    m = lambda cond: F.median(F.when(cond, x))
    n = F.count_if
    found = marked.groupBy(*_EPHEMERIS).agg(
        F.count(F.lit(1)).alias("n"), F.max("n_in").alias("n_in"), F.max("box").alias("box"),
        F.sqrt(F.avg((x - box_model) * (x - box_model))).alias("rms_box"), F.sqrt(F.avg((x - v_model) * (x - v_model))).alias("rms_v"),
        m(before).alias("m_before"), n(before).alias("n_before"), m(after).alias("m_after"), n(after).alias("n_after"),
        F.min(F.when(right, x)).alias("d_right"), n(right).alias("n_right"), F.min(F.when(left, x)).alias("d_left"), n(left).alias("n_left"),
        m(core).alias("m_core"), n(core).alias("n_core"), m(edge).alias("m_edge"), n(edge).alias("n_edge"),
    )
    fitted = (F.col("n") >= 5) & (F.col("n_in") >= 2) & (F.col("n") - F.col("n_in") >= 2) & (F.col("rms_v") > 0)
    sided = (F.col("n_before") >= 2) & (F.col("n_after") >= 2) & (F.abs("box") > 0)
    grazing = (F.col("n_core") >= 2) & (F.col("n_edge") >= 2) & (F.col("m_core") < -0.10)
    return found.select(
        *_EPHEMERIS,
        F.when(fitted, F.col("rms_box") / F.col("rms_v")).alias("v_score"),
        F.when(sided, F.abs(F.col("m_before") - F.col("m_after")) / F.abs("box")).alias("asymmetry"),
        F.least(F.when(F.col("n_right") >= 2, F.col("d_right")), F.when(F.col("n_left") >= 2, F.col("d_left"))).alias("secondary_depth"),
        F.when(grazing, F.least(F.lit(1.5), F.greatest(F.lit(0.0), F.col("m_edge") / F.col("m_core")))).alias("grazing_ratio"),
        (F.col("duration") / F.col("period")).alias("duty_cycle"),
    )


def shape_flags(scores: DataFrame) -> DataFrame:
    """`scores` (with depth_cv, where it was measured) with flags per check, n_flags, is_strong_fp (a hard flag) and flag_summary.

    A high duty cycle isn't flagged where the duration is at the search ceiling.
    """
    cv = F.col("depth_cv") if "depth_cv" in scores.columns else F.lit(None).cast("double")
    no = lambda c: F.coalesce(c, F.lit(False))
    secondary = no(F.col("secondary_depth") < SECONDARY)
    duty = no((F.col("duty_cycle") > DUTY) & (F.col("duration") < CEILING))
    grazing = no(F.col("grazing_ratio") < GRAZING)
    v, asymmetric, uneven = no(F.col("v_score") > V_SCORE), no(F.col("asymmetry") > ASYMMETRY), no(cv > DEPTH_CV)
    number = lambda *flags: sum((f.cast("int") for f in flags), F.lit(0))
    # fixed values: the texts of the flags, those that decide first
    summary = joined_flags(
        F.when(secondary, F.format_string("SECONDARY_DIP=%.3fσ", F.col("secondary_depth"))),
        F.when(duty, F.concat(F.lit("HIGH_DUTY="), percent(F.col("duty_cycle")))),
        F.when(grazing, F.format_string("GRAZING_V_SHAPE(ratio=%.2f)", F.col("grazing_ratio"))),
        F.when(v, F.format_string("V_SCORE=%.2f>1.5 (V-shaped, EB/rotation)", F.col("v_score"))),
        F.when(asymmetric, F.format_string("ASYMM=%.2f", F.col("asymmetry"))),
        F.when(uneven, F.format_string("DEPTH_CV=%.2f", cv)),
    )
    return scores.withColumns(
        {
            "two_dip_flag": secondary, "high_duty_flag": duty, "grazing_flag": grazing, "v_flag": v, "asymm_flag": asymmetric,
            "depth_cv_flag": uneven, "n_flags": number(secondary, duty, grazing, v, asymmetric, uneven),
            "is_strong_fp": secondary | duty | grazing, "flag_summary": summary,
        }
    )


def ephemeris_errors(df: DataFrame) -> DataFrame:
    """(target, error): targets that can't be folded, as period, t0 or duration isn't a finite number, or a length isn't above 0."""
    bad = lambda c: ~F.coalesce(tidy(F.col(c)) > 0, F.lit(False))
    why = F.when(bad("period"), "bad_period").when(tidy(F.col("t0")).isNull(), "bad_t0").when(bad("duration"), "bad_duration")
    return df.groupBy("target").agg(F.min(why).alias("error")).filter("error is not null")


def morphology(df: DataFrame, bins: int = 200, with_depth_cv: bool = False) -> DataFrame:
    """One row per target: shape scores rounded to 4 places, and flags.

    Rows whose ephemeris isn't made of finite numbers (see `ephemeris_errors`) are left out, so their target has no row.
    `with_depth_cv` also measures how the depths of the transits vary, and may flag it.
    """
    for c in ("period", "duration", "t0"):
        df = df.filter(tidy(F.col(c)) > 0 if c != "t0" else tidy(F.col(c)).isNotNull())
    rows = folded(df)
    scores = shape_scores(binned(rows, bins))
    if with_depth_cv:
        scores = scores.join(depth_consistency(rows), _EPHEMERIS, "left")
    scores = shape_flags(scores)
    return scores.withColumns({c: F.round(c, 4) for c in SHAPE_COLUMNS.values() if c in scores.columns and isinstance(scores.schema[c].dataType, DoubleType)})


def morphology_or_default(results: DataFrame, morph: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """`results` with the shape columns of a results table, one target's from `morph`.

    Where nothing could be measured, morph_n_flags is -1, morph_is_strong_fp false, and morph_flags is morph_error:... for a target in
    `errors` (target, error), else morph_unavailable; all other shape columns are null.
    """
    there = morph.columns
    own = [F.col(c).alias(name) if c in there else F.lit(None).cast("double").alias(name) for name, c in SHAPE_COLUMNS.items()]
    found = results.join(morph.select("target", *own), "target", "left")
    why = F.lit("morph_unavailable")
    if errors is not None:
        found = found.join(errors.select("target", F.col("error").alias("_why")), "target", "left")
        why = F.coalesce(F.concat(F.lit("morph_error:"), F.col("_why")), why)
    defaults = {"morph_n_flags": F.lit(-1), "morph_is_strong_fp": F.lit(False), "morph_flags": why}
    return found.withColumns({c: F.coalesce(F.col(c), value) for c, value in defaults.items()}).drop("_why")


def min_abs_phase(folded: DataFrame) -> DataFrame:
    """(target, min_abs_phase): how near the middle of the dip the nearest point of a folded series lies."""
    return folded.groupBy("target").agg(F.min(F.abs("phase")).alias("min_abs_phase"))


def clean_or_flagged(vetted: DataFrame) -> DataFrame:
    """(verdict, n): rows whose flags are "none" (clean) and others (flagged); missing flags count as flagged."""
    clean = F.coalesce(F.col("flags") == "none", F.lit(False))
    return vetted.groupBy(F.when(clean, "clean").otherwise("flagged").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
