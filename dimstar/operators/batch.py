"""Batch analysis of scored candidates: filters, review tiers, counts, histograms, sector and target summaries."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimstar.functions.rules import percent

# Tiers in the order of reports, and the edges of the period histogram (right-closed).
TIERS = ("A", "A*", "B", "C", "D", "bump")
PRIORITY_TIERS = ("A", "A*", "B")
PERIOD_EDGES = (0.0, 0.5, 1.0, 2.0, 5.0, 14.0)
PERIOD_NAMES = ("0-0.5", "0.5-1", "1-2", "2-5", "5-14")


def with_optional(df: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    """`df` with the column `name`, made from the default where it isn't there."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))


def existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The columns of an ordered wish list that are there."""
    return df.select([c for c in wanted if c in df.columns])


def ok_rows(df: DataFrame) -> DataFrame:
    return df.filter("download_status = 'ok'") if "download_status" in df.columns else df


def candidates(df: DataFrame, threshold: float = 0.86) -> DataFrame:
    return ok_rows(df).filter(F.col("score") >= threshold)


def dips(df: DataFrame) -> DataFrame:
    """Rows whose signal is a dip; an unknown polarity isn't one."""
    return df.filter(~F.col("polarity_flipped")) if "polarity_flipped" in df.columns else df


def tier_rule(df: DataFrame) -> DataFrame:
    """`df` with tier and tier_reasons; missing measurements count as 0, a missing polarity as flipped."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    secondary, duty, v, duration = zero("morph_secondary_dip"), zero("morph_duty_cycle"), zero("morph_v_score"), zero("bls_duration")
    flags, n_flags = F.coalesce(F.col("morph_flags"), F.lit("")), F.coalesce(F.col("morph_n_flags"), F.lit(0))
    bump = F.coalesce(F.col("polarity_flipped"), F.lit(True))
    elevated = (duty >= 0.15) & (duty < 0.25)
    # The texts of the reasons. Conditions and texts apart: a query that reads only the tier formats nothing.
    reasons = [
        (secondary < -0.30, F.format_string("secondary dip %.2fσ", secondary)),
        (duty >= 0.25, F.concat(F.lit("high duty cycle "), percent(duty))),
        (v > 1.2, F.format_string("V-shaped fold (v_score=%.2f)", v)),
        (flags.contains("SECONDARY_DIP") & ~(secondary < -0.30), F.lit("secondary dip (morph flag)")),
        (duration >= 0.499, F.lit("duration at search ceiling")),
    ]
    warnings = [
        (elevated, F.concat(F.lit("elevated duty "), percent(duty))),
        ((n_flags == 1) & ~flags.contains("HIGH_DUTY"), F.concat(F.lit("1 morph flag: "), F.substring(flags, 1, 50))),
    ]
    bad = reduce(or_, (met for met, _ in reasons))
    warn = reduce(add, (met.cast("int") for met, _ in warnings))
    tier = (
        F.when(bump, "bump")
        .when(bad, "C")
        .when(warn >= 2, "D")
        .when((warn == 1) & elevated & (duty < 0.20), "A*")
        .when(warn == 1, "B")
        .otherwise("A")
    )
    joined = lambda pairs: F.concat_ws("; ", *(F.when(met, text) for met, text in pairs))
    why = F.when(bump, "polarity=bump (EB/flare)").when(bad, joined(reasons)).when(warn > 0, joined(warnings)).otherwise("clean")
    return df.withColumns({"tier": tier, "tier_reasons": why})


def tier_counts(tiered: DataFrame) -> DataFrame:
    """(place, tier, n) of the tiers that occur, in the order of reports."""
    order = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")).cast("int")
    return tiered.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).select(order.alias("place"), "tier", "n").filter("place > 0")


def period_bin(period: Column) -> Column:
    chain = F
    for lo, hi, name in zip(PERIOD_EDGES, PERIOD_EDGES[1:], PERIOD_NAMES):
        chain = chain.when((period > lo) & (period <= hi), name)
    return chain.otherwise(None)


def period_histogram(df: DataFrame, period: str = "bls_period") -> DataFrame:
    """(bin, n) of all bins, also empty ones; bins are right-closed and values outside are left out. One row per bin: no join."""
    counts = df.agg(*(F.count_if(period_bin(F.col(period)) == name).alias(name) for name in PERIOD_NAMES))
    pairs = F.array(*(F.struct(F.lit(name).alias("bin"), F.col(f"`{name}`").alias("n")) for name in PERIOD_NAMES))
    return counts.select(F.inline(pairs))


def sector_summary(df: DataFrame) -> DataFrame:
    """Per sector: candidates, dips among them, best score."""
    return df.groupBy("sector").agg(
        F.count("score").alias("n_candidates"),
        F.count_if(~F.col("polarity_flipped")).alias("n_dips"),
        F.max("score").alias("best_score"),
    )


def multi_sector(df: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Targets with two or more clean dips whose periods agree; a missing flag count passes, a missing target doesn't.

    The coefficient of variation uses the sample deviation of two or more periods, and is 1 if their mean isn't positive.
    """
    clean = df.filter(~F.col("polarity_flipped") & (F.coalesce(F.col("morph_n_flags"), F.lit(-1)) <= 0) & F.col("target").isNotNull())
    grouped = clean.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_sectors"),
        F.countDistinct("sector").alias("n_distinct_sectors"),
        F.sort_array(F.collect_list("sector")).alias("sectors"),
        F.avg("bls_period").alias("period_mean"),
        F.count("bls_period").alias("n_periods"),
        F.stddev_samp("bls_period").alias("deviation"),
        F.max("score").alias("score_max"),
        F.min("score").alias("score_min"),
        F.max("morph_n_flags").alias("morph_n_flags"),
    )
    spread = F.when(F.col("period_mean") > 0, F.col("deviation") / F.col("period_mean")).otherwise(F.lit(1.0))
    steady = grouped.filter("n_sectors >= 2 and n_periods >= 2").withColumn("period_cv", spread)
    return steady.filter(F.col("period_cv") < tolerance).drop("n_periods", "deviation")


def repeated_targets(df: DataFrame, least: int = 2) -> DataFrame:
    """Rows of targets that have at least `least` rows (HAVING that keeps the rows)."""
    frequent = df.groupBy("target").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("target")
    return df.join(frequent, "target", "left_semi")


def batch_counts(df: DataFrame) -> DataFrame:
    """One row of counts and percentages over the candidates; shares of nothing are 0."""
    share = lambda part, whole: F.round(100.0 * part / F.greatest(whole, F.lit(1)), 4)
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("score") >= 0.86).alias("n_candidates"),
        F.count_if((F.col("score") >= 0.86) & ~F.col("polarity_flipped")).alias("n_dips"),
        F.count_if((F.col("score") >= 0.895) & ~F.col("polarity_flipped")).alias("n_high"),
        F.count_if((F.col("score") >= 0.86) & (F.col("morph_n_flags") == 0)).alias("n_clean"),
        F.count_if((F.col("score") >= 0.86) & (F.col("morph_n_flags") > 0)).alias("n_flagged"),
        F.count_if((F.col("score") >= 0.86) & F.col("morph_is_strong_fp")).alias("n_strong_fp"),
    )
    c = F.col
    return counts.withColumns(
        {
            "pct_candidates": share(c("n_candidates"), c("n_rows")),
            "pct_dips": share(c("n_dips"), c("n_candidates")),
            "pct_clean": share(c("n_clean"), c("n_candidates")),
        }
    )


def priority(tiered: DataFrame, order: list[str], top: int | None = None) -> DataFrame:
    """Rows of the priority tiers, by falling score and then `order`, or the first `top` of them."""
    rows = tiered.filter(F.col("tier").isin(*PRIORITY_TIERS)).orderBy(F.col("score").desc_nulls_last(), *order)
    return rows.limit(top) if top else rows


def frequent_values(df: DataFrame, column: str, top: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(top)


def not_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't among the finished ones. Finished keys are made distinct first; AQE broadcasts them if small."""
    return df.join(done.select(keys).distinct(), keys, "left_anti")


def take_until(attempts: DataFrame, group: str, order: str, ok: str, want: int) -> DataFrame:
    """Rows in order up to the one with the `want`-th success, per group."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    good = F.coalesce(F.sum(F.col(ok).cast("int")).over(before), F.lit(0))
    return attempts.withColumn("good_before", good).filter(F.col("good_before") < want)


def failure_streaks(attempts: DataFrame, group: str, order: str, failed: str) -> DataFrame:
    """`attempts` with streak: how many failures in a row end here (0 on success)."""
    w = Window.partitionBy(group).orderBy(order)
    island = F.sum((~F.col(failed)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy(group, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return attempts.withColumn("island", island).withColumn("streak", F.sum(F.col(failed).cast("int")).over(inside)).drop("island")


def candidate_lines(priority: DataFrame, top: int = 10) -> DataFrame:
    """(line): the first `top` rows by score as records to paste into the list of candidates to vet; missing numbers are 0.

    Equal scores go by target, sector and the numbers of the line.
    """
    first = priority.orderBy(F.col("score").desc_nulls_last(), "target", "sector", "bls_period", "bls_t0", "bls_duration").limit(top)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    tic = F.coalesce(F.regexp_replace(F.col("target"), "TIC ", ""), F.lit(""))
    form = '{"tic": %s, "period": %.4f, "t0": %.4f, "dur": %.4f, "score": %.4f, "sector": %d},'
    sector = F.coalesce(F.col("sector").cast("int"), F.lit(0))
    return first.select(F.format_string(form, tic, number("bls_period"), number("bls_t0"), number("bls_duration"), number("score"), sector).alias("line"))
