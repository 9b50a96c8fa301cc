"""Choice of one candidate period per target from its scored list.

Candidates are rows (target, k, period, power, cnn) and tspan per target; k orders ties. The rules that depend on what was chosen
before fold over the target's candidate array, sorted by score, with the current choice as state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parameters of the rules.
FLOOR, FLOOR_PENALTY = 0.10, 0.40
OVERRIDE, GATE = 0.95, 0.02
GUARD_MIN, GUARD_DROP, GUARD_POWER, GUARD_COMBINED = 0.15, 0.03, 0.25, 0.85
LONG_TIE, LONG_POWER, LONG_MAX, LONG_NEAR, LONG_COMBINED = 0.01, 0.55, 20, 0.05, 0.98
SHORT_MIN, SHORT_TIE, SHORT_POWER, SHORT_MAX, SHORT_NEAR = 0.08, 0.03, 0.25, 20, 0.03
TRANSITS = 3


def objective(df: DataFrame) -> DataFrame:
    """`df` with penalty, hybrid (a diagnostic) and combined (what is maximised)."""
    whole = Window.partitionBy("target")
    clip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cnn")))
    log_power = F.log1p(F.greatest(F.col("power"), F.lit(0.0)))
    top = F.max(log_power).over(whole)
    share = F.when(top > 1e-9, log_power / top).otherwise(1.0)
    penalty = F.when(F.col("period") < FLOOR, FLOOR_PENALTY).otherwise(1.0)
    eps = 1e-9
    return df.withColumns(
        {
            "penalty": penalty,
            "hybrid": (0.7 * clip + 0.3 * share) * penalty,
            "combined": F.pow(clip + eps, F.lit(2.0)) * F.pow(log_power + eps, F.lit(0.10)) * penalty,
        }
    )


def _first_max(items: Column, value) -> Column:
    """The item of the largest value; of equal ones the first by k."""
    best = F.array_max(F.transform(items, lambda x: F.struct(value(x).alias("value"), (-x["k"]).alias("first"), x.alias("item"))))
    return best["item"]


def _ratio_ok(ratio: Column, most: int, near: float) -> Column:
    k = F.rint(ratio)
    return (k >= 2) & (k <= most) & (F.abs(ratio - k) < near)


def select_candidates(df: DataFrame) -> DataFrame:
    """(target, k, period, cnn, power, combined, mode, top5): the choice per target and the rules that made it.

    The list of one target has some tens of entries (24 after the search).
    """
    fields = ["k", "period", "power", "cnn", "penalty", "hybrid", "combined"]
    entry = F.struct((-F.col("cnn")).alias("minus"), *fields)
    rows = objective(df).groupBy("target").agg(F.sort_array(F.collect_list(entry)).alias("all"), F.max("tspan").alias("tspan"))
    rows = rows.withColumn("high", F.filter("all", lambda x: x["cnn"] >= OVERRIDE))
    gate = F.array_max(F.transform("all", lambda x: x["cnn"] * x["penalty"]))
    rows = rows.withColumn("gate", gate).withColumn("gated", F.filter("all", lambda x: x["cnn"] * x["penalty"] >= F.col("gate") - GATE))
    by_cnn, by_combined = (lambda x: x["cnn"]), (lambda x: x["combined"])
    start = F.when(F.size("high") > 0, _first_max(F.col("high"), by_cnn)).otherwise(_first_max(F.col("gated"), by_combined))
    rows = rows.withColumn("pick", start).withColumn("mode", F.when(F.size("high") > 0, "high_cnn_override").otherwise("cnn_qualified_combined"))

    def replace(rows: DataFrame, new: Column, suffix: str) -> DataFrame:
        changed = rows.withColumn("new", new)
        is_new = F.col("new").isNotNull() & (F.col("new")["k"] != F.col("pick")["k"])
        mode = F.when(is_new, F.concat(F.col("mode"), F.lit(suffix))).otherwise(F.col("mode"))
        return changed.withColumns({"mode": mode, "pick": F.when(is_new, F.col("new")).otherwise(F.col("pick"))}).drop("new")

    p = F.col("pick")
    tiny = F.lit(1e-12)
    longer = F.filter(
        "all",
        lambda x: (x["period"] >= GUARD_MIN) & (x["cnn"] >= p["cnn"] - GUARD_DROP)
        & (x["power"] >= GUARD_POWER * F.greatest(p["power"], tiny)) & (x["combined"] >= GUARD_COMBINED * F.greatest(p["combined"], tiny)),
    )
    rows = replace(rows, F.when((p["period"] < FLOOR) & (F.size(longer) > 0), _first_max(longer, by_combined)), "+floor_guard")

    def promote(state: Column, x: Column) -> Column:
        now = state["now"]
        later = x["period"] > now["period"]
        stop = state["stopped"] | (later & (x["cnn"] < now["cnn"] - LONG_TIE))
        observable = F.when(F.col("tspan") > 0, x["period"] <= F.col("tspan") / TRANSITS).otherwise(True)
        fits = later & observable & (x["power"] >= LONG_POWER * F.greatest(now["power"], tiny))
        fits = fits & _ratio_ok(x["period"] / F.greatest(now["period"], tiny), LONG_MAX, LONG_NEAR) & (x["combined"] >= LONG_COMBINED * now["combined"])
        return F.struct(F.when(~stop & F.coalesce(fits, F.lit(False)), x).otherwise(now).alias("now"), stop.alias("stopped"))

    state = F.struct(p.alias("now"), F.lit(False).alias("stopped"))
    rows = replace(rows, F.aggregate("all", state, promote)["now"], "+alias_promote_longer")

    def step_down(now: Column, x: Column) -> Column:
        fits = (
            (x["period"] < now["period"]) & (x["period"] >= SHORT_MIN) & (x["cnn"] >= now["cnn"] - SHORT_TIE)
            & (x["power"] >= SHORT_POWER * F.greatest(now["power"], tiny))
            & _ratio_ok(now["period"] / F.greatest(x["period"], tiny), SHORT_MAX, SHORT_NEAR)
        )
        return F.when(F.coalesce(fits, F.lit(False)), x).otherwise(now)

    rows = replace(rows, F.aggregate("all", p, step_down), "+short_alias_guard")
    ceiling = F.when(F.col("tspan") > 0, F.col("tspan") / TRANSITS)
    within = F.filter("all", lambda x: x["period"] <= F.col("tspan") / TRANSITS)
    back = F.when((p["period"] > ceiling) & (F.size(within) > 0), _first_max(within, by_combined))
    rows = replace(rows, back, "+transit_ceil_guard")
    top5 = F.slice(F.sort_array(F.transform("all", lambda x: F.struct(x["hybrid"].alias("hybrid"), (-x["k"]).alias("minus_k"), x["period"].alias("period"), x["cnn"].alias("cnn"))), False), 1, 5)
    return rows.select("target", "pick.k", "pick.period", "pick.cnn", "pick.power", "pick.combined", "mode", top5.alias("top5"))


def polarity(df: DataFrame) -> DataFrame:
    """`df` with score_used (the larger of dip and bump) and polarity_flipped (the bump's is larger)."""
    flipped = F.col("score_bump") > F.col("score_dip")
    return df.withColumns({"polarity_flipped": flipped, "score_used": F.when(flipped, F.col("score_bump")).otherwise(F.col("score_dip"))})


def deep_enough(df: DataFrame, least: float = 0.5) -> DataFrame:
    return df.filter(F.abs("depth") >= least)
