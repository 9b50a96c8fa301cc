"""Evaluation of scores against labels, and against known answers. Rows are (y, score): y is 0 or 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimstar.functions.rules import harmonic_match, score_label, seeded_uniform
from dimstar.operators.order_stats import exact_percentiles

_TINY = 1e-12


def _rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision, recall = tp / (tp + fp + _TINY), tp / (tp + fn + _TINY)
    return precision, recall, 2 * precision * recall / (precision + recall + _TINY)


def confusion_at(df: DataFrame, threshold: float | Column) -> DataFrame:
    """One row: tn, fp, fn, tp, precision, recall, f1 for predictions from `threshold` on."""
    hit, pos = F.col("score") >= threshold, F.col("y") == 1
    n = df.agg(F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))
    p, r, f = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.withColumns({"precision": p, "recall": r, "f1": f})


def score_curve(df: DataFrame) -> DataFrame:
    """(score, tp, fp, n_pos, n_neg): one row per distinct score, counts of rows that reach it.

    Rows are added up per score first. The running sums are made per range of scores and moved by the totals of the ranges above, so
    that no task has to hold all scores.
    """
    by_score = df.filter("score is not null and y is not null").groupBy("score").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    parts = by_score.withColumn("part", F.floor(F.col("score") * 256))
    totals = parts.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("q").alias("qq"))  # at most 257 rows for scores of 0 to 1
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    totals = totals.select(
        "part", F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("p_above"), F.coalesce(F.sum("qq").over(above), F.lit(0)).alias("q_above"),
        F.sum("pp").over(whole).alias("n_pos"), F.sum("qq").over(whole).alias("n_neg"),
    )
    down = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("q").over(down)}).join(totals, "part")
    return rows.select("score", (F.col("tp") + F.col("p_above")).alias("tp"), (F.col("fp") + F.col("q_above")).alias("fp"), "n_pos", "n_neg")


def best_f1(curve: DataFrame) -> DataFrame:
    """One row: the threshold with the largest F1 (of equal ones the lowest), and that F1."""
    _, _, f1 = _rates(F.col("tp"), F.col("fp"), F.col("n_pos") - F.col("tp"))
    rated = curve.withColumn("f1", f1)
    return rated.agg(F.max_by("score", F.struct(F.round("f1", 12), -F.col("score"))).alias("threshold"), F.max("f1").alias("f1"))


def best_youden(curve: DataFrame) -> DataFrame:
    """One row: the threshold with the largest true minus false positive rate (of equal ones the highest), and that difference."""
    j = F.col("tp") / F.greatest("n_pos", F.lit(1)) - F.col("fp") / F.greatest("n_neg", F.lit(1))
    rated = curve.withColumn("j", j)
    return rated.agg(F.max_by("score", F.struct(F.round("j", 12), F.col("score"))).alias("threshold"), F.max("j").alias("j"))


def precision_threshold(curve: DataFrame, wanted: float = 0.90, fallback: float = 0.95) -> DataFrame:
    """One row: the threshold with the largest recall among those of the wanted precision (of equal ones the lowest)."""
    p, r, _ = _rates(F.col("tp"), F.col("fp"), F.col("n_pos") - F.col("tp"))
    good = curve.withColumns({"p": p, "r": r}).filter(F.col("p") >= wanted)
    return good.agg(F.coalesce(F.max_by("score", F.struct(F.round("r", 12), -F.col("score"))), F.lit(fallback)).alias("threshold"))


def roc_auc(curve: DataFrame) -> DataFrame:
    """One row: area under the ROC curve, by trapezoids between neighbouring scores."""
    # each distinct score adds its negatives times the positives above it and half of its own: no order over all scores is needed
    part = curve.select("score", "tp", "fp", "n_pos", "n_neg", F.floor(F.col("score") * 256).alias("part"))
    w = Window.partitionBy("part").orderBy(F.desc("score"))
    ends = part.groupBy("part").agg(F.max("tp").alias("tp_end"), F.max("fp").alias("fp_end"))
    above = Window.orderBy(F.desc("part"))
    ends = ends.select("part", F.lag("tp_end", 1, 0).over(above).alias("tp_in"), F.lag("fp_end", 1, 0).over(above).alias("fp_in"))
    rows = part.join(ends, "part").withColumns({"tp0": F.coalesce(F.lag("tp").over(w), "tp_in"), "fp0": F.coalesce(F.lag("fp").over(w), "fp_in")})
    area = F.sum((F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")) / 2.0)
    return rows.agg((area / F.greatest(F.max(F.col("n_pos") * F.col("n_neg")), F.lit(1))).alias("auc"))


def threshold_report(df: DataFrame, wanted: float = 0.90) -> DataFrame:
    """(name, threshold, tn, fp, fn, tp, precision, recall, f1) at four thresholds: best F1, best Youden J, wanted precision, 0.5."""
    curve = score_curve(df)
    chosen = [best_f1(curve).select("threshold"), best_youden(curve).select("threshold"), precision_threshold(curve, wanted).select("threshold")]
    names = ["best_f1", "best_youden_j", f"precision_ge_{wanted:.2f}"]
    points = df.sparkSession.createDataFrame([("default_0.5", 0.5)], "name string, threshold double")
    for name, row in zip(names, chosen):
        points = points.unionByName(row.select(F.lit(name).alias("name"), "threshold"))
    hit, pos = F.col("score") >= F.col("threshold"), F.col("y") == 1
    counts = df.crossJoin(F.broadcast(points)).groupBy("name", "threshold").agg(  # four rows
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp")
    )
    p, r, f = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f})


def class_weights(df: DataFrame) -> DataFrame:
    """(y, n, weight): weights n_all / (2 * n)."""
    counts = df.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("y", "n", (F.sum("n").over(Window.partitionBy()) / (2.0 * F.col("n"))).alias("weight"))


def classification_report(df: DataFrame, threshold: float) -> DataFrame:
    """(y, precision, recall, f1, support) of both classes; see `report_averages` for the lines below them."""
    predicted = (F.col("score") >= threshold).cast("int")
    n = df.withColumn("h", predicted).agg(*(F.count_if((F.col("h") == h) & (F.col("y") == y)).alias(f"h{h}y{y}") for h in (0, 1) for y in (0, 1)))
    rows = F.array(*(F.struct(F.lit(y).alias("y"), F.col(f"h{y}y{y}").alias("tp"), F.col(f"h{y}y{1 - y}").alias("fp"), F.col(f"h{1 - y}y{y}").alias("fn")) for y in (0, 1)))
    p, r, f = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.select(F.inline(rows)).select("y", p.alias("precision"), r.alias("recall"), f.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def report_averages(df: DataFrame, threshold: float) -> DataFrame:
    """(name, precision, recall, f1, support): accuracy (in all three), the mean of both classes, and the mean weighted by their sizes."""
    classes = classification_report(df, threshold)
    whole = classes.agg(
        F.sum("support").alias("support"), F.sum(F.col("recall") * F.col("support")).alias("right"),
        *(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), *(F.sum(F.col(c) * F.col("support")).alias(f"sum_{c}") for c in ("precision", "recall", "f1")),
    )
    n = F.greatest("support", F.lit(1))
    line = lambda name, *values: F.struct(F.lit(name).alias("name"), *(x.alias(c) for x, c in zip(values, ("precision", "recall", "f1"))), F.col("support").alias("support"))
    accuracy = F.col("right") / n
    rows = F.array(
        line("accuracy", accuracy, accuracy, accuracy), line("macro avg", *(F.col(f"macro_{c}") for c in ("precision", "recall", "f1"))),
        line("weighted avg", *(F.col(f"sum_{c}") / n for c in ("precision", "recall", "f1"))),
    )
    return whole.select(F.inline(rows))


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(score_label(F.col("score")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def focal_loss(df: DataFrame, gamma: float = 2.0, alpha: float = 0.25) -> DataFrame:
    """One row: the mean focal loss, a metric."""
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("score")))
    right = F.when(F.col("y") == 1, p).otherwise(1 - p)
    weight = F.when(F.col("y") == 1, alpha).otherwise(1 - alpha)
    return df.agg(F.avg(-weight * F.pow(1 - right, F.lit(gamma)) * F.ln(right)).alias("focal_loss"))


def stratified_split(df: DataFrame, key: str, label: str, seed: int = 42, test: float = 0.20, validation: float = 0.16) -> DataFrame:
    """`df` with part: test, validation or train, in the same shares of each label.

    Rows are placed by a number that depends on key and seed alone; exact shares come from its rank within (label, slice of the
    number), so a label with most rows is ranked in many tasks, and shares are exact to one row per slice.
    """
    u = seeded_uniform(seed, key)
    rows = df.withColumn("u", u).withColumn("slice", F.floor(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"slice{seed}"), F.col(key).cast("string"))), 1, 4), 16, 10).cast("int") / 4096))
    w = Window.partitionBy(label, "slice")
    place = (F.row_number().over(w.orderBy("u", key)) - 0.5) / F.count(F.lit(1)).over(w)
    rows = rows.withColumn("place", place)
    part = F.when(F.col("place") < test, "test").when(F.col("place") < test + validation, "validation").otherwise("train")
    return rows.withColumn("part", part).drop("u", "slice", "place")


# Known answers


def known_answers(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per target with a true period: does the choice match (best), does any candidate (any, the first by k), and the matching
    candidate with the highest score (oracle), with an audit of promoting it.

    candidates: (target, k, period, power, score, chosen); catalog: (target, p_true), one row per target.
    """
    rows = candidates.join(catalog, "target").withColumn("m", harmonic_match(F.col("period"), F.col("p_true")))
    # a candidate's fields together, with k first so that aggregates order by it
    one = F.struct("k", "period", "power", "score", F.col("m.matched").alias("matched"), F.col("m.k").alias("harmonic"), F.col("m.kind").alias("kind"), F.col("m.rel_err").alias("rel_err"))
    hit = F.col("m.matched")
    found = rows.groupBy("target", "p_true").agg(
        F.min(F.when(F.col("chosen"), one)).alias("best"),
        F.min(F.when(hit, one)).alias("any"),
        F.max_by(F.when(hit, one), F.when(hit & F.col("score").isNotNull(), F.struct("score", -F.col("k")))).alias("oracle"),
    )
    b, a, o = F.col("best"), F.col("any"), F.col("oracle")
    longer = (o["period"] > b["period"]) & (o["period"] >= 0.60)
    strong = F.coalesce(o["score"] >= b["score"] - 0.04, F.lit(True)) & F.coalesce(o["power"] >= 0.30 * F.greatest(b["power"], F.lit(1e-12)), F.lit(True))
    reason = (
        F.when(o.isNull(), "no_match_in_topk")
        .when(b["period"].isNull() | o["period"].isNull(), "nan_periods")
        .when(~longer, "match_not_long_or_below_min_period")
        .when(strong, "long_alias_plausible")
        .otherwise("long_alias_but_weak")
    )
    return found.select(
        "target", "p_true",
        F.coalesce(b["matched"], F.lit(False)).alias("match_best"), b["period"].alias("p_best"), b["harmonic"].alias("best_k"), b["kind"].alias("best_kind"), b["rel_err"].alias("best_rel_err"), b["score"].alias("score"),
        a.isNotNull().alias("match_any"), a["k"].alias("match_rank"), a["period"].alias("p_any"), a["kind"].alias("any_kind"),
        o.isNotNull().alias("match_oracle"), o["k"].alias("oracle_rank"), o["period"].alias("p_oracle"), o["kind"].alias("oracle_kind"),
        reason.alias("promote_reason"), (reason == "long_alias_plausible").alias("promoted"),
    )


def known_answer_summary(answers: DataFrame, threshold: float = 0.86) -> DataFrame:
    """One row: detection rate, shares of matches among detections, percentiles of scores, promotions.

    Rows without a score, or with a `status` other than ok, where there is one, don't count. Percentiles are exact, and no task holds all
    scores.
    """
    detected = F.col("score") >= threshold
    share = lambda c: F.avg(F.when(detected, F.col(c).cast("int")))
    scored = answers.filter("score is not null")
    if "status" in answers.columns:
        scored = scored.filter("status = 'ok'")
    found = scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(detected).alias("n_detected"), F.avg(detected.cast("int")).alias("detection_rate"),
        share("match_best").alias("best_rate"), share("match_any").alias("any_rate"), share("match_oracle").alias("oracle_rate"),
        F.count_if(F.col("promoted")).alias("n_promoted"),
    )
    levels = exact_percentiles(scored, "score", [0.05, 0.5, 0.95]).select(F.col("p0").alias("p05"), F.col("p1").alias("p50"), F.col("p2").alias("p95"))
    return found.join(levels, F.lit(True), "left")  # one row each
