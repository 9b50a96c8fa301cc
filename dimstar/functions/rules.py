"""Row-level rules as column expressions: labels, phases, period matching, identifiers, formatting.

Missing values are NULL throughout: `tidy` turns NaN and infinities into NULL where data come in, so that no comparison with a
missing value is ever true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score thresholds and their labels, highest first.
LABELS = ((0.895, "high_confidence_planet"), (0.88, "likely_planet"), (0.86, "candidate"))
FLAG_SEPARATOR = " | "


def tidy(c: Column) -> Column:
    """NULL for NaN and infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def score_label(score: Column, labels=LABELS) -> Column:
    """The first label whose threshold the score reaches, else reject; a missing score is rejected."""
    chain = F
    for threshold, name in labels:
        chain = chain.when(score >= threshold, name)
    return chain.otherwise("reject")


def failure_label(status: Column, score: Column) -> Column:
    """Label of a result row: fetch failures and scoring failures have labels of their own."""
    return F.when(status != "ok", "download_fail").when(score.isNull(), "score_fail").otherwise(score_label(score))


def floor_mod(x: Column, p: Column) -> Column:
    """x modulo p with the sign of p; NULL for p = 0."""
    return x - p * F.floor(F.try_divide(x, p))


def phase(t: Column, period: Column, t0: Column) -> Column:
    """Phase in [-0.5, 0.5), 0 at t0; NULL without a positive period."""
    return F.when(period > 0, floor_mod(t - t0 + period / 2, period) / period - 0.5)


def transit_number(t: Column, period: Column, t0: Column) -> Column:
    return F.floor((t - t0) / period + 0.5).cast("long")


def odd(n: Column) -> Column:
    """Parity by the floored modulus, so that -1 is odd."""
    return F.pmod(n, F.lit(2)) == 1


def duty_cycle(duration: Column, period: Column) -> Column:
    return F.try_divide(duration, period)


def ensure_odd(k: int) -> int:
    """k, or the next odd number."""
    return k | 1


def relative_error(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-12))


def harmonic_match(predicted: Column, true: Column, tolerance: float = 0.02, most: int = 6) -> Column:
    """struct(matched, k, kind, rel_err): the multiple k or divisor 1/k of the true period nearest to the predicted one.

    Of equal errors the smaller k counts, and the multiple before the divisor. Outside the tolerance k and kind are NULL; without
    two positive periods all is NULL but matched, which is false.
    """
    good = (predicted > 0) & (true > 0)
    options = []
    for k in range(1, most + 1):
        for place, (kind, target) in enumerate((("multiple", true * k), ("divisor", true / k))):
            name = "fundamental" if k == 1 else kind
            options.append(F.struct(relative_error(predicted, target).alias("err"), F.lit(k).alias("k"), F.lit(place).alias("place"), F.lit(name).alias("kind")))
    best = F.array_min(F.array(*options))
    fits = F.coalesce(good & (best["err"] <= tolerance), F.lit(False))
    return F.struct(
        fits.alias("matched"),
        F.when(fits, best["k"]).alias("k"),
        F.when(fits, best["kind"]).alias("kind"),
        F.when(good, best["err"]).alias("rel_err"),
    )


def normalize_target(name: Column) -> Column:
    """Trimmed; a leading TOI- becomes TOI and a space, in any case."""
    return F.regexp_replace(F.trim(name), "(?i)^TOI-", "TOI ")


def target_name(number: Column) -> Column:
    return F.concat(F.lit("TIC "), number.cast("string"))


def target_number(name: Column) -> Column:
    """The number of a target name, NULL if there is none."""
    return F.regexp_replace(F.trim(name), "(?i)^TIC\\s*", "").try_cast("bigint")


def simple_id(text: Column) -> Column:
    """A number after TIC, else a text that is all digits."""
    after = F.regexp_extract(text, r"(?i)TIC\s*(\d+)", 1)
    return F.coalesce(F.when(after != "", after.try_cast("bigint")), F.when(text.rlike(r"^\s*\d+\s*$"), F.trim(text).try_cast("bigint")))


def cascade_id(text: Column) -> Column:
    """5 to 12 digits after TIC and non-word characters; else the longest run of 9 to 16 digits, else any of 7 to 12, within
    100,000 to 2,000,000,000."""
    in_range = lambda n: (n >= 100_000) & (n <= 2_000_000_000)
    tagged = F.regexp_extract(text, r"(?i)TIC\W*(\d{5,12})", 1)
    runs = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    numbers = lambda lo, hi: F.filter(runs, lambda r: (F.length(r) >= lo) & (F.length(r) <= hi) & in_range(r.try_cast("bigint")))
    longest = F.array_max(F.transform(numbers(9, 16), lambda r: F.struct(F.length(r).alias("l"), r.try_cast("bigint").alias("n"))))
    return F.coalesce(F.when(tagged != "", tagged.try_cast("bigint")), longest["n"], F.get(numbers(7, 12), F.lit(0)).try_cast("bigint"))


def percent(fraction: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", fraction * 100)


def joined_flags(*flags: Column) -> Column:
    """The flags that aren't NULL, joined; "none" if all are."""
    kept = F.filter(F.array(*flags), lambda f: f.isNotNull())
    return F.when(F.size(kept) == 0, "none").otherwise(F.array_join(kept, FLAG_SEPARATOR))


def seeded_uniform(seed: int, *keys) -> Column:
    """A uniform number in [0, 1) that depends on the keys and the seed alone; the same in every run and partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
