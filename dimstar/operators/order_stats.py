"""Exact percentiles of large groups: no task holds all values of one.

Equal values are counted first. The counts are dealt to ranges of values; the sizes of the ranges, added up in order, tell which range
holds a percentile's place, and only those ranges are read again to find it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dimstar.functions.runtime import materialize


def exact_percentiles(df: DataFrame, value: str, shares: list[float], by: str | None = None) -> DataFrame:
    """(by, n, p0, p1, ...): the number of values and, for each of `shares`, the percentile between neighbouring values, linearly.

    One row per group, or one row without `by` (none if there are no values). Nulls are left out, NaN is the largest value; null is a
    group of its own.
    """
    keys = [by] if by else []
    counted = df.select(*keys, F.col(value).cast("double").alias("value")).filter("value is not null").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("rows"))
    ranged = materialize(counted.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id()), "value-ranges")
    sizes = ranged.groupBy(*keys, "part").agg(F.sum("rows").alias("inside"))  # a row for each range of a group
    group = Window.partitionBy(*keys)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("inside").over(before), F.lit(0)), "n": F.sum("inside").over(group)})
    place = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    holds = F.lit(False)
    for p in place:
        holds = holds | ((F.col("before") <= F.ceil(p)) & (F.floor(p) < F.col("before") + F.col("inside")))
    wanted = sizes.filter(holds).select(*(F.col(k).alias(f"own_{k}") for k in keys), F.col("part").alias("own_part"), "before", "n")
    same = F.col("part") == F.col("own_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"own_{k}"))
    up_to = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.join(wanted, same).withColumn("end", F.col("before") + F.sum("rows").over(up_to)).withColumn("begin", F.col("end") - F.col("rows"))
    at = lambda i: F.max(F.when((F.col("begin") <= i) & (i < F.col("end")), F.col("value")))
    ends = [c for i, p in enumerate(place) for c in (at(F.floor(p)).alias(f"lo{i}"), at(F.ceil(p)).alias(f"hi{i}"))]
    found = rows.groupBy(*keys).agg(F.max("n").alias("n"), *ends)

    def between(i: int):
        p = F.lit(float(shares[i])) * (F.col("n") - 1)
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        return F.when(F.floor(p) == F.ceil(p), lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi).alias(f"p{i}")

    found = found.select(*keys, "n", *(between(i) for i in range(len(shares))))
    return found if by else found.filter("n is not null")
