"""The engine's relations on the driver's tables, once for Spark and once as SQL text for the oracle.

Series come from `events` (a target is an event type with a quarter of the users, or a user), scored candidates from `lineitem`,
true periods from `supplier`, the planet catalog from `part`, windows and labels from `embeddings`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DAYS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 86400000000.0D"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, t, f) of the dense series."""
    return series_of(table(spark, sf_dir, "events"))


def series_of(events: DataFrame) -> DataFrame:
    return events.selectExpr("concat(event_type, '-', user_id % 4) AS target", f"{_DAYS} AS t", "value AS f")


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, t, f) of the sparse series."""
    return table(spark, sf_dir, "events").selectExpr("concat('user-', user_id) AS target", f"{_DAYS} AS t", "value AS f")


def with_ephemeris(df: DataFrame) -> DataFrame:
    """A period, t0 and duration for each dense target, by the last digit of its name."""
    k = F.substring_index("target", "-", -1).cast("double")
    period = 2.0 + 0.75 * k
    return df.withColumns({"period": period, "t0": F.lit(0.3), "duration": 0.1 * period + 0.05 * k})


SERIES = """
    SELECT event_type || '-' || (user_id % 4) AS target, (epoch_us(ts) - 1704067200000000) / 86400000000.0::DOUBLE AS t, value AS f
    FROM events"""
USER_SERIES = """
    SELECT 'user-' || user_id AS target, (epoch_us(ts) - 1704067200000000) / 86400000000.0::DOUBLE AS t, value AS f FROM events"""
EPHEMERIS = f"""
    SELECT target, t, f, 2.0::DOUBLE + 0.75::DOUBLE * k AS period, 0.3::DOUBLE AS t0,
           0.1::DOUBLE * (2.0::DOUBLE + 0.75::DOUBLE * k) + 0.05::DOUBLE * k AS duration
    FROM (SELECT *, split_part(target, '-', 2)::DOUBLE AS k FROM ({SERIES}))"""
FOLDED = f"""
    SELECT *, duration / period AS dur_phase,
           (x - period * floor(x / period)) / period - 0.5::DOUBLE AS phase,
           floor((t - t0) / period + 0.5::DOUBLE)::BIGINT AS transit
    FROM (SELECT *, t - t0 + period / 2 AS x FROM ({EPHEMERIS}))"""


def binned_sql(bins: int, source: str = FOLDED) -> str:
    return f"""
    SELECT target, period, t0, duration, bin, -0.5::DOUBLE + (bin + 0.5::DOUBLE) * (1.0::DOUBLE / {bins}) AS center, level, n
    FROM (SELECT target, period, t0, duration, floor((phase + 0.5::DOUBLE) / (1.0::DOUBLE / {bins}))::INTEGER AS bin, median(f) AS level, count(*) AS n
          FROM ({source}) GROUP BY ALL) WHERE n >= 2 AND bin BETWEEN 0 AND {bins - 1}"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with shape measurements."""
    period = "CASE WHEN l_suppkey % 5 = 0 THEN (1 + l_suppkey % 7) * (1.0D + 0.0002D * l_linenumber) ELSE l_quantity / 4 END"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        "concat('TIC ', l_suppkey) AS target", "l_linenumber AS sector", "0.8D + l_discount AS score",
        "l_returnflag = 'R' AS polarity_flipped", f"{period} AS bls_period", f"l_tax * 4 * ({period}) AS bls_duration",
        "l_tax * 4 AS morph_duty_cycle", "-l_discount * 4 AS morph_secondary_dip", "0.9D + l_tax * 5 AS morph_v_score",
        "l_linenumber % 3 AS morph_n_flags", "l_linenumber % 3 = 2 AS morph_is_strong_fp",
        "CASE WHEN l_linenumber % 5 = 0 THEN 'SECONDARY_DIP' WHEN l_linenumber % 3 = 1 THEN 'HIGH_DUTY' ELSE 'none' END AS morph_flags",
        "CASE WHEN l_linestatus = 'F' THEN 'ok' ELSE 'too_short' END AS download_status",
    )


SCORED = """
    SELECT l_orderkey, l_linenumber, l_partkey, 'TIC ' || l_suppkey AS target, l_linenumber AS sector, 0.8::DOUBLE + l_discount AS score,
           l_returnflag = 'R' AS polarity_flipped, p AS bls_period, l_tax * 4 * p AS bls_duration, l_tax * 4 AS morph_duty_cycle,
           -l_discount * 4 AS morph_secondary_dip, 0.9::DOUBLE + l_tax * 5 AS morph_v_score, l_linenumber % 3 AS morph_n_flags,
           l_linenumber % 3 = 2 AS morph_is_strong_fp,
           CASE WHEN l_linenumber % 5 = 0 THEN 'SECONDARY_DIP' WHEN l_linenumber % 3 = 1 THEN 'HIGH_DUTY' ELSE 'none' END AS morph_flags,
           CASE WHEN l_linestatus = 'F' THEN 'ok' ELSE 'too_short' END AS download_status
    FROM (SELECT *, CASE WHEN l_suppkey % 5 = 0 THEN (1 + l_suppkey % 7) * (1.0::DOUBLE + 0.0002::DOUBLE * l_linenumber)
                         ELSE l_quantity / 4 END AS p FROM lineitem)"""

TIERED = f"""
    SELECT *,
        CASE WHEN bump THEN 'bump' WHEN len(reasons) > 0 THEN 'C' WHEN len(warns) >= 2 THEN 'D'
             WHEN len(warns) = 1 AND elevated AND duty < 0.20::DOUBLE THEN 'A*' WHEN len(warns) = 1 THEN 'B' ELSE 'A' END AS tier,
        CASE WHEN bump THEN 'polarity=bump (EB/flare)' WHEN len(reasons) > 0 THEN array_to_string(reasons, '; ')
             WHEN len(warns) > 0 THEN array_to_string(warns, '; ') ELSE 'clean' END AS tier_reasons
    FROM (SELECT *,
            list_filter([CASE WHEN sec < -0.30::DOUBLE THEN printf('secondary dip %.2fσ', sec) END,
                         CASE WHEN duty >= 0.25::DOUBLE THEN 'high duty cycle ' || printf('%.1f%%', duty * 100) END,
                         CASE WHEN v > 1.2::DOUBLE THEN printf('V-shaped fold (v_score=%.2f)', v) END,
                         CASE WHEN contains(flags, 'SECONDARY_DIP') AND NOT sec < -0.30::DOUBLE THEN 'secondary dip (morph flag)' END,
                         CASE WHEN dur >= 0.499::DOUBLE THEN 'duration at search ceiling' END], lambda x: x IS NOT NULL) AS reasons,
            list_filter([CASE WHEN elevated THEN 'elevated duty ' || printf('%.1f%%', duty * 100) END,
                         CASE WHEN n = 1 AND NOT contains(flags, 'HIGH_DUTY') THEN '1 morph flag: ' || flags[1:50] END], lambda x: x IS NOT NULL) AS warns
          FROM (SELECT *, coalesce(morph_secondary_dip, 0) AS sec, coalesce(morph_duty_cycle, 0) AS duty, coalesce(morph_v_score, 0) AS v,
                       coalesce(bls_duration, 0) AS dur, coalesce(morph_flags, '') AS flags, coalesce(morph_n_flags, 0) AS n,
                       coalesce(polarity_flipped, true) AS bump,
                       coalesce(morph_duty_cycle, 0) >= 0.15::DOUBLE AND coalesce(morph_duty_cycle, 0) < 0.25::DOUBLE AS elevated
                FROM ({SCORED})))"""

#: Candidates per target, as after a search.
TOP = 24


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, k, period, power, cnn, tspan): all rows of each supplier, k counting from the strongest."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w))
    return rows.selectExpr("l_suppkey", "concat('TIC ', l_suppkey) AS target", "k", "l_quantity / 4 AS period", "l_extendedprice / 1000 AS power", "0.86D + l_discount AS cnn", "27.4D AS tspan")


def candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The TOP strongest candidate_rows of each supplier, for queries on finished lists."""
    return candidate_rows(spark, sf_dir).filter(F.col("k") <= TOP)


CANDIDATE_LISTS = f"""
    SELECT l_suppkey, 'TIC ' || l_suppkey AS target, k::INTEGER AS k, l_quantity / 4 AS period, l_extendedprice / 1000 AS power,
           0.86::DOUBLE + l_discount AS cnn, 27.4::DOUBLE AS tspan
    FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS k
          FROM lineitem) WHERE k <= {TOP}"""
CANDIDATE_ROWS = CANDIDATE_LISTS.removesuffix(f" WHERE k <= {TOP}")


def true_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("concat('TIC ', s_suppkey) AS target", "1.0D + (s_suppkey % 11) * 0.9D AS p_true")


TRUE_PERIODS = "SELECT 'TIC ' || s_suppkey AS target, 1.0::DOUBLE + (s_suppkey % 11) * 0.9::DOUBLE AS p_true FROM supplier"


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, score): windows with a binary label and a score from their first value, rounded so that scores tie."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "int(label < 5) AS y", "round(1 / (1 + exp(-10 * double(embedding[0]) - (CASE WHEN label < 5 THEN 1 ELSE 0 END))), 3) AS score")


LABELLED_SCORES = """
    SELECT vec_id AS id, (label < 5)::INTEGER AS y,
           round(1 / (1 + exp(-10 * embedding[1]::DOUBLE - (CASE WHEN label < 5 THEN 1 ELSE 0 END))), 3) AS score FROM embeddings"""


def uniform_sql(seed: str, *keys: str) -> str:
    """SQL of functions.rules.seeded_uniform."""
    text = " || '|' || ".join([f"'{seed}'", *(f"({k})::VARCHAR" for k in keys)])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
