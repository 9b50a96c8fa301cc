"""All queries of the engine on the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimstar.functions import rules
from dimstar.functions.runtime import shared_folder
from dimstar.operators import batch, evaluation, search, selection, series, target_sweep, vetting, windows
from dimstar.plans import views as v
from dimstar.plans.registry import QUERIES, SQL, query, r, rounded
from dimstar.sources import datasets, readers, schemas
from dimstar.streaming import sweep

# Batch analysis


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, target, score, tier, tier_reasons FROM ({v.TIERED})")
def tier_classify(s, d):
    return batch.tier_rule(v.scored(s, d)).select("l_orderkey", "l_linenumber", "l_partkey", "target", "score", "tier", "tier_reasons")


@query(f"""
    SELECT list_position(['A', 'A*', 'B', 'C', 'D', 'bump'], tier)::INTEGER AS place, tier, count(*) AS n
    FROM ({v.TIERED}) WHERE download_status = 'ok' AND score >= 0.86::DOUBLE GROUP BY tier""")
def tier_counts(s, d):
    return batch.tier_counts(batch.tier_rule(batch.candidates(v.scored(s, d))))


@query(f"""
    SELECT sector, count(score) AS n_candidates, count(*) FILTER (NOT polarity_flipped) AS n_dips, max(score) AS best_score
    FROM ({v.SCORED}) WHERE download_status = 'ok' AND score >= 0.86::DOUBLE GROUP BY sector""")
def sector_summary(s, d):
    return batch.sector_summary(batch.candidates(v.scored(s, d)))


@query(f"""
    SELECT bin, count(bls_period) AS n
    FROM (VALUES ('0-0.5', 0.0, 0.5), ('0.5-1', 0.5, 1.0), ('1-2', 1.0, 2.0), ('2-5', 2.0, 5.0), ('5-14', 5.0, 14.0)) b(bin, lo, hi)
    LEFT JOIN ({v.SCORED}) ON bls_period > lo AND bls_period <= hi AND download_status = 'ok' AND score >= 0.86::DOUBLE AND NOT polarity_flipped
    GROUP BY bin""")
def period_histogram(s, d):
    return batch.period_histogram(batch.dips(batch.candidates(v.scored(s, d))))


_MULTI = f"""
    SELECT target, count(*) AS n_sectors, count(DISTINCT sector) AS n_distinct_sectors, array_to_string(list_sort(list(sector)), ',') AS sectors,
           round(avg(bls_period), 4) AS period_mean, round(max(score), 6) AS score_max, round(min(score), 6) AS score_min,
           max(morph_n_flags) AS morph_n_flags, round(stddev_samp(bls_period) / avg(bls_period), 6) AS period_cv
    FROM ({v.SCORED}) WHERE NOT polarity_flipped AND coalesce(morph_n_flags, -1) <= 0
    GROUP BY target HAVING count(*) >= 2 AND stddev_samp(bls_period) / avg(bls_period) < 0.001::DOUBLE"""


@query(_MULTI)
def multi_sector(s, d):
    found = batch.multi_sector(v.scored(s, d)).withColumn("sectors", F.array_join("sectors", ","))
    return rounded(rounded(found, "score_max", "score_min", "period_cv"), "period_mean", digits=4)


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, target, score, tier FROM ({v.TIERED})
    WHERE tier IN ('A', 'A*', 'B') AND download_status = 'ok' AND score >= 0.86::DOUBLE AND NOT polarity_flipped
    ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey, target LIMIT 200""")
def priority_topn(s, d):
    rows = batch.dips(batch.candidates(v.scored(s, d)))
    top = batch.priority(batch.tier_rule(rows), ["l_orderkey", "l_linenumber", "l_partkey", "target"], 200)
    return batch.existing(top, ["l_orderkey", "l_linenumber", "l_partkey", "target", "score", "tier", "not_there"])


@query(f"""
    SELECT printf('{{"tic": %s, "period": %.4f, "t0": %.4f, "dur": %.4f, "score": %.4f, "sector": %d}},', replace(target, 'TIC ', ''), bls_period, 0.0::DOUBLE, bls_duration, score, sector) AS line
    FROM ({v.TIERED}) WHERE tier IN ('A', 'A*', 'B') ORDER BY score DESC, target, sector, bls_period, bls_duration LIMIT 10""")
def candidate_lines(s, d):
    """The ten best of the rows to vet as records to paste: a report."""
    rows = batch.tier_rule(v.scored(s, d)).filter(F.col("tier").isin(*batch.PRIORITY_TIERS))
    return batch.candidate_lines(rows.withColumn("bls_t0", F.lit(0.0)))


@query(f"""
    SELECT *, round(100.0::DOUBLE * n_candidates / greatest(n_rows, 1), 4) AS pct_candidates,
           round(100.0::DOUBLE * n_dips / greatest(n_candidates, 1), 4) AS pct_dips,
           round(100.0::DOUBLE * n_clean / greatest(n_candidates, 1), 4) AS pct_clean
    FROM (SELECT count(*) AS n_rows, count(*) FILTER (score >= 0.86::DOUBLE) AS n_candidates,
                 count(*) FILTER (score >= 0.86::DOUBLE AND NOT polarity_flipped) AS n_dips,
                 count(*) FILTER (score >= 0.895::DOUBLE AND NOT polarity_flipped) AS n_high,
                 count(*) FILTER (score >= 0.86::DOUBLE AND morph_n_flags = 0) AS n_clean,
                 count(*) FILTER (score >= 0.86::DOUBLE AND morph_n_flags > 0) AS n_flagged,
                 count(*) FILTER (score >= 0.86::DOUBLE AND morph_is_strong_fp) AS n_strong_fp
          FROM ({v.SCORED}) WHERE download_status = 'ok')""")
def batch_counts(s, d):
    return batch.batch_counts(batch.ok_rows(v.scored(s, d)))


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN score >= 0.895::DOUBLE THEN 'high_confidence_planet' WHEN score >= 0.88::DOUBLE THEN 'likely_planet'
                WHEN score >= 0.86::DOUBLE THEN 'candidate' ELSE 'reject' END AS label,
           CASE WHEN download_status <> 'ok' THEN 'download_fail' WHEN score >= 0.895::DOUBLE THEN 'high_confidence_planet'
                WHEN score >= 0.88::DOUBLE THEN 'likely_planet' WHEN score >= 0.86::DOUBLE THEN 'candidate' ELSE 'reject' END AS outcome
    FROM ({v.SCORED})""")
def score_labels(s, d):
    rows = v.scored(s, d)
    score = F.col("score")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", rules.score_label(score).alias("label"), rules.failure_label(F.col("download_status"), score).alias("outcome"))


@query(f"SELECT target, count(*) AS n FROM ({v.SCORED}) GROUP BY target HAVING count(*) >= 2 ORDER BY n DESC, target LIMIT 20")
def frequent_targets(s, d):
    return batch.frequent_values(batch.repeated_targets(v.scored(s, d)), "target", 20)


@query("SELECT o_orderkey, 'TIC ' || o_orderkey AS target FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti_join(s, d):
    done = v.table(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    rest = batch.not_done(v.table(s, d, "orders").select("o_orderkey"), done, ["o_orderkey"])
    return rest.select("o_orderkey", rules.target_name(F.col("o_orderkey")).alias("target"))


@query("""
    SELECT o_custkey, o_orderkey, good_before FROM (
        SELECT *, coalesce(sum((o_orderstatus = 'F')::INTEGER) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS good_before
        FROM orders) WHERE good_before < 3""")
def probe_until(s, d):
    attempts = v.table(s, d, "orders").withColumn("ok", F.col("o_orderstatus") == "F")
    return batch.take_until(attempts, "o_custkey", "o_orderkey", "ok", 3).select("o_custkey", "o_orderkey", "good_before")


@query("""
    SELECT o_custkey, o_orderkey, sum(bad) OVER (PARTITION BY o_custkey, island ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS streak
    FROM (SELECT *, (o_orderstatus <> 'F')::INTEGER AS bad,
                 sum((o_orderstatus = 'F')::INTEGER) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
          FROM orders)""")
def timeout_streaks(s, d):
    attempts = v.table(s, d, "orders").withColumn("failed", F.col("o_orderstatus") != "F")
    return batch.failure_streaks(attempts, "o_custkey", "o_orderkey", "failed").select("o_custkey", "o_orderkey", "streak")


# Catalogs and identifiers


@query("""
    SELECT p_partkey AS tic_id, p_name AS pl_name, p_size / 2.0::DOUBLE AS pl_orbper FROM part
    WHERE p_size / 2.0::DOUBLE <= 0.5::DOUBLE * 27.4::DOUBLE AND upper(p_brand) LIKE 'BRAND%' ORDER BY pl_orbper, tic_id, pl_name LIMIT 2000""")
def catalog_filter(s, d):
    catalog = v.table(s, d, "part").selectExpr("p_partkey AS tic_id", "p_name AS pl_name", "p_size / 2.0D AS pl_orbper", "p_brand AS disc_facility")
    return readers.usable_planets(catalog, facility="brand").select("tic_id", "pl_name", "pl_orbper")


@query("SELECT DISTINCT trim(c_name) AS tidstr FROM customer WHERE upper(trim(c_mktsegment)) = 'MACHINERY' AND trim(c_name) <> '' AND lower(trim(c_name)) <> 'nan'")
def confirmed_objects(s, d):
    objects = v.table(s, d, "customer").select(F.col("c_name").alias("tidstr"), F.when(F.col("c_mktsegment") == "MACHINERY", " cp ").otherwise("FP").alias("tfopwg_disp"))
    return readers.confirmed_objects(objects)


_IDS = """
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || ' TIC-' || (page_id + 123456) WHEN 1 THEN url || ' 000' || (page_id + 1000000) || '00'
                                     WHEN 2 THEN (page_id + 5000000)::VARCHAR ELSE url END AS txt FROM pages"""


@query(f"""
    SELECT page_id, coalesce(
        TRY_CAST(nullif(regexp_extract(txt, '(?i)TIC\\W*(\\d{{5,12}})', 1), '') AS BIGINT),
        list_sort(list_transform(list_filter(regexp_extract_all(txt, '(\\d+)', 1),
                  lambda x: len(x) BETWEEN 9 AND 16 AND TRY_CAST(x AS BIGINT) BETWEEN 100000 AND 2000000000),
                  lambda x: {{'l': len(x), 'n': TRY_CAST(x AS BIGINT)}}), 'DESC')[1].n,
        TRY_CAST(list_filter(regexp_extract_all(txt, '(\\d+)', 1),
                  lambda x: len(x) BETWEEN 7 AND 12 AND TRY_CAST(x AS BIGINT) BETWEEN 100000 AND 2000000000)[1] AS BIGINT)) AS tic_id
    FROM ({_IDS})""")
def tic_extract(s, d):
    pages = v.table(s, d, "pages").selectExpr(
        "page_id",
        "CASE page_id % 4 WHEN 0 THEN concat(url, ' TIC-', page_id + 123456) WHEN 1 THEN concat(url, ' 000', page_id + 1000000, '00') WHEN 2 THEN string(page_id + 5000000) ELSE url END AS txt",
    )
    return pages.select("page_id", rules.cascade_id(F.col("txt")).alias("tic_id"))


@query("""
    SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    WHERE month(o_orderdate) = 5 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND round_even(o_totalprice / 20000, 0)::BIGINT IN (5, 10)""")
def observation_filter(s, d):
    rows = v.table(s, d, "orders").selectExpr("o_orderkey", "o_orderpriority", "o_totalprice", "month(o_orderdate) AS sequence_number", "o_orderpriority AS provenance_name", "o_totalprice / 20000 AS t_exptime")
    return readers.wanted_observations(rows, sector=5, exposures=(5, 10), authors=("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""
    SELECT o_custkey, month(o_orderdate)::INTEGER AS sector, o_orderkey FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey, month(o_orderdate)
               ORDER BY CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END, o_orderstatus, o_orderpriority, o_orderkey) AS nth
        FROM orders) WHERE nth = 1""")
def preferred_products(s, d):
    rows = v.table(s, d, "orders").selectExpr(
        "o_custkey AS target", "month(o_orderdate) AS sector", "o_orderkey", "o_orderpriority",
        "CASE WHEN o_orderstatus = 'F' THEN 'SPOC' ELSE o_orderstatus END AS author",
        "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 120 ELSE 0 END AS exptime",
    )
    best = readers.preferred_products(rows, ties=("o_orderpriority", "o_orderkey"))
    return best.select(F.col("target").alias("o_custkey"), F.col("sector").cast("int").alias("sector"), "o_orderkey")


@query("SELECT doc_id, quality FROM labels WHERE quality = 0")
def background_rows(s, d):
    return readers.background(v.table(s, d, "labels"), "quality").select("doc_id", "quality")


# Series


@query(f"""
    SELECT target, round(t, 6) AS t, round((f - median(f) OVER w) / stddev_pop(f) OVER w, 6) AS f FROM ({v.USER_SERIES}) WINDOW w AS (PARTITION BY target)""")
def normalize_series(s, d):
    return rounded(series.normalize(series.finite_points(v.user_series(s, d))), "t", "f")


@query(f"""
    SELECT target, round(t, 6) AS t, round(greatest(med - room, least(med + room, f)), 6) AS f FROM (
        SELECT *, 2.0::DOUBLE * 1.4826::DOUBLE * (median(abs(f - med)) OVER (PARTITION BY target) + 1e-12::DOUBLE) AS room
        FROM (SELECT *, median(f) OVER (PARTITION BY target) AS med FROM ({v.USER_SERIES})))""")
def robust_clip(s, d):
    return rounded(series.robust_clip(v.user_series(s, d), 2.0), "t", "f")


@query(f"""
    SELECT target, round(t, 6) AS t, f FROM (SELECT *, median(f) OVER w AS med, stddev_pop(f) OVER w AS sd FROM ({v.USER_SERIES}) WINDOW w AS (PARTITION BY target))
    WHERE abs(f - med) < 2.0::DOUBLE * sd""")
def sigma_clip(s, d):
    return rounded(series.sigma_clip(v.user_series(s, d), 2.0), "t")


_TREND = f"SELECT *, quantile_cont(f, 0.5) OVER (PARTITION BY target ORDER BY t ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS trend FROM ({v.SERIES})"


@query(f"SELECT target, round(t, 6) AS t, round(trend, 6) AS trend FROM ({_TREND})")
def moving_median(s, d):
    return rounded(series.moving_median(v.series(s, d)).select("target", "t", "trend"), "t", "trend")


@query(f"""
    SELECT target, round(t, 6) AS t, round(greatest(-8.0::DOUBLE, least(8.0::DOUBLE, y / CASE WHEN sd > 0 THEN sd ELSE 1 END)), 6) AS f
    FROM (SELECT *, stddev_pop(y) OVER (PARTITION BY target) AS sd FROM (SELECT *, f - trend AS y FROM ({_TREND})))""")
def detrend(s, d):
    return rounded(series.detrend(v.series(s, d)), "t", "f")


@query(f"""
    WITH s AS (SELECT *, greatest(11, floor(0.05::DOUBLE * n)::BIGINT | 1) // 2 AS half
               FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY t, f) - 1 AS p, count(*) OVER (PARTITION BY target) AS n FROM ({v.SERIES}))),
    images AS (SELECT *, unnest([p + 2 * k * n, -p - 1 + 2 * k * n]) AS q FROM s, (SELECT unnest(range(-3, 4)) AS k)),
    levels AS (SELECT *, quantile_cont(f, 0.5) OVER (PARTITION BY target ORDER BY q ROWS BETWEEN half PRECEDING AND half FOLLOWING) AS level
               FROM images WHERE q BETWEEN -half AND n - 1 + half)
    SELECT target, round(t, 6) AS t, round(y / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS f
    FROM (SELECT *, stddev_pop(y) OVER (PARTITION BY target) AS sd FROM (SELECT target, t, f - level AS y FROM levels WHERE q = p))""")
def detrend_reflected(s, d):
    return rounded(series.detrend_reflected(v.series(s, d)), "t", "f")


@query(f"""
    SELECT target, j, round(t, 6) AS t, f FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY target) AS n FROM ({v.SERIES}))
    JOIN (SELECT unnest(range(101))::INTEGER AS j) ON floor(j::DOUBLE * (n - 1) / 100)::BIGINT = i""")
def decimate_resample(s, d):
    return rounded(series.decimate(v.series(s, d), 101), "t")


_GRID = f"""
    SELECT target, j, lo + j * ((hi - lo) / 100) AS at FROM (SELECT target, min(t) AS lo, max(t) AS hi FROM ({v.SERIES}) GROUP BY target), (SELECT unnest(range(101))::INTEGER AS j)"""


@query(f"""
    SELECT g.target, g.j, round(g.at, 6) AS t, round(CASE WHEN b.t1 IS NULL THEN b.f ELSE b.f + (b.f1 - b.f) / (b.t1 - b.t) * (g.at - b.t) END, 5) AS f
    FROM ({_GRID}) g ASOF JOIN (SELECT *, lead(t) OVER w AS t1, lead(f) OVER w AS f1 FROM ({v.SERIES}) WINDOW w AS (PARTITION BY target ORDER BY t)) b
    ON g.target = b.target AND g.at >= b.t""")
def interp_resample(s, d):
    return rounded(rounded(series.interpolate(v.series(s, d), 101), "t"), "f", digits=5)


@query(f"""
    SELECT target, CASE WHEN n < 60 THEN 'too_short' WHEN sd <= 0 THEN 'bad_std' ELSE 'ok' END AS status, n AS n_points, round(span, 6) AS tspan_days, round(gap, 6) AS median_dt_days
    FROM (SELECT target, count(*) AS n, max(t) - min(t) AS span, median(g) AS gap, stddev_pop(f) AS sd
          FROM (SELECT *, t - lag(t) OVER (PARTITION BY target ORDER BY t) AS g FROM ({v.USER_SERIES})) GROUP BY target)""")
def series_status(s, d):
    return rounded(series.series_status(v.user_series(s, d), 60), "tspan_days", "median_dt_days")


@query(f"""
    SELECT target, round(t, 6) AS t, f FROM (SELECT *, count(*) FILTER (late) OVER (PARTITION BY target) AS n_late
        FROM (SELECT *, t >= max(t) OVER (PARTITION BY target) - 10.0::DOUBLE AS late FROM ({v.USER_SERIES}))) WHERE late OR n_late < 20""")
def trailing_span(s, d):
    return rounded(series.trailing_span(v.user_series(s, d), 10.0, 20), "t")


@query(f"SELECT target, day, f FROM (SELECT *, row_number() OVER (PARTITION BY target, day ORDER BY t) AS nth FROM (SELECT *, floor(t)::DOUBLE AS day FROM ({v.USER_SERIES}))) WHERE nth = 1")
def first_of_equal_times(s, d):
    rows = v.user_series(s, d).select("target", F.floor("t").cast("double").alias("t"), "f", F.col("t").alias("at"))
    return series.first_occurrences(rows, "at").select("target", F.col("t").alias("day"), "f")


@query("SELECT vec_id, i, round(i * 27.4::DOUBLE / 64, 6) AS t, embedding[i + 1]::DOUBLE AS f FROM embeddings, (SELECT unnest(range(64))::INTEGER AS i)")
def synthetic_times(s, d):
    packed = v.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("flux"))
    return rounded(series.synthetic_times(packed, "flux").select("vec_id", "i", "t", "f"), "t")


# Folding, vetting, shape


def _folded(s, d) -> DataFrame:
    return vetting.folded(v.with_ephemeris(v.series(s, d)))


@query(f"SELECT target, round(min(abs(phase)), 6) AS min_abs_phase FROM ({v.FOLDED}) GROUP BY target")
def min_abs_phase(s, d):
    return rounded(vetting.min_abs_phase(_folded(s, d)), "min_abs_phase")


@query(f"SELECT target, round(t, 6) AS t, round(phase, 6) AS phase, transit FROM ({v.FOLDED})")
def phase_fold(s, d):
    return rounded(_folded(s, d).select("target", "t", "phase", "transit"), "t", "phase")


@query(f"SELECT target, bin, round(center, 6) AS center, round(level, 6) AS level, n FROM ({v.binned_sql(50)})")
def phase_bin_median(s, d):
    return rounded(vetting.binned(_folded(s, d), 50).select("target", "bin", "center", "level", "n"), "center", "level")


_EACH = f"SELECT target, transit, median(f) AS depth, count(*) AS n FROM ({v.FOLDED}) WHERE abs(phase) < 1.5::DOUBLE * dur_phase / 2 GROUP BY target, transit HAVING count(*) >= 3"


@query(f"""
    SELECT target, round(median(depth) FILTER (transit % 2 <> 0), 6) AS odd_depth, round(median(depth) FILTER (transit % 2 = 0), 6) AS even_depth,
           count(*) FILTER (transit % 2 <> 0) AS n_odd, count(*) FILTER (transit % 2 = 0) AS n_even FROM ({_EACH}) GROUP BY target""")
def odd_even_depths(s, d):
    return rounded(vetting.odd_even_depths(_folded(s, d)).drop("period", "t0", "duration"), "odd_depth", "even_depth")


@query(f"""
    SELECT target, CASE WHEN count(*) FILTER (far) >= 3 THEN round(median(f) FILTER (far), 6) END AS phase05_level, count(DISTINCT transit) AS n_transits
    FROM (SELECT *, abs(abs(phase) - 0.5::DOUBLE) < 0.05::DOUBLE AS far FROM ({v.FOLDED})) GROUP BY target""")
def phase05_level(s, d):
    return rounded(vetting.phase05_level(_folded(s, d)).select("target", "phase05_level", "n_transits"), "phase05_level")


@query(f"SELECT target, CASE WHEN count(*) > 5 THEN round(arg_min(center, (level, bin)), 6) END AS dip_centroid FROM ({v.binned_sql(50)}) GROUP BY target")
def dip_centroid(s, d):
    return rounded(vetting.dip_centroid(_folded(s, d), 50).select("target", "dip_centroid"), "dip_centroid")


@query(f"""
    SELECT target, CASE WHEN count(*) >= 4 AND abs(avg(depth)) > 0.05::DOUBLE THEN round(stddev_pop(depth) / abs(avg(depth)), 6) END AS depth_cv
    FROM (SELECT target, transit, median(f) AS depth FROM ({v.FOLDED}) WHERE abs(phase) < 1.5::DOUBLE * dur_phase / 2 GROUP BY target, transit HAVING count(*) >= 2) GROUP BY target""")
def depth_consistency(s, d):
    return rounded(vetting.depth_consistency(_folded(s, d)).select("target", "depth_cv"), "depth_cv")


@query(f"""
    WITH folded AS ({v.FOLDED}), each AS ({_EACH}),
    depth AS (SELECT target, median(depth) FILTER (transit % 2 <> 0) AS odd_depth, median(depth) FILTER (transit % 2 = 0) AS even_depth FROM each GROUP BY target),
    level AS (SELECT target, period, duration, CASE WHEN count(*) FILTER (far) >= 3 THEN median(f) FILTER (far) END AS p05
              FROM (SELECT *, abs(abs(phase) - 0.5::DOUBLE) < 0.05::DOUBLE AS far FROM folded) GROUP BY target, period, duration),
    dip AS (SELECT target, CASE WHEN count(*) > 5 THEN arg_min(center, (level, bin)) END AS center FROM ({v.binned_sql(50, 'folded')}) GROUP BY target),
    joined AS (SELECT *, CASE WHEN abs(odd_depth) > 0 THEN abs(even_depth / odd_depth) END AS ratio, duration / period AS duty FROM level LEFT JOIN depth USING (target) LEFT JOIN dip USING (target))
    SELECT target, round(ratio, 6) AS odd_even_ratio, round(duty, 6) AS duty_cycle,
           coalesce(nullif(array_to_string(list_filter([
               CASE WHEN ratio < 0.6::DOUBLE OR ratio > 1.7::DOUBLE THEN printf('ODD/EVEN DEPTH RATIO=%.2f ⚠ possible EB', ratio) END,
               CASE WHEN p05 < -0.3::DOUBLE THEN printf('SECONDARY DIP at phase 0.5 (%.3fσ) ⚠ possible EB', p05) END,
               CASE WHEN duration >= 0.499::DOUBLE THEN 'DURATION AT SEARCH CEILING' END,
               CASE WHEN duty > 0.25::DOUBLE THEN 'HIGH DUTY CYCLE=' || printf('%.1f%%', duty * 100) || ' ⚠ likely stellar rotation or EB (transit duration is ' || printf('%.0f%%', duty * 100) || ' of orbit)' WHEN duty > 0.15::DOUBLE THEN 'ELEVATED DUTY CYCLE=' || printf('%.1f%%', duty * 100) || ' — verify transit shape' END,
               CASE WHEN abs(center) > 0.15::DOUBLE THEN printf('DIP CENTROID OFFSET=%+.3f phase units ⚠ possible non-transit morphology (rotation / EB / artifact)', center) END], lambda x: x IS NOT NULL), ' | '), ''), 'none') AS flags
    FROM joined""")
def vetting_flags(s, d):
    found = vetting.vetted(v.with_ephemeris(v.series(s, d)), 50)
    return rounded(found.select("target", "odd_even_ratio", "duty_cycle", "flags"), "odd_even_ratio", "duty_cycle")


def clean_or_flagged(s, d):
    return vetting.clean_or_flagged(vetting_flags(s, d))


query(f"SELECT CASE WHEN flags = 'none' THEN 'clean' ELSE 'flagged' END AS verdict, count(*) AS n FROM ({SQL['vetting_flags']}) GROUP BY 1")(clean_or_flagged)


@query(f"""
    SELECT target, n, round(t0 + n * period, 6) AS time FROM (
        SELECT target, period, t0, unnest(range(ceil((min(t) - t0) / period)::BIGINT, floor((max(t) - t0) / period)::BIGINT + 1)) AS n FROM ({v.EPHEMERIS}) GROUP BY target, period, t0)""")
def predicted_transits(s, d):
    return rounded(vetting.predicted_transits(v.with_ephemeris(v.series(s, d))).select("target", "n", "time"), "time")


@query(f"SELECT target, bin, round(level, 6) AS level, n FROM ({v.binned_sql(60, f'SELECT * FROM ({v.FOLDED}) WHERE abs(phase) <= greatest(4 * dur_phase, 0.08::DOUBLE)')})")
def zoom_panel(s, d):
    return rounded(vetting.zoom_panel(_folded(s, d)).select("target", "bin", "level", "n"), "level")


def _parity_sql(is_odd: bool) -> str:
    rows = f"SELECT * FROM ({v.FOLDED}) WHERE abs(phase) <= least(1.5::DOUBLE * greatest(4 * dur_phase, 0.08::DOUBLE), 0.4::DOUBLE) AND (transit % 2 <> 0) = {is_odd}"
    return f"SELECT target, {is_odd} AS odd, bin, round(level, 6) AS level, n FROM ({v.binned_sql(50, rows)})"


@query(f"{_parity_sql(True)} UNION ALL {_parity_sql(False)}")
def parity_panels(s, d):
    return rounded(vetting.parity_panels(_folded(s, d)).select("target", "odd", "bin", "level", "n"), "level")


@query(f"""
    SELECT target, round(quantile_cont(f, 0.005), 6) AS low, round(quantile_cont(f, 0.995), 6) AS high,
           round(quantile_cont(f, 0.01), 6) AS low1, round(quantile_cont(f, 0.99), 6) AS high1 FROM ({v.SERIES}) GROUP BY target""")
def plot_limits(s, d):
    p = F.percentile("f", F.array(*map(F.lit, (0.005, 0.995, 0.01, 0.99)))).alias("p")
    found = v.series(s, d).groupBy("target").agg(p)
    return found.select("target", *(F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("low", "high", "low1", "high1"))))


_SHAPE = f"""
    SELECT *, CASE WHEN n >= 5 AND n_in >= 2 AND n - n_in >= 2 AND rms_v > 0 THEN rms_box / rms_v END AS v_score,
           CASE WHEN n_before >= 2 AND n_after >= 2 AND abs(box) > 0 THEN abs(m_before - m_after) / abs(box) END AS asymmetry,
           least(CASE WHEN n_right >= 2 THEN d_right END, CASE WHEN n_left >= 2 THEN d_left END) AS secondary_depth,
           CASE WHEN n_core >= 2 AND n_edge >= 2 AND m_core < -0.10::DOUBLE THEN least(1.5::DOUBLE, greatest(0.0::DOUBLE, m_edge / m_core)) END AS grazing_ratio,
           duration / period AS duty_cycle
    FROM (SELECT target, period, duration, count(*) AS n, max(n_in) AS n_in, max(box) AS box,
                 sqrt(avg((x - CASE WHEN inside THEN box ELSE 0 END) ** 2)) AS rms_box,
                 sqrt(avg((x - CASE WHEN inside THEN v * greatest(0.0::DOUBLE, 1 - abs(c) / (d / 2)) ELSE 0 END) ** 2)) AS rms_v,
                 median(x) FILTER (c >= -1.5::DOUBLE * d AND c < -d / 2) AS m_before, count(*) FILTER (c >= -1.5::DOUBLE * d AND c < -d / 2) AS n_before,
                 median(x) FILTER (c > d / 2 AND c <= 1.5::DOUBLE * d) AS m_after, count(*) FILTER (c > d / 2 AND c <= 1.5::DOUBLE * d) AS n_after,
                 min(x) FILTER (c >= 0.40::DOUBLE AND c <= 0.50::DOUBLE) AS d_right, count(*) FILTER (c >= 0.40::DOUBLE AND c <= 0.50::DOUBLE) AS n_right,
                 min(x) FILTER (c >= -0.50::DOUBLE AND c <= -0.40::DOUBLE) AS d_left, count(*) FILTER (c >= -0.50::DOUBLE AND c <= -0.40::DOUBLE) AS n_left,
                 median(x) FILTER (abs(c) < 0.20::DOUBLE * d) AS m_core, count(*) FILTER (abs(c) < 0.20::DOUBLE * d) AS n_core,
                 median(x) FILTER (abs(c) >= 0.30::DOUBLE * d AND abs(c) < 0.55::DOUBLE * d) AS m_edge,
                 count(*) FILTER (abs(c) >= 0.30::DOUBLE * d AND abs(c) < 0.55::DOUBLE * d) AS n_edge
          FROM (SELECT *, median(x) FILTER (inside) OVER w AS box, count(*) FILTER (inside) OVER w AS n_in,
                       coalesce(median(x) FILTER (c >= -0.01::DOUBLE AND c <= 0.01::DOUBLE) OVER w, min(x) OVER w) AS v
                FROM (SELECT *, center AS c, level AS x, duration / period AS d, abs(center) <= duration / period / 2 AS inside FROM ({v.binned_sql(50)}))
                WINDOW w AS (PARTITION BY target))
          GROUP BY target, period, duration)"""


def _shape(s, d) -> DataFrame:
    return vetting.shape_scores(vetting.binned(_folded(s, d), 50))


def _one_shape(name: str):
    SQL[f"morph_{name}"] = f"SELECT target, round({name}, 4) AS {name} FROM ({_SHAPE})"
    QUERIES[f"morph_{name}"] = lambda s, d: _shape(s, d).select("target", F.round(name, 4).alias(name))


for _name in ("v_score", "asymmetry", "secondary_depth", "grazing_ratio"):
    _one_shape(_name)


@query(f"""
    SELECT target, (two::INTEGER + high::INTEGER + graze::INTEGER + vf::INTEGER + asym::INTEGER)::INTEGER AS n_flags, two OR high OR graze AS is_strong_fp
    FROM (SELECT *, coalesce(secondary_depth < -0.80::DOUBLE, false) AS two, coalesce(duty_cycle > 0.30::DOUBLE AND duration < 0.499::DOUBLE, false) AS high,
                 coalesce(grazing_ratio < 0.50::DOUBLE, false) AS graze, coalesce(v_score > 1.5::DOUBLE, false) AS vf, coalesce(asymmetry > 0.60::DOUBLE, false) AS asym
          FROM ({_SHAPE}))""")
def morph_composite(s, d):
    return vetting.shape_flags(_shape(s, d)).select("target", "n_flags", "is_strong_fp")


@query(f"""
    SELECT target, period, t0, duration, round(v_score, 4) AS v_score, round(asymmetry, 4) AS asymmetry, round(secondary_depth, 4) AS secondary_depth,
           round(grazing_ratio, 4) AS grazing_ratio, round(duty_cycle, 4) AS duty_cycle, two AS two_dip_flag, high AS high_duty_flag, graze AS grazing_flag, vf AS v_flag,
           asym AS asymm_flag, false AS depth_cv_flag, (two::INTEGER + high::INTEGER + graze::INTEGER + vf::INTEGER + asym::INTEGER)::INTEGER AS n_flags, two OR high OR graze AS is_strong_fp,
           coalesce(nullif(array_to_string(list_filter([
               CASE WHEN two THEN printf('SECONDARY_DIP=%.3fσ', secondary_depth) END, CASE WHEN high THEN 'HIGH_DUTY=' || printf('%.1f%%', duty_cycle * 100) END,
               CASE WHEN graze THEN printf('GRAZING_V_SHAPE(ratio=%.2f)', grazing_ratio) END, CASE WHEN vf THEN printf('V_SCORE=%.2f>1.5 (V-shaped, EB/rotation)', v_score) END,
               CASE WHEN asym THEN printf('ASYMM=%.2f', asymmetry) END], lambda x: x IS NOT NULL), ' | '), ''), 'none') AS flag_summary
    FROM (SELECT *, 0.3::DOUBLE AS t0, coalesce(secondary_depth < -0.80::DOUBLE, false) AS two, coalesce(duty_cycle > 0.30::DOUBLE AND duration < 0.499::DOUBLE, false) AS high,
                 coalesce(grazing_ratio < 0.50::DOUBLE, false) AS graze, coalesce(v_score > 1.5::DOUBLE, false) AS vf, coalesce(asymmetry > 0.60::DOUBLE, false) AS asym
          FROM ({_SHAPE.replace(v.binned_sql(50), v.binned_sql(200))}))""")
def morphology(s, d):
    return vetting.morphology(v.with_ephemeris(v.series(s, d)))


#: Ephemerides as search results may have them: three dense targets have one that can't be folded.
_BROKEN_SQL = f"""SELECT *, target = 'click-3' AS bad_p, target = 'view-2' AS bad_t0, target = 'error-1' AS bad_d FROM ({v.EPHEMERIS})"""


@query(f"""
    WITH wanted AS (SELECT DISTINCT target FROM ({v.SERIES}) UNION SELECT DISTINCT target FROM ({v.USER_SERIES})),
    bad AS (SELECT target, CASE WHEN bool_or(bad_p) THEN 'bad_period' WHEN bool_or(bad_t0) THEN 'bad_t0' ELSE 'bad_duration' END AS why FROM ({_BROKEN_SQL}) WHERE bad_p OR bad_t0 OR bad_d GROUP BY target),
    uneven AS (SELECT target, CASE WHEN count(*) >= 4 AND abs(avg(depth)) > 0.05::DOUBLE THEN stddev_pop(depth) / abs(avg(depth)) END AS depth_cv
               FROM (SELECT target, transit, median(f) AS depth FROM ({v.FOLDED}) WHERE abs(phase) < 1.5::DOUBLE * dur_phase / 2 GROUP BY target, transit HAVING count(*) >= 2) GROUP BY target),
    flagged AS (SELECT s.*, depth_cv, coalesce(secondary_depth < -0.80::DOUBLE, false) AS two, coalesce(duty_cycle > 0.30::DOUBLE AND duration < 0.499::DOUBLE, false) AS high,
                       coalesce(grazing_ratio < 0.50::DOUBLE, false) AS graze, coalesce(v_score > 1.5::DOUBLE, false) AS vf, coalesce(asymmetry > 0.60::DOUBLE, false) AS asym,
                       coalesce(depth_cv > 0.80::DOUBLE, false) AS cv
                FROM ({_SHAPE.replace(v.binned_sql(50), v.binned_sql(200))}) s LEFT JOIN uneven USING (target) WHERE target NOT IN (SELECT target FROM bad))
    SELECT target, round(v_score, 4) AS morph_v_score, round(asymmetry, 4) AS morph_asymmetry, round(secondary_depth, 4) AS morph_secondary_dip, round(depth_cv, 4) AS morph_depth_cv,
           round(duty_cycle, 4) AS morph_duty_cycle, round(grazing_ratio, 4) AS morph_grazing_ratio, graze AS morph_grazing_flag,
           coalesce(two::INTEGER + high::INTEGER + graze::INTEGER + vf::INTEGER + asym::INTEGER + cv::INTEGER, -1)::INTEGER AS morph_n_flags, coalesce(two OR high OR graze, false) AS morph_is_strong_fp,
           CASE WHEN two IS NULL THEN coalesce('morph_error:' || why, 'morph_unavailable') ELSE coalesce(nullif(array_to_string(list_filter([
               CASE WHEN two THEN printf('SECONDARY_DIP=%.3fσ', secondary_depth) END, CASE WHEN high THEN 'HIGH_DUTY=' || printf('%.1f%%', duty_cycle * 100) END,
               CASE WHEN graze THEN printf('GRAZING_V_SHAPE(ratio=%.2f)', grazing_ratio) END, CASE WHEN vf THEN printf('V_SCORE=%.2f>1.5 (V-shaped, EB/rotation)', v_score) END,
               CASE WHEN asym THEN printf('ASYMM=%.2f', asymmetry) END, CASE WHEN cv THEN printf('DEPTH_CV=%.2f', depth_cv) END], lambda x: x IS NOT NULL), ' | '), ''), 'none') END AS morph_flags
    FROM wanted LEFT JOIN flagged USING (target) LEFT JOIN bad USING (target)""")
def shape_results(s, d):
    """Shape columns of all targets, those that can't be folded and those without an ephemeris included."""
    rows = v.with_ephemeris(v.series(s, d)).withColumns(
        {
            "period": F.when(F.col("target") == "click-3", 0.0).otherwise(F.col("period")),
            "t0": F.when(F.col("target") == "view-2", float("nan")).otherwise(F.col("t0")),
            "duration": F.when(F.col("target") != "error-1", F.col("duration")),
        }
    )
    wanted = v.series(s, d).select("target").union(v.user_series(s, d).select("target")).distinct()
    return vetting.morphology_or_default(wanted, vetting.morphology(rows, with_depth_cv=True), vetting.ephemeris_errors(rows))


# Search and selection

_PERIODS, _DURATIONS = search.log_grid(0.6, 6.0, 200), search.legal_durations(0.1, 0.5, 25, 0.6)
_WIDTH = min(_DURATIONS) / 5
_SIZES = [max(1, round(x / _WIDTH)) for x in _DURATIONS]
_doubles = lambda xs: f"{[repr(x) for x in xs]}::DOUBLE[]"  # noqa: E731  read from text, as decimal literals would be rounded


@query(f"""
    WITH centred AS (SELECT target, t - min(t) OVER w AS dt, min(t) OVER w AS start, count(*) OVER w AS n, round_even((f - median(f) OVER w) * 1048576, 0)::BIGINT AS y
                     FROM ({v.SERIES}) WINDOW w AS (PARTITION BY target)),
    grid AS (SELECT period, ceil(period / '{_WIDTH!r}'::DOUBLE)::INTEGER AS bins FROM (SELECT unnest({_doubles(_PERIODS)}) AS period)),
    sums AS (SELECT target, period, (floor((dt - period * floor(dt / period)) / '{_WIDTH!r}'::DOUBLE)::INTEGER % bins)::INTEGER AS bin, sum(y)::BIGINT AS y, count(*) AS m
             FROM centred, grid GROUP BY ALL),
    spine AS (SELECT target, start, n, all_y, period, bins, unnest(range(bins + {max(_SIZES)} - 1))::INTEGER AS slot
              FROM (SELECT target, start, n, sum(y)::BIGINT AS all_y FROM centred GROUP BY ALL), grid),
    slots AS (SELECT s.*, coalesce(y, 0) AS y, coalesce(m, 0) AS m, sum(coalesce(y, 0)) OVER w AS to_y, sum(coalesce(m, 0)) OVER w AS to_m
              FROM spine s LEFT JOIN sums x ON x.target = s.target AND x.period = s.period AND x.bin = s.slot % s.bins
              WINDOW w AS (PARTITION BY s.target, s.period ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    boxes AS (SELECT a.target, a.period, a.start, a.n, a.all_y, a.slot, duration, k, (b.to_y - a.to_y + a.y)::BIGINT AS y, (b.to_m - a.to_m + a.m)::BIGINT AS m
              FROM slots a JOIN (SELECT unnest({_doubles(_DURATIONS)}) AS duration, unnest({_SIZES}) AS k) ON k < a.bins AND a.slot < a.bins
              JOIN slots b ON b.target = a.target AND b.period = a.period AND b.slot = a.slot + k - 1),
    rated AS (SELECT *, ((all_y - y)::DOUBLE / (n - m) - y::DOUBLE / m) / 1048576.0::DOUBLE AS depth FROM boxes WHERE m > 0 AND m < n),
    best AS (SELECT *, row_number() OVER (PARTITION BY target, period ORDER BY 0.5::DOUBLE * m * depth * depth DESC, duration, slot) AS nth FROM rated WHERE depth > 0)
    SELECT target, period, round(start + (slot + k / 2.0::DOUBLE) * '{_WIDTH!r}'::DOUBLE, 6) AS t0, duration, round(depth, 6) AS depth, round(0.5::DOUBLE * m * depth * depth, 4) AS power
    FROM best WHERE nth = 1""")
def box_search(s, d):
    return rounded(rounded(search.box_search(v.series(s, d), _PERIODS, _DURATIONS), "t0", "depth"), "power", digits=4)


@query()
def box_search_series(s, d):
    return search.box_search_series(v.series(s, d), search.two_pass_plan(), top=24)


@query(f"""
    WITH ranked AS (SELECT target, period, 0.0::DOUBLE AS t0, 0.1::DOUBLE AS duration, cnn AS depth, power,
                           row_number() OVER (PARTITION BY target, period < 3 ORDER BY power DESC, period, cnn) AS nth FROM ({v.CANDIDATE_ROWS})),
    listed AS (SELECT target, list({{'period': period, 't0': t0, 'duration': duration, 'depth': depth, 'power': power}} ORDER BY power DESC, period, depth) AS l
               FROM ranked WHERE nth <= 240 GROUP BY target),
    kept AS (SELECT target, list_reduce(l, lambda a, x: CASE WHEN len(a) >= 24 OR len(list_filter(a, lambda k: abs(x.period - k.period) / greatest(k.period, 1e-12::DOUBLE) <= 0.002::DOUBLE)) > 0
                                                        THEN a ELSE a || [x] END, l[1:0]) AS c FROM listed)
    SELECT target, k::INTEGER AS k, c[k].period AS period, c[k].t0 AS t0, c[k].duration AS duration, c[k].depth AS depth, c[k].power AS power
    FROM (SELECT target, c, unnest(range(1, len(c) + 1)) AS k FROM kept)""")
def two_pass_merge_dedupe(s, d):
    rows = v.candidate_rows(s, d).select("target", "period", F.lit(0.0).alias("t0"), F.lit(0.1).alias("duration"), F.col("cnn").alias("depth"), "power")
    return search.merged_passes([rows.filter("period < 3"), rows.filter("period >= 3")])


_HARMONIC = f"""
    SELECT target, k, (fit).k AS harmonic, (fit).kind AS kind, round((fit).err, 6) AS rel_err FROM (
        SELECT c.target, c.k, list_min([{", ".join(
            f"{{'err': abs(period - p_true * {k}) / (p_true * {k}), 'k': {k}, 'place': 0, 'kind': '{'fundamental' if k == 1 else 'multiple'}'}}, "
            f"{{'err': abs(period - p_true / {k}) / (p_true / {k}), 'k': {k}, 'place': 1, 'kind': '{'fundamental' if k == 1 else 'divisor'}'}}"
            for k in range(1, 7))}]) AS fit
        FROM ({v.CANDIDATE_LISTS}) c JOIN ({v.TRUE_PERIODS}) p ON c.target = p.target) WHERE (fit).err <= 0.02::DOUBLE"""


def _harmonic(candidates: DataFrame, s, d) -> DataFrame:
    rows = candidates.join(v.true_periods(s, d), "target").withColumn("m", rules.harmonic_match(F.col("period"), F.col("p_true")))
    return rows.filter("m.matched").select("target", F.col("k"), F.col("m.k").alias("harmonic"), F.col("m.kind").alias("kind"), F.round("m.rel_err", 6).alias("rel_err"))


@query(_HARMONIC)
def harmonic_match(s, d):
    return _harmonic(v.candidate_lists(s, d), s, d)


@query(_HARMONIC.replace(v.CANDIDATE_LISTS, v.CANDIDATE_ROWS))
def harmonic_match_all_rows(s, d):
    return _harmonic(v.candidate_rows(s, d), s, d)


def _answers(s, d) -> DataFrame:
    rows = v.candidate_lists(s, d).select("target", "k", "period", "power", F.col("cnn").alias("score"), (F.col("k") == 1).alias("chosen"))
    return evaluation.known_answers(rows, v.true_periods(s, d))


_ANSWERS = f"""
    WITH c AS ({v.CANDIDATE_LISTS}), m AS (SELECT target, k, harmonic FROM ({_HARMONIC})),
    j AS (SELECT c.*, p_true, m.harmonic IS NOT NULL AS hit FROM c JOIN ({v.TRUE_PERIODS}) p USING (target) LEFT JOIN m ON m.target = c.target AND m.k = c.k),
    g AS (SELECT target, p_true, bool_or(k = 1 AND hit) AS match_best, max(CASE WHEN k = 1 THEN period END) AS p_best, max(CASE WHEN k = 1 THEN cnn END) AS score,
                 max(CASE WHEN k = 1 THEN power END) AS power, bool_or(hit) AS match_any, min(CASE WHEN hit THEN k END) AS match_rank,
                 arg_max(k, (cnn, -k)) FILTER (hit) AS oracle_rank FROM j GROUP BY target, p_true),
    a AS (SELECT g.*, o.period AS p_oracle, o.cnn AS o_cnn, o.power AS o_power FROM g LEFT JOIN c o ON o.target = g.target AND o.k = g.oracle_rank)
    SELECT target, round(p_true, 6) AS p_true, match_best, match_any, match_rank, oracle_rank, round(p_oracle, 6) AS p_oracle, score,
           CASE WHEN oracle_rank IS NULL THEN 'no_match_in_topk' WHEN NOT (p_oracle > p_best AND p_oracle >= 0.60::DOUBLE) THEN 'match_not_long_or_below_min_period'
                WHEN o_cnn >= score - 0.04::DOUBLE AND o_power >= 0.30::DOUBLE * power THEN 'long_alias_plausible' ELSE 'long_alias_but_weak' END AS promote_reason
    FROM a"""


@query(_ANSWERS)
def best_any_oracle(s, d):
    found = _answers(s, d).select("target", "p_true", "match_best", "match_any", "match_rank", "oracle_rank", "p_oracle", "score", "promote_reason")
    return rounded(found, "p_true", "p_oracle")


@query(f"""
    SELECT count(*) AS n, count(*) FILTER (score >= 0.86::DOUBLE) AS n_detected, avg((score >= 0.86::DOUBLE)::INTEGER) AS detection_rate,
           round(avg(match_best::INTEGER) FILTER (score >= 0.86::DOUBLE), 6) AS best_rate, round(avg(match_any::INTEGER) FILTER (score >= 0.86::DOUBLE), 6) AS any_rate,
           round(avg((oracle_rank IS NOT NULL)::INTEGER) FILTER (score >= 0.86::DOUBLE), 6) AS oracle_rate,
           count(*) FILTER (promote_reason = 'long_alias_plausible') AS n_promoted,
           round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95 FROM ({_ANSWERS})""")
def benchmark_summary(s, d):
    return rounded(evaluation.known_answer_summary(_answers(s, d)), "best_rate", "any_rate", "oracle_rate", "p05", "p50", "p95")


_COMBINED = f"""
    SELECT target, k, penalty, round((0.7::DOUBLE * c + 0.3::DOUBLE * lp / max(lp) OVER (PARTITION BY target)) * penalty, 6) AS hybrid,
           round(pow(c + 1e-9::DOUBLE, 2) * pow(lp + 1e-9::DOUBLE, 0.1::DOUBLE) * penalty, 6) AS combined
    FROM (SELECT target, k, greatest(0.0::DOUBLE, least(1.0::DOUBLE, cnn)) AS c, ln(1 + power) AS lp, CASE WHEN period < 0.10::DOUBLE THEN 0.40::DOUBLE ELSE 1.0::DOUBLE END AS penalty
          FROM ({v.CANDIDATE_LISTS}))"""


def _combined(candidates: DataFrame) -> DataFrame:
    return rounded(selection.objective(candidates).select("target", "k", "penalty", "hybrid", "combined"), "hybrid", "combined")


@query(_COMBINED)
def combined_objective(s, d):
    return _combined(v.candidate_lists(s, d))


@query(_COMBINED.replace(v.CANDIDATE_LISTS, v.CANDIDATE_ROWS))
def combined_objective_all_rows(s, d):
    return _combined(v.candidate_rows(s, d))


def _first_sql(items: str, value: str) -> str:
    """SQL for the item of the largest value in a list of candidates, the first by k of equal ones; null for an empty list."""
    return f"(list_sort(list_transform({items}, lambda x: {{'minus': -(x.{value}), 'k': x.k, 'item': x}}))[1]).item"


def _step_sql(before: str, new: str, suffix: str) -> str:
    """SQL for one rule over the choices `before`: the list `new` may give another candidate, then the mode gets the suffix."""
    return f"""(SELECT target, tspan, l, CASE WHEN new.k <> pick.k THEN mode || '{suffix}' ELSE mode END AS mode, CASE WHEN new.k <> pick.k THEN new ELSE pick END AS pick
                FROM (SELECT *, {new} AS new FROM {before}))"""


def _near_sql(ratio: str, near: float) -> str:
    return f"round_even({ratio}, 0) BETWEEN 2 AND 20 AND abs({ratio} - round_even({ratio}, 0)) < {near}::DOUBLE"


_TINY = "1e-12::DOUBLE"
_GUARD = _first_sql(
    f"list_filter(l, lambda x: x.period >= 0.15::DOUBLE AND x.cnn >= pick.cnn - 0.03::DOUBLE AND x.power >= 0.25::DOUBLE * greatest(pick.power, {_TINY}) AND x.combined >= 0.85::DOUBLE * greatest(pick.combined, {_TINY}))",
    "combined",
)
# the scans keep the choice of the moment as their state
_PROMOTE = f"""list_reduce(l, lambda a, x: CASE
    WHEN a.stopped OR (x.period > a.now.period AND x.cnn < a.now.cnn - 0.01::DOUBLE) THEN {{'now': a.now, 'stopped': true}}
    WHEN x.period > a.now.period AND (coalesce(tspan, 0) <= 0 OR x.period <= tspan / 3) AND x.power >= 0.55::DOUBLE * greatest(a.now.power, {_TINY})
         AND {_near_sql(f"(x.period / greatest(a.now.period, {_TINY}))", 0.05)} AND x.combined >= 0.98::DOUBLE * a.now.combined THEN {{'now': x, 'stopped': false}}
    ELSE a END, {{'now': pick, 'stopped': false}}).now"""
_STEP_DOWN = f"""list_reduce(l, lambda a, x: CASE
    WHEN x.period < a.period AND x.period >= 0.08::DOUBLE AND x.cnn >= a.cnn - 0.03::DOUBLE AND x.power >= 0.25::DOUBLE * greatest(a.power, {_TINY})
         AND {_near_sql(f"(a.period / greatest(x.period, {_TINY}))", 0.03)} THEN x ELSE a END, pick)"""


def selection_sql(candidates: str) -> str:
    """SQL of `select_candidate` over a relation (target, k, period, power, cnn, tspan)."""
    found = f"""(SELECT target, tspan, l, CASE WHEN l[1].cnn >= 0.95::DOUBLE THEN 'high_cnn_override' ELSE 'cnn_qualified_combined' END AS mode,
                        CASE WHEN l[1].cnn >= 0.95::DOUBLE THEN l[1] ELSE {_first_sql("list_filter(l, lambda x: x.cnn * x.penalty >= gate - 0.02::DOUBLE)", "combined")} END AS pick FROM listed)"""
    found = _step_sql(found, f"CASE WHEN pick.period < 0.10::DOUBLE THEN {_GUARD} END", "+floor_guard")
    found = _step_sql(found, _PROMOTE, "+alias_promote_longer")
    found = _step_sql(found, _STEP_DOWN, "+short_alias_guard")
    within = _first_sql("list_filter(l, lambda x: x.period <= tspan / 3)", "combined")
    found = _step_sql(found, f"CASE WHEN tspan > 0 AND pick.period > tspan / 3 THEN {within} END", "+transit_ceil_guard")
    return f"""
    WITH rated AS (SELECT *, max(lp) OVER (PARTITION BY target) AS top FROM (
        SELECT target, tspan, k, period, power, cnn, greatest(0.0::DOUBLE, least(1.0::DOUBLE, cnn)) AS c, ln(1 + greatest(power, 0.0::DOUBLE)) AS lp,
               CASE WHEN period < 0.10::DOUBLE THEN 0.40::DOUBLE ELSE 1.0::DOUBLE END AS penalty FROM ({candidates}))),
    listed AS (SELECT target, max(tspan) AS tspan, max(cnn * penalty) AS gate, list({{'k': k, 'period': period, 'power': power, 'cnn': cnn, 'penalty': penalty,
                   'hybrid': (0.7::DOUBLE * c + 0.3::DOUBLE * CASE WHEN top > 1e-9::DOUBLE THEN lp / top ELSE 1 END) * penalty,
                   'combined': pow(c + 1e-9::DOUBLE, 2) * pow(lp + 1e-9::DOUBLE, 0.1::DOUBLE) * penalty}} ORDER BY cnn DESC, k) AS l FROM rated GROUP BY target)
    SELECT target, pick.k AS k, pick.period AS period, pick.cnn AS cnn, mode,
           array_to_string(list_transform(list_sort(list_transform(l, lambda x: {{'minus': -(x.hybrid), 'k': x.k, 'period': x.period, 'cnn': x.cnn}}))[1:5],
                                          lambda x: printf('%d:%.6f:%.6f:%.6f', x.k, x.period, x.cnn, -x.minus)), ' ') AS top5
    FROM {found}"""


@query(selection_sql(v.CANDIDATE_LISTS))
def select_candidate(s, d):
    found = selection.select_candidates(v.candidate_lists(s, d))
    entry = lambda x: F.format_string("%d:%.6f:%.6f:%.6f", -x["minus_k"], x["period"], x["cnn"], x["hybrid"])
    return found.select("target", "k", "period", "cnn", "mode", F.array_join(F.transform("top5", entry), " ").alias("top5"))


# Evaluation

_HITS = f"SELECT y, score, score >= 0.5::DOUBLE AS hit FROM ({v.LABELLED_SCORES})"


@query(f"""
    SELECT tn, fp, fn, tp, round(tp / (tp + fp + 1e-12::DOUBLE), 6) AS precision, round(tp / (tp + fn + 1e-12::DOUBLE), 6) AS recall,
           round(2 * tp / (2 * tp + fp + fn + 1e-12::DOUBLE), 6) AS f1
    FROM (SELECT count(*) FILTER (NOT hit AND y = 0) AS tn, count(*) FILTER (hit AND y = 0) AS fp, count(*) FILTER (NOT hit AND y = 1) AS fn, count(*) FILTER (hit AND y = 1) AS tp FROM ({_HITS}))""")
def confusion_at_threshold(s, d):
    return rounded(evaluation.confusion_at(v.labelled_scores(s, d), 0.5), "precision", "recall", "f1")


_CURVE = f"""
    SELECT score, (sum(p) OVER w)::BIGINT AS tp, (sum(q) OVER w)::BIGINT AS fp, (sum(p) OVER ())::BIGINT AS n_pos, (sum(q) OVER ())::BIGINT AS n_neg
    FROM (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM ({v.LABELLED_SCORES}) GROUP BY score) WINDOW w AS (ORDER BY score DESC)"""


@query(_CURVE)
def score_curve(s, d):
    return evaluation.score_curve(v.labelled_scores(s, d))


@query(f"SELECT score AS threshold, round(f1, 6) AS f1 FROM (SELECT score, 2.0::DOUBLE * tp / (tp + fp + n_pos) AS f1 FROM ({_CURVE})) ORDER BY round(f1, 12) DESC, score LIMIT 1")
def pr_curve_best_f1(s, d):
    return rounded(evaluation.best_f1(evaluation.score_curve(v.labelled_scores(s, d))), "f1")


@query(f"SELECT score AS threshold, round(j, 6) AS j FROM (SELECT score, tp / n_pos::DOUBLE - fp / n_neg::DOUBLE AS j FROM ({_CURVE})) ORDER BY round(j, 12) DESC, score DESC LIMIT 1")
def roc_youden(s, d):
    return rounded(evaluation.best_youden(evaluation.score_curve(v.labelled_scores(s, d))), "j")


@query(f"""
    SELECT coalesce((SELECT score FROM ({_CURVE}) WHERE tp / (tp + fp + 1e-12::DOUBLE) >= 0.70::DOUBLE ORDER BY tp DESC, score LIMIT 1), 0.95) AS threshold""")
def precision_threshold(s, d):
    return evaluation.precision_threshold(evaluation.score_curve(v.labelled_scores(s, d)), 0.70)


@query(f"""
    SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) / count(*), 6) AS auc
    FROM ({v.LABELLED_SCORES}) a, ({v.LABELLED_SCORES}) b WHERE a.y = 1 AND b.y = 0""")
def roc_auc(s, d):
    return rounded(evaluation.roc_auc(evaluation.score_curve(v.labelled_scores(s, d))), "auc")


@query(f"""
    WITH points AS (SELECT 'best_f1' AS name, threshold FROM ({SQL['pr_curve_best_f1']}) UNION ALL SELECT 'best_youden_j', threshold FROM ({SQL['roc_youden']})
                    UNION ALL SELECT 'precision_ge_0.70', threshold FROM ({SQL['precision_threshold']}) UNION ALL SELECT 'default_0.5', 0.5::DOUBLE),
    counts AS (SELECT name, threshold, count(*) FILTER (score < threshold AND y = 0) AS tn, count(*) FILTER (score >= threshold AND y = 0) AS fp,
                      count(*) FILTER (score < threshold AND y = 1) AS fn, count(*) FILTER (score >= threshold AND y = 1) AS tp FROM ({v.LABELLED_SCORES}), points GROUP BY ALL),
    rates AS (SELECT *, tp / (tp + fp + 1e-12::DOUBLE) AS p, tp / (tp + fn + 1e-12::DOUBLE) AS r FROM counts)
    SELECT name, threshold, tn, fp, fn, tp, p AS precision, r AS recall, 2 * p * r / (p + r + 1e-12::DOUBLE) AS f1 FROM rates""")
def threshold_report(s, d):
    return evaluation.threshold_report(v.labelled_scores(s, d), 0.70)


@query(f"SELECT y, count(*) AS n, round(sum(count(*)) OVER () / (2.0::DOUBLE * count(*)), 6) AS weight FROM ({v.LABELLED_SCORES}) GROUP BY y")
def class_weights(s, d):
    return rounded(evaluation.class_weights(v.labelled_scores(s, d)), "weight")


@query(f"""
    SELECT y, round(tp / (tp + fp + 1e-12::DOUBLE), 6) AS precision, round(tp / (tp + fn + 1e-12::DOUBLE), 6) AS recall, round(2 * tp / (2 * tp + fp + fn + 1e-12::DOUBLE), 6) AS f1, tp + fn AS support
    FROM (SELECT c.y, count(*) FILTER (h.y = c.y AND h.hit::INTEGER = c.y) AS tp, count(*) FILTER (h.y <> c.y AND h.hit::INTEGER = c.y) AS fp, count(*) FILTER (h.y = c.y AND h.hit::INTEGER <> c.y) AS fn
          FROM ({_HITS}) h, (VALUES (0), (1)) c(y) GROUP BY c.y)""")
def classification_report(s, d):
    return rounded(evaluation.classification_report(v.labelled_scores(s, d), 0.5), "precision", "recall", "f1")


@query(f"""
    WITH hits AS ({_HITS}), c AS (
        SELECT y, tp / (tp + fp + 1e-12::DOUBLE) AS p, tp / (tp + fn + 1e-12::DOUBLE) AS r, tp + fn AS n
        FROM (SELECT c.y, count(*) FILTER (h.y = c.y AND h.hit::INTEGER = c.y) AS tp, count(*) FILTER (h.y <> c.y AND h.hit::INTEGER = c.y) AS fp, count(*) FILTER (h.y = c.y AND h.hit::INTEGER <> c.y) AS fn
              FROM hits h, (VALUES (0), (1)) c(y) GROUP BY c.y)),
    f AS (SELECT *, 2 * p * r / (p + r + 1e-12::DOUBLE) AS f FROM c),
    a AS (SELECT avg((hit::INTEGER = y)::INTEGER) AS right FROM hits)
    SELECT 'accuracy' AS name, round(a.right, 6) AS precision, round(a.right, 6) AS recall, round(a.right, 6) AS f1, (SELECT sum(n)::BIGINT FROM f) AS support FROM a
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(n)::BIGINT FROM f
    UNION ALL SELECT 'weighted avg', round(sum(p * n) / sum(n), 6), round(sum(r * n) / sum(n), 6), round(sum(f * n) / sum(n), 6), sum(n)::BIGINT FROM f""")
def report_averages(s, d):
    return rounded(evaluation.report_averages(v.labelled_scores(s, d), 0.5), "precision", "recall", "f1")


@query(f"""
    SELECT CASE WHEN score >= 0.895::DOUBLE THEN 'high_confidence_planet' WHEN score >= 0.88::DOUBLE THEN 'likely_planet' WHEN score >= 0.86::DOUBLE THEN 'candidate' ELSE 'reject' END AS label, count(*) AS n
    FROM ({v.LABELLED_SCORES}) GROUP BY label""")
def label_counts(s, d):
    return evaluation.label_counts(v.labelled_scores(s, d))


@query(f"""
    SELECT round(avg(-CASE WHEN y = 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END * pow(1 - q, 2) * ln(q)), 6) AS focal_loss
    FROM (SELECT y, CASE WHEN y = 1 THEN p ELSE 1 - p END AS q FROM (SELECT y, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, score)) AS p FROM ({v.LABELLED_SCORES})))""")
def focal_loss(s, d):
    return rounded(evaluation.focal_loss(v.labelled_scores(s, d)), "focal_loss")


@query(f"""
    SELECT id, y, CASE WHEN place < 0.20::DOUBLE THEN 'test' WHEN place < 0.36::DOUBLE THEN 'validation' ELSE 'train' END AS part
    FROM (SELECT *, (row_number() OVER (PARTITION BY y, slice ORDER BY u, id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY y, slice) AS place
          FROM (SELECT id, y, {v.uniform_sql('42', 'id')} AS u, floor(('0x' || substr(md5('slice42|' || id), 1, 4))::BIGINT / 4096.0)::BIGINT AS slice FROM ({v.LABELLED_SCORES})))""")
def stratified_split(s, d):
    return evaluation.stratified_split(v.labelled_scores(s, d).select("id", "y"), "id", "y")


# Windows and the classifier


@query("""
    WITH x AS (SELECT vec_id, i, embedding[i]::DOUBLE AS e FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
    SELECT vec_id, i::INTEGER AS i, round((e - avg(e) OVER w) / stddev_pop(e) OVER w, 5) AS z FROM x WINDOW w AS (PARTITION BY vec_id)""")
def window_zscore(s, d):
    w = v.table(s, d, "embeddings").select("vec_id", windows.zscored(F.col("embedding").cast("array<double>")).alias("z"))
    return w.select("vec_id", F.posexplode("z").alias("i", "z")).select("vec_id", (F.col("i") + 1).alias("i"), F.round("z", 5).alias("z"))


@query("""
    SELECT vec_id, 0.0::DOUBLE AS missing, round(stddev_pop(e), 5) AS deviation FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e FROM embeddings) GROUP BY vec_id""")
def window_stats(s, d):
    w = v.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    return windows.window_stats(w).select("vec_id", "missing", F.round("deviation", 5).alias("deviation"))


@query(f"""
    SELECT target, round(t, 6) AS t, round(f - CASE WHEN abs(phase * period) <= duration / 2 THEN 3.0::DOUBLE * sd ELSE 0 END, 6) AS f
    FROM (SELECT *, stddev_pop(f) OVER (PARTITION BY target) AS sd FROM ({v.FOLDED}))""")
def inject_transits(s, d):
    rows = v.with_ephemeris(v.series(s, d)).withColumn("mult", F.lit(3.0))
    return rounded(windows.inject_dips(rows).select("target", "t", "f"), "t", "f")


_DRAW = f"""
    SELECT target, aug, y, CASE WHEN y = 1 THEN 0.5::DOUBLE * exp({v.uniform_sql('43', 'target', 'aug')} * {float(np.log(13.7 / 0.5))!r}::DOUBLE) END AS period,
           {v.uniform_sql('44', 'target', 'aug')} AS u2, {v.uniform_sql('45', 'target', 'aug')} AS u3, {v.uniform_sql('46', 'target', 'aug')} AS u4
    FROM (SELECT *, ({v.uniform_sql('42', 'target', 'aug')} < 0.5::DOUBLE)::INTEGER AS y FROM (SELECT DISTINCT target FROM ({v.USER_SERIES})), (SELECT unnest(range(1, 7))::INTEGER AS aug))"""


@query(f"""
    SELECT target, aug, y, round(period, 6) AS period, round(u3 * period, 6) AS t0,
           CASE WHEN y = 1 THEN round(greatest(1 / 24.0::DOUBLE, least(0.5::DOUBLE, (0.01::DOUBLE + 0.07::DOUBLE * u2) * period)), 6) END AS duration,
           CASE WHEN y = 1 THEN round(2 + 8 * u4, 6) END AS mult FROM ({_DRAW})""")
def augmentations(s, d):
    return rounded(windows.augmentations(v.user_series(s, d)), "period", "t0", "duration", "mult")


@query(f"""
    WITH p AS (SELECT target, phase AS x, avg(f) AS f FROM ({v.FOLDED}) GROUP BY ALL),
    turned AS (SELECT * FROM p UNION ALL SELECT target, max(x) - 1, arg_max(f, x) FROM p GROUP BY target UNION ALL SELECT target, min(x) + 1, arg_min(f, x) FROM p GROUP BY target),
    n AS (SELECT *, lead(x) OVER w AS x1, lead(f) OVER w AS f1 FROM turned WINDOW w AS (PARTITION BY target ORDER BY x)),
    g AS (SELECT target, j, -0.5::DOUBLE + j * (1.0::DOUBLE / {windows.LENGTH - 1}) AS tick FROM (SELECT DISTINCT target FROM p), range({windows.LENGTH}) r(j))
    SELECT g.target, j::INTEGER AS j, round(n.f + coalesce((tick - n.x) / (n.x1 - n.x) * (n.f1 - n.f), 0), 6) AS level, true AS valid
    FROM g ASOF JOIN n ON g.target = n.target AND g.tick >= n.x""")
def fold_windows(s, d):
    rows = v.with_ephemeris(v.series(s, d)).withColumn("k", F.lit(1))
    found = windows.folded_windows(rows)
    return rounded(found.select("target", F.posexplode("w").alias("j", "level"), windows.valid_window(F.col("w")).alias("valid")), "level")


@query("""
    WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i, len(embedding) AS n FROM embeddings),
    y AS (SELECT *, abs(i::DOUBLE / n - 0.5::DOUBLE) <= 0.03::DOUBLE AS inside, stddev_pop(x) OVER (PARTITION BY vec_id) AS sd FROM x)
    SELECT vec_id, count(*) FILTER (inside) AS boxed, round(sum(CASE WHEN inside THEN x - 8 * CASE WHEN sd > 0 THEN sd ELSE 1 END ELSE x END), 5) AS total
    FROM y GROUP BY vec_id""")
def injected_box(s, d):
    w = F.col("embedding").cast("array<double>")
    rows = v.table(s, d, "embeddings").select("vec_id", w.alias("w"), windows.with_box(w).alias("b"))
    total = F.aggregate("b", F.lit(0.0), lambda a, x: a + x)
    boxed = F.size(F.filter(F.arrays_zip("w", "b"), lambda p: p["w"] != p["b"])).cast("long")
    return rows.select("vec_id", boxed.alias("boxed"), F.round(total, 5).alias("total"))


@query()
def cnn_score(s, d):
    w = v.table(s, d, "embeddings").select(F.col("vec_id").alias("target"), windows.zscored(F.col("embedding").cast("array<double>")).alias("w"), (F.col("label") < 5).cast("int").alias("y"))
    scored = windows.score_windows(w, windows.train_windows(w))
    return selection.polarity(scored).select(F.col("target").alias("vec_id"), "y", "score_dip", "score_bump", "score_used", "polarity_flipped")


@query()
def sweep_targets(s, d):
    """The whole sweep over the dense series, with a network trained on dips put into them."""
    return target_sweep.sweep_targets(v.series(s, d))


# Streams


@query(f"""
    SELECT count(*) AS n_rows, count(DISTINCT target) AS n_targets, round(sum(f), 2) AS total FROM ({v.USER_SERIES})""")
def stream_sweep(s, d):
    """All events through a stream of micro-batches into a results table, which is then read."""
    folder = f"{shared_folder(s)}/sweep-{uuid.uuid4().hex}"
    events = sweep.events_stream(s, f"{d}/events.parquet*", schemas.EVENTS)
    rows = lambda b: b.selectExpr("event_id", "concat('user-', user_id) AS target", "value AS f")
    sweep.sweep(events, rows, f"{folder}/results", f"{folder}/state", ["event_id"])
    done = s.read.parquet(f"{folder}/results")
    return done.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("target").alias("n_targets"), F.round(F.sum("f"), 2).alias("total"))


@query(f"SELECT target, count(*) AS n, round(sum(f), 2) AS total FROM ({v.SERIES}) GROUP BY target")
def complete_targets(s, d):
    """All events through a stream that collects each target's points in its state until they are complete; then they are read."""
    folder = f"{shared_folder(s)}/targets-{uuid.uuid4().hex}"
    sizes = v.series(s, d).groupBy("target").agg(F.count(F.lit(1)).alias("expected"))
    events = sweep.events_stream(s, f"{d}/events.parquet*", schemas.EVENTS)
    sweep.collect_targets(v.series_of(events).join(sizes, "target"), f"{folder}/points", f"{folder}/state")
    found = s.read.schema("target string, t double, f double").parquet(f"{folder}/points/batch=*")
    return found.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("f"), 2).alias("total"))


@query()
def recovery_errors(s, d):
    """How well the search finds dips put into the dense series: the copies that windows to train on are made of."""
    found = target_sweep.searched_windows(target_sweep.prepared(v.series(s, d)))
    return found.select("target", "aug", "y", "p_injected", "bls_period", "bls_power", "recovery_error")


@query("""
    WITH tried AS (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 8000)
    SELECT c_custkey FROM tried WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000) ORDER BY c_custkey LIMIT 1500""")
def probe_waves(s, d):
    """The first 1,500 customers with a large urgent order, tried in waves: a target that downloads, of 8,000 at most."""
    orders = v.table(s, d, "orders").filter("o_orderpriority = '1-URGENT' and o_totalprice > 200000").select(F.col("o_custkey").alias("target")).distinct().withColumn("ok", F.lit(True))
    targets = v.table(s, d, "customer").selectExpr("c_custkey AS target", "c_custkey AS place")
    found = datasets.probe_in_waves(targets, lambda wave: wave.join(orders, "target"), f"{shared_folder(s)}/attempts-{uuid.uuid4().hex}")
    return found.select(F.col("target").alias("c_custkey"))


@query("""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS target, count(*) AS n, round(avg(value), 6) AS level FROM events GROUP BY ALL""")
def hourly_levels(s, d):
    rows = v.table(s, d, "events").selectExpr("ts", "event_type AS target", "value AS f")
    return rounded(sweep.windowed_levels(rows), "level")


def entry(spark: SparkSession) -> DataFrame:
    """Tier counts of the smallest tables."""
    return tier_counts(spark, "/root/testdata/sf0.001")


from dimstar.plans import stored  # noqa: E402, F401  registers its queries
