"""Queries through the tables that a run leaves behind: written by the sinks, read again by the sources, whole.

Each writes to a folder of its own in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimstar.functions.runtime import shared_folder
from dimstar.operators import batch, evaluation, search, selection, series, windows
from dimstar.plans import views as v
from dimstar.plans.registry import query, rounded
from dimstar.sources import datasets, readers, schemas, writers


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Results of a run


def _appended(s: SparkSession, d: str) -> str:
    """A results table made of two batches, as two sectors' sweeps leave it."""
    path, rows = folder(s, "results"), v.scored(s, d)
    writers.append_results(rows.filter("sector <= 3"), path)
    writers.append_results(rows.filter("sector > 3"), path)
    return path


@query(f"""
    SELECT sector, target, score, NULL::VARCHAR AS label, download_status, bls_period, NULL::DOUBLE AS bls_power, polarity_flipped, morph_duty_cycle, morph_n_flags::INTEGER AS morph_n_flags, morph_flags
    FROM ({v.SCORED})""")
def results_table(s, d):
    found = s.read.schema(schemas.CHECKPOINT).parquet(_appended(s, d))
    return found.select("sector", "target", "score", "label", "download_status", "bls_period", "bls_power", "polarity_flipped", "morph_duty_cycle", "morph_n_flags", "morph_flags")


@query(f"SELECT DISTINCT sector, target FROM ({v.SCORED})")
def finished_targets(s, d):
    return readers.finished_targets(s, _appended(s, d))


@query(f"""
    WITH r AS (SELECT target, sector, score, download_status, bls_period, polarity_flipped, morph_flags FROM ({v.SCORED})),
    top AS (SELECT target, sector, score FROM r ORDER BY score DESC, target, sector LIMIT 200)
    SELECT 'summary' AS name, target, sector, score, bls_period, download_status, polarity_flipped, morph_flags FROM r
    UNION ALL SELECT 'shortlist', target, sector, score, bls_period, download_status, polarity_flipped, morph_flags FROM r WHERE score >= 0.86::DOUBLE
    UNION ALL SELECT 'high', target, sector, score, bls_period, download_status, polarity_flipped, morph_flags FROM r WHERE score >= 0.895::DOUBLE
    UNION ALL SELECT 'top', target, sector, score, NULL, NULL, NULL, NULL FROM top""")
def run_tables(s, d):
    """All rows of the four tables of a run; of the top list the columns that its order tells apart."""
    path, found = folder(s, "run"), None
    writers.write_run(v.scored(s, d), path)
    for name in ("summary", "shortlist", "high", "top"):
        rows = readers.read_checkpoint(s, f"{path}/{name}").select(F.lit(name).alias("name"), "target", "sector", "score", "bls_period", "download_status", "polarity_flipped", "morph_flags")
        if name == "top":
            rows = rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in ("bls_period", "download_status", "polarity_flipped", "morph_flags")})
        found = rows if found is None else found.unionByName(rows)
    return found


@query(f"SELECT replace(target, 'TIC ', '')::BIGINT AS tic_id, sector, score FROM ({v.SCORED}) WHERE download_status = 'ok' ORDER BY score DESC, tic_id, sector LIMIT 300")
def candidate_file(s, d):
    """The 300 first of a written candidate list, names turned into numbers."""
    path = folder(s, "candidates")
    rows = v.scored(s, d).filter("download_status = 'ok'").withColumn("bls_t0", F.lit(0.0))
    writers.write_csv(writers.conformed(rows, schemas.CHECKPOINT), path)
    return readers.read_candidates(s, path, top=300).select("tic_id", "sector", "score")


_TIERED_COLUMNS = "l_orderkey bigint, l_linenumber int, l_partkey bigint, target string, score double, tier string, tier_reasons string"


@query(f"""
    SELECT 'analysis' AS name, l_orderkey, l_linenumber, l_partkey, target, score, tier, tier_reasons FROM ({v.TIERED})
    UNION ALL SELECT 'priority', l_orderkey, l_linenumber, l_partkey, target, score, tier, tier_reasons FROM ({v.TIERED}) WHERE tier IN ('A', 'A*', 'B')""")
def analysis_tables(s, d):
    """The tiered and the priority table, with their reasons, through CSV."""
    path = folder(s, "analysis")
    tiered = batch.tier_rule(v.scored(s, d)).select([c.split()[0] for c in _TIERED_COLUMNS.split(", ")])
    writers.write_analysis(tiered, batch.priority(tiered, ["l_orderkey", "l_linenumber", "l_partkey"]), path)
    read = lambda name: readers.read_csv(s, f"{path}/{name}", _TIERED_COLUMNS).withColumn("name", F.lit(name))
    return read("analysis").unionByName(read("priority"))


@query(f"""
    WITH t AS (SELECT coalesce((SELECT score FROM (
                   SELECT score, sum(y) OVER w AS tp, count(*) OVER w AS n FROM ({v.LABELLED_SCORES}) WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
                   WHERE tp / (n + 1e-12::DOUBLE) >= 0.70::DOUBLE ORDER BY tp DESC, score LIMIT 1), 0.95::DOUBLE) AS c),
    l AS (SELECT unnest([{{'name': 'candidate', 'level': c}}, {{'name': 'likely', 'level': 0.88::DOUBLE}}, {{'name': 'high_confidence', 'level': 0.895::DOUBLE}}], recursive := true) FROM t)
    SELECT name, level, count(*) FILTER (score >= level) AS n FROM l, ({v.LABELLED_SCORES}) GROUP BY name, level""")
def stored_thresholds(s, d):
    """A fitted threshold written as settings, read back beside the defaults of the others, and how many scores reach each."""
    path, scores = folder(s, "settings"), v.labelled_scores(s, d)
    fitted = evaluation.precision_threshold(evaluation.score_curve(scores), 0.70)
    writers.write_json(fitted.select(F.col("threshold").alias("candidate_threshold")), path)
    names = ("candidate", "likely", "high_confidence")
    levels = readers.read_settings(s, path).select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"{n}_threshold").alias("level")) for n in names))).alias("l")).select("l.*")
    # three levels
    return scores.join(F.broadcast(levels), F.lit(True), "inner").groupBy("name", "level").agg(F.count_if(F.col("score") >= F.col("level")).alias("n"))


# Samples and catalogs


def _samples(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "embeddings").selectExpr("vec_id", "int(label < 5) AS label", "transform(embedding, x -> double(x)) AS w")


def _summed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("vec_id", F.size("w").alias("n"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), *more)


_TOTALS = "SELECT vec_id, (label < 5)::INTEGER AS label, len(embedding)::INTEGER AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings"


@query(f"SELECT vec_id, n, total FROM ({_TOTALS}) WHERE label = 0")
def labelled_samples(s, d):
    """The samples without a signal of a table divided by label."""
    path = folder(s, "labelled")
    writers.write_labelled(_samples(s, d), path)
    return _summed(datasets.read_backgrounds(s, path))


@query(f"SELECT vec_id, n, total, label, 64 AS window_len, 0.25::DOUBLE AS focal_alpha FROM ({_TOTALS})")
def sample_bundle(s, d):
    """All samples of a bundle, their size and labels checked against its constants."""
    path = folder(s, "bundle")
    datasets.write_bundle(_samples(s, d), {"window_len": 64, "focal_alpha": 0.25}, path)
    rows, constants = datasets.read_bundle(s, path)
    return _summed(rows, "label").join(F.broadcast(constants), F.lit(True), "inner")  # one row


@query("SELECT p_partkey AS tic_id, p_name AS pl_name, p_size::DOUBLE AS pl_orbper FROM part WHERE p_size >= 5")
def cached_catalog(s, d):
    """A catalog that is fetched once: the second reading finds the stored one and asks nothing."""
    path = folder(s, "catalog")

    def never() -> DataFrame:
        raise RuntimeError("the stored catalog wasn't used")

    datasets.read_through(s, path, lambda: v.table(s, d, "part").selectExpr("p_partkey AS tic_id", "p_name AS pl_name", "double(p_size) AS pl_orbper"))
    return datasets.read_through(s, path, never).filter("pl_orbper >= 5")


@query("""
    SELECT c_custkey, 'digits' AS name, nullif(regexp_extract(c_name, '(\\d{5,12})', 1), '')::BIGINT AS tic_id FROM customer
    UNION ALL SELECT c_custkey, 'numbers', CASE WHEN c_custkey % 10 = 0 THEN c_custkey END FROM customer""")
def catalog_ids(s, d):
    """Ids of a catalog that has names only, and of one that has numbers for some rows: then texts stay without an id."""
    rows = v.table(s, d, "customer").select("c_custkey", F.col("c_name").alias("tic_id"))
    mixed = rows.withColumn("tic_id", F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("tic_id")))
    named = lambda df, name: readers.numbers_or_digits(df, "tic_id").select("c_custkey", F.lit(name).alias("name"), "tic_id")
    return named(rows, "digits").unionByName(named(mixed, "numbers"))


# Series and candidates


@query(f"""
    SELECT target, round(t, 6) AS t, f FROM ({v.USER_SERIES}) WHERE floor(f)::BIGINT % 7 <> 0 AND floor(t * 24)::BIGINT % 5 <> 0 AND f IS NOT NULL""")
def finite_points(s, d):
    """The points of the sparse series that are numbers; every seventh flux is NaN and every fifth hour infinite."""
    broken = F.when(F.floor("f") % 7 == 0, float("nan")).when(F.floor(F.col("t") * 24) % 5 == 0, float("inf")).otherwise(F.col("f"))
    return rounded(series.finite_points(v.user_series(s, d).withColumn("f", broken)), "t")


@query(f"""
    WITH p AS (SELECT target, list(f ORDER BY t, f) AS x FROM ({v.USER_SERIES}) GROUP BY target)
    SELECT target, j::INTEGER AS j, x[j + 1] AS f FROM p, range(80) r(j)""")
def padded_series(s, d):
    """Each sparse series as 80 values: longer ones are cut, shorter ones filled up."""
    packed = v.user_series(s, d).groupBy("target").agg(F.sort_array(F.collect_list(F.struct("t", "f"))).alias("x"))
    return series.padded(packed.select("target", F.col("x.f").alias("x")), "x", 80).select("target", F.posexplode("x").alias("j", "f"))


@query(f"""
    WITH p AS (SELECT target, phase AS x, avg(f) AS f FROM ({v.FOLDED}) GROUP BY ALL),
    n AS (SELECT *, lead(x) OVER w AS x1, lead(f) OVER w AS f1 FROM p WINDOW w AS (PARTITION BY target ORDER BY x)),
    g AS (SELECT target, min(x) AS low, arg_min(f, x) AS first, j, -0.5::DOUBLE + j * (1.0::DOUBLE / {windows.LENGTH - 1}) AS tick FROM p, range({windows.LENGTH}) r(j) GROUP BY target, j)
    SELECT g.target, j::INTEGER AS j, round(CASE WHEN tick < low THEN first ELSE n.f + coalesce((tick - n.x) / (n.x1 - n.x) * (n.f1 - n.f), 0) END, 6) AS level
    FROM g ASOF LEFT JOIN n ON g.target = n.target AND g.tick >= n.x""")
def fold_windows_clamped(s, d):
    """Folded windows whose ends keep the level of the first and last point."""
    found = windows.folded_windows(v.with_ephemeris(v.series(s, d)).withColumn("k", F.lit(1)), circular=False)
    return rounded(found.select("target", F.posexplode("w").alias("j", "level")), "level")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, depth, score_bump > score_dip AS polarity_flipped, greatest(score_dip, score_bump) AS score_used
    FROM (SELECT *, (l_quantity - 25) / 10 AS depth, 0.8::DOUBLE + l_discount AS score_dip, 0.8::DOUBLE + l_tax AS score_bump FROM lineitem) WHERE abs(depth) >= 0.5::DOUBLE""")
def scored_signs(s, d):
    """Candidates deep enough to be scored, and the sign that scores more; ties go to the dip."""
    rows = v.table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "(l_quantity - 25) / 10 AS depth", "0.8D + l_discount AS score_dip", "0.8D + l_tax AS score_bump")
    return selection.polarity(selection.deep_enough(rows)).select("l_orderkey", "l_linenumber", "l_partkey", "depth", "polarity_flipped", "score_used")


@query(f"""
    SELECT target, k::INTEGER AS k, period, power, cnn AS depth FROM (
        SELECT target, period, power, cnn, row_number() OVER (PARTITION BY target ORDER BY power DESC, period, cnn) AS k FROM ({v.CANDIDATE_ROWS})) WHERE k <= 60""")
def strongest_boxes(s, d):
    """The 60 strongest boxes of each target, numbered by power."""
    rows = v.candidate_rows(s, d).select("target", "period", F.lit(0.0).alias("t0"), F.lit(0.1).alias("duration"), F.col("cnn").alias("depth"), "power")
    return search.top_per_target(rows, 60).select("target", "k", "period", "power", "depth")
