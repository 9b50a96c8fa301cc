"""Reading of series, catalogs, candidate lists and settings. Paths can be in any store that Spark reads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dimstar.functions.rules import cascade_id, simple_id, target_number, tidy
from dimstar.sources import schemas


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, by column name: columns of the schema that the file lacks are NULL, others are left out.

    NaN and infinite numbers become NULL. Raises ValueError for a missing required column.
    """
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in required or [] if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    fields = StructType.fromDDL(schema)

    def typed(field) -> Column:
        if field.name not in raw.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        text = F.trim(F.col(field.name))
        kind = field.dataType.simpleString()
        value = tidy(text.try_cast("double")) if kind == "double" else text.try_cast("double").try_cast(kind) if kind in ("int", "bigint") else text if kind == "string" else text.try_cast(kind)
        return value.alias(field.name)

    return raw.select([typed(f) for f in fields])


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CHECKPOINT, ["target"])


def read_candidates(spark: SparkSession, path: str, top: int | None = None) -> DataFrame:
    """(tic_id, sector, ...) of a priority list with names such as TIC 123 in target; the first `top` by score."""
    rows = read_csv(spark, path, schemas.CHECKPOINT, ["target", "sector", "bls_period", "bls_t0", "bls_duration"])
    found = rows.withColumn("tic_id", target_number(F.col("target"))).select("tic_id", "sector", "score", "bls_period", "bls_t0", "bls_duration")
    return found.orderBy(F.col("score").desc_nulls_last(), "tic_id", "sector").limit(top) if top else found


def finished_targets(spark: SparkSession, path: str) -> DataFrame:
    """The distinct (sector, target) of a results table; empty if there is none yet."""
    empty = spark.createDataFrame([], "sector int, target string")
    return spark.read.parquet(path).select("sector", "target").distinct() if exists(spark, path) else empty


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """One row of settings: each value of the JSON file, or its default. Without a file, one with the defaults is written."""
    default = {k: F.lit(v) for k, v in schemas.CONFIG_DEFAULTS.items()}
    if not exists(spark, path):
        spark.range(1).select(*(v.alias(k) for k, v in default.items())).coalesce(1).write.json(path)
    found = spark.read.schema(schemas.CONFIG).option("multiLine", True).json(path).limit(1)
    one = spark.range(1).select(F.lit(1).alias("one"))
    return one.join(F.broadcast(found), F.lit(True), "left").select(*(F.coalesce(F.col(k), v).alias(k) for k, v in default.items()))


def confirmed_objects(objects: DataFrame) -> DataFrame:
    """Distinct ids of objects with the disposition CP, in any case; blank and "nan" ids are left out."""
    rows = objects.filter(F.upper(F.trim("tfopwg_disp")) == "CP").select(F.trim("tidstr").alias("tidstr"))
    return rows.filter((F.col("tidstr") != "") & (F.lower("tidstr") != "nan")).distinct()


def usable_planets(catalog: DataFrame, *, span: float = 27.4, facility: str | None = None, top: int = 2000) -> DataFrame:
    """Planets with an id and a finite period that fits twice into the span, by id, period and name; the first `top`."""
    rows = catalog.withColumn("pl_orbper", tidy(F.col("pl_orbper"))).filter("tic_id is not null and pl_orbper is not null")
    rows = rows.filter(F.col("pl_orbper") <= 0.5 * span)
    if facility:
        rows = rows.filter(F.upper("disc_facility").startswith(facility.upper()))
    return rows.orderBy("pl_orbper", "tic_id", "pl_name").limit(top)


def numbers_or_digits(df: DataFrame, column: str) -> DataFrame:
    """`df` with the column as a number; only if no value of the whole table is one, the first 5 to 12 digits of each text are."""
    number = F.col(column).try_cast("bigint")
    any_number = df.agg((F.count(number) > 0).alias("any_number"))  # one row
    digits = F.regexp_extract(F.col(column).cast("string"), r"(\d{5,12})", 1)
    fallback = F.when(digits != "", digits.try_cast("bigint"))
    return df.crossJoin(F.broadcast(any_number)).withColumn(column, F.when(F.col("any_number"), number).otherwise(fallback)).drop("any_number")


def first_readable(spark: SparkSession, tables: list[str], column_sets: list[list[str]], conditions: list[str]) -> DataFrame:
    """The first combination of table, columns and condition that resolves, tried in this order; raises the last error."""
    error: Exception = ValueError("nothing to try")
    for name in tables:
        for columns in column_sets:
            for condition in conditions:
                try:
                    found = spark.table(name).where(condition).select(*columns)
                    found.schema
                    return found
                except AnalysisException as problem:
                    error = problem
    raise error


def wanted_observations(observations: DataFrame, *, sector: int | None = None, exposures=(20, 120), authors=("SPOC",)) -> DataFrame:
    """Observations of a sector with a wanted exposure (rounded) by a wanted author. Filters on stored columns reach the scan."""
    rows = observations
    if sector is not None:
        rows = rows.filter(F.col("sequence_number") == sector)
    if authors:
        rows = rows.filter(F.col("provenance_name").isin(*authors))
    exposure = F.rint(tidy(F.col("t_exptime").try_cast("double"))).cast("bigint")
    return rows.filter(exposure.isin(*exposures)) if exposures else rows


def observed_ids(observations: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct ids found in any of the columns that are there, by the cascade of patterns."""
    there = [F.col(c).cast("string") for c in columns if c in observations.columns]
    found = observations.select(F.explode(F.array(*map(cascade_id, there))).alias("tic_id"))
    return found.filter("tic_id is not null").distinct()


def searched_ids(found: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct ids of the first of the columns that is there."""
    first = next(c for c in columns if c in found.columns)
    return found.select(simple_id(F.col(first).cast("string")).alias("tic_id")).filter("tic_id is not null").distinct()


def preferred_products(products: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """One product per (target, sector): the pipeline's with the wanted exposure first, then the pipeline's, then any; then by author,
    exposure and the columns `ties`, which should tell all products apart."""
    rank = F.when((F.col("author") == "SPOC") & (F.col("exptime") == 120), 0).when(F.col("author") == "SPOC", 1).otherwise(2)
    w = Window.partitionBy("target", "sector").orderBy(rank, "author", "exptime", *ties)
    return products.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def patch_pool(patches: list[DataFrame], needed: int, per_patch: int, seed: int = 42) -> DataFrame:
    """At most `needed` distinct targets from several searches, in a seeded order.

    At most `per_patch` of each search count, those with the smallest seeded hashes, and no search after the one that completes the
    pool. A target belongs to the first search that has it; null targets are left out.
    """
    if not patches:
        raise ValueError("no patches")
    place = F.xxhash64("target", F.lit(seed))
    rows = None
    for i, p in enumerate(patches):
        part = p.select("target").filter("target is not null").distinct().orderBy(place, "target").limit(per_patch).withColumn("patch", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    own = rows.groupBy("target").agg(F.min("patch").alias("patch"))
    counts = own.groupBy("patch").agg(F.count(F.lit(1)).alias("n"))  # a row for each search
    before = F.coalesce(F.sum("n").over(Window.orderBy("patch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = counts.withColumn("before", before).filter(F.col("before") < needed).select("patch")
    return own.join(F.broadcast(asked), "patch").select("target").orderBy(place, "target").limit(needed)


def background(rows: DataFrame, label: str = "label") -> DataFrame:
    """The rows without a signal (label 0); a missing label isn't one."""
    return rows.filter(F.col(label) == 0)
