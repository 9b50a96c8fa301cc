"""Writing of results. Each is one Spark write, so a failed task leaves no half of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dimstar.sources import schemas


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """Exactly the columns of a schema: others are left out, missing ones are NULL."""
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in StructType.fromDDL(schema)))


def append_results(df: DataFrame, path: str) -> None:
    """Add result rows to a Parquet table divided by sector."""
    conformed(df, schemas.CHECKPOINT).write.mode("append").partitionBy("sector").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_run(results: DataFrame, folder: str, *, top: int = 200, shortlist: float = 0.86, high: float = 0.895) -> None:
    """All results, the `top` by score, and those from two thresholds on, as four CSV tables off one cached input."""
    kept = results.cache()
    try:
        write_csv(kept, f"{folder}/summary")
        write_csv(kept.orderBy(F.col("score").desc_nulls_last(), "target", "sector").limit(top), f"{folder}/top")
        write_csv(kept.filter(F.col("score") >= shortlist), f"{folder}/shortlist")
        write_csv(kept.filter(F.col("score") >= high), f"{folder}/high")
    finally:
        kept.unpersist()


def write_analysis(tiered: DataFrame, priority: DataFrame, folder: str) -> bool:
    """The tiered table, and the priority table if it has rows; says whether it had."""
    write_csv(tiered, f"{folder}/analysis")
    if priority.isEmpty():
        return False
    write_csv(priority, f"{folder}/priority")
    return True


def write_labelled(df: DataFrame, path: str) -> None:
    """Samples as Parquet divided by label; array columns stay arrays."""
    df.write.mode("overwrite").partitionBy("label").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A small table (settings, a threshold report) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
