"""One failing group doesn't fail its job: grouped Arrow functions whose errors become rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Characters of an error's text that are kept.
TEXT = 120


def error_text(error: BaseException) -> str:
    """Kind and text of an error in one line."""
    return f"{type(error).__name__}: {error}".replace("\n", " ").strip()[:TEXT]


def with_error(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("error", StringType())])


def guarded(kernel: Callable[[pa.Table], pa.Table], keys: list[str]) -> Callable[[pa.Table], pa.Table]:
    """`kernel` with the column error added: null in its rows; if it raises, one row with the group's keys and the error's text.

    The other columns of that row are null. What the interpreter itself raises to end a task (KeyboardInterrupt, SystemExit) isn't caught.
    """

    def run(group: pa.Table) -> pa.Table:
        try:
            found = kernel(group)
            return found.append_column("error", pa.nulls(found.num_rows, pa.string()))
        except Exception as error:  # the group's own result
            return pa.table({k: group.column(k).slice(0, 1) for k in keys} | {"error": pa.array([error_text(error)])})

    return run


def completed(run: Callable[[pa.Table], pa.Table], names: list[str], types: dict[str, pa.DataType]) -> Callable[[pa.Table], pa.Table]:
    """`run` with the columns that an error's row lacks added as nulls, all in the order of `names`."""

    def whole(group: pa.Table) -> pa.Table:
        found = run(group)
        missing = [n for n in names if n not in found.column_names]
        for n in missing:
            found = found.append_column(n, pa.nulls(found.num_rows, types.get(n, pa.null())))
        return found.select(names)

    return whole


def apply_isolated(grouped, keys: list[str], kernel: Callable[[pa.Table], pa.Table], schema: StructType, isolate: bool = True) -> DataFrame:
    """`grouped.applyInArrow(kernel, schema)`; with `isolate` its errors are rows, and the result has the column error."""
    if not isolate:
        return grouped.applyInArrow(kernel, schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    types = {f.name: f.type for f in to_arrow_schema(schema)}
    names = [*schema.names, "error"]
    return grouped.applyInArrow(completed(guarded(kernel, keys), names, types), with_error(schema))


def failures(df: DataFrame, key: str = "target") -> DataFrame:
    """(key, error): one row for each key with a failed group, with its least text."""
    return df.filter("error is not null").groupBy(key).agg(F.min("error").alias("error"))


def successes(df: DataFrame, failed: DataFrame, key: str = "target") -> DataFrame:
    """The rows of the keys that aren't in `failed`, without the column error."""
    rows = df.filter("error is null").drop("error")
    return rows.join(failed.select(F.col(key).alias("_failed")), F.col(key).eqNullSafe(F.col("_failed")), "left_anti")
