"""Joins from rows to per-group results that stay even when one group holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

#: A group is hot from this share of all rows on, so there are at most this many hot groups and their broadcast is bounded.
HOT_GROUPS = 1024

#: A key with more rows than this is dealt to several tasks, where not more than MOST_SPLIT keys would be; these are broadcast.
ROWS_PER_TASK, MOST_SPLIT = 2_000, 100_000

#: Rows are broadcast up to this many bytes, counted before; beyond it, the join shuffles.
BROADCAST_BYTES = 32_000_000


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, hot: int = HOT_GROUPS) -> DataFrame:
    """Inner join of `rows` with `groups` (one row per `key`, `size` rows of `rows` each, `total` in all).

    Groups with at least total / hot rows are at most `hot` in number: their keys are read by the driver, and they are broadcast. The
    rest are shuffled by key, and none of them has more than total / hot rows, or half of ROWS_PER_TASK. Rows whose key is null or in no group are left out.
    Group rows are taken to be short (keys, ids and counts); `groups` is read twice.
    """
    large = (F.col(size) * hot >= F.lit(total)) & (F.col(size) > ROWS_PER_TASK // 2)
    keys = [r[0] for r in groups.filter(large).select(key).collect()]
    if not keys:
        return rows.join(groups, key)
    few = rows.filter(F.col(key).isin(keys)).join(F.broadcast(groups.filter(large)), key)
    return few.unionByName(rows.filter(~F.col(key).isin(keys)).join(groups.filter(~large), key))


def split_join(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """Join of `rows` with `side` (one row per `key`) in which a hot key's rows are dealt to several tasks.

    A key with more than ROWS_PER_TASK rows has its row of `side` copied once for each task its rows are dealt to. These keys are
    read by the driver; where they would be more than MOST_SPLIT, only keys with ten times as many rows count as hot, and so on. Keys
    are counted in `counted`, or `rows`, which is then computed twice. `how` is inner or left; a null key matches nothing.
    """
    counts = (rows if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col(key).isNotNull())
    most, keys = ROWS_PER_TASK, None
    while keys is None or len(keys) > MOST_SPLIT:
        most = most if keys is None else 10 * most
        keys = counts.filter(F.col("n") > most).limit(MOST_SPLIT + 1).collect()
    if not keys:
        return rows.join(side, key, how)
    deals = [(k, -(-n // most)) for k, n in keys]
    hot = F.broadcast(rows.sparkSession.createDataFrame(deals, StructType([counts.schema[key], StructField("deals", IntegerType())])))
    others = [c for c in rows.columns if c != key] or [key]
    dealt = rows.join(hot, key, "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64(*others), F.col("deals")).cast("int"), F.lit(0))).drop("deals")
    copied = side.join(hot, key, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
    return dealt.join(copied, [key, "deal"], how).drop("deal")


def few_bytes(df: DataFrame, bound: int = BROADCAST_BYTES) -> bool:
    """Do the rows of `df` take at most `bound` bytes, at 16 and what its texts take for each? Stops counting soon after the bound."""
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    size = sum(long, F.lit(16 * max(1, len(df.columns)))).cast("long")
    return (df.limit(bound // 16 + 1).agg(F.sum(size)).first()[0] or 0) <= bound


def keep_ids(rows: DataFrame, ids: DataFrame, id_col: str, how: str, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Rows whose id is ("left_semi") or is not ("left_anti") in `ids`: by broadcast if these take few bytes, else by a shuffle."""
    return rows.join(F.broadcast(ids) if few_bytes(ids, bound) else ids, id_col, how)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, as what is made of short texts can be long; `ship_code` bounds the bytes that arrive."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
