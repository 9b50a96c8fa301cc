"""Exact deduplication by skew-safe combining, with DataFrame operations only.

1. Deduplicate locally: equal texts of a task meet in the map-side part of the first aggregation.
2. Merge salted digest groups: (digest, salt, text) groups, so that a text with a third of all rows is spread over the salts.
3. Combine the salts' winners globally: (digest, text) groups of at most `salts` rows.

The text itself is a grouping key at each stage, so contents are compared in full and a shared digest never joins two texts.
Rows then get their group's result by digest alone; digests with several texts (none are known for SHA-256) are told apart by text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimstar.functions.runtime import materialize
from dimstar.llm.skew import attach_groups, keep_ids


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _combine(rows: DataFrame, pick, salts: int) -> DataFrame:
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    merged = salted.groupBy("digest", "salt", "text").agg(pick("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return merged.groupBy("digest", "text").agg(pick("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    salts: int = 16,
    digest: Callable[[Column], Column] = _sha256,
) -> DataFrame:
    """One row per row of `docs`: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical; null counts as the empty text, and all empty texts are one group. keep_id is the
    largest (or, with keep="smallest", the smallest) id of the group that isn't null. Repeated rows (same id and text) are all
    reported, with the same result. A group whose ids are all null has keep_id null and counts as kept. Other columns of `docs`
    aren't read. An empty table gives an empty result.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be largest or smallest")
    pick = F.max if keep == "largest" else F.min
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    by_digest = _combine(rows, pick, salts).groupBy("digest").agg(
        pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("n_texts")
    )
    winners = materialize(by_digest, "exact-winners")
    total, most_texts = winners.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.coalesce(F.max("n_texts"), F.lit(0))).first()

    sha = _sha256(F.col("text")).alias("text_sha256")
    plain = winners.filter("n_texts = 1").drop("n_texts")
    found = attach_groups(rows.select("id", "digest", sha), plain, "digest", "group_size", total)
    if most_texts > 1:
        shared = winners.filter("n_texts > 1").select("digest")
        mixed = rows.join(shared, "digest", "left_semi")
        told = mixed.join(_combine(mixed, pick, salts), ["digest", "text"])
        found = found.unionByName(told.select("id", "digest", sha, "keep_id", "group_size"))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", salts: int = 16) -> DataFrame:
    """One row of `docs` for each text, with the id that `exact_groups` keeps; columns as they were.

    Of repeated rows (same id and text) one stays, whichever; a row with a null id stays only if no row of its text has an id, and then
    one of them. Rows of one id with different texts are told apart. Null counts as the empty text; an empty table gives no rows.
    """
    groups = exact_groups(docs, id_col=id_col, text_col=text_col, keep=keep, salts=salts)
    mark = lambda sha: F.unhex(F.sha2(F.concat(F.coalesce(F.concat(F.lit("0"), F.col(id_col).cast("string")), F.lit("1")), F.lit(":"), sha), 256))
    own = "_row_of_exact_dedup"
    # rows that go, and those that are there several times
    rows = groups.select(mark(F.col("text_sha256")).alias(own), "kept").groupBy(own).agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    found = materialize(rows.filter("not kept or rows > 1"), "exact-dropped")
    marked = docs.withColumn(own, mark(_sha256(F.coalesce(F.col(text_col), F.lit("")))))
    left = keep_ids(marked, found.filter("not kept").select(own), own, "left_anti")
    again = found.filter("kept").select(own)
    if again.limit(1).count():
        once = keep_ids(left, again, own, "left_semi").dropDuplicates([own])
        left = keep_ids(left, again, own, "left_anti").unionByName(once)
    return left.drop(own)
