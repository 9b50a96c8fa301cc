"""Removal of boilerplate lines: those that many distinct sites have.

HyperLogLog sketches of the sites per line digest are merged by aggregation. Estimates far from the threshold decide at once; lines
near it get an exact distinct count. Lines of `least_sites` or more sites are taken out of every text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimstar.functions.runtime import materialize
from dimstar.llm.skew import few_bytes, split_join

#: Standard error of a sketch with 2**LG_K registers is about 1.04 / 2**(LG_K / 2); BAND is more than six of them.
LG_K, BAND = 12, 0.10


def _digest(line):
    return F.unhex(F.sha2(line, 256))


def _among(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of `lines` with one of the digests: by broadcast if these take few bytes; else a line that is in many texts is dealt to several tasks."""
    return lines.join(F.broadcast(chosen), "digest", "left_semi") if few_bytes(chosen) else split_join(lines, chosen, "digest")


def common_lines(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", least_sites: int = 5) -> DataFrame:
    """(digest) of the lines that `least_sites` or more distinct sites have. Blank lines and null sites don't count.

    Lines of a single site, which most are, are told by the least and the greatest one; only the others get sketches. With
    `least_sites` of 1 or less, a line of one site is common, too.
    """
    lines = docs.select(F.col(site_col).alias("site"), F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    lines = lines.filter("site is not null and trim(line) != ''").select(_digest(F.col("line")).alias("digest"), F.col("site").cast("string").alias("site"))
    ends = lines.groupBy("digest").agg(F.min("site").alias("least"), F.max("site").alias("greatest"))
    if least_sites < 2:
        return materialize(ends.select("digest"), "common-lines")
    several = materialize(ends.filter("least != greatest").select("digest"), "line-several")
    # one row per task and line goes to the merge of the sketches
    seen = _among(lines, several).groupBy("digest").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    spread = seen.select("digest", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = materialize(spread.filter(F.col("sites") >= (1 - BAND) * least_sites - 1), "line-spread")
    far = F.col("sites") > (1 + BAND) * least_sites + 1
    near = spread.filter(~far).select("digest")
    # one row for each line and site: a near-threshold line has few of them, however often it occurs
    exact = _among(lines, near).distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= least_sites)
    return materialize(spread.filter(far).select("digest").unionByName(exact.select("digest")), "common-lines")


def drop_common_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least_sites: int = 5) -> DataFrame:
    """One row per row of `docs`: id_col, text (without the common lines), n_lines, n_removed.

    Lines end at line feeds and are told apart by their SHA-256. Blank lines stay. A null text stays null, with 0 lines;
    the empty text has one. Rows with a null site don't add to a line's sites, but lose common lines like others. Repeated rows are
    treated alike. Other columns aren't read; an empty table gives no rows. A text's common lines are told by their places, which are
    taken from all its places by a hash set: the work grows with its lines.
    """
    common = common_lines(docs, text_col=text_col, site_col=site_col, least_sites=least_sites)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = rows.select("id", F.xxhash64("text").alias("of"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    hit = _among(lines.select("id", "of", "place", _digest(F.col("line")).alias("digest")), common)
    # the places of one text: no more than it has lines
    found = hit.groupBy("id", "of").agg(F.collect_set("place").alias("common")).withColumnRenamed("id", "own")
    same = F.col("id").eqNullSafe(F.col("own")) & (F.xxhash64("text") == F.col("of"))
    joined = rows.join(found, same, "left").select("id", "text", "common")
    # bound once for a text, not once for each of its lines
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    places = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("common"))
    kept = once(F.split("text", "\n"), lambda parts: once(F.struct(parts.alias("parts"), places(parts).alias("places")), lambda x: F.transform(x["places"], lambda i: F.get(x["parts"], i))))
    none = F.col("common").isNull()
    out = joined.select(
        F.col("id").alias(id_col),
        F.when(none, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("common"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return out.withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long")))
