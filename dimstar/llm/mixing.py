"""Mixing of sources to target weights by weighted sampling without replacement, with DataFrame operations only.

1. Each document has a size in words and an exponential key, -ln(u) / weight with u from the hash of its id: documents in ascending
   order of keys are a weighted sample without replacement (Efraimidis and Spirakis).
2. Each source gets a target by its weight; targets above `most` times the source's size are cut, and what that frees is shared anew.
3. A source is taken in complete epochs first. The rest of its target is taken in order of keys, up to a running sum of sizes; the
   document at the end is taken up to the word that reaches the target.

Running sums go over ranges of (source, key), so a source with most of all rows is many ranges: sums of whole ranges give the offset
of each range, and each range adds up its own rows. Sources are ranked in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimstar.functions.runtime import materialize
from dimstar.llm.skew import attach_groups

#: Words, and the letters that a weight is made of.
WORD, NO_LETTER = r"[^\x20\x09-\x0D]+", r"[^\p{L}\x20]"

#: Weights of documents are at least this.
LEAST_WEIGHT = 0.000001


def letter_weight(text: Column) -> Column:
    """Weight of a document from its text: 0.05 and, of 0.95, the squared share of letters and spaces in its characters."""
    whole = F.char_length(text)
    share = (whole - F.regexp_count(text, F.lit(NO_LETTER))).cast("double") / F.greatest(whole, F.lit(1)).cast("double")
    return F.lit(0.05) + F.lit(0.95) * share * share


def _uniform(id_col: Column, seed: int) -> Column:
    """A number between 0 and 1, both excluded, from 48 bits of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def in_ranges(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """`rows` with the number `part` of their range of `order`; ranges ascend with part."""
    return materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), label)


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(of, weight): the sources `of` in ascending order get the weights in turn."""
    ranged = in_ranges(sources.select("of"), ["of"], "mix-sources")
    before, offsets = 0, {}
    for part, n in sorted(ranged.groupBy("part").count().collect()):  # one row for each range
        offsets[part], before = before, before + n
    place = F.row_number().over(Window.partitionBy("part").orderBy("of")) - 1
    if offsets:
        place = place + F.element_at(F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair)), F.col("part"))
    nth = F.pmod(place, F.lit(len(weights))) + 1
    return ranged.select("of", F.element_at(F.array(*map(F.lit, weights)), nth.cast("int")).cast("decimal(18,6)").alias("weight"))


def capped_targets(sources: DataFrame, most: int) -> DataFrame:
    """`sources` (of, weight, source_size, ...) with their target: shares of all sizes by weight, at most `most` times their own size.

    Each round shares what the capped sources leave among the others; a source that is above its bound is capped from then on. Two
    sums go to the driver in each round. Weights are decimals, so that sums don't depend on the order.
    """
    exact = "decimal(38,6)"
    cap = (F.col("source_size") * most).cast(exact)
    weight = F.col("weight").cast(exact)
    total, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("decimal(38,0)"), F.coalesce(F.sum("weight"), F.lit(0)).cast(exact)).first()
    rest, live, capped = total, weights, F.lit(False)
    while live:
        share = (F.col("weight").cast("double") * F.lit(float(rest))) / F.lit(float(live))
        capped = share > cap.cast("double")
        used, left = sources.agg(
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)).cast(exact), F.coalesce(F.sum(F.when(~capped, weight)), F.lit(0)).cast(exact)
        ).first()
        if left == live:
            break
        rest, live = total - used, left
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(live or 1))
    return sources.withColumn("target", F.when(capped, cap.cast("double")).otherwise(share))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: DataFrame | tuple[int, ...] = (5, 2, 1),
    quality: Column | None = None,
    most: int = 3,
    seed: int = 1,
) -> DataFrame:
    """One row per row of `docs`: id_col, size (words), source_size, target, taken (words, repeats counted), epochs (complete ones).

    `weights` is a table (source, weight) or weights that the sources, in ascending order of code points and null last, get in turn;
    a source without a weight in the table has weight 0. `quality` is a column expression over `docs`, by default `letter_weight`; null,
    NaN and values below LEAST_WEIGHT count as that. A null text has size 0, a null source is a source of its own, a null id counts
    as empty in the hash. Rows with equal ids are told apart by a hash of their text; equal rows are interchangeable, so results agree
    between runs. Other columns aren't read but by `quality`; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    weight = letter_weight(text) if quality is None else quality.cast("double")
    weight = F.greatest(F.coalesce(F.nanvl(weight, F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    of = lambda c: F.coalesce(F.concat(F.lit("0"), F.col(c).cast("string")), F.lit("1"))  # noqa: E731  null last
    rows = docs.select(
        F.col(id_col).alias("id"),
        of(source_col).alias("of"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (-F.log(_uniform(F.col(id_col), seed)) / weight).alias("key"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("nth"),
    )
    order = ["of", "key", "id", "hash", "nth"]
    ranged = in_ranges(materialize(rows, "mix-sizes"), order, "mix-ranges")

    sums = materialize(ranged.groupBy("of", "part").agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("rows")), "mix-sums")
    sources = materialize(sums.groupBy("of").agg(F.sum("sum").alias("source_size"), F.sum("rows").alias("rows")), "mix-totals")
    if isinstance(weights, DataFrame):
        given = weights.groupBy(of("source").alias("of")).agg(F.sum(F.col("weight").cast("decimal(18,6)")).cast("decimal(18,6)").alias("weight"))
        shares = sources.join(given, "of", "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("decimal(18,6)")))
    else:
        shares = sources.join(cyclic_weights(sources, weights), "of")
    targets = capped_targets(materialize(shares, "mix-weights"), most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))

    # sums of the ranges before, then of the rows before in the range
    earlier = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("of", "part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    before = Window.partitionBy("of", "part").orderBy("key", "id", "hash", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(offsets, ["of", "part"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    total = sources.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    whole = attach_groups(placed, targets, "of", "rows", total)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before")))
    return whole.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "epochs"
    )


def mixed_texts(docs: DataFrame, mix: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, copy, text) of each copy that `mix` takes: whole texts, then the first words of those that are taken in part.

    `mix` has the columns of `mix_sources`; its ids are taken as unique and not null. Texts without words are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    taken = mix.filter("taken > 0").select(F.col(id_col).alias("id"), "size", "taken")
    copies = rows.join(taken, "id").withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr("int((taken - 1) div size)"))))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    # each word with the blanks before it
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), words.cast("int")), "")
    return copies.select(F.col("id").alias(id_col), "copy", F.when(words == F.col("size"), F.col("text")).otherwise(first).alias("text"))
