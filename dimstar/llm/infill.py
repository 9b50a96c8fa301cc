"""Fill-in-middle arrangements of texts, with SQL functions only.

A text is cut into units by regexp_extract_all, and at two places given by groups of the hexadecimal SHA-256 of seed and id. The
pieces are put together by slice and array_join, behind sentinels. Texts that contain a sentinel stay plain, and sentinels can't
overlap, so splitting an arranged text at its sentinels gives exactly the three pieces back.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")

#: One code point, line feeds included.
CODE_POINT = "(?s)."


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if no two of them can share characters of a text; else ValueError."""
    if len(set(sentinels)) < 3 or not all(sentinels):
        raise ValueError("three different sentinels that aren't empty are needed")
    for a, b in itertools.product(sentinels, repeat=2):
        if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
            raise ValueError(f"sentinels {a!r} and {b!r} can overlap")
    return sentinels


def _draw(seed: int, id_col: Column, group: int) -> Column:
    """The `group`-th eight hexadecimal digits of the hash of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    unit: str = CODE_POINT,
    per_hundred: int = 90,
    spm_per_hundred: int = 20,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """One row per row of `docs`: id_col, n (units), form, prefix_chars, middle_chars (code points, null if plain), output.

    form is plain for about 100 - per_hundred of a hundred texts, for empty ones and those with a sentinel in them; of the rest,
    spm_per_hundred of a hundred are spm (suffix first), the others psm (prefix first). `unit` is a pattern whose matches are the units
    a text is cut between; they have to cover all of it. A null text counts as empty, a null id as an empty one in the hash;
    repeated rows get equal results. Other columns aren't read; an empty table gives no rows. The units of one text are an array in one
    row, about 60 bytes a unit while it is worked on.
    """
    before, after, between = _checked(sentinels)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = F.lit(False)
    for s in sentinels:
        found = found | F.col("text").contains(s)
    units = rows.select(
        "id",
        "text",
        F.regexp_extract_all("text", F.lit(unit), F.lit(0)).alias("units"),
        *(_draw(seed, F.col("id"), k).alias(f"h{k + 1}") for k in range(4)),
    )
    cut = lambda h: F.pmod(F.col(h), F.size("units").cast("long") + 1).cast("int")
    plain = (F.col("text") == "") | found | (F.pmod(F.col("h3"), F.lit(100)) >= per_hundred)
    form = F.when(plain, "plain").when(F.pmod(F.col("h4"), F.lit(100)) < spm_per_hundred, "spm").otherwise("psm")
    cuts = units.select("id", "text", "units", form.alias("form"), F.least(cut("h1"), cut("h2")).alias("p"), F.greatest(cut("h1"), cut("h2")).alias("q"))
    piece = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    pieces = cuts.select(
        "id",
        "text",
        "form",
        F.size("units").cast("long").alias("n"),
        piece(F.lit(1), F.col("p")).alias("prefix"),
        piece(F.col("p") + 1, F.col("q") - F.col("p")).alias("middle"),
        piece(F.col("q") + 1, F.size("units") - F.col("q")).alias("suffix"),
    )
    psm = F.concat(F.lit(before), "prefix", F.lit(after), "suffix", F.lit(between), "middle")
    spm = F.concat(F.lit(after), "suffix", F.lit(before), "prefix", F.lit(between), "middle")
    return pieces.select(
        F.col("id").alias(id_col),
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that `fill_in_middle` made `output` of; null where one of both is null."""
    parts = F.split(output, "|".join(re.escape(s) for s in _checked(sentinels)), -1)
    part = lambda k: F.element_at(parts, k)  # noqa: E731  the first part, before all sentinels, is empty
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(part(2), part(4), part(3)))
        .when(form == "spm", F.concat(part(3), part(4), part(2)))
    )
