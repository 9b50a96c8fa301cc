"""Chat formatting: cumulative snapshots of conversations are collapsed, and the maximal ones are rendered.

Logs often hold a conversation once per turn. Each turn's hash depends on its place, role and text; running sums of two such hashes
give every turn prefix a rolling 128-bit hash. A conversation whose whole hash is that of a proper prefix of another one is a
snapshot: an anti-join drops it. Of conversations with the same turns, the one with the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dimstar.functions.runtime import materialize

# Markers of the rendered format.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return conversations.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).filter("id is not null and turn is not null")


def prefixes(turns: DataFrame) -> DataFrame:
    """(id, i, last, h1, h2): the rolling hash of the first i turns of each conversation; last marks the whole conversation."""
    order = Window.partitionBy("id").orderBy("turn", "role", "text")
    placed = turns.select("id", "turn", "role", "text", F.row_number().over(order).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("id")).alias("n"))
    wide = lambda seed: F.xxhash64(F.lit(seed), "i", "role", "text").cast("decimal(38,0)")
    hashed = placed.select("id", "i", (F.col("i") == F.col("n")).alias("last"), wide(1).alias("a"), wide(2).alias("b"))
    running = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.select("id", "i", "last", F.sum("a").over(running).alias("h1"), F.sum("b").over(running).alias("h2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(id) of the conversations that are kept."""
    known = materialize(prefixes(turns), "turn-prefixes")
    whole = known.filter("last").groupBy("h1", "h2", "i").agg(F.min("id").alias("id"))  # one of each set of equal conversations
    inner = known.filter("not last").select("h1", "h2", "i").distinct()
    return whole.join(inner, ["h1", "h2", "i"], "left_anti").select("id")


def render_conversations(
    conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per maximal conversation: id_col, n_turns, text (rendered turns in order, each with its role).

    Turns are ordered by (turn, role, text); a null role or text counts as empty; rows with a null id or turn are left out. Repeated
    rows are turns of their own. Markers inside a text are written with a space after "<", so they can't end a turn. Other columns
    aren't read; an empty table gives no rows. The turns of one conversation have to fit into one row, as the result is one.
    """
    turns = _turns(conversations, id_col, turn_col, role_col, text_col)
    kept = turns.join(maximal_conversations(turns), "id", "left_semi")
    plain = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit(TURN_START), plain("role"), F.lit("\n"), plain("text"), F.lit(TURN_END + "\n"))
    ordered = kept.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("turns"))
    return ordered.select(
        F.col("id").alias(id_col), F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.line"), "").alias("text")
    )
