"""Chat formatting with cumulative snapshots collapsed.

Logs often hold a conversation again and again as it grows. Every turn gets a rolling hash of the conversation up to it:
the exclusive-or of the hashes of (place, role, text) so far, in two independent halves of 64 bits. A conversation whose
whole hash is a shorter prefix hash of another one is a snapshot of it and goes, by an anti-join; of equal conversations
the smallest id stays. Texts take part only in the last step, for what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from farspark.operators.settle import settle

#: How a turn is written.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def render(turns: Column) -> Column:
    """A conversation as one text; a null role is `user`, a null text empty."""
    line = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("user")), F.lit(MIDDLE),
                              F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))
    return F.array_join(F.transform(turns, line), "")


def maximal(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations that no longer one begins with: key, `n_turns`, `n_copies` (conversations equal to it, itself included).

    Turns are ordered by `turn`, then role, then text; nulls come first, and repeated rows are turns of their own. Role and text
    count as `render` writes them. A null key is one conversation; it yields to an equal one with a key.
    """
    rows = turns.select(
        F.col(key).alias("_key"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("user")).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"))
    order = W.partitionBy("_key").orderBy("_turn", "_role", "_text")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("_place", F.row_number().over(order))
    hashed = placed.select("_key", "_place", *(
        F.xxhash64(F.lit(half), "_place", "_role", "_text").alias(f"_h{half}") for half in (1, 2)))
    by_place = W.partitionBy("_key").orderBy("_place")
    rolled = settle(hashed.select(
        "_key", "_place", *(F.bit_xor(f"_h{half}").over(by_place.rowsBetween(W.unboundedPreceding, 0)).alias(f"_h{half}") for half in (1, 2)),
        F.lead("_place").over(by_place).isNull().alias("_last")))
    prefix = ["_place", "_h1", "_h2"]
    best = F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key")))
    whole = rolled.filter("_last").groupBy(*prefix).agg(best.alias("_best"), F.count("*").alias("n_copies"))
    begun = rolled.filter("NOT _last").select(*prefix).distinct()
    return whole.join(begun, prefix, "left_anti").select(
        F.col("_best.key").alias(key), F.col("_place").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per maximal conversation: key, `n_turns`, `n_copies` and `text`, its turns as `render` writes them.

    See `maximal` for ties, nulls and repeated rows. A conversation becomes one row, so its own text has to fit a task; equal
    conversations and common openings do not add to that. Other columns are ignored; an empty table gives an empty one.
    """
    kept = settle(maximal(turns, key, turn, role, text)).withColumnRenamed(key, "_kept")
    rows = turns.select(F.col(key).alias("_key"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("user")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = rows.join(kept, F.col("_key").eqNullSafe(F.col("_kept")))
    grouped = chosen.groupBy("_key", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return grouped.select(F.col("_key").alias(key), "n_turns", "n_copies", render(F.col("turns")).alias("text"))
