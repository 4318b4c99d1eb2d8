"""Chat formatting with collapse of cumulative snapshots.

A log that saves a conversation after every turn holds each as prefix of the next. A rolling hash over the turns names
every prefix of every conversation; a conversation whose own hash is that of a proper prefix of another goes, by anti-join,
and of equal conversations the one with the least id stays. What is left is rendered in one text per conversation.

The rolling hash adds, turn by turn, two 64-bit hashes of place, role and text, as exact decimals; so prefixes are
compared by number of turns and 128 bits. Prefix hashes are made distinct before the join, so a first turn or a
conversation that a third of all share costs one row.

Edge cases: turns are ordered by turn, null first, then role and text, and counted from 1; a null role or text is unlike
an empty one when compared and rendered as empty; rows with a null conversation id are one conversation; repeated rows
are turns; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeforms.llm import shared

# The marks of the ChatML format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def piece(role: Column, text: Column) -> Column:
    """A rendered turn. Marks inside the text are broken by a space, so a text can't open or close a turn."""
    safe = [F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("< |im_")) for c in (role, text)]
    return F.concat(F.lit(OPEN), safe[0], F.lit("\n"), safe[1], F.lit(CLOSE + "\n"))


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n, h, g, prefixes, text): a row per conversation with its hashes, those of its proper prefixes, and its rendering."""
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).withColumn("k", F.row_number().over(order))
    parts = [F.col("k"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    hashed = rows.select("conv", "k", piece(F.col("role"), F.col("text")).alias("x"), *(F.sum(F.xxhash64(*p).cast("decimal(20,0)")).over(so_far).alias(name) for name, p in (("h", parts), ("g", [F.lit(1), *parts]))))
    whole = hashed.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("k", "h", "g", "x"))).alias("all"))
    last = F.element_at("all", -1)
    prefixes = F.transform(F.slice("all", 1, F.size("all") - 1), lambda t: F.struct(t["k"].alias("n"), t["h"].alias("h"), t["g"].alias("g")))
    return whole.select("conv", last["k"].alias("n"), last["h"].alias("h"), last["g"].alias("g"), prefixes.alias("prefixes"), F.array_join(F.transform("all", lambda t: t["x"]), "").alias("text"))


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, n_copies, text) of the conversations that none continues; n_copies counts those equal to it, itself included."""
    held = shared.cut(conversations(turns, conv, turn, role, text))
    name = ["n", "h", "g"]
    own = held.groupBy(*name).agg(F.min("conv").alias("keep"), F.count(F.lit(1)).alias("n_copies"))
    continued = held.select(F.inline("prefixes")).distinct()
    maximal = shared.cut(own.join(continued, name, "left_anti"))
    kept = shared.sized_join(held.select("conv", *name, "text"), maximal, name, "inner").where(F.col("conv").eqNullSafe(F.col("keep")))
    return kept.select(F.col("conv").alias(conv), F.col("n").cast("long").alias("n_turns"), F.col("n_copies").cast("long"), "text")
