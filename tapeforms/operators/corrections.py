"""Corrected bars carried downstream: only the sessions that they touch are computed again.

Windows, forward returns and signals of a session depend on its own bars and, before its first whole window, on the last window of an earlier
session. So of a version of the bars that differs from the one before in some sessions, those are computed again, and the ones that begin with a window that these have changed. All
other rows only move by as many places as bars were added or taken away before them, which the short table of sessions tells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeforms.operators import bars as B
from tapeforms.sources import folders

SESSION = ["symbol", "session"]


def table_of(sessions: DataFrame, window: int) -> DataFrame:
    """sessions (symbol, session, n_bars) with before, the bars of earlier sessions, whole, the last earlier session with a whole window, and carried, the place where that window ends."""
    order = W.partitionBy("symbol").orderBy("session")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    placed = sessions.select(*SESSION, "n_bars").withColumn("before", F.coalesce(F.sum("n_bars").over(earlier), F.lit(0)))
    own = F.when(F.col("n_bars") > window, F.struct("session", (F.col("before") + F.col("n_bars") - 1).alias("end")))
    last = placed.withColumn("_w", own).withColumn("_w", F.last("_w", ignorenulls=True).over(earlier))
    return last.select(*SESSION, "n_bars", "before", F.col("_w.session").alias("whole"), F.col("_w.end").alias("carried"))


def affected(changed: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol, session) of the new sessions to compute again: changed ones, and those that begin with a window of a changed one, now or before. old and new as table_of() gives them."""
    now = new.join(old.select(*SESSION, F.col("whole").alias("_was")), SESSION, "left")
    moved = ~F.col("whole").eqNullSafe(F.col("_was"))
    hit = changed.select("symbol", F.col("session").alias("whole"), F.lit(True).alias("_hit"))
    own = changed.select(*SESSION, F.lit(True).alias("_own"))
    return now.join(hit, ["symbol", "whole"], "left").join(own, SESSION, "left").where(F.col("_hit") | F.col("_own") | moved).select(*SESSION)


def recomputed(old: DataFrame, bars: DataFrame, changed: DataFrame, window: int, compute: Callable[[DataFrame], DataFrame], narrowed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What compute gives on all of bars, from what it gave on the bars before: old (symbol, session, idx, q_end, …), a row per bar.

    compute: from indexed bars to a row per bar (symbol, session, idx, …), with q_end if it depends on the current window. bars (symbol, ts, …) are the new ones in regular hours; of them only the sessions
    that are computed again, and the ones whose last window they begin with, are read, besides the days of all for the table of sessions. narrowed: what to read of bars, given
    the sessions (symbol, session); by default a join.
    """
    names = old.columns
    day = F.to_date(B.new_york())
    were = folders.cut(table_of(old.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n_bars")), window))
    are = folders.cut(table_of(bars.groupBy("symbol", day.alias("session")).agg(F.count(F.lit(1)).alias("n_bars")), window))
    again = folders.cut(affected(changed, were, are))
    feeding = again.join(are, SESSION).where("whole is not null").select("symbol", F.col("whole").alias("session"))
    wanted = folders.cut(again.union(feeding).distinct())
    some = narrowed(wanted) if narrowed is not None else bars.withColumn("session", day).join(wanted, SESSION, "left_semi").drop("session")
    # Places within the part, moved to those within the whole.
    part = folders.cut(B.indexed(some))
    shift = part.groupBy(*SESSION).agg(F.min("idx").alias("_from")).join(are.select(*SESSION, "before"), SESSION).select(*SESSION, (F.col("before") - F.col("_from")).alias("_shift"))
    placed = part.join(shift, SESSION).withColumn("idx", F.col("idx") + F.col("_shift")).drop("_shift")
    fresh = compute(placed).join(again, SESSION, "left_semi").select(names)
    rest = old.join(again, SESSION, "left_anti").join(were.select(*SESSION, F.col("before").alias("_was")), SESSION).join(are.select(*SESSION, "before", "carried"), SESSION)
    at = F.col("idx") - F.col("_was") + F.col("before")
    moved: dict[str, Column] = {"idx": at.alias("idx")}
    if "q_end" in names:
        moved["q_end"] = F.when(F.col("idx") - F.col("_was") >= window, at).otherwise(F.col("carried")).alias("q_end")
    return fresh.unionByName(rest.select(*(moved.get(c, F.col(c)) for c in names)))
