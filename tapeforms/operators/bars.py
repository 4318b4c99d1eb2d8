"""Bars: derivation from ticks, regular hours, upsert, sessions, index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN_MINUTE, CLOSE_MINUTE = 9 * 60 + 30, 16 * 60
SHORT_SESSION = 380
PRICES = ["open", "high", "low", "close"]


def new_york(ts: str = "ts") -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col(ts))


def minute_of_day(ts: str = "ts") -> Column:
    ny = new_york(ts)
    return F.hour(ny) * 60 + F.minute(ny)


def from_events(events: DataFrame, minutes: int = 1, symbol: str | Column = "EVT") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) from ticks (event_id, ts, value); ticks without a positive value go."""
    name = F.lit(symbol) if isinstance(symbol, str) else symbol
    order = F.struct("ts", "event_id")
    ticks = events.where("value > 0").select(name.alias("symbol"), F.window("ts", f"{minutes} minutes")["start"].alias("bar"), "ts", "event_id", "value")
    return ticks.groupBy("symbol", F.col("bar").alias("ts")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


def regular_hours(bars: DataFrame) -> DataFrame:
    """Bars that start from 09:30 until before 16:00 in New York."""
    return bars.where(minute_of_day().between(OPEN_MINUTE, CLOSE_MINUTE - 1))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per (symbol, ts, source) the row ingested last, of both; columns symbol, ts, source, ingested_at and more."""
    key = ["symbol", "ts", "source"]
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), "ingested_at").alias("_r")).select(*key, "_r.*").select(*both.columns)


def ingestion_log(batch: DataFrame) -> DataFrame:
    """A row per symbol and source of a batch; an empty batch leaves none."""
    return batch.groupBy("symbol", "source").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_rows"), F.max("ingested_at").alias("fetched_at"))


def sessions(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", F.to_date(new_york()).alias("session")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_bars"))


def coverage(sessions_: DataFrame, short: int = SHORT_SESSION) -> DataFrame:
    return sessions_.groupBy("symbol").agg(
        F.sum("n_bars").alias("n_bars"), F.count(F.lit(1)).alias("n_sessions"), F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.count_if(F.col("n_bars") < short).alias("n_short")
    )


def until(bars: DataFrame, end_ts: Column) -> DataFrame:
    return bars.where(F.col("ts") <= end_ts)


def at(bars: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bars of exactly the times wanted (symbol, ts); a time without a bar is an error, not a row less."""
    found = wanted.select("symbol", "ts").join(bars.withColumn("_found", F.lit(True)), ["symbol", "ts"], "left")
    missing = F.raise_error(F.concat(F.lit("no bar of "), F.col("symbol"), F.lit(" at "), F.col("ts").cast("string"))).cast("boolean")
    return found.where(F.when(F.col("_found").isNull(), missing).otherwise(F.lit(True))).drop("_found")


def before_split(bars: DataFrame, split_date: str) -> DataFrame:
    """The training part: sessions up to and with the split date."""
    return bars.where(F.to_date(new_york()) <= F.lit(split_date).cast("date"))


def first_test_idx(indexed: DataFrame, split_date: str) -> DataFrame:
    """(symbol, first_test_idx): the first place after the split date; null without one."""
    return indexed.groupBy("symbol").agg(F.min(F.when(F.col("session") > F.lit(split_date).cast("date"), F.col("idx"))).alias("first_test_idx"))


def last_bar(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))


def to_refresh(stored: DataFrame, feed: DataFrame) -> DataFrame:
    """The rows of a feed to fetch again: from a day before each symbol's last stored bar on; all of a symbol without any."""
    return feed.join(last_bar(stored), "symbol", "left").where(F.col("last_ts").isNull() | (F.col("ts") >= F.col("last_ts") - F.expr("interval 1 day"))).drop("last_ts")


def closed(bars: DataFrame, asof: Column, minutes: int = 1) -> DataFrame:
    """Bars that are complete at asof: the one that is still forming is never visible."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    elapsed = F.timestamp_diff("MINUTE", epoch, asof.cast("timestamp_ntz"))
    last = F.timestamp_add("MINUTE", F.floor(elapsed / minutes) * minutes - minutes, epoch)
    return bars.where(F.col("ts") <= last)


def indexed(bars: DataFrame) -> DataFrame:
    """bars with session, minute, pos (place in the session), idx (place over all sessions, from 0) and bars_left.

    Places are ranked within sessions, and sessions are offset by the counts of those before; only the short table of
    sessions is ordered as a whole.
    """
    labelled = bars.withColumns({"session": F.to_date(new_york()), "minute": minute_of_day()})
    inside = W.partitionBy("symbol", "session")
    counts = labelled.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("symbol").orderBy("session").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = labelled.withColumn("pos", F.row_number().over(inside.orderBy("ts")) - 1)
    offset = counts.withColumn("_before", before)
    out = placed.join(offset, ["symbol", "session"]).withColumns({"idx": (F.col("_before") + F.col("pos")).cast("long"), "bars_left": (F.col("_n") - 1 - F.col("pos")).cast("long")})
    return out.drop("_n", "_before")
