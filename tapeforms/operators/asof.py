"""Backward as-of joins, and what rows carry over from those before them, without a task that holds a whole symbol.

Rows are dealt into buckets of time per symbol. Within a bucket order decides; what a bucket begins with is carried over, also over empty ones, on the short table of
the last row of each bucket. So a symbol with most of the rows spreads over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DAY = 24 * 60


def bucket_of(ts: Column, minutes: int) -> Column:
    """The number of the bucket of that many minutes in which a time lies."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz")) / (minutes * 60_000_000)).cast("long")


def carried(rows: DataFrame, keys: list[str], bucket: str, order: str, value: str, name: str) -> DataFrame:
    """(keys, bucket, name): for each bucket of rows the last non-null `value`, by `order`, of the buckets before it."""
    last = rows.groupBy(*keys, bucket).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    earlier = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return last.withColumn(name, F.last("_last", ignorenulls=True).over(earlier)).drop("_last")


def asof(times: DataFrame, rows: DataFrame, minutes: int = DAY, symbol: str = "symbol", ts: str = "ts", name: str = "found") -> DataFrame:
    """times with `name`, a struct of the latest of rows of the symbol at or before ts; null where there is none, or where symbol or ts is null.

    Of rows with one symbol and time the greatest by its columns counts. minutes is the width of a bucket: about as many as a task's share of rows.
    """
    seen = rows.where(F.col(symbol).isNotNull() & F.col(ts).isNotNull())
    right = seen.select(F.col(symbol).alias("_s"), F.col(ts).cast("timestamp_ntz").alias("_t"), F.lit(None).cast(times.schema.simpleString()).alias("_row"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_r"))
    left = times.select(F.col(symbol).alias("_s"), F.col(ts).cast("timestamp_ntz").alias("_t"), F.struct(*(F.col(f"`{c}`") for c in times.columns)).alias("_row"), F.lit(None).cast(rows.schema.simpleString()).alias("_r"))
    both = left.unionByName(right).withColumns({"_b": bucket_of(F.col("_t"), minutes), "_asks": F.col("_row").isNotNull()})
    before = carried(both.withColumn("_o", F.struct("_t", "_r")), ["_s"], "_b", "_o", "_r", "_before")
    inside = W.partitionBy("_s", "_b").orderBy("_t", "_asks", "_r").rowsBetween(W.unboundedPreceding, 0)
    placed = both.withColumn("_own", F.last("_r", ignorenulls=True).over(inside)).where("_asks").join(before, (both["_s"] == before["_s"]) & (both["_b"] == before["_b"]), "left")
    known = F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_before"))
    return placed.select("_row", known.alias("_found")).select("_row.*", F.col("_found").alias(name))


def previous(rows: DataFrame, keys: list[str], ts: str, order: list[str], value: Column, name: str, minutes: int = DAY) -> DataFrame:
    """rows with `name`: the value (a struct, not null) of the row before, by ts and then order, of the same keys."""
    dealt = rows.withColumns({"_b": bucket_of(F.col(ts), minutes), "_v": value, "_o": F.struct(ts, *order)})
    before = carried(dealt, keys, "_b", "_o", "_v", "_before")
    inside = W.partitionBy(*keys, "_b").orderBy("_o")
    return dealt.withColumn("_own", F.lag("_v").over(inside)).join(before, [*keys, "_b"]).withColumn(name, F.coalesce("_own", "_before")).drop("_b", "_v", "_o", "_own", "_before")
