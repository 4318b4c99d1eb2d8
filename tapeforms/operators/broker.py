"""A broker's rows as ours: orders and positions as it tells them, and the orders that never leave here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeforms.operators import asof
from tapeforms.operators.journal import order_state


def number(c: str) -> Column:
    """A figure that the broker gives as text; null for what is no number."""
    return F.col(c).try_cast("double")


def orders(raw: DataFrame) -> DataFrame:
    """(id, symbol, qty, side, status, submitted_at, filled_at, fill_price, filled_qty) from the broker's (id, symbol, qty, side, status, submitted_at, filled_at, filled_avg_price,
    filled_qty), figures as text. Every side but sell is a buy; of an order that isn't filled, times and prices are null as they come, and empty texts are null."""
    side = F.when(F.lower("side") == "sell", "sell").otherwise("buy")
    return raw.select("id", "symbol", number("qty").alias("qty"), side.alias("side"), order_state(F.coalesce("status", F.lit(""))).alias("status"), "submitted_at", "filled_at", number("filled_avg_price").alias("fill_price"), number("filled_qty").alias("filled_qty"))


def positions(raw: DataFrame) -> DataFrame:
    """(symbol, ts, qty, avg_entry) of the broker's (symbol, ts, qty, avg_entry_price), figures as text. A short position counts as none: qty 0 without a price."""
    qty = F.coalesce(number("qty"), F.lit(0.0))
    return raw.select("symbol", "ts", F.greatest(qty, F.lit(0.0)).alias("qty"), F.when(qty > 0, number("avg_entry_price")).alias("avg_entry"))


def screened(wanted: DataFrame, held: DataFrame, minutes: int = asof.DAY) -> DataFrame:
    """wanted (order_id, symbol, ts, side, qty) with held, reason and status.

    An order for no quantity (null, zero or less), or a sale of more than positions() last told of its symbol by then, is rejected here; the others are submitted. A symbol that nothing was told of, or none, is
    held by 0. Orders of a busy symbol are dealt out by buckets of time.
    """
    seen = asof.asof(wanted, held.select("symbol", "ts", F.col("qty").alias("q")), minutes, name="_found")
    out = seen.withColumn("held", F.coalesce("_found.q", F.lit(0.0))).drop("_found")
    reason = F.when(F.coalesce(F.col("qty") <= 0, F.lit(True)), "no_quantity").when((F.lower("side") == "sell") & (F.col("qty") > F.col("held")), "no_shorting")
    return out.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "submitted").otherwise("rejected"))
