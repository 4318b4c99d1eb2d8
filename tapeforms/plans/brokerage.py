"""Queries of a broker's rows, with their SQL; they join the catalog's. The given tables have none, so they are derived from every event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeforms.operators import broker
from tapeforms.plans import catalog as C

TOLD = ("FILLED", "partially_filled", "canceled", "Cancelled", "expired", "done_for_day", "suspended", "accepted", "rejected")


def one_of(*values: str) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("event_id") % len(values) + 1).cast("int"))


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = F.col("event_id") % len(TOLD) == 0
    return C.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), F.when(F.col("event_id") % 7 == 3, "").otherwise((F.col("event_id") % 12).cast("string")).alias("qty"), one_of("BUY", "SELL", "sell", "other").alias("side"), one_of(*TOLD).alias("status"),
        F.col("ts").alias("submitted_at"), F.when(filled, F.col("ts") + F.expr("interval 1 minute")).alias("filled_at"), F.when(filled, F.col("value").cast("string")).alias("filled_avg_price"), F.when(filled, (F.col("event_id") % 12).cast("string")).alias("filled_qty"),
    )


_LIST = ", ".join(f"'{t}'" for t in TOLD)


@C.query("broker_orders", f"""SELECT event_id AS id, event_type AS symbol, {C.num("CASE WHEN event_id % 7 <> 3 THEN event_id % 12 END::DOUBLE", 'qty')}, CASE WHEN event_id % 4 IN (1, 2) THEN 'sell' ELSE 'buy' END AS side,
  CASE WHEN st = 'filled' THEN 'filled' WHEN st IN ('rejected', 'canceled', 'cancelled', 'expired', 'done_for_day', 'suspended') THEN 'rejected' ELSE 'open' END AS status, ts::VARCHAR AS submitted_at,
  CASE WHEN st = 'filled' THEN (ts + INTERVAL 1 MINUTE)::VARCHAR END AS filled_at, {C.num("CASE WHEN st = 'filled' THEN value END", 'fill_price')}, {C.num("CASE WHEN st = 'filled' THEN event_id % 12 END::DOUBLE", 'filled_qty')}
FROM (SELECT *, lower([{_LIST}][event_id % {len(TOLD)} + 1]) AS st FROM events)""")
def broker_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broker's orders as ours."""
    return C.shown(broker.orders(told(spark, sf_dir)))


@C.query("screened_orders", f"""WITH held AS (SELECT user_id % 5 AS u, ts, max(greatest(event_id % 11 - 3, 0)) AS q FROM events WHERE event_id % 3 = 1 GROUP BY 1, 2)
SELECT e.event_id AS order_id, {C.num('coalesce(q, 0)::DOUBLE', 'held')}, CASE WHEN event_id % 8 - 1 <= 0 THEN 'no_quantity' WHEN event_id % 2 = 1 AND event_id % 8 - 1 > coalesce(q, 0) THEN 'no_shorting' END AS reason,
  CASE WHEN event_id % 8 - 1 <= 0 OR (event_id % 2 = 1 AND event_id % 8 - 1 > coalesce(q, 0)) THEN 'rejected' ELSE 'submitted' END AS status
FROM (SELECT *, user_id % 5 AS u FROM events WHERE event_id % 3 <> 1) e ASOF LEFT JOIN held ON e.u = held.u AND e.ts >= held.ts""")
def screened_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two events in three, against the positions that each third event tells."""
    events = C.table(spark, sf_dir, "events").withColumn("symbol", (F.col("user_id") % 5).cast("string"))
    held = broker.positions(events.where("event_id % 3 = 1").select("symbol", "ts", (F.col("event_id") % 11 - 3).cast("string").alias("qty"), F.lit("1").alias("avg_entry_price")))
    wanted = events.where("event_id % 3 <> 1").select(F.col("event_id").alias("order_id"), "symbol", "ts", F.when(F.col("event_id") % 2 == 1, "sell").otherwise("buy").alias("side"), (F.col("event_id") % 8 - 1).cast("double").alias("qty"))
    return C.shown(broker.screened(wanted, held).select("order_id", "held", "reason", "status"))
