"""A broker on bars: what becomes of orders, the account bar by bar, and the trading loop that places them.

Market orders of a bar fill at the next bar's open, with costs; a sale of more than what is held is rejected when it is
placed; a position that is open at a session's last bar is sold at its close.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeforms.plans.settings import Settings
from tapeforms.sources import folders

CASH = 100_000.0
EVENT = "struct<order_id:bigint,side:string,qty:double,status:string,reason:string,fill_idx:bigint,fill_price:double>"
EVENTS = pa.list_(pa.struct([("order_id", pa.int64()), ("side", pa.string()), ("qty", pa.float64()), ("status", pa.string()), ("reason", pa.string()), ("fill_idx", pa.int64()), ("fill_price", pa.float64())]))


def _event(order: dict, status: str, reason: str | None = None, idx: int | None = None, price: float | None = None) -> dict:
    return {"order_id": order["order_id"], "side": order["side"], "qty": order["qty"], "status": status, "reason": reason, "fill_idx": idx, "fill_price": price}


class Book:
    """Position, average entry and flow of cash of one session, bar by bar."""

    def __init__(self, qty: float, average: float, cost: float):
        self.qty, self.average, self.cost, self.flow = qty, average, cost, 0.0
        self.pending: list[dict] = []

    def filled(self, order: dict, price: float, idx: int, reason: str | None = None) -> dict:
        q = order["qty"]
        if order["side"] == "buy":
            price *= 1 + self.cost
            held = self.qty + q
            self.average = (self.average * self.qty + price * q) / held if held else 0.0
            self.qty, self.flow = held, self.flow - q * price
        else:
            price *= 1 - self.cost
            self.qty, self.flow = self.qty - q, self.flow + q * price
            if self.qty == 0:
                self.average = 0.0
        return _event(order, "filled", reason, idx, price)

    def bar(self, idx: int, open_: float, close: float, last: bool, orders: list[dict]) -> list[dict]:
        """What happens at a bar: fills at its open, the forced sale, and which of its orders wait for the next."""
        self.flow = 0.0
        events = [self.filled(o, open_, idx) for o in self.pending]
        if last and self.qty > 0:
            events.append(self.filled({"order_id": None, "side": "sell", "qty": self.qty}, close, idx, "force_flat"))
        self.pending = []
        for o in orders:
            if o["qty"] is None or o["qty"] <= 0:
                events.append(_event(o, "rejected", "no_quantity"))
            elif o["side"] == "sell" and o["qty"] > self.qty:
                events.append(_event(o, "rejected", "no_shorting"))
            else:
                self.pending.append(o)
        return events


def _sessions(rows: DataFrame, cost: float) -> DataFrame:
    """One pass over all sessions, each from what it begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, at = Book(0.0, 0.0, cost), None
        for batch in batches:
            flow, qty, average, events = [], [], [], []
            for r in batch.to_pylist():
                if at != (r["symbol"], r["session"]):
                    at, book = (r["symbol"], r["session"]), Book(r["carry_qty"] or 0.0, r["carry_average"] or 0.0, cost)
                    book.pending = [o for o in r["before"] or () if o["side"] == "buy" and (o["qty"] or 0) > 0]
                events.append(book.bar(r["idx"], r["open"], r["close"], r["bars_left"] == 0, r["orders"] or []))
                flow.append(book.flow)
                qty.append(book.qty)
                average.append(book.average)
            columns = [batch.column(c) for c in ("symbol", "session", "idx", "bars_left", "close")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.float64()) for x in (flow, qty, average)), pa.array(events, EVENTS)], names=["symbol", "session", "idx", "bars_left", "close", "flow", "qty", "avg_entry", "events"])

    laid = rows.repartition("symbol", "session").sortWithinPartitions("symbol", "session", "idx")
    return laid.mapInArrow(run, f"symbol string, session date, idx long, bars_left long, close double, flow double, qty double, avg_entry double, events array<{EVENT}>")


def simulated(orders: DataFrame, indexed: DataFrame, cost_bps: float) -> DataFrame:
    """(symbol, session, idx, bars_left, close, flow, qty, avg_entry, events) of each bar, under orders (order_id, symbol, idx, side, qty).

    A session begins flat, but for the purchases of the last bar before it, so sessions are apart and each is a run of rows in
    a task. Only where two sales of one bar, each covered by what is held, leave a session short, does the next begin with
    that: then sessions are run again until no beginning changes.
    """
    per_bar = orders.groupBy("symbol", "idx").agg(F.sort_array(F.collect_list(F.struct("order_id", "side", F.col("qty").cast("double").alias("qty")))).alias("orders"))
    rows = indexed.select("symbol", "session", "idx", "pos", "bars_left", "open", "close").join(per_bar, ["symbol", "idx"], "left")
    before = per_bar.select("symbol", (F.col("idx") + 1).alias("idx"), F.lit(0).alias("pos"), F.col("orders").alias("before"))
    rows = rows.join(before, ["symbol", "idx", "pos"], "left")
    carry: DataFrame | None = None
    while True:
        none = F.lit(None).cast("double")
        begun = rows.withColumns({"carry_qty": none, "carry_average": none}) if carry is None else rows.join(carry, ["symbol", "idx", "pos"], "left")
        out = folders.cut(_sessions(begun, cost_bps * 1e-4))
        short = out.where("bars_left = 0 and qty < 0").select("symbol", (F.col("idx") + 1).alias("idx"), F.lit(0).alias("pos"), F.col("qty").alias("carry_qty"), F.col("avg_entry").alias("carry_average"))
        changed = short.count() if carry is None else short.exceptAll(carry).count() + carry.exceptAll(short).count()
        if not changed:
            return out
        carry = short


def fills(orders: DataFrame, indexed: DataFrame, cost_bps: float) -> DataFrame:
    """orders with status (filled, rejected, or submitted where no bar follows), reason, fill_idx and fill_price."""
    events = simulated(orders, indexed, cost_bps).select(F.explode("events").alias("e")).select("e.order_id", "e.status", "e.reason", "e.fill_idx", "e.fill_price").where("order_id is not null")
    placed = orders.select("order_id", "symbol", "idx", "side", "qty").join(events, "order_id", "left")
    return placed.withColumn("status", F.coalesce("status", F.lit("submitted")))


def account_curve(orders: DataFrame, indexed: DataFrame, cost_bps: float, cash: float = CASH) -> DataFrame:
    """(symbol, idx, cash, qty, avg_entry, equity) after each bar: cash summed within sessions and over the table of sessions."""
    bars = simulated(orders, indexed, cost_bps)
    inside = W.partitionBy("symbol", "session").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("symbol").orderBy("session").rowsBetween(W.unboundedPreceding, -1)
    offset = bars.groupBy("symbol", "session").agg(F.sum("flow").alias("_f")).select("symbol", "session", F.coalesce(F.sum("_f").over(earlier), F.lit(0.0)).alias("_before"))
    rows = bars.join(offset, ["symbol", "session"]).withColumn("cash", cash + F.col("_before") + F.sum("flow").over(inside))
    return rows.select("symbol", "idx", "cash", "qty", "avg_entry", (F.col("cash") + F.col("qty") * F.col("close")).alias("equity"))


STATE = "held double, avg_entry double, cash double, entry_idx long, order_side string, order_qty double, order_intent string"
REPLAY = f"symbol string, idx long, ts timestamp_ntz, close double, outcome string, equity double, fill_price double, {STATE}"


class Trader:
    """The trading loop of one symbol: what it holds, what it has ordered, and the step that a closed bar makes it take."""

    def __init__(self, s: Settings, minutes: int, cash: float):
        self.s, self.minutes = s, minutes
        self.held, self.average, self.cash = 0.0, 0.0, cash
        self.entry: int | None = None
        self.order: tuple[str, float, str] | None = None
        self.price: float | None = None

    def restore(self, r: dict) -> None:
        self.held, self.average, self.cash, self.entry = r["held"], r["avg_entry"], r["cash"], r["entry_idx"]
        self.order = (r["order_side"], r["order_qty"], r["order_intent"]) if r["order_side"] else None

    def settle(self, open_: float) -> None:
        self.price = None
        if self.order is None:
            return
        side, qty, _ = self.order
        self.price = open_ * (1 + (1e-4 if side == "buy" else -1e-4) * self.s.cost_bps)
        if side == "buy":
            self.average = (self.average * self.held + self.price * qty) / (self.held + qty)
            self.held, self.cash = self.held + qty, self.cash - qty * self.price
        else:
            self.held, self.cash = self.held - qty, self.cash + qty * self.price
            if self.held == 0:
                self.average, self.entry = 0.0, None
        self.order = None

    def step(self, idx: int, minute: int, open_: float, close: float, direction: str | None) -> str:
        s = self.s
        self.settle(open_)
        to_close = 16 * 60 - minute - self.minutes
        if self.held > 0:
            if to_close <= s.force_flat_minutes_before_close:
                self.order = ("sell", self.held, "force_flat")
            elif self.entry is None:
                return "hold:adopted"
            elif idx - self.entry >= s.horizon:
                self.order = ("sell", self.held, "time_stop")
            return f"exit:{self.order[2]}" if self.order else "hold"
        if to_close <= s.force_flat_minutes_before_close + s.horizon:
            return "too_close_to_enter"
        if direction != "LONG":
            return f"no_trade:{direction or 'NO_TRADE'}"
        if close <= 0:
            return "no_price"
        qty = float(math.floor((self.cash + self.held * close) * s.position_size / close))
        if qty <= 0:
            return "size_zero"
        self.order, self.entry = ("buy", qty, "entry"), idx
        return "entry"


def replay(indexed: DataFrame, signals: DataFrame, s: Settings, minutes: int, cash: float = CASH, state: DataFrame | None = None) -> DataFrame:
    """The trading loop over closed bars, one decision per bar: the columns of REPLAY, a row per bar.

    What a bar does depends on the account that all bars before it left, since orders are sized by its equity; so a symbol is
    a chain, read in order with a state of one row. `state` has the last row of each symbol of an earlier run: bars up to
    there are left out, and the run goes on from it.
    """
    rows = indexed.select("symbol", "idx", "ts", "minute", "open", "close").join(signals.select("symbol", "idx", "direction"), ["symbol", "idx"], "left")
    if state is None:
        rows = rows.withColumn("state", F.lit(None).cast(f"struct<idx:bigint,{STATE.replace(' ', ':').replace(',:', ',').replace('long', 'bigint')}>"))
    else:
        names = ["idx", *(c.split()[0] for c in STATE.split(", "))]
        rows = rows.join(state.select("symbol", F.struct(*names).alias("state")), "symbol", "left").where("state is null or idx > state.idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trader, symbol = Trader(s, minutes, cash), None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["symbol"] != symbol:
                    symbol, trader = r["symbol"], Trader(s, minutes, cash)
                    if r["state"]:
                        trader.restore(r["state"])
                outcome = trader.step(r["idx"], r["minute"], r["open"], r["close"], r["direction"])
                order = trader.order or (None, None, None)
                out.append((outcome, trader.cash + trader.held * r["close"], trader.price, trader.held, trader.average, trader.cash, trader.entry, *order))
            kinds = [pa.string(), *[pa.float64()] * 5, pa.int64(), pa.string(), pa.float64(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("symbol", "idx", "ts", "close")), *columns], names=["symbol", "idx", "ts", "close", "outcome", "equity", "fill_price", "held", "avg_entry", "cash", "entry_idx", "order_side", "order_qty", "order_intent"])

    laid = rows.repartition("symbol").sortWithinPartitions("symbol", "idx")
    return laid.select("symbol", "idx", "ts", "minute", "open", "close", "direction", "state").mapInArrow(run, REPLAY)


def orders_of(replayed: DataFrame) -> DataFrame:
    """(broker_order_id, symbol, intent, side, qty, submitted_at, status, filled_at, filled_avg_price): the orders that a replay placed."""
    placed = replayed.where("order_side is not null").select("symbol", "idx", F.col("order_intent").alias("intent"), F.col("order_side").alias("side"), F.col("order_qty").alias("qty"), F.col("ts").alias("submitted_at"))
    filled = replayed.where("fill_price is not null").select("symbol", (F.col("idx") - 1).alias("idx"), F.col("ts").alias("filled_at"), F.col("fill_price").alias("filled_avg_price"))
    status = F.when(F.col("filled_at").isNull(), "open").otherwise("filled").alias("status")
    return placed.join(filled, ["symbol", "idx"], "left").select(F.col("idx").alias("broker_order_id"), "symbol", "intent", "side", "qty", "submitted_at", status, "filled_at", "filled_avg_price")


def snapshots(replayed: DataFrame) -> DataFrame:
    """(symbol, ts, qty, avg_entry, market_value, unrealized_pl, account_equity) at each bar; of a flat account only the equity."""
    held = F.col("held") > 0
    return replayed.select(
        "symbol", "ts", F.when(held, F.col("held")).alias("qty"), F.when(held, F.col("avg_entry")).alias("avg_entry"), F.when(held, F.col("held") * F.col("close")).alias("market_value"),
        F.when(held, F.col("held") * (F.col("close") - F.col("avg_entry"))).alias("unrealized_pl"), F.col("equity").alias("account_equity"),
    )
