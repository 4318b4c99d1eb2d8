"""Live trading: the decision of a step, the journal of signals and orders, trades paired from it, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeforms.functions import metrics
from tapeforms.operators import asof, ledger

# How a broker's order states map to ours; any other state is open.
STATES = {"filled": "filled", "rejected": "rejected", "canceled": "rejected", "cancelled": "rejected", "expired": "rejected", "done_for_day": "rejected", "suspended": "rejected"}


def order_state(state: Column) -> Column:
    out = F.lit("open")
    for theirs, ours in STATES.items():
        out = F.when(F.lower(state) == theirs, ours).otherwise(out)
    return out


def step(cases: DataFrame, horizon: int, force_flat_minutes: int, position_size: float) -> DataFrame:
    """cases, a row per step with the state it meets, with outcome and qty.

    Columns: is_open, has_bars, held, sell_pending, buy_pending, mins_to_close, has_entry_record, bars_since_entry, decided,
    direction, price, equity.
    """
    flat_now = F.col("mins_to_close") <= force_flat_minutes
    qty = F.floor(F.col("equity") * position_size / F.col("price"))
    holding = F.when(F.col("sell_pending"), "exit_pending").when(flat_now, "exit:force_flat").when(~F.col("has_entry_record"), "hold:adopted").when(F.col("bars_since_entry") >= horizon, "exit:time_stop").otherwise("hold")
    entering = (
        F.when(F.col("buy_pending"), "entry_pending").when(F.col("decided"), "already_decided").when(F.col("mins_to_close") <= force_flat_minutes + horizon, "too_close_to_enter")
        .when(F.col("direction") != "LONG", F.concat(F.lit("no_trade:"), "direction")).when(F.col("price").isNull() | (F.col("price") <= 0), "no_price").when(qty <= 0, "size_zero").otherwise("entry")
    )
    outcome = F.when(~F.col("is_open"), "market_closed").when(~F.col("has_bars"), "no_bars").when(F.col("held") > 0, holding).otherwise(entering)
    return cases.withColumn("outcome", outcome).withColumn("qty", F.when(F.col("outcome") == "entry", qty).when(F.col("outcome").startswith("exit:"), F.col("held")))


def append_new(log: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """log with those rows whose key it doesn't have; of rows with one key the first by all columns."""
    rest = [c for c in rows.columns if c not in key]
    fresh = rows.join(log.select(*key).distinct(), key, "left_anti").groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*")
    return log.unionByName(fresh.select(*log.columns))


def current_orders(events: DataFrame) -> DataFrame:
    """The state of each order after its latest event."""
    return ledger.current(events, "broker_order_id")


def sync_signals(signals: DataFrame, orders: DataFrame) -> DataFrame:
    """signals with the state of the order that was placed for them."""
    latest = orders.groupBy(F.col("signal_id").alias("id")).agg(F.max_by("status", "submitted_at").alias("_s"))
    return signals.join(latest, "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def open_entry(orders: DataFrame, signals: DataFrame) -> DataFrame:
    """(config_hash, symbol, signal_ts): the signal behind the newest entry order, from which a restart goes on."""
    entries = orders.where("intent = 'entry'").join(signals.select(F.col("id").alias("signal_id"), "config_hash", "signal_ts"), "signal_id")
    return entries.groupBy("config_hash", "symbol").agg(F.max_by("signal_ts", "submitted_at").alias("signal_ts"))


def bars_since(bars: DataFrame, entries: DataFrame) -> DataFrame:
    """(symbol, n): bars after each symbol's entry_ts."""
    return bars.join(entries.select("symbol", "entry_ts"), "symbol").groupBy("symbol").agg(F.count_if(F.col("ts") > F.col("entry_ts")).alias("n"))


def paired_trades(orders: DataFrame) -> DataFrame:
    """Round trips of filled orders: an exit pairs with the newest entry since the last exit, so it is one whose predecessor is an entry.

    Predecessors are found within days, and carried over from the day before that had any, so no symbol is one task.
    """
    filled = orders.where("status = 'filled' and filled_at is not null and symbol is not null")
    before = asof.previous(filled, ["symbol"], "filled_at", ["broker_order_id"], F.struct("intent", "qty", "filled_avg_price", "filled_at"), "_e")
    rows = before.where("intent <> 'entry' and _e.intent = 'entry'")
    e, x = F.col("_e.filled_avg_price"), F.col("filled_avg_price")
    return rows.select("symbol", F.col("_e.filled_at").alias("entry_ts"), F.col("filled_at").alias("exit_ts"), F.col("_e.qty").alias("qty"), e.alias("entry_price"), x.alias("exit_price"), (x / e - 1).alias("net_ret"), (F.col("_e.qty") * (x - e)).alias("pnl"), F.col("intent").alias("exit_reason"))


def weekly(trades: DataFrame, end: Column, days: int = 7) -> DataFrame:
    """Per symbol the figures of the trades that ended in the last `days` days."""
    inside = trades.where((F.col("exit_ts") <= end) & (F.col("exit_ts") >= end - F.expr(f"interval {days} days")))
    return inside.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_trades"), metrics.hit_rate("net_ret").alias("hit_rate"), F.avg("net_ret").alias("mean_net_ret"), F.sum("pnl").alias("total_pnl"))


def against_benchmark(snapshots: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, equity_start, equity_end, bh_return): equity over the snapshots, and the bars between the first and last of them."""
    span = snapshots.groupBy("symbol").agg(F.min_by("equity", "ts").alias("equity_start"), F.max_by("equity", "ts").alias("equity_end"), F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
    held = bars.join(span, "symbol").where("ts between _t0 and _t1").groupBy("symbol").agg(F.when(F.count(F.lit(1)) >= 2, F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("bh_return"))
    return span.drop("_t0", "_t1").join(held, "symbol", "left")


def rebased(snapshots: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, ts, benchmark): closes between the first and last snapshot, scaled to the equity at the first."""
    span = snapshots.groupBy("symbol").agg(F.min_by("equity", "ts").alias("_e"), F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
    inside = bars.join(span, "symbol").where("ts between _t0 and _t1")
    first = inside.groupBy("symbol").agg(F.min_by("close", "ts").alias("_c"))
    return inside.join(first, "symbol").select("symbol", "ts", (F.col("close") / F.col("_c") * F.col("_e")).alias("benchmark"))


def status(orders: DataFrame) -> DataFrame:
    """Per symbol: filled orders, closed trades, and orders still open."""
    filled = F.col("status") == "filled"
    return orders.groupBy("symbol").agg(F.count_if(filled).alias("n_filled"), F.count_if(filled & F.col("intent").isin("time_stop", "force_flat")).alias("n_closed"), F.count_if(F.col("status") == "open").alias("n_open"))


def full_status(orders: DataFrame, snapshots: DataFrame, armed: DataFrame) -> DataFrame:
    """Per symbol: whether its configuration may trade, the position and equity of the last snapshot, and the counts of orders.

    snapshots (symbol, ts, qty, avg_entry, account_equity); armed (symbol, armed).
    """
    last = F.max_by(F.struct("qty", "avg_entry", "account_equity"), "ts")
    now = snapshots.groupBy("symbol").agg(F.max("ts").alias("last_snapshot"), last.alias("_l"))
    position = F.coalesce(F.col("_l.qty"), F.lit(0.0))
    rows = now.select("symbol", "last_snapshot", position.alias("qty"), F.col("_l.avg_entry").alias("avg_entry"), F.col("_l.account_equity").alias("equity"))
    out = rows.join(status(orders), "symbol", "left").join(armed.select("symbol", "armed"), "symbol", "left")
    return out.fillna(0, ["n_filled", "n_closed", "n_open"]).fillna(False, ["armed"])


def weekly_rows(trades: DataFrame, snapshots: DataFrame, bars: DataFrame, backtest_mean: DataFrame, end: Column, days: int = 7) -> DataFrame:
    """The weekly report, a row per symbol: figures of the week's trades, how far they are from the backtest (symbol, backtest_mean), equity over the
    week's snapshots (symbol, ts, account_equity), and the benchmark between the first and last of them."""
    inside = (F.col("ts") <= end) & (F.col("ts") >= end - F.expr(f"interval {days} days"))
    week = snapshots.where(inside).select("symbol", "ts", F.col("account_equity").alias("equity"))
    held = against_benchmark(week, bars).join(weekly(trades, end, days), "symbol", "full").join(backtest_mean, "symbol", "left")
    away = F.col("mean_net_ret") - F.col("backtest_mean")
    return held.select("symbol", F.coalesce("n_trades", F.lit(0)).alias("n_trades"), "hit_rate", "mean_net_ret", "total_pnl", "backtest_mean", away.alias("divergence"), "equity_start", "equity_end", "bh_return")


def equity_series(snapshots: DataFrame, end: Column, days: int = 7) -> DataFrame:
    """(symbol, ts, equity) of the week's snapshots."""
    return snapshots.where((F.col("ts") <= end) & (F.col("ts") >= end - F.expr(f"interval {days} days"))).select("symbol", "ts", F.col("account_equity").alias("equity"))


def overlay(bars: DataFrame, matches: DataFrame, window: int, horizon: int) -> DataFrame:
    """(symbol, end_idx, step, level): closes from `window` bars before to `horizon` after each match's end, over the first of them."""
    span = matches.select("symbol", "end_idx", F.explode(F.sequence(F.lit(-window), F.lit(horizon))).alias("step")).withColumn("idx", F.col("end_idx") + F.col("step"))
    rows = span.join(bars.select("symbol", "idx", "close"), ["symbol", "idx"])
    base = rows.where(F.col("step") == -window).select("symbol", "end_idx", F.col("close").alias("_c"))
    return rows.join(base, ["symbol", "end_idx"]).select("symbol", "end_idx", "step", (F.col("close") / F.col("_c")).alias("level"))


def histogram(values: DataFrame, value: str) -> DataFrame:
    """(bin, lo, hi, n): from 5 to 30 bins of equal width over the range, half as many as there are values; the last one is closed."""
    s = values.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_a"), F.max(value).alias("_b"))
    s = s.withColumn("_k", F.least(F.lit(30), F.greatest(F.lit(5), F.floor(F.col("_n") / 2))).cast("int")).withColumn("_w", (F.col("_b") - F.col("_a")) / F.col("_k"))
    place = F.when(F.col("_w") == 0, 0).otherwise(F.least(F.col("_k") - 1, F.floor((F.col(value) - F.col("_a")) / F.col("_w"))))
    rows = values.where(F.col(value).isNotNull()).crossJoin(F.broadcast(s)).withColumn("bin", place.cast("int"))
    return rows.groupBy("bin", "_a", "_w").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("_a") + F.col("bin") * F.col("_w")).alias("lo"), (F.col("_a") + (F.col("bin") + 1) * F.col("_w")).alias("hi"), "n")


def weekly_report(week: DataFrame, benchmark: DataFrame, backtest_mean: float | None) -> str:
    """The report as Markdown, from the one row per symbol of weekly() and against_benchmark()."""
    lines = ["# Weekly report", ""]
    other = {r["symbol"]: r for r in benchmark.collect()}
    for r in week.orderBy("symbol").collect():
        lines += [f"## {r['symbol']}", "", f"- trades: {r['n_trades']}", f"- hit rate: {r['hit_rate']:.1%}", f"- mean net return: {r['mean_net_ret']:+.4%}", f"- profit: {r['total_pnl']:,.2f}"]
        if backtest_mean is not None:
            lines.append(f"- backtest mean: {backtest_mean:+.4%} (difference {r['mean_net_ret'] - backtest_mean:+.4%})")
        if (b := other.get(r["symbol"])) and b["bh_return"] is not None:
            lines.append(f"- equity: {b['equity_start']:,.2f} to {b['equity_end']:,.2f}; buy and hold {b['bh_return']:+.4%}")
    return "\n".join(lines) + "\n"
