"""Fills, the walk-forward, its metrics, and what it is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeforms.functions import metrics
from tapeforms.plans.settings import Settings

YEAR = 252


def fill_price(price: Column, side: Column, cost_bps: float) -> Column:
    """Buys pay the cost on top, sells get it off."""
    return F.when(side == "buy", price * (1 + cost_bps * 1e-4)).otherwise(price * (1 - cost_bps * 1e-4))


def forced_flat(indexed: DataFrame, positions: DataFrame, cost_bps: float) -> DataFrame:
    """positions (symbol, entry_idx, entry_price, qty) that are still held at their session's last bar: sold at its close."""
    entry = indexed.select("symbol", "session", F.col("idx").alias("entry_idx"))
    last = indexed.where("bars_left = 0").select("symbol", "session", F.col("idx").alias("exit_idx"), F.col("close").alias("_close"))
    exit_price = F.col("_close") * (1 - cost_bps * 1e-4)
    return positions.join(entry, ["symbol", "entry_idx"]).join(last, ["symbol", "session"]).select("symbol", "entry_idx", "exit_idx", "entry_price", exit_price.alias("exit_price"), (exit_price / F.col("entry_price") - 1).alias("net_ret"), F.lit("force_flat").alias("exit_reason"))


def askable(s: Settings, min_idx: int = 0) -> Column:
    """Bars at which a flat book may ask for a signal: enough history, on the stride, and room to hold in the session."""
    return (F.col("idx") >= max(s.min_history_bars, min_idx)) & (F.col("idx") % s.query_stride == 0) & (F.col("bars_left") >= s.horizon + 1)


def asked(signals: DataFrame, indexed: DataFrame, s: Settings, min_idx: int = 0) -> DataFrame:
    """The signals that the walk-forward asks for: (symbol, session, idx, direction).

    A trade that is entered for the bar after i leaves at the open horizon bars later, in the same session. So sessions are
    independent, and within one a fold over the askable bars keeps the first at which the book is free again.
    """
    live = indexed.where(askable(s, min_idx)).select("symbol", "session", "idx").join(signals.select("symbol", "idx", "direction"), ["symbol", "idx"])
    lists = live.groupBy("symbol", "session").agg(F.sort_array(F.collect_list(F.struct("idx", "direction"))).alias("bars"))
    start = F.struct(F.lit(-1).cast("long").alias("free"), F.filter("bars", lambda x: F.lit(False)).alias("out"))

    def step(state: Column, x: Column) -> Column:
        free = F.when(x["direction"] == "LONG", x["idx"] + 1 + s.horizon).otherwise(state["free"])
        return F.when(x["idx"] >= state["free"], F.struct(free.alias("free"), F.concat(state["out"], F.array(x)).alias("out"))).otherwise(state)

    return lists.select("symbol", "session", F.inline(F.aggregate("bars", start, step)["out"]))


def trades(asked_: DataFrame, indexed: DataFrame, s: Settings) -> DataFrame:
    """(symbol, session, signal_idx, entry_idx, exit_idx, signal_close, entry_price, exit_price, gross_ret, net_ret, exit_reason) of the LONG signals."""
    order = W.partitionBy("symbol", "session").orderBy("idx")
    ahead = indexed.select("symbol", "idx", F.col("close").alias("signal_close"), F.lead("open", 1).over(order).alias("_in"), F.lead("open", 1 + s.horizon).over(order).alias("_out"))
    c = s.cost_bps * 1e-4
    t = asked_.where("direction = 'LONG'").join(ahead, ["symbol", "idx"])
    t = t.withColumns({"entry_price": F.col("_in") * (1 + c), "exit_price": F.col("_out") * (1 - c)})
    return t.select("symbol", "session", F.col("idx").alias("signal_idx"), (F.col("idx") + 1).alias("entry_idx"), (F.col("idx") + 1 + s.horizon).alias("exit_idx"), "signal_close", "entry_price", "exit_price", (F.col("_out") / F.col("_in") - 1).alias("gross_ret"), (F.col("exit_price") / F.col("entry_price") - 1).alias("net_ret"), F.lit("time_stop").alias("exit_reason"))


def equity(trades_: DataFrame, indexed: DataFrame, s: Settings, cash: float = 100_000.0) -> DataFrame:
    """(symbol, session, idx, ts, equity) at each bar: cash compounded over the trades, the open one marked at the close.

    A trade multiplies equity by a factor that does not depend on it, so the curve is a running product: within sessions and
    over the table of sessions.
    """
    growth = 1 + s.position_size / F.col("signal_close") * (F.col("exit_price") - F.col("entry_price"))
    moved = trades_.withColumn("_g", growth)
    by_session = indexed.select("symbol", "session").distinct().join(moved.groupBy("symbol", "session").agg(F.product("_g").alias("_all")), ["symbol", "session"], "left")
    before = by_session.select("symbol", "session", F.coalesce(F.product("_all").over(W.partitionBy("symbol").orderBy("session").rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0)).alias("_before"))
    inside = W.partitionBy("symbol", "session").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    exits = moved.select("symbol", F.col("exit_idx").alias("idx"), "_g")
    opened = moved.select("symbol", F.col("entry_idx").alias("idx"), F.struct("exit_idx", "signal_close", "entry_price").alias("_t"))
    rows = indexed.select("symbol", "session", "idx", "ts", "close").join(exits, ["symbol", "idx"], "left").join(opened, ["symbol", "idx"], "left").join(before, ["symbol", "session"])
    rows = rows.withColumns({"_closed": cash * F.col("_before") * F.coalesce(F.product("_g").over(inside), F.lit(1.0)), "_t": F.last("_t", ignorenulls=True).over(inside)})
    held = F.col("_t").isNotNull() & (F.col("idx") < F.col("_t.exit_idx"))
    marked = F.col("_closed") * (1 + s.position_size / F.col("_t.signal_close") * (F.col("close") - F.col("_t.entry_price")))
    return rows.select("symbol", "session", "idx", "ts", F.when(held, marked).otherwise(F.col("_closed")).alias("equity"))


def summary(asked_: DataFrame, trades_: DataFrame, equity_: DataFrame, cash: float = 100_000.0) -> DataFrame:
    """The metrics of a walk-forward, one row per symbol."""
    bars = equity_.groupBy("symbol").agg(F.count_distinct("session").alias("n_sessions"), (F.max_by("equity", "idx") / cash - 1).alias("total_return"))
    falls = metrics.max_drawdown(equity_, "equity", "idx", ["symbol"], "session")
    queried = asked_.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_signals"), F.count_if(F.col("direction") == "LONG").alias("n_long_signals"))
    years = F.greatest(F.col("n_sessions") / YEAR, F.lit(1e-9))
    per = trades_.join(bars.select("symbol", "n_sessions"), "symbol").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_if(F.col("exit_reason") == "force_flat").alias("n_force_flat"), metrics.hit_rate("net_ret").alias("hit_rate"), F.avg("net_ret").alias("mean_net_ret"),
        metrics.sharpe("net_ret", F.count(F.lit(1)) / F.max(years)).alias("sharpe"),
    )
    out = bars.join(falls, "symbol").join(queried, "symbol", "left").join(per, "symbol", "left")
    return out.fillna(0, ["n_signals", "n_long_signals", "n_trades", "n_force_flat"])


def buy_and_hold(indexed: DataFrame, cost_bps: float) -> DataFrame:
    """(symbol, total_return, sharpe, max_drawdown) of the first open held to the last close."""
    c = cost_bps * 1e-4
    whole = indexed.groupBy("symbol").agg((F.max_by("close", "idx") * (1 - c) / (F.min_by("open", "idx") * (1 + c)) - 1).alias("total_return"))
    daily = indexed.groupBy("symbol", "session").agg(F.max_by("close", "idx").alias("close"))
    returns = daily.withColumn("r", F.col("close") / F.lag("close").over(W.partitionBy("symbol").orderBy("session")) - 1)
    return whole.join(returns.groupBy("symbol").agg(metrics.sharpe("r", YEAR).alias("sharpe")), "symbol").join(metrics.max_drawdown(indexed, "close", "idx", ["symbol"], "session"), "symbol")


def random_means(indexed: DataFrame, decisions: DataFrame, s: Settings, resamples: int, min_idx: int = 0) -> DataFrame:
    """(symbol, resample, mean_ret): as many entries as decisions (symbol, idx), at random bars of the same minutes of day.

    Each draw comes from a hash of seed, resample and the decision's number, with replacement among the bars of that
    minute at which the strategy could have decided. The returns of a minute are one array, a value per session, which its decisions meet; draws are looked up in it and summed within the task,
    so what is shuffled after that grows with the resamples, not with the decisions. Decisions are numbered within sessions and over the table of sessions.
    """
    order = W.partitionBy("symbol", "session").orderBy("idx")
    c = s.cost_bps * 1e-4
    rows = indexed.withColumns({"_in": F.lead("open", 1).over(order), "_out": F.lead("open", 1 + s.horizon).over(order)})
    open_to = rows.where((F.col("idx") >= max(s.min_history_bars, min_idx)) & (F.col("bars_left") >= s.horizon + 1))
    ret = F.col("_out") * (1 - c) / (F.col("_in") * (1 + c)) - 1
    pools = open_to.groupBy("symbol", "minute").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", ret.alias("ret")))), lambda x: x["ret"]).alias("pool"))
    decided = decisions.select("symbol", "idx").join(indexed.select("symbol", "session", "idx", "minute"), ["symbol", "idx"])
    sizes = decided.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("symbol", "session", F.coalesce(F.sum("_n").over(W.partitionBy("symbol").orderBy("session").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    wanted = decided.withColumn("_k", F.row_number().over(order) - 1).join(before, ["symbol", "session"]).select("symbol", "minute", (F.col("_before") + F.col("_k")).alias("ord"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(s.seed), "resample", "ord")), 1, 13), 16, 10).cast("long")
    drawn = wanted.join(pools, ["symbol", "minute"]).withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    picked = drawn.select("symbol", "resample", F.get("pool", (u % F.size("pool")).cast("int")).alias("ret"))
    return picked.groupBy("symbol", "resample").agg(F.avg("ret").alias("mean_ret"))


def p_value(means: DataFrame, strategy: DataFrame) -> DataFrame:
    """(symbol, p_value, n_resamples) against strategy (symbol, mean_net_ret): ties count against the strategy, and p is never 0."""
    beaten = F.count_if(F.round("mean_ret", 12) >= F.round("mean_net_ret", 12))
    return means.join(strategy, "symbol").groupBy("symbol").agg(((1 + beaten) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("n_resamples"))


def saved_trades(trades_: DataFrame, indexed: DataFrame, run_id: int) -> DataFrame:
    """(run_id, symbol, side, signal_ts, entry_ts, exit_ts, entry_price, exit_price, gross_return, net_return): the trades of a run as the log of trades keeps them."""
    at = indexed.select("symbol", "idx", "ts")
    out = trades_
    for name in ("signal", "entry", "exit"):
        out = out.join(at.select("symbol", F.col("idx").alias(f"{name}_idx"), F.col("ts").alias(f"{name}_ts")), ["symbol", f"{name}_idx"])
    return out.select(F.lit(run_id).cast("long").alias("run_id"), "symbol", F.lit("LONG").alias("side"), "signal_ts", "entry_ts", "exit_ts", "entry_price", "exit_price", F.col("gross_ret").alias("gross_return"), F.col("net_ret").alias("net_return"))
