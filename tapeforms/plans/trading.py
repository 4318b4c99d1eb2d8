"""Queries of orders, accounts and the trading loop, each with the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeforms.operators import backtest, journal, ledger, signals, simulator
from tapeforms.operators import bars as B
from tapeforms.plans import catalog as C
from tapeforms.plans.catalog import BARS_SQL, CASH, COST, MINUTES, bars, num, query, shown, table
from tapeforms.sources import folders

SPLIT = "2024-01-15"


# Orders of every bar: purchases, sales that what is held may not cover, and orders without quantity.
def bar_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("pos") % 5 < 3, "buy").otherwise("sell")
    return bars(spark, sf_dir).select(F.col("idx").alias("order_id"), "symbol", "idx", side.alias("side"), ((F.col("idx") * 7) % 6).cast("double").alias("qty"))


def _broker_sql(select: str) -> str:
    fill = f"j.open * CASE WHEN s.side = 'buy' THEN 1 + {COST} ELSE 1 - {COST} END"
    return f"""WITH RECURSIVE {BARS_SQL}, j AS (
  SELECT idx, ts, open, close, bars_left, CASE WHEN pos % 5 < 3 THEN 'buy' ELSE 'sell' END AS side, ((idx * 7) % 6)::DOUBLE AS oq FROM x
), sim AS (
  SELECT idx, 0.0::DOUBLE AS qty, 0.0::DOUBLE AS average, {CASH}::DOUBLE AS cash, close, side, oq, oq > 0 AND side = 'buy' AS ok, NULL::DOUBLE AS price FROM j WHERE idx = 0
  UNION ALL
  SELECT idx, q2, CASE WHEN q2 = 0 THEN 0.0 ELSE a1 END, c1 + CASE WHEN q1 > 0 AND q2 = 0 THEN q1 * close * (1 - {COST}) ELSE 0 END, close, side, oq, oq > 0 AND (side = 'buy' OR oq <= q2), price
  FROM (SELECT *, CASE WHEN bars_left = 0 AND q1 > 0 THEN 0.0 ELSE q1 END AS q2 FROM (
    SELECT j.idx, j.close, j.bars_left, j.side, j.oq, CASE WHEN s.ok THEN {fill} END AS price,
           s.qty + CASE WHEN NOT s.ok THEN 0.0 WHEN s.side = 'buy' THEN s.oq ELSE -s.oq END AS q1,
           s.cash + CASE WHEN NOT s.ok THEN 0.0 WHEN s.side = 'buy' THEN -s.oq * {fill} ELSE s.oq * {fill} END AS c1,
           CASE WHEN s.ok AND s.side = 'buy' THEN (s.average * s.qty + s.oq * {fill}) / (s.qty + s.oq) ELSE s.average END AS a1
    FROM sim s JOIN j ON j.idx = s.idx + 1))
) {select}"""


query("fills", _broker_sql(f"""SELECT a.idx AS order_id, 'EVT' AS symbol, a.idx, a.side, a.oq AS qty, CASE WHEN NOT a.ok THEN 'rejected' WHEN b.idx IS NULL THEN 'submitted' ELSE 'filled' END AS status,
  CASE WHEN a.oq <= 0 THEN 'no_quantity' WHEN NOT a.ok THEN 'no_shorting' END AS reason, CASE WHEN a.ok THEN b.idx END AS fill_idx, {num('CASE WHEN a.ok THEN b.price END', 'fill_price')} FROM sim a LEFT JOIN sim b ON b.idx = a.idx + 1"""))(
    lambda s, d: shown(simulator.fills(bar_orders(s, d), bars(s, d), C.KNN.cost_bps))
)
query("account_curve", _broker_sql(f"SELECT 'EVT' AS symbol, idx, {num('cash', 'cash')}, {num('qty', 'qty')}, {num('average + 1e-9', 'avg_entry')}, {num('cash + qty * close', 'equity')} FROM sim"))(  # averages of two prices end in a 5 at the place that is rounded
    lambda s, d: shown(simulator.account_curve(bar_orders(s, d), bars(s, d), C.KNN.cost_bps).withColumn("avg_entry", F.col("avg_entry") + 1e-9))
)

#: On 15-minute bars the last order that still fills in its session is that of the bar before the last.
LIVE = replace(C.CANDLE, enable_shorts=False, force_flat_minutes_before_close=20, position_size=0.25)


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bars(spark, sf_dir)
    return folders.cut(simulator.replay(x, signals.signals(x, LIVE), LIVE, MINUTES, CASH))


def _live_sql(select: str) -> str:
    fill = f"j.open * CASE WHEN s.side = 'buy' THEN 1 + {COST} ELSE 1 - {COST} END"
    s = LIVE
    return f"""WITH RECURSIVE {BARS_SQL}, {C.CANDLE_SQL.split(BARS_SQL + ', ')[1]}, j AS (
  SELECT x.idx, x.ts, x.open, x.close, 960 - x.minute - {MINUTES} AS left_, CASE WHEN c.direction = 'LONG' THEN 'LONG' ELSE 'NO_TRADE' END AS direction FROM x JOIN candle c ON c.idx = x.idx
), sim AS (
  SELECT *, CASE WHEN outcome = 'entry' THEN 'buy' END AS side, CASE WHEN outcome = 'entry' THEN floor({CASH} * {s.position_size} / close) END AS oq, CASE WHEN outcome = 'entry' THEN idx END AS entry FROM (
    SELECT idx, ts, close, 0.0::DOUBLE AS held, 0.0::DOUBLE AS average, {CASH}::DOUBLE AS cash, NULL::DOUBLE AS price,
           CASE WHEN left_ <= {s.force_flat_minutes_before_close + s.horizon} THEN 'too_close_to_enter' WHEN direction <> 'LONG' THEN 'no_trade:' || direction WHEN floor({CASH} * {s.position_size} / close) <= 0 THEN 'size_zero' ELSE 'entry' END AS outcome
    FROM j WHERE idx = 0)
  UNION ALL
  SELECT idx, ts, close, held, average, cash, price, outcome, CASE WHEN outcome = 'entry' THEN 'buy' WHEN starts_with(outcome, 'exit:') THEN 'sell' END, CASE WHEN outcome = 'entry' THEN size WHEN starts_with(outcome, 'exit:') THEN held END,
         CASE WHEN outcome = 'entry' THEN idx ELSE entry END
  FROM (SELECT *, CASE WHEN held > 0 THEN CASE WHEN left_ <= {s.force_flat_minutes_before_close} THEN 'exit:force_flat' WHEN idx - entry >= {s.horizon} THEN 'exit:time_stop' ELSE 'hold' END
                 WHEN left_ <= {s.force_flat_minutes_before_close + s.horizon} THEN 'too_close_to_enter' WHEN direction <> 'LONG' THEN 'no_trade:' || direction WHEN size <= 0 THEN 'size_zero' ELSE 'entry' END AS outcome
    FROM (SELECT *, floor((cash + held * close) * {s.position_size} / close) AS size FROM (
      SELECT j.idx, j.ts, j.close, j.left_, j.direction, CASE WHEN s.side IS NOT NULL THEN {fill} END AS price,
             CASE s.side WHEN 'buy' THEN s.held + s.oq WHEN 'sell' THEN 0.0 ELSE s.held END AS held,
             CASE s.side WHEN 'buy' THEN {fill} WHEN 'sell' THEN 0.0 ELSE s.average END AS average,
             CASE s.side WHEN 'buy' THEN s.cash - s.oq * {fill} WHEN 'sell' THEN s.cash + s.oq * {fill} ELSE s.cash END AS cash,
             CASE WHEN s.side = 'sell' THEN NULL ELSE s.entry END AS entry
      FROM sim s JOIN j ON j.idx = s.idx + 1)))
), lo AS (
  SELECT a.idx AS broker_order_id, 'EVT' AS symbol, CASE WHEN a.side = 'buy' THEN 'entry' ELSE substr(a.outcome, 6) END AS intent, a.side, a.oq AS qty, a.ts AS submitted_at, CASE WHEN b.idx IS NULL THEN 'open' ELSE 'filled' END AS status, b.ts AS filled_at, b.price AS filled_avg_price
  FROM sim a LEFT JOIN sim b ON b.idx = a.idx + 1 WHERE a.side IS NOT NULL
), sn AS (
  SELECT ts, CASE WHEN held > 0 THEN held END AS qty, CASE WHEN held > 0 THEN average END AS avg_entry, CASE WHEN held > 0 THEN held * close END AS market_value, CASE WHEN held > 0 THEN held * (close - average) END AS unrealized_pl, cash + held * close AS account_equity FROM sim
), tr AS (
  SELECT *, exit_price / entry_price - 1 AS net_ret, qty * (exit_price - entry_price) AS pnl FROM (
    SELECT lag(filled_at) OVER w AS entry_ts, filled_at AS exit_ts, lag(qty) OVER w AS qty, lag(filled_avg_price) OVER w AS entry_price, filled_avg_price AS exit_price, intent, lag(intent) OVER w AS before
    FROM lo WHERE status = 'filled' WINDOW w AS (ORDER BY filled_at, broker_order_id)) WHERE intent <> 'entry' AND before = 'entry'
), week AS (SELECT * FROM sn WHERE ts <= TIMESTAMP '{C.CUT}' AND ts >= TIMESTAMP '{C.CUT}' - INTERVAL 7 DAY
) {select}"""


def week_end():
    return F.lit(C.CUT).cast("timestamp_ntz")


def armed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the configuration of each symbol has a verdict that lets it trade: here c5 of the evaluations."""
    v = ledger.verdicts(C.evaluations(spark, sf_dir))
    return ledger.armed(v.where("config_hash = 'c5'").select("config_hash").distinct(), v).select(F.lit("EVT").alias("symbol"), "armed")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = replayed(spark, sf_dir)
    mean = C.walk(spark, sf_dir, C.CANDLE)[2].groupBy("symbol").agg(F.avg("net_ret").alias("backtest_mean"))
    return shown(journal.weekly_rows(journal.paired_trades(simulator.orders_of(r)), simulator.snapshots(r), bars(spark, sf_dir), mean, week_end()))


WALK_MEAN = C._walk_sql(C.CANDLE_SQL, "candle")
query("live_replay", _live_sql(f"SELECT 'EVT' AS symbol, idx, ts::VARCHAR AS ts, outcome, {num('held', 'held')}, {num('average', 'avg_entry')}, {num('cash', 'cash')}, {num('cash + held * close', 'equity')}, side AS order_side, {num('oq', 'order_qty')}, entry AS entry_idx FROM sim"))(
    lambda s, d: shown(replayed(s, d).select("symbol", "idx", "ts", "outcome", "held", "avg_entry", "cash", "equity", "order_side", "order_qty", "entry_idx"))
)
query("live_orders", _live_sql(f"SELECT broker_order_id, symbol, intent, side, {num('qty', 'qty')}, submitted_at::VARCHAR AS submitted_at, status, filled_at::VARCHAR AS filled_at, {num('filled_avg_price', 'filled_avg_price')} FROM lo"))(lambda s, d: shown(simulator.orders_of(replayed(s, d))))
query("snapshots", _live_sql("SELECT 'EVT' AS symbol, ts::VARCHAR AS ts, " + ", ".join(num(c, c) for c in ("qty", "avg_entry", "market_value", "unrealized_pl", "account_equity")) + " FROM sn"))(lambda s, d: shown(simulator.snapshots(replayed(s, d))))
query("status_full", _live_sql(f"""SELECT 'EVT' AS symbol, max(ts)::VARCHAR AS last_snapshot, {num('coalesce(arg_max_null(qty, ts), 0)', 'qty')}, {num('arg_max_null(avg_entry, ts)', 'avg_entry')}, {num('arg_max(account_equity, ts)', 'equity')}, (SELECT count(*) FILTER (status = 'filled') FROM lo) AS n_filled,
  (SELECT count(*) FILTER (status = 'filled' AND intent <> 'entry') FROM lo) AS n_closed, (SELECT count(*) FILTER (status = 'open') FROM lo) AS n_open,
  coalesce((SELECT bool_or(verdict = 'SURVIVED') FROM (SELECT coalesce(max(v), 'CRASHED') AS verdict FROM (SELECT event_id // 2 AS e, CASE WHEN event_id % 2 = 1 AND event_id % 3 <> 0 THEN CASE WHEN event_id % 5 = 0 THEN 'SURVIVED' ELSE 'REJECTED' END END AS v FROM events WHERE (event_id // 2) % 29 = 5) GROUP BY e)), false) AS armed FROM sn"""))(
    lambda s, d: (lambda r: shown(journal.full_status(simulator.orders_of(r), simulator.snapshots(r), armed(s, d))))(replayed(s, d))
)
query("equity_series", _live_sql(f"SELECT 'EVT' AS symbol, ts::VARCHAR AS ts, {num('account_equity', 'equity')} FROM week"))(lambda s, d: shown(journal.equity_series(simulator.snapshots(replayed(s, d)), week_end())))
query(
    "weekly_report_rows",
    _live_sql(f"""SELECT 'EVT' AS symbol, n_trades, {num('hit_rate', 'hit_rate')}, {num('mean_net_ret', 'mean_net_ret')}, {num('total_pnl', 'total_pnl')}, {num('m', 'backtest_mean')}, {num('mean_net_ret - m', 'divergence')}, {num('e0', 'equity_start')}, {num('e1', 'equity_end')}, {num('bh', 'bh_return')}
FROM (SELECT count(*) AS n_trades, avg((net_ret > 0)::INT) AS hit_rate, avg(net_ret) AS mean_net_ret, sum(pnl) AS total_pnl FROM tr WHERE exit_ts <= TIMESTAMP '{C.CUT}' AND exit_ts >= TIMESTAMP '{C.CUT}' - INTERVAL 7 DAY),
     (SELECT arg_min(account_equity, ts) AS e0, arg_max(account_equity, ts) AS e1, min(ts) AS t0, max(ts) AS t1 FROM week),
     (SELECT CASE WHEN count(*) >= 2 THEN arg_max(close, ts) / arg_min(close, ts) - 1 END AS bh FROM x WHERE ts BETWEEN (SELECT min(ts) FROM week) AND (SELECT max(ts) FROM week)),
     (SELECT avg(net_ret) AS m FROM (WITH RECURSIVE {WALK_MEAN} SELECT net_ret FROM trades))"""),
)(weekly)


# A run is an event when it begins (even event_id) and one when it ends (odd), unless it never does.
def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    begins = e % 2 == 0
    return table(spark, sf_dir, "events").where(begins | (e % 3 != 0)).select(
        F.floor(e / 2).alias("id"), e.alias("seq"), F.when(begins, F.concat(F.lit("c"), (F.col("user_id") % 17).cast("string"))).alias("config_hash"), F.when(begins, e).alias("started_at"), F.when(~begins, e).alias("finished_at"),
        F.when(begins, "running").when(e % 7 == 0, "failed").otherwise("ok").alias("status"),
    )


query("run_registry", """SELECT id, max(config_hash) AS config_hash, max(started_at) AS started_at, max(finished_at) AS finished_at, arg_max(status, seq) AS status FROM (
  SELECT event_id // 2 AS id, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'c' || (user_id % 17) END AS config_hash, CASE WHEN event_id % 2 = 0 THEN event_id END AS started_at, CASE WHEN event_id % 2 = 1 THEN event_id END AS finished_at,
         CASE WHEN event_id % 2 = 0 THEN 'running' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM events WHERE event_id % 2 = 0 OR event_id % 3 <> 0) GROUP BY id""")(
    lambda s, d: ledger.current(run_events(s, d), "id").select("id", "config_hash", "started_at", "finished_at", "status")
)
query("save_trades", f"WITH RECURSIVE {WALK_MEAN} SELECT 7::BIGINT AS run_id, 'EVT' AS symbol, 'LONG' AS side, a.ts::VARCHAR AS signal_ts, b.ts::VARCHAR AS entry_ts, c.ts::VARCHAR AS exit_ts, {num('entry_price', 'entry_price')}, {num('exit_price', 'exit_price')}, {num('gross_ret', 'gross_return')}, {num('net_ret', 'net_return')} FROM trades t JOIN x a ON a.idx = t.signal_idx JOIN x b ON b.idx = t.entry_idx JOIN x c ON c.idx = t.exit_idx")(
    lambda s, d: (lambda x, _, t: shown(backtest.saved_trades(t, x, 7)))(*C.walk(s, d, C.CANDLE))
)
query("bars_at", f"WITH {BARS_SQL} SELECT symbol, ts::VARCHAR AS ts, {C.PRICE_SQL} FROM x WHERE bars_left = 0")(
    lambda s, d: (lambda x: shown(B.at(x.select("symbol", "ts", *B.PRICES), x.groupBy("symbol", "session").agg(F.max("ts").alias("ts")))))(bars(s, d))
)
query("train_bars", f"WITH {BARS_SQL} SELECT symbol, idx, ts::VARCHAR AS ts FROM x WHERE session <= DATE '{SPLIT}'")(lambda s, d: shown(B.before_split(bars(s, d), SPLIT).select("symbol", "idx", "ts")))
query("first_test_idx", f"WITH {BARS_SQL} SELECT symbol, min(idx) FILTER (session > DATE '{SPLIT}') AS first_test_idx FROM x GROUP BY 1")(lambda s, d: shown(B.first_test_idx(bars(s, d), SPLIT)))

# Long only, the default of the settings.
LONG_KNN, LONG_TEMPLATE, LONG_CANDLE = (replace(c, enable_shorts=False) for c in (C.KNN, C.TEMPLATE, C.CANDLE))
DISABLED = "CASE WHEN direction = 'SHORT' THEN 'NO_TRADE' ELSE direction END AS direction"
query("knn_signals_long_only", f"WITH {C.KNN_SQL} SELECT symbol, idx, {DISABLED}, reason FROM knn")(lambda s, d: shown(signals.signals(bars(s, d), LONG_KNN).select("symbol", "idx", "direction", "reason")))
query("template_signals_long_only", f"WITH {C.TEMPLATE_SQL} SELECT symbol, idx, {DISABLED}, CASE WHEN direction = 'SHORT' THEN 'shorts_disabled' ELSE reason END AS reason FROM template")(lambda s, d: shown(signals.signals(bars(s, d), LONG_TEMPLATE).select("symbol", "idx", "direction", "reason")))
query("candle_signals_long_only", f"WITH {C.CANDLE_SQL} SELECT symbol, idx, {DISABLED}, CASE WHEN direction = 'SHORT' THEN 'shorts_disabled' ELSE reason END AS reason FROM candle")(lambda s, d: shown(signals.signals(bars(s, d), LONG_CANDLE).select("symbol", "idx", "direction", "reason")))
