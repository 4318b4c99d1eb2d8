from __future__ import annotations

import math
import random

import pytest
from conftest import BARS, minute_bars
from pyspark.sql import functions as F

from tapeforms.operators import bars as B
from tapeforms.operators import broker, journal, simulator
from tapeforms.plans.research import Study, match
from tapeforms.plans.settings import settings
from tapeforms.sources.store import EventLog
from tapeforms.streaming import live


@pytest.fixture(scope="module")
def indexed(spark):
    return B.indexed(spark.createDataFrame(minute_bars(5, 12), BARS)).cache()


def event_loop(rows, orders, cost_bps, cash):
    """The broker bar by bar, written from its rules."""
    qty, average, pending, status, curve = 0.0, 0.0, [], {}, []
    c = cost_bps * 1e-4
    for i, r in enumerate(rows):
        for o in pending:
            price = r.open * (1 + c if o["side"] == "buy" else 1 - c)
            if o["side"] == "buy":
                average = (average * qty + price * o["qty"]) / (qty + o["qty"]) if qty + o["qty"] else 0.0
                qty, cash = qty + o["qty"], cash - price * o["qty"]
            else:
                qty, cash = qty - o["qty"], cash + price * o["qty"]
                average = 0.0 if qty == 0 else average
            status[o["id"]] = ("filled", r.idx, price)
        pending = []
        if r.bars_left == 0 and qty > 0:
            cash, qty, average = cash + qty * r.close * (1 - c), 0.0, 0.0
        for o in orders.get(i, ()):
            if o["qty"] <= 0 or (o["side"] == "sell" and o["qty"] > qty):
                status[o["id"]] = ("rejected", None, None)
            else:
                status[o["id"]] = ("submitted", None, None)
                pending.append(o)
        curve.append((cash, qty, average, cash + qty * r.close))
    return status, curve


@pytest.mark.parametrize("seed", range(3))
def test_broker_equals_an_event_loop(spark, indexed, seed):
    """Several orders a bar, orders of a session's last bar, and pairs of sales that leave a session short."""
    rng = random.Random(seed)
    rows = indexed.orderBy("idx").collect()
    orders, n = {}, 0
    for i in range(len(rows)):
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            orders.setdefault(i, []).append({"id": n, "side": rng.choice(("buy", "sell", "sell")), "qty": float(rng.randint(0, 4))})
            n += 1
    status, curve = event_loop(rows, orders, 5.0, 1000.0)
    assert seed or any(q < 0 for _, q, _, _ in curve)
    df = spark.createDataFrame([(o["id"], "T", i, o["side"], o["qty"]) for i, some in orders.items() for o in some], "order_id long, symbol string, idx long, side string, qty double")
    got = {r.order_id: (r.status, r.fill_idx, r.fill_price) for r in simulator.fills(df, indexed, 5.0).collect()}
    assert got.keys() == status.keys()
    assert all(got[k][:2] == v[:2] and (v[2] is None or math.isclose(got[k][2], v[2])) for k, v in status.items())
    account = simulator.account_curve(df, indexed, 5.0, 1000.0).orderBy("idx").collect()
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6) for r, want in zip(account, curve, strict=True) for a, b in zip((r.cash, r.qty, r.avg_entry, r.equity), want, strict=True))


def test_a_time_without_a_bar_is_an_error(spark, indexed):
    bars = indexed.select("symbol", "ts", "close")
    assert B.at(bars, bars.limit(3)).count() == 3
    with pytest.raises(Exception, match="no bar of T at"):
        B.at(bars, spark.sql("select 'T' as symbol, timestamp_ntz'2024-01-08 03:00:00' as ts")).collect()


def test_a_loop_that_is_started_again_goes_on_and_decides_once(spark, indexed, tmp_path):
    s = settings({"horizon": 2, "force_flat_minutes_before_close": 2, "position_size": 0.5, "cost_bps": 0})
    day = indexed.withColumn("minute", F.col("minute") + 378)  # so that sessions end at the close
    rows = day.select("symbol", "idx", "ts", "minute", "open", "close", F.when(F.col("idx") % 4 == 0, "LONG").otherwise("NO_TRADE").alias("direction")).cache()
    whole = simulator.replay(rows, rows, s, 1, 10_000.0).orderBy("idx").collect()
    assert {"entry", "hold", "exit:time_stop", "too_close_to_enter", "no_trade:NO_TRADE"} <= {r.outcome for r in whole}
    log = EventLog(spark, str(tmp_path / "journal"), simulator.REPLAY)
    for part, (a, b) in enumerate(((0, 20), (10, 45), (0, 60))):  # bars come again after each start
        rows.where(f"idx between {a} and {b}").coalesce(1).write.parquet(str(tmp_path / f"in{part}"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / f"in{part}"))
        query = live.trade(stream, log, str(tmp_path / f"ck{part}"), s, 1, 10_000.0, survivors_only=False)
        query.processAllAvailable()
        query.stop()
    assert log.read().orderBy("idx").collect() == whole
    orders = simulator.orders_of(log.read())
    trades = journal.paired_trades(orders)
    entries = orders.where("intent = 'entry' and status = 'filled'").count()
    assert entries and trades.count() >= entries - 1
    last = whole[-1]
    profit = trades.agg(F.sum("pnl")).first()[0]
    assert math.isclose(last.equity - 10_000.0, profit + (last.held * (last.close - last.avg_entry)), abs_tol=1e-6)
    shots = simulator.snapshots(log.read())
    assert shots.where("qty is null and market_value is not null").isEmpty() and shots.where("qty is not null").count() == sum(r.held > 0 for r in whole)
    status = journal.full_status(orders, shots, spark.createDataFrame([("T", True)], "symbol string, armed boolean")).first()
    assert status.armed and status.n_filled == orders.where("status = 'filled'").count() and math.isclose(status.equity, last.equity)


def test_a_study_spends_before_it_computes(spark, tmp_path):
    bars = spark.createDataFrame(minute_bars(6, 40), BARS)
    study = Study(spark, str(tmp_path / "study"), bars)
    s = settings({"symbols": "T", "window": 4, "horizon": 2, "k": 3, "min_matches": 1, "dedup_gap": 1, "p_threshold": 0.5, "t_multiplier": 0, "min_history_bars": 20, "cost_bps": 0, "split_date": "2024-01-10"})
    with pytest.raises(KeyError):
        study.evaluate(s.hash)
    train = study.backtest(s, resamples=20)
    assert train["n_trades"] and 0 < train["p_random"] <= 1
    assert [(r.config_hash, r.n_runs) for r in study.ledger().collect()] == [(s.hash, 1)]
    survived, reasons, test = study.evaluate(s.hash, resamples=20)
    assert survived == (not reasons) and test["n_trades"] > 0
    assert study.trades.read().groupBy("run_id").count().count() == 2
    assert study.verdicts().first().verdict == ("SURVIVED" if survived else "REJECTED") and "1 TIME" in study.banner()
    broken = Study(spark, str(tmp_path / "study"), bars.withColumn("close", F.raise_error(F.lit("gone")).cast("double")))
    with pytest.raises(Exception, match="gone"):
        broken.evaluate(s.hash, resamples=20)
    assert sorted(r.verdict for r in study.verdicts().collect())[0] == "CRASHED" and "2 TIMES" in study.banner()


def test_match_looks_at_one_window_only(spark, indexed):
    s = settings({"window": 4, "horizon": 2, "k": 3, "dedup_gap": 1})
    found = match(indexed.select("symbol", "ts", *B.PRICES, "volume"), s, "2024-01-12 14:40:00")
    row = found.figures.first()
    assert row.n == 3 and row.n_candidates > 3
    top = found.head().collect()
    assert [r.kept_rank for r in top] == [1, 2, 3] and [r.dist for r in top] == sorted(r.dist for r in top)
    none = match(indexed.select("symbol", "ts", *B.PRICES, "volume"), s, "2024-01-08 14:36:00").figures.collect()
    assert all(r.n == 0 for r in none)


def test_what_a_broker_tells_and_what_never_reaches_it(spark):
    none = (None,) * 4
    told = spark.createDataFrame([("a", "T", "3", "BUY", "Filled", "1.5", "3"), ("b", "T", "", "sell", "done_for_day", *none[:2]), ("c", None, "x", None, None, *none[:2])], "id string, symbol string, qty string, side string, status string, filled_avg_price string, filled_qty string")
    got = broker.orders(told.withColumns({"submitted_at": F.lit(None), "filled_at": F.lit(None)})).orderBy("id").collect()
    assert [(r.qty, r.side, r.status, r.fill_price, r.filled_qty) for r in got] == [(3.0, "buy", "filled", 1.5, 3.0), (None, "sell", "rejected", None, None), (None, "buy", "open", None, None)]
    at = "timestamp_ntz'2024-01-08 {}:00:00'".format
    held = broker.positions(spark.sql(f"select * from values ('T', {at(10)}, '5', '2'), ('T', {at(12)}, '-5', '2'), ('U', {at(10)}, null, null) as t(symbol, ts, qty, avg_entry_price)"))
    assert sorted((r.symbol, r.qty, r.avg_entry) for r in held.collect() if r.qty > 0) == [("T", 5.0, 2.0)]
    wanted = spark.sql(f"select * from values (1, 'T', {at(11)}, 'sell', 5d), (2, 'T', {at(11)}, 'SELL', 6d), (3, 'T', {at(13)}, 'sell', 1d), (4, 'T', {at('09')}, 'sell', 1d), (5, 'U', {at(11)}, 'buy', 9d), (6, 'U', {at(11)}, 'buy', 0d), (7, null, {at(11)}, 'buy', null), (8, null, {at(11)}, 'sell', 1d) as t(order_id, symbol, ts, side, qty)")
    out = {r.order_id: (r.held, r.reason, r.status) for r in broker.screened(wanted, held).collect()}
    assert out == {1: (5.0, None, "submitted"), 2: (5.0, "no_shorting", "rejected"), 3: (0.0, "no_shorting", "rejected"), 4: (0.0, "no_shorting", "rejected"), 5: (0.0, None, "submitted"), 6: (0.0, "no_quantity", "rejected"), 7: (0.0, "no_quantity", "rejected"), 8: (0.0, "no_shorting", "rejected")}
    assert broker.screened(wanted.limit(0), held).isEmpty() and broker.screened(wanted, held.limit(0)).count() == 8
