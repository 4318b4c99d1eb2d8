from __future__ import annotations

import datetime as dt
import time

import pytest
from conftest import BARS, minute_bars
from pyspark.sql import functions as F

from tapeforms.operators import bars as B
from tapeforms.operators import signals, simulator
from tapeforms.plans.settings import settings
from tapeforms.streaming import live
from tapeforms.streaming import signals as S

CONFIG = {"symbols": "T", "signal_source": "candles", "window": 4, "horizon": 2, "candle_trend_lookback": 2, "force_flat_minutes_before_close": 2, "position_size": 0.5, "cost_bps": 0}


def two_symbols(spark):
    rows = [*minute_bars(3, 40), *minute_bars(2, 25, seed=5, symbol="U")]
    late = dt.timedelta(minutes=350)  # so that sessions come near the close
    return spark.createDataFrame([(r[0], r[1] + late, *r[2:]) for r in rows], BARS).cache()


def in_parts(spark, bars, folder, cuts):
    """A stream of the bars of each part after the other, from one checkpoint; what it gives in all."""
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = bars.withColumn("_k", F.row_number().over(B.W.partitionBy("symbol").orderBy("ts"))).where(f"_k > {a} and _k <= {b}").drop("_k")
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        yield spark.readStream.schema(bars.schema).parquet(f"{folder}/in")


def test_signals_and_decisions_of_a_stream_that_is_started_again_equal_those_of_the_batch(spark, tmp_path):
    bars = two_symbols(spark)
    x = B.indexed(B.regular_hours(bars)).cache()
    candle, template = settings(CONFIG), settings(CONFIG | {"signal_source": "template", "template_threshold": 2.0})
    with S.rocks(spark):
        for stream in in_parts(spark, bars, str(tmp_path / "s"), (0, 7, 33, 40, 200)):
            out = S.stream_signals(stream, template, candle)
            query = out.writeStream.format("parquet").option("path", str(tmp_path / "s" / "out")).option("checkpointLocation", str(tmp_path / "s" / "ck")).trigger(availableNow=True).start()
            query.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "s" / "out"))
        for s in (template, candle):
            want = signals.signals(x, s).select("symbol", "idx", "ts", "direction", "reason", "pattern", "n_matched", "matched")
            assert sorted(map(str, got.where(F.col("source") == s.signal_source).select(*want.columns).collect())) == sorted(map(str, want.collect()))
            assert want.where("direction <> 'NO_TRADE' or reason <> 'no_window'").count() > 10
        for stream in in_parts(spark, bars, str(tmp_path / "d"), (0, 30, 31, 200)):
            out = S.decisions(S.stream_signals(stream, candle), candle, 1, 10_000.0)
            query = out.writeStream.format("parquet").option("path", str(tmp_path / "d" / "out")).option("checkpointLocation", str(tmp_path / "d" / "ck")).trigger(availableNow=True).start()
            query.awaitTermination()
    want = simulator.replay(x, signals.signals(x, candle), candle, 1, 10_000.0)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "d" / "out")).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {"entry", "hold", "too_close_to_enter"} <= {r.outcome for r in want.collect()}


def test_a_loop_looks_again_without_a_new_bar(spark, tmp_path):
    s = settings(CONFIG)
    x = B.indexed(B.regular_hours(two_symbols(spark))).where("symbol = 'T' and idx < 5")
    rows = x.select("symbol", "idx", "ts", "minute", "open", "close", F.lit("NO_TRADE").alias("direction"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    with S.rocks(spark):
        out = S.decisions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), s, 1, 10_000.0, poll=0.01)
        query = out.writeStream.format("memory").queryName("looks").option("checkpointLocation", str(tmp_path / "ck")).start()
        until = time.time() + 60  # a stream with timers is never without work
        while time.time() < until and spark.table("looks").where(~S.is_bar()).count() < 2:
            time.sleep(0.5)
        query.stop()
    looks = spark.table("looks")
    assert looks.where(S.is_bar()).count() == 5
    assert {r.outcome for r in looks.where(~S.is_bar()).collect()} <= {"market_closed", "already_decided"} and looks.where(~S.is_bar()).count() >= 2


def test_what_a_look_without_a_bar_comes_to():
    s = settings(CONFIG)
    monday, sunday = dt.datetime(2024, 1, 8, 15, 0, tzinfo=dt.UTC), dt.datetime(2024, 1, 7, 15, 0, tzinfo=dt.UTC)
    trader = simulator.Trader(s, 1, 10_000.0)
    assert S.idle_outcome(trader, sunday) == "market_closed" and S.idle_outcome(trader, monday) == "already_decided"
    trader.order = ("buy", 3.0, "entry")
    assert S.idle_outcome(trader, monday) == "entry_pending"
    trader.order, trader.held = ("sell", 3.0, "time_stop"), 3.0
    assert S.idle_outcome(trader, monday) == "exit_pending"
    trader.order = None
    assert S.idle_outcome(trader, monday) == "hold"
    assert S.next_look(monday, 60) == 60 and S.next_look(sunday, 20) == 200 and S.next_look(sunday, 90) == 600


def test_only_survivors_trade(spark, tmp_path):
    s = settings(CONFIG)
    columns = "config_hash string, verdict string"
    for verdicts in (None, spark.createDataFrame([(s.hash, "REJECTED"), ("other", "SURVIVED")], columns)):
        with pytest.raises(S.NotASurvivor):
            live.trade(None, None, str(tmp_path), s, 1, verdicts=verdicts)
        with pytest.raises(S.NotASurvivor):
            S.traded(None, s, 1, verdicts)
    S.require_survivor(spark.createDataFrame([(s.hash, "SURVIVED"), (s.hash, "CRASHED")], columns), s)
