from __future__ import annotations

import datetime as dt

from conftest import BARS, minute_bars
from pyspark.sql import functions as F

from tapeforms import cli
from tapeforms.sources import shards

CONFIG = """symbols: [t]            # one
signal_source: candles
candle_patterns: [hammer, shooting_star, bullish_engulfing,
                  bearish_engulfing, piercing_line]
candle_trend_lookback: 2
window: 4
horizon: 2
min_history_bars: 20
cost_bps: 0
split_date: "2024-01-10"
force_flat_minutes_before_close: 2
"""


def test_from_shards_to_a_weekly_report(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "config.yaml").write_text(CONFIG + f"warehouse: {tmp_path}/w\ndb_path: {tmp_path}/db\n")

    def ran(*argv):
        code = cli.main(list(argv), spark)
        said = capsys.readouterr()
        return code, said.out + said.err

    assert "no bars of T" in ran("backtest")[1] and ran("match", "--asof", "2024-01-12 09:50")[0] == 1
    late = dt.timedelta(minutes=350)
    bars = spark.createDataFrame([(r[0], r[1] + late, *r[2:]) for r in minute_bars(6, 40)], BARS)
    shards.write(bars.withColumns({"source": F.lit("t"), "ingested_at": F.col("ts")}), f"file://{tmp_path}/db")
    assert "240 bars in 6 sessions" in ran("data", "refresh")[1] and "240 bars" in ran("data", "status", "--set", "seed=1")[1]
    code, said = ran("match", "--asof", "2024-01-12 15:30", "--set", "k=3", "--set", "dedup_gap=1")
    assert code == 0 and "3 kept" in said and said.count("distance") == 3
    key = ran("config")[1].split("config_hash: ")[1].strip()
    assert "backtest it first" in ran("evaluate", key, "--yes")[1]
    code, said = ran("backtest", "--resamples", "20")
    assert code == 0 and "n_trades" in said and key in said and key in ran("ledger")[1]
    assert ran("trade")[0] == 1 and "has passed no evaluation" in ran("trade")[1]
    monkeypatch.setattr("builtins.input", lambda _: "no")
    assert "nothing is spent" in ran("evaluate", key)[1]
    code, said = ran("evaluate", key, "--yes", "--resamples", "20")
    assert code == 0 and ("SURVIVED" in said or "REJECTED" in said) and "1 TIME" in said
    cli.Desk(spark, cli.from_yaml("config.yaml")).logs().evaluations.append([(1, key, 1, "SURVIVED", None)])
    code, said = ran("trade")
    assert code == 0 and "armed" in said and "T at 2024-01-13" in said
    assert ran("trade") == (code, said) == (0, ran("status")[1])  # again: nothing new
    code, said = ran("report", "weekly", "--days", "30")
    assert code == 0 and "# Weekly report" in said and len(list((tmp_path / "reports").iterdir())) == 1
    assert ran("config", "--set", "nothing=1")[0] == 1


def test_knn_signals_are_traded(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "config.yaml").write_text(CONFIG.replace("signal_source: candles", "signal_source: knn_shape") + f"k: 3\ndedup_gap: 1\nmin_matches: 2\nt_multiplier: 0.5\nwarehouse: {tmp_path}/w\ndb_path: {tmp_path}/db\n")
    bars = spark.createDataFrame([(r[0], r[1] + dt.timedelta(minutes=350), *r[2:]) for r in minute_bars(3, 30)], BARS)
    shards.write(bars.withColumns({"source": F.lit("t"), "ingested_at": F.col("ts")}), f"file://{tmp_path}/db")
    assert cli.main(["trade"], spark) == 1 and "has passed no evaluation" in capsys.readouterr().err
    desk = cli.Desk(spark, cli.from_yaml("config.yaml"))
    desk.logs().evaluations.append([(1, desk.s.hash, 1, "SURVIVED", None)])
    assert cli.main(["trade"], spark) == 0
    assert "T at 2024-01-10" in capsys.readouterr().out and {"entry", "no_trade"} <= {r.outcome.split(":")[0] for r in desk.journal().collect()} and desk.journal().count() == 90
