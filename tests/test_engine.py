from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from conftest import BARS, minute_bars

from pyspark.sql import functions as F
from tapeforms.functions import candles, templates
from tapeforms.operators import backtest, neighbours, signals, windows
from tapeforms.operators import bars as B
from tapeforms.plans.settings import Settings, from_yaml, settings

SMALL = Settings(symbols=("T",), window=5, horizon=3, k=5, dedup_gap=2, min_matches=3, min_history_bars=20, candle_trend_lookback=3, template_threshold=1.5, enable_shorts=True)


@pytest.fixture(scope="module")
def indexed(spark):
    return B.indexed(spark.createDataFrame(minute_bars(), BARS)).cache()


def test_index_runs_over_sessions(indexed):
    rows = indexed.orderBy("ts").collect()
    assert [r.idx for r in rows] == list(range(120))
    assert [r.bars_left for r in rows[:40]] == list(range(39, -1, -1))
    assert {r.minute for r in rows if r.pos == 0} == {570}


def test_regular_hours_keep_the_open_and_drop_the_close(spark):
    rows = [("T", t, 1.0, 1.0, 1.0, 1.0, 1.0) for t in ("2024-01-08 14:29:00", "2024-01-08 14:30:00", "2024-01-08 20:59:00", "2024-01-08 21:00:00", "2024-07-08 13:30:00", "2024-07-08 20:00:00")]
    df = spark.createDataFrame(rows, "symbol string, ts string, open double, high double, low double, close double, volume double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(str(r.ts) for r in B.regular_hours(df).collect()) == ["2024-01-08 14:30:00", "2024-01-08 20:59:00", "2024-07-08 13:30:00"]


def test_the_forming_bar_is_hidden(spark):
    df = spark.createDataFrame(minute_bars(1, 5), BARS)
    seen = B.closed(df, F.lit("2024-01-08 14:33:20")).count()
    assert seen == 3


def test_windows_stay_in_their_session_and_are_normal(indexed):
    w = windows.windows(indexed, 5, 3).orderBy("end_idx").collect()
    assert len(w) == 3 * 35 and sum(r.fwd_ret is None for r in w) == 3 * 3
    for r in w[:20]:
        assert abs(math.fsum(r.z)) < 1e-9 and math.isclose(math.fsum(v * v for v in r.z) / 5, 1, rel_tol=1e-9)
    assert len(windows.windows(indexed, 5, 3, "ohlc").first().x) == 20


def test_current_window_is_carried_over_the_night(indexed):
    got = {r.idx: r.q_end for r in windows.current_window(indexed, 5).collect()}
    assert got[4] is None and got[5] == 5 and got[40] == got[44] == 39 and got[45] == 45


def test_neighbours_equal_brute_force_and_never_look_ahead(indexed):
    w = windows.windows(indexed, 5, 3).cache()
    q = w.where("valid").select("symbol", F.col("end_idx").alias("q_end"), F.col("z").alias("qz"))
    near = {(r.q_end, r.rank): r.end_idx for r in neighbours.nearest(neighbours.distances(w, q, 5, 3, 5, block=16), 2).collect()}
    blocked = {(r.q_end, r.rank): r.end_idx for r in neighbours.nearest_by_blocks(w, q, 5, 3, 2, block=16).collect()}
    rows = w.collect()
    want = {}
    for a in rows:
        some = sorted((round(math.dist(a.z, b.z), 9), b.end_idx) for b in rows if b.fwd_ret is not None and b.end_idx + 3 <= a.end_idx - 5)
        want |= {(a.end_idx, i + 1): e for i, (_, e) in enumerate(some[:10])}
    assert near == blocked == want


def test_wide_windows_by_blocks_equal_all_pairs(spark):
    """Windows of 30 values and many neighbours, over several blocks, chunks and symbols."""
    rng = random.Random(3)
    rows = [(symbol, None, i, dt.datetime(2024, 1, 8) + dt.timedelta(minutes=i), [rng.gauss(0, 1) for _ in range(30)], rng.random() > 0.1, rng.gauss(0, 1) if rng.random() > 0.1 else None) for symbol in ("A", "B") for i in range(300)]
    w = spark.createDataFrame(rows, "symbol string, session date, end_idx long, end_ts timestamp_ntz, z array<double>, valid boolean, fwd_ret double")
    q = w.where("valid").select("symbol", F.col("end_idx").alias("q_end"), F.col("z").alias("qz"))
    got = {(r.symbol, r.q_end, r["rank"]): (r.end_idx, r.dist, r.fwd_ret, r.end_ts) for r in neighbours.nearest_by_blocks(w, q, 30, 15, 10, block=64, chunk=32).collect()}
    want = {}
    for a in rows:
        if a[5]:
            some = sorted((round(math.dist(a[4], b[4]), 9), b[2], b[6], b[3]) for b in rows if b[0] == a[0] and b[5] and b[6] is not None and b[2] + 15 <= a[2] - 30)
            want |= {(a[0], a[2], i + 1): (e, d, f, t) for i, (d, e, f, t) in enumerate(some[: neighbours.BUFFER * 10])}
    assert len(want) > 10_000 and got == want


def test_overlaps_at_exactly_the_gap_go(spark):
    rows = [("T", 100, r, e, None, float(r), 0.1) for r, e in enumerate((10, 12, 13, 16, 30, 50), 1)]
    df = spark.createDataFrame(rows, "symbol string, q_end long, rank int, end_idx long, end_ts timestamp_ntz, dist double, fwd_ret double")
    kept = [r.end_idx for r in neighbours.without_overlaps(df, 3, 2).orderBy("kept_rank").collect()]
    assert kept == [10, 13, 16]


@pytest.mark.parametrize("source", ["knn_shape", "template", "candles"])
def test_signals_do_not_depend_on_the_future(spark, source):
    s = settings({k: getattr(SMALL, k) for k in ("window", "horizon", "k", "dedup_gap", "min_matches", "min_history_bars", "candle_trend_lookback", "template_threshold", "enable_shorts")} | {"signal_source": source})
    rows = minute_bars()
    changed = [(*r[:2], *(p * 1.37 for p in r[2:6]), r[6]) if i > 80 else r for i, r in enumerate(rows)]
    both = [{r.idx: (r.direction, r.reason) for r in signals.signals(B.indexed(spark.createDataFrame(x, BARS)), s).where("idx <= 80").collect()} for x in (rows, changed)]
    assert both[0] == both[1] and len(both[0]) == 81


def test_each_template_is_its_own_nearest():
    vectors = {n: templates.template_vector(a, 10) for n, (_, a) in templates.TEMPLATES.items()}
    for n, v in vectors.items():
        assert min(vectors, key=lambda m: math.dist(v, vectors[m])) == n
    with pytest.raises(KeyError):
        templates.chosen(("nothing",))
    with pytest.raises(ValueError):
        templates.template_vector((1.0, 1.0), 5)


CASES = {
    "hammer": [(100, 100.6, 97, 100.5)], "shooting_star": [(100, 103, 99.9, 99.5)],
    "bullish_engulfing": [(101, 101.5, 99.5, 100), (99.5, 102, 99, 101.5)], "bearish_engulfing": [(100, 101.5, 99.5, 101), (101.5, 102, 99, 99.5)],
    "piercing_line": [(102, 102.5, 99.5, 100), (99, 101.6, 98.8, 101.5)], "dark_cloud_cover": [(100, 102.5, 99.5, 102), (103, 103.2, 100.2, 100.5)],
    "morning_star": [(105, 105.5, 99.5, 100), (99, 100, 98, 99.2), (100, 104.5, 99.5, 104)], "evening_star": [(100, 105.5, 99.5, 105), (106, 107, 105.5, 106.2), (105, 105.5, 100.5, 101)],
    "three_white_soldiers": [(100, 102.2, 99.8, 102), (101, 104.2, 100.8, 104), (103, 106.2, 102.8, 106)], "three_black_crows": [(106, 106.2, 103.8, 104), (105, 105.2, 101.8, 102), (103, 103.2, 99.8, 100)],
}


@pytest.mark.parametrize("name", list(CASES))
def test_detectors(spark, name):
    first = minute_bars(1, len(CASES[name]))
    df = B.indexed(spark.createDataFrame([(r[0], r[1], *map(float, c), 1.0) for r, c in zip(first, CASES[name], strict=True)], BARS))
    rows, ago = signals.with_candles(df)
    hit = [r.idx for r in rows.where(signals.fires(candles.CANDLES[name], ago)).collect()]
    assert hit[-1:] == [len(CASES[name]) - 1]


def simulate(rows, directions, s, cash=100_000.0):
    """An event loop, bar by bar, against which the closed form is held."""
    equity, held, asked, trades, due, curve = cash, None, [], [], None, []
    c = s.cost_bps * 1e-4
    pending_in = pending_out = None
    for i, r in enumerate(rows):
        if pending_in is not None:
            held = (pending_in, r.open * (1 + c))
            pending_in, due = None, i + s.horizon
        if pending_out:
            qty, price = held
            equity += qty * (r.open * (1 - c) - price)
            trades.append((i, r.open * (1 - c) / price - 1))
            held = pending_out = None
        curve.append(equity + (held[0] * (r.close - held[1]) if held else 0))
        if held and i == due - 1:
            pending_out = True
        elif not held and i >= s.min_history_bars and i % s.query_stride == 0 and r.bars_left >= s.horizon + 1:
            asked.append(i)
            if directions[i] == "LONG":
                pending_in = equity * s.position_size / r.close
    return asked, trades, curve


@pytest.mark.parametrize("horizon,stride", [(1, 1), (3, 1), (3, 2)])
def test_walk_forward_equals_an_event_loop(spark, indexed, horizon, stride):
    s = settings({"horizon": horizon, "query_stride": stride, "min_history_bars": 7, "signal_source": "candles"})
    rows = indexed.orderBy("idx").collect()
    directions = {r.idx: "LONG" if (r.idx * 37) % 5 < 2 else "NO_TRADE" for r in rows}
    sig = spark.createDataFrame([("T", i, d) for i, d in directions.items()], "symbol string, idx long, direction string")
    asked = backtest.asked(sig, indexed, s).cache()
    trades = backtest.trades(asked, indexed, s).cache()
    curve = [r.equity for r in backtest.equity(trades, indexed, s).orderBy("idx").collect()]
    want_asked, want_trades, want_curve = simulate(rows, directions, s)
    assert sorted(r.idx for r in asked.collect()) == want_asked
    got = [(r.exit_idx, r.net_ret) for r in trades.orderBy("exit_idx").collect()]
    assert [g[0] for g in got] == [w[0] for w in want_trades] and all(math.isclose(g[1], w[1], abs_tol=1e-12) for g, w in zip(got, want_trades, strict=True))
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(curve, want_curve, strict=True))


def test_random_baseline_is_repeatable_and_bounded(spark, indexed):
    s = settings({"horizon": 3, "min_history_bars": 10})
    decisions = indexed.where("idx in (15, 50, 90)").select("symbol", "idx")
    one, two = (sorted(map(tuple, backtest.random_means(indexed, decisions, s, 50).collect())) for _ in range(2))
    assert one == two and len(one) == 50
    best = spark.createDataFrame([("T", 9.0)], "symbol string, mean_net_ret double")
    assert math.isclose(backtest.p_value(backtest.random_means(indexed, decisions, s, 50), best).first().p_value, 1 / 51)


def test_settings(tmp_path):
    a = settings({"k": "100"}, ["symbols=spy,qqq", "enable_shorts=yes"])
    assert a.k == 100 and a.symbols == ("SPY", "QQQ") and a.enable_shorts
    assert a.hash == settings({"k": 100, "seed": 7}, ["symbols=spy,qqq", "enable_shorts=1"]).hash != settings({"k": 99}).hash
    with pytest.raises(KeyError):
        settings({"nothing": 1})
    (tmp_path / "c.yaml").write_text("window: 20  # bars\nsymbols:\n  - qqq\ncandle_patterns: [hammer, shooting_star]\n")
    b = from_yaml(str(tmp_path / "c.yaml"), ["horizon=4"])
    assert (b.window, b.symbols, b.candle_patterns, b.horizon) == (20, ("QQQ",), ("hammer", "shooting_star"), 4)
    (tmp_path / "d.yaml").write_text("# all\nsymbols: [qqq]   # one\ntemplate_patterns: [double_bottom, 'triple_bottom',  # two\n                    cup_with_handle]\nsplit_date: \"2022-12-31\"\nreports_dir: 'a # b'\ndb_path: db/bars.db\nfeatures:\n")
    c = from_yaml(str(tmp_path / "d.yaml"))
    assert (c.template_patterns, c.split_date, c.reports_dir, c.db_path, c.features) == (("double_bottom", "triple_bottom", "cup_with_handle"), "2022-12-31", "a # b", "db/bars.db", "close")
    assert c.hash == settings({"symbols": "QQQ"}).hash
    for text in ("symbols:\n  first: x\n", "symbols: [a,\n b\n"):
        (tmp_path / "e.yaml").write_text(text)
        with pytest.raises(ValueError, match="nested|end"):
            from_yaml(str(tmp_path / "e.yaml"))
