from __future__ import annotations

import datetime as dt
import random
import threading

import pytest
from conftest import BARS, minute_bars
from pyspark.sql import functions as F

from tapeforms.operators import asof, backtest, corrections, diagonals, journal, neighbours, shape_index, signals, windows
from tapeforms.operators import bars as B
from tapeforms.plans.research import AlreadyClaimed, Study
from tapeforms.plans.settings import settings
from tapeforms.sources.store import BarStore, Claims


def indexed(spark, sessions=6, per=60, seed=0, flat=0):
    """Bars of a random walk; of the first `flat` sessions all have the same few moves, over and over."""
    rows = []
    for s, r in enumerate(minute_bars(sessions, per, seed)):
        if s // per < flat:
            level = 100.0 * (1.01 if s % 3 else 1.0)
            r = (r[0], r[1], level, level, level, level, r[6])
        rows.append(r)
    return B.indexed(spark.createDataFrame(rows, BARS)).cache()


def rows_of(df):
    return sorted((r.symbol, r.q_end, r["rank"], r.end_idx, r.dist) for r in df.collect())


@pytest.mark.parametrize(("window", "flat"), [(2, 0), (4, 5), (7, 0)])
def test_every_search_ranks_ties_by_bar(spark, window, flat):
    x = indexed(spark, flat=flat)
    w = windows.windows(x, window, 3).cache()
    q = w.where("valid").select("symbol", F.col("end_idx").alias("q_end"), F.col("z").alias("qz"))
    want = rows_of(neighbours.nearest(neighbours.distances(w, q, window, 3, window), 5))
    assert len(want) > 5000
    assert rows_of(neighbours.nearest_by_blocks(w, q, window, 3, 5, block=64, chunk=50)) == want
    assert rows_of(shape_index.nearest_by_index(w, window, 3, 5, window, cell=20, part=30)) == want
    assert rows_of(diagonals.nearest_by_diagonals(x, window, 3, 5, chunk=60)) == want


def test_searches_of_prices_and_of_raw_windows(spark):
    x = indexed(spark, 4, 50, seed=2)
    for features, normalization in (("ohlc", "logret_zscore"), ("close", "logret_raw")):
        w = windows.windows(x, 5, 2, features, normalization)
        width = 5 * (1 if features == "close" else 4)
        q = w.where("valid").select("symbol", F.col("end_idx").alias("q_end"), F.col("z").alias("qz"))
        want = rows_of(neighbours.nearest(neighbours.distances(w, q, 5, 2, width), 4))
        assert rows_of(shape_index.nearest_by_index(w, 5, 2, 4, width, cell=16)) == want
        if normalization == "logret_zscore":
            assert rows_of(diagonals.nearest_by_diagonals(x, 5, 2, 4, "ohlc", chunk=100)) == want


def test_the_index_computes_a_part_of_the_pairs(spark):
    w = windows.windows(indexed(spark, 20, 120), 5, 3).cache()
    found = shape_index.nearest_by_index(w, 5, 3, 5, 5, cell=40).cache()
    row = shape_index.computed_share(found, w, neighbours.unconditional(w, 5, 3)).first()
    assert 0 < row.n_computed < row.n_pairs / 3


def test_searches_of_few_windows_or_none(spark):
    for x in (indexed(spark, 1, 6), indexed(spark, 2, 3), indexed(spark).limit(0)):
        w = windows.windows(x, 4, 2)
        assert shape_index.nearest_by_index(w, 4, 2, 5, 4).count() == diagonals.nearest_by_diagonals(x, 4, 2, 5).count() == 0


def test_asof_join_of_a_hot_symbol(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    moment = lambda days: start + dt.timedelta(seconds=rng.randrange(days * 86400))
    bars = [("H" if i % 10 else "U", moment(40), i) for i in range(3000)] + [("H", start + dt.timedelta(days=90), 5000), (None, start, 6000), ("H", None, 6001)]
    times = [(i, "H" if i % 10 else "U", moment(120) - dt.timedelta(days=5)) for i in range(2000)] + [(3000, "X", start), (3001, None, start), (3002, "H", None), (3003, "H", bars[1][1]), (3003, "H", bars[1][1])]
    b = spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, n long")
    t = spark.createDataFrame(times, "id long, symbol string, ts timestamp_ntz")
    got = sorted((r.id, r.found.n if r.found else None) for r in asof.asof(t, b).collect())
    known = [x for x in bars if x[0] is not None and x[1] is not None]
    want = sorted((i, max(((ts, n) for s, ts, n in known if s == symbol and ts <= at), default=(None, None))[1] if symbol and at else None) for i, symbol, at in times)
    assert got == want
    assert asof.asof(t, b.limit(0)).where("found is not null").isEmpty() and asof.asof(t.limit(0), b).isEmpty()
    keys = asof.asof(t, b)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in keys and "_b" in keys


def test_pairs_of_orders_over_days(spark):
    rows = [(i, "T", what, 1.0, "filled", 100.0 + i, f"2024-01-{8 + 3 * i:02} 15:00:00") for i, what in enumerate(("entry", "time_stop", "time_stop", "entry", "entry", "force_flat"))]
    df = spark.createDataFrame(rows, "broker_order_id long, symbol string, intent string, qty double, status string, filled_avg_price double, filled_at string").withColumn("filled_at", F.col("filled_at").cast("timestamp_ntz"))
    assert sorted((r.entry_price, r.exit_price) for r in journal.paired_trades(df).collect()) == [(100.0, 101.0), (104.0, 105.0)]


def test_resampling_shuffles_no_row_per_draw(spark):
    x = indexed(spark, 5, 40)
    s = settings({"horizon": 2, "min_history_bars": 0})
    decisions = x.where("bars_left >= 3 and idx % 3 = 0").select("symbol", "idx")
    means = backtest.random_means(x, decisions, s, 50)
    assert means.count() == 50 and means.where("mean_ret is null").isEmpty()
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.rindex("partial_avg") or "partial_avg" in plan


def stored(spark, rows, at):
    return spark.createDataFrame(rows, BARS).withColumns({"source": F.lit("x"), "ingested_at": F.lit(at).cast("timestamp_ntz")})


def test_corrections_carry_downstream_as_a_full_run_would(spark, tmp_path):
    rows = minute_bars(9, 30, seed=4)
    short = [r for i, r in enumerate(rows) if not 150 <= i < 177]  # a session of three bars
    store = BarStore(spark, str(tmp_path / "bars"))
    store.upsert(stored(spark, short, "2024-02-01 00:00:00"))
    first = store.seq()
    s = settings({"symbols": "T", "signal_source": "template", "window": 4, "horizon": 2, "template_threshold": 2.0})

    def full(bars):
        return signals.signals(B.indexed(bars), s).drop("matched")

    def plain(version):
        return B.regular_hours(store.read(version)).select("symbol", "ts", *B.PRICES, "volume")

    before = full(plain(first)).cache()
    before.count()
    for corrected in ([(*r[:5], r[5] * 1.01, r[6]) for r in rows[60:64]], rows[150:153] + rows[160:165], [(r[0], r[1] + dt.timedelta(days=20), *r[2:]) for r in rows[:12]]):
        was = store.seq()
        store.upsert(stored(spark, corrected, f"2024-02-0{was + 2} 00:00:00"))
        changed = store.changed_sessions(was)
        days = {r.session for r in changed.collect()}
        assert len(days) == 1
        read = []

        def narrowed(wanted, version=store.seq(), read=read):
            read.extend(r.session for r in wanted.collect())
            return plain(version).withColumn("session", F.to_date(B.new_york())).join(wanted, ["symbol", "session"], "left_semi").drop("session")

        after = corrections.recomputed(before, plain(store.seq()), changed, 4, lambda x: signals.signals(x, s).drop("matched"), narrowed).cache()
        assert sorted(map(str, after.collect())) == sorted(map(str, full(plain(store.seq())).collect()))
        assert days <= set(read) and len(read) <= 4
        before = after
    assert store.changed_sessions(store.seq()).isEmpty()
    assert store.read(begin="2024-01-20 00:00:00").count() == 12 and store.read(end="2024-01-08 14:34:00").count() == 5
    assert store.read(first).count() == len(short)


def test_one_of_many_claims_wins(spark, tmp_path):
    claims = Claims(spark, str(tmp_path / "claims"))
    gate, won = threading.Barrier(8), []

    def run():
        gate.wait()
        won.append(claims.take("c-0"))

    threads = [threading.Thread(target=run) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 7 + [True] and claims.taken() == ["c-0"] and claims.take("c-1")


def test_one_of_many_evaluators_spends(spark, tmp_path):
    bars = spark.createDataFrame(minute_bars(6, 40), BARS)
    study = Study(spark, str(tmp_path / "study"), bars)
    s = settings({"symbols": "T", "signal_source": "candles", "window": 4, "horizon": 2, "min_history_bars": 20, "cost_bps": 0, "candle_trend_lookback": 1, "split_date": "2024-01-10"})
    study.backtest(s, resamples=5)
    outcomes = []

    def run():
        try:
            outcomes.append(study.evaluate(s.hash, resamples=5, number=0)[0])
        except AlreadyClaimed:
            outcomes.append("claimed")

    threads = [threading.Thread(target=run) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert outcomes.count("claimed") == 3 and study.verdicts().count() == 1
    study.claims.take(f"{s.hash}-1")  # and killed before it wrote anything down
    assert sorted(r.verdict for r in study.verdicts().collect())[0] == "CRASHED" and study.verdicts().count() == 2 and "2 TIMES" in study.banner()
