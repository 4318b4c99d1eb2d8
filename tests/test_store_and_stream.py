from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from conftest import BARS, minute_bars

from pyspark.sql import functions as F
from tapeforms.operators import journal, ledger
from tapeforms.plans import catalog
from tapeforms.sources import folders
from tapeforms.sources.store import BarStore, EventLog
from tapeforms.streaming import live


def batch(spark, rows, at):
    return spark.createDataFrame(rows, BARS).withColumns({"source": F.lit("x"), "ingested_at": F.lit(at).cast("timestamp_ntz")})


def test_upsert_is_idempotent_and_replaces(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "bars"))
    rows = minute_bars(2, 30)
    assert store.upsert(batch(spark, rows, "2024-02-01 00:00:00")) == 60
    assert store.upsert(batch(spark, rows, "2024-02-02 00:00:00")) == 60
    assert store.read().count() == 60
    later = [(*r[:5], r[5] + 1, r[6]) for r in rows[:5]]
    store.upsert(batch(spark, later, "2024-02-03 00:00:00"))
    assert [r.close for r in store.load("T", "2024-01-08 14:34:00").collect()] == [r[5] for r in later]
    assert store.upsert(batch(spark, [], "2024-02-04 00:00:00")) == 0
    assert store.coverage().first().n_sessions == 2


def test_several_writers_lose_no_bar(spark, tmp_path):
    folder = str(tmp_path / "bars")
    rows = minute_bars(4, 12)
    other = [("U", r[1].replace(month=3), *r[2:]) for r in rows]
    parts = [rows[i::3] for i in range(3)] + [other]

    def write(i):
        return BarStore(spark, folder).upsert(batch(spark, parts[i], f"2024-02-0{i + 1} 00:00:00"))

    with ThreadPoolExecutor(4) as pool:  # three meet in a month, the fourth has one of its own
        assert sorted(pool.map(write, range(4))) == [16, 16, 16, 48]
    store = BarStore(spark, folder)
    assert store.seq() == 3 and sorted(r[0] for r in spark.read.schema(store.MANIFEST).json(f"{folder}/manifest").select("seq").collect()) == [0, 1, 2, 3]
    assert sorted((r.symbol, r.ts, r.close) for r in store.read().collect()) == sorted((r[0], r[1], r[5]) for r in rows + other)
    named = {r[0] for r in spark.read.schema(store.MANIFEST).json(f"{folder}/manifest").select("v").collect()}
    assert {p.name for p in (tmp_path / "bars" / "data").iterdir() if p.name.startswith("v=")} == {f"v={v}" for v in named}
    assert not list((tmp_path / "bars" / "staged").iterdir())


def test_refresh_takes_the_last_day_again(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "bars"))
    rows = minute_bars(4, 10)
    store.upsert(batch(spark, rows[:20], "2024-02-01 00:00:00"))
    # From 14:39 of the first day on: its last bar, and the ten of each day after.
    assert store.refresh(batch(spark, rows, "2024-02-02 00:00:00")) == 31
    assert store.read().count() == 40


def test_spent_and_never_finished_is_crashed(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), "evaluation_id long, config_hash string, seq long, verdict string")
    assert log.read().count() == 0
    log.append([(1, "a", 1, None), (2, "b", 2, None)])
    log.append([(2, "b", 3, "SURVIVED")])
    got = {r.evaluation_id: r.verdict for r in ledger.verdicts(log.read()).collect()}
    assert got == {1: "CRASHED", 2: "SURVIVED"}
    assert [r.config_hash for r in ledger.survivors(ledger.verdicts(log.read())).collect()] == ["b"]


def test_verdict_lists_every_failure(spark):
    columns = "n_trades int, mean double, p double, alpha double, train_mean double, train_sharpe double, test_sharpe double"
    rows = [(8, 0.003, 0.001, 0.01, 0.004, 2.0, 1.5), (0, None, None, 0.01, 0.004, 2.0, None), (8, -0.001, 0.2, 0.01, 0.004, 2.0, -1.0), (8, 0.0001, None, 0.01, 0.004, None, 1.0)]
    got = [tuple(r.reasons) for r in ledger.decide(spark.createDataFrame(rows, columns)).collect()]
    assert got == [(), ("no_trades",), ("mean_not_positive", "p_above_alpha", "inconsistent_with_train", "sharpe_sign_flip"), ("no_p_value", "inconsistent_with_train")]


def test_an_exit_pairs_with_the_newest_entry(spark):
    rows = [(i, "T", what, 1.0, "filled", 100.0 + i, f"2024-01-08 15:0{i}:00") for i, what in enumerate(("time_stop", "entry", "entry", "time_stop", "force_flat", "entry"))]
    df = spark.createDataFrame(rows, "broker_order_id long, symbol string, intent string, qty double, status string, filled_avg_price double, filled_at string").withColumn("filled_at", F.col("filled_at").cast("timestamp_ntz"))
    got = journal.paired_trades(df).collect()
    assert [(r.entry_price, r.exit_price) for r in got] == [(102.0, 103.0)]
    week = journal.weekly(journal.paired_trades(df), F.lit("2024-01-09 00:00:00").cast("timestamp_ntz"))
    text = journal.weekly_report(week, spark.createDataFrame([("T", 100.0, 101.0, 0.01)], "symbol string, equity_start double, equity_end double, bh_return double"), 0.001)
    assert "trades: 1" in text and "buy and hold +1.0000%" in text


def test_a_stream_gives_closed_bars_once_and_upserts_them(spark, tmp_path):
    ticks = spark.range(300).selectExpr("id as event_id", "timestamp_ntz'2024-01-08 14:30:00' + make_interval(0,0,0,0,0,0,id * 7) as ts", "1.0 + id as value")
    ticks.repartition(3).write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    rows = live.drained(live.closed_bars(stream), "stream_test").collect()
    assert len(rows) == len({r.ts for r in rows}) == 34
    store = BarStore(spark, str(tmp_path / "bars"))
    query = live.into_store(live.closed_bars(stream), store, str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert store.read().count() == 34


def test_the_query_of_closed_bars_keeps_rows_and_state_in_the_shared_folder(spark, tmp_path):
    ticks = spark.range(300).selectExpr("id as event_id", "timestamp_ntz'2024-01-08 14:30:00' + make_interval(0,0,0,0,0,0,id * 7) as ts", "1.0 + id as value")
    ticks.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.stream_closed_bars(spark, str(tmp_path))
    assert [(r.ts, r.open, r.close, r.volume) for r in got.orderBy("ts").collect()] == [("2024-01-08 14:30:00", 1.0, 129.0, 129.0), ("2024-01-08 14:45:00", 130.0, 258.0, 129.0)]
    files = got.inputFiles()
    assert files and all(f"{folders.shared_dir(spark).removeprefix('file://')}/closed-bars-" in f for f in files)
    assert spark.read.text(files[0].split("/bars/")[0] + "/checkpoint/offsets").count()
