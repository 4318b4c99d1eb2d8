from __future__ import annotations

import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tapeforms.operators import ledger, simulator
from tapeforms.plans.settings import settings
from tapeforms.sources.store import Busy, EventLog, FoldedLog
from tapeforms.streaming import live

SCHEMA = "id long, seq long, status string, price double"


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def events(n, at=0, seed=0):
    rng = random.Random(seed)
    order = list(range(at, at + n))
    rng.shuffle(order)  # events come late, so a later append may have an earlier seq
    return [(rng.choice([None, *range(12)]), seq, rng.choice([None, "open", "filled"]), rng.choice([None, 1.0, rng.random()])) for seq in order]


def test_what_is_current_equals_the_fold_of_all_events_and_reads_are_bounded(spark, tmp_path):
    log = FoldedLog(spark, f"file://{tmp_path}/log", SCHEMA, "id")
    assert log.current().isEmpty() and log.fold() == 0
    every = events(240, seed=3)
    for batch in range(12):
        rows = spark.createDataFrame(every[20 * batch : 20 * batch + 20], SCHEMA)
        assert log.append(rows, f"w{batch % 2}", batch)
        assert log.append(rows, f"w{batch % 2}", batch)  # again, before it is folded
        if batch % 3 == 2:
            assert len(log.tail()) == 3 and log.fold() == 3 and log.tail() == []
            assert not log.append(rows, f"w{batch % 2}", batch)  # and after
        assert log.has(f"w{batch % 2}", batch) and not log.has("w0", batch + 1)
        assert plain(log.current()) == plain(ledger.current(spark.createDataFrame(every[: 20 * batch + 20], SCHEMA), "id"))
    assert len(os.listdir(tmp_path / "log" / "appends")) <= 6 and len(os.listdir(tmp_path / "log" / "snapshots")) <= 2 and len(os.listdir(tmp_path / "log" / "manifests")) <= 4  # with sums of the local file system


def test_a_reader_from_before_a_fold_and_unfinished_appends(spark, tmp_path):
    log = FoldedLog(spark, f"file://{tmp_path}/log", SCHEMA, "id")
    log.append(spark.createDataFrame(events(30), SCHEMA), "w", 0)
    before = log.current()
    want = plain(ledger.current(spark.createDataFrame(events(30), SCHEMA), "id"))
    log.fold()
    os.makedirs(tmp_path / "log" / "appends" / "w=000000000001")  # of a writer that was killed
    assert plain(before) == want == plain(log.current()) and log.tail() == []
    log.append(spark.createDataFrame(events(30, 30, 1), SCHEMA), "w", 1)
    assert log.tail() == ["w=000000000001"]


def test_of_two_that_fold_at_once_one_ends_and_nothing_is_lost(spark, tmp_path):
    log = FoldedLog(spark, f"file://{tmp_path}/log", SCHEMA, "id")
    log.append(spark.createDataFrame(events(30), SCHEMA), "w", 0)

    def fold(_):
        try:
            return log.fold()
        except Busy:
            return -1

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(fold, range(4)))
    assert done.count(1) == 1 and set(done) <= {1, 0, -1}
    with pytest.raises(Busy):
        log._publish({"number": 0, "snapshot": None, "held": [], "batches": {}})
    assert plain(log.current()) == plain(ledger.current(spark.createDataFrame(events(30), SCHEMA), "id"))


def test_a_loop_that_goes_on_from_folded_rows_decides_as_one_over_all_bars(spark, tmp_path):
    s = settings({"horizon": 2, "force_flat_minutes_before_close": 2, "position_size": 0.5, "cost_bps": 0})
    bars = [(name, i, 600 + i % 30, 100.0 + (i * 7) % 11, 101.0 + (i * 5) % 13, "LONG" if i % 4 == 0 else "NO_TRADE") for name in ("T", "U") for i in range(60)]
    rows = spark.createDataFrame(bars, "symbol string, idx long, minute int, open double, close double, direction string").withColumn("ts", F.timestamp_add("MINUTE", F.col("idx"), F.lit("2024-01-08 15:00:00").cast("timestamp_ntz"))).cache()
    whole = plain(simulator.replay(rows, rows, s, 1, 10_000.0))
    log, state = EventLog(spark, f"file://{tmp_path}/journal", simulator.REPLAY), live.last_rows(spark, f"file://{tmp_path}/state")
    for part, (a, b) in enumerate(((0, 11), (12, 30), (31, 40), (25, 59))):  # the last with bars again
        rows.where(f"idx between {a} and {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        checkpoint = str(tmp_path / ("ck" if part < 3 else "new"))
        query = live.trade(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), log, checkpoint, s, 1, 10_000.0, survivors_only=False, state=state, fold_every=2)
        query.processAllAvailable()
        query.stop()
    assert plain(log.read()) == whole
    assert len(state.tail()) <= 2
