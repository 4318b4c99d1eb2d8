from __future__ import annotations

import datetime as dt
import sqlite3
from types import SimpleNamespace

import pyarrow.fs as pafs
from conftest import BARS, minute_bars
from pyspark.sql import functions as F

from tapeforms.sources import shards

STAMP = dt.datetime(2024, 2, 1, 12)


def given(spark, rows):
    return spark.createDataFrame(rows, BARS).withColumns({"source": F.lit("t"), "ingested_at": F.lit(STAMP).cast("timestamp_ntz")}).select(*shards.COLUMNS)


def plain(df):
    return sorted(map(tuple, df.collect()))


def filled(file, rows, wal=False):
    db = sqlite3.connect(file)
    if wal:
        db.execute("PRAGMA journal_mode=WAL")
    db.execute(shards.TABLE)
    db.executemany("INSERT OR REPLACE INTO bars (symbol, ts, open, high, low, close, volume, source, ingested_at) VALUES (?, ?, ?, ?, ?, ?, ?, 't', '2024-02-01T12:00:00+00:00')", [(r[0], r[1].isoformat() + "+00:00", *r[2:]) for r in rows])
    db.commit()
    db.close()


def test_bars_come_back_and_predicates_reach_the_shards(spark, tmp_path):
    rows = [*minute_bars(3, 60), *minute_bars(2, 40, seed=1, symbol="U")]
    bars, path = given(spark, rows).cache(), f"file://{tmp_path}/shards"
    shards.write(bars, path, roll=50)
    back = shards.read(spark, path)
    assert plain(back) == plain(bars)
    noon = dt.datetime(2024, 1, 9, 14, 40)
    for condition in ("symbol = 'U'", "symbol in ('T', 'X')", "ts >= timestamp_ntz'2024-01-09 14:40:00' and ts < timestamp_ntz'2024-01-09 14:50:30'", "symbol = 'T' and ts > timestamp_ntz'2024-01-09 14:40:00'", "ts <= timestamp_ntz'2024-01-09 14:40:00' and close > 100", "ts = timestamp_ntz'2024-01-09 14:40:00'", "symbol = 'nobody'"):
        assert plain(back.where(condition)) == plain(bars.where(condition)), condition
    reader = shards.ShardReader(path)
    everything = len(reader.partitions())
    left = list(reader.pushFilters([shards.EqualTo(("symbol",), "U"), shards.GreaterThan(("ts",), noon), shards.GreaterThan(("close",), 1.0)]))
    assert len(left) == 1 and 0 < len(reader.partitions()) < everything
    plan = shards.read(spark, path).where("symbol = 'U' and close > 1")._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(symbol" not in plan and "(symbol#" not in plan.split("Filter")[1].split("\n")[0]


def test_files_of_others_are_read_in_parts_and_empty_folders_give_no_rows(spark, tmp_path, monkeypatch):
    rows = minute_bars(3, 60)
    folder = tmp_path / "others"
    folder.mkdir()
    filled(folder / "a.db", rows[:100], wal=True)
    filled(folder / "b.db", rows[100:])
    filled(folder / "none.db", [])
    monkeypatch.setattr(shards, "SPLIT", 4096)
    reader = shards.ShardReader(f"file://{folder}")
    assert len(reader.partitions()) > 5
    got = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(b.column(c).to_pylist() for c in shards.COLUMNS), strict=True)]
    assert sorted(got) == plain(given(spark, rows)) == plain(shards.read(spark, f"file://{folder}"))
    assert rows_by_bytes(monkeypatch, folder / "a.db") == 100
    assert plain(shards.read(spark, f"file://{tmp_path}/nowhere")) == []


def rows_by_bytes(monkeypatch, file):
    """Rows of a shard of which only the bytes can be had."""
    far = pafs.SubTreeFileSystem("/", pafs.LocalFileSystem())
    monkeypatch.setattr(shards, "pafs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=lambda uri: (far, "")), LocalFileSystem=pafs.LocalFileSystem))
    try:
        return shards.opened("x", str(file)).execute("SELECT count(*) FROM bars").fetchone()[0]
    finally:
        monkeypatch.setattr(shards, "pafs", pafs)


def test_a_stream_of_shards_gives_additions_and_corrections_once_over_restarts(spark, tmp_path):
    rows = minute_bars(2, 30)
    folder = tmp_path / "live"
    folder.mkdir()
    path, seen = f"file://{folder}", []

    def drained():
        query = shards.stream(spark, path, "T").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        now = plain(spark.read.schema(shards.BARS).parquet(str(tmp_path / "out")))
        fresh = list(now)
        for r in seen:
            fresh.remove(r)
        seen[:] = now
        return fresh

    filled(folder / "a.db", rows[:20])
    shards.write(given(spark, rows[20:30]), path)
    assert drained() == plain(given(spark, rows[:30]))
    fixed = [(*rows[19][:5], 1.5, 7.0), (*rows[3][:5], 2.5, 8.0)]
    filled(folder / "a.db", [*fixed, *rows[30:35]])
    shards.write(given(spark, [*rows[35:40], *minute_bars(1, 5, symbol="U")]), path, roll=3)
    assert drained() == plain(given(spark, [*fixed, *rows[30:40]]))
    assert drained() == []
