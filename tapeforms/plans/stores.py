"""Queries of the sharded store and of the compacted log, with their SQL; they join the catalog's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeforms.operators import bars as B
from tapeforms.plans import catalog as C
from tapeforms.plans import trading as T
from tapeforms.sources import folders, shards
from tapeforms.sources.store import FoldedLog
from tapeforms.streaming import live

SINCE = "2024-01-05 00:00:00"
#: Bars of each kind of event as a symbol.
SYMBOL_BARS = f"SELECT event_type AS symbol, time_bucket(INTERVAL '{C.MINUTES} minutes', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events WHERE value > 0 GROUP BY 1, 2"


def sharded(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with the bars of every kind of event in shards."""
    path = f"{folders.shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    bars = B.from_events(C.table(spark, sf_dir, "events"), C.MINUTES, F.col("event_type"))
    shards.write(bars.withColumns({"source": F.lit("events"), "ingested_at": F.col("ts")}), path)
    return path


@C.query("shard_bars", f"SELECT symbol, ts::VARCHAR AS ts, {C.PRICE_SQL}, volume FROM ({SYMBOL_BARS}) WHERE ts >= TIMESTAMP '{SINCE}' AND ts <= TIMESTAMP '{C.CUT}'")
def shard_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars between two times from database files, of which only those that hold such bars are opened."""
    span = F.col("ts").between(*(F.lit(t).cast("timestamp_ntz") for t in (SINCE, C.CUT)))
    return C.shown(shards.read(spark, sharded(spark, sf_dir)).where(span).select("symbol", "ts", *B.PRICES, "volume"))


@C.query("shard_stream", f"SELECT symbol, ts::VARCHAR AS ts, {C.PRICE_SQL}, volume FROM ({SYMBOL_BARS})")
def shard_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars of the shards, read as a stream."""
    rows = live.written(shards.stream(spark, sharded(spark, sf_dir)), f"{folders.shared_dir(spark)}/shard-stream-{uuid.uuid4().hex}")
    return C.shown(rows.select("symbol", "ts", *B.PRICES, "volume"))


RUNS = "id long, seq long, config_hash string, started_at long, finished_at long, status string"


@C.query("folded_runs", C.oracle_sql()["run_registry"])
def folded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of each run, from a snapshot and the appends after it; events come in five batches that are mixed in seq, three of them in snapshots."""
    log = FoldedLog(spark, f"{folders.shared_dir(spark)}/runs-{uuid.uuid4().hex}", RUNS, "id")
    events = T.run_events(spark, sf_dir)
    for batch in range(5):
        log.append(events.where(F.col("seq") % 5 == batch), "events", batch)
        if batch in (1, 2):
            log.fold()
    return log.current().select("id", "config_hash", "started_at", "finished_at", "status")
