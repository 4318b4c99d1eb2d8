"""Queries of the stateful streams over `events`, with their SQL; they join the catalog's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeforms.plans import catalog as C
from tapeforms.plans import trading as T
from tapeforms.sources import folders
from tapeforms.streaming import live, shapes, signals

#: The last bar stays open for want of a later tick.
CLOSED = f"ts < (SELECT time_bucket(INTERVAL '{C.MINUTES} minutes', max(ts)) FROM events WHERE value > 0)"


def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = f"{sf_dir}/events.parquet"
    ticks = spark.readStream.schema(spark.read.parquet(events).schema).parquet(f"{events}*")
    return live.closed_bars(ticks, C.MINUTES)


def written(rows: DataFrame, name: str) -> DataFrame:
    with signals.rocks(rows.sparkSession):
        return live.written(rows, f"{folders.shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}")


@C.query("stream_signals", f"""WITH {C.TEMPLATE_SQL}, {C.CANDLE_SQL.split(C.BARS_SQL + ', ')[1]}
SELECT 'template' AS source, symbol, session::VARCHAR AS session, idx, ts::VARCHAR AS ts, direction, reason, pattern, n_matched::BIGINT AS n_matched, matched FROM template WHERE {CLOSED} UNION ALL
SELECT 'candles', symbol, session::VARCHAR, idx, ts::VARCHAR, direction, reason, pattern, n_matched, matched FROM candle WHERE {CLOSED}""")
def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template and candle signals of the bars that a stream over events has closed, as they close."""
    rows = written(signals.stream_signals(closed(spark, sf_dir), C.TEMPLATE, C.CANDLE), "signals")
    return C.shown(rows.select("source", "symbol", "session", "idx", "ts", "direction", "reason", "pattern", "n_matched", F.array_join("matched", ",").alias("matched")))


@C.query("stream_decisions", T._live_sql(f"SELECT 'EVT' AS symbol, idx, ts::VARCHAR AS ts, outcome, {C.num('held', 'held')}, {C.num('cash', 'cash')}, {C.num('cash + held * close', 'equity')}, side AS order_side, {C.num('oq', 'order_qty')}, entry AS entry_idx FROM sim WHERE {CLOSED}"))
def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From ticks to the decisions of the trading loop in one stream: closed bars, candle signals, the account by symbol."""
    rows = written(signals.decisions(signals.stream_signals(closed(spark, sf_dir), T.LIVE), T.LIVE, C.MINUTES, C.CASH), "decisions")
    return C.shown(rows.select("symbol", "idx", "ts", "outcome", "held", "cash", "equity", "order_side", "order_qty", "entry_idx"))


@C.query("stream_knn_signals", f"""WITH {C.KNN_SQL} SELECT {C.SIGNAL_COLUMNS}, q_end, n, {', '.join(C.num(c, c) for c in ('mean', 'median', 'pct_positive', 'uncond_mean', 'threshold'))}, n_candidates FROM knn WHERE {CLOSED}""")
def stream_knn_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-NN signals of the bars that a stream over events has closed, from the log of windows that it keeps."""
    folder = f"{folders.shared_dir(spark)}/knn-{uuid.uuid4().hex}"
    shapes.start(closed(spark, sf_dir), C.KNN, folder, availableNow=True).awaitTermination()
    return C.shown(shapes.given(spark, folder).drop("minute", "open", "close"))
