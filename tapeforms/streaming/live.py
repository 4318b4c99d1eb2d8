"""Closed bars from a stream of ticks, and their upsert into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tapeforms.operators import bars as B
from tapeforms.operators import simulator
from tapeforms.plans.settings import Settings
from tapeforms.sources import folders
from tapeforms.sources.store import BarStore, EventLog, FoldedLog
from tapeforms.streaming.signals import require_survivor


def closed_bars(ticks: DataFrame, minutes: int = 1, late: str = "0 seconds", symbol: str = "EVT") -> DataFrame:
    """Bars of a stream of ticks (event_id, ts, value), each given once, when the watermark has passed its end.

    Time is that of the ticks: a bar closes when a later tick comes. Watermarks need TIMESTAMP, so the session's time zone
    has to be UTC; ts comes out as TIMESTAMP_NTZ.
    """
    order = F.struct("t", "event_id")
    rows = ticks.where("value > 0").withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    bars = rows.groupBy(F.window("t", f"{minutes} minutes").alias("w")).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return bars.select(F.lit(symbol).alias("symbol"), F.col("w.start").cast("timestamp_ntz").alias("ts"), *B.PRICES, "volume")


def into_store(bars: DataFrame, store: BarStore, checkpoint: str, source: str = "stream") -> StreamingQuery:
    """Upserts each batch of closed bars; a batch that is run again replaces the same keys."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # The clock, not the number of the batch: with a new checkpoint numbers begin again, and older rows would win.
        store.upsert(B.regular_hours(batch).withColumns({"source": F.lit(source), "ingested_at": F.localtimestamp()}))

    return bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).start()


def written(bars: DataFrame, folder: str) -> DataFrame:
    """All that a finite stream gives, as Parquet in a new folder that all machines share, which holds the stream's state as well."""
    query = bars.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/bars").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return bars.sparkSession.read.schema(bars.schema).parquet(f"{folder}/bars")


def drained(bars: DataFrame, name: str) -> DataFrame:
    """All that a finite stream gives, as a table in memory; for tests and small inputs."""
    query = bars.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return bars.sparkSession.table(name)


def trade(bars: DataFrame, journal: EventLog, checkpoint: str, s: Settings, minutes: int, cash: float = simulator.CASH, every: str | None = None, verdicts: DataFrame | None = None, survivors_only: bool = True, state: FoldedLog | None = None, fold_every: int = 50) -> StreamingQuery:
    """The trading loop on a stream of closed bars (symbol, idx, ts, minute, open, close, direction).

    It trades survivors only: without a verdict (of ledger.verdicts()) that lets the configuration through it raises NotASurvivor.

    The journal, a log with the columns of simulator.REPLAY, is all the state there is: each batch goes on from the last row of
    every symbol there, so a loop that was killed and started again decides on each bar once, and a batch that is run
    again adds nothing. With `state`, a log that last_rows() has made, each batch goes on from there instead: it reads a row per symbol and the appends since the last
    fold, of which there is one after fold_every batches, however long the journal is. `every`, such as "60 seconds", is the time between two looks at the stream; without it each batch follows the one before.
    """

    if survivors_only:
        require_survivor(verdicts, s)

    def write(batch: DataFrame, batch_id: int) -> None:
        known = journal.read()
        names = known.columns
        last = known.groupBy("symbol").agg(F.max_by(F.struct(*(c for c in names if c != "symbol")), "idx").alias("_r")).select("symbol", "_r.*")
        journal.append(simulator.replay(batch, batch, s, minutes, cash, last).select(*names))

    def write_on(batch: DataFrame, batch_id: int) -> None:
        # The query's id: it outlives a restart, and a new checkpoint, where numbers of batches begin again, has another.
        writer = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if state.has(writer, batch_id):
            return
        names = journal.read().columns
        rows = folders.cut(simulator.replay(batch, batch, s, minutes, cash, state.current().select("symbol", "row.*")).select(*names))
        # The journal first: if we are killed in between, this batch is decided again from the same state, and replaces its own rows.
        journal.append(rows, f"{writer}-{batch_id}")
        rest = F.struct(*(c for c in names if c != "symbol"))
        state.append(rows.groupBy("symbol").agg(F.max("idx").alias("idx"), F.max_by(rest, "idx").alias("row")), writer, batch_id)
        if batch_id % fold_every == fold_every - 1:
            state.fold()

    writer = bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write if state is None else write_on)
    return (writer.trigger(processingTime=every) if every else writer).start()


def last_rows(spark: SparkSession, folder: str) -> FoldedLog:
    """The last row of the journal of each symbol, as the state that trade() goes on from."""
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(simulator.REPLAY) if f.name != "symbol")
    return FoldedLog(spark, folder, f"symbol string, idx long, row struct<{fields}>", "symbol", "idx")
