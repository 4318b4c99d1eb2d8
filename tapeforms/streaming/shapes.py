"""k-NN signals on a stream of closed bars, and decisions from them.

A bar that closes ends a window, which asks for its neighbours, and completes the forward return of the window that ended `horizon` bars before in the session, which may be found
from then on. Windows come from the buffer of streaming.signals, whose state is of fixed size. Each batch adds its rows to a log and asks all of the log: a few questions go
to where the candidates lie, many (a first batch with the whole history) are dealt into blocks as in the batch engine. What is read per batch so grows with the history, as an exact search has it, but
nothing is computed twice, and no history has to fit one task.

The signals of a batch go to a second log, all of a symbol in one file, which the deciding stream follows. Both streams keep their checkpoints below the folder; a batch that is run again replaces
its rows, and the account passes over bars that it has decided on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeforms.operators import neighbours, signals, simulator, windows
from tapeforms.plans.settings import Settings
from tapeforms.sources.store import BatchLog
from tapeforms.streaming.signals import buffered, decisions, rocks

BAR = "symbol string, session date, idx long, ts timestamp_ntz, minute int, open double, close double"
SHAPES = f"{BAR}, q_end long, z array<double>, valid boolean, c_end long, c_z array<double>, c_valid boolean, fwd_ret double"
SIGNALS = f"{BAR}, direction string, reason string, q_end long, n long, mean double, median double, pct_positive double, n_candidates long, uncond_mean double, threshold double"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def shaped(bars: DataFrame, s: Settings) -> DataFrame:
    """SHAPES of a stream of closed bars: each with its current window (z, valid; null before the first) and the window that it completes (c_end, c_z, c_valid, fwd_ret; null if none)."""
    if s.features != "close":
        raise ValueError("a stream gives k-NN signals on closes")
    rows = buffered(bars, s.window, s.window + s.horizon + 1)

    def returns(closes: Column) -> Column:
        return F.zip_with(F.slice(closes, 2, s.window), F.slice(closes, 1, s.window), lambda now, before: F.ln(now / before))

    done = F.size("closes") > s.window + s.horizon
    ahead = F.get("closes", F.lit(0)) / F.get("closes", F.lit(s.horizon)) - 1
    then = F.when(done, returns(F.reverse(F.slice("closes", s.horizon + 1, s.window + 1))))
    known = rows.withColumns({"_x": returns(F.col("w")), "_then": then})
    (z, valid), (c_z, c_valid) = (windows.normaliser(s.normalization)(F.col(c)) for c in ("_x", "_then"))
    made = {"z": z, "valid": F.when(F.col("_x").isNotNull(), valid), "c_end": F.when(done, F.col("idx") - s.horizon), "c_z": c_z, "c_valid": F.when(F.col("_then").isNotNull(), c_valid), "fwd_ret": F.when(done, ahead)}
    return known.withColumns(made).select(*names(SHAPES))


def answered(rows: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """SIGNALS of a batch's rows, from all rows of the log (these among them)."""
    queries = rows.where("valid").select("symbol", "q_end", F.col("z").alias("qz")).dropDuplicates(["symbol", "q_end"])
    # The time at which a candidate became known; no figure depends on it.
    past = known.where("fwd_ret is not null").select("symbol", "session", F.col("c_end").alias("end_idx"), F.col("ts").alias("end_ts"), F.col("c_z").alias("z"), F.col("c_valid").alias("valid"), "fwd_ret")
    if queries.limit(neighbours.FEW + 1).count() <= neighbours.FEW:
        near = neighbours.nearest_of_few(past, queries, s.window, s.horizon, s.k, s.window)
        usual = neighbours.unconditional_of_few(past, queries, s.window, s.horizon)
    else:
        near = neighbours.nearest_by_blocks(past, queries, s.window, s.horizon, s.k)
        ended = known.where("q_end = idx").select("symbol", "session", F.col("idx").alias("end_idx"), "valid", F.lit(None).cast("double").alias("fwd_ret"))
        every = ended.unionByName(past.select(*ended.columns)).groupBy("symbol", "session", "end_idx").agg(F.max("valid").alias("valid"), F.max("fwd_ret").alias("fwd_ret"))
        usual = neighbours.unconditional(every, s.window, s.horizon)
    stats = neighbours.match_stats(neighbours.without_overlaps(near, s.k, s.dedup_gap))
    place = ["symbol", "q_end"]
    figures = queries.select(*place).join(usual, place, "left").join(stats, place, "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    return signals.knn_verdict(rows.join(figures, place, "left"), s).select(*names(SIGNALS))


def logs(spark: SparkSession, folder: str, merge_every: int = 64) -> tuple[BatchLog, BatchLog]:
    """The log of shapes and that of signals. The second is never merged, since a stream follows its files."""
    return BatchLog(spark, f"{folder}/shapes", SHAPES, merge_every), BatchLog(spark, f"{folder}/signals", SIGNALS, None)


def start(bars: DataFrame, s: Settings, folder: str, merge_every: int = 64, **trigger) -> StreamingQuery:
    """Starts the stream of k-NN signals of s on closed bars (symbol, ts, open, high, low, close), which has to begin with the history that is to be searched. folder is this stream's own.

    trigger: as of writeStream.trigger().
    """
    shapes, given = logs(bars.sparkSession, folder, merge_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        shapes.append(batch, batch_id)
        rows = shapes.read(batch_id)
        if not rows.isEmpty():  # batches that only move the watermark close no bar
            given.append(answered(rows, shapes.read(), s).repartition("symbol"), batch_id)

    with rocks(bars.sparkSession):
        writer = shaped(bars, s).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write)
        return (writer.trigger(**trigger) if trigger else writer).start()


def given(spark: SparkSession, folder: str) -> DataFrame:
    """All signals so far."""
    return logs(spark, folder)[1].read()


def decided(spark: SparkSession, folder: str, s: Settings, minutes: int, cash: float = simulator.CASH, poll: float | None = None) -> DataFrame:
    """A stream of the decisions (simulator.REPLAY) on the signals of a folder, as they come."""
    return decisions(spark.readStream.schema(SIGNALS).parquet(f"{folder}/signals/*"), s, minutes, cash, poll)
