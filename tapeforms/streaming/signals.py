"""Signals and decisions on a stream of closed bars, with their state in the state store, by symbol.

One operator keeps the last bars of each symbol and gives every bar out with what its signals need; the signals themselves are the columns of the batch engine. A
second one keeps each symbol's account and takes the step that a bar makes the trading loop take. Both hold a state of fixed size, so a batch costs the same however
long the stream has run, and a query that is started again from its checkpoint decides on no bar twice. They need the state store that
keeps typed state: see rocks().
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeforms.functions import candles
from tapeforms.operators import bars as B
from tapeforms.operators import ledger, signals, simulator, windows
from tapeforms.plans.settings import Settings

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BEFORE = [f"_{c}{back}" for back in (1, 2) for c in B.PRICES]
BUFFERED = "symbol string, session date, idx long, ts timestamp_ntz, minute int, pos long, open double, high double, low double, close double, " + ", ".join(f"{c} double" for c in BEFORE) + ", closes array<double>, w array<double>, q_end long"
BUFFER = "idx long, pos long, session date, ts timestamp_ntz, recent array<double>, w array<double>, q_end long"
#: When a loop looks again without a new bar: `poll` seconds later, and this many times longer while the market is closed, up to CLOSED_MOST.
CLOSED_TIMES, CLOSED_MOST = 10, 600.0


class NotASurvivor(RuntimeError):
    """A configuration that no evaluation has let through."""


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB; their checkpoints remember it."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Buffer(StatefulProcessor):
    """Numbers the bars of a symbol and keeps the last `depth` of the session, and the closes of the last whole window, of whatever session."""

    def __init__(self, window: int, depth: int):
        self.window, self.depth = window, max(depth, window + 1, 3)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("buffer", BUFFER)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        idx, pos, session, last, recent, w, q_end = tuple(held) if held is not None else (-1, -1, None, None, [], None, None)
        recent = list(recent)
        w = list(w) if w is not None else None
        names = [c.split()[0] for c in BUFFERED.split(", ")]
        for r in sorted(rows, key=lambda r: r.ts):
            if last is not None and r.ts <= last:
                continue  # given before
            if r.session != session:
                session, pos, recent = r.session, -1, []
            idx, pos, last = idx + 1, pos + 1, r.ts
            prices = [r.open, r.high, r.low, r.close]
            recent = (recent + prices)[-4 * self.depth :]
            closes = recent[3::4]
            if pos >= self.window:
                w, q_end = closes[-self.window - 1 :], idx
            earlier = [recent[-4 * back - 4 : -4 * back] or [None] * 4 for back in (1, 2)]
            yield Row(**dict(zip(names, [key[0], session, idx, r.ts, r.minute, pos, *prices, *earlier[0], *earlier[1], closes[::-1], w, q_end], strict=True)))
        self.state.update((idx, pos, session, last, recent, w, q_end))

    def close(self) -> None:
        pass


def buffered(bars: DataFrame, window: int, depth: int) -> DataFrame:
    """Closed bars (symbol, ts, open, high, low, close) in regular hours, numbered, each with the bars before it and the closes of its current window."""
    labelled = B.regular_hours(bars).select("symbol", "ts", *B.PRICES, F.to_date(B.new_york()).alias("session"), B.minute_of_day().cast("int").alias("minute"))
    return labelled.groupBy("symbol").transformWithState(statefulProcessor=Buffer(window, depth), outputStructType=BUFFERED, outputMode="Append", timeMode="None")


def with_signals(rows: DataFrame, s: Settings) -> DataFrame:
    """buffered() bars with direction, reason, pattern, n_matched and matched of the template or candle signals of s."""
    if s.signal_source == "candles":
        ago = [candles.Candle(*(F.col(c if back == 0 else f"_{c}{back}") for c in B.PRICES)) for back in (0, 1, 2)]
        out = signals.candle_verdict(rows, ago, s, lambda n: F.get("closes", F.lit(n)))
        return out.withColumns({"pattern": F.get("matched", F.lit(0)), "n_matched": F.size("matched")})
    if s.signal_source != "template" or s.features != "close":
        raise ValueError("a stream gives template signals on closes, or candle signals")
    x = F.zip_with(F.slice("w", 2, s.window), F.slice("w", 1, s.window), lambda now, before: F.ln(now / before))
    z, valid = windows.normaliser(s.normalization)(F.col("_x"))
    shaped = rows.withColumn("_x", x).withColumns({"z": z, "valid": F.when(F.col("_x").isNotNull(), valid)})
    return signals.template_verdict(signals.with_template_figures(shaped, s), s).drop("_x", "z", "valid", "any_long", "any_short")


def depth_of(s: Settings) -> int:
    """How many bars of a session the signals of s look at."""
    return max((p.bars - 1 + max(0, s.candle_trend_lookback) for p in candles.CANDLES.values()), default=0) + 1


def stream_signals(bars: DataFrame, *settings: Settings) -> DataFrame:
    """(source, symbol, session, idx, ts, minute, open, close, direction, reason, pattern, n_matched, matched): a row per bar and configuration. Their windows are of one length."""
    if len({s.window for s in settings}) != 1:
        raise ValueError("configurations of one stream share the length of their windows")
    rows = buffered(bars, settings[0].window, max(map(depth_of, settings)))
    figures = ["direction", "reason", "pattern", "n_matched", "matched"]
    shown = ["symbol", "session", "idx", "ts", "minute", "open", "close"]
    for i, s in enumerate(settings):
        rows = with_signals(rows, s).withColumn(f"_of{i}", F.struct(F.lit(s.signal_source).alias("source"), *figures)).drop(*figures)
    return rows.select(*shown, F.inline(F.array(*(F.col(f"_of{i}") for i in range(len(settings))))))


ACCOUNT = "idx long, ts timestamp_ntz, close double, " + simulator.STATE


def market_open(now: dt.datetime) -> bool:
    """Whether regular hours run at that time, by the clock alone: weekdays from 09:30 until before 16:00 in New York."""
    there = now.astimezone(ZoneInfo("America/New_York"))
    return there.weekday() < 5 and B.OPEN_MINUTE <= there.hour * 60 + there.minute < B.CLOSE_MINUTE


def next_look(now: dt.datetime, poll: float) -> float:
    """Seconds until the loop looks again without a new bar."""
    return poll if market_open(now) else min(poll * CLOSED_TIMES, CLOSED_MOST)


class Decider(StatefulProcessor):
    """The trading loop of each symbol: a decision per closed bar, and one per look without a new bar if there is a poll."""

    def __init__(self, s: Settings, minutes: int, cash: float, poll: float | None = None):
        self.s, self.minutes, self.cash, self.poll = s, minutes, cash, poll

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("account", ACCOUNT)

    def _trader(self) -> tuple[simulator.Trader, Row | None]:
        trader = simulator.Trader(self.s, self.minutes, self.cash)
        held = self.state.get() if self.state.exists() else None
        if held is not None:
            held = Row(*[c.split()[0] for c in ACCOUNT.split(", ")])(*held)
            trader.restore(held.asDict())
        return trader, held

    @staticmethod
    def _row(trader: simulator.Trader, symbol: str, idx: int, ts: dt.datetime, close: float, outcome: str) -> Row:
        order = trader.order or (None, None, None)
        values = (symbol, idx, ts, close, outcome, trader.cash + trader.held * close, trader.price, trader.held, trader.average, trader.cash, trader.entry, *order)
        return Row(**dict(zip([c.split()[0] for c in simulator.REPLAY.split(", ")], values, strict=True)))

    def _look_again(self, now_ms: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        wait = next_look(dt.datetime.fromtimestamp(now_ms / 1000, dt.UTC), self.poll)
        self.handle.registerTimer(now_ms + math.ceil(1000 * wait))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        trader, held = self._trader()
        last = held.idx if held is not None else -1
        ts, close = (held.ts, held.close) if held is not None else (None, None)
        for r in sorted(rows, key=lambda r: r.idx):
            if r.idx <= last:
                continue  # decided before
            outcome = trader.step(r.idx, r.minute, r.open, r.close, r.direction)
            last, ts, close = r.idx, r.ts, r.close
            yield self._row(trader, key[0], last, ts, close, outcome)
        order = trader.order or (None, None, None)
        self.state.update((last, ts, close, trader.held, trader.average, trader.cash, trader.entry, *order))
        if self.poll is not None:
            self._look_again(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        trader, held = self._trader()
        trader.price = None
        if held is not None and held.ts is not None:
            yield self._row(trader, key[0], held.idx, held.ts, held.close, idle_outcome(trader, dt.datetime.fromtimestamp(now / 1000, dt.UTC)))
        if self.poll is not None:
            self._look_again(now)

    def close(self) -> None:
        pass


def idle_outcome(trader: simulator.Trader, now: dt.datetime) -> str:
    """What a look without a new bar comes to."""
    if not market_open(now):
        return "market_closed"
    if trader.order is not None:
        return "entry_pending" if trader.order[0] == "buy" else "exit_pending"
    return "hold" if trader.held > 0 else "already_decided"


def decisions(signalled: DataFrame, s: Settings, minutes: int, cash: float = simulator.CASH, poll: float | None = None) -> DataFrame:
    """The columns of simulator.REPLAY: a row per closed bar of signalled (symbol, idx, ts, minute, open, close, direction), and with poll (seconds) one per look without a new bar."""
    rows = signalled.select("symbol", "idx", "ts", F.col("minute").cast("int").alias("minute"), "open", "close", "direction")
    return rows.groupBy("symbol").transformWithState(statefulProcessor=Decider(s, minutes, cash, poll), outputStructType=simulator.REPLAY, outputMode="Append", timeMode="ProcessingTime" if poll is not None else "None")


def require_survivor(verdicts: DataFrame | None, s: Settings) -> None:
    """Raises unless an evaluation of the configuration survived; verdicts as ledger.verdicts() gives them."""
    if verdicts is None or ledger.survivors(verdicts).where(F.col("config_hash") == s.hash).isEmpty():
        raise NotASurvivor(f"configuration {s.hash} has passed no evaluation")


def traded(bars: DataFrame, s: Settings, minutes: int, verdicts: DataFrame | None, cash: float = simulator.CASH, poll: float | None = None) -> DataFrame:
    """From closed bars to decisions in one stream, for a configuration that has survived its evaluation."""
    require_survivor(verdicts, s)
    return decisions(stream_signals(bars, s), s, minutes, cash, poll)


def is_bar(outcome: str = "outcome") -> Column:
    """Rows of decisions() that belong to a bar, not to a look without one."""
    return ~F.col(outcome).isin("market_closed", "entry_pending", "exit_pending", "already_decided")
