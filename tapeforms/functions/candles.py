"""Candlestick anatomy and the ten detectors, as Boolean columns over a bar and the one or two before it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_WICK, SMALL_BODY, STRONG_BODY = 2.0, 0.3, 0.5


class Candle:
    """Columns of the bar `back` bars ago in the session (0: the bar itself)."""

    def __init__(self, open_: Column, high: Column, low: Column, close: Column):
        self.open, self.high, self.low, self.close = open_, high, low, close
        top, bottom = F.greatest(open_, close), F.least(open_, close)
        self.body, self.range = F.abs(close - open_), high - low
        self.upper, self.lower = high - top, bottom - low
        self.bullish, self.bearish = close > open_, close < open_
        self.middle = (open_ + close) / 2
        self.top, self.bottom = top, bottom


@dataclass(frozen=True)
class Pattern:
    name: str
    bars: int
    direction: str
    fires: Callable[..., Column]


def _wick(long: str, short: str) -> Callable[..., Column]:
    return lambda c: (c.body > 0) & (getattr(c, long) >= LONG_WICK * c.body) & (getattr(c, short) <= c.body)


def _star(a: Candle, b: Candle, d: Candle, rising: bool) -> Column:
    outer = (a.bearish, d.bullish) if rising else (a.bullish, d.bearish)
    gap = b.top < a.close if rising else b.bottom > a.close
    back = d.close > a.middle if rising else d.close < a.middle
    return outer[0] & (a.range > 0) & (b.range > 0) & (a.body >= STRONG_BODY * a.range) & (b.body <= SMALL_BODY * b.range) & gap & outer[1] & back


def _three(a: Candle, b: Candle, d: Candle, rising: bool) -> Column:
    if rising:
        return a.bullish & b.bullish & d.bullish & (b.close > a.close) & (d.close > b.close) & (a.close > b.open) & (b.open > a.open) & (b.close > d.open) & (d.open > b.open)
    return a.bearish & b.bearish & d.bearish & (b.close < a.close) & (d.close < b.close) & (a.close < b.open) & (b.open < a.open) & (b.close < d.open) & (d.open < b.open)


#: In the order in which the first to fire gives a signal its name.
CANDLES = {
    p.name: p
    for p in (
        Pattern("hammer", 1, "LONG", _wick("lower", "upper")),
        Pattern("shooting_star", 1, "SHORT", _wick("upper", "lower")),
        Pattern("bullish_engulfing", 2, "LONG", lambda p, c: p.bearish & c.bullish & (c.close >= p.open) & (c.open <= p.close) & (c.body > p.body)),
        Pattern("bearish_engulfing", 2, "SHORT", lambda p, c: p.bullish & c.bearish & (c.open >= p.close) & (c.close <= p.open) & (c.body > p.body)),
        Pattern("piercing_line", 2, "LONG", lambda p, c: p.bearish & c.bullish & (c.open < p.close) & (p.middle < c.close) & (c.close < p.open)),
        Pattern("dark_cloud_cover", 2, "SHORT", lambda p, c: p.bullish & c.bearish & (c.open > p.close) & (p.open < c.close) & (c.close < p.middle)),
        Pattern("morning_star", 3, "LONG", lambda a, b, d: _star(a, b, d, True)),
        Pattern("evening_star", 3, "SHORT", lambda a, b, d: _star(a, b, d, False)),
        Pattern("three_white_soldiers", 3, "LONG", lambda a, b, d: _three(a, b, d, True)),
        Pattern("three_black_crows", 3, "SHORT", lambda a, b, d: _three(a, b, d, False)),
    )
}


def chosen(names: tuple[str, ...]) -> list[Pattern]:
    if not names:
        raise ValueError("no candle pattern is enabled")
    missing = [n for n in names if n not in CANDLES]
    if missing:
        raise KeyError(f"unknown candle patterns {missing}")
    return [CANDLES[n] for n in names]
