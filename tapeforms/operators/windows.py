"""Sliding windows of returns within a session, their normal forms, and the window that is current at a bar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FLAT = 1e-12
SESSION = ["symbol", "session"]


def log_returns(bars: DataFrame, features: str = "close") -> DataFrame:
    """indexed() bars with r, the log returns against the close before in the session: of the close, or of open, high, low and close."""
    before = F.lag("close").over(W.partitionBy(*SESSION).orderBy("idx"))
    names = {"close": ["close"], "ohlc": ["open", "high", "low", "close"]}[features]
    r = F.array(*(F.ln(F.col(c) / F.col("_before")) for c in names))
    return bars.withColumn("_before", before).withColumn("r", F.when(F.col("_before").isNotNull(), r)).drop("_before")


def forward_return(bars: DataFrame, horizon: int) -> DataFrame:
    """bars with fwd_ret, the return over the next `horizon` bars of the session, else null."""
    ahead = F.lead("close", horizon).over(W.partitionBy(*SESSION).orderBy("idx"))
    return bars.withColumn("fwd_ret", ahead / F.col("close") - 1)


def raw(x: Column) -> tuple[Column, Column]:
    return x, F.lit(True)


def zscore(x: Column) -> tuple[Column, Column]:
    """Minus the mean, by the population deviation, over all values; not valid, and not divided, where there is none."""
    n = F.when(F.size(x) > 0, F.size(x))
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    centred = F.transform(F.arrays_zip(x.alias("v"), F.array_repeat(mean, n).alias("m")), lambda p: p["v"] - p["m"])
    spread = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, v: s + v * v) / n)
    return F.transform(F.arrays_zip(centred.alias("v"), F.array_repeat(F.when(spread > FLAT, spread).otherwise(1.0), n).alias("s")), lambda p: p["v"] / p["s"]), spread > FLAT


#: Normal forms by name; each takes a window's values and gives its form and whether it is valid.
NORMALISERS: dict[str, Callable[[Column], tuple[Column, Column]]] = {"logret_zscore": zscore, "logret_raw": raw}


def normaliser(name: str) -> Callable[[Column], tuple[Column, Column]]:
    if name not in NORMALISERS:
        raise KeyError(f"unknown normalization {name!r}")
    return NORMALISERS[name]


def windows(bars: DataFrame, window: int, horizon: int, features: str = "close", normalization: str = "logret_zscore") -> DataFrame:
    """(symbol, session, end_idx, end_ts, x, z, valid, fwd_ret): one row per run of `window` bars within a session.

    x is the window bar by bar, z its normal form. bars are indexed().
    """
    width = window * (1 if features == "close" else 4)
    frame = W.partitionBy(*SESSION).orderBy("idx").rowsBetween(1 - window, 0)
    rows = forward_return(log_returns(bars, features), horizon).withColumn("x", F.flatten(F.collect_list("r").over(frame)))
    z, valid = normaliser(normalization)(F.col("x"))
    full = rows.where(F.size("x") == width)
    return full.select("symbol", "session", F.col("idx").alias("end_idx"), F.col("ts").alias("end_ts"), "x", z.alias("z"), valid.alias("valid"), "fwd_ret")


def current_window(bars: DataFrame, window: int) -> DataFrame:
    """indexed() bars with q_end: the end of the latest window that ends at or before the bar, of an earlier session if need be.

    A window ends at each bar from the session's bar `window` on (the first has no return). What is carried over from
    sessions before is found on the table of sessions.
    """
    ends = F.when(F.col("pos") >= window, F.col("idx"))
    last = bars.groupBy("symbol", "session").agg(F.max(ends).alias("_end"))
    carried = last.withColumn("_carried", F.max("_end").over(W.partitionBy("symbol").orderBy("session").rowsBetween(W.unboundedPreceding, -1))).drop("_end")
    return bars.join(carried, ["symbol", "session"]).withColumn("q_end", F.coalesce(ends, "_carried")).drop("_carried")


def window_at(all_windows: DataFrame, asof: Column) -> DataFrame:
    """Per symbol the latest window that ends at or before asof."""
    columns = [c for c in all_windows.columns if c != "symbol"]
    return all_windows.where(F.col("end_ts") <= asof).groupBy("symbol").agg(F.max_by(F.struct(*columns), "end_idx").alias("_w")).select("symbol", "_w.*")
