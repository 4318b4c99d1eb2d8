"""Nearest past windows from running dot products, without windows.

The inner product of two windows that end at bars i and j is that of those ending one bar earlier, plus the product of the bars that enter, less that of the
bars that leave. So along each diagonal of the table of pairs a pair costs the same whatever the window's length, and with the mean and deviation of each window it
gives the distance of their normal forms. What is shuffled are the returns of the bars, packed by whole sessions, never windows.
Running sums lose precision, by a known bound: pairs that may be among the best by that bound are computed again by component, so the
results are those of neighbours.nearest() on z-scored windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeforms.operators.neighbours import BUFFER, PAIRS, Group
from tapeforms.operators.windows import FLAT, forward_return, log_returns

#: Bars of a chunk, about; sessions stay whole.
CHUNK = 2048
ROWS = 256
KINDS = {"at": "<i8", "r": "<f8", "pos": "<i8", "fwd_ret": "<f8", "end_ts": "<i8"}


class Series:
    """The returns of the bars of some sessions, and the mean and deviation of the window that ends at each."""

    def __init__(self, row: dict, window: int):
        self.at, r, pos, self.fwd_ret, self.end_ts = (np.frombuffer(row[c], dtype=KINDS[c]) for c in KINDS)
        self.window, self.r = window, r.reshape(len(self.at), -1)
        n = len(self.at)
        self.mean, self.spread = np.zeros(n), np.zeros(n)
        if n >= window:
            runs = sliding_window_view(self.r, window, axis=0)
            self.mean[window - 1 :] = runs.mean(axis=(1, 2))
            self.spread[window - 1 :] = runs.std(axis=(1, 2))
        self.valid = (pos >= window) & (self.spread > FLAT)
        self.most = float(np.abs(self.r).max(initial=0))

    def normal(self, at: np.ndarray) -> np.ndarray:
        """The normal forms of the windows that end at these places."""
        x = self.r[at[:, None] - np.arange(self.window - 1, -1, -1)[None, :]].reshape(len(at), -1)
        return (x - self.mean[at][:, None]) / self.spread[at][:, None]


class Diagonals(Group):
    """Queries: all valid windows of some sessions."""

    def begin(self, series: Series) -> None:
        self.series = series
        self.places = np.flatnonzero(series.valid)
        self.at = series.at[self.places]
        self.worst, self.worst_at = np.full(len(self.at), np.inf), np.full(len(self.at), np.iinfo(np.int64).max)

    def pass_by(self, other: Series) -> None:
        own, w = self.series, self.window
        chosen = np.flatnonzero(other.valid & np.isfinite(other.fwd_ret))
        if not len(chosen) or not len(self.places):
            return
        values = w * own.r.shape[1]
        error = np.finfo(float).eps * 4 * (len(own.at) + len(other.at)) * values * own.most * other.most
        number = np.full(len(own.at), -1)
        number[self.places] = np.arange(len(self.places))
        last = int(self.places[np.flatnonzero(self.at - w >= other.at[chosen[0]] + self.horizon)[-1]]) if (self.at - w >= other.at[chosen[0]] + self.horizon).any() else -1
        dots, rows = [], []
        products = np.zeros(len(other.at))
        for i in range(last + 1):
            moved = np.empty_like(products)
            moved[0] = 0.0
            moved[1:] = products[:-1]
            moved += other.r @ own.r[i]
            if i >= w:
                moved[w:] -= other.r[:-w] @ own.r[i - w]
            products = moved
            if number[i] >= 0:
                dots.append(products[chosen])
                rows.append(number[i])
            if len(rows) == ROWS or (i == last and rows):
                self._compare(np.array(rows), np.array(dots), other, chosen, values, error)
                dots, rows = [], []

    def _compare(self, rows: np.ndarray, dots: np.ndarray, other: Series, chosen: np.ndarray, values: int, error: float) -> None:
        at = other.at[chosen]
        mean, spread = self.series.mean[self.places[rows]], self.series.spread[self.places[rows]]
        both = spread[:, None] * other.spread[chosen][None, :]
        squares = 2 * values - 2 * (dots - values * mean[:, None] * other.mean[chosen][None, :]) / both
        width = 2 * error / both + 1e-12 * values
        squares[at[None, :] + self.horizon > self.at[rows][:, None] - self.window] = np.inf

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            step = max(1, PAIRS * 8 // values)
            parts = [((self.series.normal(self.places[i[s : s + step]]) - other.normal(chosen[j[s : s + step]])) ** 2).sum(1) for s in range(0, len(i), step)]
            return np.concatenate(parts)

        self.take(rows, np.maximum(squares - width, 0), 2 * width, at, other.fwd_ret[chosen], other.end_ts[chosen], exact)


def _packed(bars: DataFrame, horizon: int, features: str, chunk: int) -> DataFrame:
    """(symbol, part, first, at, r, pos, fwd_ret, end_ts): bars of whole sessions as bytes."""
    rows = forward_return(log_returns(bars, features), horizon).select("symbol", F.floor((F.col("idx") - F.col("pos")) / chunk).alias("part"), F.col("idx").alias("at"), "r", F.col("pos").cast("long").alias("pos"), "fwd_ret", F.col("ts").alias("end_ts"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at = table.column("at").to_numpy()
        lists = table.column("r").combine_chunks()
        channels = int(np.asarray(lists.value_lengths().fill_null(0)).max(initial=0)) or 1
        r = np.zeros((len(at), channels))
        r[np.asarray(lists.is_valid())] = np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, channels)
        values = {"at": at, "r": r, "pos": table.column("pos").to_numpy(), "fwd_ret": table.column("fwd_ret").to_numpy(zero_copy_only=False).astype(np.float64), "end_ts": table.column("end_ts").cast(pa.int64()).to_numpy()}
        return pa.table([table.column("symbol").slice(0, 1), table.column("part").slice(0, 1), pa.array([int(at[0])]), *(pa.array([np.ascontiguousarray(v, dtype=KINDS[k]).tobytes()], pa.binary()) for k, v in values.items())], names=["symbol", "part", "first", *KINDS])

    return rows.groupBy("symbol", "part").applyInArrow(pack, "symbol string, part long, first long, " + ", ".join(f"{c} binary" for c in KINDS))


def nearest_by_diagonals(bars: DataFrame, window: int, horizon: int, k: int, features: str = "close", chunk: int = CHUNK) -> DataFrame:
    """neighbours.nearest() of every valid z-scored window of indexed bars: (symbol, q_end, end_idx, end_ts, fwd_ret, dist, rank)."""
    packed = _packed(bars, horizon, features, chunk)
    top = packed.groupBy("symbol").agg(F.max("part").alias("_top"))
    units = packed.withColumn("unit", F.col("part")).withColumn("part", F.lit(-1).cast("long"))
    later = packed.join(top, "symbol").withColumn("unit", F.explode(F.sequence("part", "_top"))).drop("_top")
    names = ["symbol", "unit", "part", *KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in names}
                if (row["symbol"], row["unit"]) != key:
                    if group is not None and (out := group.found()) is not None:
                        yield out
                    key, group = (row["symbol"], row["unit"]), Diagonals(row["symbol"], window, horizon, BUFFER * k)
                if row["part"] < 0:
                    group.begin(Series(row, window))
                else:
                    group.pass_by(Series(row, window))
        if group is not None and (out := group.found()) is not None:
            yield out

    laid = units.select(names).unionByName(later.select(names)).repartition("symbol", "unit").sortWithinPartitions("symbol", "unit", "part")
    return laid.mapInArrow(run, "symbol string, q_end long, end_idx long, end_ts timestamp_ntz, fwd_ret double, dist double, rank int")
