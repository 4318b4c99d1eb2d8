"""Nearest past windows by an index of their shapes, so that most pairs are never computed.

Each window is summed up by the means of a few segments; by these, windows are dealt into cells of a symbol, each with the box of its
means. The distance from a query to anything in a cell is at least that of its means to the box, by segment lengths. A unit of queries (of one cell) first
meets the cell that it is in, then those other cells whose boxes may hold something nearer than its queries' worst kept neighbours, nearest box
first; a cell is passed over for every query that has its neighbours nearer than the box. Results are those of neighbours.nearest().

Where many windows have one shape, their cell is cut by time, and once a query has its neighbours at distance 0, all parts that begin
later are passed over, since ties go by bar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeforms.operators.neighbours import BUFFER, TIE, Group
from tapeforms.sources import folders

#: Segments at most, levels of a segment (a power of two) at most, windows of a cell, about, and of a part of one.
SEGMENTS, LEVELS, CELL, PART = 8, 16, 128, 4096
FOUND = "symbol string, q_end long, end_idx long, end_ts timestamp_ntz, fwd_ret double, dist double, rank int, met long"
STATE = ("query", "held_at", "held_dist", "held_ret", "held_ts")
KINDS = {"at": "<i8", "z": "<f8", "fwd_ret": "<f8", "end_ts": "<i8", "met": "<i8", "query": "<i8", "held_at": "<i8", "held_dist": "<f8", "held_ret": "<f8", "held_ts": "<i8"}


def segments(width: int) -> list[tuple[int, int]]:
    """Start and length of each segment of a window of that many values."""
    n = min(width, SEGMENTS)
    cuts = [width * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def means(z: np.ndarray) -> np.ndarray:
    return np.stack([z[:, a : a + n].mean(axis=1) for a, n in segments(z.shape[1])], axis=1)


class Unit(Group):
    """Queries of one cell. met counts the candidates whose distance to each was computed."""

    def add(self, at: np.ndarray, z: np.ndarray) -> None:
        super().add(at, z)
        self.means = means(self.z)
        self.lengths = np.array([n for _, n in segments(self.z.shape[1])], dtype=np.float64)
        self.met = np.zeros(len(self.at), dtype=np.int64)

    def visit(self, at: np.ndarray, z: np.ndarray, fwd_ret: np.ndarray, end_ts: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        gap = np.maximum(np.maximum(low - self.means, self.means - high), 0)
        least = np.sqrt(gap * gap @ self.lengths)
        passed = (least > self.worst + 2 * TIE) | ((self.worst == 0) & (at[0] > self.worst_at)) | (at[0] + self.horizon > self.at - self.window)
        rows = np.flatnonzero(~passed)
        if len(rows):
            before = self.size
            self.met[rows] += self.meet(at, z, fwd_ret, end_ts, rows)
            if self.size - before > len(self.at):
                self.keep_best()

    def state(self) -> dict[str, bytes]:
        if self.held:
            self.keep_best()
        held = self.held[0] if self.held else [np.empty(0)] * len(STATE)
        values = dict(zip(STATE, held, strict=True)) | {"at": self.at, "z": self.z, "met": self.met}
        return {k: np.ascontiguousarray(v, dtype=KINDS[k]).tobytes() for k, v in values.items()}

    @classmethod
    def resumed(cls, row: dict, window: int, horizon: int, most: int) -> Unit:
        unit = cls(row["symbol"], window, horizon, most)
        at = np.frombuffer(row["at"], dtype=KINDS["at"])
        unit.add(at, np.frombuffer(row["z"], dtype=KINDS["z"]).reshape(len(at), -1))
        if row.get("met") is not None:
            unit.met = np.frombuffer(row["met"], dtype=KINDS["met"]).copy()
            unit.held = [tuple(np.frombuffer(row[c], dtype=KINDS[c]) for c in STATE)]
            unit.keep_best()
        return unit

    def found(self) -> pa.RecordBatch | None:
        out = super().found()
        if out is None:
            return None
        query = self.held[0][0]
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(self.met[query])], names=[*out.schema.names, "met"])


def _segment_means(z: Column, width: int) -> list[Column]:
    return [F.aggregate(F.slice(z, a + 1, n), F.lit(0.0), lambda s, v: s + v) / n for a, n in segments(width)]


def with_cells(windows: DataFrame, width: int, cell: int = CELL) -> DataFrame:
    """windows (cut) with cell: the quantiles between which the means of their segments lie, so many levels that a cell holds about `cell` windows."""
    named = windows.withColumns({f"_m{i}": m for i, m in enumerate(_segment_means(F.col("z"), width))})
    n = len(segments(width))
    probabilities = [i / LEVELS for i in range(1, LEVELS)]
    row = named.agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(f"_m{i}", probabilities).alias(f"q{i}") for i in range(n))).first()
    bits = min(n * (LEVELS.bit_length() - 1), max(0, int(np.ceil(np.log2(max(1, row["n"]) / cell)))))
    code = F.lit(0).cast("long")
    for i in range(n):
        levels = 1 << bits // n + (i < bits % n)
        bounds = (row[f"q{i}"] or [])[LEVELS // levels - 1 :: LEVELS // levels]
        code = code * levels + sum((F.when(F.col(f"_m{i}") > b, 1).otherwise(0) for b in bounds[: levels - 1]), F.lit(0))
    return named.withColumn("cell", code).drop(*(f"_m{i}" for i in range(n)))


def _parted(rows: DataFrame, part: int) -> DataFrame:
    """rows (symbol, cell, at, …) with slot: cells of more than `part` rows are cut by time."""
    counts = folders.cut(rows.groupBy("symbol", "cell").agg(F.ceil(F.count(F.lit(1)) / part).alias("_parts"), F.min("at").alias("_from"), F.max("at").alias("_to")))
    slot = F.floor((F.col("at") - F.col("_from")) * F.col("_parts") / (F.col("_to") - F.col("_from") + 1))
    return rows.join(counts, ["symbol", "cell"]).withColumn("slot", slot.cast("long")).drop("_parts", "_from", "_to")


def _packed(rows: DataFrame) -> DataFrame:
    """A row per (symbol, cell, slot) of rows (symbol, cell, slot, at, z, fwd_ret, end_ts), in order of time, with its first and last bar and its box."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at = table.column("at").to_numpy()
        z = np.asarray(table.column("z").combine_chunks().flatten(), dtype=np.float64).reshape(len(at), -1)
        m = means(z)
        ret = table.column("fwd_ret").to_numpy(zero_copy_only=False).astype(np.float64)
        times = table.column("end_ts").cast(pa.int64()).fill_null(0).to_numpy()
        values = {"at": at, "z": z, "fwd_ret": ret, "end_ts": times}
        columns = [*(table.column(c).slice(0, 1) for c in ("symbol", "cell", "slot")), pa.array([int(at[0])]), pa.array([int(at[-1])]), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (m.min(0), m.max(0)))]
        return pa.table([*columns, *(pa.array([np.ascontiguousarray(v, dtype=KINDS[k]).tobytes()], pa.binary()) for k, v in values.items())], names=["symbol", "cell", "slot", "first", "last", "low", "high", *values])

    return rows.groupBy("symbol", "cell", "slot").applyInArrow(pack, "symbol string, cell long, slot long, first long, last long, low array<double>, high array<double>, at binary, z binary, fwd_ret binary, end_ts binary")


def _gap(n: int, lengths: list[int]) -> Column:
    """The least distance of two boxes of means, (low, high) and (c_low, c_high)."""
    sides = [F.greatest(F.col("c_low")[i] - F.col("high")[i], F.col("low")[i] - F.col("c_high")[i], F.lit(0.0)) for i in range(n)]
    return F.sqrt(sum((d * d * size for d, size in zip(sides, lengths, strict=True)), F.lit(0.0)))


def _visited(units: DataFrame, visits: DataFrame, window: int, horizon: int, most: int, last: bool) -> DataFrame:
    """Each unit with the cells that it visits (symbol, cell, slot of the unit), nearest box first. last: its neighbours; else itself with the worst distance of its queries."""
    place = ["symbol", "cell", "slot"]
    rows = units.withColumn("gap", F.lit(-1.0)).unionByName(visits, allowMissingColumns=True)
    laid = rows.repartition(*place).sortWithinPartitions(*place, "gap", "first")
    names = ["at", "z", "met", *STATE]
    schema = FOUND if last else "symbol string, cell long, slot long, first long, last long, low array<double>, high array<double>, " + ", ".join(f"{c} binary" for c in names) + ", radius double"

    def closed(unit: Unit, row: dict) -> pa.RecordBatch | None:
        if last:
            return unit.found()
        values = {c: [row[c]] for c in ("symbol", "cell", "slot", "first", "last", "low", "high")} | {k: [v] for k, v in unit.state().items()}
        values["radius"] = [float(unit.worst.max(initial=0))]
        kinds = [pa.string(), *[pa.int64()] * 4, *[pa.list_(pa.float64())] * 2, *[pa.binary()] * len(names), pa.float64()]
        order = ["symbol", "cell", "slot", "first", "last", "low", "high", *names, "radius"]
        return pa.RecordBatch.from_arrays([pa.array(values[c], k) for c, k in zip(order, kinds, strict=True)], names=order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, own = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["gap"] < 0:
                    if unit is not None and (out := closed(unit, own)) is not None:
                        yield out
                    unit, own = Unit.resumed(row, window, horizon, most), row
                    continue
                at = np.frombuffer(row["at"], dtype=KINDS["at"])
                z = np.frombuffer(row["z"], dtype=KINDS["z"]).reshape(len(at), -1)
                unit.visit(at, z, np.frombuffer(row["fwd_ret"], dtype=KINDS["fwd_ret"]), np.frombuffer(row["end_ts"], dtype=KINDS["end_ts"]), np.array(row["low"]), np.array(row["high"]))
        if unit is not None and (out := closed(unit, own)) is not None:
            yield out

    return laid.mapInArrow(run, schema)


def nearest_by_index(all_windows: DataFrame, window: int, horizon: int, k: int, width: int, cell: int = CELL, part: int = PART) -> DataFrame:
    """neighbours.nearest() of every valid window among those that it may look at, with met: how many distances were computed for the query."""
    spark = all_windows.sparkSession
    known = folders.cut(all_windows.where("valid").select("symbol", F.col("end_idx").alias("at"), "z", "fwd_ret", "end_ts"))
    celled = with_cells(known, width, cell)
    cells = folders.cut(_packed(_parted(celled.where("fwd_ret is not null"), part)))
    units = _packed(_parted(celled, part)).drop("fwd_ret", "end_ts")
    most = BUFFER * k
    seen = F.col("c_first") + horizon <= F.col("last") - window
    place = ["symbol", "cell", "slot"]
    payload = ["at", "z", "fwd_ret", "end_ts"]
    own = cells.select("symbol", "cell", F.col("first").alias("c_first"), F.col("low").alias("c_low"), F.col("high").alias("c_high"), *payload)
    units = folders.cut(units)
    home = units.select(*place, "last").join(own, ["symbol", "cell"]).where(seen).select(*place, F.col("c_first").alias("first"), F.col("c_low").alias("low"), F.col("c_high").alias("high"), *payload, F.lit(0.0).alias("gap"))
    begun = folders.cut(_visited(units, home, window, horizon, most, last=False))
    # Boxes only, dealt into slices, so that no symbol is one task.
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    boxes = cells.select("symbol", F.col("cell").alias("c_cell"), F.col("slot").alias("c_slot"), F.col("first").alias("c_first"), F.col("low").alias("c_low"), F.col("high").alias("c_high")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    light = begun.select(*place, "last", "low", "high", "radius", F.pmod(F.xxhash64("cell", "slot"), F.lit(slices)).cast("int").alias("slice"))
    lengths = [n for _, n in segments(width)]
    met = light.join(boxes, ["symbol", "slice"]).where((F.col("c_cell") != F.col("cell")) & seen).withColumn("gap", _gap(len(lengths), lengths)).where(F.col("gap") <= F.col("radius") + 2 * TIE)
    named = cells.select("symbol", F.col("cell").alias("c_cell"), F.col("slot").alias("c_slot"), *payload)
    away = met.select(*place, "c_cell", "c_slot", "gap", F.col("c_first").alias("first"), F.col("c_low").alias("low"), F.col("c_high").alias("high")).join(named, ["symbol", "c_cell", "c_slot"]).drop("c_cell", "c_slot")
    return _visited(begun.drop("radius"), away, window, horizon, most, last=True)


def computed_share(found: DataFrame, all_windows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(symbol, n_pairs, n_computed): pairs of a query and what it may look at (candidates: symbol, q_end, n_candidates), and how many of them were computed."""
    asked = all_windows.where("valid").select("symbol", F.col("end_idx").alias("q_end")).join(candidates, ["symbol", "q_end"])
    met = found.groupBy("symbol", "q_end").agg(F.max("met").alias("met"))
    return asked.join(met, ["symbol", "q_end"], "left").groupBy("symbol").agg(F.sum("n_candidates").alias("n_pairs"), F.sum(F.coalesce("met", F.lit(0))).alias("n_computed"))
