"""Nearest past windows of each window, without a look ahead."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BUFFER = 5  # neighbours per kept match that are ranked before overlaps go
BLOCK = 512
#: Distances are ranked at this precision, ties by end_idx, so that engines that sum in another order agree.
DIGITS = 9
TIE = 10.0**-DIGITS
#: Error of a square by matrix product, as a part of the squares of the two; and pairs that are computed by component at once.
PRODUCT, PAIRS = 1e-12, 100_000
#: Queries that are few enough to be sent to every candidate.
FEW = 2048


def eligible(window: int, horizon: int, q_end: str = "q_end") -> Column:
    """What a query may look at: valid windows whose forward return ended before the query's window began."""
    return F.col("valid") & F.col("fwd_ret").isNotNull() & (F.col("end_idx") + horizon <= F.col(q_end) - window)


def _blocked(all_windows: DataFrame, queries: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Queries and candidates keyed by (symbol, qb): a candidate goes to each block of queries from its own on."""
    q = queries.withColumn("qb", F.floor(F.col("q_end") / block))
    top = q.groupBy("symbol").agg(F.max("qb").alias("_top"))
    c = all_windows.where("valid and fwd_ret is not null").select("symbol", "end_idx", "end_ts", "z", "fwd_ret", "valid").join(top, "symbol")
    own = F.floor(F.col("end_idx") / block)
    return q, c.where(own <= F.col("_top")).withColumn("qb", F.explode(F.sequence(own, F.col("_top")))).drop("_top")


def distances(all_windows: DataFrame, queries: DataFrame, window: int, horizon: int, width: int, block: int = BLOCK) -> DataFrame:
    """(symbol, q_end, end_idx, end_ts, fwd_ret, dist) of each query (symbol, q_end, qz) with each window that it may look at.

    The join is by symbol and block of queries, so it runs in as many tasks as there are blocks; the distance is spelled
    out by component, which keeps it in generated code.
    """
    q, c = _blocked(all_windows, queries, block)
    return _with_distances(q.join(c, ["symbol", "qb"]).where(eligible(window, horizon)), width)


def _with_distances(pairs: DataFrame, width: int) -> DataFrame:
    squares = [(F.col("qz")[i] - F.col("z")[i]) * (F.col("qz")[i] - F.col("z")[i]) for i in range(width)]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    return pairs.select("symbol", "q_end", "end_idx", "end_ts", "fwd_ret", F.round(F.sqrt(total), DIGITS).alias("dist"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The BUFFER * k nearest per query, with their rank."""
    order = W.partitionBy("symbol", "q_end").orderBy("dist", "end_idx")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BUFFER * k)


class Group:
    """Queries of one symbol, some blocks of them, and the best candidates that they have met."""

    def __init__(self, symbol: str, window: int, horizon: int, most: int):
        self.symbol, self.window, self.horizon, self.most = symbol, window, horizon, most
        self.at, self.z = np.empty(0, dtype=np.int64), None
        self.held: list[tuple[np.ndarray, ...]] = []  # query, candidate, distance, forward return, time
        self.worst, self.worst_at = np.empty(0), np.empty(0, dtype=np.int64)
        self.size = 0

    def add(self, at: np.ndarray, z: np.ndarray) -> None:
        self.at = np.concatenate((self.at, at))
        self.z = z if self.z is None else np.concatenate((self.z, z))
        self.worst, self.worst_at = np.full(len(self.at), np.inf), np.full(len(self.at), np.iinfo(np.int64).max)

    def meet(self, at: np.ndarray, z: np.ndarray, fwd_ret: np.ndarray, end_ts: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The candidates against the queries (those in rows only); gives how many each of these may look at. Squares come by matrix product, and again by component where they may matter."""
        squares = (z * z).sum(1)
        rows = np.arange(len(self.at)) if rows is None else rows
        looked = np.zeros(len(rows), dtype=np.int64)
        for lo in range(0, len(rows), 512):
            some = rows[lo : lo + 512]
            q = self.z[some]
            own = (q * q).sum(1)
            near = own[:, None] + squares[None, :] - 2 * q @ z.T
            near[at[None, :] + self.horizon > self.at[some][:, None] - self.window] = np.inf
            looked[lo : lo + 512] = np.isfinite(near).sum(1)
            error = PRODUCT * (own.max(initial=0) + squares.max(initial=0))
            self.take(some, near - error, 2 * error, at, fwd_ret, end_ts, lambda i, j, z=z: ((self.z[i] - z[j]) ** 2).sum(1))
        return looked

    def take(self, rows: np.ndarray, lower: np.ndarray, width: np.ndarray | float, at: np.ndarray, fwd_ret: np.ndarray, end_ts: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Holds the candidates that may be among the best of the queries in rows, with all that tie with these.

        Squared distances lie between lower and lower + width (infinite: not to be looked at); exact(i, j) computes those of pairs.
        """
        best = min(self.most, len(at))
        upper = lower + width
        limit = np.minimum(np.partition(upper, best - 1, axis=1)[:, best - 1], self.worst[rows] ** 2)
        limit = limit + 4 * TIE * np.sqrt(limit) + 4 * TIE * TIE
        i, j = np.nonzero((lower <= limit[:, None]) & (lower < np.inf))
        for lo in range(0, len(i), PAIRS):
            a, b = rows[i[lo : lo + PAIRS]], j[lo : lo + PAIRS]
            self.held.append((a, at[b], np.round(np.sqrt(exact(a, b)), DIGITS), fwd_ret[b], end_ts[b]))
            self.size += len(a)
            if self.size > 3 * max(len(self.at) * self.most, PAIRS):
                self.keep_best()

    def keep_best(self) -> None:
        query, at, dist, fwd_ret, end_ts = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((at, dist, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, rank = order[rank < self.most], query[rank < self.most], rank[rank < self.most]
        self.held = [(query, at[order], dist[order], fwd_ret[order], end_ts[order])]
        self.size = len(query)
        full = rank == self.most - 1
        self.worst[query[full]] = dist[order][full]
        self.worst_at[query[full]] = at[order][full]

    def found(self) -> pa.RecordBatch | None:
        if not self.held:
            return None
        self.keep_best()
        query, at, dist, fwd_ret, end_ts = self.held[0]
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        columns = [pa.array([self.symbol] * len(query), pa.string()), pa.array(self.at[query]), pa.array(at), pa.array(end_ts).cast(pa.timestamp("us")), pa.array(fwd_ret), pa.array(dist), pa.array(rank, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["symbol", "q_end", "end_idx", "end_ts", "fwd_ret", "dist", "rank"])


def _packed(rows: DataFrame, block: str) -> DataFrame:
    """rows (symbol, block, at, z, fwd_ret, end_ts) with a row per block of them, its columns as binary."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        z = np.asarray(table.column("z").combine_chunks().flatten(), dtype=np.float64)
        times = table.column("end_ts").cast(pa.int64())
        parts = [table.column("at").to_numpy(), z, table.column("fwd_ret").to_numpy(zero_copy_only=False).astype(np.float64), times.to_numpy(zero_copy_only=False).astype(np.float64)]
        return pa.table([table.column("symbol").slice(0, 1), table.column(block).slice(0, 1), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["symbol", block, "at", "z", "fwd_ret", "end_ts"])

    return rows.groupBy("symbol", block).applyInArrow(pack, f"symbol string, {block} long, at binary, z binary, fwd_ret binary, end_ts binary")


def nearest_by_blocks(all_windows: DataFrame, queries: DataFrame, window: int, horizon: int, k: int, block: int = 8 * BLOCK, chunk: int = 8 * BLOCK) -> DataFrame:
    """nearest(distances()) for wide windows, in matrix products.

    `block` queries are a unit and `chunk` candidates a row of bytes. A unit's queries come first in its partition, then the chunks that it may look at, one
    after another; only the best BUFFER * k of each query are kept, so what a task holds doesn't grow and its result needs no merge.
    """
    none = [F.lit(None).cast("double").alias("fwd_ret"), F.lit(None).cast("timestamp_ntz").alias("end_ts")]
    q = queries.select("symbol", F.floor(F.col("q_end") / block).alias("unit"), F.col("q_end").alias("at"), F.col("qz").alias("z"), *none)
    top = q.groupBy("symbol").agg(F.max("unit").alias("_top"))
    c = all_windows.where("valid and fwd_ret is not null").select("symbol", F.floor(F.col("end_idx") / chunk).alias("part"), F.col("end_idx").alias("at"), "z", "fwd_ret", "end_ts")
    first = F.floor(F.col("part") * chunk / block)
    chunks = _packed(c, "part").join(top, "symbol").where(first <= F.col("_top")).withColumn("unit", F.explode(F.sequence(first, F.col("_top"))))
    names = ["symbol", "unit", "part", "at", "z", "fwd_ret", "end_ts"]
    rows = _packed(q, "unit").withColumn("part", F.lit(-1).cast("long")).select(names).unionByName(chunks.select(names))
    place = ["symbol", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in names}
                if (r["symbol"], r["unit"]) != key:
                    if group is not None and (out := group.found()) is not None:
                        yield out
                    key, group = (r["symbol"], r["unit"]), Group(r["symbol"], window, horizon, BUFFER * k)
                at = np.frombuffer(r["at"], dtype=np.int64)
                z = np.frombuffer(r["z"]).reshape(len(at), -1)
                if r["part"] < 0:
                    group.add(at, z)
                elif group.z is not None:
                    group.meet(at, z, np.frombuffer(r["fwd_ret"]), np.frombuffer(r["end_ts"]).astype(np.int64))
        if group is not None and (out := group.found()) is not None:
            yield out

    laid = rows.repartition(*place).sortWithinPartitions(*place, "part")
    return laid.mapInArrow(run, "symbol string, q_end long, end_idx long, end_ts timestamp_ntz, fwd_ret double, dist double, rank int")


def nearest_of_few(all_windows: DataFrame, queries: DataFrame, window: int, horizon: int, k: int, width: int) -> DataFrame:
    """nearest(distances()) of at most FEW queries, as the caller has counted, whatever the number of candidates: these stay where they are, every task keeps its best
    for each query, and only those are shuffled. So one query is the work of all tasks."""
    c = all_windows.where("valid and fwd_ret is not null").select("symbol", "end_idx", "end_ts", "z", "fwd_ret", "valid")
    pairs = c.join(F.broadcast(queries.select("symbol", "q_end", "qz")), "symbol").where(eligible(window, horizon))
    return nearest(_with_distances(pairs, width), k)


def without_overlaps(ranked: DataFrame, k: int, gap: int) -> DataFrame:
    """Of each query's ranked neighbours, best first, those more than `gap` bars from all kept before, at most k: (…, kept_rank)."""
    item = F.struct("rank", "end_idx", "end_ts", "dist", "fwd_ret")
    lists = ranked.groupBy("symbol", "q_end").agg(F.sort_array(F.collect_list(item)).alias("near"))
    start = F.filter("near", lambda x: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        stop = (F.size(kept) >= k) | F.exists(kept, lambda y: F.abs(y["end_idx"] - x["end_idx"]) <= gap)
        return F.when(stop, kept).otherwise(F.concat(kept, F.array(x)))

    kept = lists.select("symbol", "q_end", F.posexplode(F.aggregate("near", start, step)).alias("kept_rank", "m"))
    return kept.select("symbol", "q_end", (F.col("kept_rank") + 1).alias("kept_rank"), "m.*")


def match_stats(kept: DataFrame) -> DataFrame:
    """Per query: n, mean, median and share above 0 of the kept forward returns."""
    return kept.groupBy("symbol", "q_end").agg(F.count(F.lit(1)).alias("n"), F.avg("fwd_ret").alias("mean"), F.median("fwd_ret").alias("median"), F.avg((F.col("fwd_ret") > 0).cast("double")).alias("pct_positive"))


def unconditional(all_windows: DataFrame, window: int, horizon: int) -> DataFrame:
    """(symbol, q_end, n_candidates, uncond_mean) of what each window may look at, from running sums, without a join of pairs.

    Sums run within sessions and over the table of sessions. A forward return ends in its session, horizon bars after its
    window; so of earlier sessions all that have one may be looked at, and of its own those that end window + horizon bars before.
    """
    use = F.when(F.col("valid"), F.col("fwd_ret"))
    frame = W.partitionBy("symbol", "session").orderBy("end_idx").rangeBetween(W.unboundedPreceding, -(window + horizon))
    earlier = W.partitionBy("symbol").orderBy("session").rowsBetween(W.unboundedPreceding, -1)
    sums = all_windows.groupBy("symbol", "session").agg(F.count(use).alias("_n"), F.coalesce(F.sum(use), F.lit(0.0)).alias("_s"))
    before = sums.select("symbol", "session", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s0"))
    own = all_windows.select("symbol", "session", F.col("end_idx").alias("q_end"), F.count(use).over(frame).alias("_n"), F.coalesce(F.sum(use).over(frame), F.lit(0.0)).alias("_s"))
    n, s = F.col("_n0") + F.col("_n"), F.col("_s0") + F.col("_s")
    return own.join(before, ["symbol", "session"]).select("symbol", "q_end", n.alias("n_candidates"), F.when(n > 0, s / n).alias("uncond_mean"))


def unconditional_of_few(all_windows: DataFrame, queries: DataFrame, window: int, horizon: int) -> DataFrame:
    """unconditional() of at most FEW queries (symbol, q_end), as the caller has counted, from (symbol, end_idx, valid, fwd_ret): added up before the shuffle."""
    few = F.broadcast(queries.select("symbol", "q_end"))
    met = all_windows.select("symbol", "end_idx", "valid", "fwd_ret").join(few, "symbol").where(eligible(window, horizon))
    return met.groupBy("symbol", "q_end").agg(F.count(F.lit(1)).alias("n_candidates"), F.avg("fwd_ret").alias("uncond_mean"))
