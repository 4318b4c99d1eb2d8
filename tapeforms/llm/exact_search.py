"""Exact top-k search by inner product, with a KD-tree for each shard of the vectors.

Components become floor(scale * x), so scores are integers and the same whatever the order of summation. A few splits of a bounded sample
(SAMPLE vectors) divide the space into cells, only to bring like vectors together: every vector is placed and every result is exact.
Cells are dealt into shards of about SHARD rows. Each shard becomes a KD-tree: nodes are split at the median of their widest
dimension, down to LEAF rows, and each has a tight bounding box and its least id.

The score of a query with anything in a box is at most the sum, over the dimensions, of the larger product with its two sides. A
query goes through a tree best bound first and stops when no bound can beat the k-th score that it holds; where bound and score are
equal, the least id decides, so large groups of copies are passed over as well. Queries are packed by cell into blocks. A block first
visits one shard of its own cell, where its k-th scores will mostly be high, and takes them along to the others: those shards
go unvisited whose box can't beat the k-th score of any query of the block. In a task, a shard's tree is followed by the blocks
that visit it, one after another, so a task holds one tree and one block.

Exactness: while dim * max|a| * max|b| stays below 2^53, all products are exact in double precision. Beyond that, scores are computed by
unbounded integers without bounds, and held to the range of a long.

Edge cases: vectors that are null or hold null or non-finite components take no part, and neither do rows without an id, which could not
be named; vectors of different lengths have no score; of rows that repeat an id, all are candidates and all are queries, but
none is a candidate for its own id; a query without candidates gives no row; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeforms.llm import shared

K = 20
SCALE = 64
#: Vectors that the cells are drawn from, at most, and cells, at most.
SAMPLE, CELLS = 4096, 64
#: Vectors of a shard and queries of a block, about, and vectors of a leaf, at most.
SHARD, BLOCK, LEAF = 8192, 512, 256
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: Relative error that a bound of boxes allows for.
ROUNDING = 1e-12
CELL = ["dim", "cell"]


def median_split(values: np.ndarray) -> float:
    """The median, or the least value above the minimum where they are equal, so that neither side is empty."""
    values = np.sort(values)
    middle = values[len(values) // 2]
    return float(middle if middle > values[0] else values[np.searchsorted(values, values[0], side="right")])


class Cells:
    """Median splits of a sample, as a full binary tree in heap order; values from the threshold on go right."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.feature, self.threshold = np.zeros((1 << depth) - 1, dtype=np.int64), np.full((1 << depth) - 1, np.inf)
        rows = {0: sample}
        for node in range(len(self.feature)):
            x = rows.pop(node)
            spread = np.ptp(x, axis=0) if len(x) else np.zeros(1)
            if spread.max(initial=0) > 0:
                self.feature[node] = spread.argmax()
                self.threshold[node] = median_split(x[:, self.feature[node]])
            right = x[:, self.feature[node]] >= self.threshold[node]
            rows[2 * node + 1], rows[2 * node + 2] = x[~right], x[right]

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] >= self.threshold[node])
        return node - len(self.feature)


class Tree:
    """A KD-tree: points in the order of the leaves, and for each node its box, least id, children (-1 in leaves) and rows."""

    FIELDS = {"ids": "<i8", "points": "<f8", "low": "<f8", "high": "<f8", "least": "<i8", "nodes": "<i8"}

    def __init__(self, dim: int, ids: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, nodes: np.ndarray):
        self.dim, self.ids, self.least = dim, ids, least
        self.points, self.low, self.high = (x.reshape(-1, dim) if dim else np.zeros((n, 0)) for x, n in ((points, len(ids)), (low, len(least)), (high, len(least))))
        self.nodes = nodes.reshape(-1, 4)  # left, right, first row, end
        self.most = float(np.abs(self.points).max(initial=0))

    @classmethod
    def built(cls, ids: np.ndarray, points: np.ndarray) -> Tree:
        low, high, least, nodes, order = [], [], [], [], []
        placed = 0

        def grow(rows: np.ndarray) -> int:
            nonlocal placed
            n, x = len(nodes), points[rows]
            low.append(x.min(axis=0))
            high.append(x.max(axis=0))
            least.append(ids[rows].min())
            nodes.append([-1, -1, placed, placed])
            if len(rows) <= LEAF:
                order.append(rows)
                placed += len(rows)
            else:
                widest = x[:, (high[n] - low[n]).argmax()] if x.shape[1] else np.zeros(len(x))
                rows = rows[np.lexsort((ids[rows], widest))]
                nodes[n][0] = grow(rows[: len(rows) // 2])
                nodes[n][1] = grow(rows[len(rows) // 2 :])
            nodes[n][3] = placed
            return n

        grow(np.arange(len(ids)))
        at = np.concatenate(order)
        return cls(points.shape[1], ids[at], points[at], np.array(low), np.array(high), np.array(least), np.array(nodes))

    def stored(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(getattr(self, k), dtype=v).tobytes() for k, v in self.FIELDS.items()}

    @classmethod
    def read(cls, dim: int, columns: dict[str, bytes]) -> Tree:
        return cls(dim, *(np.frombuffer(columns[k], dtype=v) for k, v in cls.FIELDS.items()))

    def scores(self, rows: slice, q: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return (self.points[rows] @ q).astype(np.int64)
        weights = [int(v) for v in q]
        return np.array([max(-LONG - 1, min(LONG, sum(int(a) * b for a, b in zip(p, weights, strict=True)))) for p in self.points[rows]], dtype=np.int64)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, worst: np.ndarray | None = None, worst_id: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, scores) of at most k rows that are better than its worst so far (score and id; none: least long), best first."""
        exact = self.dim * self.most * float(np.abs(queries).max(initial=0)) < EXACT
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T if exact else np.full((len(queries), len(self.nodes)), np.inf)
        least, nodes = self.least.tolist(), self.nodes.tolist()
        for i, q in enumerate(queries):
            bound = bounds[i].tolist()
            floor, floor_id = (-LONG - 1, LONG) if worst is None else (int(worst[i]), int(worst_id[i]))
            ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
            heap = [(-bound[0], least[0], 0)]
            while heap:
                negative, first, n = heapq.heappop(heap)
                if -negative < floor or (-negative == floor and first > floor_id):
                    break
                left, right, start, end = nodes[n]
                if left >= 0:
                    for child in (left, right):
                        heapq.heappush(heap, (-bound[child], least[child], child))
                    continue
                s, at = self.scores(slice(start, end), q, exact), self.ids[start:end]
                better = ((s > floor) | ((s == floor) & (at <= floor_id))) & (at != own[i])
                if not better.any():
                    continue
                ids, scores = np.concatenate((ids, at[better])), np.concatenate((scores, s[better]))
                if len(ids) >= k:
                    order = np.lexsort((ids, ~scores))[:k]
                    ids, scores = ids[order], scores[order]
                    floor, floor_id = int(scores[-1]), int(ids[-1])
            order = np.lexsort((ids, ~scores))
            yield ids[order], scores[order]


def usable(id_col: str, vector: str) -> Column:
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def matrices(batch: pa.RecordBatch, column: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch by the length of their vectors: their places, and their vectors as whole numbers."""
    lists = batch.column(column)
    sizes = np.asarray(lists.value_lengths())
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, np.floor(scale * np.asarray(lists.take(pa.array(rows)).flatten(), dtype=np.float64)).reshape(len(rows), dim)


def drawn_cells(vectors: DataFrame, scale: int, shard: int) -> dict[int, Cells]:
    """The cells of each length of vectors, from the SAMPLE rows of the least hashes; about as many as there will be shards, at most CELLS."""
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().combine_chunks()
    out = {}
    for batch in sample.to_batches():
        for rows, x in matrices(batch, 0, scale):
            shards = min(CELLS, n * len(rows) / max(1, sample.num_rows) / shard)
            out[x.shape[1]] = Cells(x, int(np.ceil(np.log2(shards))) if shards > 1 and x.shape[1] else 0)
    return out


def placed(vectors: DataFrame, cells: dict[int, Cells], scale: int) -> DataFrame:
    """(id, query, dim, cell, v) of vectors (id, query, v), with v as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                for rows, x in matrices(batch, 2, scale):
                    cell = cells[x.shape[1]].of(x) if x.shape[1] in cells else np.zeros(len(x), dtype=np.int64)
                    taken = batch.take(pa.array(rows))
                    bytes_ = pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary())
                    yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array(cell, pa.int32()), bytes_], names=["id", "query", "dim", "cell", "v"])

    return vectors.mapInArrow(run, "id long, query boolean, dim int, cell int, v binary")


def _points(table: pa.Table, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("v").to_pylist()), dtype="<f8").reshape(table.num_rows, dim)


TREE = ", ".join(f"{k} binary" for k in Tree.FIELDS)


def shards(rows: DataFrame) -> DataFrame:
    """A row per shard (dim, cell, part) with its tree and box."""

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        tree = Tree.built(table.column("id").to_numpy(), _points(table, dim))
        box = [pa.array([x[0].tolist()], pa.list_(pa.float64())) for x in (tree.low, tree.high)]
        return pa.table([*(table.column(c).slice(0, 1) for c in ("dim", "cell", "part")), *box, *(pa.array([b], pa.binary()) for b in tree.stored().values())], names=["dim", "cell", "part", "box_low", "box_high", *Tree.FIELDS])

    return rows.groupBy("dim", "cell", "part").applyInArrow(build, f"dim int, cell int, part int, box_low array<double>, box_high array<double>, {TREE}")


def blocks(rows: DataFrame) -> DataFrame:
    """A row per block (dim, cell, block) of queries: their ids and vectors as bytes."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        parts = [table.column("id").to_numpy().astype("<i8").tobytes(), b"".join(table.column("v").to_pylist())]
        return pa.table([*(table.column(c).slice(0, 1) for c in ("dim", "cell", "block")), *(pa.array([p], pa.binary()) for p in parts)], names=["dim", "cell", "block", "own", "vectors"])

    return rows.groupBy("dim", "cell", "block").applyInArrow(pack, "dim int, cell int, block int, own binary, vectors binary")


VISIT = "dim int, cell int, block int, own binary, vectors binary, worst binary, worst_id binary"
HITS = "dim int, cell int, block int, number int, query_id long, vec_id long, score long"
PLACE = ["s_dim", "s_cell", "s_part"]


def _visited(trees: DataFrame, visits: DataFrame, k: int, first: bool) -> DataFrame:
    """Each visit (a block with the shard it goes to, PLACE) searched in its shard.

    first: gives the block back, with the k-th score and id of each of its queries, its box, and its hits; else gives the hits.
    """
    names = [c.split()[0] for c in VISIT.split(", ")]
    tree_rows = trees.select(F.col("dim").alias("s_dim"), F.col("cell").alias("s_cell"), F.col("part").alias("s_part"), *Tree.FIELDS)
    laid = tree_rows.unionByName(visits, allowMissingColumns=True).withColumn("_visit", F.col("own").isNotNull())
    laid = laid.repartition(*PLACE).sortWithinPartitions(*PLACE, "_visit", "cell", "block")
    schema = f"{VISIT}, low array<double>, high array<double>, least long, hits array<struct<number: int, query_id: long, vec_id: long, score: long>>" if first else HITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if not row["_visit"]:
                    tree = Tree.read(row["s_dim"], row)
                    continue
                own = np.frombuffer(row["own"], dtype="<i8")
                queries = np.frombuffer(row["vectors"], dtype="<f8").reshape(len(own), row["dim"])
                known = (None, None) if first else (np.frombuffer(row["worst"], dtype="<i8"), np.frombuffer(row["worst_id"], dtype="<i8"))
                found = list(tree.search(queries, own, k, *known))
                n = [len(ids) for ids, _ in found]
                number = np.repeat(np.arange(len(own), dtype=np.int32), n)
                ids, scores = (np.concatenate([x[s] for x in found]) for s in (0, 1))
                if not first:
                    head = [np.full(len(ids), row[c], dtype=np.int32) for c in ("dim", "cell", "block")]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*head, number, own[number], ids, scores)], names=[c.split()[0] for c in HITS.split(", ")])
                    continue
                full = [len(x) == k for x, _ in found]
                worst = np.array([s[-1] if f else -LONG - 1 for (_, s), f in zip(found, full, strict=True)], dtype="<i8")
                worst_id = np.array([x[-1] if f else LONG for (x, _), f in zip(found, full, strict=True)], dtype="<i8")
                values = {**{c: row[c] for c in names[:5]}, "worst": worst.tobytes(), "worst_id": worst_id.tobytes(), "low": queries.min(axis=0).tolist(), "high": queries.max(axis=0).tolist(), "least": int(worst.min())}
                values["hits"] = [{"number": a, "query_id": b, "vec_id": c, "score": d} for a, b, c, d in zip(number.tolist(), own[number].tolist(), ids.tolist(), scores.tolist(), strict=True)]
                yield pa.RecordBatch.from_pylist([values], schema=_first_schema())

    return laid.mapInArrow(run, schema)


def _first_schema() -> pa.Schema:
    item = pa.struct([("number", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    return pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("own", "vectors", "worst", "worst_id")), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("least", pa.int64()), ("hits", pa.list_(item))])


def box_bound() -> Column:
    """The most that the score of anything in the box (low, high) with anything in (box_low, box_high) can be, and some more than rounding takes; without limit where there is no dimension."""

    def best(i: Column) -> Column:
        corners = [F.get(F.col(a), i) * F.get(F.col(b), i) for a in ("low", "high") for b in ("box_low", "box_high")]
        return F.greatest(*corners) + ROUNDING * F.greatest(*map(F.abs, corners))

    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.col("dim")), F.lit(0.0), lambda s, i: s + best(i - 1)), F.lit(float("inf")))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, the k other rows of the highest scores, ties by id."""
    spark = vectors.sparkSession
    taking = vectors.where(usable(id_col, vector)).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vector).alias("v"))
    rows = shared.cut(placed(taking, drawn_cells(taking, scale, shard), scale).withColumn("_n", F.monotonically_increasing_id()))
    counts = rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_c"), F.count_if("query").alias("_q"))
    parts = shared.cut(counts.select(*CELL, F.ceil(F.col("_c") / shard).cast("int").alias("parts"), F.greatest(F.lit(1), F.ceil(F.col("_q") / block)).cast("int").alias("blocks")))
    dealt = shared.sized_join(rows, parts, CELL, "inner")
    turn = F.xxhash64("_n")
    trees = shared.cut(shards(dealt.select("id", "v", *CELL, F.pmod(turn, "parts").cast("int").alias("part"))))
    packed = blocks(dealt.where("query").select("id", "v", *CELL, F.pmod(turn, "blocks").cast("int").alias("block")))
    home = shared.sized_join(packed, parts.select(*CELL, "parts"), CELL, "inner").select("*", F.col("dim").alias("s_dim"), F.col("cell").alias("s_cell"), F.pmod("block", "parts").cast("int").alias("s_part")).drop("parts")
    begun = shared.cut(shared.sized_join(_visited(trees, home, k, first=True), parts.select(*CELL, "parts"), CELL, "inner").withColumn("at_home", F.pmod("block", "parts").cast("int")).drop("parts"))

    # Boxes only: every block against every shard, dealt into slices. A block's own vectors move where they are wanted.
    slices = shared.partitions(spark)
    boxes = trees.select("dim", F.col("cell").alias("s_cell"), F.col("part").alias("s_part"), "box_low", "box_high").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    light = begun.select("dim", "cell", "block", "at_home", "low", "high", "least", F.pmod(F.xxhash64("cell", "block"), F.lit(slices)).cast("int").alias("slice"))
    away = (F.col("s_cell") != F.col("cell")) | (F.col("s_part") != F.col("at_home"))
    met = light.join(boxes, ["dim", "slice"]).where(away & (box_bound() >= F.col("least"))).select("dim", "cell", "block", "s_cell", "s_part")
    visits = begun.select(*(c.split()[0] for c in VISIT.split(", "))).join(met, ["dim", "cell", "block"]).withColumn("s_dim", F.col("dim"))
    hits = begun.select("dim", "cell", "block", F.inline("hits")).unionByName(_visited(trees, visits, k, first=False))
    order = W.partitionBy("dim", "cell", "block", "number").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
