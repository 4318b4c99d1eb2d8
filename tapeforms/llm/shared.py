"""Steps that several operators share: durable checkpoints, sized joins, bounded blocks, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeforms.sources.folders import cut, shared_dir  # noqa: F401

#: A side of at most this many bytes, measured, may be broadcast.
BROADCAST_BYTES = 32 << 20
#: White space between words, as a Java regular expression and as the characters themselves.
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame) -> DataFrame:
    """df as one column, _row, so that no name that an operator adds can meet one of df; select("_row.*") undoes it."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))


def width(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        own = F.octet_length(column) + 16
    elif isinstance(kind, T.ArrayType):
        inner = kind.elementType
        fixed = not isinstance(inner, T.StringType | T.BinaryType | T.ArrayType | T.MapType | T.StructType)
        own = 16 + (F.size(column) * 8 if fixed else F.aggregate(column, F.lit(0), lambda s, x: s + width(x, inner)))
    elif isinstance(kind, T.StructType):
        own = sum((width(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    else:
        own = F.lit(8)
    return F.coalesce(own.cast("int"), F.lit(8))


def sized_join(left: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """left joined to small (already cut): broadcast when the bytes of small's rows, added up, are within BROADCAST_BYTES, else by shuffle, where AQE splits hot keys."""
    row = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in small.schema.fields), F.lit(16))
    if (small.agg(F.sum(row.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES:
        return left.join(F.broadcast(small), on, how)
    return left.join(small.hint("merge"), on, how)


#: Bytes of text that are cut into words at once.
TEXT_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, size: int = TEXT_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch with about `size` bytes of text each (or one text), and the texts, null as empty."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, stop - at), texts.slice(at, stop - at)
        at = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings without nulls, one text after another, and where each begins (one more entry for the end)."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def words(texts: pa.Array, bare: bool = False, lower: bool = False, marks: bytes = b"") -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Texts cut before each run of spaces and line feeds that follows no other white space of ASCII: the place of every word in the array of distinct words, that array, and the word at which each text begins (one more entry for the end).

    bare: without the spaces. lower: letters A-Z made small. marks: signs that, at the end of a word and after a letter a-z, are words of their own.
    """
    data, ends = text_bytes(texts)
    if lower:
        data = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    space = (data == 32) | (data == 10)
    begins = np.zeros(len(data) + 1, dtype=bool)
    white = space if bare else space | (data - np.uint8(9) < 5) | (data - np.uint8(28) < 4)
    begins[1:-1] = space[1:] & ~white[:-1]
    begins[ends] = True
    if marks and len(data) > 1:
        last = np.append(space[1:] | begins[1:-1], True)
        small = (data[:-1] | 32) - 97 < 26
        begins[1:-1] |= small & last[1:] & np.isin(data[1:], np.frombuffer(marks, dtype=np.uint8))
    begins[-1] = False
    at = np.flatnonzero(begins)
    offsets = np.append(at, len(data))
    if bare:
        kept = np.concatenate(([0], np.cumsum(~space)))
        data, offsets = data[~space], kept[offsets]
    cut_ = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    coded = cut_.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary, np.searchsorted(at, ends)


class WordIds:
    """A table from words to runs of unsigned 32-bit ids, in flat arrays. It holds at most `limit` bytes, beyond which it begins anew: it spares repeated work only.

    A word is known by its 128-bit hash.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 32 << 20):
        self.encode, self.limit = encode, limit
        self.forget()

    def forget(self) -> None:
        self.high, self.low = np.empty(0, np.uint64), np.empty(0, np.uint64)  # sorted by high
        self.start, self.size, self.flat = np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.uint32)

    def _place(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Where each word is in the table, or -1."""
        if not len(self.high):
            return np.full(len(high), -1)
        at = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        return np.where((self.high[at] == high) & (self.low[at] == low), at, -1)

    def _add(self, words: pa.Array, high: np.ndarray, low: np.ndarray) -> None:
        ids = self.encode(words.to_pylist())
        size = np.fromiter(map(len, ids), dtype=np.uint32, count=len(ids)) // 4
        start = np.cumsum(size, dtype=np.uint32) - size + np.uint32(len(self.flat))
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), dtype="<u4")))
        joined = np.concatenate((self.high, high))
        order = np.argsort(joined, kind="stable")
        self.high = joined[order]
        self.low, self.start, self.size = (np.concatenate(x)[order] for x in ((self.low, low), (self.start, start), (self.size, size)))

    def of(self, texts: pa.Array, **how) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of the texts, one after another, and where each text's begin (one more entry for the end)."""
        place, distinct, first = words(texts, **how)
        data, ends = text_bytes(distinct)
        data, ends = memoryview(data), ends.tolist()
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]), dtype=np.uint64)
        high, low = digests[::2], digests[1::2]
        at = self._place(high, low)
        if (at < 0).any():
            if 24 * len(self.high) + 4 * len(self.flat) > self.limit:
                self.forget()
                at = self._place(high, low)
            new = np.flatnonzero(at < 0)
            self._add(distinct.take(pa.array(new)), high[new], low[new])
            at = self._place(high, low)
        starts, sizes = self.start[at].astype(np.int64), self.size[at].astype(np.int64)
        n = sizes[place]
        begins = np.concatenate(([0], np.cumsum(n)))
        return self.flat[np.repeat(starts[place] - begins[:-1], n) + np.arange(begins[-1])], begins[first]


def blocks(rows: DataFrame, keys: list[str], node: str, size: int, count: str | None = None) -> DataFrame:
    """Rows of buckets (equal keys), ready for tasks that compare a bucket's rows with one another, with columns chunk, a and b.

    A bucket of up to `size` rows is one block (a = b = 0). A larger one is dealt into chunks by a hash of `node`,
    and each pair of chunks a <= b is a block, so that no block holds more than about twice `size` rows however hot its
    key is. Buckets of one row are left out, since they have nothing to compare.
    count: a column that tells how many rows the bucket has, where that is known.
    """
    if count:
        counted = rows.withColumn("_n", F.col(count)).where("_n > 1")
    else:
        counted = rows.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), keys)
    chunks = F.ceil(F.col("_n") / size).cast("int")
    dealt = counted.withColumn("_k", chunks).withColumn("chunk", F.pmod(F.xxhash64(node), F.col("_k")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return dealt.withColumn("a", F.least("chunk", "_o")).withColumn("b", F.greatest("chunk", "_o")).drop("_n", "_k", "_o")


def by_block(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks laid out so that each is one run of rows within a partition."""
    order = [*keys, "a", "b"]
    return dealt.repartition(partitions(dealt.sparkSession), *order).sortWithinPartitions(*order, "chunk")


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs (rows with equal keys), of about `rows` rows or one run, each with the run number of every row."""
    held: list[pa.RecordBatch] = []
    n = 0

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            c = table.column(k).combine_chunks()
            values = c.to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        return np.cumsum(new)

    def drained(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, n
        table = pa.Table.from_batches(held)
        ids = numbered(table)
        end = table.num_rows if last else int(np.searchsorted(ids, ids[-1]))
        held = [] if last else table.slice(end).combine_chunks().to_batches()
        n = table.num_rows - end
        if end:
            yield table.slice(0, end).combine_chunks(), ids[:end]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from drained(False)
    if held:
        yield from drained(True)


def pairs(run: np.ndarray, side: np.ndarray | None = None, at_once: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of rows in the same run, some at a time. With side: in a run of two sides only pairs across them."""
    n = len(run)
    ends = np.searchsorted(run, run, side="right")
    both = None
    if side is not None:
        starts = np.searchsorted(run, run, side="left")
        both = side[starts] != side[ends - 1]
    left, right, held = [], [], 0
    at = np.arange(n)
    shift = 0
    while len(at):
        shift += 1
        at = at[at + shift < ends[at]]
        i, j = at, at + shift
        if both is not None:
            keep = ~both[i] | (side[i] != side[j])
            i, j = i[keep], j[keep]
        left.append(i)
        right.append(j)
        held += len(i)
        if held >= at_once:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


class Forest:
    """Union-find over the rows of one block; the edges that join two trees span what the block links."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        p, q = self.find(x), self.find(y)
        if p == q:
            return False
        self.up[max(p, q)] = min(p, q)
        self.edges.append((x, y))
        return True

    def join_all(self, xs: np.ndarray, ys: np.ndarray) -> None:
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            self.join(x, y)


def least_of(placed: DataFrame, component: str, value: str, name: str) -> DataFrame:
    """placed (cut) with `name`, the least `value` of its component. Only components of two rows and more meet anything."""
    many = cut(placed.groupBy(component).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("_m")).where("_m > 1").drop("_m"))
    return sized_join(placed, many, [component], "left").withColumn(name, F.coalesce(name, value))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of the edges (u, v); component is one of its nodes, the same for all of them.

    Local contraction: each node merges into the neighbour (or itself) with the least hash, edges are rewritten between
    what is left, and rounds go on, with other hashes, until no edge is left. Only a minimum is taken over the
    neighbours, so a hub with any number of links needs no memory. Every round is cut to the shared folder.
    """
    once = cut(edges.where("u <> v").select("u", "v"))
    live = cut(once.union(once.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels: DataFrame | None = None
    seed = 0
    while not live.isEmpty():
        seed += 1

        def ranked(c: str, seed: int = seed) -> Column:
            return F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("x"))

        merged = cut(live.groupBy("u").agg(F.least(F.min(ranked("v")), F.first(ranked("u")))["x"].alias("to")))
        left, right = merged.select("u", F.col("to").alias("p")), merged.select(F.col("u").alias("v"), F.col("to").alias("q"))
        live = cut(live.where("u < v").join(left, "u").join(right, "v").where("p <> q").select(F.col("p").alias("u"), F.col("q").alias("v")).transform(lambda d: d.union(d.select(F.col("v").alias("u"), F.col("u").alias("v")))).distinct())
        step = merged.select(F.col("u").alias("component"), F.col("to").alias("next"))
        if labels is None:
            labels = merged.select(F.col("u").alias("node"), F.col("to").alias("component"))
        else:
            labels = cut(sized_join(labels, step, ["component"], "left").select("node", F.coalesce("next", "component").alias("component")))
    if labels is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
