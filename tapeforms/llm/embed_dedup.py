"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

Each vector is scaled to length 1 and turned by random rotations. The signs after the first rotations, at least CODE_BITS of
them, are its code; next to it are stored the correction factors (the inner product of the vector and its code, per
rotation) and a 4-bit rounding of the turned vector. The code of one vector over its factor, times the rounding of another, is an
unbiased estimate of their inner product, and the factor gives its standard error. A pair whose estimate is more than
SIGMAS errors below the threshold is dismissed; all others are undecided.

Codes are made once and written; only they are shuffled to be compared. Vectors that take part in an undecided pair of a block are
fetched by their number, and that pair is recomputed from them in double precision, so no pair below the threshold
is ever linked.

Pairs come from banding the signs of further rotations, per label and length. Bits and bands follow from the number of
vectors of a label, by the least expected work: with up to some ten thousand, no bit, so that all pairs of a label are estimated, block
against block; with more, bands of so many bits that a pair at the threshold shares none with probability MISS. A pair is
taken in the first band that it shares. Buckets that are large are dealt into chunks, of which each pair is a task's
block; a task gives link counts and a spanning forest, never pairs. Equal vectors of a label are one node and are counted, not
compared.

Edge cases: null vectors and labels, empty and zero vectors, and vectors with null or non-finite components link with
nothing but keep their row, with themselves as component; vectors of different lengths do not link; repeated ids keep
their rows and count each other if their vectors link; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeforms.llm import shared

COSINE = 0.93
#: Probability with which the bands lose a pair at the threshold.
MISS = 1.5e-7
#: Bits of a band, at most.
MOST_BITS = 30
#: What a copy of a code costs to shuffle and lay out, in comparisons.
COPY = 500
#: Bits of a code, at least: as many rotations as it takes.
CODE_BITS = 128
#: Half-width of the confidence interval, in standard errors of the estimate.
SIGMAS = 5.5
#: Codes of a bucket that one task takes; larger buckets are dealt into chunks of about this size.
BLOCK = 2048
LEVELS = 15  # 4 bits


#: Bytes of rotations that a worker keeps, so that they aren't made again for each slice of vectors.
KEPT_BYTES = 64 << 20
_kept: dict[tuple[int, int, int], np.ndarray] = {}


def rotations(dim: int, count: int, seed: int = 11) -> np.ndarray:
    """(count * dim, dim): random orthogonal matrices, one above the other; the same wherever they are made."""
    key = (dim, count, seed)
    if key in _kept:
        return _kept[key]
    random = np.random.default_rng([seed, dim])
    made = []
    for _ in range(count):
        q, r = np.linalg.qr(random.standard_normal((dim, dim)))
        made.append((q * np.sign(np.diag(r))).T)
    out = np.concatenate(made)
    if out.nbytes + sum(x.nbytes for x in _kept.values()) > KEPT_BYTES:
        _kept.clear()
    if out.nbytes <= KEPT_BYTES:
        _kept[key] = out
    return out


def bands_for(bits: int, cosine: float, miss: float) -> int:
    """How many bands of so many signs a pair at the threshold shares none of with probability `miss`."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if bits == 0 else math.ceil(math.log(miss) / math.log1p(-same))


def plan(n: Column, cosine: float, miss: float) -> Column:
    """struct(work, bits, bands) of least work per vector, among n vectors of a label: comparisons and copies."""
    choices = []
    for bits in range(MOST_BITS + 1):
        bands = bands_for(bits, cosine, miss)
        choices.append(F.struct((bands * (n / float(1 << bits) + COPY)).alias("work"), F.lit(bits).alias("bits"), F.lit(bands).alias("bands")))
    return F.array_min(F.array(*choices))


def turns(dim: int) -> int:
    """Rotations that make a code of a vector of that length."""
    return -(-CODE_BITS // dim)


def unit_rows(lists: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Codes, factors and roundings of unit vectors, and the estimates that they give."""

    def __init__(self, dim: int, signs: np.ndarray, factors: np.ndarray, levels: np.ndarray, low: np.ndarray, step: np.ndarray):
        self.dim, self.turns = dim, turns(dim)
        self.signs, self.factors, self.levels, self.low, self.step = signs, factors, levels, low, step

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        n, dim = x.shape
        turned = x @ rotations(dim, turns(dim)).T
        by_turn = np.abs(turned).reshape(n, -1, dim)
        first = turned[:, :dim]
        low = first.min(axis=1)
        step = np.maximum((first.max(axis=1) - low) / LEVELS, 1e-12)
        levels = np.rint((first - low[:, None]) / step[:, None]).astype(np.uint8)
        return cls(dim, turned > 0, by_turn.sum(axis=2) / math.sqrt(dim), levels, low, step)

    def stored(self) -> list[bytes]:
        """A record per vector: signs, levels of 4 bits, then factors, least value and step as 4-byte floats."""
        nibbles = np.pad(self.levels, ((0, 0), (0, self.dim % 2)))
        parts = [np.packbits(self.signs, axis=1), nibbles[:, ::2] << 4 | nibbles[:, 1::2], np.column_stack([self.factors, self.low, self.step]).astype("<f4").view(np.uint8)]
        return [r.tobytes() for r in np.concatenate(parts, axis=1)]

    @classmethod
    def read(cls, dim: int, records: list[bytes]) -> Codes:
        t = turns(dim)
        raw = np.frombuffer(b"".join(records), dtype=np.uint8).reshape(len(records), -1)
        a, b = -(-t * dim // 8), -(-dim // 2)
        signs = np.unpackbits(raw[:, :a], axis=1, count=t * dim).astype(bool)
        nibbles = raw[:, a : a + b]
        levels = np.stack([nibbles >> 4, nibbles & 15], axis=2).reshape(len(records), -1)[:, :dim]
        numbers = np.ascontiguousarray(raw[:, a + b :]).view("<f4").astype(np.float64)
        return cls(dim, signs, numbers[:, :t], levels, numbers[:, t], numbers[:, t + 1])

    def take(self, rows: np.ndarray | slice) -> Codes:
        return Codes(self.dim, self.signs[rows], self.factors[rows], self.levels[rows], self.low[rows], self.step[rows])

    def estimates(self, other: Codes) -> np.ndarray:
        """Inner products of each of these vectors (by its code) with each of the others (by its rounding)."""
        f = np.maximum(self.factors, 1e-9)
        weighed = np.where(self.signs, 1.0, -1.0).reshape(len(f), self.turns, self.dim) / (f * (self.turns * math.sqrt(self.dim)))[:, :, None]
        back = rotations(self.dim, self.turns)
        direction = weighed.reshape(len(f), -1) @ back
        rounded = (other.levels * other.step[:, None] + other.low[:, None]) @ back[: self.dim]
        return direction.astype(np.float32) @ rounded.astype(np.float32).T

    def errors(self, other: Codes, cosine: float) -> np.ndarray:
        """Standard errors of the estimates of pairs whose inner product is `cosine` or more."""
        f = np.maximum(self.factors, 1e-9)
        of_code = (1 - cosine * cosine) * np.maximum(0, 1 / f**2 - 1).sum(axis=1) / self.turns**2 / max(1, self.dim - 1)
        of_rounding = (1 / f**2).mean(axis=1)[:, None] * (other.step**2 / 12)[None, :]
        return np.sqrt(of_code[:, None] + of_rounding).astype(np.float32)

    def undecided(self, other: Codes, cosine: float, sigmas: float) -> np.ndarray:
        """Whether the upper confidence bound of each pair reaches the threshold."""
        return self.estimates(other) + np.float32(sigmas) * self.errors(other, cosine) >= cosine


def units(table: pa.Table, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Each block's rows, as the two sides that meet, and whether they are one and the same."""
    bounds = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
    a, b, chunk = (table.column(c).to_numpy() for c in ("a", "b", "chunk"))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        rows = np.arange(lo, hi)
        if a[lo] == b[lo]:
            yield rows, rows, True
        else:
            first = chunk[lo:hi] == a[lo]
            yield rows[first], rows[~first], False


def open_pairs(left: Codes, right: Codes, same: bool, keys: tuple[np.ndarray, np.ndarray], band: int, cosine: float, sigmas: float) -> np.ndarray:
    """The undecided pairs of two sides whose first shared band is this one."""
    found = left.undecided(right, cosine, sigmas)
    if same:
        found = np.triu(found, 1)
    if band:
        for at in range(0, len(found), 128):
            i, j = np.nonzero(found[at : at + 128])
            found[at + i, j] = (keys[0][at + i, :band] != keys[1][j, :band]).all(axis=1)
    return found


def spanned(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of a graph between rows and columns (numbered after the rows)."""
    rows, columns = linked.shape
    free = [linked.any(axis=1), linked.any(axis=0)]
    edges = []
    while free[0].any():
        front, side = np.array([int(free[0].argmax())]), 0
        free[0][front] = False
        while len(front):  # breadth first; each row and column is met once
            near = (linked[front] if side == 0 else linked[:, front].T)[:, free[1 - side]]
            new = np.flatnonzero(free[1 - side])
            hit = near.any(axis=0)
            parents, new = front[near[:, hit].argmax(axis=0)], new[hit]
            edges.extend(zip((parents + side * rows).tolist(), (new + (1 - side) * rows).tolist(), strict=True))
            free[1 - side][new] = False
            front, side = new, 1 - side
    return edges


def links(vectors: DataFrame, cosine: float, miss: float, sigmas: float, block: int) -> DataFrame:
    """From (node, label, v, n), a row per distinct vector that stands for n: rows (u, v, w) with v null, where w more
    vectors link with u, and rows with w null, edges that span the components."""
    sized = vectors.withColumn("dim", F.size("v"))
    choice = plan(F.count(F.lit(1)), cosine, miss)
    plans = shared.cut(sized.groupBy("label", "dim").agg(choice.alias("p")).select("label", "dim", "p.bits", "p.bands"))
    planned = shared.sized_join(sized.select("node", "label", "dim", "v", "n"), plans, ["label", "dim"], "inner")
    label = vectors.schema["label"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                shapes = np.column_stack([part.column(c).to_numpy() for c in ("dim", "bits", "bands")])
                for dim, bits, bands in np.unique(shapes, axis=0).tolist():
                    rows = np.flatnonzero((shapes == (dim, bits, bands)).all(axis=1))
                    taken = part.take(pa.array(rows))
                    x = unit_rows(taken.column("v"), dim)
                    skip = turns(dim) * dim
                    signs = x @ rotations(dim, turns(dim) + -(-bands * bits // dim))[skip : skip + bands * bits].T > 0
                    keys = (signs.reshape(len(rows), bands, bits) @ (1 << np.arange(bits))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in ("node", "label", "dim", "n")), pa.array(Codes.of(x).stored(), pa.binary()), lists], names=["node", "label", "dim", "n", "code", "keys"])

    coded = shared.cut(planned.mapInArrow(encode, f"node long, label {label}, dim int, n long, code binary, keys array<int>"))
    unit = ["label", "dim", "band", "key"]
    entries = coded.select("label", "dim", "node", "code", "keys", F.posexplode("keys").alias("band", "key"))
    dealt = shared.by_block(shared.blocks(entries, unit, "node", block), unit)
    place = [*unit, "a", "b"]

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ids in shared.runs(batches, place, rows=8000):
            dims, bands = table.column("dim").to_numpy(), table.column("band").to_numpy()
            hits = []
            for left, right, same in units(table, ids):
                if not len(left) or not len(right):
                    continue
                codes, keys = [], []
                for side in (left, right):
                    part = table.slice(int(side[0]), int(side[-1] - side[0]) + 1)
                    codes.append(Codes.read(int(dims[left[0]]), part.column("code").to_pylist()))
                    keys.append(np.asarray(part.column("keys").combine_chunks().flatten()).reshape(len(side), -1))
                found = open_pairs(*codes, same, tuple(keys), int(bands[left[0]]), cosine, sigmas)
                hits += [left[found.any(axis=1)], right[found.any(axis=0)]]
            rows = np.unique(np.concatenate(hits)) if hits else np.empty(0, np.int64)
            if len(rows):
                yield from table.select([*place, "chunk", "node"]).take(pa.array(rows)).to_batches()

    kinds = f"label {label}, dim int, band int, key int, a int, b int, chunk int, node long"
    wanted = dealt.select(*place, "chunk", "node", "code", "keys").mapInArrow(estimate, kinds)
    # Only the ends of undecided pairs come back, with their vectors.
    fetched = wanted.join(vectors.select("node", "v", "n"), "node").join(coded.select("node", "code", "keys"), "node")
    laid = fetched.repartition(shared.partitions(vectors.sparkSession), *place).sortWithinPartitions(*place, "chunk")

    def recompute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ids in shared.runs(batches, place, rows=2000):
            dims, bands, n, nodes = (table.column(c).to_numpy() for c in ("dim", "band", "n", "node"))
            weight = np.zeros(len(n), dtype=np.int64)
            edges = []
            for left, right, same in units(table, ids):
                if not len(left) or not len(right):
                    continue
                x, codes, keys = [], [], []
                for side in (left, right):
                    part = table.slice(int(side[0]), int(side[-1] - side[0]) + 1)
                    x.append(unit_rows(part.column("v").combine_chunks(), int(dims[left[0]])))
                    codes.append(Codes.read(int(dims[left[0]]), part.column("code").to_pylist()))
                    keys.append(np.asarray(part.column("keys").combine_chunks().flatten()).reshape(len(side), -1))
                linked = open_pairs(*codes, same, tuple(keys), int(bands[left[0]]), cosine, sigmas)
                for at in range(0, len(left), 512):
                    linked[at : at + 512] &= x[0][at : at + 512] @ x[1].T >= cosine
                weight[left] += linked @ n[right]
                weight[right] += n[left] @ linked
                both = np.concatenate([nodes[left], nodes[right]])
                graph = linked | linked.T if same else linked
                edges += [(int(both[i]), int(both[j])) for i, j in spanned(graph)]
            some = np.flatnonzero(weight)
            if len(some):
                ends = np.array(edges)
                u = np.concatenate([nodes[some], ends[:, 0]])
                v = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ends[:, 1])])
                w = pa.concat_arrays([pa.array(weight[some]), pa.nulls(len(ends), pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(u), v, w], names=["u", "v", "w"])

    return laid.select(*place, "chunk", "node", "v", "n", "code", "keys").mapInArrow(recompute, "u long, v long, w long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, miss: float = MISS, sigmas: float = SIGMAS, block: int = BLOCK) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of vectors."""
    v = F.col("v")
    sound = F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).withColumn("ok", F.coalesce(sound, F.lit(False)))
    # Adding 0 makes -0.0 and 0.0 one value.
    plain = F.array_join(F.transform(v, lambda x: (x.cast("double") + F.lit(0.0)).cast("string")), ",")
    rows = rows.withColumn("name", F.when(F.col("ok"), F.unhex(F.md5(F.concat_ws("|", F.col("label").cast("string"), plain)))))
    nodes = rows.where("ok").groupBy("name").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    nodes = shared.cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = shared.cut(links(nodes.select("node", "label", "v", "n"), cosine, miss, sigmas, block))
    weights = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("w"))
    groups = shared.components(found.where("v is not null").select("u", "v"))
    placed = shared.cut(nodes.select("name", "node", "n", "least").join(weights, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    heads = shared.cut(shared.least_of(placed, "component", "least", "component_id").select("name", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), "component_id"))
    out = shared.sized_join(rows.select("id", "name"), heads, ["name"], "left")
    of = F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), of.alias("component_id"), F.coalesce(F.col("id") == of, F.lit(False)).alias("kept"))
