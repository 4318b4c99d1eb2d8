"""Fuzzy line dedup: MinHash over character shingles, exact Jaccard verification, one line kept per component.

A line is compared in a normal form (lower case, white space runs as one space). Equal lines are one node, found by hash.
The shingle signatures of longer lines are banded; lines that share a band are candidates. Band keys travel packed, a task's
keys of one partition as one value, and come out as rows only where two lines share one. A bucket's lines go to one
task (or, where it is large, in chunks to one task per pair of chunks), which compares the true shingle sets and leaves out
only pairs that are already connected, so every component is exact over the candidates while what leaves the task is a
spanning forest. Small buckets with the same least line go to the same task, which so meets most pairs once. Components come from distributed contraction. Each component keeps its first line, in the order of
document id, text hash and line number.

Fourteen bands of 4 rows find a pair of Jaccard similarity 0.8 with probability 0.9994, one of 0.85 with 0.99997.

Edge cases: a null text stays null and an empty one empty; blank lines stay, and so do lines of fewer than `min_chars`
characters in normal form, where a caller wants such a limit: the query and the pipeline set it to 0, so that every line
counts; a line of fewer than 7 characters has no other line with its shingles, and is compared by hash only; repeated rows (equal id and text) are one document and keep the
same lines; null ids come last in the order; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeforms.llm import shared
from tapeforms.llm.quality import let

SHINGLE = 7
SIMILARITY = 0.8
BANDS = 14
ROWS = 4
#: The limit of a call that gives none; 0 takes every line.
MIN_CHARS = 20
#: Lines of a bucket that one task takes; larger buckets are dealt into chunks of about this size.
BLOCK = 256
BITMAP = 4096
#: What a bound in floating point may be off by: a similarity of exactly the limit counts.
ROUNDING = 1e-9
#: Lines whose band keys a task remembers to have given, and shingles that it keeps as sets and as numbers; all only spare repeated work.
SEEN = 100_000
SETS = 100_000
CODES = 1_000_000
#: Pairs of band key and line that a task holds before it gives them out.
PAIRS = 1 << 19


def normal(line: str) -> str:
    if line.isprintable() and "  " not in line:  # so it has no white space but single spaces
        return line.strip(" ").lower()
    return " ".join(line.split()).lower()


def shingles(line: str, k: int = SHINGLE) -> set[str]:
    """The character shingles of a line in normal form; a shorter line is one shingle."""
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def in_both(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted arrays of distinct numbers share."""
    joined = np.concatenate((a, b))
    joined.sort(kind="stable")  # merges the two
    return int(np.count_nonzero(joined[1:] == joined[:-1]))


def alike(a: set[str] | np.ndarray, b: set[str] | np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - ROUNDING:
        return False
    both = len(a & b) if isinstance(a, set) else in_both(a, b)
    return both >= similarity * (len(a) + len(b) - both) - ROUNDING


def points(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Shingles:
    """The shingles of some lines of at least k characters. Two lines of few enough different letters are compared by numbers that spell
    the shingles out, each letter in an equal share of 64 bits (512 letters at k = 7); others by sets of strings. Both are exact."""

    def __init__(self, lines: dict[int, str], k: int):
        self.lines, self.k, self.bits = lines, k, 64 // k
        there = np.zeros(0x110000, dtype=bool)
        for part in portions(list(lines.values()), 1 << 16):
            there[points("".join(part))] = True
        letters = np.flatnonzero(there)[: min(1 << self.bits, 1 << 15)]
        self.number = np.full(0x110000, 1 << 15, dtype=np.uint16)
        self.number[letters] = np.arange(len(letters), dtype=np.uint16)
        self.codes: dict[int, np.ndarray | None] = {}
        self.sets: dict[int, set[str]] = {}
        self.held_codes = self.held_sets = 0

    def _codes(self, i: int) -> np.ndarray | None:
        """The distinct numbers of line i, sorted; None if it has a letter without a number."""
        if i not in self.codes:
            if self.held_codes > CODES:
                self.codes.clear()
                self.held_codes = 0
            h, found = self.number[points(self.lines[i])], None
            if h.max() < 1 << 15:
                h, width = h.astype(np.uint64), 1
                while width < self.k:
                    step = min(width, self.k - width)
                    h = (h[:-step] << np.uint64(self.bits * step)) | h[step:]
                    width += step
                h.sort()
                found = h[np.append(True, h[1:] != h[:-1])]
                self.held_codes += len(found)
            self.codes[i] = found
        return self.codes[i]

    def _set(self, i: int) -> set[str]:
        if i not in self.sets:
            if self.held_sets > SETS:
                self.sets.clear()
                self.held_sets = 0
            self.sets[i] = shingles(self.lines[i], self.k)
            self.held_sets += len(self.sets[i])
        return self.sets[i]

    def alike(self, i: int, j: int, similarity: float) -> bool:
        a, b = self._codes(i), self._codes(j)
        if a is None or b is None:
            return alike(self._set(i), self._set(j), similarity)
        return alike(a, b, similarity)


def shingle_hashes(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of lines of at least k characters, one line after another, and where each line's begin."""
    one = np.uint64(0x9E3779B97F4A7C15)
    h = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    width = 1
    while width < k:  # the polynomial hash of width characters, from two overlapping parts
        step = min(width, k - width)
        joined = h[: len(h) - step] * (one + np.uint64(2 * width))
        joined += h[step:]
        h = joined
        width += step
    counts = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)) - (k - 1)
    ends = np.cumsum(counts + (k - 1)) - (k - 1)
    h = np.concatenate([h[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h, np.cumsum(counts) - counts


@functools.cache
def permutations(n: int) -> list[tuple[np.uint32, np.uint32]]:
    """What n orders of shingles xor them with and multiply them by."""
    random = np.random.default_rng(7)
    return [(random.integers(1 << 32, dtype=np.uint32), random.integers(1 << 31, dtype=np.uint32) * np.uint32(2) + np.uint32(1)) for _ in range(n)]


def band_keys(lines: list[str], k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(lines, bands) hashes of MinHash bands, of lines of at least k characters."""
    h, starts = shingle_hashes(lines, k)
    base = (h >> np.uint64(32)).astype(np.uint32)
    mixed = np.empty_like(base)
    least = np.empty((bands * rows, len(lines)), dtype=np.uint32)
    for (mask, factor), out in zip(permutations(bands * rows), least, strict=True):
        np.bitwise_xor(base, mask, out=mixed)
        np.multiply(mixed, factor, out=mixed)
        np.minimum.reduceat(mixed, starts, out=out)
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    for r in range(rows):
        keys = (keys ^ least[r::rows]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return np.ascontiguousarray(keys.T)


def bitmaps(lines: list[str], k: int = SHINGLE) -> list[int]:
    """A bitmap of each line's shingles. Bits in which two differ are shingles that only one has: a lower bound, for a quick no."""
    out: list[int] = []
    for at in range(0, len(lines), 256):
        part = lines[at : at + 256]
        h, starts = shingle_hashes(part, k)
        bits = np.zeros((len(part), BITMAP), dtype=bool)
        bits[np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(h)))), (h >> np.uint64(20)).astype(np.int64) & (BITMAP - 1)] = True
        rows = np.packbits(bits, axis=1).tobytes()
        width = BITMAP // 8
        out += [int.from_bytes(rows[i : i + width], "big") for i in range(0, len(rows), width)]
    return out


def _worded(text: str | None, min_chars: int) -> Iterator[tuple[int, str]]:
    for number, line in enumerate(text.split("\n") if text else ()):
        line = normal(line)
        if line and len(line) >= min_chars:
            yield number, line


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """docs with _k and _t, hashes of id and text that stand for a document."""
    return docs.withColumn("_k", F.xxhash64(id_col)).withColumn("_t", F.xxhash64(text))


def occurrences(docs: DataFrame, id_col: str, text: str, k: int, bands: int, rows: int, min_chars: int, parts: int) -> DataFrame:
    """(id_col, _k, _t, line, h, g): the lines of docs by number and by two 64-bit hashes of their normal form. Between them rows of
    (part, pairs) alone: band keys of lines that have a whole shingle, each with the line's h, which fall in that part; a line's are left out where the task has given them lately."""
    kind = docs.schema[id_col].dataType.simpleString()
    columns = [id_col, "_k", "_t", "line", "h", "g", "part", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        types: list[pa.DataType] = []

        def given() -> pa.RecordBatch:
            part, pairs = packed(np.concatenate(held), parts)
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(part), t) for t in types), part, pairs], names=columns)

        for whole in batches:
            for batch, texts in shared.slices(whole, 3, 1 << 20):
                row, line, names, fresh, own = [], [], [], [], []
                for i, t in enumerate(texts):
                    for number, x in _worded(t.as_py(), min_chars):
                        name = xxhash.xxh3_128_digest(x)
                        if len(x) >= k and name[:8] not in seen:  # spares repeated work only; what is left is removed after the shuffle
                            seen.add(name[:8])
                            fresh.append(x)
                            own.append(name[:8])
                        row.append(i)
                        line.append(number)
                        names.append(name)
                if len(seen) > SEEN:
                    seen.clear()
                hashes = np.frombuffer(b"".join(names), dtype=np.int64)
                longs = [pa.array(np.ascontiguousarray(hashes[i::2])) for i in (0, 1)]
                arrays = [*(batch.column(c).take(pa.array(row, pa.int64())) for c in range(3)), pa.array(line, pa.int32()), *longs]
                types = [a.type for a in arrays]
                yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(row), pa.int32()), pa.nulls(len(row), pa.binary())], names=columns)
                if fresh:
                    keys = np.concatenate([band_keys(part, k, bands, rows).view(np.int64) for part in portions(fresh, 1 << 16)])
                    held.append(np.stack((keys.ravel(), np.repeat(np.frombuffer(b"".join(own), dtype=np.int64), bands)), axis=1))
                    if sum(map(len, held)) >= PAIRS:
                        yield given()
        if held:
            yield given()

    return keyed(docs, id_col, text).select(id_col, "_k", "_t", text).mapInArrow(run, f"`{id_col}` {kind}, _k long, _t long, line int, h long, g long, part int, pairs binary")


def packed(pairs: np.ndarray, parts: int) -> tuple[pa.Array, pa.Array]:
    """Rows of two 64-bit numbers dealt by the first into parts: the parts that have any, and the bytes of the rows of each."""
    part = (pairs[:, 0].view(np.uint64) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
    ends = np.cumsum(np.bincount(part, minlength=parts))
    some = np.flatnonzero(np.diff(ends, prepend=0))
    offsets = np.append(0, ends[some] * 16).astype(np.int32)
    data = np.ascontiguousarray(pairs[np.argsort(part, kind="stable")])
    return pa.array(some, pa.int32()), pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def buckets(found: DataFrame, parts: int) -> DataFrame:
    """(key, h, n, x, s, least) of the keys that two lines and more have, without repetition: n lines, and of their h the exclusive or, a sum and the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.frombuffer(b"".join([x for batch in batches for x in batch.column(0).to_pylist()]), dtype=np.int64).reshape(-1, 2)
        order = np.argsort(pairs[:, 0])
        key = pairs[order, 0]
        pairs = pairs[order[among(key)]]
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))[: len(pairs)]]
        pairs = pairs[among(pairs[:, 0])]
        if len(pairs):
            key, h = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(starts, len(key)))
            of = [np.repeat(x, n) for x in (n, np.bitwise_xor.reduceat(h, starts), np.add.reduceat(h >> 24, starts), h[starts])]
            table = pa.RecordBatch.from_arrays([pa.array(x) for x in (key, h, *of)], names=["key", "h", "n", "x", "s", "least"])
            yield from (table.slice(at, 50_000) for at in range(0, len(key), 50_000))

    dealt = found.where("pairs is not null").repartitionById(parts, F.col("part"))
    return dealt.select("pairs").mapInArrow(run, "key long, h long, n long, x long, s long, least long")


def among(key: np.ndarray) -> np.ndarray:
    """Of sorted keys, which occur twice and more."""
    same = np.zeros(len(key) + 1, dtype=bool)
    same[1:-1] = key[1:] == key[:-1]
    return same[1:] | same[:-1]


def portions(lines: list[str], chars: int) -> Iterator[list[str]]:
    """The lines, some at a time: about `chars` characters or one line."""
    held, size = [], 0
    for x in lines:
        held.append(x)
        size += len(x)
        if size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def verified(members: DataFrame, k: int, similarity: float, block: int) -> DataFrame:
    """Edges (u, v) that span the components of the lines (key, h, n, least, text), comparing within each key only. n and least are
    the number and the least h of a key's lines."""
    dealt = shared.blocks(members, ["key"], "h", block, count="n")
    near = F.when(F.col("n") <= block // 4, F.xxhash64("least")).otherwise(F.xxhash64("key", "a", "b"))
    dealt = dealt.withColumn("near", near).repartition(shared.partitions(members.sparkSession), "near").sortWithinPartitions("near", "key", "a", "b", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ids in shared.runs(batches, ["key", "a", "b"], rows=2000):
            h = table.column("h").to_pylist()
            text = table.column("text").to_pylist()
            place = {x: i for i, x in reversed(list(enumerate(h)))}
            forest = shared.Forest(len(h))
            rows = list(place.values())
            line = {i: normal(text[i]) for i in rows}
            bits = dict(zip(rows, bitmaps(list(line.values()), k), strict=True))
            size = {i: len(x) - k + 1 for i, x in line.items()}  # of shingles, repeats counted
            sets = Shingles(line, k)
            slack = (1 - similarity) / (1 + similarity)

            def linked(i: int, j: int) -> bool:
                if (bits[i] ^ bits[j]).bit_count() > slack * (size[i] + size[j]) + ROUNDING:
                    return False
                return sets.alike(i, j, similarity)

            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))).tolist()
            for lo, hi in zip(starts, [*starts[1:], len(h)], strict=True):
                clusters: dict[int, list[int]] = {}
                for i in dict.fromkeys(place[x] for x in h[lo:hi]):
                    met = [forest.find(i)]
                    for root, others in clusters.items():
                        if forest.find(root) == forest.find(i) or any(linked(i, j) and forest.join(i, j) for j in others):
                            met.append(root)
                    joined = [x for root in met for x in clusters.pop(root, ())]
                    clusters[forest.find(i)] = [*joined, i]
            if forest.edges:
                yield pa.RecordBatch.from_arrays([pa.array([h[e[s]] for e in forest.edges], pa.int64()) for s in (0, 1)], names=["u", "v"])

    return dealt.select("key", "a", "b", "chunk", "h", "text").mapInArrow(run, "u long, v long")


def first_place(id_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("_t").alias("t"), F.col("line").alias("l"), F.col("_k").alias("k"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """(_k, _t, lines): the numbers of the lines to drop, of each document that has any."""
    n = shared.partitions(docs.sparkSession)
    found = shared.cut(occurrences(docs, id_col, text, k, bands, rows, min_chars, n))
    lines = found.where("pairs is null").drop("part", "pairs")
    # Buckets of two lines and more; of buckets with the same lines one is enough.
    shaped = shared.cut(buckets(found, n))
    chosen = shaped.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key")
    members = shared.cut(shaped.select("key", "h", "n", "least").join(chosen, "key"))
    wanted = shared.cut(members.select("h").distinct())
    firsts = shared.sized_join(lines, wanted, ["h"], "left_semi").groupBy("h").agg(F.min(first_place(id_col)).alias("p"))
    places = shared.cut(firsts.groupBy(F.col("p.k").alias("_k"), F.col("p.t").alias("_t")).agg(F.collect_list(F.struct("h", F.col("p.l").alias("l"))).alias("_at")))
    holders = shared.sized_join(keyed(docs, id_col, text).select("_k", "_t", F.col(text).alias("_x")), places, ["_k", "_t"], "inner")
    texts = holders.select(F.inline(let(F.split("_x", "\n"), lambda parts: F.transform("_at", lambda p: F.struct(p["h"].alias("h"), F.get(parts, p["l"]).alias("text")))))).dropDuplicates(["h"])
    groups = shared.components(verified(members.join(texts, "h"), k, similarity, block))
    # Equal lines are one group; groups in one component are one.
    equal = lines.groupBy("h", "g").agg(F.min(first_place(id_col)).alias("p"), F.count(F.lit(1)).alias("n"))
    placed = equal.join(groups.select(F.col("node").alias("h"), "component"), "h", "left").where("n > 1 or component is not null")
    of = F.when(F.col("component").isNotNull(), F.struct(F.col("component").alias("c"), F.lit(None).cast("long").alias("g"))).otherwise(F.struct(F.col("h").alias("c"), F.col("g").alias("g")))
    placed = shared.cut(placed.withColumn("_of", of))
    kept_at = shared.cut(shared.least_of(placed, "_of", "p", "keep").select("h", "g", F.col("keep.k").alias("ck"), F.col("keep.t").alias("ct"), F.col("keep.l").alias("cl")))
    gone = shared.sized_join(lines, kept_at, ["h", "g"], "inner").where("not (_k = ck and _t = ct and line = cl)")
    return gone.groupBy("_k", "_t").agg(F.collect_set("line").alias("lines"))


def _freed(docs: DataFrame, id_col: str, text: str, how: dict) -> DataFrame:
    """(_row, _text, n_lines, n_dropped): each row of docs, its text freed of duplicate lines, and the lines (with a word) it had and lost."""
    gone = shared.cut(dropped_lines(docs, id_col, text, **how))
    rows = shared.packed(docs).withColumns({"_k": F.xxhash64(f"_row.{id_col}"), "_t": F.xxhash64(f"_row.{text}")})
    joined = shared.sized_join(rows, gone.withColumnRenamed("lines", "_gone"), ["_k", "_t"], "left")
    t = F.col(f"_row.{text}")
    freed = let(F.split(t, "\n"), lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone"), lambda i: F.get(parts, i)), "\n"))
    worded = F.size(F.filter(F.split(t, "\n"), lambda x: ~x.rlike(r"^[\x20\x09-\x0D]*$")))
    return joined.select("_row", F.when(F.col("_gone").isNull(), t).otherwise(freed).alias("_text"), F.when(t.isNull(), 0).otherwise(worded).cast("long").alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_dropped"))


def with_lines_dropped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with `text` freed of duplicate lines, and the columns n_lines (with a word) and n_dropped, to which others of that name give way."""
    columns = [F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return _freed(docs, id_col, text, how).select(*columns, "n_lines", "n_dropped")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with duplicate lines dropped; a document that loses all its lines goes, and n_chars, if there, follows the text."""
    out = _freed(docs, id_col, text, how).where((F.col("n_dropped") == 0) | ~F.col("_text").rlike(r"^[\x20\x09-\x0D]*$"))
    length = {"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in docs.columns else {}
    return out.select(*((length | {text: F.col("_text").alias(text)}).get(c, F.col(f"_row.`{c}`")) for c in docs.columns))
