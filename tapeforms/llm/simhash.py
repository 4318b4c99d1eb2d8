"""SimHash near-duplicates: 64-bit fingerprints of word shingles, self-joined as a binary trie.

A fingerprint takes each bit by majority over the XXH64 hashes of the text's word shingles. Two fingerprints link when at
most `budget` bits differ; a document's component is what links reach. Distinct fingerprints are nodes, so copies cost
one row. Two linked fingerprints agree on at least one of budget + 1 bit blocks, so the trie is entered once per block
with that block's bits first: the subtrees below it are the parallel units, and inside one, node pairs are traversed
together level by level with the differing bits added up, and dropped once the budget is exceeded. A subtree with too
many leaves is dealt into chunks, of which each pair is a unit (see shared.blocks). Only a spanning forest leaves a unit.

Edge cases: null, empty and blank texts have fingerprint 0 and link like any other; texts of fewer words than a shingle
are one shingle; repeated rows and equal ids each keep their row; an empty table gives an empty result; null ids keep
their fingerprint, and their component is the least id reachable (null if there is none); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeforms.llm import shared

BITS = 64
SHINGLE = 4
SEED = 42
BUDGET = 4
#: Leaves of a subtree that one task takes; larger subtrees are dealt into chunks of about this size.
BLOCK = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text. Letters A-Z are lower-cased and words end at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([digest(line, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[: len(words) - shingle] + 1)).tolist()
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id_col, _t, fp): _t is a hash of the text, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=[id_col, "_t", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.xxhash64(text).alias("_t"), text).mapInArrow(run, f"`{id_col}` {kind}, _t long, fp long")


def bounds(budget: int) -> list[tuple[int, int]]:
    """Shift and width of each of budget + 1 blocks of bits."""
    cuts = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def rotated(x: np.ndarray, shift: int) -> np.ndarray:
    """The bits turned so that the block at `shift` (from the low end) and what is above it come lowest."""
    return x if shift == 0 else (x >> np.uint64(shift)) | (x << np.uint64(BITS - shift))


def traverse(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted, distinct keys that differ in at most `budget` bits, by a walk over pairs of trie nodes.

    A node is a range of keys that agree on their top bits. lo[i]:hi[i] are the subtrees to join with themselves, whose
    first `depth` bits agree. The frontier is walked depth first in slices, so it stays small.
    """
    zero = np.zeros(len(lo), dtype=np.int64)
    stack = [(depth, lo, hi, lo.copy(), hi.copy(), zero)]
    limit = 1 << 17
    while stack:
        level, a0, a1, b0, b1, errors = stack.pop()
        if len(a0) > limit:
            stack.extend((level, a0[i : i + limit], a1[i : i + limit], b0[i : i + limit], b1[i : i + limit], errors[i : i + limit]) for i in range(0, len(a0), limit))
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            other = i != j
            i, j = i[other], j[other]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, errors = (x[~leaf] for x in (a0, a1, b0, b1, errors))
        if not len(a0) or level == BITS:
            continue
        bit = np.uint64(BITS - 1 - level)
        middle_a, middle_b = split(keys, a0, a1, bit), split(keys, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        children = []
        for left, right, more in ((0, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, 1)):
            x0, x1 = (a0, middle_a) if left == 0 else (middle_a, a1)
            y0, y1 = (b0, middle_b) if right == 0 else (middle_b, b1)
            keep = (x0 < x1) & (y0 < y1) & (errors + more <= budget)
            if (left, right) == (1, 0):
                keep &= ~same
            children.append((x0[keep], x1[keep], y0[keep], y1[keep], errors[keep] + more))
        joined = [np.concatenate(c) for c in zip(*children, strict=True)]
        if len(joined[0]):
            stack.append((level + 1, *joined))


def split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where in each range of sorted keys `bit`, the first in which they may differ, turns from 0 to 1."""
    first = (keys[lo] >> bit) & np.uint64(1)
    last = (keys[hi - 1] >> bit) & np.uint64(1)
    middle = np.where(first == 1, lo, hi)
    mixed = np.flatnonzero((first == 0) & (last == 1))
    a, b = lo[mixed], hi[mixed] - 1  # keys[a] has 0 and keys[b] has 1
    while len(a) and (b - a > 1).any():
        c = (a + b) // 2
        one = ((keys[c] >> bit) & np.uint64(1)) == 1
        b = np.where(one, c, b)
        a = np.where(one, a, c)
    middle[mixed] = b
    return middle


def links(prints: DataFrame, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between distinct fingerprints fp that span the components of the relation of at most `budget` differing bits."""
    places = bounds(budget)
    fields = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)).alias("k")) for i, (shift, width) in enumerate(places)]
    entries = prints.select("fp", F.inline(F.array(*fields)))
    dealt = shared.by_block(shared.blocks(entries, ["i", "k"], "fp", block), ["i", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ids in shared.runs(batches, ["i", "k", "a", "b"]):
            fp = table.column("fp").to_numpy().view(np.uint64)
            block_of = table.column("i").to_numpy()
            crossing = table.column("a").to_numpy() != table.column("b").to_numpy()
            chunk = table.column("chunk").to_numpy()
            for i, (shift, width) in enumerate(places):
                rows = np.flatnonzero(block_of == i)
                if not len(rows):
                    continue
                # The block's own bits come first; a unit is a range of sorted keys.
                turned = rotated(fp[rows], (shift + width) % BITS)
                order = np.lexsort((turned, ids[rows]))
                rows, turned = rows[order], turned[order]
                unit = ids[rows]
                lo = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
                hi = np.concatenate((lo[1:], [len(unit)]))
                forest = shared.Forest(len(rows))
                for x, y in traverse(turned, lo, hi, budget, width):
                    p, q = rows[x], rows[y]
                    mine = ~crossing[p] | (chunk[p] != chunk[q])
                    diff = fp[p] ^ fp[q]
                    for s, w in places[:i]:  # a pair that agrees on an earlier block is that block's
                        mine &= ((diff >> np.uint64(s)) & np.uint64((1 << w) - 1)) != 0
                    forest.join_all(x[mine], y[mine])
                if forest.edges:
                    ends = np.array(forest.edges)
                    yield pa.RecordBatch.from_arrays([pa.array(fp[rows[ends[:, k]]].view(np.int64)) for k in (0, 1)], names=["u", "v"])

    return dealt.select("i", "k", "a", "b", "chunk", "fp").mapInArrow(run, "u long, v long")


def _placed(prints: DataFrame, id_col: str, budget: int, block: int) -> DataFrame:
    """(fp, least, first, component) of each distinct fingerprint: its least id, and the first row that has an id, by id and hash of the text."""
    row = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("i"), F.col("_t").alias("t")))
    nodes = shared.cut(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.min(row).alias("first")))
    groups = shared.components(links(nodes.select("fp"), budget, block))
    return shared.cut(nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row of docs; component_id is the least id that links reach."""
    prints = shared.cut(fingerprints(docs, id_col, text, shingle))
    heads = shared.cut(shared.least_of(_placed(prints, id_col, budget, block), "component", "least", "component_id").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return shared.sized_join(prints, heads, ["fp"], "inner").select(id_col, hexed, "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """One row of each component: that with the least id and, of rows with that id in the component, the least text (by hash); of equal
    rows one. Rows that share an id but are no near-duplicates are judged apart. Rows without an id stay, as nothing can stand for them."""
    prints = shared.cut(fingerprints(docs, id_col, text, shingle))
    heads = shared.cut(_placed(prints, id_col, budget, block).groupBy("component").agg(F.min("first").alias("_h")).where("_h is not null").select(F.col("_h.i").alias("_id"), F.col("_h.t").alias("_t")))
    rows = shared.packed(docs).withColumns({"_id": F.col(f"_row.{id_col}"), "_t": F.xxhash64(f"_row.{text}")})
    counted = shared.cut(shared.sized_join(prints.select(F.col(id_col).alias("_id"), "_t"), heads, ["_id", "_t"], "inner").groupBy("_id", "_t").agg(F.count(F.lit(1)).alias("_n")))
    named = shared.sized_join(rows.where("_id is not null"), counted, ["_id", "_t"], "inner")
    # Only rows that share id and text are shuffled.
    one = named.where("_n > 1").groupBy("_id", "_t").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return named.where("_n = 1").select("_row").unionByName(one.select("_row")).unionByName(rows.where("_id is null").select("_row")).select("_row.*")
