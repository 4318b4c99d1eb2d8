"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the commoner form of each.

For each edit position i of a word w, what is near w there begins with w[:i] and ends with w[i + 1:]. In forward order the words with
that prefix are an interval, in the order of the reversed words those with that suffix are one; the words in both are reported
from a wavelet tree over the places that the words in forward order have in reverse order. Points are kept by length: of the length of w
they are replacements, of one less deletions, so that a rectangle holds nothing but near words (and w). Insertions are deletions seen from the
other word. A deletion in a run of equal code points is asked for at the run's first only, so each pair is found once.

Work is divided by what an edit leaves whole: words of a length that share their first half are searched for edits in the second, those that share their second half for
edits in the first, together with the words that are one shorter. Such groups are Spark's to shuffle. Large groups are dealt into chunks, and
each pair of chunks is a task's block. A task searches many groups, or one block, with two trees.

Edge cases: null and empty texts have no words; a null id counts as the empty string in the draw; repeated rows count each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeforms.llm import shared

# What a word is made of, how often the draw deletes a code point, and which words count.
LETTERS = "[A-Za-zÀ-ÿ]+"
BIG, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DRAW = 97
LEAST_CHARS, LEAST_COUNT = 5, 3
#: How many times as frequent as a word its form has to be.
FACTOR = 2
#: Words of a block, about, rectangles that are searched at once, and code points of words that are compared as a matrix.
BLOCK, AT_ONCE, MATRIX = 10_000, 200_000, 64
GROUP = ["unit", "side", "key"]


def words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", draw: int = DRAW) -> DataFrame:
    """(word) of every run of letters of every text; where `draw` divides the CRC-32 of `id:run`, a code point of the run is deleted."""
    found = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_i"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(LETTERS), F.lit(0))).alias("_x"))
    lowered = found.select("_i", F.translate("_x", BIG, SMALL).alias("_x"))
    drawn = lowered.select("_x", F.crc32(F.concat("_i", F.lit(":"), "_x").cast("binary")).alias("_h"))
    at = (F.col("_h") % F.length("_x")).cast("int")
    shorter = F.concat(F.substring("_x", F.lit(1), at), F.substring("_x", at + 2, F.length("_x")))
    return drawn.select(F.when(F.col("_h") % draw == 0, shorter).otherwise(F.col("_x")).alias("word"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, draw: int = DRAW) -> DataFrame:
    """(word, n): the distinct words of at least so many code points and occurrences."""
    counted = words(docs, id_col, text, draw).where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def grouped(vocab: DataFrame) -> DataFrame:
    """(unit, side, key, word, n): each word among those of its own length (unit) and those one longer, by what an edit in the other half leaves whole."""
    rows = []
    for longer in (0, 1):
        unit = F.length("word") + longer
        half = F.floor(unit / 2).cast("int")
        rows += [F.struct(unit.cast("int").alias("unit"), F.lit(side).alias("side"), key.alias("key")) for side, key in (("end", F.substring("word", F.lit(1), half)), ("start", F.expr(f"right(word, length(word) + {longer} - floor((length(word) + {longer}) / 2))")))]
    return vocab.select("word", "n", F.inline(F.array(*rows)))


class WaveletTree:
    """Distinct numbers 0 .. n-1 in some order, by their bits from the highest on; reports those of a range of places and a range of values."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.bits = max(1, int(self.size - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # zeros before each place, by level
        for b in reversed(range(self.bits)):
            ones = (values >> b & 1).astype(bool)
            self.zeros.append(np.concatenate(([0], np.cumsum(~ones))))
            values = np.concatenate((values[~ones], values[ones]))

    def report(self, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) for the values in [low, high) at the places [start, end) of each rectangle."""
        of = np.flatnonzero((start < end) & (low < high))
        s, e, least = start[of], end[of], np.zeros(len(of), dtype=np.int64)
        for level, zeros in enumerate(self.zeros):
            span = 1 << self.bits - 1 - level  # of values that a child holds
            s0, e0, n0 = zeros[s], zeros[e], zeros[-1]
            children = [(s0, e0, least), (n0 + s - s0, n0 + e - e0, least + span)]
            kept = [(a < b) & (v < high[of]) & (v + span > low[of]) for a, b, v in children]
            s, e, least = (np.concatenate([c[x][k] for c, k in zip(children, kept, strict=True)]) for x in range(3))
            of = np.concatenate([of[k] for k in kept])
        return of, least


class Order:
    """Words in the order of (run, word): the place of each, and for each of its prefixes the interval of the words that share it.

    low and high hold a word's intervals by the length of the prefix, from 0 to its own length, from first[word] on.
    """

    def __init__(self, words: list[str], run: np.ndarray, first: np.ndarray, size: np.ndarray):
        numbers = run.tolist()
        rows = np.array(sorted(range(len(words)), key=lambda i: (numbers[i], words[i])), dtype=np.int64)
        self.place = np.empty(len(rows), dtype=np.int64)
        self.place[rows] = np.arange(len(rows))
        self.low, self.high = np.empty(first[-1] + size[-1] + 1, dtype=np.int64), np.empty(first[-1] + size[-1] + 1, dtype=np.int64)
        common = np.where(run[rows[1:]] == run[rows[:-1]], common_prefixes([words[i] for i in rows.tolist()]), -1)
        places, level = np.arange(len(rows)), 0
        while len(places):
            breaks = np.concatenate(([True], common < level))
            begins = np.flatnonzero(breaks)
            of = np.cumsum(breaks) - 1
            at = first[rows[places]] + level
            self.low[at] = places[begins][of]
            self.high[at] = places[np.append(begins[1:], len(places)) - 1][of] + 1
            level += 1
            # Words that are too short drop out; none of them lies between two that share a longer prefix.
            stays = np.flatnonzero(size[rows[places]] >= level)
            if len(stays) < len(places):
                common = np.minimum.reduceat(common[: stays[-1]], stays[:-1]) if len(stays) > 1 else common[:0]
                places = places[stays]


def common_prefixes(words: list[str]) -> np.ndarray:
    """How many code points each word but the last shares with the next."""
    matrix = np.array([w[:MATRIX] for w in words], dtype=f"<U{MATRIX}").view("<u4").reshape(len(words), MATRIX)
    same = matrix[:-1] == matrix[1:]
    common = np.where(same.all(axis=1), MATRIX, same.argmin(axis=1))
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    common = np.minimum(common, np.minimum(size[:-1], size[1:]))
    for i in np.flatnonzero((common == MATRIX) & (size[:-1] > MATRIX) & (size[1:] > MATRIX)).tolist():
        a, b = (np.frombuffer(words[j].encode("utf-32-le"), dtype="<u4") for j in (i, i + 1))
        n = min(len(a), len(b))
        differs = np.flatnonzero(a[:n] != b[:n])
        common[i] = differs[0] if len(differs) else n
    return common


def near_pairs(words: list[str], run: np.ndarray, unit: np.ndarray, at_end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of words that are near, within their runs, each pair once.

    Words of a run are as long as its unit or one shorter. Their edits lie in the second half of the unit where at_end, else in the first.
    """
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    first = np.cumsum(size + 1) - size - 1
    forward = Order(words, run, first, size)
    backward = Order([w[::-1] for w in words], run, first, size)
    # Every edit position of every whole word.
    asks = np.flatnonzero(size == unit)
    half = size[asks] // 2
    begin, end = np.where(at_end[asks], half, 0), np.where(at_end[asks], size[asks], half)
    count = end - begin
    row = np.repeat(asks, count)
    position = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    before, after = first[row] + position, first[row] + size[row] - 1 - position
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    start = np.cumsum(size) - size
    here = start[row] + position
    for shorter in (False, True):
        held = np.flatnonzero(size == unit - shorter)
        if not len(held):
            continue
        ranks = []
        for order in (forward, backward):
            has = np.zeros(len(words) + 1, dtype=np.int64)
            has[order.place[held] + 1] = 1
            ranks.append(np.cumsum(has))  # points before a place
        by_place = held[np.argsort(forward.place[held])]
        values = ranks[1][backward.place[by_place]]
        whose = np.empty(len(held), dtype=np.int64)
        whose[values] = by_place
        sides = [ranks[0][forward.low[before]], ranks[0][forward.high[before]], ranks[1][backward.low[after]], ranks[1][backward.high[after]]]
        if shorter:
            wanted = (position == 0) | (points[here] != points[here - 1])
        else:
            sides[0] = ranks[0][forward.place[row]] + 1  # only words after it in forward order: of two replacements one is found
            wanted = sides[3] - sides[2] > 1
        wanted &= (sides[0] < sides[1]) & (sides[2] < sides[3])
        tree = WaveletTree(values)
        chosen = np.flatnonzero(wanted)
        for lo in range(0, len(chosen), AT_ONCE):
            some = chosen[lo : lo + AT_ONCE]
            of, value = tree.report(*(x[some] for x in sides))
            yield row[some[of]], whose[value]


def near(vocab: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, other, other_n) for each word of vocab (word, n) and each of its near words."""
    dealt = shared.by_block(shared.blocks(grouped(vocab), GROUP, "word", block), GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ids in shared.runs(batches, [*GROUP, "a", "b"]):
            word, n = table.column("word"), table.column("n")
            chunk = table.column("chunk").to_numpy()
            crossing = table.column("a").to_numpy() != table.column("b").to_numpy()
            at_end = np.asarray(pc.equal(table.column("side"), "end"))
            for x, y in near_pairs(word.to_pylist(), ids, table.column("unit").to_numpy().astype(np.int64), at_end):
                mine = ~crossing[x] | (chunk[x] != chunk[y])
                both = pa.array(np.concatenate((x[mine], y[mine]))), pa.array(np.concatenate((y[mine], x[mine])))
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (word.take(both[0]), word.take(both[1]), n.take(both[1]))], names=["word", "other", "other_n"])

    return dealt.select(*GROUP, "a", "b", "chunk", "word", "n").mapInArrow(run, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following forms ends. Each round doubles the steps, and counts grow along them, so rounds are few."""
    held = shared.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = held.select(F.col("word").alias("root"), F.col("root").alias("_to"))
        moved = shared.cut(shared.sized_join(held, onward, ["root"], "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")))
        if moved.where("_moved").isEmpty():
            return held
        held = moved.drop("_moved")


def variants(vocab: DataFrame, factor: float = FACTOR, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of vocab (word, n): its form is the commonest near word, ties by code points, if that is `factor` times as common."""
    vocab = shared.cut(vocab.select("word", "n"))
    best = near(vocab, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("w"))).alias("_best"))
    placed = shared.cut(shared.sized_join(vocab, shared.cut(best), ["word"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("_best.n") >= factor * F.col("n"), F.struct(F.col("_best.w").alias("form"), (-F.col("_best.n")).alias("form_n"))).alias("_form"),
    ))
    ends = roots(placed.where("_form is not null").select("word", "_form.form"))
    return shared.sized_join(placed, ends, ["word"], "left").select("word", "_form.form", F.coalesce("root", "word").alias("root"), "n", "n_near", "_form.form_n")
