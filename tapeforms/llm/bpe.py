"""Byte-level BPE as a monoid: halves are encoded apart and joined at their boundary, up a tree.

Within one piece (a match of the splitting pattern): a sequence of tokens is the encoding of its bytes exactly if each
adjacent pair of its tokens encodes to itself. So two encoded halves are joined by re-encoding the bytes of the last and
first w tokens around the boundary; if the pairs at both edges of that window are stable, all tokens outside it
provably are, else w doubles, at most to the whole. Within a text: where a non-space is followed by a space or line
feed, no match of the pattern spans the place and none depends on what stands before it, so the encoding of a text is
the concatenation of those of its segments, and texts cut anywhere are joined by re-encoding from the last such place on
the left to the first on the right. Decoding concatenates the bytes of tokens up the tree.

A task keeps the encodings of segments that it has met, in a bounded table; that only spares repeated work.

Edge cases: null and empty texts have no tokens; texts of any length are encoded whole; repeated rows give repeated
rows; nulls and extra columns of other kinds are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tapeforms.llm import shared

#: Bytes up to which a piece is merged in one go; longer ones are halved.
LEAF = 12
#: Characters up to which a text is encoded in one go; longer ones are halved.
TEXT_LEAF = 1 << 16
#: Bytes of a leaf of a long piece, which has no common halves.
LONG_LEAF = 512
#: Entries that a task's tables of pieces, leaves and pairs may each have, and bytes of its table of segments.
TABLE = 30_000
TABLE_BYTES = 32 << 20
#: White space beyond ASCII with a space or line feed after it: no safe place to cut.
UNSAFE = "[" + "".join(f"\\x{{{c:x}}}" for c in range(128, 1 << 16) if chr(c).isspace()) + "][ \n]"


class Codec:
    """The encoder and decoder for one table of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = dict(zip(ranks.values(), ranks, strict=True))
        self.stable: dict[tuple[int, int], bool] = {}
        self.leaves: dict[bytes, tuple[int, ...]] = {}
        self.pieces: dict[str, bytes] = {}
        #: Marks that are a match of their own at the end of a word.
        self.marks = bytes(m for m in b",.;:!?" if self.pattern.findall("a" + chr(m)) == ["a", chr(m)])
        self.segments = shared.WordIds(lambda segments: list(map(self.split_and_encode, segments)), TABLE_BYTES)

    def merged(self, data: bytes) -> tuple[int, ...]:
        """A leaf: the pair of least rank, the leftmost of these, is merged until none is in the table."""
        if len(data) > 128:
            return self.merged_by_heap(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        near = [ranks.get(data[i : i + 2], 1 << 60) for i in range(len(data) - 1)]
        while near:
            least = min(near)
            if least == 1 << 60:
                break
            i = near.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return tuple([ranks[p] for p in parts])

    def merged_by_heap(self, data: bytes) -> tuple[int, ...]:
        """merged() for wide windows: pairs wait in a heap, by rank and place."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            j = before[i]
            if j >= 0 and (r := ranks.get(data[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def is_stable(self, a: int, b: int) -> bool:
        found = self.stable.get((a, b))
        if found is None:
            found = self.stable[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
            if len(self.stable) > TABLE:
                self.stable.clear()
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of two encodings together."""
        if not left or not right or self.is_stable(left[-1], right[0]):
            return left + right
        w = 1
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b])))
            if (a == 0 or self.is_stable(left[a - 1], window[0])) and (b == len(right) or self.is_stable(window[-1], right[b])):
                return left[:a] + window + right[b:]
            w *= 2

    def tree(self, data: bytes, leaf: int) -> tuple[int, ...]:
        if len(data) > leaf:
            middle = len(data) // 2
            return self.join(self.tree(data[:middle], leaf), self.tree(data[middle:], leaf))
        if leaf > LEAF:
            return self.merged(data)
        found = self.leaves.get(data)
        if found is None:
            if len(self.leaves) > TABLE:
                self.leaves.clear()
            found = self.leaves[data] = self.merged(data)
        return found

    def piece(self, text: str) -> bytes:
        """The ids of a match of the pattern, as little-endian unsigned 32-bit integers."""
        found = self.pieces.get(text)
        if found is None:
            data = text.encode()
            whole = self.ranks.get(data)
            ids = (whole,) if whole is not None else self.tree(data, LEAF if len(data) <= LONG_LEAF else LONG_LEAF)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(data) <= 64:
                if len(self.pieces) > TABLE:
                    self.pieces.clear()
                self.pieces[text] = found
        return found

    def split_and_encode(self, text: str) -> bytes:
        """The ids of a text that is taken as it is."""
        return b"".join(map(self.piece, self.pattern.findall(text)))

    def texts(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. Where a non-space is followed by a space or line feed, the text is cut, and the ids of its
        segments are put together; a text with other white space than that of ASCII before such a place is encoded by itself."""
        ids, begins = self.segments.of(texts, marks=self.marks)
        ends = (4 * begins).tolist()
        data = ids.tobytes()
        out = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for i in np.flatnonzero(np.asarray(pc.match_substring_regex(texts, UNSAFE))).tolist():
            out[i] = self.text(texts[i].as_py())
        return out

    def text(self, text: str) -> bytes:
        """The ids of a text, by halves; a half is cut at the safe place nearest to its middle."""
        if len(text) <= TEXT_LEAF:
            return self.split_and_encode(text)
        middle = len(text) // 2
        for reach in (64, 4096, len(text)):  # the window about the middle grows until it has a safe place
            a, b = max(1, middle - reach), min(len(text) - 1, middle + reach)
            safe = re.search("(?<=\\S)[ \n]", text[a - 1 : b])
            if safe:
                at = a - 1 + safe.start()
                return self.text(text[:at]) + self.text(text[at:])
        return self.split_and_encode(text)

    def forget(self) -> None:
        """Gives up the tables, so that a worker that waits for other tasks holds none."""
        for table in (self.stable, self.leaves, self.pieces):
            table.clear()
        self.segments.forget()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, concatenated up a binary tree."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, ids): ids are little-endian unsigned 32-bit integers in binary. The file at path is on every machine."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part, texts in shared.slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.texts(texts), pa.binary())], names=[id_col, "ids"])
        own.forget()

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decoded(ids: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, data): the bytes that ids (binary, as of encoded()) stand for."""
    kind = ids.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [None if x.as_py() is None else own.decode(np.frombuffer(x.as_py(), dtype="<u4")) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=[id_col, "data"])

    return ids.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row: texts encoded, and the ids decoded again."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part, texts in shared.slices(batch, 1):
                ids = own.texts(texts)
                data = (own.decode(np.frombuffer(x, dtype="<u4")) for x in ids)
                columns = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()),
                    *([pa.array(ids, pa.binary())] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])
        own.forget()

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
